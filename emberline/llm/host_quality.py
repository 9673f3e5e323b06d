"""Operator 1: host-level quality rules.

Rules judge each document; their failures are summed by host, each host's failure rate is shrunk towards the
corpus by a beta prior fitted to all hosts, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import bounded, kept_columns, materialise, plain_text, read_spread, row_numbers, space_words, word_ids

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
#: Hosts whose verdicts are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 200_000

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    ends = np.cumsum(counts)
    return before[ends] - before[ends - counts]


def _repeated(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which words lie in a window of WINDOW words that its own text holds twice or more."""
    n = len(ids)
    hit = np.zeros(n + 1, np.int64)
    if n < WINDOW:
        return hit[:n].astype(bool)
    code, length = ids, 1
    while length < WINDOW:  # exact: equal codes mean equal runs of words
        pair = code[:-length] << np.int64(32) | code[length:]
        code = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        length *= 2
    inside = rows[: len(code)] == rows[WINDOW - 1 :]
    where = np.flatnonzero(inside)
    key = rows[where] << np.int64(32) | code[where]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = where[count[inverse] > 1]
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + WINDOW, -1)
    return np.cumsum(hit[:n]) > 0


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    lines = pc.split_pattern(texts, "\n")
    rows = row_numbers(pc.list_value_length(lines).to_numpy().astype(np.int64))
    flat = lines.flatten()
    worded = pc.match_substring_regex(flat, r"[^ \t\n\x0b\f\r]").to_numpy(zero_copy_only=False)
    ids, _ = word_ids(flat.filter(pa.array(worded)))
    rows = rows[worded]
    _, first = np.unique(rows << np.int64(32) | ids, return_index=True)
    return np.bincount(rows, minlength=len(texts)) - np.bincount(rows[first], minlength=len(texts))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    words, counts = space_words(texts)
    ids, _ = word_ids(words)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    table = np.zeros(256, bool)
    table[list(b"#*$%&|<>")] = True
    start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    return {
        "n_words": counts,
        "word_chars": _per_row(chars, counts),
        "n_symbols": _per_row(table[data[start : start + sizes.sum()]], sizes),
        "n_dup_lines": _duplicate_lines(texts),
        "n_repeat_words": _per_row(_repeated(ids, row_numbers(counts)), counts),
    }


def with_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (all unless given) and the MEASURES, a row for each row of docs."""
    keep = docs.columns if keep is None else keep
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("measured"))
    schema = ", ".join([f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))] + [f"m{i} bigint" for i in range(len(MEASURES))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "measured"):
            found = measure(plain_text(batch.column("measured")))
            kept = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], [*(f"k{i}" for i in range(len(keep))), *(f"m{i}" for i in range(len(MEASURES)))])

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"m{i}").alias(c) for i, c in enumerate(MEASURES)])


def base_rule():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the beta distribution of hosts' failure rates, by the method of moments.

    hosts: n and failed of each. One row of sums reaches the driver. The spread between hosts is what remains of the
    weighted variance after the binomial one; without any, the prior weighs as much as 1,000 documents.
    """
    row = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("s")).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = row["f"] / row["n"]
    noise = mean * (1 - mean)
    if not noise:
        return mean, 1 - mean
    spread = row["s"] / row["n"] - mean * mean - noise * row["k"] / row["n"]
    weight = min(1000.0, max(1.0, noise / spread - 1)) if spread > 0 else 1000.0
    return mean * weight, (1 - mean) * weight


def host_rates(measured: DataFrame) -> DataFrame:
    """host_key and host_rate, the shrunk share of failures, of rows with host_key and base_failed; broadcast if few enough."""
    hosts = materialise(measured.where(F.col("host_key").isNotNull()).groupBy("host_key").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    alpha, beta = beta_prior(hosts)
    rates = hosts.select("host_key", ((F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))).alias("host_rate"))
    # The hosts' number is known here: up to BROADCAST_HOSTS take 20 MB, and beyond that both sides are shuffled.
    return F.broadcast(rates) if hosts.count() <= BROADCAST_HOSTS else rates


def _judged(measured: DataFrame, rates: DataFrame, max_rate: float) -> DataFrame:
    return measured.join(rates, "host_key", "left").withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= F.lit(max_rate)))


def _measured(docs: DataFrame, host: str, text: str, keep: list[str]) -> DataFrame:
    """The columns of keep as c0, c1 ..., host_key, the MEASURES and base_failed."""
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    inner = docs.select(*own, F.col(f"`{host}`").alias("host_key"), F.col(f"`{text}`").alias("host_text"))
    return with_measures(inner, "host_text", [*(f"c{i}" for i in range(len(keep))), "host_key"]).withColumn("base_failed", base_rule())


def host_quality(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE, keep: list[str] | None = None) -> DataFrame:
    """Each row of docs with its MEASURES, base_failed, host_rate (shrunk) and kept.

    kept: base_failed is false and the host's shrunk rate is at most max_rate. A null host has no verdict: its rows
    are kept by the base rule alone and host_rate is null. Null and empty texts have no words, so they fail.
    Repeated rows count and return as often as they occur; an empty table gives an empty one. Texts of any length are
    measured whole, a row at a time where it is long. Columns of docs other than host and text don't take part; they pass
    through, but for those named like a result, which the result replaces.
    """
    keep = kept_columns(docs, keep, [*MEASURES, "base_failed", "host_rate", "kept"])
    measured = materialise(_measured(docs, host, text, keep), "measures")
    out = _judged(measured, host_rates(measured), max_rate)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, "base_failed", "host_rate", "kept")


def keep_good_hosts(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns, whatever their names.

    Texts are measured once for the hosts and once more for the verdicts, which takes less than to write them again.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    measured = lambda keep: _measured(inner, names[docs.columns.index(host)], names[docs.columns.index(text)], keep)
    judged = _judged(measured(names), host_rates(measured([])), max_rate)
    return judged.where("kept").select(*names).toDF(*docs.columns)


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(read_spread(spark, sf_dir, "documents"), keep=["doc_id"]).drop("host_rate")


SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r) GROUP BY doc_id),
ls AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ls GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(f * f / n) AS s FROM h),
v AS (SELECT f / n AS mu, f / n * (1 - f / n) AS noise, s / n - (f / n) * (f / n) - f / n * (1 - f / n) * k / n AS spread FROM s),
prior AS (SELECT mu, CASE WHEN noise = 0 THEN 1.0 WHEN spread > 0 THEN least(1000.0, greatest(1.0, noise / spread - 1)) ELSE 1000.0 END AS weight FROM v),
q AS (SELECT source, (f + mu * weight) / (n + weight) AS host_rate FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_rate, 0) <= 0.5 AS kept FROM b LEFT JOIN q USING (source)
"""

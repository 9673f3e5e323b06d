"""Operator 7: a quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of their vote
patterns estimates each labeller's accuracy on either class, and so the chance that a document with a pattern is good. Those posteriors are the labels of a linear scorer over hashed features, which then scores every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import bounded, kept_columns, mix, plain_text, read_spread, row_numbers, space_words, word_ids
from emberline.llm.host_quality import measure

#: Documents with words whose posteriors train the scorer, at most; EM's counts are of all documents.
SAMPLE = 4000
#: Copies of texts that a task draws keys for at one time.
COPIES = 1 << 20
BUCKETS = 1 << 15
ROUNDS = 150
#: Function words of the languages expected, for one of the labellers.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was on are as with be by at this from or an a "
    "der die das und ist nicht ein eine von zu den mit sich auf für im dem des "
    "le la les de des et un une est que qui dans pour sur par au du pas avec "
    "el los las que y en un una es por con para del se al su".split()
)


def signals(texts: pa.Array) -> dict[str, np.ndarray]:
    """What the labellers look at, of each text; shares are 0 for a text without words."""
    found = measure(texts)
    words, counts = space_words(texts)
    ids, dictionary = word_ids(words)
    rows, n = row_numbers(counts), len(texts)
    many, chars = np.maximum(counts, 1), np.maximum(found["word_chars"], 1)
    of = lambda flags: np.bincount(rows, weights=np.asarray(flags, np.float64)[ids], minlength=n) if len(ids) else np.zeros(n)
    value = lambda x: x.to_numpy(zero_copy_only=False)
    function = value(pc.is_in(pc.utf8_lower(dictionary), value_set=pa.array(sorted(FUNCTION_WORDS))))
    upper = value(pc.utf8_is_upper(dictionary)) & (value(pc.utf8_length(dictionary)) > 1)
    shout = value(pc.match_substring(dictionary, "!!"))
    marks = value(pc.match_substring_regex(dictionary, r"^[^\pL\pN]+$"))
    return {
        "words": counts,
        "symbols": found["n_symbols"] / chars,
        "repeats": found["n_repeat_words"] / many,
        "dup_lines": found["n_dup_lines"],
        "stutter": np.bincount(rows[1:][(ids[1:] == ids[:-1]) & (rows[1:] == rows[:-1])], minlength=n) / many,
        "function": of(function) / many,
        "upper": of(upper) / many,
        "shout": of(shout) / many,
        "marks": of(marks) / many,
        "length": found["word_chars"] / many,
    }


LABELLERS = ["symbols", "repeats", "stutter", "upper", "marks", "shout", "function", "words", "length"]


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """A column for each labeller: 1 good, -1 bad, 0 nothing."""
    pick = lambda bad, good=False: np.where(bad, -1, np.where(good, 1, 0))
    some = s["words"] >= 15
    return np.stack([
        pick(s["symbols"] > 0.08),
        pick(s["repeats"] > 0.3),
        pick((s["stutter"] > 0.12) & (s["words"] >= 5)),
        pick(s["upper"] > 0.4),
        pick(s["marks"] > 0.15),
        pick(s["shout"] > 0.2),
        pick((s["function"] < 0.02) & some, (s["function"] > 0.08) & some),
        pick(s["words"] < 2, s["words"] >= 20),
        pick((s["length"] > 14) | (s["length"] < 2), (s["length"] > 3) & (s["length"] < 9)),
    ], axis=1) * (s["words"] > 0)[:, None]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern, each labeller's chances to vote bad, nothing and good for the classes bad and good, and the share of good.

    A labeller that votes either way says nothing by its silence; one that only ever votes bad does. It starts from the
    votes' sum, a vote for bad weighing as two, and ten pseudo-votes keep chances off 0 and 1.
    """
    silent = (patterns == 0) & (patterns > 0).any(axis=0)
    weights = counts.astype(np.float64)
    posterior = 1 / (1 + np.exp(-np.where(patterns < 0, 2.0 * patterns, patterns).sum(axis=1)))
    chances, share = np.zeros((2, 3, patterns.shape[1])), 0.5
    for _ in range(rounds):
        for c, p in ((0, 1 - posterior), (1, posterior)):
            seen = np.stack([((patterns == v) & ~silent).T @ (weights * p) for v in (-1, 0, 1)])
            chances[c] = (seen + 10 / 3) / (seen.sum(axis=0) + 10)
        share = float((weights @ posterior + 5) / (weights.sum() + 10))
        logs = [np.where(patterns < 0, np.log(x[0]), np.where(patterns > 0, np.log(x[2]), np.where(silent, 0, np.log(x[1])))).sum(axis=1) for x in chances]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] + np.log1p(-share) - logs[1] - np.log(share), -500, 500)))
    return posterior, chances, share


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B], table[0x61:0x7B], table[0x80:], table[0x30:0x3A] = 65, 97, 97, 48
    return table


_CLASS = _classes()


def _buckets(dictionary: pa.Array) -> np.ndarray:
    """Two hashed features of each word: itself, and its shape (runs of one class of characters as one)."""
    offsets = np.frombuffer(dictionary.buffers()[1], np.int32, len(dictionary) + 1, dictionary.offset * 4).astype(np.int64)
    raw = np.frombuffer(dictionary.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    out = np.zeros((2, len(dictionary)), np.int64)
    for k, data in enumerate((raw, _CLASS[raw])):
        first = np.zeros(len(data), bool)
        first[starts] = True
        held = np.ones(len(data), bool) if not k else first | np.concatenate([[True], data[1:] != data[:-1]])
        order = np.cumsum(held) - 1
        place = order - np.repeat(order[starts], np.diff(offsets))
        part = np.where(held, mix(data.astype(np.uint64) + np.uint64(256) * place.astype(np.uint64), 20 + k), np.uint64(0))
        out[k] = (mix(np.add.reduceat(part, starts)) % np.uint64(BUCKETS)).astype(np.int64) + k * BUCKETS
    return out


def _binned(s: dict[str, np.ndarray]) -> np.ndarray:
    """Hashed features of the signals' bins, one column for each signal."""
    edges = {"words": [1, 5, 20, 100, 1000], "dup_lines": [1, 3, 10], "length": [2, 3, 5, 7, 9, 14]}
    cols = [np.searchsorted(edges.get(name, [0.005, 0.02, 0.08, 0.2, 0.4]), values, side="right") + 16 * k for k, (name, values) in enumerate(s.items())]
    return np.stack(cols, axis=1) + 2 * BUCKETS


SIZE = 2 * BUCKETS + 16 * 10


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of each feature of the texts, and the votes."""
    s = signals(texts)
    words, counts = space_words(texts)
    ids, dictionary = word_ids(words)
    rows, n = row_numbers(counts), len(texts)
    cols = _buckets(dictionary)[:, ids] if len(ids) else np.zeros((2, 0), np.int64)
    key = np.concatenate([(rows * SIZE + cols[k]) for k in range(2)])
    key, many = np.unique(key, return_counts=True)
    binned = _binned(s)
    row = np.concatenate([key // SIZE, np.repeat(np.arange(n), binned.shape[1])])
    col = np.concatenate([key % SIZE, binned.ravel()])
    value = np.concatenate([many / np.maximum(counts, 1)[key // SIZE], np.ones(binned.size)])
    return row, col, value, votes(s)


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic scorer, by gradient steps with a rate of its own for each weight; the last is the intercept.

    times: how many documents each row stands for, one if not given.
    """
    weights, squares = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-8)
    times = np.ones(len(target)) if times is None else times
    share = times / times.sum()
    for _ in range(rounds):
        score = np.bincount(row, weights=value * weights[col], minlength=len(target)) + weights[-1]
        wrong = (1 / (1 + np.exp(-score)) - target) * share
        gradient = np.append(np.bincount(col, weights=value * wrong[row], minlength=SIZE), wrong.sum()) + 1e-6 * weights
        squares += gradient * gradient
        weights -= 0.3 * gradient / np.sqrt(squares)
    return weights


def _pattern(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1).astype(np.int64)


@dataclass
class Scorer:
    """weights of the hashed features; chances and share as EM estimated them, posteriors by pattern."""

    weights: np.ndarray
    chances: np.ndarray
    share: float
    posteriors: dict[int, float]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's score and posterior of being good; both 0 for a text without words."""
        s = signals(texts)
        words, counts = space_words(texts)
        ids, dictionary = word_ids(words)
        each = self.weights[_buckets(dictionary)].sum(axis=0)[ids] if len(ids) else np.zeros(0)
        total = np.bincount(row_numbers(counts), weights=each, minlength=len(texts)) / np.maximum(counts, 1)
        total += self.weights[_binned(s)].sum(axis=1) + self.weights[-1]
        there = counts > 0
        posterior = np.array([self.posteriors.get(int(p), self.share) for p in _pattern(votes(s))])
        return np.where(there, 1 / (1 + np.exp(-total)), 0.0), np.where(there, posterior, 0.0)


def drawn(inner: DataFrame, total: int, sample: int) -> dict[int, int]:
    """Hashes of the bodies in an even sample of the rows with words, total in all, and how many of its rows each has.

    Each row has a key, from its text's hash and its number among the text's copies; the sample is the rows of the
    lowest keys. It depends on the texts alone, not on how they are dealt. Copies are counted before keys are drawn,
    and only keys below a limit, about as many as the sample, reach the driver.
    """
    limit = np.uint64(int(min(1.0, (sample + 8 * sample**0.5) / total) * (1 << 63)))
    copies = inner.where(F.col("body").rlike(r"[^ \t-\r]")).groupBy(F.xxhash64("body").alias("hash")).agg(F.count("*").alias("n"))

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, many = (batch.column(k).to_numpy() for k in ("hash", "n"))
            ends = np.cumsum(many)
            for at in range(0, int(many.sum()), COPIES):
                place = np.arange(at, min(at + COPIES, int(ends[-1])))
                of = np.searchsorted(ends, place, side="right")
                key = mix(hashes[of].view(np.uint64) ^ mix(place - (ends - many)[of], 31), 32) >> np.uint64(1)
                low = key < limit
                yield pa.RecordBatch.from_arrays([pa.array(hashes[of][low]), pa.array(key[low].view(np.int64))], ["hash", "key"])

    return Counter(x["hash"] for x in copies.mapInArrow(keys, "hash bigint, key bigint").orderBy("key", "hash").limit(sample).collect())


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Scorer | None:
    """EM over all of docs, then the scorer from an even sample of those with words; None where no text has words.

    A text stands in the sample once, with the number of its rows drawn as its weight. The driver gets a row for each
    vote pattern (3 to the number of labellers, at most) and the sample's features.
    """
    inner = docs.select(F.col(f"`{text}`").cast("string").alias("body"))

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            s = signals(plain_text(batch.column("body")))
            found, many = np.unique(_pattern(votes(s))[s["words"] > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(many.astype(np.int64))], ["pattern", "n"])

    counted = inner.mapInArrow(vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).sort("pattern").collect()
    if not counted:
        return None
    number = np.array([x["pattern"] for x in counted])
    patterns = number[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    posterior, chances, share = estimate(patterns, np.array([x["n"] for x in counted]))
    posteriors = dict(zip(number.tolist(), posterior.tolist(), strict=True))
    times = drawn(inner, sum(x["n"] for x in counted), sample)
    hashes = docs.sparkSession.createDataFrame(pa.table({"hash": pa.array(sorted(times), pa.int64())}))
    picked = inner.withColumn("hash", F.xxhash64("body")).join(F.broadcast(hashes), "hash").select("hash", "body")

    def unseen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            first = [k for k, x in enumerate(batch.column("hash").to_pylist()) if x not in seen and not seen.add(x)]
            yield batch.take(pa.array(first, pa.int64()))

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(unseen(batches), "body"):
            row, col, value, v = _features(plain_text(batch.column("body")))
            order = np.argsort(row, kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(t))) for x, t in ((col, np.int32), (value, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(_pattern(v)), *lists], ["hash", "pattern", "cols", "vals"])

    rows = picked.mapInArrow(featured, "hash bigint, pattern bigint, cols array<int>, vals array<float>").dropDuplicates(["hash"]).toArrow()
    rows = rows.filter(pc.is_in(rows["pattern"], value_set=pa.array(number)))
    if not rows.num_rows:
        return Scorer(np.zeros(SIZE + 1), chances, share, posteriors)
    # The order in which tasks answer must not matter for the weights' last digits.
    rows = rows.take(pc.sort_indices(rows["hash"]))
    target = np.array([posteriors[p] for p in rows["pattern"].to_pylist()])
    cols, vals = rows["cols"].combine_chunks(), rows["vals"].combine_chunks()
    row = row_numbers(pc.list_value_length(cols).to_numpy().astype(np.int64))
    many = np.array([times[x] for x in rows["hash"].to_pylist()], np.float64)
    return Scorer(fit(row, cols.flatten().to_numpy(), vals.flatten().to_numpy().astype(np.float64), target, times=many), chances, share, posteriors)


def weak_quality(docs: DataFrame, text: str = "text", keep: list[str] | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Each row of docs with score, posterior (from the votes alone) and kept (score of at least threshold).

    Null texts and those without words score 0 and aren't kept. Repeated rows count and return as often as they occur;
    an empty table gives an empty one. Texts of any length are read whole. Columns other than text pass through unread,
    but for those named like a result, which the result replaces.
    """
    keep = kept_columns(docs, keep, ["score", "posterior", "kept"])
    kept = [f"c{i}" for i in range(len(keep))]
    scorer = train(docs, text, sample) or Scorer(np.zeros(SIZE + 1), np.zeros((2, 3, len(LABELLERS))), 0.5, {})
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    inner = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text}`").cast("string").alias("body"))
    schema = ", ".join([*(f"{k} {inner.schema[k].dataType.simpleString()}" for k in kept), "score double, posterior double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            score, posterior = shared.value.score(plain_text(batch.column("body")))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(score), pa.array(posterior)], [*kept, "score", "posterior"])

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "score", "posterior", (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    return weak_quality(docs.toDF(*names), names[docs.columns.index("text")]).where("kept").select(*names).toDF(*docs.columns)


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(read_spread(spark, sf_dir, "documents"), keep=["doc_id"])

"""Operator 2: benchmark decontamination with suffix arrays.

Each task turns its shard of the training words into a suffix array and binary-searches every suffix of the test texts
in it. The intervals found give the longest verbatim matches and all locations of each window of test words; documents
with such a window are affected.

Suffixes are sparse: q words that follow each other become one symbol if they occur in a test text, and all others
separate. A suffix that starts at a separator matches no test suffix of q words or more, so the array leaves it out;
q is never more than the shortest window, so no match is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import bounded, folded_words, kept_columns, materialise, plain_text, read_spread, read_table, row_numbers, word_ids

WINDOW = 10
MAX_SEED = 4
#: Bytes of test text that are searched for at one time, about seven times as many as an index; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20


@dataclass
class TestIndex:
    """The test texts as symbols. tables: for each further word of a seed, the sorted codes of the seeds so far."""

    vocabulary: pa.Array
    tables: list[np.ndarray]
    symbols: np.ndarray  # of each suffix's start, 0 where a text ends; zeros follow
    starts: np.ndarray  # of the suffixes
    lengths: np.ndarray  # in words, of the suffixes
    widths: np.ndarray  # in words, of a window of the suffix's text
    window: np.ndarray  # number of the window that the suffix begins with and stands for, or -1
    window_words: np.ndarray
    item_offsets: np.ndarray  # of each window in items
    items: list[str]
    window_items: np.ndarray

    @property
    def seed(self) -> int:
        return len(self.tables) + 1


def _seeds(words: np.ndarray, rows: np.ndarray, tables: list[np.ndarray], size: int) -> np.ndarray:
    """The symbol of the seed that starts at each word, 0 for none."""
    symbols = words
    for k, table in enumerate(tables, 1):
        codes = np.zeros(len(words), np.int64)
        there = np.flatnonzero((symbols[:-k] > 0) & (words[k:] > 0) & (rows[:-k] == rows[k:])) if len(words) > k else np.zeros(0, np.int64)
        code = symbols[there] * np.int64(size + 1) + words[there + k]
        at = np.minimum(np.searchsorted(table, code), max(0, len(table) - 1))
        codes[there] = np.where(table[at] == code, at + 1, 0) if len(table) else 0
        symbols = codes
    return symbols


def _run_codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A code of the width words from each place on, equal for equal runs; the last width - 1 places have none."""
    code, length = ids, 1
    while length < width:
        step = min(length, width - length)
        pair = code[: len(code) - step] * np.int64(len(ids) + 2) + code[step:]
        code, length = np.unique(pair, return_inverse=True)[1].astype(np.int64), length + step
    return code


def test_index(items: list[tuple[str | None, str]], window: int = WINDOW) -> TestIndex | None:
    """items: id and text of each test item. None if there is no word in them. All steps are over arrays."""
    words, counts = folded_words(plain_text(pa.array([text for _, text in items], pa.string())))
    if not len(words):
        return None
    ids, vocabulary = word_ids(words)
    ids += 1
    rows = row_numbers(counts)
    size = len(vocabulary)
    seed = int(min(MAX_SEED, window, counts[counts > 0].min()))
    tables, symbols = [], ids
    for k in range(1, seed):
        there = np.flatnonzero((symbols[:-k] > 0) & (rows[:-k] == rows[k:]))
        table = np.unique(symbols[there] * np.int64(size + 1) + ids[there + k])
        tables.append(table)
        symbols = _seeds(ids, rows, tables, size)
    ends = np.cumsum(counts)[rows]
    at = np.arange(len(ids))
    starts = np.flatnonzero(symbols)
    # A window has `window` words, or all of a shorter item; equal windows are one, numbered by width and code.
    wide = np.minimum(counts, window)[rows]
    begins = np.flatnonzero(at + wide <= ends)
    first, numbers, window_words = np.full(len(ids), -1, np.int32), np.zeros(len(begins), np.int64), []
    for width in np.unique(wide[begins]):
        own = np.flatnonzero(wide[begins] == width)
        _, place, inverse = np.unique(_run_codes(ids, int(width))[begins[own]], return_index=True, return_inverse=True)
        numbers[own] = inverse + len(window_words)
        first[begins[own[place]]] = np.arange(len(place)) + len(window_words)
        window_words += [int(width)] * len(place)
    named = pc.dictionary_encode(pa.array([name for name, _ in items], pa.string()))
    item = pc.fill_null(named.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[rows[begins]]
    listed = np.unique(numbers[item >= 0] * np.int64(len(items) + 1) + item[item >= 0])
    held = np.bincount(listed // (len(items) + 1), minlength=len(window_words))
    # Suffixes of different texts are kept apart by a zero.
    shifted = np.zeros(len(ids) + int(rows[-1]) + 2, np.int32)
    shifted[at + rows] = symbols
    return TestIndex(
        vocabulary, tables, shifted, starts + rows[starts], (ends[starts] - starts).astype(np.int32), wide[starts].astype(np.int32), first[starts], np.array(window_words, np.int64),
        np.concatenate([[0], np.cumsum(held)]).astype(np.int64), named.dictionary.to_pylist(), listed % (len(items) + 1),
    )


def no_index(window: int = WINDOW) -> TestIndex:
    """An index of which nothing occurs in any text: its only word has a character that separates words."""
    out = test_index([("", "0")], window)
    out.vocabulary = pa.array(["-"])
    return out


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of symbols that don't start with 0, sorted by their first depth symbols (prefix doubling)."""
    rank, n, length = symbols, len(symbols), 1
    live = np.flatnonzero(symbols)
    while length < depth:
        after = np.zeros(n, np.int64)
        if length < n:
            after[: n - length] = rank[length:]
        different, inverse = np.unique(rank[live] * np.int64(n + int(rank.max()) + 2) + after[live], return_inverse=True)
        rank = np.zeros(n, np.int64)
        rank[live] = inverse + 1
        length *= 2
        if len(different) == len(live):
            break
    return live[np.argsort(rank[live], kind="stable")]


def _bound(symbols: np.ndarray, suffixes: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
    """In each interval, the first suffix whose symbol at depth isn't less than wanted."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        less = symbols[suffixes[mid] + depth] < wanted[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]


def search(index: TestIndex, symbols: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
    """Binary search of every test suffix in the suffix array of symbols, which end with a zero.

    Returns the windows that occur and where; and lengths, in words, with the places where a test suffix matches so far
    and no further, for matches of at least a window.
    """
    most = int(index.lengths.max()) - index.seed + 1
    suffixes = suffix_array(symbols, most)
    padded = np.concatenate([symbols, np.zeros(most + 1, np.int64)])
    n = len(index.starts)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(suffixes), np.int64)
    active = np.arange(n)
    windows, ended = [], set()
    need = np.where(index.window >= 0, index.window_words[index.window] - index.seed + 1, -1)
    tested = np.concatenate([index.symbols, np.zeros(most + 1, np.int64)])

    def end(length: int, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        told = (a < b) & (length >= index.widths[j])
        ended.update((length, x, y) for x, y in zip(a[told].tolist(), b[told].tolist(), strict=True))

    for depth in range(most):
        wanted, length = tested[index.starts[active] + depth], depth + index.seed - 1 if depth else 0
        over = active[wanted == 0]
        end(length, over, lo[over], hi[over])
        active, wanted = active[wanted > 0], wanted[wanted > 0]
        if not len(active):
            break
        low = _bound(padded, suffixes, lo[active], hi[active], depth, wanted)
        high = _bound(padded, suffixes, low, hi[active], depth, wanted + 1)
        end(length, active, lo[active], low)
        end(length, active, high, hi[active])
        found = low < high
        active = active[found]
        lo[active], hi[active] = low[found], high[found]
        windows += [(int(index.window[j]), suffixes[lo[j] : hi[j]]) for j in active[need[active] == depth + 1]]
    end(most + index.seed - 1, active, lo[active], hi[active])
    return windows, [(length, suffixes[a:b]) for length, a, b in ended]


@dataclass
class Found:
    """What one index finds in a batch of texts: longest match and spans of words by row, and items by row."""

    counts: np.ndarray
    longest: np.ndarray
    per_row: np.ndarray  # offsets of each row in starts and lengths
    starts: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def _find(index: TestIndex, texts: pa.Array) -> Found:
    words, counts = folded_words(texts)
    ids, dictionary = word_ids(words)
    known = pc.fill_null(pc.index_in(dictionary, value_set=index.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    rows, firsts, n = row_numbers(counts), np.cumsum(counts) - counts, len(texts)
    seeds = _seeds(known[ids] if len(known) else ids, rows, index.tables, len(index.vocabulary))
    places = np.flatnonzero(seeds)
    hit = np.zeros(len(ids) + 1, np.int64)
    longest = np.zeros(n, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    if len(places):
        gap = np.concatenate([[0], np.cumsum((np.diff(places) > 1) | (np.diff(rows[places]) > 0))])
        symbols, place = np.zeros(len(places) + gap[-1] + 1, np.int64), np.zeros(len(places) + gap[-1] + 1, np.int64)
        symbols[np.arange(len(places)) + gap], place[np.arange(len(places)) + gap] = seeds[places], places
        windows, matches = search(index, symbols)
        for w, at in windows:
            np.add.at(hit, place[at], 1)
            np.add.at(hit, place[at] + index.window_words[w], -1)
            pairs.append(np.stack([np.unique(rows[place[at]]), np.full(len(np.unique(rows[place[at]])), w)], axis=1))
        for length, at in matches:
            np.maximum.at(longest, rows[place[at]], length)
    flags = np.cumsum(hit[:-1]) > 0
    begins = flags & np.concatenate([[True], ~flags[:-1] | (rows[1:] != rows[:-1])]) if len(flags) else flags
    starts = np.flatnonzero(begins)
    stops = np.concatenate([starts[1:], [len(flags)]])
    before = np.concatenate([[0], np.cumsum(flags)])
    pair = np.concatenate(pairs)
    item_rows = np.repeat(pair[:, 0], (index.item_offsets[1:] - index.item_offsets[:-1])[pair[:, 1]])
    items = np.concatenate([np.zeros(0, np.int64), *(index.window_items[index.item_offsets[w] : index.item_offsets[w + 1]] for w in pair[:, 1])])
    names: list[list[str]] = [[] for _ in range(n)]
    for row, item in np.unique(np.stack([item_rows, items], axis=1), axis=0) if len(items) else []:
        names[row].append(index.items[item])
    return Found(counts, longest, np.searchsorted(rows[starts], np.arange(n + 1)), starts - firsts[rows[starts]], (before[stops] - before[starts]).astype(np.int64), [sorted(set(x)) for x in names])


FOUND = ["n_words bigint", "longest_match bigint", "hit_starts array<bigint>", "hit_lengths array<bigint>", "items array<string>"]
NAMES = [x.split()[0] for x in FOUND]
RESULTS = [*NAMES, "n_hit", "n_items", "contaminated"]


def _columns(found: Found) -> list[pa.Array]:
    offsets = pa.array(found.per_row.astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (found.starts, found.lengths)]
    return [pa.array(found.counts), pa.array(found.longest), *lists, pa.array(found.items, pa.list_(pa.string()))]


def _pass(inner: DataFrame, index, kept: list[str], hits_only: bool = False) -> DataFrame:
    """The columns of kept and FOUND for each row of inner, or for those alone in which something is found."""
    schema = ", ".join([*(f"{c} {inner.schema[c].dataType.simpleString()}" for c in kept), *FOUND])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "searched"):
            found = _find(index.value, plain_text(batch.column("searched")))
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *_columns(found)], [*kept, *NAMES])
            yield out.filter(pa.array(np.diff(found.per_row) > 0)) if hits_only else out

    return inner.mapInArrow(run, schema)


def _joined(passes: DataFrame) -> DataFrame:
    """rid and FOUND of the rows of several passes (parts, an array of FOUND): longest match, joined spans and items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, parts in zip(batch.column("rid").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                spans: list[list[int]] = []
                for start, length in sorted(x for p in parts for x in zip(p["hit_starts"], p["hit_lengths"], strict=True)):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], start + length)
                    else:
                        spans.append([start, start + length])
                rows.append((rid, parts[0]["n_words"], max(p["longest_match"] for p in parts), [a for a, _ in spans], [b - a for a, b in spans], sorted({x for p in parts for x in p["items"]})))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["rid", *NAMES])

    return passes.groupBy("rid").agg(F.collect_list(F.struct(*NAMES)).alias("parts")).mapInArrow(run, ", ".join(["rid bigint", *FOUND]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of docs with n_words, longest_match (words), hit_starts and hit_lengths (spans of words), items, n_hit, n_items and contaminated.

    longest_match is the length of the longest verbatim match of at least one window, 0 without any. items are the
    names of the items with a window here, sorted as strings. A null or empty text has no words, so nothing is found;
    an item without words or an empty benchmark finds nothing, and an item with a null id counts for hits but isn't
    listed. Texts of any length are searched whole. Repeated rows, of documents or items, each get their own result or
    count once. Columns that aren't named here pass through, but for those named like a result, which the result
    replaces.

    The bytes of the benchmark's different items are measured first: up to block_bytes are broadcast at a time. A larger
    benchmark takes more passes over the documents, which are numbered and written once; each pass writes what it finds
    before the next one's index is built, so that one index is held at a time.
    """
    spark = docs.sparkSession
    keep = kept_columns(docs, keep, RESULTS)
    kept = [f"k{i}" for i in range(len(keep))]
    tests = benchmark.select(F.col(f"`{item}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("string").alias("body")).where(F.col("body").isNotNull()).distinct()
    size = tests.agg(F.sum(F.octet_length("body") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    inner = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text}`").cast("string").alias("searched"))
    index_of = lambda block: test_index([(x["id"], x["body"]) for x in block.sort("id", "body").collect()], window) or no_index(window)
    if blocks == 1:
        out = _pass(inner, spark.sparkContext.broadcast(index_of(tests)), kept)
    else:
        rowset = materialise(inner.withColumn("rid", F.monotonically_increasing_id()), "searched")
        tests, parts = materialise(tests, "tests"), []
        for b in range(blocks):
            index = spark.sparkContext.broadcast(index_of(tests.where(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == b)))
            parts.append(materialise(_pass(rowset, index, ["rid"], True), "hits"))
            index.destroy()
        counted = _pass(rowset, spark.sparkContext.broadcast(no_index(window)), ["rid", *kept]).select("rid", *kept, "n_words")
        empty = [F.lit(0).cast("bigint"), *(F.array().cast(x.split()[1]) for x in FOUND[2:])]
        hits = _joined(reduce(DataFrame.unionByName, parts)).drop("n_words")
        out = counted.join(hits, "rid", "left").select(*kept, "n_words", *[F.coalesce(n, e).alias(n) for n, e in zip(NAMES[1:], empty, strict=True)])
    n_hit = F.aggregate("hit_lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], *NAMES, n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), (F.size("hit_lengths") > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with docs' own columns, whatever their names."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    found = find_leaks(docs.toDF(*names), benchmark, names[docs.columns.index(text)])
    return found.where(~F.col("contaminated")).select(*names).toDF(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read_spread(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest_match")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id),
-- The longest match of at least one window: runs of windows at one distance between document and item.
iw AS (SELECT item_id, j, least(len(ws), 10) AS n, array_to_string(ws[j:j + least(len(ws), 10) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS j FROM b WHERE len(ws) > 0)),
al AS (SELECT doc_id, item_id, i, n, i - j AS diag FROM dw JOIN iw USING (n, g)),
runs AS (SELECT doc_id, max(len) AS longest_match FROM (SELECT doc_id, count(*) + max(n) - 1 AS len FROM
        (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, n, diag ORDER BY i) AS run FROM al) GROUP BY doc_id, item_id, n, diag, run) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0)::BIGINT AS longest_match
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN runs USING (doc_id)
"""

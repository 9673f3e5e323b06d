"""Operator 4: near-duplicates by DartMinHash and a banded join.

A text's elements are its shingles of five words, weighted by how often they occur. Darts are thrown, by hashing, into
the plane of weight and rank above each element; a text owns the darts below its weights, and each of the signature's
coordinates keeps the earliest dart that falls on it. Two texts agree on a coordinate with the probability of their
weighted Jaccard similarity. Work is for the darts needed, not for coordinates times elements.

Copies of a text count once. Texts that share a band of coordinates meet in a bucket; each is held against the bucket's
first text, the one that meets most others. Texts of a bucket that are still in different components are compared block
by block, by sketches, and only pairs that these don't rule out leave their task. Each link is verified by the exact
similarity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import bounded, folded_words, kept_columns, materialise, mix, plain_text, read_spread, row_numbers, word_ids
from emberline.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 7
#: Width of the first layer of ranks, in darts for a weight of 1; each layer after the second is twice as wide.
FIRST_WIDTH = 2.0**-6
#: Texts of a bucket that are compared with others at one time.
BLOCK = 512
SLACK = 0.01
#: Units of weight of a bucket's texts that are compared with others at one time, 8 bytes each.
BLOCK_UNITS = 1 << 20
#: Tasks over which the rows of one key are dealt in a join, and pairs of one hub that a task gets.
SALTS, HUB_PAIRS = 16, 512
#: Dropped rows whose numbers are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text whose darts are thrown together.
DART_BYTES = 2 << 20


@cache
def _layer(number: int) -> tuple[float, np.ndarray]:
    """Width of a layer, and the distribution function of the number of darts that a weight of 1 gets in it."""
    width = FIRST_WIDTH * 2.0 ** max(0, number - 1)
    most = int(width + 12 * width**0.5 + 12)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])
    return width, np.cumsum(np.exp(np.arange(most + 1) * np.log(width) - width - logs))[:-1]


def elements(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each unit of weight of the texts' shingles, and two hashes of each text's words.

    The k-th occurrence of a shingle is a unit of its own. A text of fewer words, but not none, is one shingle.
    """
    words, counts = folded_words(texts)
    ids, dictionary = word_ids(words)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in dictionary.to_pylist()), np.uint64, len(dictionary))
    word = hashes[ids] if len(ids) else np.zeros(0, np.uint64)
    rows, firsts, n = row_numbers(counts), np.cumsum(counts) - counts, len(word)
    wide = np.minimum(counts, shingle)[rows]
    place = np.arange(n) - firsts[rows]
    starts = np.flatnonzero(place + wide <= counts[rows])
    shingles = np.zeros(len(starts), np.uint64)
    for k in range(shingle):
        on = k < wide[starts]
        shingles[on] = mix(shingles[on], k + 1) ^ mix(word[starts[on] + k], k + 1)
    owner = rows[starts]
    key = mix(shingles) + mix(owner.astype(np.uint64), 1)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    occurrence = np.empty(len(order), np.int64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0)) if len(order) else at
    units = mix(shingles) + mix(occurrence.astype(np.uint64), 2)
    whole = np.zeros((2, len(texts)), np.uint64)
    ordinal = place.astype(np.uint64)
    for k in range(2):
        np.add.at(whole[k], rows, mix(word ^ mix(ordinal, 3 + k), 5 + k))
    return owner, units, whole


def signatures(rows: np.ndarray, units: np.ndarray, n: int, size: int) -> np.ndarray:
    """n signatures of size coordinates each: the earliest dart on each. Rows without units get zeros."""
    none = np.uint64(2**64 - 1)
    kept = np.full(n * size, none)
    sought = np.zeros(n, bool)
    sought[rows] = True
    live = np.arange(len(units))
    number = 0
    while len(live):
        _, distribution = _layer(number)
        hashed = mix(units[live], 100 + number)
        darts = np.searchsorted(distribution, (hashed >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
        thrown = np.flatnonzero(darts)
        many = darts[thrown]
        each = np.repeat(thrown, many)
        serial = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        dart = mix(hashed[each] + mix(serial.astype(np.uint64), 7), 8)
        coordinate = ((dart >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        earliest = np.full(n * size, none)
        np.minimum.at(earliest, rows[live[each]] * size + coordinate.astype(np.int64), mix(dart, 9))
        kept = np.where(kept == none, earliest, kept)
        sought &= (kept.reshape(n, size) == none).any(axis=1)
        live = live[sought[rows[live]]]
        number += 1
    kept[kept == none] = 0
    return kept.reshape(n, size)


def _band_hashes(kept: np.ndarray, bands: int) -> np.ndarray:
    parts = kept.reshape(len(kept), bands, -1)
    out = mix(np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]), 11)
    for k in range(parts.shape[2]):
        out = mix(out ^ parts[:, :, k], 12)
    return out.view(np.int64)


def _featured(inner: DataFrame, kept: list[str], bands: int, rows: int, shingle: int) -> DataFrame:
    """inner and of each row its number rid, two hashes of its words, its weight and the hashes of its bands."""
    schema = ", ".join([*(f"{c} {inner.schema[c].dataType.simpleString()}" for c in [*kept, "body"]), "rid bigint, k1 bigint, k2 bigint, weight bigint, bands array<bigint>"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 36
        for batch in bounded(batches, "body", DART_BYTES):
            n = batch.num_rows
            owner, units, whole = elements(plain_text(batch.column("body")), shingle)
            weight = np.bincount(owner, minlength=n)
            rid = serial + np.arange(n)
            serial += n
            hashes = _band_hashes(signatures(owner, units, n, bands * rows), bands)
            there = weight > 0
            # A text without words is like no other: its own number stands for its words.
            keys = [np.where(there, whole[0].view(np.int64), rid), np.where(there, whole[1].view(np.int64), -1)]
            offsets = np.concatenate([[0], np.cumsum(there * bands)]).astype(np.int32)
            banded = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[there].ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*kept, "body"]), pa.array(rid), *map(pa.array, keys), pa.array(weight), banded], [*kept, "body", "rid", "k1", "k2", "weight", "bands"])

    return inner.mapInArrow(run, schema)


def _unit_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """rid and the sorted hashes of its text's units of weight, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            owner, units, _ = elements(plain_text(batch.column("body")), shingle)
            order = np.lexsort((units, owner))
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows)) * 8
            data = units[order].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], ["rid", "units"])

    return texts.select("rid", "body").mapInArrow(run, "rid bigint, units binary")


def _similarities(pairs: DataFrame) -> DataFrame:
    """u, v and the exact weighted Jaccard similarity of the units a and b."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(bounded(batches, "a", 4 * DART_BYTES), "b", 4 * DART_BYTES):
            out = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                out.append(shared / (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(out, pa.float64())], ["u", "v", "sim"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint, sim double")


def _verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """pairs u, v with their similarity. n: how many pairs v has, about; a hub's are dealt over tasks, its units repeated."""
    parts = F.ceil(F.col("n") / HUB_PAIRS)
    left = units.select(F.col("rid").alias("u"), F.col("units").alias("a"))
    hubs = pairs.groupBy("v").agg(F.max(parts).alias("parts"))
    right = units.select(F.col("rid").alias("v"), F.col("units").alias("b")).join(hubs, "v").select("v", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return _similarities(pairs.withColumn("part", F.pmod(F.xxhash64("u"), parts)).join(left, "u").join(right, ["v", "part"]))


def _dealt(rows: DataFrame, own: DataFrame, keys: list[str], by: str, how: str = "left") -> DataFrame:
    """rows joined with own, which has a row a key at most: a key's rows are dealt over SALTS tasks, own's repeated in each."""
    salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def _buckets(banded: DataFrame) -> DataFrame:
    """rid, bucket and weight of banded where a bucket has n > 1 texts, of a weight of heft, and first, the text that meets most others."""
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("heft")).where("n > 1")
    members = materialise(_dealt(banded, sizes, ["bucket"], "rid", "inner"), "met")
    meets = members.groupBy("rid").agg(F.sum("n").alias("meets"))
    members = members.join(meets, "rid")
    firsts = members.groupBy("bucket").agg(F.max(F.struct("meets", -F.col("rid"))).alias("most")).select("bucket", (-F.col("most.col2")).alias("first"))
    return _dealt(members, firsts, ["bucket"], "rid", "inner").select("bucket", "rid", "n", "heft", "first")


def _sketches(units: DataFrame, bands: int, rows: int) -> DataFrame:
    """Of texts given by their units: rid, weight, the lowest byte of each coordinate, the hashes of the bands, and the
    units' lowest 32 bits, sorted.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "units", 8 * DART_BYTES):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("units")]
            weight = np.array([len(x) for x in sets])
            kept = signatures(row_numbers(weight), np.concatenate(sets), len(sets), bands * rows)
            low, hashes = kept.astype(np.uint8), _band_hashes(kept, bands)
            short = [np.unique(x.astype(np.uint32)) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(weight), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (low, hashes, short))], ["rid", "weight", "low", "hashes", "short"])

    return units.select("rid", "units").mapInArrow(run, "rid bigint, weight bigint, low binary, hashes binary, short binary")


def _close_pairs(open_: DataFrame, sketches: DataFrame, similarity: float, size: int) -> DataFrame:
    """Pairs u, v of one bucket in different components whose sketches don't rule a link out.

    A bucket is dealt out to blocks of about BLOCK texts, or BLOCK_UNITS of weight, and each two blocks are compared by one task, which returns
    only what passes: sizes that allow the similarity, at most six standard deviations fewer equal coordinates than it
    gives, and a similarity of the units' lowest bits that is as high but for SLACK, more than equal bits of different
    units add up to. Texts that share more buckets are compared in the first one.
    """
    least = size * similarity - 6 * (size * similarity * (1 - similarity)) ** 0.5
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("heft") / F.lit(BLOCK_UNITS))).cast("long")
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("rid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("bucket", "rid", "component", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")).join(sketches, "rid")

    def compare(table: pa.Table) -> pa.Table:
        col = {c: table[c].to_numpy() for c in ("bucket", "rid", "component", "block", "b1", "b2", "weight")}
        low = np.stack([np.frombuffer(x, np.uint8) for x in table["low"].to_pylist()])
        hashes = np.stack([np.frombuffer(x, np.int64) for x in table["hashes"].to_pylist()])
        short = [np.frombuffer(x, np.uint32) for x in table["short"].to_pylist()]
        one, two = (np.flatnonzero(col["block"] == col[b][0]) for b in ("b1", "b2"))
        out = [np.zeros((0, 2), np.int64)]
        for start in range(0, len(one), 32):
            x = one[start : start + 32]
            fits = (col["component"][x][:, None] != col["component"][two]) & (np.minimum(col["weight"][x][:, None], col["weight"][two]) >= similarity * np.maximum(col["weight"][x][:, None], col["weight"][two]))
            fits &= (low[x][:, None, :] == low[two][None, :, :]).sum(axis=2) >= least
            i, j = np.nonzero(fits)
            i, j = x[i], two[j]
            shared = hashes[i] == hashes[j]
            here = hashes[i, shared.argmax(axis=1)] == col["bucket"][0]
            i, j = i[here], j[here]
            shared = np.array([len(np.intersect1d(short[a], short[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
            near = shared >= (similarity - SLACK) * (col["weight"][i] + col["weight"][j] - shared)
            out.append(np.sort(np.stack([col["rid"][i], col["rid"][j]], axis=1)[near], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({"u": pa.array(found[:, 0]), "v": pa.array(found[:, 1])})

    return dealt.groupBy("bucket", "b1", "b2").applyInArrow(compare, "u bigint, v bigint").distinct()


def _classified(docs: DataFrame, text: str, keep: list[str], similarity: float, shingle: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the columns of keep as c0, c1 ..., rid, k1 and k2; and k1, k2 and class of each different text with copies or links."""
    kept = [f"c{i}" for i in range(len(keep))]
    inner = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text}`").cast("string").alias("body"))
    rowset = materialise(_featured(inner, kept, bands, rows, shingle), "rows")
    nodes = materialise(rowset.groupBy("k1", "k2").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "texts")
    members = materialise(_buckets(nodes.select("rid", "weight", F.explode("bands").alias("bucket"))), "members")
    pairs = members.where("rid <> first").groupBy(F.col("rid").alias("u"), F.col("first").alias("v")).agg(F.max("n").alias("n"))
    # Texts are dealt out by number at any size: whether what met could be broadcast depends on the copies.
    met = members.select("rid").distinct().hint("merge")
    units = materialise(_unit_sets(rowset.select("rid", "body").join(met, "rid", "left_semi"), shingle), "units")
    links = _verified(pairs, units).where(F.col("sim") >= similarity).select("u", "v")
    component = materialise(connected_components(links), "components")
    # What is left: texts of one bucket in different components.
    labelled = members.join(component.withColumnRenamed("node", "rid"), "rid", "left").select("bucket", "rid", "n", "heft", F.coalesce("component", "rid").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    open_ = materialise(_dealt(labelled, mixed, ["bucket"], "rid", "inner"), "open")
    more = _close_pairs(open_, _sketches(units.join(open_.select("rid").distinct(), "rid", "left_semi"), bands, rows), similarity, bands * rows)
    late = materialise(_verified(more.join(more.groupBy("v").agg(F.count("*").alias("n")), "v"), units).where(F.col("sim") >= similarity).select("u", "v"), "late")
    if late.limit(1).count():
        component = materialise(connected_components(component.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(late)), "components")
    # Texts that have neither copies nor links are classes by themselves and need no look.
    named = nodes.select("k1", "k2", "rid", "copies").join(component.withColumnRenamed("node", "rid"), "rid", "left")
    classes = named.where("copies > 1 OR component IS NOT NULL").select("k1", "k2", F.coalesce("component", "rid").alias("class"))
    return rowset, classes


def _with_class(rowset: DataFrame, classes: DataFrame) -> DataFrame:
    return _dealt(rowset, classes, ["k1", "k2"], "rid").withColumn("class", F.coalesce("class", "rid"))


def near_classes(docs: DataFrame, text: str = "text", keep: list[str] | None = None, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Each row of docs with rid, its number in this run, and class, the smallest rid of its class.

    A class holds texts that a chain of links of at least similarity joins, and all copies. Texts are the same if their
    words are (ASCII letters lower-cased, digits and characters beyond ASCII). Null texts, and those without words, are
    classes of one row. Repeated rows are copies. Texts of any length are shingled whole, alone in their batch if they are
    long. An empty table gives an empty one. Columns other than text pass through unread, but for those named like a
    result, which the result replaces.
    """
    keep = kept_columns(docs, keep, ["rid", "class"])
    rowset, classes = _classified(docs, text, keep, similarity, shingle, bands, rows)
    return _with_class(rowset, classes).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "rid", "class")


def one_of_each(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The first row of each class, with docs' own columns, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rowset, classes = _classified(docs.toDF(*names), names[docs.columns.index(text)], names, similarity, shingle, bands, rows)
    dropped = materialise(_with_class(rowset.select("rid", "k1", "k2"), classes).where(F.col("rid") != F.col("class")).select("rid"), "dropped")
    # The number of rows to drop is known here: up to BROADCAST_ROWS take some 50 MB, and more are joined by a shuffle.
    gone = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return rowset.join(gone, "rid", "left_anti").select(*names).toDF(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), class_size and kept (one row of each class, the first as this run numbers them)."""
    rows = near_classes(read_spread(spark, sf_dir, "documents"), keep=["doc_id"])
    rows = materialise(rows, "classes")
    named = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    size = F.coalesce("class_size", F.lit(1).cast("long"))
    return _dealt(rows, named, ["class"], "rid").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), size.alias("class_size"), (F.col("rid") == F.col("class")).alias("kept"))

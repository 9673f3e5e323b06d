"""Operator 5: URL filters, by rules and a cascade of Bloom filters.

The first filter encodes the listed keys, the second the corpus's other keys that the first lets through, the third the
listed keys that the second lets through, and so on until nothing is let through. Every key of the corpus took part, so
for each of them the first filter that hasn't got it tells exactly whether it is listed. Nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import kept_columns, materialise, mix, read_table

#: Bits of a filter at most, 32 MB; more keys are dealt out to several cascades that are asked one after the other.
FILTER_BITS = 1 << 28
#: 64-bit words of a filter that are a row when the filter is put together.
CHUNK = 8192
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
THIN_CHARS = 1000


@dataclass
class Bloom:
    bits: np.ndarray
    hashes: int
    level: int

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return places(h1, h2, len(self.bits) * 64, self.hashes, self.level)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def places(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int, level: int) -> np.ndarray:
    """The bits of each key, a row for each hash; other ones in each level, or keys that met once would meet again."""
    a, b = mix(h1.astype(np.int64).view(np.uint64), level), mix(h2.astype(np.int64).view(np.uint64), level) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(hashes)])


def listed_by(cascade: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the number of filters that have it, up to the first that hasn't, is odd."""
    depth, inside = np.zeros(len(h1), np.int64), np.ones(len(h1), bool)
    for level in cascade:
        inside[inside] = level.has(h1[inside], h2[inside])
        depth += inside
    return depth % 2 == 1


def _bloom(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """A filter of n keys (h1, h2): each task ors its bits, the cluster theirs, and packed chunks reach the driver."""
    bits = max(64, -(-int(-n * np.log(rate) / np.log(2) ** 2) // 64) * 64)
    hashes = max(1, round(bits / n * np.log(2)))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), bits, hashes, level))
            if not len(at):
                continue
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(held.view(np.int64))], ["word", "held"])

    def packed(chunk: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK, np.int64)
        out[chunk["word"].to_numpy() % CHUNK] = chunk["held"].to_numpy()
        return pa.table({"chunk": pa.array([chunk["word"][0].as_py() // CHUNK]), "packed": pa.array([out.tobytes()], pa.binary())})

    words = keys.select("h1", "h2").mapInArrow(mark, "word bigint, held bigint").groupBy("word").agg(F.bit_or("held").alias("held"))
    out = np.zeros(-(-bits // 64 // CHUNK) * CHUNK, np.uint64)
    for row in words.groupBy((F.col("word") / CHUNK).cast("long").alias("c")).applyInArrow(packed, "chunk bigint, packed binary").collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["packed"], np.uint64)
    return Bloom(out[: bits // 64], hashes, level)


def _let_through(keys: DataFrame, level: Bloom) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column("h1").to_numpy(), batch.column("h2").to_numpy())))

    return materialise(keys.select("h1", "h2").mapInArrow(run, "h1 bigint, h2 bigint"), "let_through")


def cascade(keys: DataFrame) -> list[Bloom]:
    """The filters for keys: h1, h2 (two hashes) and listed, each key once. No listed key needs no filter."""
    encoded, other = keys.where("listed").select("h1", "h2"), keys.where("not listed").select("h1", "h2")
    n, m = encoded.count(), other.count()
    levels: list[Bloom] = []
    while n:
        # The first filter lets through about as many others as there are listed keys; each later one a sixteenth: a few
        # more bits than at a half, and a quarter of the levels, which follow each other.
        rate = 1 / 16 if levels else min(0.5, max(1e-4, n / max(1, m) / 2**0.5))
        levels.append(_bloom(encoded, n, rate, len(levels)))
        encoded, other = _let_through(other, levels[-1]), encoded
        n = encoded.count()
    return levels


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def mark_listed(rows: DataFrame, keys: DataFrame, key: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """rows with listed: whether keys, which has every key of rows once, lists the row's key. A null key isn't listed.

    keys: key and listed. A cascade has about 25 bits for a listed key at most, so their number bounds what is
    broadcast: beyond filter_bits the keys are dealt out by hash, and the rows pass the cascades one after the other,
    each written before the next cascade is built, so that one is held at a time.
    """
    keys = materialise(keys.where(F.col(key).isNotNull()).select(*hashed(F.col(key)), F.col("listed")), "keys")
    shards = max(1, -(-25 * keys.where("listed").count() // filter_bits))
    out = rows.withColumns(dict(zip(["h1", "h2"], hashed(F.col(key)), strict=True))).withColumn("listed", F.lit(False))
    for shard in range(shards):
        levels = cascade(keys.where(F.pmod("h1", F.lit(shards)) == shard) if shards > 1 else keys)
        shared, schema = rows.sparkSession.sparkContext.broadcast(levels), out.schema

        def run(batches: Iterable[pa.RecordBatch], shared=shared, shard=shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
                known = batch.column(key).is_valid().to_numpy(zero_copy_only=False) & (h1 % shards == shard)
                found = batch.column("listed").to_numpy(zero_copy_only=False) | listed_by(shared.value, h1, h2) & known
                yield batch.set_column(batch.schema.get_field_index("listed"), "listed", pa.array(found))

        out = out.mapInArrow(run, schema)
        if shards > 1:
            out = materialise(out, "asked")
            shared.destroy()
    return out.drop("h1", "h2")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null one or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _fits(rule: str, host: Column, path: Column) -> Column:
    own, _, rest = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """Each row of pages with host, path, rule, listed and verdict.

    listed: key (host and path together) and listed, with every key of pages once. The longest rule that fits decides
    (of equally long ones, one that blocks); without one, listed keys are blocked and others allowed. A null url, or one
    without ://, has an empty host and path, fits no rule, isn't listed and is allowed. Repeated rows each get their
    result; an empty table gives an empty one. Urls may have any length. Other columns pass through, but for those named
    like a result, which the result replaces; columns other than url and those in keep aren't read.
    """
    keep = kept_columns(pages, keep, ["host", "path", "rule", "listed", "verdict"])
    kept = [f"c{i}" for i in range(len(keep))]
    host, path = host_and_path(F.col("address"))
    inner = pages.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{url}`").cast("string").alias("address"))
    inner = inner.withColumn("host", host).withColumn("path", path).drop("address")
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    first = lambda value: F.coalesce(*[F.when(_fits(r[1], F.col("host"), F.col("path")), F.lit(value(r))) for r in order], F.lit(None).cast("string"))
    inner = inner.withColumn("rule", first(lambda r: r[1])).withColumn("ruled", first(lambda r: r[0])).withColumn("key", F.nullif(F.concat("host", "path"), F.lit("")))
    out = mark_listed(inner, listed, "key")
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "host", "path", "rule", "listed", verdict.alias("verdict"))


def thin_keys(pages: DataFrame) -> DataFrame:
    """Every key of pages, listed if none of its pages has THIN_CHARS characters of html."""
    host, path = host_and_path(F.col("url"))
    keyed = pages.select(F.nullif(F.concat(host, path), F.lit("")).alias("key"), F.coalesce(F.length("html"), F.lit(0)).alias("size"))
    return keyed.where(F.col("key").isNotNull()).groupBy("key").agg((F.max("size") < THIN_CHARS).alias("listed"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return filter_urls(pages, thin_keys(pages), keep=["page_id"])


SQL = r"""
WITH r AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, length(coalesce(html, '')) AS size, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS ruled
      FROM p, rules WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
      AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id),
k AS (SELECT host || path AS key, max(size) < 1000 AS listed FROM p WHERE host || path <> '' GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(listed, FALSE) AS listed,
       coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (page_id) LEFT JOIN k ON k.key = host || path
"""

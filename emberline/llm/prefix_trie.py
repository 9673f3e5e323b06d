"""Prefix trie of conversations: shared beginnings, their subtrees' leaves and the tokens that sharing saves.

A node is a distinct sequence of first turns, named by two 64-bit sums over (place, role, text) of its turns. Totals of
subtrees are rolled up by bands of HEIGHT depths: a node explodes to its ancestors inside its band only; the bands' roots
form a tree of their own, HEIGHT times as flat, whose totals are found the same way; then each root's completed total is
handed to its ancestors in the band above. So a node gives at most HEIGHT rows a level, and depth d takes log(d) levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import materialise, read_table

#: Depths of a band.
HEIGHT = 16
#: Conversation ids of one text in the list of those that end at a node.
ENDS = 4096
KEY = ["depth", "a", "b"]
WORD = r"[^\x20\x09-\x0D]+"


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and depth from 0: the prefix's name (a, b), the words of its last turn, and whether it's whole."""
    order = Window.partitionBy("conv_id").orderBy("depth")
    named = turns.select(
        "conv_id",
        "depth",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
        *[F.xxhash64(F.lit(seed), "depth", F.octet_length("role"), "role", "text").alias(n) for seed, n in ((11, "a"), (12, "b"))],
    )
    zero = F.lit(0).cast("long")
    rows = named.unionByName(convs.select("conv_id", *[zero.alias(c) for c in ("depth", "words", "a", "b")]))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "conv_id",
        "depth",
        "words",
        *[F.bit_xor(c).over(running).alias(c) for c in ("a", "b")],
        F.lead("depth").over(order).isNull().alias("whole"),
    )


def _above(paths: DataFrame, nodes: DataFrame, own: bool) -> DataFrame:
    """Each node of nodes with up, an ancestor in its band (itself too); without own, those of the band above a band's root.

    nodes holds conv_id, a member, beside the key; its ancestors are among that conversation's rows of paths.
    """
    order = Window.partitionBy("conv_id").orderBy("depth")
    frame = order.rowsBetween(-(HEIGHT - 1), 0) if own else order.rowsBetween(-HEIGHT, -1)
    lists = paths.select("conv_id", "depth", F.collect_list(F.struct(*KEY)).over(frame).alias("up"))
    found = nodes.join(lists, ["conv_id", "depth"])
    if own:
        found = found.withColumn("up", F.expr(f"filter(up, x -> x.depth >= depth - depth % {HEIGHT})"))
    return found.withColumn("up", F.explode("up"))


def _summed(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.groupBy(*[F.col(f"up.{k}").alias(k) for k in KEY]).agg(*[F.sum(v).alias(v) for v in values])


def roll_up(paths: DataFrame, nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """The key of each node with the sums of values over its subtree, itself included.

    paths: rows conv_id, depth, a, b of whole conversations, with every depth from 0. nodes: the key, conv_id (a member)
    and values. deepest: the largest depth. Sums of a node with many descendants are combined before they are shuffled.
    """
    inside = _summed(_above(paths, nodes, own=True), values)
    if deepest < HEIGHT:
        return inside
    inside = materialise(inside, "bands")
    on_roots = F.col("depth") % HEIGHT == 0
    shallow = F.expr(f"depth div {HEIGHT}").alias("depth")
    roots = inside.where(on_roots).join(nodes.select(*KEY, "conv_id"), KEY).select(shallow, "a", "b", "conv_id", *values)
    totals = roll_up(paths.where(on_roots).select("conv_id", shallow, "a", "b"), roots, values, deepest // HEIGHT)
    below = totals.where("depth > 0").join(roots.select(*KEY, "conv_id"), KEY).withColumn("depth", F.col("depth") * HEIGHT)
    handed = _summed(_above(paths, below.select("conv_id", *KEY, *values), own=False), values)
    handed = handed.select(*KEY, *[F.col(v).alias(f"more_{v}") for v in values])
    return inside.join(handed, KEY, "left").select(*KEY, *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])


def _digests(rows: DataFrame) -> DataFrame:
    """The key and the SHA-256 of the comma-joined ids of each node's conversations; read in order, never held whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key != now:
                    if state:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(done)
        if state:
            yield _batch([(*now, state.hexdigest())])

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [*KEY, "ends_sha256"])

    parts = rows.groupBy(*KEY, F.floor(F.col("conv_id") / ENDS).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns, and one for the root.

    turns: conv_id, depth (1, 2 ... in each conversation), role, text, none null. convs: the ids of all conversations, those
    without turns too. Result: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Without conversations there is no node. Texts may have any length; columns of
    other names don't take part. A conversation's rows meet in one task, which sorts them by a spilling sort.
    """
    rows = materialise(_prefixes(turns, convs), "prefixes")
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    order = Window.partitionBy("conv_id").orderBy("depth")
    before = rows.select("conv_id", "depth", "words", *[F.lag(c).over(order).alias(f"p{c}") for c in ("a", "b")])
    nodes = materialise(nodes.join(before, ["conv_id", "depth"]), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    own = nodes.select(*KEY, "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = roll_up(rows.select("conv_id", *KEY), own, ["n_leaves", "saved_tokens"], deepest)
    ends = _digests(rows.where("whole").select(*KEY, "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(totals, KEY, "left")
        .join(ends, KEY, "left")
        .join(parents, ["depth", "pa", "pb"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    )


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, i (1, 2 ... by turn, null first, ties by role and text), role, text; nulls are empty texts, rows without an id are left out."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("i"), "role", "text")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations: c begins with the first crc32(c) % 4 turns of c - c % 20."""
    rows = materialise(numbered(read_table(spark, sf_dir, "conversations")), "turns")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"))
    convs = materialise(convs.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0).cast("long"))).alias("taken")), "conversations")
    begun = convs.join(rows.where("i <= 3").select(F.col("conv_id").alias("base"), "i", "role", "text"), "base").where("i <= h").select("conv_id", F.col("i").alias("depth"), "role", "text")
    rest = rows.join(convs, "conv_id").where("i > h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    return prefix_trie(begun.unionByName(rest), convs.select("conv_id"))


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                 lambda acc, o: list_reduce(list_prepend(xor(acc, o), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
nb AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT c.conv_id, i - h + least(h, coalesce(n, 0)) AS pos, role, text FROM t JOIN c USING (conv_id) LEFT JOIN nb USING (base) WHERE i > h
      UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.base WHERE i <= h),
l AS (SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS ts FROM c LEFT JOIN p USING (conv_id) GROUP BY 1),
m AS (SELECT conv_id, d, ts[1:d] AS k, len(ts) = d AS whole FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM l)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole), '') AS ends FROM m GROUP BY k, d),
ch AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
             CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(regexp_split_to_array(n.k[n.d].t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS saved
      FROM n LEFT JOIN ch ON n.k = ch.k AND n.d = ch.d),
s AS (SELECT k[1:e] AS k, e AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s ON v.k = s.k AND v.d = s.d LEFT JOIN n q ON q.d = v.d - 1 AND q.k = v.k[1:v.d - 1]
"""

"""Registered queries on runs: paged sources, new ids by a stream, periods committed one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans import views
from emberline.plans.queries import query
from emberline.plans.records import _folder
from emberline.sources import commits, pages
from emberline.sources.shared import read_table
from emberline.streaming.seen import run_new_ids

#: Items of a page of orders.
PAGE = 700


@query("", "SELECT o_orderkey AS id, o_orderstatus AS status, round_even(o_totalprice, 2) AS total FROM orders")
def paged_orders(spark: SparkSession, d: str) -> DataFrame:
    """A layer's pages, landed as files, read in parallel up to the first that isn't full; a leftover of a longer run comes after it."""
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("total"))
    orders = read_table(spark, d, "orders").select((F.col("o_orderkey") - F.col("o_orderkey") % PAGE).alias("offset"), item.alias("item"))
    after = orders.agg(F.max("offset")).first()[0] + PAGE
    landed = orders.unionByName(orders.where("item.id < 50").withColumn("offset", F.lit(after).cast("long")))
    path = _folder(spark)
    # A page is a file, so its rows meet in one task; pages have PAGE rows.
    landed.groupBy("offset").agg(F.to_json(F.struct(F.sort_array(F.collect_list("item")).alias("features"))).alias("value")).write.partitionBy("offset").text(path)
    return pages.read_pages(spark, path, "id bigint, status string, total double", PAGE).select("id", "status", F.bround("total", 2).alias("total"))


@query("pl", "SELECT plume_id, provider FROM pl WHERE day >= '2024-01-25'")
def stream_new_ids(spark: SparkSession, d: str) -> DataFrame:
    """T-B, T-C as a stream (an extension): two runs land, and the second's new ids come once; the first is silent."""
    base = _folder(spark)
    p = views.plumes(spark, d).select("plume_id", "provider", "day")
    p.where("day < '2024-01-25'").write.parquet(f"{base}/landed/run=1")
    args = (f"{base}/landed", f"{base}/seen", "plume_id bigint, provider string, day string")
    run_new_ids(spark, *args, "1", buckets=64)
    p.write.parquet(f"{base}/landed/run=2")
    return run_new_ids(spark, *args, "2", buckets=64).select("plume_id", "provider")


@query("", "SELECT strftime(l_shipdate, '%Y') AS period, l_linenumber AS line, count(*) AS n, round_even(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def committed_periods(spark: SparkSession, d: str) -> DataFrame:
    """T-A, K06: years written and committed one by one; a first run ends after three of them and an attempt that isn't committed, a second goes on."""
    t, path = read_table(spark, d, "lineitem").withColumn("period", F.date_format("l_shipdate", "yyyy")), _folder(spark)
    years = [r[0] for r in t.select("period").distinct().sort("period").collect()]
    make = lambda p: t.where(F.col("period") == p).groupBy(F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    commits.run_periods(spark, path, years[:3], make)
    commits.write_attempt(make(years[3]).limit(1), path, years[3])
    commits.run_periods(spark, path, years, make)
    kind = make(years[0]).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    return commits.read_periods(spark, path, schema).select("period", "line", "n", F.bround("quantity", 2).alias("quantity"))

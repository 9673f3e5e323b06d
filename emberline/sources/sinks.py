"""Sinks: GeoJSON lines, layers and state tables."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pruned(extras: Column) -> Column:
    """A map without blank and null values."""
    return F.map_filter(extras, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def as_features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """A GeoJSON feature a row, as text: null and blank properties are left out, lists are joined by "; "."""
    props = []
    for f in df.schema:
        if f.name in (lon, lat):
            continue
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind.startswith("array"):
            c = F.nullif(F.array_join(c, "; "), F.lit(""))
        elif kind == "string":
            c = F.when(F.trim(c) != "", c)
        props.append(c.alias(f.name))
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), point.alias("geometry"))).alias("value"))


def write_features(df: DataFrame, path: str) -> None:
    """GeoJSON lines, written in parts: a collection of any size."""
    as_features(df).write.mode("overwrite").text(path)


def write_layers(df: DataFrame, path: str) -> DataFrame:
    """df by layer as Parquet, and the number of features of each."""
    df.write.mode("overwrite").partitionBy("layer").parquet(path)
    return df.groupBy("layer").agg(F.count("*").alias("n"))


def write_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_composites(cells: DataFrame, path: str) -> DataFrame:
    """Composites (kind, period, row, col, mean, anomaly, n_obs) by kind and period, of which only those given are replaced; returns the index."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "period").parquet(path)
    return cells.groupBy("kind", "period").agg(F.count("*").alias("cells"), F.count("anomaly").alias("graded"))


def load_stack(spark, path: str, kind: str) -> DataFrame:
    """The composites of a kind."""
    types = "mean double, anomaly double, n_obs bigint, row bigint, col bigint, kind string, period string"
    return spark.read.schema(types).parquet(path).where(F.col("kind") == kind)


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines without null fields, in the order given."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def keyed_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """key and items, the other columns of its rows as an array in order: a document by key, of keys that a row can hold."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("items"))


def write_archives(members: DataFrame, path: str, kind: str) -> DataFrame:
    """Writes members (file, member, text) as tar or zip archives below a folder that Arrow can open; file and the bytes of each.

    An archive is a task's, so its members should be few enough for one. A task that runs again writes the same archive.
    """

    def pack(table: pa.Table) -> pa.Table:
        out, name = io.BytesIO(), table["file"][0].as_py()
        order = sorted(zip(table["member"].to_pylist(), table["text"].to_pylist(), strict=True))
        if kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for member, text in order:
                    z.writestr(zipfile.ZipInfo(member), text)
        else:
            with tarfile.open(fileobj=out, mode="w") as t:
                for member, text in order:
                    info = tarfile.TarInfo(member)
                    info.size = len(data := text.encode())
                    t.addfile(info, io.BytesIO(data))
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as stream:
            stream.write(out.getvalue())
        return pa.table({"file": [name], "bytes": pa.array([len(out.getvalue())], pa.int64())})

    return members.select("file", "member", "text").groupBy("file").applyInArrow(pack, "file string, bytes bigint")

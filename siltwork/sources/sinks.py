"""Writing data sets: JSON lines, shards, exports, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions.taxonomy import or_chain
from siltwork.operators.ranking import ranked_within
from siltwork.session import materialised


def output_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """``text``, ``label`` and, where present, ``confidence``, ``source``, ``metadata``."""
    labels: list[Column] = [F.col(c) for c in ("domain_true", "domain_id", "label") if c in df.columns]
    extra = [F.col(c) for c in ("confidence", "source", "metadata") if c in df.columns]
    return df.select(F.col(text).alias("text"), F.coalesce(or_chain(*labels), F.lit("unknown")).alias("label"), *extra)


def write_jsonl(df: DataFrame, path: str, *, mode: str = "overwrite", rows_per_file: int | None = None) -> None:
    """JSON lines; null fields are left out; with ``rows_per_file`` in files of at most so many rows."""
    writer = df.write.mode(mode)
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.json(path)


def with_shard(df: DataFrame, rows: int, order: str) -> DataFrame:
    """``shard`` (from 1): consecutive shards of exactly ``rows`` rows by ``order``, but for the last."""
    ranked = ranked_within(df, F.lit("all"), [F.col(order)], "__sw_rank")
    return ranked.withColumn("shard", (F.floor((F.col("__sw_rank") - 1) / rows) + 1).cast("int")).drop("__sw_rank")


def write_sharded(df: DataFrame, path: str, *, rows: int, order: str, whole: str | None = None) -> None:
    """One folder a shard under ``path``; with ``whole`` the same rows in one data set there, too."""
    sharded = materialised(with_shard(df, rows, order)) if whole is not None else with_shard(df, rows, order)
    sharded.write.mode("overwrite").partitionBy("shard").json(path)
    if whole is not None:
        write_jsonl(sharded.drop("shard"), whole)


def _folder(spark: SparkSession, path: str):  # noqa: ANN202 - objects of the JVM
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on any file system that Hadoop knows."""
    fs, target = _folder(spark, path)
    return fs.exists(target)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder; 0 where there is none."""
    fs, target = _folder(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def list_chunks(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that fit a glob pattern."""
    fs, target = _folder(spark, pattern)
    return sorted(f.getPath().toString() for f in fs.globStatus(target) or [])


def write_or_delete(df: DataFrame, path: str) -> bool:
    """JSON lines if there are rows; else what is there is deleted. Whether there were rows."""
    if not df.isEmpty():
        write_jsonl(df, path)
        return True
    fs, target = _folder(df.sparkSession, path)
    fs.delete(target, True)
    return False


def write_metadata(stats: DataFrame, counts: DataFrame, path: str) -> None:
    """One JSON object: the statistics (one row) and ``distributions``, numbers of rows by value of
    each field. Values of a distribution are labels, few whatever the data."""
    by_field = counts.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("value", F.lit("")), "n"))).alias("d"))
    maps = by_field.agg(F.map_from_entries(F.collect_list(F.struct("field", "d"))).alias("distributions"))
    stats.crossJoin(F.broadcast(maps)).coalesce(1).write.mode("overwrite").json(path)  # two tables of one row


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """csv, json, jsonl or parquet; nested columns of a csv become JSON; else a ValueError."""
    if fmt == "csv":
        flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields]
        df.select(*flat).write.mode("overwrite").csv(path, header=True)
    elif fmt in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no export to {fmt}")


def labelled_columns(df: DataFrame, first: tuple[str, ...] = ("text", "domain_id", "confidence", "top_candidates")) -> DataFrame:
    """Preferred columns first, the rest in order."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])

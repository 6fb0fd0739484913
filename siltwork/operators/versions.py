"""Data set versions: semantic tags, comparison, content hashes, and a store of versions."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.sources.sinks import exists, folder_bytes


def parse_version(tag: Column) -> Column:
    """(major, minor, patch) of ``v1.2.3``; missing parts are 0, an unreadable tag is (0, 0, 0)."""
    plain = F.ltrim(tag, F.lit("v"))
    good = plain.rlike(r"^\d{1,9}(\.\d{1,9}){0,2}$")
    part = lambda i: F.coalesce(F.when(good, F.get(F.split(plain, r"\."), F.lit(i))).cast("int"), F.lit(0))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def next_version(tag: Column, step: str = "minor") -> Column:
    """The tag after: major, minor (also for an unknown step) or patch; null gives ``v1.0.0``."""
    v = parse_version(tag)
    major, minor, patch = v["major"], v["minor"], v["patch"]
    text = lambda *p: F.concat(F.lit("v"), F.concat_ws(".", *[x.cast("string") for x in p]))
    new = text(major + 1, F.lit(0), F.lit(0)) if step == "major" else text(major, minor, patch + 1) if step == "patch" else text(major, minor + 1, F.lit(0))
    return F.when(tag.isNull(), "v1.0.0").otherwise(new)


def map_difference(left: DataFrame, right: DataFrame, *, key: str, entries: str) -> DataFrame:
    """``key``, ``name``, ``old``, ``new``: entries of two maps of the same key that differ."""
    flat = lambda df, c: df.select(F.col(key).alias("key"), F.explode(entries).alias("name", c))
    both = flat(left, "old").join(flat(right, "new"), ["key", "name"], "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("key").alias(key), "name", "old", "new")


def content_hash(df: DataFrame) -> str:
    """A digest of the rows whatever their order: sums of row hashes, so nothing is sorted."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
    digest = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = df.select(digest.alias("d"), F.xxhash64(row).cast("decimal(38,0)").alias("x")).agg(F.count("*"), F.sum("d"), F.sum("x")).first()
    return "-".join(str(x or 0) for x in r)


class VersionStore:
    """Versions of data sets as Parquet folders with a registry of JSON lines."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _registry(self) -> str:
        return f"{self.root}/registry"

    def versions(self) -> DataFrame:
        """Registry rows, newest tag first: the latest entry of a tag stands."""
        schema = "tag string, description string, parent string, created_at string, hash string, rows long, metadata map<string,string>, status string, tags array<string>, changed_at string"
        if not exists(self.spark, self._registry()):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).json(self._registry())
        last = rows.groupBy("tag").agg(F.max_by(F.struct(*rows.columns), F.coalesce("changed_at", "created_at")).alias("r")).select("r.*")
        last = last.withColumn("status", F.coalesce("status", F.lit("draft"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        return last.orderBy(parse_version(F.col("tag")).desc())

    def commit(self, df: DataFrame, *, tag: str | None = None, step: str = "minor", description: str = "", metadata: dict[str, str] | None = None, as_of: datetime.datetime) -> str:
        """Write ``df`` as a new version and return its tag; a tag that exists is a ValueError."""
        newest = self.versions().select("tag").first()
        parent = newest["tag"] if newest else None
        if tag is None:
            one = self.spark.createDataFrame([(parent,)], "t string")
            tag = one.select(next_version(F.col("t"), step).alias("n")).first()["n"]
        if self.versions().where(F.col("tag") == tag).count():
            raise ValueError(f"version {tag} exists")
        path = f"{self.root}/data/{tag}"
        df.write.parquet(path)
        kept = self.spark.read.parquet(path)
        entry = {"tag": tag, "description": description, "parent": parent, "created_at": as_of.isoformat(), "hash": content_hash(kept), "rows": kept.count(), "metadata": metadata or {}}
        self._append(entry)
        return tag

    def _append(self, entry: dict) -> None:
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("append").text(self._registry())

    def _change(self, tag: str, as_of: datetime.datetime, **fields: object) -> None:
        row = self.versions().where(F.col("tag") == tag).first()
        if row is None:
            raise KeyError(tag)
        self._append(row.asDict(recursive=True) | fields | {"changed_at": as_of.isoformat()})

    def add_tag(self, tag: str, name: str, *, as_of: datetime.datetime) -> None:
        """Give a version a further name (``production``); one that it has changes nothing."""
        row = self.versions().where(F.col("tag") == tag).first()
        if row is None:
            raise KeyError(tag)
        if name not in row["tags"]:
            self._change(tag, as_of, tags=[*row["tags"], name])

    def set_status(self, tag: str, status: str, *, as_of: datetime.datetime) -> None:
        """draft, active or archived, or what the caller calls it."""
        self._change(tag, as_of, status=status)

    def listed(self, *, status: str | None = None, name: str | None = None) -> DataFrame:
        """Versions of a status, with a further name, or both; newest commit first."""
        out = self.versions()
        if status is not None:
            out = out.where(F.col("status") == status)
        if name is not None:
            out = out.where(F.array_contains("tags", name))
        return out.orderBy(F.desc("created_at"), F.desc("tag"))

    def archive(self, keep: int = 100, *, as_of: datetime.datetime) -> int:
        """Archive what is beyond the ``keep`` newest commits; how many were not so before."""
        old = [r["tag"] for r in self.archived(keep).where("status <> 'archived'").select("tag").collect()]
        for tag in old:
            self.set_status(tag, "archived", as_of=as_of)
        return len(old)

    def export(self, tag: str, path: str) -> None:
        """A copy of a version's rows under ``path``, in a folder of its tag."""
        self.checkout(tag).write.mode("overwrite").parquet(f"{path}/{tag}")

    def checkout(self, tag: str) -> DataFrame:
        """The rows of a version."""
        if not self.versions().where(F.col("tag") == tag).count():
            raise KeyError(tag)
        return self.spark.read.parquet(f"{self.root}/data/{tag}")

    def compare(self, a: str, b: str) -> DataFrame:
        """Differences of the metadata of two versions."""
        pick = lambda t: self.versions().where(F.col("tag") == t).select(F.lit("m").alias("k"), "metadata")
        return map_difference(pick(a), pick(b), key="k", entries="metadata").drop("k")

    def archived(self, keep: int = 100) -> DataFrame:
        """Versions beyond the ``keep`` newest by time of commit."""
        newest = self.versions().orderBy(F.desc("created_at"), F.desc("tag")).limit(keep)
        return self.versions().join(newest.select("tag"), "tag", "left_anti")

    def statistics(self) -> DataFrame:
        """One row: ``n_versions``, ``n_rows``, the ``latest`` tag, ``by_status`` (map of counts) and
        ``n_bytes`` of all data."""
        counts = self.versions().groupBy("status").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max(F.struct(parse_version(F.col("tag")), "tag")).alias("last"))
        out = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_versions"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.max("last")["tag"].alias("latest"),
            F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("by_status"),
        )
        return out.withColumn("n_bytes", F.lit(folder_bytes(self.spark, f"{self.root}/data")).cast("long"))

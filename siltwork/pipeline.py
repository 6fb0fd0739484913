"""One façade over the steps from raw logs to a versioned data set."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.config import EtlConfig, WriterConfig
from siltwork.operators.dataset import balance, dataset_statistics, reject_reason, stratified_split
from siltwork.operators.etl import process_records
from siltwork.operators.model_calls import Classifier, classify, rule_classification
from siltwork.operators.versions import VersionStore
from siltwork.sources.readers import read_any
from siltwork.sources.sinks import export


class Pipeline:
    """read -> process -> classify -> balance and split -> commit."""

    def __init__(self, spark: SparkSession, root: str, *, classifier: Classifier | None = None, etl: EtlConfig = EtlConfig(), writer: WriterConfig = WriterConfig()) -> None:
        self.spark, self.classifier, self.etl, self.writer = spark, classifier, etl, writer
        self.store = VersionStore(spark, root)

    def ingest(self, path: str, source: str = "upload", *, multi_line: bool = True) -> DataFrame:
        """Normalised records of a file; rows get ids in the order of the file where they have none.
        A CSV without line breaks within quotes may be split among tasks by ``multi_line=False``."""
        raw = read_any(self.spark, path, multi_line=multi_line)
        if "row_id" not in raw.columns:
            raw = raw.withColumn("row_id", F.monotonically_increasing_id())
        return process_records(raw, source=source, config=self.etl)

    def classify(self, records: DataFrame) -> DataFrame:
        """Records with ``domain`` and ``confidence``."""
        if self.classifier is None:
            return records.withColumn("__sw_c", rule_classification(F.col("text"))).withColumn("domain", F.col("__sw_c.label")).withColumn("confidence", F.col("__sw_c.confidence")).drop("__sw_c")
        labels = classify(records, self.classifier).select(F.col("id").alias("row_id"), F.col("label").alias("domain"), "confidence")
        return records.join(labels, "row_id")

    def build(self, labelled: DataFrame) -> DataFrame:
        """Fit rows, balanced and split. With ``leak_safe`` the split comes first, so that copies
        of a row made for balance stay in the training part."""
        fit = labelled.where(reject_reason(F.col("text"), F.col("domain")).isNull())
        if not self.writer.leak_safe:
            rows = balance(fit, config=self.writer).withColumn("part_id", F.concat_ws("#", F.col("row_id").cast("string"), F.col("copy").cast("string")))
            return stratified_split(rows, id_col="part_id", config=self.writer)
        parts = stratified_split(fit, config=self.writer)
        train = balance(parts.where("split = 'train'"), config=self.writer)
        held = parts.where("split = 'eval'").withColumn("copy", F.lit(1))
        return train.unionByName(held).withColumn("part_id", F.concat_ws("#", F.col("row_id").cast("string"), F.col("copy").cast("string")))

    def run(self, path: str, *, as_of: datetime.datetime, description: str = "") -> str:
        """All steps; returns the tag of the new version."""
        return self.store.commit(self.build(self.classify(self.ingest(path))), description=description, as_of=as_of)

    def load(self, tag: str, split: str | None = None) -> DataFrame:
        """A version or one of its parts."""
        rows = self.store.checkout(tag)
        return rows if split is None else rows.where(F.col("split") == split)

    def download(self, tag: str, split: str, path: str) -> None:
        """A part of a version as JSON lines."""
        export(self.load(tag, split), path, "jsonl")

    def statistics(self, tag: str) -> DataFrame:
        """Statistics of a version."""
        return dataset_statistics(self.store.checkout(tag))

"""Calls of models that live outside of Spark: cache first, then partitions of misses."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.taxonomy import decided_label, is_stop_word, keyword_hits, let

#: texts -> (label, confidence) of each.
Classifier = Callable[[list[str]], list[tuple[str, float]]]
#: (texts, domains) -> variants of each.
Augmenter = Callable[[list[str], list[str]], list[list[str]]]


def cache_key(*parts: Column) -> Column:
    """Digest of what an answer depends on; null parts are empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def label_key(text: Column, labels: tuple[str, ...] = (), context: Column | None = None) -> Column:
    """What an answer depends on when labels and context are given: text, sorted labels, the first
    100 characters of the context, joined by bars; empty parts are left out."""
    parts = [F.coalesce(text, F.lit(""))]
    if labels:
        parts.append(F.lit(",".join(sorted(labels))))
    if context is not None:
        parts.append(F.nullif(F.left(context, F.lit(100)), F.lit("")))
    return F.concat_ws("|", *parts)


def cache_put(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers (``key``, ``result``, ``ts``), one entry a key: the latest stands. A
    null key is no entry."""
    columns = ("key", "result", "ts")
    both = cache.select(*columns).unionByName(answers.select(*columns)).where("key IS NOT NULL")
    return both.groupBy("key").agg(F.max_by("result", F.struct("ts", "result")).alias("result"), F.max("ts").alias("ts"))


def labeler_rates(df: DataFrame, *, confidence: Column, error: Column, low: float = 0.5) -> DataFrame:
    """One row: results, errors, those of low confidence, and their rates (null for none)."""
    out = df.agg(F.count("*").alias("total"), F.count_if(error).alias("errors"), F.count_if(confidence < low).alias("low_confidence"))
    return out.withColumn("error_rate", F.try_divide("errors", "total")).withColumn("low_rate", F.try_divide("low_confidence", "total"))


def augmenter_rates(df: DataFrame, *, variants: str = "variants", success: str = "success") -> DataFrame:
    """One row: seeds, variants made, failures, variants a seed, rate of failures (null for none)."""
    made = F.greatest(F.size(F.coalesce(F.col(variants), F.array())), F.lit(0))
    out = df.agg(F.count("*").alias("total"), F.coalesce(F.sum(made), F.lit(0)).alias("generated"), F.count_if(~F.coalesce(F.col(success), F.lit(False))).alias("errors"))
    return out.withColumn("variants_per_seed", F.try_divide("generated", "total")).withColumn("error_rate", F.try_divide("errors", "total"))


def answer_defaults(labels: tuple[Column, ...], scores: tuple[Column, ...]) -> Column:
    """(label, confidence): the first label that isn't empty, else oos; the first score that is
    neither missing nor 0, else 0.5."""
    label = F.coalesce(*[F.nullif(x, F.lit("")) for x in labels], F.lit("oos"))
    return F.struct(label.alias("label"), F.coalesce(*[F.nullif(x, F.lit(0.0)) for x in scores], F.lit(0.5)).alias("confidence"))


def latest_entries(cache: DataFrame, *, as_of: datetime.datetime, hours: int = 24) -> DataFrame:
    """``key``, ``result``: the last answer for each key that isn't older than the time to live."""
    fresh = cache.where(F.col("ts") >= F.lit(as_of - datetime.timedelta(hours=hours)))
    return fresh.groupBy("key").agg(F.max_by("result", F.struct("ts", "result")).alias("result"))


def cache_statistics(cache: DataFrame, *, as_of: datetime.datetime, hours: int = 24) -> DataFrame:
    """One row: ``entries``, distinct ``keys``, ``fresh`` entries and ``expired`` ones (no time: expired)."""
    fresh = F.col("ts") >= F.lit(as_of - datetime.timedelta(hours=hours))
    return cache.agg(F.count("*").alias("entries"), F.countDistinct("key").alias("keys"), F.count_if(fresh).alias("fresh"), F.count_if(~F.coalesce(fresh, F.lit(False))).alias("expired"))


def rule_classification(text: Column) -> Column:
    """(label, confidence) without any model: stop words, rules, best hint, else oos."""

    def decide(hits: Column) -> Column:
        best, sure = F.get(hits, F.lit(0)), decided_label(hits)
        label = F.coalesce(sure, best["label"], F.lit("oos"))
        return F.struct(label.alias("label"), F.when(sure.isNotNull(), 0.9).when(best.isNotNull(), 0.5).otherwise(0.0).alias("confidence"))

    stop = F.struct(F.lit("oos").alias("label"), F.lit(0.95).alias("confidence"))
    return F.when(is_stop_word(text), stop).otherwise(let(keyword_hits(F.coalesce(text, F.lit(""))), decide))


def classify(df: DataFrame, classifier: Classifier, *, text: str = "text", id_col: str = "row_id", batch: int = 64) -> DataFrame:
    """``id``, ``label``, ``confidence`` of each row; stop words never reach the model, each distinct
    text does once, and a batch that fails is oos with confidence 0."""
    asked = df.where(~is_stop_word(F.col(text)) & F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, out = frame["t"].tolist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    answers = list(classifier(part))
                    if len(answers) != len(part):
                        raise ValueError("a label for each text")
                except Exception:  # noqa: BLE001 - whatever a model raises costs its batch only
                    answers = [("oos", 0.0)] * len(part)
                out += answers
            yield pd.DataFrame({"t": texts, "label": [a for a, _ in out], "confidence": [float(c) for _, c in out]})

    answers = asked.mapInPandas(run, "t string, label string, confidence double")
    joined = df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(answers, "t", "left")
    stop = is_stop_word(F.col("t"))
    return joined.select("id", F.when(stop, "oos").otherwise(F.coalesce("label", F.lit("oos"))).alias("label"), F.when(stop, 0.95).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def augment(df: DataFrame, augmenter: Augmenter, *, text: str = "text", domain: str = "domain", variants: int = 3) -> DataFrame:
    """``original_text``, ``domain``, ``variant``: distinct, non-empty variants that differ from the
    original, up to ``variants`` for each seed; a seed that fails gives none."""
    seeds = df.select(F.col(text).alias("original_text"), F.col(domain).alias("domain")).where("original_text IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                made = augmenter(frame["original_text"].tolist(), frame["domain"].tolist())
            except Exception:  # noqa: BLE001
                made = [[] for _ in range(len(frame))]
            rows = [
                (o, d, v) for o, d, vs in zip(frame["original_text"], frame["domain"], made)
                for v in list(dict.fromkeys(x.strip(" -•") for x in vs if x and x.strip(" -•") and x.strip(" -•") != o))[:variants]
            ]
            yield pd.DataFrame(rows, columns=["original_text", "domain", "variant"])

    return seeds.mapInPandas(run, "original_text string, domain string, variant string")


def response_lines(c: Column, most: int = 4) -> Column:
    """Distinct non-empty lines of a model's answer without bullets, at most ``most``."""
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^[-•\s]+", "")))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: x != "")), 1, most)


def response_json(c: Column, schema: str) -> Column:
    """The object between the first and the last brace of a model's answer, or null."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)

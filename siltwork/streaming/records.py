"""The same operators on streams: ingest without duplicates, counts by time, user context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltwork.config import EtlConfig
from siltwork.functions.text import collapse_ws


def clean_stream(df: DataFrame, *, at: str = "ts", late: str = "1 hour", config: EtlConfig = EtlConfig()) -> DataFrame:
    """Normalised texts of a stream, each once within the watermark, which bounds the state."""
    text = F.substring(collapse_ws(F.col("text")), 1, config.max_length)
    good = df.withColumn("text", text).where(F.char_length("text") >= config.min_length)
    return good.withWatermark(at, late).dropDuplicatesWithinWatermark(["text"])


def windowed_counts(df: DataFrame, *, at: str, key: str, window: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows by window and key; late rows within the watermark count."""
    span = F.window(at, window, slide) if slide else F.window(at, window)
    return df.withWatermark(at, late).groupBy(span, key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def user_preferences(df: DataFrame, *, user: str = "user_id", domain: str = "domain", at: str = "ts") -> DataFrame:
    """After each batch ``user``, ``domain``, ``weight``: every message halves the weights so far
    and adds a half (the first counts whole). Only the weights are kept, for a user at most one
    for each domain seen."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weights: dict[str, float] = dict(zip(*state.get)) if state.exists else {}
        for frame in frames:
            for d in frame.sort_values(at)[domain]:
                if pd.isna(d):
                    continue
                if not weights:
                    weights = {d: 1.0}
                else:
                    weights = {k: v / 2 for k, v in weights.items()}
                    weights[d] = weights.get(d, 0.0) + 0.5
        state.update((list(weights), list(weights.values())))
        yield pd.DataFrame({"user": [key[0]] * len(weights), "domain": list(weights), "weight": list(weights.values())})

    return df.groupBy(user).applyInPandasWithState(
        update, "user string, domain string, weight double", "domains array<string>, weights array<double>", "update", GroupStateTimeout.NoTimeout
    )

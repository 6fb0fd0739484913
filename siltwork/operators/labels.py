"""Label quality: votes, ensembles, calibration, error analysis, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.config import ConsensusConfig
from siltwork.functions.taxonomy import validate_domain
from siltwork.functions.text import DOMAINS


def count_votes(votes: DataFrame) -> DataFrame:
    """``id``, ``winner``, ``winner_votes``, ``total_votes``, ``mean_confidence``, ``winner_confidence``.

    ``votes``: ``id``, ``label``, ``confidence``, ``turn``. The label with most votes wins, of
    equal ones the one first seen. Null labels don't vote.
    """
    per = votes.where("label IS NOT NULL").groupBy("id", "label").agg(
        F.count("*").alias("n"), F.min("turn").alias("first"), F.sum("confidence").alias("s"), F.count("confidence").alias("m")
    )
    best = F.max_by(F.struct("label", "n", (F.col("s") / F.col("m")).alias("own")), F.struct("n", -F.col("first"), "label"))
    return per.groupBy("id").agg(
        best.alias("w"), F.sum("n").alias("total_votes"), (F.sum("s") / F.sum("m")).alias("mean_confidence")
    ).select(
        "id", F.col("w.label").alias("winner"), F.col("w.n").alias("winner_votes"), "total_votes", "mean_confidence",
        F.col("w.own").alias("winner_confidence"),
    )


def consensus_labels(votes: DataFrame, rules: DataFrame, config: ConsensusConfig = ConsensusConfig()) -> DataFrame:
    """Final label of each item from its votes and the label its rules give (``id``, ``rule``; null: none).

    In strict mode the rules outweigh a different winner. Confidence is the mean over all votes,
    plus the boost (at most 1) where rules and winner agree. Valid are items with a consensus and
    enough confidence. Items without votes are ``oos`` with ratio 0.
    """
    out = rules.join(count_votes(votes), "id", "left")
    ratio = F.coalesce(F.col("winner_votes") / F.col("total_votes"), F.lit(0.0))
    winner = F.coalesce("winner", F.lit("oos"))
    final = F.coalesce(F.when(F.lit(config.strict), F.col("rule")), winner)
    mean = F.coalesce("mean_confidence", F.lit(0.0))
    conf = F.when(F.col("rule") == winner, F.least(F.lit(1.0), mean + config.rule_boost)).otherwise(mean)
    return out.select(
        "id", final.alias("final_domain"), conf.alias("final_confidence"), ratio.alias("consensus_ratio"),
        (ratio >= config.threshold).alias("consensus_achieved"), (F.col("rule") == winner).alias("rule_match"),
        ((ratio >= config.threshold) & (conf >= config.min_confidence)).alias("is_valid"),
    )


def ensemble_labels(votes: DataFrame, threshold: float = 0.67) -> DataFrame:
    """Plurality over models (at least two votes): confidence is the mean of the winner's votes."""
    ratio = F.col("winner_votes") / F.col("total_votes")
    return count_votes(votes).where("total_votes >= 2").select(
        "id", F.col("winner").alias("label"), F.col("winner_confidence").alias("confidence"), ratio.alias("ratio"), (ratio >= threshold).alias("agreed")
    )


def calibration_table(df: DataFrame, *, label: Column, confidence: Column, correct: Column) -> DataFrame:
    """``domain``, ``bucket`` (tenths of confidence), ``n``, ``accuracy``."""
    rows = df.select(label.alias("domain"), F.floor(confidence * 10).cast("int").alias("bucket"), correct.cast("int").alias("ok"))
    return rows.where("bucket IS NOT NULL AND ok IS NOT NULL").groupBy("domain", "bucket").agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"))


def calibrate(df: DataFrame, table: DataFrame, *, label: Column, confidence: Column, out_col: str = "calibrated") -> DataFrame:
    """The accuracy of the label's bucket, or the raw confidence where there is none.

    The table has at most eleven rows for each canonical domain, hence the broadcast.
    """
    small = F.broadcast(table.where(F.col("domain").isin(*DOMAINS)).select(F.col("domain").alias("__sw_d"), F.col("bucket").alias("__sw_b"), F.col("accuracy").alias("__sw_a")))
    on = (label == F.col("__sw_d")) & (F.floor(confidence * 10).cast("int") == F.col("__sw_b"))
    return df.join(small, on, "left").withColumn(out_col, F.coalesce("__sw_a", confidence)).drop("__sw_d", "__sw_b", "__sw_a")


def confidence_summary(df: DataFrame, *, label: Column, confidence: Column, valid: Column) -> DataFrame:
    """``domain``, counts and spread of confidence."""
    rows = df.select(label.alias("domain"), confidence.alias("c"), valid.alias("v"))
    return rows.groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if("v").alias("n_valid"), F.avg("c").alias("mean"), F.percentile("c", 0.5).alias("median"),
        F.stddev_pop("c").alias("std"), F.min("c").alias("low"), F.max("c").alias("high"),
    )


def confusions(df: DataFrame, *, predicted: Column, truth: Column, top: int = 10) -> DataFrame:
    """The ``top`` most frequent pairs of different predicted and true label."""
    rows = df.select(predicted.alias("predicted"), truth.alias("truth")).where("predicted <> truth")
    return rows.groupBy("predicted", "truth").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicted", "truth").limit(top)


def sane_candidates(c: Column) -> Column:
    """Candidates (label, score) with canonical labels and numeric scores (null and NaN: 0); null entries go."""
    good = F.filter(c, lambda x: x.isNotNull() & x["label"].isNotNull())
    return F.transform(good, lambda x: F.struct(validate_domain(x["label"]).alias("label"), F.coalesce(F.nanvl(x["score"].cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score")))


def best_candidate(c: Column) -> Column:
    """The sane candidate of highest score (ties: first label in order)."""
    return F.get(F.array_sort(sane_candidates(c), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)), F.lit(0))


def override_by_candidate(domain: Column, confidence: Column, candidates: Column, threshold: float = 0.7) -> Column:
    """(domain, confidence): those of the best candidate if it reaches the threshold and isn't oos."""
    best = best_candidate(candidates)
    take = (best["score"] >= threshold) & (best["label"] != "oos")
    return F.struct(F.when(take, best["label"]).otherwise(validate_domain(domain)).alias("domain"), F.when(take, best["score"]).otherwise(confidence).alias("confidence"))


def label_accuracy(df: DataFrame, *, given: Column, found: Column) -> DataFrame:
    """One row: ``n``, ``n_correct``, ``n_relabelled``, ``accuracy`` of given labels against found ones."""
    rows = df.select((given == found).alias("ok"))
    out = rows.agg(F.count("ok").alias("n"), F.count_if("ok").alias("n_correct"), F.count_if(~F.col("ok")).alias("n_relabelled"))
    return out.withColumn("accuracy", F.try_divide("n_correct", "n"))


def validation_rates(df: DataFrame) -> DataFrame:
    """One row: items and shares with a consensus, a matching rule, and found valid."""
    share = lambda c: F.try_divide(F.count_if(F.coalesce(F.col(c), F.lit(False))), F.count("*"))
    return df.agg(F.count("*").alias("n"), share("consensus_achieved").alias("consensus_rate"), share("rule_match").alias("rule_rate"), share("is_valid").alias("valid_rate"))


def problem_items(df: DataFrame, *, id_col: str, confidence: str, ratio: str, top: int = 20) -> DataFrame:
    """The ``top`` invalid items of least agreement and confidence (a report)."""
    return df.where("NOT is_valid").orderBy(F.asc_nulls_first(ratio), F.asc_nulls_first(confidence), id_col).limit(top).select(id_col, ratio, confidence)

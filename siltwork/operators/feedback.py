"""What people's corrections, reviews and messages tell: queue, feedback, user context."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.config import FeedbackConfig
from siltwork.operators.ranking import ranked_within


def review_batch(df: DataFrame, queued: DataFrame, *, low: float = 0.5, capacity: int = 10_000, text: str = "text", confidence: str = "confidence", id_col: str = "row_id") -> DataFrame:
    """Rows below ``low`` whose text isn't queued yet, one for each text, least confident first, as
    many as the queue has room for (the capacity is the feature). ``item`` is their id."""
    room = max(0, capacity - queued.count())
    new = df.where((F.col(confidence) < low) & F.col(text).isNotNull())
    one = new.groupBy(text).agg(F.min(F.struct(confidence, id_col)).alias("r")).select(F.col("r." + id_col).alias(id_col), text, F.col("r." + confidence).alias(confidence))
    fresh = one.join(queued.select(text), text, "left_anti")
    return fresh.orderBy(confidence, id_col).limit(room).withColumn("item", F.left(F.md5(text), F.lit(16)))


def feedback_statistics(df: DataFrame, *, predicted: Column, corrected: Column, at: Column, as_of: datetime.datetime) -> DataFrame:
    """``predicted``, ``corrected``, ``n``, ``recent`` (last 7 days): counts of all opinions."""
    rows = df.select(predicted.alias("predicted"), corrected.alias("corrected"), (at >= F.lit(as_of - datetime.timedelta(days=7))).alias("r"))
    return rows.groupBy("predicted", "corrected").agg(F.count("*").alias("n"), F.count_if("r").alias("recent"))


def should_retrain(counts: DataFrame, *, recent: int = 20, rate: float = 0.3) -> DataFrame:
    """One row: ``total``, ``corrections``, ``rate``, ``recent``, ``retrain``."""
    changed = F.col("predicted") != F.col("corrected")
    out = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(changed, F.col("n"))), F.lit(0)).alias("corrections"),
        F.coalesce(F.sum(F.when(changed, F.col("recent"))), F.lit(0)).alias("recent"),
    )
    share = F.coalesce(F.try_divide(F.col("corrections"), F.col("total")), F.lit(0.0))
    return out.withColumn("rate", share).withColumn("retrain", (F.col("recent") > recent) | (F.col("rate") > rate))


def prompt_warnings(counts: DataFrame, *, least: int = 3, total: int = 10) -> DataFrame:
    """Pairs corrected at least ``least`` times, once there are ``total`` corrections, as warnings."""
    wrong = counts.where("predicted <> corrected")
    pairs = wrong.withColumn("all", F.sum("n").over(W.partitionBy())).where((F.col("all") >= total) & (F.col("n") >= least))
    return pairs.select("predicted", "corrected", "n", F.concat("predicted", F.lit(" is often "), "corrected").alias("warning"))


def dynamic_examples(df: DataFrame, *, text: Column, corrected: Column, at: Column, as_of: datetime.datetime, config: FeedbackConfig = FeedbackConfig()) -> DataFrame:
    """``domain``, ``turn``, ``text``: the latest examples of each domain from corrections of the
    window whose text has one corrected domain only and a fit length."""
    since = as_of - datetime.timedelta(days=config.window_days)
    rows = df.select(text.alias("text"), corrected.alias("domain"), at.alias("at")).where((F.col("at") >= F.lit(since)) & F.char_length(F.trim("text")).between(config.min_length, config.max_length))
    clear = rows.groupBy("text").agg(F.min("domain").alias("domain"), F.max("domain").alias("other"), F.max("at").alias("at")).where("domain = other")
    turn = F.row_number().over(W.partitionBy("domain").orderBy(F.desc("at"), "text"))
    return clear.withColumn("turn", turn).where(F.col("turn") <= config.per_domain).select("domain", "turn", "text")


def last_messages(df: DataFrame, *, user: str, at: str, id_col: str, n: int = 10) -> DataFrame:
    """The ``n`` latest rows of each user and their ``turn`` (1 the latest). Spark cuts every
    partition to ``n`` rows a user before the shuffle, so a heavy user is no burden."""
    turn = F.row_number().over(W.partitionBy(user).orderBy(F.desc(at), F.desc(id_col)))
    return df.where(F.col(user).isNotNull()).withColumn("turn", turn).where(F.col("turn") <= n)


def preferences(df: DataFrame, *, user: str, domain: str, at: str, id_col: str) -> DataFrame:
    """``user``, ``domain``, ``weight``, ``place``: each message halves what went before and adds half.

    Message k of n counts 2^-(n-k+1), the first 2^-(n-1), over all messages of a user. ``place``
    orders a user's domains by exact weight, equal weights alike: a weight may be less than a
    double can hold, but it is a binary number whose digits are the places of the domain's
    messages, so the domain seen later weighs more. Only a domain that holds all messages before
    the single one of another is as heavy as that.
    """
    rows = df.where(F.col(user).isNotNull()).select(F.col(user).alias("user"), F.col(domain).alias("domain"), F.col(at).alias("at"), F.col(id_col).alias("id"))
    back = ranked_within(rows, F.col("user"), [F.desc("at"), F.desc("id")], "back")
    per = back.groupBy("user", "domain").agg(F.min("back").alias("latest"), F.max("back").alias("oldest"), F.count("*").alias("n"), F.sum(F.pow(F.lit(2.0), -F.col("back").cast("double"))).alias("w"))
    of_user, by_latest = W.partitionBy("user"), W.partitionBy("user").orderBy("latest")
    all_ = F.max("oldest").over(of_user)
    weight = F.col("w") + F.when(F.col("oldest") == all_, F.pow(F.lit(2.0), -all_.cast("double"))).otherwise(0.0)
    rest = F.col("n") == all_ - F.col("latest") + 1
    single = (F.lag("n").over(by_latest) == 1) & (F.lag("latest").over(by_latest) == F.col("latest") - 1)
    place = F.row_number().over(by_latest) - F.coalesce((rest & single).cast("int"), F.lit(0))
    return per.select("user", "domain", weight.alias("weight"), place.alias("place"))


def context_statistics(df: DataFrame, *, user: Column, at: Column, as_of: datetime.datetime, hours: int = 24) -> DataFrame:
    """One row: users, users active in the last hours, messages."""
    per = df.select(user.alias("u"), at.alias("at")).where("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return per.agg(F.count("*").alias("users"), F.count_if(F.col("last") > F.lit(as_of - datetime.timedelta(hours=hours))).alias("active"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))


def example_texts(examples: DataFrame) -> DataFrame:
    """``domain``, ``prompt``: the examples of each domain (at most a few) as numbered lines."""
    line = F.concat(F.lit("Example "), F.col("turn").cast("string"), F.lit(": "), F.col("text"), F.lit(" -> "), F.col("domain"))
    lines = examples.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lines.select("domain", F.array_join(F.col("l.line"), "\n").alias("prompt"))


def preferred_domains(weights: DataFrame, k: int = 3) -> DataFrame:
    """``user``, ``turn``, ``domain``: the ``k`` domains of most weight of each user, by ``place``
    where there is one."""
    heaviest = F.col("place") if "place" in weights.columns else F.desc("weight")
    turn = F.row_number().over(W.partitionBy("user").orderBy(heaviest, "domain"))
    return weights.withColumn("turn", turn).where(F.col("turn") <= k).select("user", "turn", "domain")


def context_prompts(messages: DataFrame, weights: DataFrame, *, user: str, text: str, at: str, id_col: str) -> DataFrame:
    """``user``, ``recent`` (the two messages before the latest, oldest first, cut to 100
    characters), ``domains`` (up to three preferred ones)."""
    last = last_messages(messages, user=user, at=at, id_col=id_col, n=3).where("turn > 1")
    recent = last.groupBy(F.col(user).alias("user")).agg(F.sort_array(F.collect_list(F.struct((-F.col("turn")).alias("o"), F.left(F.col(text), F.lit(100)).alias("t")))).alias("m"))
    top = preferred_domains(weights).groupBy("user").agg(F.sort_array(F.collect_list(F.struct("turn", "domain"))).alias("d"))
    return top.join(recent, "user", "left").select("user", F.coalesce(F.array_join(F.col("m.t"), " | "), F.lit("")).alias("recent"), F.array_join(F.col("d.domain"), ",").alias("domains"))


def queue_statistics(df: DataFrame, *, status: str = "status", priority: str = "priority", confidence: str = "confidence", statuses: tuple[str, ...] = (), priorities: tuple[str, ...] = ()) -> DataFrame:
    """``kind``, ``name``, ``n``, ``avg_confidence``: items in all, by status and by priority; names
    that no item has are given with 0, values beyond the named ones have no row."""
    n, mean = F.count("*").alias("n"), F.avg(confidence).alias("avg_confidence")
    out = df.agg(n, mean).select(F.lit("all").alias("kind"), F.lit("").alias("name"), "n", "avg_confidence")
    for kind, column, names in (("status", status, statuses), ("priority", priority, priorities)):
        if names:
            known = df.sparkSession.createDataFrame([(x,) for x in names], "name string")
            counts = df.groupBy(F.col(column).alias("name")).agg(n, mean)
            part = known.join(counts, "name", "left").select(F.lit(kind).alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"), "avg_confidence")
            out = out.unionByName(part)
    return out


def priority_of(confidence: Column) -> Column:
    """critical, high, medium or low by confidence; a missing one is critical."""
    return F.when(confidence < 0.3, "critical").when(confidence < 0.5, "high").when(confidence < 0.7, "medium").when(confidence >= 0.7, "low").otherwise("critical")


def queue_order(df: DataFrame, n: int, *, confidence: str = "confidence", created: str = "created_at", id_col: str = "review_id") -> DataFrame:
    """The next ``n`` pending items: by priority, confidence, time of creation and id (the number is
    the feature)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")]), priority_of(F.col(confidence)))
    return df.where("status = 'pending'").orderBy(rank, F.asc_nulls_last(confidence), F.asc_nulls_last(created), id_col).limit(n)


def corrections_by_domain(counts: DataFrame) -> DataFrame:
    """``predicted``, ``n``, ``corrections``, ``rate`` of each predicted label, from ``feedback_statistics``."""
    changed = F.when(F.col("predicted") != F.col("corrected"), F.col("n")).otherwise(0)
    out = counts.groupBy("predicted").agg(F.sum("n").alias("n"), F.sum(changed).alias("corrections"))
    return out.withColumn("rate", F.try_divide("corrections", "n"))


def top_corrections(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent pairs of predicted and corrected label (a report)."""
    return counts.where("predicted <> corrected").orderBy(F.desc("n"), "predicted", "corrected").limit(k).select("predicted", "corrected", "n")


def active_users(df: DataFrame, *, user: Column, at: Column, as_of: datetime.datetime, hours: int = 24) -> DataFrame:
    """``user``, ``n``, ``last`` of users with a message in the last hours; the others' contexts may go."""
    per = df.select(user.alias("user"), at.alias("at")).where("user IS NOT NULL").groupBy("user").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return per.where(F.col("last") > F.lit(as_of - datetime.timedelta(hours=hours)))


def top_preferences(weights: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` domains of most weight summed over users (a report)."""
    sums = weights.groupBy("domain").agg(F.sum("weight").alias("weight"))
    return sums.orderBy(F.desc(F.round("weight", 6)), "domain").limit(k)

"""From labelled rows to a data set: quality filter, balance, split, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.config import WriterConfig
from siltwork.functions.text import strip_ws
from siltwork.operators.ranking import ranked_within


def seeded_order(id_col: str, seed: int) -> Column:
    """A shuffle that is the same everywhere: by digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")))


def reject_reason(text: Column, domain: Column) -> Column:
    """Why a row isn't fit to be written; null if it is."""
    return (
        F.when(text.isNull() | (text == ""), "empty text").when(domain.isNull() | (domain == ""), "no domain")
        .when(F.char_length(strip_ws(text)) < 3, "short text").when(F.char_length(text) > 5000, "long text")
    )


def domain_sizes(df: DataFrame, domain: str = "domain") -> DataFrame:
    """``domain``, ``n``: counted before the shuffle."""
    return df.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("n"))


#: Domains whose sizes may reach the driver.
MAX_DOMAINS = 1000


def _collected_sizes(df: DataFrame, domain: str) -> dict[str | None, int]:
    rows = domain_sizes(df, domain).limit(MAX_DOMAINS + 1).collect()
    if len(rows) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    return {r["domain"]: r["n"] for r in rows}


def balance_target(sizes: list[int], config: WriterConfig = WriterConfig()) -> int:
    """Rows each domain should have: the upper median, or with a cap the mean up to the cap."""
    ordered = sorted(sizes)
    if not ordered:
        return 0
    if config.max_per_domain is not None:
        return min(config.max_per_domain, sum(ordered) // len(ordered))
    return ordered[len(ordered) // 2]


def balance(df: DataFrame, *, domain: str = "domain", id_col: str = "row_id", config: WriterConfig = WriterConfig()) -> DataFrame:
    """``df`` and ``copy``: larger domains cut to the target by seeded order, smaller ones repeated
    in turn up to it. Domains with fewer rows than ``min_per_domain`` stay as they are. The number
    of domains is that of the taxonomy; their sizes are all that reaches the driver, and more than
    ``MAX_DOMAINS`` are a ValueError.
    """
    sizes = _collected_sizes(df, domain)
    target = balance_target(list(sizes.values()), config)
    goal = {d: n if n < config.min_per_domain else target for d, n in sizes.items()}
    ranked = ranked_within(df, F.col(domain), [seeded_order(id_col, config.seed), F.col(f"`{id_col}`")], "__sw_rank")
    size, want = F.lit(None).cast("long"), F.lit(None).cast("long")
    for d, n in sizes.items():
        here = F.col(domain).isNull() if d is None else F.col(domain) == d
        size, want = F.when(here, n).otherwise(size), F.when(here, goal[d]).otherwise(want)
    # Row r of n becomes copies r, r + n, r + 2n ... up to the goal.
    times = F.floor((want - F.col("__sw_rank")) / size) + 1
    return ranked.where(F.col("__sw_rank") <= want).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")))).drop("__sw_rank")


def eval_sizes(sizes: dict[str | None, int], config: WriterConfig = WriterConfig()) -> dict[str | None, int]:
    """Evaluation rows of each domain: the fraction, at least one unless the domain has one row;
    then up to the minimum in all, from the largest remaining domains, leaving each one row."""
    take = {d: 0 if n <= 1 else max(1, int(n * config.eval_fraction)) for d, n in sizes.items()}
    total = sum(sizes.values())
    missing = max(config.min_eval, int(total * config.eval_fraction)) - sum(take.values())
    for d in sorted(sizes, key=lambda d: (-(sizes[d] - take[d]), d or "")):
        more = max(0, min(missing, sizes[d] - take[d] - 1))
        take[d] += more
        missing -= more
    return take


def stratified_split(df: DataFrame, *, domain: str = "domain", id_col: str = "row_id", config: WriterConfig = WriterConfig()) -> DataFrame:
    """``df`` and ``split`` (train or eval), by domain and seeded order."""
    sizes = _collected_sizes(df, domain)  # one row a domain
    take = eval_sizes(sizes, config)
    ranked = ranked_within(df, F.col(domain), [seeded_order(id_col, config.seed), F.col(f"`{id_col}`")], "__sw_rank")
    limit = F.lit(0)
    for d, n in take.items():
        limit = F.when(F.col(domain).isNull() if d is None else F.col(domain) == d, n).otherwise(limit)
    return ranked.withColumn("split", F.when(F.col("__sw_rank") <= limit, "eval").otherwise("train")).drop("__sw_rank")


def dataset_statistics(df: DataFrame, *, domain: str = "domain", text: str = "text", confidence: str = "confidence") -> DataFrame:
    """One row: rows, domains, mean length and confidence (of rows that have one), imbalance."""
    rows = df.groupBy(domain).agg(
        F.count("*").alias("n"), F.sum(F.char_length(text)).alias("chars"), F.count(text).alias("texts"),
        F.sum(F.when(~F.isnan(confidence), F.col(confidence))).alias("conf"), F.count(F.when(~F.isnan(confidence), F.col(confidence))).alias("confs"),
    )
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_domains"),
        F.coalesce(F.try_divide(F.sum("chars"), F.sum("texts")), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.try_divide(F.sum("conf"), F.sum("confs")), F.lit(0.0)).alias("avg_confidence"),
        F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("imbalance"),
    )


def dataset_score(stats: DataFrame, duplicate_share: Column) -> DataFrame:
    """Quality score in 0..1 and its issues from the statistics of a data set."""
    score = 1 - 0.3 * duplicate_share - F.least(0.2 * F.coalesce("imbalance", F.lit(0.0)), F.lit(0.3)) - 0.2 * (1 - F.col("avg_confidence"))
    issues = F.array_compact(F.array(
        F.when(duplicate_share > 0.05, "duplicates"), F.when(F.col("imbalance") > 1, "imbalance"),
        F.when(F.col("avg_length") < 10, "short texts"), F.when(F.col("avg_length") > 500, "long texts"),
    ))
    return stats.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).withColumn("issues", F.array_join(issues, ","))


def augmentation_seeds(df: DataFrame, *, text: str = "text", labels: tuple[str, ...] = ("domain_true", "domain_id"), id_col: str = "row_id", per_domain: int = 30) -> DataFrame:
    """``id_col``, ``text``, ``domain``, ``turn``: the first rows of each domain to be augmented, in the
    order of ids. The domain is the first label that isn't empty; rows without label or text and
    unknown ones are no seeds. Spark cuts each domain before the shuffle; the number is the feature.
    """
    label = F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in labels])
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("text"), label.alias("domain")).where("text <> '' AND domain <> 'unknown'")
    turn = F.row_number().over(W.partitionBy("domain").orderBy(id_col))
    return rows.withColumn("turn", turn).where(F.col("turn") <= per_domain)


def distributions(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``field``, ``value``, ``n``: rows by value of each of some columns."""
    out = None
    for c in columns:
        part = df.groupBy(F.col(f"`{c}`").cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("field"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out

"""Consensus from several annotators' labels: a community confusion model.

Every annotator belongs to one of a few communities with a shared confusion matrix, and has a
matrix of their own whose prior is centred on the community's: an annotator with few labels is
judged mostly by the community, one with many by their own record. Item classes, memberships and
matrices are found by variational updates. The labels of an item stay together in one row; an
update is one pass over these rows against the matrices, and returns expected confusion counts
summed for each annotator. Nothing of the size of the data leaves the executors.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.session import bounded_broadcast, checkpointed


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers (recurrence and asymptotic series)."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _expected_log(alpha: np.ndarray) -> np.ndarray:
    return digamma(alpha) - digamma(alpha.sum(-1, keepdims=True))


@dataclass
class Model:
    """Expected logarithms of class prior and matrices (annotator, true class, given label)."""

    log_prior: np.ndarray
    log_matrix: np.ndarray

    def posterior(self, item: np.ndarray, annotator: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Class probabilities of ``n`` items from their flat lists of labels."""
        k = len(self.log_prior)
        score = np.tile(self.log_prior, (n, 1))
        for z in range(k):
            score[:, z] += np.bincount(item, weight * self.log_matrix[annotator, z, label], n)
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(1, keepdims=True)


class Communities:
    """Variational state of the communities and of the annotators' matrices."""

    def __init__(self, annotators: int, classes: int, levels: tuple[float, ...], strength: float, smoothing: float) -> None:
        k = classes
        self.k, self.strength, self.smoothing = k, strength, smoothing
        eye = np.eye(k)
        means = np.stack([eye * d + (1 - eye) * (1 - d) / (k - 1) for d in levels])
        #: Prior of the shared matrices: some pseudo-labels at each level of care.
        self.prior = means * smoothing
        self.shared = self.prior.copy()
        self.member = np.full((annotators, len(levels)), 1 / len(levels))
        self.alpha = np.tile(means.mean(0) * strength + 1e-2, (annotators, 1, 1))
        self.classes = np.ones(k)

    def update(self, counts: np.ndarray, class_counts: np.ndarray) -> None:
        """One round of updates from the expected counts (annotator, true class, label)."""
        self.classes = 1 + class_counts
        for _ in range(3):
            logs = _expected_log(self.shared)
            size = np.log(self.member.sum(0) + 1)
            score = np.einsum("azl,mzl->am", counts, logs) + size
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            self.member = p / p.sum(1, keepdims=True)
            self.shared = self.prior + np.einsum("am,azl->mzl", self.member, counts)
        means = self.shared / self.shared.sum(-1, keepdims=True)
        self.alpha = np.einsum("am,mzl->azl", self.member, means) * self.strength + counts + 1e-3

    def model(self) -> Model:
        return Model(_expected_log(self.classes), _expected_log(self.alpha))

    def reliability(self) -> np.ndarray:
        """Probability that an annotator gives the right label, over the class distribution."""
        mean = self.alpha / self.alpha.sum(-1, keepdims=True)
        share = self.classes / self.classes.sum()
        return np.einsum("azz,z->a", mean, share)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    lists = batch.column("annotators")
    ends = lists.offsets.to_numpy()
    item = np.repeat(np.arange(len(lists)), np.diff(ends))
    cut = slice(ends[0], ends[-1]) if len(ends) else slice(0, 0)
    get = lambda c: batch.column(c).values.to_numpy(zero_copy_only=False)[cut]
    return item, get("annotators"), get("labels"), get("weights")


def consensus(
    votes: DataFrame, *, classes: tuple[str, ...], levels: tuple[float, ...] = (0.92, 0.75, 0.5, 0.25),
    strength: float = 8.0, smoothing: float = 20.0, rounds: int = 25, tolerance: float = 2e-3, max_annotators: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) from ``votes``: ``item``, ``annotator``, ``label``, ``weight``.

    items: ``item``, ``label`` (most probable), ``probability``, ``agreement`` (share of pairs of
    labels of the item that agree; null for a single label), ``n_labels``.
    annotators: ``annotator``, ``community`` (most probable, 0 the most reliable level given),
    ``reliability`` (probability of a right label), ``n_labels``.

    Every label counts with its weight (null: 1): of a repeated one the weights add up, and of
    different ones of an annotator for an item all count, as vote counts of unnamed runs do, so
    remove outdated ones first. A warning tells if the updates haven't settled after ``rounds``. Labels outside ``classes`` and null ones are left out; an item with no label left
    has label null and probability null. A null annotator counts as one of its own. Ties go to
    the class named first. Only the number of annotators is bounded (their matrices are sent to
    all executors): beyond ``max_annotators`` a ValueError. Empty votes give two empty tables.
    """
    k = len(classes)
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    clean = votes.select(
        "item", F.coalesce("annotator", F.lit("")).alias("annotator"), F.when(code >= 0, code).cast("int").alias("label"),
        F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"),
    )
    known = clean.where("label IS NOT NULL").groupBy("annotator").count()
    names = known.orderBy("annotator").limit(max_annotators + 1).collect()  # bounded by the limit
    if len(names) > max_annotators:
        raise ValueError(f"more than {max_annotators} annotators")
    spark = votes.sparkSession
    sc = spark.sparkContext
    index = spark.createDataFrame([(r["annotator"], i) for i, r in enumerate(names)], "annotator string, a int")
    coded = clean.join(bounded_broadcast(index), "annotator", "left")
    one = coded.groupBy("item", "a", "label").agg(F.sum("weight").alias("weight"))
    items = one.groupBy("item").agg(
        F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("a", "label", "weight")))).alias("v")
    )
    items = checkpointed(
        items.select("item", F.col("v.a").alias("annotators"), F.col("v.label").alias("labels"), F.col("v.weight").alias("weights"))
    )
    state = Communities(len(names), k, levels, strength, smoothing)
    cells = [f"c{i}" for i in range(k * k)]
    schema = "a int, " + ", ".join(f"{c} double" for c in cells)

    def counted(model: Model) -> tuple[np.ndarray, np.ndarray]:
        shared, annotators = sc.broadcast(model), len(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Row `annotators` holds the class counts in its first cells.
            total = np.zeros((annotators + 1, k, k))
            for b in batches:
                item, who, label, weight = _flat(b)
                q = shared.value.posterior(item, who, label, weight, b.num_rows)
                used = np.bincount(item, minlength=b.num_rows) > 0
                total[annotators, 0] += q[used].sum(0)
                for z in range(k):
                    total[:annotators, z] += np.bincount(who * k + label, weight * q[item, z], annotators * k).reshape(annotators, k)
            at = np.flatnonzero(total.any((1, 2)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), *[pa.array(x) for x in total[at].reshape(len(at), -1).T]], names=["a", *cells]
            )

        sums = items.mapInArrow(run, schema).groupBy("a").agg(*[F.sum(c).alias(c) for c in cells]).collect()
        out = np.zeros((len(names) + 1, k, k))
        for r in sums:
            out[r["a"]] = np.array([r[c] for c in cells]).reshape(k, k)
        return out[:-1], out[-1, 0]

    before = None
    for _ in range(rounds if names else 0):
        counts, class_counts = counted(state.model())
        state.update(counts, class_counts)
        right = np.array([state.reliability()])
        if before is not None and np.abs(right - before).max() < tolerance:
            break
        before = right
    else:
        if names:
            warnings.warn(f"consensus: not settled after {rounds} rounds", stacklevel=2)
    model = sc.broadcast(state.model())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, who, label, weight = _flat(b)
            n = b.num_rows
            q = model.value.posterior(item, who, label, weight, n)
            per = np.stack([np.bincount(item, weight * (label == z), n) for z in range(k)], 1)
            m = per.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                agree = (per * (per - 1)).sum(1) / (m * (m - 1))
            none, lone = m == 0, m <= 1
            best = q.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [b.column("item"), pa.array([classes[i] for i in best], pa.string(), mask=none), pa.array(q.max(1), mask=none),
                 pa.array(np.where(lone, 0, np.clip(agree, 0, 1)), mask=lone), pa.array(m.astype(np.int64))],
                names=["item", "label", "probability", "agreement", "n_labels"],
            )

    kind = items.schema["item"].dataType.simpleString()
    result = items.mapInArrow(decide, f"item {kind}, label string, probability double, agreement double, n_labels long")
    rows = [
        (r["annotator"], int(state.member[i].argmax()), float(state.reliability()[i]), r["count"]) for i, r in enumerate(names)
    ]
    people = spark.createDataFrame(rows, "annotator string, community int, reliability double, n_labels long")
    return result, people


def annotation_votes(validation: DataFrame, reviews: DataFrame) -> DataFrame:
    """``item``, ``annotator``, ``label``, ``weight`` of labeller runs and reviewers.

    Runs are told apart by temperature; of an item whose details are lost, the vote counts are
    votes of one unnamed run. An item delivered twice counts once. Of a reviewer's opinions on an
    item the latest stands (then the one of highest ``review_id``). Every item of ``validation``
    appears, if need be with a null label.
    """
    from siltwork.functions.text import canonical_domain

    runs = validation.select("id", F.explode("all_predictions").alias("p")).where("p.temperature IS NOT NULL OR p.run IS NOT NULL OR p.domain IS NOT NULL")
    runs = runs.select(
        F.col("id").alias("item"),
        F.concat(F.lit("run:"), F.coalesce("p.temperature", F.concat(F.lit("#"), F.col("p.run").cast("string")), F.lit("?"))).alias("annotator"),
        canonical_domain(F.col("p.domain")).alias("label"), F.lit(1.0).alias("weight"),
    ).groupBy("item", "annotator").agg(F.min("label").alias("label"), F.min("weight").alias("weight"))
    has_details = F.size(F.coalesce("all_predictions", F.array())) > 0
    bare = validation.groupBy("id").agg(F.max(has_details).alias("known"), F.max_by(F.map_entries("consensus_votes"), F.size("consensus_votes")).alias("v"))
    counts = bare.where("NOT known").select("id", F.explode("v").alias("e")).select(
        F.col("id").alias("item"), F.lit("run:?").alias("annotator"), canonical_domain(F.col("e.key")).alias("label"),
        F.col("e.value").cast("double").alias("weight"),
    ).where("weight > 0")
    opinions = reviews.where(F.lower("status").isin("approved", "corrected")).select(
        F.col("id").alias("item"), F.concat(F.lit("reviewer:"), F.coalesce("reviewer_id", F.lit("?"))).alias("annotator"),
        F.when(F.lower("status") == "corrected", canonical_domain(F.col("corrected_domain"))).otherwise(canonical_domain(F.col("predicted_domain"))).alias("label"),
        F.struct("review_timestamp", "review_id").alias("at"),
    )
    opinions = opinions.groupBy("item", "annotator").agg(F.max_by("label", "at").alias("label")).withColumn("weight", F.lit(1.0))
    every = validation.select(F.col("id").alias("item"), F.lit(None).cast("string").alias("annotator"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight")).distinct()
    return runs.unionByName(counts).unionByName(opinions).unionByName(every)

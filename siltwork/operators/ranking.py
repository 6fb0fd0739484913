"""Exact positions within groups of any size, without a task that holds a group.

A window over a group sorts it in one task, which a group with a third of all rows makes the
slowest of all. Here one global range sort spreads every group, and prefix sums over the
partitions give exact positions. For the first few rows of a group a window is better: Spark
cuts it to those few before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.session import checkpointed


def _run_starts(keys: pa.Array) -> np.ndarray:
    """Row numbers at which a sorted key (never null) differs from the row before; 0 first."""
    if len(keys) == 0:
        return np.zeros(0, np.int64)
    change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def partition_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its first and last group, the rows of the last, all rows."""
    first = last = pid = None
    n_last = n = 0
    for b in batches:
        keys = b.column(1)
        if not len(keys):
            continue
        pid = b.column(0)[0].as_py()
        starts = _run_starts(keys)
        end = keys[len(keys) - 1].as_py()
        first = keys[0].as_py() if first is None else first
        tail = len(keys) - int(starts[-1])
        n_last = n_last + tail if len(starts) == 1 and end == last else tail
        last = end
        n += len(keys)
    if pid is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid], pa.int32()), pa.array([first]), pa.array([last]), pa.array([n_last], pa.int64()), pa.array([n], pa.int64())],
            names=["pid", "first", "last", "n_last", "n"],
        )


def carried(edges: list[tuple]) -> dict[int, int]:
    """For each partition: rows that its first group has in the partitions before it."""
    out, open_key, open_rows = {}, None, 0
    for pid, first, last, n_last, n in sorted(edges):
        out[pid] = open_rows if first == open_key else 0
        open_rows = n_last + (out[pid] if first == last and n_last == n else 0)
        open_key = last
    return out


def ranked_within(df: DataFrame, group: Column, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """``df`` with the position (from 1) of each row within its group, by ``order``.

    A null group is a group of its own. Rows equal in ``order`` get positions in arbitrary order,
    so end it with a unique column. A column already called ``rank_col`` is replaced; an empty
    table gives an empty table.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != rank_col]
    key = F.concat(F.when(group.isNull(), F.lit("0")).otherwise("1"), F.coalesce(group.cast("string"), F.lit("")))
    order = [F.col("__sw_key"), *order]
    keyed = df.select(key.alias("__sw_key"), "*") if rank_col not in df.columns else df.withColumn("__sw_key", key)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("__sw_key", *keep)
    # Both passes below must see the same partitions in the same order, also after the loss of
    # an executor; range bounds are sampled anew on each run, so the order is written down.
    ordered = checkpointed(ordered.withColumn("__sw_pid", F.spark_partition_id()))
    edges = ordered.select("__sw_pid", "__sw_key").mapInArrow(partition_edges, "pid int, first string, last string, n_last long, n long")
    carry = carried([tuple(r) for r in edges.collect()])  # one row for each partition
    schema = ordered.drop("__sw_key", "__sw_pid").schema.add(rank_col, "long", False)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, 0
        for b in batches:
            keys = b.column("__sw_key")
            if not len(keys):
                continue
            starts = _run_starts(keys)
            lengths = np.diff(np.append(starts, len(keys)))
            within = np.arange(len(keys)) - np.repeat(starts, lengths) + 1
            if key is None:
                within[: lengths[0]] += carry[b.column("__sw_pid")[0].as_py()]
            elif keys[0].as_py() == key:
                within[: lengths[0]] += seen
            key, seen = keys[len(keys) - 1].as_py(), int(within[-1])
            names = [n for n in b.schema.names if n not in ("__sw_key", "__sw_pid")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(within)], names=[*names, rank_col])

    return ordered.mapInArrow(rank, schema)

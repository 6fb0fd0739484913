"""Capping the rows of a dominant contributor, keeping those of best quality.

One global range sort by (contributor, descending score, id) spreads a contributor that holds a
third of all rows over many partitions. The position of a row within its contributor is then its
index in its partition, less the place where the contributor begins there, plus the rows the
contributor has in earlier partitions. The last number is needed only for the first contributor
of a partition, so what the driver sees is one small row for each partition, whatever the data.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.operators.ranking import ranked_within


def valid_score(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The score if it is a number within the range, else null (which ranks last)."""
    return F.when(~F.isnan(score) & score.between(low, high), score)


def cap_contributors(
    df: DataFrame,
    *,
    contributor: Column,
    score: Column,
    tie: str,
    max_share: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """The rows that stay if no contributor has more than its cap.

    The cap is ``max_rows`` or ``floor(max_share * number of all rows)`` (a decimal written as a
    string, so that the product is exact), the smaller if both are given. Kept are the rows of
    highest ``score``, then of smallest ``tie``; a null score ranks last (see ``valid_score``).

    Cases: null contributors count as one contributor; repeated rows each count; equal rows
    beyond the cap leave in arbitrary choice among equals; a cap of 0 and an empty table give an
    empty table; other columns pass through.
    """
    if max_share is None and max_rows is None:
        raise ValueError("give max_share or max_rows")
    caps = [] if max_rows is None else [int(max_rows)]
    if max_share is not None:
        caps.append(int(Decimal(max_share) * df.count()))
    order = [score.desc_nulls_last(), F.col(f"`{tie}`").asc_nulls_last()]
    ranked = ranked_within(df, contributor, order, "__sw_rank")
    return ranked.where(F.col("__sw_rank") <= min(caps)).drop("__sw_rank")

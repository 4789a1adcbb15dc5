"""Running sums and lags over groups of any size: range partitions, and what is carried between them.

Rows are range-partitioned by group and order, so a hot group spans many partitions.  One row for each
group and partition (its sum, its last row) is carried forward by a small window; inside a partition a
plain window does the rest.  No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.operators.aggregate import _null_safe
from panelcast.sources.tables import materialise


def _ranged(df: DataFrame, keys: list[str], by: list[str], parts: int | None) -> DataFrame:
    order = [*keys, *by]
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    # the partition number has to be the same in all uses: fix it on disk
    return materialise(ranged.withColumn("_part", F.spark_partition_id()))


def _carried(keys: list[str]):
    """One row for each group and partition; without keys all partitions are one group."""
    return Window.partitionBy(*(keys or [F.pmod("_part", F.lit(1))])).orderBy("_part")


def running_sums(
    df: DataFrame, keys: Sequence[str], by: Sequence[str], columns: Sequence[str], parts: int | None = None
) -> DataFrame:
    """*df* with ``{column}_upto`` (sum up to and with the row) and ``{column}_all`` (sum of the group).

    Order within a group is by *by*, which should be unique in it.  *parts* sets the number of range
    partitions (default: the session's shuffle partitions).
    """
    keys, by = list(keys), list(by)
    ranged = _ranged(df, keys, by, parts)
    sums = ranged.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in columns])
    before = _carried(keys).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.pmod("_part", F.lit(1))]))
    sums = sums.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{c}") for c in columns],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in columns],
    )
    here = Window.partitionBy(*keys, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    joined = _null_safe(ranged, sums, [*keys, "_part"], "inner")
    upto = {f"{c}_upto": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(here), F.lit(0)) for c in columns}
    return joined.withColumns(upto).drop("_part", *[f"_b_{c}" for c in columns])


def previous(df: DataFrame, keys: Sequence[str], by: Sequence[str], column: str, name: str, parts: int | None = None) -> DataFrame:
    """*df* with *name*, the *column* of the row before in its group (null on the first row)."""
    keys, by = list(keys), list(by)
    ranged = _ranged(df, keys, by, parts)
    last = F.max_by(F.struct(F.col(column).alias("v")), F.struct(*by))
    ends = ranged.groupBy(*keys, "_part").agg(last.alias("_last"))
    ends = ends.select(*keys, "_part", F.lag("_last").over(_carried(keys)).alias("_carry"))
    here = Window.partitionBy(*keys, "_part").orderBy(*by)
    joined = _null_safe(ranged, ends, [*keys, "_part"], "inner")
    own = F.lag(F.struct(F.col(column).alias("v"))).over(here)
    return joined.withColumn(name, F.coalesce(own, F.col("_carry"))["v"]).drop("_part", "_carry")

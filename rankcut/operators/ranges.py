"""Running sums over values that one task need not hold: rows are dealt by ranges of the value, summed within each range,
and what lies in earlier ranges is added. Equal values lie in one range; sum them up first where one may be very frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankcut.sources.checkpoints import stored


def running(df: DataFrame, value: str, sums: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """df with c_upto (sum of c over the rows of the same keys up to this value) and c_all (over all of them) for each of
    the columns `sums`. The ranges are stored, so that they are the same wherever they are used; their sums are a row for
    each range and key."""
    ranged = stored(df.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    part, by = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys)
    parts = ranged.groupBy(*keys, "_range").agg(*(F.sum(c).alias(c) for c in sums))
    before = lambda c: F.coalesce(F.sum(c).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_part"), *(before(c).alias(f"_{c}_before") for c in sums), *(F.sum(c).over(by).alias(f"{c}_all") for c in sums))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in sums})
    same: Column = F.col("_range") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = rows.join(parts, same).withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_{c}_before") for c in sums})
    return out.select(*df.columns, *(f"{c}_{x}" for c in sums for x in ("upto", "all")))

"""Dense numbers 0, 1, 2, ... in a total order, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.store import written

_BITS = 33  # of monotonically_increasing_id: the row's number in its partition


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `name`, each row's place in the order; ties must be broken by the order itself.

    A range partitioning sorts; the written table keeps partition and place, and the partitions' sizes, a row for each,
    give the offsets.
    """
    keyed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = written(keyed, "numbered").withColumn("_part", F.shiftright("_at", _BITS))
    sizes = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    first, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, first))
        first += n
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _first long")
    place = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return kept.join(F.broadcast(table), "_part").withColumn(name, place).drop("_part", "_at", "_first")

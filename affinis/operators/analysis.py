"""Questions to a finished matrix: pairs (i, j, ncd), objects (object_idx, object_id, label, size_bytes, ...), membership, and
groups (object_idx, group) known from elsewhere. All are DataFrame plans; `value` names the distance column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def both_ways(pairs: DataFrame, value: str = "ncd") -> DataFrame:
    """i, j, distance with each pair in both orders."""
    return pairs.select("i", "j", value).union(pairs.select("j", "i", value))


def group_sizes(objects: DataFrame, groups: DataFrame) -> DataFrame:
    return objects.join(groups, "object_idx").groupBy("group").agg(F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes"))


def listing(membership: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with their groups, by cluster, group, label."""
    return membership.join(groups, "object_idx").select("cluster", "group", "label", "object_id").orderBy("cluster", "group", "label", "object_id")


def crosstab(membership: DataFrame, groups: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row for each cluster, a column for each group; the names, if given, spare a pass."""
    return membership.join(groups, "object_idx").groupBy("cluster").pivot("group", names).count().na.fill(0)


def shares(membership: DataFrame, groups: DataFrame) -> DataFrame:
    """cluster, group, n, share of the cluster."""
    counts = membership.join(groups, "object_idx").groupBy("cluster", "group").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("cluster")))


def closest(pairs: DataFrame, n: int = 15, value: str = "ncd") -> DataFrame:
    """The n smallest distances, ties by i, j."""
    return pairs.select("i", "j", value).orderBy(value, "i", "j").limit(n)


def group_means(pairs: DataFrame, groups: DataFrame, value: str = "ncd") -> DataFrame:
    """group_a, group_b, mean distance and pairs by unordered pair of groups."""
    a = groups.select(F.col("object_idx").alias("i"), F.col("group").alias("ga"))
    b = groups.select(F.col("object_idx").alias("j"), F.col("group").alias("gb"))
    named = pairs.join(a, "i").join(b, "j")
    return named.groupBy(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b")).agg(F.avg(value).alias("mean"), F.count("*").alias("pairs"))


def _kinds(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    a = groups.select(F.col("object_idx").alias("i"), F.col("group").alias("ga"))
    b = groups.select(F.col("object_idx").alias("j"), F.col("group").alias("gb"))
    return pairs.join(a, "i").join(b, "j").withColumn("kind", F.when(F.col("ga") == F.col("gb"), "within").otherwise("cross"))


def within_cross(pairs: DataFrame, groups: DataFrame, value: str = "ncd") -> DataFrame:
    """kind, pairs, median."""
    return _kinds(pairs, groups).groupBy("kind").agg(F.count("*").alias("pairs"), F.percentile(value, 0.5).alias("median"))


def histogram(pairs: DataFrame, groups: DataFrame, bins: int = 18, value: str = "ncd") -> DataFrame:
    """kind, bin (1 to bins, of equal width from the least to the greatest distance), n."""
    edge = pairs.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    rows = _kinds(pairs, groups).join(F.broadcast(edge))
    part = F.when(F.col("high") == F.col("low"), 1).otherwise(F.least(F.lit(bins), 1 + F.floor((F.col(value) - F.col("low")) * bins / (F.col("high") - F.col("low")))))
    return rows.groupBy("kind", part.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def nearest(pairs: DataFrame, value: str = "ncd") -> DataFrame:
    """i, j, distance: each object's nearest other, the first one of ties; a partial aggregate, no sort of a row of the matrix."""
    best = both_ways(pairs, value).groupBy("i").agg(F.min(F.struct(F.col(value).alias("d"), F.col("j"))).alias("b"))
    return best.select("i", F.col("b.j").alias("j"), F.col("b.d").alias(value))


def object_means(pairs: DataFrame, value: str = "ncd") -> DataFrame:
    return both_ways(pairs, value).groupBy(F.col("i").alias("object_idx")).agg(F.avg(value).alias("mean"))


def size_correlation(pairs: DataFrame, objects: DataFrame, value: str = "ncd") -> DataFrame:
    """One row: Pearson's r of an object's mean distance and the logarithm of its size."""
    return object_means(pairs, value).join(objects.select("object_idx", "size_bytes"), "object_idx").agg(F.corr(F.log10("size_bytes"), "mean").alias("r"))


def ordered_map(pairs: DataFrame, membership: DataFrame, value: str = "ncd") -> DataFrame:
    """row, column, distance with objects ordered by cluster and label: the cells of a distance map."""
    place = membership.select("object_idx", (F.row_number().over(W.orderBy("cluster", "label", "object_id")) - 1).alias("at"))  # a row for each object
    a = place.select(F.col("object_idx").alias("i"), F.col("at").alias("row"))
    b = place.select(F.col("object_idx").alias("j"), F.col("at").alias("column"))
    return both_ways(pairs, value).join(a, "i").join(b, "j").select("row", "column", value)

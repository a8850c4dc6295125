"""Sales clusters of dishes and their names."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tavola.functions.predicates import only
from tavola.session import cut

# Number of clusters, seed, names, rows labelled per cluster, name length.
CLUSTERS = 3
SEED = 42
HIT, WEAK, AVERAGE = "ХИТЫ", "СЛАБЫЕ", "СРЕДНИЕ"
LABELLED = 3
NAME_LENGTH = 15


def cluster(df: DataFrame, columns: list[str], k: int = CLUSTERS, seed: int = SEED) -> DataFrame:
    """Add `cluster`, 0 to k - 1 by ascending centre, over standardised columns.

    With fewer rows than clusters the result is empty.
    """
    # The count, the scaler, the clusters and the output all read it.
    typed = cut(df.withColumns({f"_x_{c}": F.col(c).cast("double") for c in columns}))
    if typed.limit(k).count() < k:
        return df.withColumn("cluster", F.lit(None).cast("int")).where(F.lit(False))
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_raw"),
            StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled"),
            KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="_id"),
        ]
    )
    model = pipeline.fit(typed)
    centres = [tuple(x) for x in model.stages[-1].clusterCenters()]
    order = {old: new for new, old in enumerate(sorted(range(len(centres)), key=lambda i: centres[i]))}
    number = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("_id")]
    return model.transform(typed).withColumn("cluster", number).select(*df.columns, "cluster")


def cluster_names(df: DataFrame, revenue: str = "total_revenue", qty: str = "total_qty") -> DataFrame:
    """(cluster, avg_revenue, avg_qty, name): above both global means, below both, or between."""
    per = df.groupBy("cluster").agg(
        F.sum(revenue).alias("r"), F.sum(qty).alias("q"), F.count(F.lit(1)).alias("n")
    )

    def mean(value: str) -> Column:
        return F.col(value).cast("double") / F.col("n")

    def overall(value: str) -> Column:
        return only(per, F.sum(value).cast("double") / F.sum("n"))

    revenue_gap = mean("r") - overall("r")
    qty_gap = mean("q") - overall("q")
    name = (
        F.when((revenue_gap > 0) & (qty_gap > 0), HIT)
        .when((revenue_gap < 0) & (qty_gap < 0), WEAK)
        .otherwise(AVERAGE)
    )
    return per.select(
        "cluster", mean("r").alias("avg_revenue"), mean("q").alias("avg_qty"), name.alias("name")
    )


def top_of_cluster(df: DataFrame, n: int = LABELLED, revenue: str = "total_revenue") -> DataFrame:
    """The `n` rows of each cluster with most revenue, with a short name to label them."""
    order = W.partitionBy("cluster").orderBy(F.desc(revenue), F.asc("dish_id"))
    return (
        df.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn("short_name", F.substring("dish_name", 1, NAME_LENGTH))
    )


def one_hot(df: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """One 0/1 column `<column>_<value>` per value, in place of `column`.

    Without `values`, every value of the table gets a column; the result's columns, and so the values,
    are known to the driver.
    """
    if values is None:
        values = sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().collect())
    flags = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(flags).drop(column)

"""Connected components of a link table by alternating star contractions.

Every step is a join and an aggregate over links; nothing is gathered per node,
so a node with very many neighbours costs rows, not memory. Steps are written to
the shared folder and the table before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crossmer.operators.storage import materialize, new_path, remove


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its smallest neighbour or itself."""
    around = _both(links)
    least = around.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return (
        around.filter("b > a").join(least, "a")
        .select(F.col("least").alias("a"), "b").filter("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a")
    return (
        joined.select(F.col("least").alias("x"), F.col("b").alias("y"))
        .unionByName(joined.select(F.col("least").alias("x"), F.col("a").alias("y")))
        .filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links a, b; written to the shared folder."""
    spark: SparkSession = links.sparkSession
    path = new_path(spark, "links")
    current = materialize(links.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), path)
    print_ = _fingerprint(current)
    while print_[0]:
        following_path = new_path(spark, "links")
        following = materialize(_small_star(_large_star(current)), following_path)
        after = _fingerprint(following)
        remove(spark, path)
        current, path = following, following_path
        if after == print_:
            break
        print_ = after
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]

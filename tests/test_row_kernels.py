"""Per-row values that are computed for whole batches, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from crossmer import constants as C
from crossmer.functions import physchem as P, sequence as Q
from crossmer.operators import scoring


def pairs():
    random.seed(21)
    pick = lambda letters: "".join(random.choices(letters, k=random.randint(0, 40)))
    rows = [(pick(letters), pick(letters)) for letters in ("AC", "ACD", C.AMINO_ACIDS) for _ in range(40)]
    return rows + [("", ""), ("", "ACDEFGH"), ("ACDEFG", "ACDEFG"), ("AAAAAAAA", "AAAAAA"), ("KKKKKK", "KRKRKR")]


def test_overlap_of_pairs(spark):
    frame = spark.createDataFrame(pairs(), "a string, b string")
    found = frame.select("a", "b", Q.kmer_overlap("a", "b").alias("x"))
    for r in found.collect():
        x, y = brute.kmer_set(r["a"]), brute.kmer_set(r["b"])
        assert r["x"] == (len(x & y) / len(x | y) if x and y else 0.0)


def test_correlation_of_pairs(spark):
    frame = spark.createDataFrame(pairs(), "a string, b string")
    size = F.least(F.length("a"), F.length("b"))
    cut = lambda c: F.substring(F.col(c), F.lit(1), size)
    plain = lambda values: P.pearson(P.per_residue(cut("a"), values), P.per_residue(cut("b"), values))
    for r in frame.withColumn("r", P.residue_correlations("a", "b")).select(
            "r.*", plain(C.HYDROPATHY_X10).alias("h"), plain(C.CHARGE_X10).alias("c")).collect():
        assert (r["hydrophobicity"], r["charge"]) == pytest.approx((r["h"], r["c"]), abs=1e-12)


def test_isoelectric_points_of_a_batch(spark):
    """The point found is where the net charge changes its sign."""
    frame = spark.createDataFrame([(a,) for a, _ in pairs() if a], "s string").withColumn("pi", P.isoelectric_point("s"))
    assert "ArrowEvalPython" in frame._jdf.queryExecution().executedPlan().toString()
    for r in frame.select("pi", P.net_charge(F.col("s"), F.col("pi") - 1e-6).alias("lower"),
                          P.net_charge(F.col("s"), F.col("pi") + 1e-6).alias("upper")).collect():
        assert r["lower"] > 0 > r["upper"]


def test_alignment_batches_are_bounded():
    """What a task aligns at a time does not grow with its partition."""
    import pandas as pd
    batch = pd.Series(["ACDEFGHIKL" * 20] * 10_000)
    sizes = [(len(q), sum(map(len, q)) + sum(map(len, t))) for q, t in scoring.gathered(iter([(batch, batch)] * 7))]
    assert sum(n for n, _ in sizes) == 70_000
    assert max(n for n, _ in sizes) <= 20_000 and max(letters for _, letters in sizes) <= 1 << 23

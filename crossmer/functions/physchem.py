"""Physicochemical profiles, isoelectric point and the composite similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from crossmer import constants as C
from crossmer.functions.sequence import bind, letter_lookup, residues
from crossmer.functions.statistics import round_to
from crossmer.kernels import profiles as kernel


def per_residue(sequence: Column, values: dict[str, int]) -> Column:
    """Scale value of every residue, 0 for a non-standard one."""
    return F.transform(residues(F.upper(sequence)), letter_lookup(values))


def window_sums(values: Column, window: int = C.PROFILE_WINDOW) -> Column:
    """Sums over every full window; divide by ``10 * window`` for scale units."""
    def slide(v: Column) -> Column:
        count = F.size(v) - (window - 1)
        return F.when(count < 1, F.array().cast("array<int>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                lambda i: F.aggregate(F.slice(v, i, window), F.lit(0), lambda s, x: s + x),
            )
        )

    return bind(values, slide)


def hydrophobicity_profile(sequence: Column, window: int = C.PROFILE_WINDOW) -> Column:
    return window_sums(per_residue(sequence, C.HYDROPATHY_X10), window)


def charge_profile(sequence: Column, window: int = C.PROFILE_WINDOW) -> Column:
    return window_sums(per_residue(sequence, C.CHARGE_X10), window)


def binary_profile(sequence: Column) -> Column:
    return per_residue(sequence, dict.fromkeys(C.HYDROPHOBIC, 1))


def residue_count(sequence: Column, letter: str) -> Column:
    upper = F.upper(sequence)
    return F.length(upper) - F.length(F.replace(upper, F.lit(letter), F.lit("")))


def _charge(counts, ph: Column) -> Column:
    """Net charge at a pH from residue counts (Henderson-Hasselbalch)."""
    ten = F.lit(10.0)
    total = 1.0 / (1.0 + F.pow(ten, ph - C.PKA_N_TERMINUS))
    total = total - 1.0 / (1.0 + F.pow(ten, C.PKA_C_TERMINUS - ph))
    for letter, pka in C.PKA_POSITIVE.items():
        total = total + counts(letter) * (1.0 / (1.0 + F.pow(ten, ph - pka)))
    for letter, pka in C.PKA_NEGATIVE.items():
        total = total - counts(letter) * (1.0 / (1.0 + F.pow(ten, pka - ph)))
    return total


def net_charge(sequence: Column, ph) -> Column:
    ph = ph if isinstance(ph, Column) else F.lit(float(ph))
    return _charge(lambda letter: residue_count(sequence, letter), ph)


@F.pandas_udf(T.DoubleType())
def isoelectric_point(sequence: pd.Series) -> pd.Series:
    """pH of zero net charge by bisection, 7 for an empty sequence."""
    return pd.Series(kernel.isoelectric_points(sequence.tolist()))


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in ("hydrophobicity", "charge")]))
def residue_correlations(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Pearson correlations of the residue values of two sequences over their common length."""
    texts = left.tolist(), right.tolist()
    return pd.DataFrame({name: kernel.residue_correlations(*texts, values) for name, values in (
        ("hydrophobicity", C.HYDROPATHY_X10), ("charge", C.CHARGE_X10))})


residue_correlations = residue_correlations.asNondeterministic()  # evaluate once per pair


def pearson(left: Column, right: Column) -> Column:
    """Pearson correlation of two equal-length integer arrays, 0 if either is flat."""
    start = F.struct(*[F.lit(0).cast("bigint").alias(x) for x in ("n", "x", "y", "xx", "yy", "xy")])

    def add(s: Column, p: Column) -> Column:
        x, y = p["x"].cast("bigint"), p["y"].cast("bigint")
        return F.struct(
            (s["n"] + 1).alias("n"), (s["x"] + x).alias("x"), (s["y"] + y).alias("y"),
            (s["xx"] + x * x).alias("xx"), (s["yy"] + y * y).alias("yy"),
            (s["xy"] + x * y).alias("xy"),
        )

    def finish(s: Column) -> Column:
        vx = s["n"] * s["xx"] - s["x"] * s["x"]
        vy = s["n"] * s["yy"] - s["y"] * s["y"]
        cov = s["n"] * s["xy"] - s["x"] * s["y"]
        return F.when((s["n"] < 2) | (vx <= 0) | (vy <= 0), F.lit(0.0)).otherwise(
            cov / (F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double")))
        )

    zipped = F.zip_with(left, right, lambda a, b: F.struct(a.alias("x"), b.alias("y")))
    return F.aggregate(zipped, start, add, finish)


METRICS_TYPE = T.StructType([
    T.StructField(name, T.DoubleType())
    for name in ("hydrophobicity_corr", "charge_corr", "hydrophobicity_cross_corr",
                 "charge_cross_corr", "binary_hydro_cross_corr")
])


@F.pandas_udf(METRICS_TYPE)
def profile_metrics(
    batches: Iterator[tuple[pd.Series, pd.Series]]
) -> Iterator[pd.DataFrame]:
    """The five profile correlations of a pair of sequences."""
    for left, right in batches:
        yield pd.DataFrame(kernel.profile_metrics(left.tolist(), right.tolist()))


profile_metrics = profile_metrics.asNondeterministic()  # evaluate once per pair


@F.pandas_udf(T.DoubleType())
def max_cross_correlation(left: pd.Series, right: pd.Series) -> pd.Series:
    """Best correlation of two integer profiles over all offsets."""
    return pd.Series(kernel.max_cross_correlation(
        [x.astype(float) for x in left], [x.astype(float) for x in right]
    ))


max_cross_correlation = max_cross_correlation.asNondeterministic()  # evaluate once per pair


def composite_score(metrics: Column, pi_difference: Column) -> Column:
    w = C.COMPOSITE_WEIGHTS
    positive = lambda value: F.greatest(value, F.lit(0.0))
    return (
        w["binary"] * positive(metrics["binary_hydro_cross_corr"])
        + w["hydrophobicity"] * positive(metrics["hydrophobicity_cross_corr"])
        + w["charge"] * positive(metrics["charge_cross_corr"])
        + w["pi"] * positive(1.0 - pi_difference / C.PI_SPAN)
        + w["aligned"] * positive(
            (metrics["hydrophobicity_corr"] + metrics["charge_corr"]) / 2.0)
    )


def detection_source(sequence_hit: Column, composite: Column) -> Column:
    similar = composite >= C.COMPOSITE_HIT
    return (
        F.when(sequence_hit & similar, F.lit("both"))
        .when(similar, F.lit("physicochemical"))
        .otherwise(F.lit("sequence"))
    )


def annotate(pairs, query: str, target: str, query_pi: str, target_pi: str, sequence_hit: Column):
    """Add the seven rounded metrics and the detection source to a pair frame."""
    raw = pairs.withColumn("_m", profile_metrics(F.col(query), F.col(target)))
    raw = raw.withColumn("_dpi", F.abs(F.col(query_pi) - F.col(target_pi)))
    raw = raw.withColumn("_pc", composite_score(F.col("_m"), F.col("_dpi")))
    return raw.select(
        *pairs.columns,
        *[round_to(F.col("_m")[f], 4).alias(f) for f in ("hydrophobicity_corr", "charge_corr")],
        round_to(F.col("_dpi"), 3).alias("pi_diff"),
        *[round_to(F.col("_m")[f], 4).alias(f) for f in (
            "hydrophobicity_cross_corr", "charge_cross_corr", "binary_hydro_cross_corr")],
        round_to(F.col("_pc"), 4).alias("pc_composite_score"),
        detection_source(sequence_hit, F.col("_pc")).alias("detection_source"),
    )

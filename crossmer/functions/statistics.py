"""Karlin-Altschul statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from crossmer import constants as C


def karlin_altschul(
    gap_open: int = C.GAP_OPEN, gap_extend: int = C.GAP_EXTEND, matrix: str = "blosum62"
) -> tuple[float, float, float]:
    """(lambda, K, H) of a scoring system; ValueError when none is published."""
    if matrix.lower() != "blosum62":
        raise ValueError(
            f"no Karlin-Altschul parameters for matrix {matrix!r}; only blosum62 is supported"
        )
    found = C.KARLIN_ALTSCHUL.get((gap_open - gap_extend, gap_extend))
    if found is None:
        known = ", ".join(f"open={e + x},ext={x}" for e, x in sorted(C.KARLIN_ALTSCHUL))
        raise ValueError(
            f"no Karlin-Altschul parameters for gap_open={gap_open}, gap_extend={gap_extend}; "
            f"available: {known}"
        )
    return found


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def effective_length(length, k: float, h: float, other_length) -> Column:
    """Length less the expected length of a chance match, never below 1."""
    length, other_length = _col(length), _col(other_length)
    corrected = length - F.ln(F.lit(k) * length * other_length) / F.lit(h)
    usable = (length > 0) & (other_length > 0) & F.lit(h > 0)
    return F.greatest(
        F.when(usable, corrected.cast("bigint")).otherwise(length.cast("bigint")),
        F.lit(1).cast("bigint"),
    )


def bit_score(raw_score: Column, lam: float, k: float) -> Column:
    bits = (F.lit(lam) * raw_score - F.lit(math.log(k))) / F.lit(math.log(2))
    return F.when(raw_score > 0, bits).otherwise(F.lit(0.0))


def evalue(
    raw_score: Column, query_length, db_size, lam: float, k: float, h: float,
    batch: bool = False,
) -> Column:
    """Expected number of chance matches at least this good.

    For scores <= 0 the pairwise form reports the whole search space and the
    batch form (``batch=True``) the corrected one.
    """
    query_length, db_size = _col(query_length), _col(db_size)
    m_eff = effective_length(query_length, k, h, db_size)
    d_eff = effective_length(db_size, k, h, query_length)
    first, second = (m_eff, d_eff) if batch else (db_size, query_length)
    return F.when(
        raw_score > 0, F.lit(k) * m_eff * d_eff * F.exp(F.lit(-lam) * raw_score)
    ).otherwise(first.cast("double") * second.cast("double"))


def score_floor(
    query_length, db_size, max_evalue: float, lam: float, k: float, h: float
) -> Column:
    """A raw score below which no pair can reach ``max_evalue`` (one point of slack)."""
    query_length, db_size = _col(query_length), _col(db_size)
    space = (
        F.lit(k)
        * effective_length(query_length, k, h, db_size)
        * effective_length(db_size, k, h, query_length)
    )
    if max_evalue <= 0:
        return F.lit(float("inf"))
    return (F.ln(space) - F.lit(math.log(max_evalue))) / F.lit(lam) - 1.0


def significance(value: Column) -> Column:
    label = F.lit(C.SIGNIFICANCE_NONE)
    for bound, name in reversed(C.SIGNIFICANCE_TIERS):
        label = F.when(value < bound, F.lit(name)).otherwise(label)
    return label


def format_evalue_text(value: Column) -> Column:
    return (
        F.when(value == 0.0, F.lit("0.0"))
        .when(value < 1e-100, F.format_string("%.1e", value))
        .when(value < 0.001, F.format_string("%.2e", value))
        .when(value < 10, F.format_string("%.4f", value))
        .when(value < 1000, F.format_string("%.1f", value))
        .otherwise(F.format_string("%.1e", value))
    )


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding by ``floor``, identical in every IEEE engine."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)

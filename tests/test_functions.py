"""Scalar and array functions."""

import math

import pytest
from pyspark.sql import functions as F

from crossmer import constants as C
from crossmer.functions import physchem as P, sequence as Q, statistics as S


def test_matrix_is_symmetric_with_dominant_diagonal():
    scores = C.blosum62()
    assert len(scores) == 400
    assert all(scores[x + y] == scores[y + x] for x in C.MATRIX_ORDER for y in C.MATRIX_ORDER)
    assert min(scores[x + x] for x in C.MATRIX_ORDER) == 4
    assert max(scores[x + y] for x in C.MATRIX_ORDER for y in C.MATRIX_ORDER if x != y) == 3


@pytest.mark.parametrize("raw, cleaned", [
    ("  acD-E*FG 123 ", "ACDEFG"), ("", ""), ("xbz", ""), ("straße", "STRASSE")])
def test_clean(column, raw, cleaned):
    assert column(lambda a, b: Q.clean_sequence(a), raw) == cleaned


@pytest.mark.parametrize("seq, ok", [("ACDEFGHI", True), ("ACDEFGH", False), ("ACDEFGHX", False)])
def test_valid(column, seq, ok):
    assert column(lambda a, b: Q.is_valid_sequence(a), seq) is ok


def test_reduce(column):
    assert column(lambda a, b: Q.reduce_sequence(a), "ilvmAFWYSTDENQKRHCGPXz") == "hhhharrrssddnnbbicgp??"


@pytest.mark.parametrize("seq, k, found", [
    ("ACDEFG", 6, ["ACDEFG"]), ("ACDEF", 6, []), ("", 4, []), ("AAAAA", 4, ["AAAA", "AAAA"])])
def test_kmers(column, seq, k, found):
    assert column(lambda a, b: Q.kmers(a, k), seq) == found
    assert sorted(column(lambda a, b: Q.kmer_set(a, k), seq)) == sorted(set(found))


@pytest.mark.parametrize("a, b, value", [
    ("ABC", "ABC", 1.0), ("ABC", "DEF", 0.0), ("", "ABC", 0.0), ("ABCD", "CDEF", 2 / 6)])
def test_jaccard(column, a, b, value):
    assert column(lambda x, y: Q.jaccard(Q.residues(x), Q.residues(y)), a, b) == pytest.approx(value)


def test_encode(column):
    assert column(lambda a, b: Q.encode_residues(a), "ARvX") == [0, 1, 19, 20]


@pytest.mark.parametrize("pair, score", [("WW", 11), ("IL", 2), ("AX", -4), ("wk", -3)])
def test_blosum(column, pair, score):
    assert column(lambda a, b: Q.blosum_lookup()(F.substring(a, 1, 1), F.substring(a, 2, 1)), pair) == score


# --- statistics ----------------------------------------------------------------------

def test_parameters():
    assert S.karlin_altschul() == (0.253, 0.038, 0.130)
    assert S.karlin_altschul(12, 1) == (0.267, 0.041, 0.140)
    for wrong in ({"matrix": "blosum45"}, {"gap_open": 3}):
        with pytest.raises(ValueError):
            S.karlin_altschul(**wrong)


@pytest.mark.parametrize("length, other", [(100, 225_000), (140, 225_000), (1000, 10 ** 6), (0, 10), (50, 0)])
def test_effective_length(column, length, other):
    expected = max(length, 1) if min(length, other) <= 0 else max(
        int(length - math.log(0.038 * length * other) / 0.13), 1)
    assert column(lambda a, b: S.effective_length(F.lit(length), 0.038, 0.13, other)) == expected


@pytest.mark.parametrize("raw", [0, -3, 1, 60, 200])
def test_bits_and_evalue(column, raw):
    bits = column(lambda a, b: S.bit_score(F.lit(raw), 0.253, 0.038))
    assert bits == pytest.approx(0.0 if raw <= 0 else (0.253 * raw - math.log(0.038)) / math.log(2))
    from brute import evalue
    for batch in (False, True):
        got = column(lambda a, b: S.evalue(F.lit(raw), F.lit(90), 500_000, 0.253, 0.038, 0.13, batch))
        assert got == pytest.approx(evalue(raw, 90, 500_000, batch))


def test_worst_evalue_does_not_overflow(column):
    got = column(lambda a, b: S.evalue(F.lit(0), F.lit(20_000), 2_000_000_000, 0.253, 0.038, 0.13))
    assert got == 4e13


def test_score_floor_never_excludes_a_hit(column):
    from brute import evalue
    for m in (10, 60, 150, 2000):
        floor = column(lambda a, b: S.score_floor(F.lit(m), 300_000, 0.01, 0.253, 0.038, 0.13))
        first = next(s for s in range(1, 500) if evalue(s, m, 300_000) <= 0.01)
        assert first - 2 <= floor <= first


@pytest.mark.parametrize("value, label", [
    (1e-11, "very high"), (1e-10, "strong"), (1e-4, "moderate"), (0.1, "weak"), (1.0, "not significant")])
def test_significance(column, value, label):
    assert column(lambda a, b: S.significance(F.lit(value))) == label


@pytest.mark.parametrize("value, text", [
    (0.0, "0.0"), (1.234e-120, "1.2e-120"), (1.234e-5, "1.23e-05"), (0.01234, "0.0123"),
    (9.87654, "9.8765"), (123.456, "123.5"), (12345.6, "1.2e+04")])
def test_format(column, value, text):
    assert column(lambda a, b: S.format_evalue_text(F.lit(value))) == text


# --- physicochemistry --------------------------------------------------------------------

def test_profiles(column):
    assert column(lambda a, b: P.binary_profile(a), "AKID") == [1, 0, 1, 0]
    assert column(lambda a, b: P.hydrophobicity_profile(a), "AILVG") == [139]  # 2.78 * 50
    assert column(lambda a, b: P.charge_profile(a), "KRDEA") == [0]
    assert column(lambda a, b: P.charge_profile(a), "KRD") == []
    assert column(lambda a, b: P.window_sums(F.array(*map(F.lit, [1, 2, 3, 4, 5])), 3)) == [6, 9, 12]


@pytest.mark.parametrize("x, y, r", [
    ([1, 2, 3], [2, 4, 6], 1.0), ([1, 2, 3], [3, 2, 1], -1.0), ([1, 1, 1], [1, 2, 3], 0.0), ([1], [2], 0.0)])
def test_pearson(column, x, y, r):
    arrays = [F.array(*map(F.lit, v)) for v in (x, y)]
    assert column(lambda a, b: P.pearson(*arrays)) == pytest.approx(r)


@pytest.mark.parametrize("seq, low, high", [
    ("", 7.0, 7.0), ("EEEEDD", 0, 4.5), ("KKKKR", 10, 14), ("RRRR", 11, 14), ("AAVVLLIIMM", 3, 9)])
def test_isoelectric_point(column, seq, low, high):
    assert low <= column(lambda a, b: P.isoelectric_point(a), seq) <= high


def _similarity(spark, a, b):
    frame = spark.createDataFrame([(a, b)], "a string, b string").withColumns({
        "pa": P.isoelectric_point(F.col("a")), "pb": P.isoelectric_point(F.col("b"))})
    return P.annotate(frame, "a", "b", "pa", "pb", F.lit(True)).first()


def test_similarity_of_known_pairs(spark):
    same = _similarity(spark, C.AMINO_ACIDS, C.AMINO_ACIDS)
    assert same["pc_composite_score"] > 0.8 and same["pi_diff"] == 0
    assert same["detection_source"] == "both"
    assert _similarity(spark, "IIIIIVVVVLLLL", "KKKKEEEERRRR")["pc_composite_score"] < 0.7
    assert _similarity(spark, "IISSIISSTTIISSII", "LLTTLLTTSSLLTTLL")["hydrophobicity_cross_corr"] > 0.6
    assert _similarity(spark, "EEEEEEEE", "RRRRRRRR")["pi_diff"] > 6


def test_gaps_are_left_out(spark):
    gapped = _similarity(spark, "AC-DEFGHIKLMN", "ACWDEFGHIKLMN")
    assert gapped["hydrophobicity_corr"] == 1.0


def test_cross_correlation_kernel_against_direct_form():
    import numpy as np
    from crossmer.kernels.profiles import max_cross_correlation
    random = np.random.default_rng(3)
    left = [random.integers(-45, 46, n).astype(float) for n in random.integers(0, 90, 400)]
    right = [random.integers(-45, 46, n).astype(float) for n in random.integers(0, 90, 400)]

    def direct(a, b):
        if not len(a) or not len(b):
            return 0.0
        if len(b) > len(a):
            a, b = b, a
        best = -1.0
        for o in range(len(a) - len(b) + 1):
            x = a[o:o + len(b)]
            r = np.corrcoef(x, b)[0, 1] if len(b) > 1 and x.std() and b.std() else 0.0
            best = max(best, r)
        return best

    assert np.allclose(max_cross_correlation(left, right), [direct(a, b) for a, b in zip(left, right)])
    assert np.allclose(max_cross_correlation(left, right), max_cross_correlation(right, left))

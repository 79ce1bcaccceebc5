"""Alignment kernel, pair scoring and tag removal."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import brute
from crossmer import constants as C
from crossmer.kernels.align import align_pairs, encode, pair_ends
from crossmer.operators import scoring, tags

SEQ = st.text(alphabet=C.AMINO_ACIDS + "X", max_size=40)
LOW = st.text(alphabet="ACW", max_size=30)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(SEQ | LOW, SEQ | LOW), min_size=1, max_size=12))
def test_kernel_equals_recurrence(pairs):
    q, t = [p[0] for p in pairs], [p[1] for p in pairs]
    for gaps in ((10, 1), (3, 1), (11, 2)):
        found = align_pairs(q, t, *gaps)
        assert [*zip(found.score, found.target_end)] == [brute.sw(a, b, *gaps) for a, b in pairs]
        assert [*zip(found.score, found.query_end)] == [brute.sw(b, a, *gaps) for a, b in pairs]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(LOW, LOW), min_size=1, max_size=12))
def test_runs_and_their_ties(pairs):
    q, t = [p[0] for p in pairs], [p[1] for p in pairs]
    found = align_pairs(q, t, with_end=False, run_from=2)
    for n, (a, b) in enumerate(pairs):
        run = brute.longest_run(a, b)
        got = (found.run[n], found.run_query_end[n], found.run_target_end[n])
        assert got == run if run[0] >= 2 else got[0] == 0


def test_mixed_lengths_in_one_batch():
    random.seed(5)
    pick = lambda n: "".join(random.choices(C.AMINO_ACIDS, k=n))
    sizes = [random.choice((0, 3, 40, 41, 90, 400, 2600)) for _ in range(24)]
    q = [pick(n) for n in sizes]
    t = [(s[5:] + pick(7)) if len(s) < 500 else pick(60) for s in q]
    found = align_pairs(q, t)
    assert [*zip(found.score, found.target_end)] == [brute.sw(a, b) for a, b in zip(q, t)]
    assert (align_pairs(q, t, with_end=False).score == found.score).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(LOW, min_size=1, max_size=6), st.lists(SEQ | LOW, min_size=1, max_size=6), st.integers(0, 30))
def test_ends_of_pairs_that_reach_their_floor(left, right, floor):
    """Ties are settled only where they count; every pair of the two sets is scored."""
    x, y = (c.ravel() for c in np.mgrid[:len(left), :len(right)])
    score, l_end, r_end = pair_ends(encode(left), encode(right), x, y, np.full(len(x), floor), C.UNKNOWN_SCORE)
    for n, (a, b) in enumerate((left[i], right[j]) for i, j in zip(x, y)):
        forward, backward = brute.sw(a, b), brute.sw(b, a)
        assert score[n] == forward[0]
        assert score[n] < floor or (l_end[n], r_end[n]) == (backward[1], forward[1])


def test_long_scores_do_not_overflow():
    long = "W" * 4000
    assert align_pairs([long], [long]).score[0] == 44_000


def test_score_is_symmetric_and_bounded():
    random.seed(6)
    q = ["".join(random.choices(C.AMINO_ACIDS, k=50)) for _ in range(50)]
    t = [s[:20] + s[25:] for s in q]
    forward, backward = align_pairs(q, t).score, align_pairs(t, q).score
    assert (forward == backward).all()
    assert (forward <= np.minimum(align_pairs(q, q).score, align_pairs(t, t).score)).all()


def test_align_pair_columns(spark):
    frame = spark.createDataFrame([("ACDEFGHIKL", "WWACDEFGHIKLWW"), ("AAAA", "")], "q string, t string")
    first, empty = scoring.align_pair(frame, "q", "t", 1000).collect()
    score, end = brute.sw("ACDEFGHIKL", "WWACDEFGHIKLWW")
    assert (first["raw_score"], first["aligned_region_len"]) == (score, end)
    assert first["evalue"] == pytest.approx(brute.evalue(score, 10, 1000))
    assert (empty["raw_score"], empty["bit_score"], empty["evalue"]) == (0, 0.0, 4000.0)


def test_batch_align_filters_and_orders(spark):
    targets = spark.createDataFrame(
        [("far", 0, "K" * 30), ("near", 1, "ACDEFGHIKLMNPQRSTVWY"), ("same", 2, "WACDEFGHIKLMNPQRSTVWYW")],
        "id string, ordinal long, sequence string")
    rows = scoring.batch_align("ACDEFGHIKLMNPQRSTVWYW", targets, db_size=500).collect()
    assert [r["target_id"] for r in rows] == ["same", "near"]


TAG = "MHHHHHHGSSG"


@pytest.mark.parametrize("seq, stripped, found, method", [
    (TAG + C.AMINO_ACIDS, C.AMINO_ACIDS, True, "exact"),
    ((TAG + C.AMINO_ACIDS).lower(), C.AMINO_ACIDS, True, "exact"),
    (C.AMINO_ACIDS, C.AMINO_ACIDS, False, "none"),
    ("MHKK", "MHKK", False, "none"),  # scores 13, below the minimum of 20
    ("MHHH", "", True, "sw"),  # scores 29: short, but above the minimum
    ("LLLL" + TAG + "ACDEFGHI", "ACDEFGHI", True, "exact"),
    ("MHHHHHHGASG" + C.AMINO_ACIDS, C.AMINO_ACIDS, True, "sw")])
def test_strip_tag(spark, seq, stripped, found, method):
    row = tags.strip_tags(spark.createDataFrame([(seq,)], "s string"), "s", TAG).first()
    assert (row["stripped"], row["tag_found"], row["method_used"]) == (stripped, found, method)
    assert (row["score"] is None) == (method == "exact")


def test_strip_tag_exact_only(spark):
    row = tags.strip_tags(
        spark.createDataFrame([("MHHHHHHGASG" + C.AMINO_ACIDS,)], "s string"), "s", TAG, "exact").first()
    assert (row["tag_found"], row["method_used"], row["score"]) == (False, "none", None)

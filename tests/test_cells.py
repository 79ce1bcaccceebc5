"""Pair searches in cells: no pair row is shuffled, and long sequences are met in segments."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from crossmer import constants as C
from crossmer.functions import statistics as S
from crossmer.kernels import kmers
from crossmer.operators import nodes as N, seeds
from crossmer.plans import screen
from test_candidates import antigens, ids, relatives, unique


def test_pairs_are_not_shuffled(spark):
    """Ids and copies come with the pairs instead of by joins of pairs; common k-mers are no rows."""
    nodes = N.build_nodes(antigens(spark, relatives(3)))
    for search in (seeds.chain_pairs, seeds.jaccard_pairs, seeds.two_pass_pairs):
        found = search(nodes, carried=("id", "copies"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "hashpartitioning(a_node" not in plan and "kmer" not in plan
        named = {(r["a_id"], r["b_id"]) for r in found.collect()}
        assert named == {(a, b) for a, b in ids(N.both_directions(search(nodes)), nodes) if (a, b) in named}
        assert len(named) == search(nodes).count() > 10


@pytest.mark.parametrize("segment", [7, 20])
def test_long_sequences_meet_in_segments(spark, monkeypatch, segment):
    records = relatives(2)
    nodes = N.build_nodes(antigens(spark, records))
    flat = unique(records)
    monkeypatch.setattr(seeds, "SEGMENT", segment)
    others = [(a, b) for a in flat for b in flat if a[0] != b[0]]
    assert ids(seeds.diagonal_pairs(nodes), nodes) == {(a[0], b[0]) for a, b in others if brute.passes_diagonal(a[1], b[1])}
    pairs = seeds.chain_pairs(nodes)
    assert ids(N.both_directions(pairs), nodes) == {(a[0], b[0]) for a, b in others if brute.chain(a[1], b[1]) >= 3}
    assert pairs.count() == pairs.distinct().count()


def test_unknown_residues_make_no_chain(spark):
    records = [("A", "AC?DEFG"), ("B", "AC?DEFG" + "W"), ("C", "WWACDEFGH"), ("D", "KKACDEFGHII")]
    nodes = N.build_nodes(antigens(spark, records))
    assert ids(N.both_directions(seeds.chain_pairs(nodes)), nodes) == {("C", "D"), ("D", "C")}
    scored = ids(N.both_directions(seeds.two_pass_pairs(nodes), "jaccard"), nodes, "jaccard")
    assert scored == {("A", "B", 2 / 3), ("B", "A", 2 / 3), ("C", "D", 2 / 8), ("D", "C", 2 / 8)}


def test_runs_and_diagonals_join_no_postings(spark):
    """Runs are found where blocks meet: neither k-mers nor sequences are joined, and a pair is shuffled once."""
    nodes = N.build_nodes(antigens(spark, relatives(3)))
    for search in (lambda: seeds.contiguous_matches(nodes, carried=("id",)), lambda: seeds.diagonal_details(nodes),
                   lambda: seeds.diagonal_details(nodes, targets=nodes)):
        plan = search()._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "kmer" not in plan and plan.count("Exchange hashpartitioning(a_node") == 1


@pytest.mark.parametrize("search", [seeds.contiguous_matches, seeds.diagonal_details,
                                    lambda nodes: seeds.diagonal_details(nodes, targets=nodes)])
def test_joined_runs_are_those_of_cells(spark, monkeypatch, search):
    """Sets with sequences beyond a segment join the postings, with equal rows."""
    nodes = N.build_nodes(antigens(spark, relatives(3)))
    met = sorted(map(str, search(nodes).select(*sorted(search(nodes).columns)).collect()))
    monkeypatch.setattr(seeds, "SEGMENT", 10)
    assert sorted(map(str, search(nodes).select(*sorted(search(nodes).columns)).collect())) == met and len(met) > 50


@pytest.mark.parametrize("rows", [3, 1 << 20])
def test_runs_of_low_complexity(monkeypatch, rows):
    """All occurrences meet, a few rows at a time, and every diagonal keeps its longest and its first run."""
    random.seed(4)
    monkeypatch.setattr(kmers, "ROWS", rows)
    texts = ["".join(random.choices("AC?", (6, 3, 1), k=random.randint(0, 30))) for _ in range(12)] + ["A" * 20, "A" * 9]
    expected = set()
    for x, a in enumerate(texts):
        for y, b in enumerate(texts[:7]):
            for d in range(-len(b), len(a)):
                runs, size = [], 0
                for p in range(max(d, 0), min(len(a), len(b) + d) + 1):
                    same = p < min(len(a), len(b) + d) and a[p] == b[p - d] != "?"
                    if not same and size >= 3:
                        runs.append((p - size, size))
                    size = size + 1 if same else 0
                if runs:
                    start, size = max(runs, key=lambda r: (r[1], -r[0]))
                    expected.add((x, y, size, runs[0][0], runs[0][0] - d, start, start - d, 0))
    found = [row for part in kmers.diagonal_runs(texts, texts[:7], 3, False, "?") for row in zip(*map(list, part))]
    assert set(found) == expected and len(found) == len(expected) > 100


def test_passes_are_counted_in_cells(spark):
    """Passing copies are summed where blocks meet; no row per pair leaves a task."""
    records = relatives(2) + [(f"C{n}", relatives(2)[n % 4][1]) for n in range(9)]
    nodes = N.build_nodes(antigens(spark, records))
    counted = seeds.diagonal_pass_counts(nodes)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "a_node" not in plan and "b_node" not in plan
    copies = {r["id"]: r["copies"] for r in nodes.frame.collect()}
    expected = {}
    for q, t in ids(seeds.diagonal_pairs(nodes), nodes):
        expected[q] = expected.get(q, 0) + copies[t]
    named = nodes.frame.select("node", "id").join(counted, "node")
    assert {r["id"]: r["others"] for r in named.collect()} == expected and len(expected) > 20


def test_counts_of_long_sequences(spark, monkeypatch):
    nodes = N.build_nodes(antigens(spark, relatives(2)))
    met = sorted(map(tuple, seeds.diagonal_pass_counts(nodes).collect()))
    monkeypatch.setattr(seeds, "SEGMENT", 20)
    assert sorted(map(tuple, seeds.diagonal_pass_counts(nodes).collect())) == met


def test_only_hits_of_the_batch_screen_leave_the_cells(spark, monkeypatch):
    records = relatives(5) + [("L1", "acdefghiklmnpqrstvwy"), ("L2", "GGACDEFGHIKLXNPQRSTVWY"), ("L3", "XXXXXXXXACDEFGXXXXXX")]
    nodes = N.build_nodes(antigens(spark, records))
    lam, k, h = S.karlin_altschul()
    hits = seeds.reduced_hits(nodes, screen._floors(nodes, C.MAX_EVALUE, lam, k, h))
    passing = seeds.reduced_pairs(nodes)
    assert 10 < hits.count() < passing.count()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a_node" not in plan and "ArrowEvalPython" not in plan
    in_cells = sorted(map(tuple, screen.screen_batch(nodes).collect()))
    monkeypatch.setattr(seeds, "SEGMENT", 7)         # long sequences: pairs are joined with their ends and aligned
    assert in_cells == sorted(map(tuple, screen.screen_batch(nodes).collect())) and len(in_cells) > 10


def test_only_hits_of_the_quick_screen_leave_the_cells(spark, monkeypatch):
    records = relatives(5) + [("L1", "acdefghiklmnpqrstvwy"), ("L2", "GGACDEFGHIKLXNPQRSTVWY"), ("L3", "XXXXXXXXACDEFGXXXXXX")]
    records += [("M1", "GGGGGGGGAVSTILGGGGGGGG"), ("M2", "PPPPPPPPAVSTILPPPPPPPP")]      # a common 6-mer that scores too little
    nodes = N.build_nodes(antigens(spark, records))
    in_cells = sorted(map(str, screen.screen_kmer(nodes).collect()))
    lam, k, h = S.karlin_altschul()
    scored = nodes.frame.select("node", F.col("sequence").alias("text"), F.lit(1e4).alias("most")).join(
        screen._floors(nodes, C.MAX_EVALUE, lam, k, h), "node")
    hits = seeds.chain_hits(nodes, scored)
    assert 10 < hits.count() < seeds.chain_pairs(nodes).count()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a_node" not in plan and "ArrowEvalPython" not in plan
    monkeypatch.setattr(seeds, "SEGMENT", 7)         # long sequences: pairs are joined with their ends and aligned
    assert in_cells == sorted(map(str, screen.screen_kmer(nodes).collect())) and len(in_cells) > 20

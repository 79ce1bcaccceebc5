"""Query sets against stored sets, against brute force."""

import pytest

import brute
from crossmer.operators import nodes as N, seeds
from crossmer.operators.indexed import KmerIndex
from crossmer.plans import lookup
from test_candidates import antigens, relatives, unique


def details(frame):
    return {(r["query_id"], r["target_id"]): (r["chain_length"], r["diagonal"], r["chain_start_qpos"])
            for r in frame.collect()}


@pytest.mark.parametrize("limit", [None, 2])
def test_diagonals_of_two_sets(spark, limit):
    """Shared and different sequences, low complexity, hot seeds joined in cells."""
    stored, asked = relatives(2), relatives(2)[::3] + relatives(11)[:10] + [("E", ""), ("T", "ACD")]
    targets, queries = N.build_nodes(antigens(spark, stored)), N.build_nodes(antigens(spark, asked))
    expected, passing = {}, set()
    for qi, q in unique(asked):
        for ti, t in unique(stored):
            found = brute.diagonal(q, t)
            if found:
                expected[qi, ti] = found
            if brute.passes_diagonal(q, t):
                passing.add((qi, ti))
    found = seeds.diagonal_details(queries, limit=limit, targets=targets)
    assert details(found) == expected and len(expected) > 50
    assert {(r["query_id"], r["target_id"]) for r in found.filter("passed_chain OR rescued").collect()} == passing


def test_no_stored_sequences(spark):
    queries, none = N.build_nodes(antigens(spark, relatives(2)[:5])), N.build_nodes(antigens(spark, relatives(2)[:5]).limit(0))
    assert seeds.diagonal_details(queries, targets=none).count() == 0
    assert seeds.diagonal_details(none, targets=queries).count() == 0


def test_long_positions_order_alike(spark, monkeypatch):
    """Sequences too long for packed keys give the same runs, diagonals and passes."""
    nodes = N.build_nodes(antigens(spark, relatives(3)))
    searches = (seeds.diagonal_details, seeds.contiguous_matches, seeds.reduced_pairs)
    packed = [sorted(map(str, search(nodes).collect())) for search in searches]
    monkeypatch.setattr(seeds, "POSITION_BITS", 3)
    assert [sorted(map(str, search(nodes).collect())) for search in searches] == packed


def test_best_of_a_pair_is_hashed(spark):
    nodes = N.build_nodes(antigens(spark, relatives(3)))
    for search in (seeds.contiguous_matches, seeds.reduced_pairs):
        plan = search(nodes)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert plan.count("Exchange hashpartitioning(a_node") == 1


@pytest.mark.parametrize("top_n", [3, 25])
def test_live_search_of_a_set(spark, top_n):
    stored = relatives(4) + [(f"C{n}", relatives(4)[0][1]) for n in range(5)]      # more copies than top_n
    frame = antigens(spark, stored)
    nodes = N.build_nodes(frame)
    index = KmerIndex(spark, buckets=4).add(nodes.frame)
    asked = [(n, s) for n, (_, s) in enumerate(relatives(4)[::4] + [("E", ""), ("T", "ACD")])] + [(99, stored[0][1])]
    size, expected = sum(len(s) for _, s in stored), set()
    for n, q in asked:
        hits = []
        for place, (i, t) in enumerate(stored):
            if brute.kmer_set(q) & brute.kmer_set(t):
                score, end = brute.sw(q, t)
                e = brute.evalue(score, len(q), size)
                if e <= 0.01 and end >= 8:
                    hits.append((-score, place, i, end))
        expected |= {(n, rank, i, -s, end) for rank, (s, _, i, end) in enumerate(sorted(hits)[:top_n], 1)}
    found = lookup.live_queries(spark.createDataFrame(asked, "node long, sequence string"), index, nodes, frame, top_n=top_n)
    got = {(r["q_node"], r["rank"], r["target_id"], r["raw_score"], r["aligned_region_len"]) for r in found.collect()}
    assert got == expected and len(expected) > 20
    index.drop()

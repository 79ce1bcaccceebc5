"""Cells that settle their pairs: blocks are shuffled once, pairs are not, and counts need no pair rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossmer.kernels import kmers
from crossmer.operators import cells, nodes as N, seeds
from crossmer.plans import quality
from test_candidates import antigens, relatives


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def rows_of(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


SEARCHES = {
    "kmer_chain_join": seeds.chain_pairs, "kmer_jaccard_join": seeds.jaccard_pairs, "two_pass_candidates": seeds.two_pass_pairs,
    "ra_candidates_documents": seeds.diagonal_pass_counts, "screen_vectorized": lambda n, limit: seeds.reduced_hits(
        n, n.frame.select("node", F.lit(40.0).alias("floor")), limit)}


@pytest.mark.parametrize("name", SEARCHES)
def test_blocks_are_not_repeated(spark, name):
    """A sequence is sent to its block once: no row per sequence and cell is made, and any number of blocks gives the same."""
    nodes = N.build_nodes(antigens(spark, relatives(3)))
    found = SEARCHES[name](nodes, limit=2)
    plan = plan_of(found)
    assert "CartesianProduct" in plan and "explode(transform" not in plan and "CoGroup" not in plan
    assert rows_of(found) == rows_of(SEARCHES[name](nodes, limit=1000)) and found.count() > 10


def test_pairs_leave_a_cell_in_pieces():
    random.seed(2)
    parts = [(np.arange(n), np.arange(n) * 2) for n in (0, 3, 25, 1, 7, 10, 2)]
    found = list(cells.pieces(iter(parts), 10))
    assert max(len(x) for x, _ in found) == 10 and min(len(x) for x, _ in found[:-1]) == 10
    for at in (0, 1):
        assert np.array_equal(np.concatenate([p[at] for p in found]), np.concatenate([p[at] for p in parts]))
    assert list(cells.pieces(iter([]), 10)) == []


UNGROUPED = {
    "contiguous_match": lambda n, **o: seeds.contiguous_matches(n, carried=("id",), **o),
    "ra_details": seeds.diagonal_details, "ra_rescue": lambda n, **o: seeds.reduced_pairs(n, carried=("id",), **o),
    "index_diagonals": lambda n, **o: seeds.diagonal_details(n, targets=n, **o)}


@pytest.mark.parametrize("name", UNGROUPED)
@pytest.mark.parametrize("limit", [None, 5])
def test_settled_pairs_are_not_shuffled(spark, name, limit):
    nodes = N.build_nodes(antigens(spark, relatives(3)))
    found = UNGROUPED[name](nodes, limit=limit, grouped=False)
    assert "hashpartitioning(a_node" not in plan_of(found)
    assert rows_of(found) == rows_of(UNGROUPED[name](nodes, limit=limit)) and found.count() > 50


def test_ra_candidates_are_not_shuffled(spark):
    nodes = N.build_nodes(antigens(spark, relatives(3)))
    found = seeds.diagonal_pairs(nodes, carried=("id",))
    assert "hashpartitioning(a_node" not in plan_of(found)
    assert rows_of(found) == rows_of(seeds.passing_ways(seeds.reduced_pairs(nodes, carried=("id",)), ("id",)))


def test_repeated_numbers_are_grouped(spark):
    """Sequences that share a number are one end of a pair, as before: several cells decide it."""
    frame = spark.createDataFrame([("A", 1, "ILVMILVMWYAC"), ("A", 1, "LIVMLIMVYWCD"), ("B", 2, "ILVMILVMWYKK"), ("C", 3, "GGGGPPPPGGGG")],
                                  "id string, ordinal long, sequence string")
    nodes = N.build_nodes(frame)
    assert not seeds._settled(nodes)
    assert rows_of(seeds.reduced_pairs(nodes, grouped=False)) == rows_of(seeds.reduced_pairs(nodes))
    assert seeds.reduced_pairs(nodes, grouped=False).count() == 1


def test_lists_with_a_common_entry():
    random.seed(3)
    lists = lambda n: [random.sample("ABCDEFGHIJKL", k=random.choice((0, 1, 1, 1, 2, 5))) for _ in range(n)]
    for left, right in ((lists(30), lists(20)), ([], lists(3)), ([[]], [[]])):
        common = kmers.common_owners(pa.array(left, pa.list_(pa.string())), pa.array(right, pa.list_(pa.string())))
        x, y = map(np.ravel, np.meshgrid(np.arange(len(left)), np.arange(len(right))))
        assert common(x, y).tolist() == [bool(set(left[i]) & set(right[j])) for i, j in zip(x, y)]


def families(spark):
    """Nodes and members: families of all sizes, copies in several families and in none."""
    random.seed(6)
    records = relatives(2) + [(f"C{n}", relatives(2)[n % 4][1]) for n in range(9)]
    nodes = N.build_nodes(antigens(spark, records))
    numbers = {r["sequence"]: r["node"] for r in nodes.frame.collect()}
    counted = {}
    for _, s in records:
        key = numbers[s], random.choice(["F1", "F1", "F2", "F3", "F4", None])
        counted[key] = counted.get(key, 0) + 1
    return nodes, spark.createDataFrame([(*k, n) for k, n in counted.items()], "id long, family string, n long")


@pytest.mark.parametrize("segment", [None, 20])
@pytest.mark.parametrize("limit", [None, 7])
def test_families_are_counted_in_cells(spark, monkeypatch, segment, limit):
    nodes, members = families(spark)
    listed = seeds.diagonal_pairs(nodes).toDF("query_id", "target_id")
    if segment:
        monkeypatch.setattr(seeds, "SEGMENT", segment)
    found = seeds.family_passes(nodes, members, limit)
    pairs = found.filter("a_node IS NOT NULL").toDF("query_id", "target_id", "weight")
    passing = found.filter("a_node IS NULL")
    if not segment:
        assert "hashpartitioning(a_node" not in plan_of(found) and 0 < pairs.count() < listed.count() / 4
    assert rows_of(quality.family_sensitivity(members, pairs)) == rows_of(quality.family_sensitivity(members, listed))
    assert rows_of(quality.filter_quality(members, pairs, passing)) == rows_of(quality.filter_quality(members, listed))


def test_passes_need_no_pairs(spark):
    nodes, members = families(spark)
    listed = seeds.diagonal_pairs(nodes).toDF("query_id", "target_id")
    counted = seeds.diagonal_pass_counts(nodes).withColumnRenamed("node", "id")
    passes = quality.with_own_copies(quality.id_copies(members), counted)
    assert rows_of(passes) == rows_of(quality.pass_counts(members, listed))
    assert rows_of(quality.passes_distribution(passes)) == rows_of(quality.pass_distribution(members, listed))
    assert rows_of(quality.passes_histogram(passes)) == rows_of(quality.pass_histogram(members, listed))


@pytest.mark.parametrize("limit", [None, 7])
def test_pairs_are_counted_in_cells(spark, limit):
    nodes, _ = families(spark)
    chains = seeds.chain_pairs(nodes, carried=("copies",)).agg(F.sum(F.col("a_copies") * F.col("b_copies"))).first()[0]
    weights = seeds.chain_weights(nodes, limit=limit)
    assert "a_node" not in plan_of(weights) and weights.agg(F.sum("pairs")).first()[0] == chains > 50
    expected = {}
    for a, b, i, j in seeds.jaccard_pairs(nodes, carried=("copies",)).select("a_node", "b_node", "a_copies", "b_copies").collect():
        expected[a], expected[b] = expected.get(a, 0) + j, expected.get(b, 0) + i
    counted = seeds.jaccard_counts(nodes, limit=limit)
    assert "a_node" not in plan_of(counted) and dict(map(tuple, counted.collect())) == expected and len(expected) > 20


def test_counts_of_long_chains(spark, monkeypatch):
    nodes, _ = families(spark)
    met = seeds.chain_weights(nodes).agg(F.sum("pairs")).first()
    monkeypatch.setattr(seeds, "SEGMENT", 20)
    assert seeds.chain_weights(nodes).agg(F.sum("pairs")).first() == met


@pytest.mark.parametrize("wide", [1 << 12, 1 << 40])
def test_marks_are_sorted_by_all_three(wide):
    """contiguous_match and ra_details: marks fit into one number or not, with the same order."""
    random.seed(5)
    marks = np.array([[random.choice((3, 7, wide)) + random.randrange(3) for _ in range(200)],
                      [random.randint(-9, 9) * (wide >> 20 or 1) for _ in range(200)], [random.randrange(30) for _ in range(200)]], dtype=np.int64)
    assert kmers._marks_sorted(marks).T.tolist() == sorted(marks.T.tolist())
    assert kmers._marks_sorted(marks[:, :0]).shape == (3, 0)

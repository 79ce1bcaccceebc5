import random

import pytest

from crossmer import constants as C
from crossmer.operators import grid
from crossmer.operators.indexed import KmerIndex


def sequences(seed, n):
    rng = random.Random(seed)
    pick = lambda k: "".join(rng.choices(C.AMINO_ACIDS, k=k))
    cores = [pick(k) for k in (6, 8, 14, 30)]
    return [(i, pick(rng.randint(0, 20)) + rng.choice(cores) + pick(rng.randint(0, 20))) for i in range(n)] + [(n, "ACD"), (n + 1, "")]


def kmers(s, k=6):
    return {s[i:i + k] for i in range(len(s) - k + 1)}


def brute(queries, targets, threshold):
    out = set()
    for q, a in queries:
        for t, b in targets:
            shared = kmers(a) & kmers(b)
            if shared:
                score = len(shared) / len(kmers(a) | kmers(b))
                out.add((q, t, round(score, 9) if score >= threshold else 0.0))
    return out


@pytest.mark.parametrize("cell", [grid.CELL_PAIRS, 40])
def test_batches_against_brute_force(spark, monkeypatch, cell):
    """A grown index finds what a rebuilt one does, and both what all pairs give, with and without hot k-mers."""
    monkeypatch.setattr("crossmer.operators.indexed.CELL_PAIRS", cell)
    targets, queries = sequences(1, 90), sequences(2, 30)
    frame = lambda rows: spark.createDataFrame(rows, "node long, sequence string")
    grown = KmerIndex(spark, buckets=4).add(frame(targets[:50])).add(frame(targets[50:]))
    whole = KmerIndex(spark, buckets=4).add(frame(targets))
    asked = frame(queries)
    expected = brute(queries, targets, 0.2)
    for index in (grown, whole):
        got = {(r["q_node"], r["t_node"], round(r["jaccard"], 9)) for r in index.two_pass(asked, 0.2).collect()}
        assert got == expected
        assert {(r["q_node"], r["t_node"]) for r in index.common_runs(asked).collect()} == {e[:2] for e in expected}
        assert {(r["q_node"], r["t_node"], round(r["jaccard"], 9)) for r in index.jaccard(asked, 0.2).collect()} == {
            e for e in expected if e[2] > 0}
    counts = {r["kmer"]: r["nodes"] for r in grown.frequencies().collect()}
    assert counts == {k: sum(k in kmers(t) for _, t in targets) for k in {k for _, t in targets for k in kmers(t)}}
    grown.drop()
    whole.drop()


def test_stored_side_is_not_shuffled(spark):
    rows = spark.createDataFrame(sequences(3, 40), "node long, sequence string")
    index = KmerIndex(spark, buckets=4).add(rows)
    plan = index.common_runs(rows)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    stored = join[join.index(f"{index.table}") - 600:join.index(f"{index.table}")]
    assert "Exchange" not in stored and "Bucketed: true" in join
    index.drop()


def test_postings_are_those_of_the_sets(spark, monkeypatch):
    """Also of texts beyond ASCII, empty and null ones, cut into slices."""
    from crossmer.functions.sequence import kmer_set
    from pyspark.sql import functions as F

    rows = sequences(5, 30) + [(90, "ÄCDEFGHÄCDEFG𝄞HI"), (91, None), (92, "AAAAAAAAAA"), (None, "ACDEFGH")]
    frame = spark.createDataFrame(rows, "node long, sequence string")
    index = KmerIndex(spark, buckets=4)
    plain = frame.select("node", kmer_set(F.col("sequence"), 6).alias("s")).select(F.explode("s").alias("kmer"), "node", F.size("s").alias("size")).filter("kmer IS NOT NULL")
    for letters in (1 << 20, 25):
        monkeypatch.setattr("crossmer.operators.indexed.LETTERS", letters)
        found = index.postings(frame)
        assert found.dtypes == plain.dtypes and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    index.drop()


@pytest.mark.parametrize("keys", [grid.BROADCAST_KEYS, 5])
def test_only_asked_postings_are_sorted(spark, monkeypatch, keys):
    monkeypatch.setattr("crossmer.operators.indexed.BROADCAST_KEYS", keys)
    targets, queries = sequences(6, 40), sequences(7, 10)
    frame = lambda rows: spark.createDataFrame(rows, "node long, sequence string")
    index = KmerIndex(spark, buckets=4).add(frame(targets))
    found = index.two_pass(frame(queries), 0.2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("LeftSemi" in plan) == (keys > 5)
    assert {(r["q_node"], r["t_node"], round(r["jaccard"], 9)) for r in found.collect()} == brute(queries, targets, 0.2)
    index.drop()

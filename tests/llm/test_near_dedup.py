import random
import re

import pytest
from pyspark.sql import functions as F

from crossmer.llm import near_dedup
from crossmer.llm.components import components
from tests.llm.texts import frame, near, odd, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, s) in enumerate(known):
        for j, t in known[:n]:
            if 100 * len(s & t) >= 75 * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def found(spark, rows):
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("seed,tile", [(1, 200_000), (2, 7)])
def test_groups_against_brute_force(spark, monkeypatch, seed, tile):
    """Copies, near copies around the threshold, chains, and a passage that most documents share."""
    monkeypatch.setattr(near_dedup, "TILE_PAIRS", tile)
    monkeypatch.setattr(near_dedup, "TILE_ROWS", max(5, tile // 100))
    rng, passage, texts = random.Random(seed), prose(99, 60), []
    for g in range(6):
        base = prose(seed * 100 + g, rng.choice([6, 12, 40, 90, 300]))
        words = len(base.split(" "))
        texts += [base] * 3 + [near(base, n, rng.randint(0, max(1, words // 18))) for n in range(12)]
    chain = prose(seed + 50, 120)
    for n in range(8):
        chain = near(chain, n, 2)
        texts.append(chain)
    texts += [prose(1000 + n, rng.randint(3, 120)) + " " + passage for n in range(40)]
    rng.shuffle(texts)
    rows = [(3 * n, t) for n, t in enumerate(texts)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("direct", [0, 30])
def test_large_leaders_are_listed_anew(spark, monkeypatch, direct):
    """Documents of one template without links, near copies of some of them, and pairs at the threshold."""
    monkeypatch.setattr(near_dedup, "DIRECT_PAIRS", direct)
    rng = random.Random(7)
    template, texts = prose(500, 240), []
    texts += [template + " " + prose(600 + n, 160) for n in range(60)]
    texts += [near(texts[n % 9], n, rng.randint(1, 22)) for n in range(30)]
    base = prose(800, 900)
    texts += [near(base, n, 20) for n in range(20)] + [base]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark, rows) == brute(rows)


def test_unlinked_template_documents_are_not_compared(spark, monkeypatch):
    """Sketches of K_FINE values list none of the documents that have 60 % of their words in common."""
    monkeypatch.setattr(near_dedup, "DIRECT_PAIRS", 100)
    compared, left_over = [], near_dedup._left_over

    def counted(members, own, sets):
        compared.append(members.select("leader", "pairs").distinct().agg({"pairs": "sum"}).first()[0] or 0)
        return left_over(members, own, sets)

    monkeypatch.setattr(near_dedup, "_left_over", counted)
    template = prose(500, 600)
    rows = [(n, template + " " + prose(600 + n, 400)) for n in range(60)]
    assert found(spark, rows) == brute(rows)
    assert sum(compared) <= 60 * 59 / 2 / 10


def test_one_of_each_group_stays(spark):
    documents = odd(spark)
    kept = near_dedup.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        ["None", "None", "1", "1", "2", "3", "4", "5", "5", "6", "8", "9"])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 160)] + [(500, 500)]
    names = list(range(600))
    rng.shuffle(names)
    links = [(names[a], names[b]) for a, b in links]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    chain, star = names[0:61], names[100:160]
    assert got == {n: min(chain) for n in chain} | {n: min(star) for n in star}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_are_told_apart_within_an_id(spark):
    first, second, third = prose(20, 80), prose(21, 80), prose(22, 80)
    rows = [
        (1, first), (1, first), (1, second), (2, near(first, 3, 1)), (3, third), (4, second), (None, third),
        (None, prose(23, 80)), (None, prose(23, 80)), (None, near(prose(23, 80), 4, 1)), (9, None), (9, None), (None, " "),
    ]
    kept = near_dedup.keep_one(frame(spark, rows)).select("doc_id", "text").collect()
    with_words = sorted(((r["doc_id"], r["text"]) for r in kept if (r["text"] or "").strip()), key=str)
    assert [(i, t) for i, t in with_words if i is not None] == sorted([(1, first), (1, second), (3, third)], key=str)
    assert sum(i is None for i, _ in with_words) == 1 and len(kept) == 4 + 3
    twice = frame(spark, [(n, prose(n, 60)) for n in range(20)] * 2)
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(twice).collect()) == list(range(20))


def test_chance_of_a_missed_link(spark):
    from math import comb

    tail = lambda t: sum(comb(64, x) * 0.75**x * 0.25 ** (64 - x) for x in range(t))
    sure = near_dedup.sure_of(64)
    assert tail(sure) < 1e-9 <= tail(sure + 1)
    assert near_dedup._needed(64) == sure and near_dedup._needed(8) == 6
    column = near_dedup._need(F.col("id"), near_dedup.K_FINE)
    got = {r["id"]: r["need"] for r in spark.range(513).select("id", column.alias("need")).collect()}
    assert got == {s: near_dedup._needed(s, near_dedup.K_FINE) if s else 1 for s in range(513)} | {0: got[0]}

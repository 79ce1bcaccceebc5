"""Candidate joins and screens against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from crossmer import constants as C
from crossmer.operators import nodes as N, ordering, seeds
from crossmer.plans import quality, screen

TWENTY, EIGHT, SIX = "WVTMDHYKFLQAGSRNEICP", "FWYTMKAD", "YTMKAD"
FLANKS = [letter * 31 for letter in "GPNQ"]


def antigens(spark, records):
    return spark.createDataFrame(
        [(i, n, s) for n, (i, s) in enumerate(records)], "id string, ordinal long, sequence string")


def relatives(seed, families=5, members=6, noise=12):
    """Families with substitutions and gaps, equal lengths, low complexity, copies."""
    random.seed(seed)
    pick = lambda n: "".join(random.choices(C.AMINO_ACIDS, k=n))
    out = []
    for f in range(families):
        base = pick(random.randint(20, 60))
        for m in range(members):
            s = "".join(c if random.random() > 0.12 else random.choice(C.AMINO_ACIDS) for c in base)
            if m % 3 == 2:
                at = random.randint(1, len(s) - 1)
                s = s[:at] + pick(random.randint(1, 4)) + s[at:]
            out.append(s)
    out += [pick(random.randint(8, 50)) for _ in range(noise)]
    out += ["A" * 30, "A" * 25, "AC" * 12, "ACAC" + "A" * 9, out[0], out[0], out[3], "ILVMILVMWY", "LIVMLIMVYW"]
    random.shuffle(out)
    return [(f"S{n:03d}", s) for n, s in enumerate(out)]


def ids(frame, node_set, *columns):
    named = N.attach(frame, node_set.frame, ["id"])
    return {(r["q_id"], r["t_id"], *[r[c] for c in columns]) for r in named.collect()}


def unique(records):
    seen = {}
    for i, s in records:
        seen.setdefault(s, i)
    return [(i, s) for s, i in seen.items()]


@pytest.mark.parametrize("limit", [None, 2])
def test_candidate_joins(spark, limit):
    records = relatives(1)
    nodes = N.build_nodes(antigens(spark, records))
    flat = unique(records)
    pairs = [(a, b) for a in flat for b in flat if a[0] != b[0]]

    chained = {(a[0], b[0]) for a, b in pairs if brute.chain(a[1], b[1]) >= 3}
    assert ids(N.both_directions(seeds.chain_pairs(nodes, limit=limit)), nodes) == chained

    def jaccard(a, b):
        x, y = brute.kmer_set(a), brute.kmer_set(b)
        return len(x & y) / len(x | y) if x and y else 0.0

    overlap = {(a[0], b[0]): jaccard(a[1], b[1]) for a, b in pairs}
    for threshold in (0.04, 0.3):
        got = ids(N.both_directions(seeds.jaccard_pairs(nodes, threshold=threshold, limit=limit), "jaccard"),
                  nodes, "jaccard")
        assert got == {(*p, v) for p, v in overlap.items() if v >= threshold}
    two = ids(N.both_directions(seeds.two_pass_pairs(nodes, limit=limit), "jaccard"), nodes, "jaccard")
    assert two == {(*p, overlap[p] if overlap[p] >= 0.04 else 0.0) for p in chained}


@pytest.mark.parametrize("limit", [None, 2])
def test_diagonal_filter(spark, limit):
    records = relatives(2)
    nodes = N.build_nodes(antigens(spark, records))
    flat = unique(records)
    expected, details = set(), {}
    for qi, q in flat:
        for ti, t in flat:
            if qi == ti:
                continue
            if brute.passes_diagonal(q, t):
                expected.add((qi, ti))
            found = brute.diagonal(q, t)
            if found:
                details[qi, ti] = found
    assert ids(seeds.diagonal_pairs(nodes, limit=limit), nodes) == expected
    rows = seeds.diagonal_details(nodes, limit=limit).collect()
    assert {(r["query_id"], r["target_id"]): (r["chain_length"], r["diagonal"], r["chain_start_qpos"])
            for r in rows} == details
    assert {(r["query_id"], r["target_id"]) for r in rows if r["passed_chain"] or r["rescued"]} == expected
    # the general form with other parameters stays a superset relation
    loose = ids(seeds.diagonal_pairs(nodes, min_chain=1), nodes)
    assert loose == set(details)


@pytest.mark.parametrize("limit", [None, 2])
def test_contiguous(spark, limit):
    records = relatives(3)
    nodes = N.build_nodes(antigens(spark, records))
    flat = unique(records)
    expected = {(qi, ti, *brute.longest_run(q, t)) for qi, q in flat for ti, t in flat
                if qi != ti and brute.longest_run(q, t)[0] >= 6}
    got = ids(seeds.contiguous_matches(nodes, limit=limit), nodes, "run", "run_query_end", "run_target_end")
    assert got == expected


def test_planted_pairs(spark):
    g, p, n, q = FLANKS
    records = [(f"{name}{side}", before + core + after) for name, core in (("L", TWENTY), ("S", EIGHT), ("M", SIX))
               for side, before, after in (("A", g, p), ("B", n, q))]
    records += [("XA", "MHWY" + "I" * 15 + "KFCT"), ("XB", "KFCT" + "V" * 19 + "MHWY")]     # two seeds, no chain
    nodes = N.build_nodes(antigens(spark, records))
    strong = ids(N.both_directions(seeds.jaccard_pairs(nodes)), nodes)
    both = ids(N.both_directions(seeds.two_pass_pairs(nodes, threshold=0.2), "jaccard"), nodes, "jaccard")
    assert ("LA", "LB") in strong
    assert ("SA", "SB", 0.0) in both and ("MA", "MB", 0.0) in both
    assert not any({"XA", "XB"} == {a, b} for a, b, _ in both)


def test_hot_kmer_is_joined_in_blocks(spark):
    random.seed(9)
    pick = lambda n: "".join(random.choices(C.AMINO_ACIDS, k=n))
    records = [(f"H{n}", pick(12) + "WCWCWCHM" + pick(12)) for n in range(90)]
    records += [(f"N{n}", pick(30)) for n in range(60)]
    nodes = N.build_nodes(antigens(spark, records))
    plain = ids(N.both_directions(seeds.chain_pairs(nodes)), nodes)
    assert ids(N.both_directions(seeds.chain_pairs(nodes, limit=10)), nodes) == plain
    assert len(plain) >= 90 * 89
    assert ids(seeds.diagonal_pairs(nodes, limit=10), nodes) == ids(seeds.diagonal_pairs(nodes), nodes)
    for limit in (10, 40):
        assert ids(N.both_directions(seeds.jaccard_pairs(nodes, limit=limit), "jaccard"), nodes, "jaccard") == \
            ids(N.both_directions(seeds.jaccard_pairs(nodes), "jaccard"), nodes, "jaccard")


def expanded(frame, records, spark, node_set, directed):
    full = N.expand_copies(frame.drop("query_id", "target_id"), antigens(spark, records),
                           node_set.frame, directed, block=2)
    return {(r["query_id"], r["target_id"]): r for r in full.collect()}


def test_kmer_screen(spark):
    records = relatives(4)
    nodes = N.build_nodes(antigens(spark, records))
    expected = brute.screen_kmer(records)
    got = expanded(screen.screen_kmer(nodes), records, spark, nodes, False)
    assert got.keys() == expected.keys() and len(expected) > 20
    for key, (score, end, e) in expected.items():
        row = got[key]
        assert (row["raw_score"], row["aligned_region_len"]) == (score, end)
        assert row["evalue"] == pytest.approx(e)
        assert (row["consec_match_len"], row["consec_query_start"]) == (0, -1)


@pytest.mark.parametrize("prefilter", [True, False])
def test_batch_screen(spark, prefilter):
    records = relatives(5)
    nodes = N.build_nodes(antigens(spark, records))
    expected = brute.screen_batch(records, prefilter=prefilter)
    got = expanded(screen.screen_batch(nodes, prefilter=prefilter), records, spark, nodes, True)
    assert got.keys() == expected.keys() and len(expected) > 20
    for key, (score, run, e) in expected.items():
        row = got[key]
        assert row["raw_score"] == score and row["evalue"] == pytest.approx(e)
        assert (row["consec_match_len"], row["consec_query_end"], row["consec_target_end"]) == run
        if run[0]:
            assert row["consec_query_start"] == run[1] - run[0] + 1


def test_batch_screen_contains_kmer_screen(spark):
    records = relatives(6)
    nodes = N.build_nodes(antigens(spark, records))
    pairs = lambda f: {frozenset((r["query_id"], r["target_id"])) for r in f.collect()}
    assert pairs(screen.screen_kmer(nodes)) <= pairs(screen.screen_batch(nodes))


def test_completed_queries_are_skipped(spark):
    records = unique(relatives(7))
    nodes = N.build_nodes(antigens(spark, records))
    full = {(r["query_id"], r["target_id"]) for r in screen.screen_batch(nodes).collect()}
    done = sorted(full)[0][0]
    frame = spark.createDataFrame([(done,)], "query_id string")
    rest = {(r["query_id"], r["target_id"]) for r in screen.screen_batch(nodes, completed=frame).collect()}
    assert rest == {p for p in full if p[0] != done}


def test_ignored_option_warns(spark):
    nodes = N.build_nodes(antigens(spark, relatives(8)[:4]))
    with pytest.warns(UserWarning, match="min_aligned_len"):
        screen.screen_batch(nodes, min_aligned_len=3)


def test_ranks_and_running_totals(spark):
    random.seed(10)
    rows = [(n * 700_001, random.randint(5, 9)) for n in range(60)]
    frame = spark.createDataFrame(rows, "ordinal long, length int")
    ranked = {r["ordinal"]: r["rank"] for r in ordering.screen_rank(frame).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert ranked == {o: n for n, (o, _) in enumerate(order)}
    sums = {r["ordinal"]: r["t"] for r in ordering.running_total(frame, "ordinal", F.col("length"), "t").collect()}
    total = 0
    for o, value in rows:
        total += value
        assert sums[o] == total


def test_filter_quality(spark):
    members = spark.createDataFrame(
        [("a1", "A"), ("a2", "A"), ("a3", "A"), ("b1", "B"), ("b2", "B"), ("x", None)], "id string, family string")
    pairs = spark.createDataFrame(
        [("a1", "a2"), ("a2", "a1"), ("b2", "b1"), ("a1", "x")], "query_id string, target_id string")
    row = quality.filter_quality(members, pairs).first()
    assert (row["total_pairs"], row["expected_pairs"], row["passing_pairs"]) == (15, 4, 3)
    assert (row["true_positives"], row["false_negatives"], row["background_passing"]) == (2, 2, 1)
    assert row["filter_rate"] == pytest.approx(10 / 11 * 100) and row["sensitivity"] == 50
    per = {r["family"]: (r["found"], r["expected"]) for r in quality.family_sensitivity(members, pairs).collect()}
    assert per == {"A": (1, 3), "B": (1, 1)}
    spread = quality.pass_distribution(members, pairs).first()
    assert (spread["queries"], spread["median"], spread["maximum"]) == (6, 1, 2)


def test_filter_quality_counts_copies(spark):
    """The same numbers as with every copy as an id of its own and all pairs listed."""
    random.seed(12)
    sequences = {f"S{n}": random.randint(1, 5) for n in range(12)}
    antigens_ = [(s, f"{s}-{c}", random.choice(["A", "B", "C", None])) for s, n in sequences.items() for c in range(n)]
    links = [(x, y) for x in sequences for y in sequences if x != y and random.random() < 0.3]
    counted = {}
    for s, _, family in antigens_:
        counted[s, family] = counted.get((s, family), 0) + 1
    classes = spark.createDataFrame([(s, f, n) for (s, f), n in counted.items()], "id string, family string, n long")
    pairs = spark.createDataFrame(links, "query_id string, target_id string")
    single = spark.createDataFrame([(i, f) for _, i, f in antigens_], "id string, family string")
    listed = spark.createDataFrame([(i, j) for s, i, _ in antigens_ for t, j, _ in antigens_ if i != j and (s == t or (s, t) in links)],
                                   "query_id string, target_id string")
    for function in (quality.filter_quality, quality.family_sensitivity, quality.pass_distribution, quality.pass_histogram):
        assert sorted(map(str, function(classes, pairs).collect())) == sorted(map(str, function(single, listed).collect()))

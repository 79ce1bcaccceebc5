import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from crossmer.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, owner string, depth string, place int, up string, top string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100       # towards zero
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in children[node])
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", 1, "z", "w") for r in rows], TURNS).repartition(3)
    return sorted(map(tuple, prefix_trie.prefix_trie(frame).collect()))


def conversations(seed, n=90, longest=9):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        c = c * 3 - 100 if c % 2 else c
        out += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "nö", "ä long answer", ""])) for t in range(rng.randint(1, longest))]
    return out


@pytest.mark.parametrize("seed,local", [(1, 20_000), (2, 1), (3, 12)])
def test_against_brute_force(spark, monkeypatch, seed, local):
    monkeypatch.setattr(prefix_trie, "LOCAL_NODES", local)
    rows = conversations(seed) + [(700, t, "user", f"turn {t}") for t in range(120)]       # a hot, deep conversation
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "nobody's"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, "user", "tie"), (0, 1, "user", "tie"),
            (100, 0, "user", "a" * 100_000), (101, 0, "user", "b"), (-5, 0, "user", "x"), (-100, 2, "", "\n:,"), (-101, 1, "a", "b:c")]
    rows += [(c, t, "user", "same") for c in range(200, 290) for t in range(3)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_decompose_sums_subtrees():
    rng = random.Random(5)
    for size in (1, 2, 3, 50, 400):
        for kind in ("path", "star", "random"):
            parents = [-1] + [{"path": i - 1, "star": 0, "random": rng.randrange(i)}[kind] for i in range(1, size)]
            values = [(rng.randrange(9), 1) for _ in parents]
            want = [list(v) for v in values]
            for i in range(size - 1, 0, -1):
                want[parents[i]] = [a + b for a, b in zip(want[parents[i]], want[i])]
            assert prefix_trie.decompose(parents, values) == want

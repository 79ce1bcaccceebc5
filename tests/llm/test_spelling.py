import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from crossmer.llm import spelling
from tests.llm.texts import frame, odd

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w) if len(w) < 1000 else 0):
            holes[k, w[:k], w[k + 1:]].add(w)
            if w[:k] + w[k + 1:] in n:
                near[w].add(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()), key=str)


def found(spark, rows, pairs=None):
    got = spelling.spelling_variants(frame(spark, rows), pairs).collect()
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got), key=str)


def variants(seed, n_words):
    rng = random.Random(seed)
    letters = "abcdeéàÀz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(n_words)]
    for w in list(words):
        for _ in range(3):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:],
                                     "".join(sorted(w))]))
    weights = [rng.choice([1, 1, 2, 30, 400]) for _ in words]
    return [(i, " ".join(rng.choices(words, weights, k=120))) for i in range(120)]


@pytest.mark.parametrize("seed,pairs", [(1, None), (2, 30)])
def test_against_brute_force(spark, seed, pairs):
    rows = variants(seed, 150)
    assert found(spark, rows, pairs) == brute(rows)


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    long_run = "acgt" * 20_000
    rows += [(20, long_run), (21, long_run + " ÷ÀÉÎÕÜÞß ÷ÀÉÎÕÜÞß"), (22, "x" * 30 + " " + "x" * 31), (23, "x" * 30 + "\n" + "x" * 31)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_chains_of_forms(spark):
    counts = {"abcdefgh": 2000, "abcdefgi": 200, "abcdefji": 20, "abcdekji": 2}
    rows = [(7, " ".join([w] * c)) for w, c in counts.items()]
    expected = brute(rows)
    assert {r[2] for r in expected} == {"abcdefgh"}
    assert found(spark, rows) == expected

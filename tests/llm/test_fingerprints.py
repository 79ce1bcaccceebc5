import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossmer.llm import fingerprints as fp
from tests.llm.texts import frame, near, odd, prose


def plain_counts(raw):
    counts = [0] * fp.BUCKETS
    for (a, b, c), (ta, tb, tc) in zip(fp.OFFSETS, fp._TABLES, strict=True):
        for i in range(len(raw) - c):
            counts[ta[raw[i + a]] ^ tb[raw[i + b]] ^ tc[raw[i + c]]] += 1
    return counts


def test_counts_against_plain_loops(monkeypatch):
    raw = prose(1, 200).encode()
    assert fp.bucket_counts(raw).tolist() == plain_counts(raw)
    monkeypatch.setattr(fp, "_PART", 17)
    assert fp.bucket_counts(raw).tolist() == plain_counts(raw)
    assert fp.bucket_counts(b"").sum() == 0


def test_likeness_is_bounded_and_orders_pairs():
    texts = [prose(n, 400) for n in range(30)]
    marks = [fp.digest(t.encode()) for t in texts]
    changed = [fp.digest(near(t, n, 20).encode()) for n, t in enumerate(texts)]
    same, close, other = fp.likeness(marks, marks), fp.likeness(marks, changed), fp.likeness(marks, marks[1:] + marks[:1])
    assert (same == 1).all() and ((close >= 0) & (close <= 1)).all() and (close > other + 0.2).all()
    assert np.array_equal(close, fp.likeness(changed, marks))
    assert len({fp.digest(t) for t in (b"", b"a", b"b", b"ab")}) == 4 and len(fp.likeness([], [])) == 0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (number, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        changed = (text[:len(text) - n] + after[:n]).encode()
        marks = [fp.digest(x) for x in (text.encode(), changed, after.encode())]
        out.append((number, len(text), hashlib.sha256(changed).hexdigest(), marks[0], marks[1],
                    float(fp.likeness(marks[:1], marks[1:2])[0]), float(fp.likeness(marks[:1], marks[2:])[0])))
    return sorted(map(str, out))


def test_neighbours_against_brute_force(spark):
    for documents in (odd(spark), frame(spark, [(9, "only one")]), frame(spark, [(n, prose(n, n % 50)) for n in range(300)])):
        rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
        assert sorted(str(tuple(r)) for r in fp.with_edited_and_next(documents).collect()) == brute(rows)
    assert fp.with_edited_and_next(frame(spark, [])).count() == 0
    assert fp.fingerprints(odd(spark)).count() == odd(spark).count()


def test_rows_of_a_hot_id_are_split(spark):
    """A third of all rows without id, and as many under one id, are dealt to several tasks."""
    start = prose(77, 30)      # some texts start alike beyond the range key
    rows = [(None, prose(n, 20)) for n in range(200)] + [(7, prose(n, 20)) for n in range(150)] + [
        (7, f"{start} {n % 25}") for n in range(50)] + [(n, prose(n, 20)) for n in range(100, 300)]
    documents = frame(spark, rows)
    assert sorted(str(tuple(r)) for r in fp.with_edited_and_next(documents).collect()) == brute(rows)
    seen, materialize = [], fp.materialize

    def kept(found):
        seen.append(materialize(found))
        return seen[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fp, "materialize", kept)
        fp.with_edited_and_next(documents)
    per_id = seen[0].filter("place = 'inside'").groupBy("part").agg(
        F.count_if(F.expr("doc_id IS NULL")).alias("none"), F.count_if(F.expr("doc_id = 7")).alias("hot")).collect()
    assert sum(r["none"] > 0 for r in per_id) > 1 and sum(r["hot"] > 0 for r in per_id) > 1

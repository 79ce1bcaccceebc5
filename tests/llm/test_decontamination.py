import random

import pytest

from crossmer.llm import decontamination as dc
from tests.llm.texts import frame, odd, prose


def table_distances(pattern, text, anchored):
    column, out = list(range(len(pattern) + 1)), []
    for j, letter in enumerate(text):
        before, column[0] = column[:], j + 1 if anchored else 0
        for i in range(1, len(pattern) + 1):
            column[i] = min(before[i] + 1, column[i - 1] + 1, before[i - 1] + (pattern[i - 1] != letter))
        out.append(column[-1])
    return out


def test_distances_against_the_table():
    rng = random.Random(1)
    for _ in range(200):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        for anchored in (False, True):
            got = list(dc.distances(dc._masks(pattern), len(pattern), text, anchored))
            assert got == table_distances(pattern, text, anchored)


def test_pieces_cover_an_item():
    for n in (1, 15, 16, 17, 100, 333):
        item = dc.Item(1, "x" * n)
        assert len(item.pieces) == item.budget + 1 == n // dc.CHARS_PER_ERROR + 1
        assert sum(len(p) for _, p in item.pieces) == n and all(p for _, p in item.pieces)


def edit(text, rng, edits):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        letters[at:at + 1] = rng.choice([[], [rng.choice("abcdef")], [letters[at], rng.choice("abcdef")]])
    return "".join(letters)


def brute(documents, items):
    """(doc_id, item_id) of every passage within the budget, by the full distance table."""
    found = set()
    for number, text in documents:
        for item, wanted in items:
            words, pattern = dc.normal(text or ""), dc.normal(wanted or "")
            budget = len(pattern) // dc.CHARS_PER_ERROR
            if pattern and budget and min(table_distances(pattern, words, False), default=9**9) <= budget:
                found.add((number, item))
            elif pattern and not budget and f" {pattern} " in f" {words} ":
                found.add((number, item))
    return found


@pytest.mark.parametrize("block_chars", [16 << 20, 300])
def test_edited_passages_against_brute_force(spark, block_chars):
    rng = random.Random(7)
    items = [(n, prose(n, rng.randint(3, 30))) for n in range(12)] + [(50, "one"), (51, "—!"), (52, None), (53, ""), (0, prose(70, 8))]
    documents = []
    for n in range(40):
        text = prose(500 + n, rng.randint(0, 60))
        for _ in range(rng.randrange(3)):
            _, wanted = rng.choice(items[:12])
            text += " " + edit(wanted, rng, rng.randint(0, len(wanted) // 12)) + " " + prose(900 + n, 5)
        documents.append((n, text if n % 2 else text.upper().replace(" ", "\n, ")))
    documents += [(100, None), (101, ""), (102, "the One!"), (103, "oneness"), (None, items[3][1])]
    rows = dc.contaminated(frame(spark, documents), spark.createDataFrame(
        [(*i, "clash") for i in items], "item_id long, text string, doc_id string"), block_chars).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(documents, items)
    texts = dict(documents)
    for r in rows:
        passage = dc.normal(texts[r["doc_id"]][r["begin"]:r["end"]])
        wanted = [dc.normal(t) for i, t in items if i == r["item_id"]]
        exact = min(table_distances(w, passage, True)[-1] for w in wanted)
        assert r["distance"] <= r["budget"] and abs(exact - r["distance"]) <= 1


def test_documents_with_passages_go(spark):
    documents = odd(spark)
    items = spark.createDataFrame([(1, "word"), (2, prose(9, 300)[100:400])], "item_id long, text string")
    kept = dc.without_passages(documents, items)
    assert kept.columns == documents.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "None", "1", "1", "2", "3", "5", "5", "6", "7", "8"])
    assert dc.contaminated(documents, items.limit(0)).count() == 0
    assert dc.contaminated(frame(spark, []), items).count() == 0


@pytest.mark.parametrize("block_chars", [16 << 20, 100])
def test_rows_are_decided_by_their_own_text(spark, block_chars):
    wanted = [prose(n, 20) for n in range(4)]
    rows = [(1, "before " + wanted[0] + " after"), (1, prose(50, 30)), (None, wanted[1]), (None, prose(51, 30)), (2, wanted[3])]
    items = spark.createDataFrame(list(enumerate(wanted)), "item_id long, text string")
    kept = dc.without_passages(frame(spark, rows), items, block_chars).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([rows[1], rows[3]], key=str)

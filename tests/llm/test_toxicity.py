import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossmer.llm import toxicity as tx
from tests.llm.texts import DOCUMENTS, frame, odd, prose, write

GRAMMAR = tx.Grammar({"scum": 4.0, "kill": 2.0}, {"idi": 3.0}, [-4.0, 2.0, 2.0, 0.0, -1.0])


def kinds(text):
    return [[k for k, _ in clause] for clause in GRAMMAR.clauses(text)]


def test_clauses_and_states():
    assert kinds("This is scum. Fine words! you idiot") == [[tx.PLAIN], [tx.TARGETED]]
    assert kinds("idiot, that you are") == [[tx.TARGETED]]
    assert kinds("not a scum") == [[tx.NEGATED]] and kinds("not that it was ever a scum") == [[tx.PLAIN]]
    assert kinds("he said scum; scum") == [[tx.REPORTED], [tx.PLAIN]]
    assert kinds('the "scum" and scum') == [[tx.REPORTED, tx.PLAIN]]
    assert kinds("never said idiots scum") == [[tx.NEGATED, tx.NEGATED]]
    assert kinds("scum scum scum idiot") == [[tx.PLAIN, tx.PLAIN]]
    assert kinds("") == kinds("nothing here") == [] and GRAMMAR.features(None) == [0.0] * tx.FEATURES


def plain_kinds(text):
    """The same machine, word by word without the composed table."""
    out, clause, n, reported, quoted, targeted = [], [], 0, False, False, False
    for token in [*tx.TOKEN.findall(text.lower()), "."]:
        symbol, weight = GRAMMAR._arc(token)
        if symbol == tx.STOP:
            if clause:
                out.append([tx.TARGETED if k == tx.PLAIN and targeted else k for k, _ in dict.fromkeys(clause)])
            clause, n, reported, targeted = [], 0, False, False
            continue
        if symbol == tx.QUOTE:
            quoted = not quoted
            continue
        if symbol == tx.MATCH:
            kind = tx.NEGATED if n else tx.REPORTED if reported or quoted else tx.TARGETED if targeted else tx.PLAIN
            clause.append((kind, weight))
        n = tx.NEGATION_REACH if symbol == tx.NEGATING else max(0, n - 1)
        reported, targeted = reported or symbol == tx.REPORT, targeted or symbol == tx.TARGETING
    return out


def test_composed_machine_against_plain_states():
    rng = np.random.default_rng(5)
    words = ["scum", "idiot", "kill", "not", "never", "said", "you", '"', ".", ";", "tree", "house", "water"]
    for _ in range(300):
        text = " ".join(rng.choice(words, rng.integers(0, 25)))
        assert kinds(text) == plain_kinds(text)


def test_scores_order_and_bounds():
    def score(text):
        return float(GRAMMAR.scores(np.array([GRAMMAR.features(text)]))[0])

    assert score("") == score("nice") < score("not scum at all") < score("scum") < score("you scum. you idiot. kill")
    assert 0 < score("scum " * 10_000) <= 1


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for n in range(400):
        toxic = n % 5 == 0
        text = prose(n, 60)
        if toxic:
            text = text.replace(" ", " zorkel ", 2).replace(". ", f" blimp{n % 7}ish . ", 1)
        rows.append((n, text, "en", "s", 0, "", "", "", ""))
        labels.append((n, 1, int(toxic), "clash"))
    labels += [(0, 1, None, ""), (None, 1, 1, ""), (5, 1, 0, ""), (9999, 1, 1, "")]
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(labelled):
    documents, labels = labelled
    grammar = tx.learn(documents, labels, ~tx.held_out("doc_id"))
    assert "zorkel" in grammar.words and any(b.startswith("bli") for b in grammar.beginnings)
    rows = tx.scored(documents, grammar).select("doc_id", "predicted", "score", tx.held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["h"]]
    assert len(held) > 50 and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)


def test_learning_ignores_held_out_rows(labelled, spark):
    documents, labels = labelled
    flipped = labels.withColumn("toxic", F.when(tx.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.learn(documents, l, ~tx.held_out("doc_id")) for l in (labels, flipped))
    assert (a.words, a.beginnings, a.coefficients.tolist()) == (b.words, b.beginnings, b.coefficients.tolist())
    assert tx.labelled_sample(labels, F.lit(True), 7).count() == 7


def test_odd_documents_and_no_labels(spark, tmp_path, labelled):
    documents = odd(spark)
    scored = tx.scored(documents, GRAMMAR)
    assert scored.columns == [*documents.columns, "score", "predicted"]
    rows = scored.collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    none = tx.learn(documents, labelled[1].limit(0))
    assert {round(r["score"], 6) for r in tx.scored(documents, none).collect()} == {tx.PRIOR}
    write(spark, tmp_path, "documents", frame(spark, []))
    write(spark, tmp_path, "labels", labelled[1])
    assert tx.op10_toxicity(spark, str(tmp_path)).count() == 0


def test_different_words_of_equal_weight_count_each():
    grammar = tx.Grammar({w: 2.0 for w in ("stab", "shoot", "burn")}, {"wor": 2.0}, [-4.0, 2.0, 2.0, 0.0, -1.0])
    assert grammar.clauses("I will stab, shoot and burn you") == [[(tx.TARGETED, 2.0)] * 3]
    assert grammar.clauses("worthless worm, stab") == [[(tx.PLAIN, 2.0)] * 3]
    assert grammar.clauses("stab stab shoot stab") == [[(tx.PLAIN, 2.0)] * 2]


def test_a_quotation_ends_with_its_line():
    assert kinds('5" of scum\nscum. scum') == [[tx.REPORTED], [tx.PLAIN], [tx.PLAIN]]
    assert kinds('"fine. scum" scum') == [[tx.REPORTED, tx.PLAIN]]

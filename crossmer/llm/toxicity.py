"""Toxicity by a weighted finite-state grammar over clauses (operator 10).

Words are arcs of lexicon transducers: insult, threat, target (persons addressed),
negation, reported speech. Insults and threats carry weights learned from labelled
documents (see `learn`): log-odds of words and of word beginnings that are typical
of documents labelled toxic. A clause ends at . ! ? ; or a line break. Four small
transducers are composed into one machine that reads the classes of a clause:

* target: after a target word, or before one in the same clause, a match counts
  as targeted;
* negation: a match within NEGATION_REACH words after a negation is negated;
* reported speech: a match after a reporting word or inside quotes is reported; quotes
  end with the line, so a mark without partner says nothing about other lines;
* match: emits the weight of insults and threats under the state reached.

A clause scores the sum of its matches, each multiplied by the factor of its state; a
word repeated in one state counts once, different words count each.
A document's features are saturating sums over clauses; a logistic regression on
the labelled sample turns them into a probability. Isolated words of the lexicon do
little when negated or reported.

Labels are learned only from rows of `learning`, at most SAMPLE_ROWS of them (those
with the smallest hash of their id; a documented bound, so the sample can be
broadcast). Counts of words cover every sampled text. Scores use the text alone.

Cases: null and empty texts and texts without words have no clauses and get the
score of the empty document; documents without label are scored alike; rows with
null labels or ids are not learned from; repeated labels of a document count once
(toxic if any says so); without any usable label all scores are PRIOR; texts of any
length are scored whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossmer.llm.common import pieces, table
from crossmer.operators.storage import materialize

SAMPLE_ROWS = 20_000
MAX_ENTRIES = 5_000          # learned lexicon entries, by evidence
BEGINNINGS = range(3, 8)     # lengths of word beginnings
MIN_TOXIC = 4                # toxic documents with an entry, at least
MIN_EVIDENCE = 18.0          # log-likelihood ratio of an entry, at least
MIN_WEIGHT = 2.5             # log-odds of an entry, at least
THREAT_WEIGHT = 2.0          # of a threat word that fewer than one clean document in a thousand contains
PRIOR = 0.05
THRESHOLD = 0.7
NEGATION_REACH = 3
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”«»„]")

# Word lists of the grammar. English, German, French, Spanish.
THREAT = frozenset("kill murder destroy shoot stab hang burn beat hurt umbringen töten erschießen vernichten "
                   "tuer détruire frapper brûler matar destruir golpear quemar".split())
TARGET = frozenset("you your yours they them their he she him her these those du dich dir dein deine ihr euch "
                   "tu toi ton ta vous votre usted ustedes tus ellos".split())
NEGATION = frozenset("not no never nobody isn aren wasn don doesn didn nicht kein keine nie niemals "
                     "pas jamais aucun nunca jamás ningún tampoco".split())
REPORTING = frozenset("said says say claimed called reported wrote quoted sagte behauptete nannte schrieb "
                      "dit écrit affirmé dijo escribió afirmó llamó".split())
QUOTES = frozenset('"“”«»„')
STOPS = frozenset(".!?;")
LINE_END = "\n"

OTHER, MATCH, TARGETING, NEGATING, REPORT, QUOTE, STOP, LINE = range(8)
PLAIN, TARGETED, NEGATED, REPORTED = range(4)
FACTORS = (1.0, 1.3, 0.3, 0.4)       # of a match in each state
FEATURES, SOFTENED = 4, 3


def _compose() -> tuple[np.ndarray, np.ndarray]:
    """The product of the four transducers: next state and kind of match, for every state and class.

    A state is (words a negation still reaches, reported, quoted, targeted).
    """
    reach, shape = NEGATION_REACH + 1, (NEGATION_REACH + 1, 2, 2, 2)
    following = np.zeros((reach * 8, 8), dtype=np.int64)
    kinds = np.zeros((reach * 8, 8), dtype=np.int64)
    for state in range(reach * 8):
        negation, reported, quoted, targeted = np.unravel_index(state, shape)
        for symbol in range(8):
            n, r, q, t = max(0, negation - 1), reported, quoted, targeted
            if symbol == NEGATING:
                n = NEGATION_REACH
            elif symbol == REPORT:
                r = 1
            elif symbol == QUOTE:
                n, q = negation, 1 - quoted
            elif symbol == TARGETING:
                t = 1
            elif symbol == STOP:
                n, r, t = 0, 0, 0
            elif symbol == LINE:
                n, r, q, t = 0, 0, 0, 0
            following[state, symbol] = np.ravel_multi_index((n, r, q, t), shape)
            kinds[state, symbol] = NEGATED if negation else REPORTED if reported or quoted else TARGETED if targeted else PLAIN
    return following, kinds


_NEXT, _KIND = (table_.tolist() for table_ in _compose())


class Grammar:
    """Lexicon weights and the composed machine; scores whole texts."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], coefficients: list[float]):
        self.words, self.beginnings, self.coefficients = words, beginnings, np.array(coefficients)
        self._known: dict[str, tuple[int, float, str]] = {}

    def _arc(self, token: str) -> tuple[int, float]:
        if token in STOPS:
            return STOP, 0.0
        if token == LINE_END:
            return LINE, 0.0
        if token in QUOTES:
            return QUOTE, 0.0
        weight = max([self.words.get(token, 0.0),
                      *(self.beginnings.get(token[:n], 0.0) for n in BEGINNINGS if n <= len(token))])
        if weight > 0:
            return MATCH, weight
        if token in NEGATION:
            return NEGATING, 0.0
        if token in REPORTING:
            return REPORT, 0.0
        return (TARGETING, 0.0) if token in TARGET else (OTHER, 0.0)

    def arcs(self, text: str) -> list[tuple[int, float, str]]:
        known = self._known
        tokens = TOKEN.findall(text.lower())
        fresh = {t for t in set(tokens) if t not in known}
        if fresh:
            if len(known) + len(fresh) > 400_000:
                known.clear()
                fresh = set(tokens)
            for token in fresh:
                known[token] = (*self._arc(token), token)
        return [known[t] for t in tokens]

    def clauses(self, text: str) -> list[list[tuple[int, float]]]:
        """(kind, weight) of the matches of every clause that has any, one for each word and kind."""
        arcs = self.arcs(text)
        if not any(symbol == MATCH for symbol, _, _ in arcs):
            return []
        out, state, matches, targets = [], 0, {}, False
        for symbol, weight, token in [*arcs, (STOP, 0.0, "")]:
            if symbol == OTHER and state < 8 and not matches:      # nothing open that a word could change
                continue
            if symbol == MATCH:
                matches[_KIND[state][symbol], token] = weight      # a word repeated over and over says no more
            elif symbol == TARGETING:
                targets = True
            elif symbol in (STOP, LINE):
                if matches:
                    out.append([(TARGETED if k == PLAIN and targets else k, w) for (k, _), w in matches.items()])
                matches, targets = {}, False
            state = _NEXT[state][symbol]
        return out

    def features(self, text: str | None) -> list[float]:
        """Saturating: total of clause scores, best clause, matched clauses, share negated or reported."""
        found = self.clauses(text) if text else []
        if not found:
            return [0.0] * FEATURES
        scores = [sum(FACTORS[k] * w for k, w in clause) for clause in found]
        matches = [k for clause in found for k, _ in clause]
        softened = sum(k in (NEGATED, REPORTED) for k in matches) / len(matches)
        return [math.log1p(sum(scores)), math.log1p(max(scores)), math.log1p(len(found)), softened]

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(self.coefficients[0] + features @ self.coefficients[1:], -30, 30)
        return 1 / (1 + np.exp(-z))


# --- learning ------------------------------------------------------------------------------

def labelled_sample(labels: DataFrame, learning, limit: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, toxic of at most `limit` labelled documents that `learning` (a condition) admits."""
    return (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(learning)
        .groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(limit)
    )


def _entries(text: str) -> set[str]:
    """The words of a text, and their beginnings marked by a trailing star."""
    words = {t for t in TOKEN.findall(text.lower()) if t[0].isalpha()}
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) >= n}


def _counted(sample: DataFrame) -> DataFrame:
    """entry, toxic, clean: documents with an entry; counted within tasks first."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            entries = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(entries, pa.string()), pa.array([counts[1][e] for e in entries], pa.int64()),
                 pa.array([counts[0][e] for e in entries], pa.int64())], ["entry", "toxic", "clean"])
            counts[0].clear()
            counts[1].clear()
            return batch

        for batch in pieces(batches, "text"):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(_entries(text or ""))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield flush()
        if counts[0] or counts[1]:
            yield flush()

    partial = sample.select("text", "toxic").mapInArrow(run, "entry string, toxic long, clean long")
    return partial.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights (log-odds) of significant words and beginnings."""
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (t + c) / (n_toxic + n_clean)
    weight = F.log((t + 0.5) / (n_toxic - t + 0.5)) - F.log((c + 0.5) / (n_clean - c + 0.5))

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))

    evidence = 2 * (part(t, share * n_toxic) + part(c, share * n_clean)
                    + part(n_toxic - t, (1 - share) * n_toxic) + part(n_clean - c, (1 - share) * n_clean))
    chosen = (
        counts.filter(F.col("toxic") >= MIN_TOXIC)
        .withColumn("weight", weight).withColumn("evidence", evidence)
        .filter((F.col("evidence") >= MIN_EVIDENCE) & (F.col("weight") >= MIN_WEIGHT))
        .orderBy(F.desc("evidence"), "entry").limit(MAX_ENTRIES)
        .select("entry", "weight").collect()        # at most MAX_ENTRIES
    )
    words = {r["entry"]: r["weight"] for r in chosen if not r["entry"].endswith("*")}
    beginnings = {r["entry"][:-1]: r["weight"] for r in chosen if r["entry"].endswith("*")}
    return words, beginnings


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps; features that would lower a score with more matches are left out."""
    used = list(range(x.shape[1]))
    while True:
        design = np.column_stack([np.ones(len(x)), x[:, used]])
        w = np.zeros(design.shape[1])
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        worst = min(((w[1 + k], f) for k, f in enumerate(used) if f != SOFTENED), default=(0.0, None))
        if worst[0] >= 0:
            out = np.zeros(1 + x.shape[1])
            out[0], out[[1 + f for f in used]] = w[0], w[1:]
            return out.tolist()
        used.remove(worst[1])


def learn(documents: DataFrame, labels: DataFrame, learning=None) -> Grammar:
    """Lexicon and regression from the labelled documents that the condition `learning` admits."""
    chosen = labelled_sample(labels, F.lit(True) if learning is None else learning)
    sample = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))      # at most SAMPLE_ROWS rows
        .select("text", "toxic")
    )
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    fallback = [math.log(PRIOR / (1 - PRIOR))] + [0.0] * FEATURES
    if not n_toxic or not n_clean:
        return Grammar({}, {}, fallback)
    counts = materialize(_counted(sample))
    words, beginnings = _lexicon(counts, n_toxic, n_clean)
    harmless = {r["entry"] for r in counts.filter(F.col("entry").isin(*sorted(THREAT)) & (
        F.col("clean") * 1000 >= n_clean)).select("entry").collect()}
    words |= {w: THREAT_WEIGHT for w in THREAT - words.keys() - harmless}
    grammar = Grammar(words, beginnings, fallback)
    rows = _featured(sample, grammar, "toxic").collect()           # at most SAMPLE_ROWS rows of a few numbers
    x = np.array([list(r)[1:] for r in rows], dtype=float).reshape(len(rows), FEATURES)
    y = np.array([r[0] for r in rows], dtype=float)
    grammar.coefficients = np.array(_fit(x, y))
    return grammar


def _featured(rows: DataFrame, grammar: Grammar, key: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((grammar.words, grammar.beginnings))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shared.value, [0.0] * (FEATURES + 1))
        for batch in pieces(batches, "text"):
            found = [own.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64())] + [pa.array([f[i] for f in found], pa.float64()) for i in range(FEATURES)],
                [key] + [f"f{i}" for i in range(FEATURES)])

    columns = ", ".join(f"f{i} double" for i in range(FEATURES))
    return rows.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, {columns}")


def scored(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """All columns of documents with `score` (0 to 1) and `predicted` (1 from THRESHOLD on)."""
    shared = documents.sparkSession.sparkContext.broadcast(
        (grammar.words, grammar.beginnings, grammar.coefficients.tolist()))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Grammar(*shared.value)
        for texts in batches:
            found = [own.features(t if isinstance(t, str) else None) for t in texts]
            yield pd.Series(own.scores(np.array(found, dtype=float).reshape(len(found), FEATURES)))

    return documents.withColumn("score", score("text")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    grammar = learn(documents, table(spark, folder, "labels"), ~held_out("doc_id"))
    return scored(documents, grammar).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")

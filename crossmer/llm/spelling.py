"""Spelling variants by PartEnum signatures of letter multisets (operator 12).

A word is the binary vector of its letters: the n-th `a` of a word is a dimension
of its own. Two words that differ by one inserted, deleted or replaced code point
have vectors at a Hamming distance of at most two, and of exactly one if their
lengths differ.

1. Dimensions are dealt out to LANES partitions by a hash. The part of a vector in
   a lane is 16 bits (the exclusive or of its dimensions' codes); all lanes
   together are one bigint.
2. Enumeration: vectors at distance k agree on all lanes but k at most. So words of
   one length agree on one of the `masks(2)`, words whose lengths differ by one on
   one of the `masks(1)`. What is left of a vector under a mask is a signature.
3. One edit leaves the first or the second half of the shorter spelling as it is, so
   a signature is listed once with either half. This keeps lists short where many
   words have nearly the same letters; it drops no pair.
4. Lists are joined on the exact signature (long ones as a grid of cells), and pairs
   are verified by their edit distance. Equal signatures of different vectors cost a
   comparison; no pair is lost. A pair is reported from its first common signature
   only, so that none has to be removed afterwards.
5. A word's form is the most frequent near word, if frequent enough. Forms grow at
   least RATIO-fold along a chain, so the number of pointer-doubling rounds to the
   root follows from the largest count.

Cases: null and empty texts hold no words; a null doc_id is the empty string in the
hash; repeated rows count each; equally frequent near words: the smallest in code-point
order; a very long word has long halves but the same number of signatures; an empty
table has no words; extra columns are ignored.
"""

from __future__ import annotations

import string
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossmer.llm.common import table
from crossmer.operators.grid import list_join
from crossmer.operators.storage import materialize

MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10                # a form is at least so many times as frequent
ERROR_MODULUS = 31
LANES = 4                 # partitions of the dimensions
GROUPS = 2                # lanes are taken in so many groups for distance one
LETTER_RUN = f"[A-Za-zÀ-ÿ]{{{MIN_LETTERS},}}"     # greedy, so a maximal run


def occurrences(documents: DataFrame) -> DataFrame:
    """word: every run of letters with at least MIN_LETTERS left, after the planted deletions."""
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return (
        documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTER_RUN), F.lit(0))).alias("run"))
        .withColumn("run", run)
        .withColumn("h", F.crc32(F.concat(number, F.lit(":"), "run")))
        .select(F.when(F.col("h") % ERROR_MODULUS == 0, cut).otherwise(F.col("run")).alias("word"))
        .filter(F.length("word") >= MIN_LETTERS)
    )


def masks(distance: int) -> list[int]:
    """What is kept of the lanes: every way to leave out as many parts as may differ."""
    if distance == 1:
        size = LANES // GROUPS
        parts = [sum(0xFFFF << 16 * i for i in range(g * size, (g + 1) * size)) for g in range(GROUPS)]
    else:
        parts = [0xFFFF << 16 * i for i in range(LANES)]
    kept = (sum(p for p in parts if p not in out) for out in combinations(parts, distance))
    return [m - (1 << 64) if m >> 63 else m for m in kept]      # as a signed bigint


def letter_vector(word: Column) -> Column:
    """The lanes of a word's letter multiset."""
    def dimension(letter: Column, n: Column) -> Column:
        code = F.xxhash64(letter, n)
        lane = F.pmod(code, F.lit(LANES)).cast("int")
        bits = F.shiftrightunsigned(code, 8).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
        return F.element_at(F.array(*[F.shiftleft(bits, 16 * i) for i in range(LANES)]), lane + 1)

    def letters(letter: Column) -> Column:
        times = F.length(word) - F.length(F.replace(word, letter, F.lit("")))
        return F.aggregate(F.sequence(F.lit(1), times), F.lit(0).cast("bigint"),
                           lambda held, n: held.bitwiseXOR(dimension(letter, n)))

    return F.aggregate(F.array_distinct(F.split(word, "")), F.lit(0).cast("bigint"),
                       lambda held, letter: held.bitwiseXOR(letters(letter)))


def signatures(words: DataFrame) -> DataFrame:
    """key, kind, slot, second, word, n, vector: every list a word stands in.

    `kind` 0: words of one length; 1 and 2: the shorter and the longer of two lengths.
    """
    size = F.length("word")

    def entries(kind: int, base: Column) -> list[Column]:
        half = F.floor(base / 2).cast("int")
        sides = (F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), size - (base - half) + 1, size))
        return [
            F.struct(
                F.xxhash64(F.lit(min(kind, 1)), F.lit(second), base, part, F.col("vector").bitwiseAND(F.lit(mask).cast("bigint"))).alias("key"),
                F.lit(kind).cast("tinyint").alias("kind"), F.lit(slot).cast("tinyint").alias("slot"),
                F.lit(bool(second)).alias("second"))
            for second, part in enumerate(sides) for slot, mask in enumerate(masks(1 if kind else 2))]

    longer = F.when(size > MIN_LETTERS, F.array(*entries(2, size - 1)))
    own = F.array(*entries(0, size), *entries(1, size))
    return words.select(
        F.explode(F.when(longer.isNull(), own).otherwise(F.concat(own, longer))).alias("s"), "word", "n", "vector"
    ).select("s.*", "word", "n", "vector")


def near_words(words: DataFrame, pairs: int | None = None) -> DataFrame:
    """word, near, near_n: both directions of every pair at edit distance one, of words with n and vector."""
    lists = signatures(words)
    differ = F.col("l.vector").bitwiseXOR(F.col("r.vector"))

    def first_slot(distance: int) -> Column:
        """The first mask under which both vectors agree."""
        agree = lambda mask: differ.bitwiseAND(F.lit(mask).cast("bigint")) == 0
        return F.coalesce(*[F.when(agree(mask), F.lit(slot)) for slot, mask in enumerate(masks(distance))])

    half = F.floor(F.least(F.length("l.word"), F.length("r.word")) / 2).cast("int")
    beginning = lambda side: F.substring(F.col(f"{side}.word"), F.lit(1), half)
    same_length = (F.col("l.kind") == 0) & (F.col("r.kind") == 0) & (F.col("l.word") < F.col("r.word")) & (
        F.col("l.slot") == first_slot(2))
    longer = (F.col("l.kind") == 1) & (F.col("r.kind") == 2) & (F.col("l.slot") == first_slot(1))
    found = list_join(
        lists, lists, "key",
        (same_length | longer) & (F.col("l.slot") == F.col("r.slot")) & (F.col("l.second") == F.col("r.second"))
        & (~F.col("l.second") | (beginning("l") != beginning("r")))
        & (F.levenshtein(F.col("l.word"), F.col("r.word"), 1) == 1), pairs)
    way = lambda a, b: F.struct(F.col(f"{a}.word").alias("word"), F.col(f"{b}.word").alias("near"),
                                F.col(f"{b}.n").alias("near_n"))
    return found.select(F.explode(F.array(way("l", "r"), way("r", "l"))).alias("p")).select("p.*")


def follow(links: DataFrame, steps: int) -> DataFrame:
    """word, root: the end of chains word -> form of at most `steps` links, by pointer doubling."""
    ends = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = ends.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return ends


def spelling_variants(documents: DataFrame, pairs: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents (doc_id, text)."""
    words = materialize(
        occurrences(documents).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)
        .withColumn("vector", letter_vector(F.col("word"))))      # written, or every signature would compute it anew
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    near = near_words(words, pairs).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = (-F.col("best.order")) >= RATIO * F.col("n")
    judged = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.order")).alias("form_n")))
    largest = judged.agg(F.max("n")).first()[0] or 0
    steps = 0
    while MIN_COUNT * RATIO ** (steps + 1) <= largest:
        steps += 1
    roots = follow(judged.filter("form IS NOT NULL"), steps)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


#: crc32 by its definition: eight steps a byte, of the text's UTF-8 bytes (letters up to U+00FF)
OP12_SQL = """
WITH runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
         translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')) AS run FROM documents)
  GROUP BY 1, 2
),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(d || ':' || run, ''), lambda ch:
             CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)]
                  ELSE [CAST(192 + (ord(ch) >> 6) AS BIGINT), CAST(128 + (ord(ch) & 63) AS BIGINT)] END))),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i:
             CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS h
  FROM runs
),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT times, CASE WHEN h % 31 = 0
                      THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
),
holes AS (
  SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b
  FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
),
near AS (
  SELECT x.word, y.word AS near, y.n AS near_n
  FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION
  SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.a || x.b = y.word
  UNION
  SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.a || x.b = y.word
),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM near GROUP BY word
),
first_best AS (
  SELECT near.word, min(encode(near)) AS form_bytes FROM near JOIN best USING (word)
  WHERE near.near_n = best.near_n GROUP BY near.word
),
judged AS (
  SELECT w.word, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN b.near_n >= 10 * w.n THEN decode(f.form_bytes) END AS form,
         CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN first_best f ON f.word = w.word
),
chains AS (
  WITH RECURSIVE steps AS (
    SELECT word, form AS at FROM judged WHERE form IS NOT NULL
    UNION ALL
    SELECT s.word, j.form FROM steps s JOIN judged j ON j.word = s.at WHERE j.form IS NOT NULL
  )
  SELECT s.word, s.at AS root FROM steps s JOIN judged j ON j.word = s.at WHERE j.form IS NULL
)
SELECT j.word, j.form, coalesce(c.root, j.word) AS root, j.n, j.n_near, j.form_n
FROM judged j LEFT JOIN chains c ON c.word = j.word
"""

"""Near-duplicate documents from bottom-k sketches of word shingles (operator 6).

1. A document's set: hashes of its distinct five-word shingles (see `words`). Its
   sketch: the K smallest of them by one hash function. Equal sets are one node
   from here on, so exact copies cost one row each.
2. Inverted lists of retained values. Two sets with a Jaccard index of at least
   0.75 share at least `need` of their retained values: exactly, while the sets
   fit into the sketch; beyond that the number is the largest that a pair at exactly
   the threshold misses with a chance below MISSED, by the exact binomial tail (values
   are drawn without replacement, which misses less often). So they share one of the first
   `size - need + 1` values when values are ordered from rare to frequent; only
   these are listed. A passage that a third of all documents contain comes last in
   that order and is hardly ever listed.
3. Each list has a leader, its most central member (whose retained values are the
   most frequent). Members meet the leaders of their lists: linear, not all pairs.
4. Pairs pass a filter, the Jaccard index estimated from the K smallest values of
   the union, and are then verified on the full sets.
5. Members that their leader's component has not taken in meet the other members
   of that leader's lists, if not yet connected to them. Filters and verification
   are part of this join, so failing pairs are never rows; lists are cut into tiles
   of TILE_PAIRS comparisons. Then every link between different texts is found or implied.
   Leaders with more than DIRECT_PAIRS such comparisons (documents that share a template
   but have no link) are not compared so: their members are listed anew by sketches of
   K_FINE values, of which linked sets share 325 at least (64 %, against 39 % of K values), so
   that fewer are listed, and steps 2 to 5 are done once more on those lists.
6. Components by star contraction; the smallest doc_id names a component.

Cases: null and empty texts and texts without words have an empty set and are
linked with nothing; documents with null doc_id are kept and linked with nothing
(component null); rows with equal doc_id each stay, in one component if linked;
repeated rows are copies; very long texts have long sets but the same sketch size;
an empty table gives no rows; extra columns are ignored. `kept` speaks of ids;
`keep_one` decides by row: rows with equal or null doc_id are told apart by their text,
and all rows with words take part, also those without doc_id.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossmer.llm.common import arrow_map, content_key, long_lists, table
from crossmer.llm.components import components
from crossmer.llm.words import shingle_sets
from crossmer.operators.storage import materialize

K = 64
K_FINE = 512                   # values of the sketches that list the members of large leaders anew
PERCENT = 75                   # links: 100 * shared >= PERCENT * union
MISSED = 1e-9                  # chance that a pair at the threshold is not listed or not estimated, per pair and test, at most
SPACES = " \t\n\x0b\x0c\r"    # between words, as in `words`
TILE_PAIRS = 200_000           # pairs of a leader's lists that are compared together, about
TILE_ROWS = 2_000              # of at most so many members on one side, about
DIRECT_PAIRS = 20_000          # comparisons of a leader's members beyond which they are listed anew

SKETCHES = "sig binary, n long, sketch array<long>"
SETS = "sig binary, shingles array<long>"


def _needed(size: int, k: int = K) -> int:
    """Retained values that two linked sets share at least, in sketches of k values."""
    share = PERCENT / 100
    return max(1, math.ceil(size * share)) if size <= k * share else min(size, sure_of(k))


@functools.cache
def sure_of(drawn: int, missed: float = MISSED) -> int:
    """The most of `drawn` values that a pair at the threshold shares but for a chance below `missed`."""
    share, tail, least = PERCENT / 100, 0.0, 0
    while True:
        tail += math.comb(drawn, least) * share**least * (1 - share) ** (drawn - least)
        if tail >= missed:
            return max(1, least)
        least += 1


def _signature(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(shingles: np.ndarray) -> np.ndarray:
    """The set as signed integers in their order, as Spark sorts them."""
    return np.sort(shingles.view(np.int64))


def sketches(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, sig (of the whole set), n (its size), sketch (its K smallest values, ascending)."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        sigs, sizes, kept = [], [], []
        for _, shingles in shingle_sets(texts):
            own = _signed(shingles)
            sigs.append(_signature(own))
            sizes.append(len(own))
            kept.append(own[:K])
        return {"doc_id": batch.column(0), "sig": sigs, "n": sizes, "sketch": long_lists(kept)}

    columns = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return arrow_map(columns, run, f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, {SKETCHES}")


def full_sets(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """sig, shingles: the whole sets of the asked nodes (doc_id, sig)."""

    def run(batch: pa.RecordBatch) -> dict:
        texts, wanted = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        sigs, sets = [], []
        for i, shingles in shingle_sets(texts):
            own = _signed(shingles)
            if _signature(own) == wanted[i]:       # another row may have the same doc_id
                sigs.append(wanted[i])
                sets.append(own)
        return {"sig": sigs, "shingles": long_lists(sets)}

    texts = documents.select("doc_id", "text").join(asked, "doc_id")
    return arrow_map(texts.select("sig", "text"), run, SETS).dropDuplicates(["sig"])


def _listed(nodes: DataFrame, k: int = K) -> DataFrame:
    """value, sig, n, centre: the inverted lists, of values in at least two sketches (of at most k values)."""
    postings = nodes.select("sig", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    frequent = postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = (
        postings.join(frequent, "value")
        .groupBy("sig", "n", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))    # at most k
    )
    rare = F.col("size") - F.size("values")       # values of no other sketch come first in the order
    length = F.col("size") - _need(F.col("size"), k) + 1 - rare
    centre = F.aggregate("values", F.lit(0.0), lambda a, v: a + F.log(v["df"].cast("double"))) / F.col("size")
    return (
        shared.withColumn("centre", centre)
        .select("sig", "n", "centre", F.explode(F.slice("values", 1, F.greatest(length, F.lit(0)))).alias("v"))
        .select("v.value", "sig", "n", "centre")
    )


def _similar_sizes(a: Column, b: Column) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(PERCENT) * F.greatest(a, b)


def _estimate_passes(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard index from the union's K smallest values: exact below K, the bound of the lists else."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    size = F.size(union)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return shared >= F.when(size < K, size * (PERCENT / 100) - 1e-9).otherwise(F.lit(float(sure_of(K))))


def _sketches_meet(a: Column, b: Column) -> Column:
    """The sketches share as many values as those of linked sets do at least: a cheap test before the estimate."""
    return F.size(F.array_intersect(a, b)) >= _need(F.least(F.size(a), F.size(b)))


def _need(size: Column, k: int = K) -> Column:
    """`_needed` of a column."""
    exact = F.greatest(F.lit(1), F.ceil(size * F.lit(PERCENT) / 100))
    return F.when(size * 100 <= k * PERCENT, exact).otherwise(F.least(size, F.lit(sure_of(k)))).cast("int")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose whole sets are similar enough."""
    return (
        pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("set_b")), "b")
        .filter(_linked(F.col("set_a"), F.col("set_b")))
        .select("a", "b")
    )


def _linked(a: Column, b: Column) -> Column:
    """100 * shared >= PERCENT * union, where the union is both sizes less what is shared."""
    return F.lit(100 + PERCENT) * F.size(F.array_intersect(a, b)) >= F.lit(PERCENT) * (F.size(a) + F.size(b))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents (doc_id, text)."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(sketches(documents))
    return _classes(rows, *_connected(documents, rows.filter("doc_id IS NOT NULL AND n > 0")))


def _connected(documents: DataFrame, usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The least doc_id of every sig of the usable sketches, and the components (node, component) of linked sigs."""
    names = usable.groupBy("sig").agg(F.min("doc_id").alias("least_id"))
    nodes = usable.select("sig", "n", "sketch").dropDuplicates(["sig"])
    met = materialize(_met(_listed(nodes)))
    taking_part = met.select("sig").unionByName(met.select(F.col("leader").alias("sig"))).distinct()
    own = materialize(nodes.join(taking_part, "sig", "left_semi"))
    sets = materialize(full_sets(documents, names.join(taking_part, "sig", "left_semi")
                                 .select(F.col("least_id").alias("doc_id"), "sig")))
    links = materialize(_led(met, own, sets))
    members = _members(met, components(links))
    large = materialize(members.filter(F.col("pairs") > DIRECT_PAIRS).select("sig", "n", "component").distinct())
    links = materialize(links.unionByName(_left_over(members.filter(F.col("pairs") <= DIRECT_PAIRS), own, sets)))
    if large.isEmpty():
        return names, materialize(components(links))
    fine = large.join(sets, "sig").select("sig", "n", F.slice("shingles", 1, K_FINE).alias("sketch"))
    met = materialize(_met(_listed(fine, K_FINE)))
    links = materialize(links.unionByName(_led(met, own, sets)))
    members = _members(met, components(links))
    return names, materialize(components(links.unionByName(_left_over(members, own, sets))))


def _met(listed: DataFrame) -> DataFrame:
    """leader, leader_n, sig, n: the members of each list with its leader, every meeting once."""
    leaders = listed.groupBy("value").agg(
        F.max(F.struct("centre", "sig", "n")).alias("l"), F.count("*").alias("members")).filter("members > 1")
    listed = listed.select("value", "sig", "n")
    return listed.join(leaders, "value").select(
        F.col("l.sig").alias("leader"), F.col("l.n").alias("leader_n"), "sig", "n").distinct()


def _led(met: DataFrame, own: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b of leaders and members of their lists."""
    a, b = own.select(F.col("sig").alias("a"), F.col("sketch").alias("sketch_a")), own.select(
        F.col("sig").alias("b"), F.col("sketch").alias("sketch_b"))
    first = (
        met.filter(F.col("leader") != F.col("sig")).filter(_similar_sizes(F.col("n"), F.col("leader_n")))
        .select(F.least("leader", "sig").alias("a"), F.greatest("leader", "sig").alias("b")).distinct()
        .join(a, "a").join(b, "b").filter(_estimate_passes(F.col("sketch_a"), F.col("sketch_b")))
        .select("a", "b")
    )
    return _verified(first, sets)


def _members(met: DataFrame, taken: DataFrame) -> DataFrame:
    """leader, sig, n, component, outside (of the leader's component), all, open, pairs: of leaders with open members."""
    labels = taken.select(F.col("node").alias("sig"), "component")
    members = (
        met.select("leader", "sig", "n")
        .unionByName(met.select("leader", F.col("leader").alias("sig"), F.col("leader_n").alias("n")))
        .distinct().join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    )
    of_leader = members.filter("leader = sig").select("leader", F.col("component").alias("main"))
    members = materialize(members.join(of_leader, "leader").withColumn("outside", F.col("component") != F.col("main")))
    size = (
        members.groupBy("leader").agg(F.count("*").alias("all"), F.sum(F.col("outside").cast("long")).alias("open"))
        .filter("open > 0").withColumn("pairs", F.col("all") * F.col("open"))
    )
    return materialize(members.join(size, "leader").drop("main"))


def _left_over(members: DataFrame, own: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b between members of one leader's lists that are not connected yet."""
    columns = ("sig", "n", "component", "sketch", "shingles", "outside", "leader")
    placed = (
        members.withColumn("down", F.ceil(F.col("all") / TILE_ROWS).cast("int"))
        .withColumn("across", F.ceil(F.col("open") * F.least(F.col("all"), F.lit(TILE_ROWS)) / TILE_PAIRS).cast("int"))
        .join(own.select("sig", "sketch"), "sig").join(sets, "sig")
        .withColumn("row", F.pmod(F.xxhash64("sig"), F.col("down")).cast("int"))
        .withColumn("column", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("across")).cast("int"))
    )
    x = placed.filter("outside").withColumn("x_row", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).select(
        "x_row", F.col("column").alias("x_column"), *[F.col(c).alias(f"x_{c}") for c in columns])
    y = placed.withColumn("y_column", F.explode(F.sequence(F.lit(0), F.col("across") - 1))).select(
        F.col("row").alias("y_row"), "y_column", *[F.col(c).alias(f"y_{c}") for c in columns])
    # tiles are small enough as they are: dealt out here, Spark does not split them again into thousands of tasks
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(tasks, "x_leader", "x_row", "x_column")
    y = y.repartition(tasks, "y_leader", "y_row", "y_column")
    tile = ((F.col("x_leader") == F.col("y_leader")) & (F.col("x_row") == F.col("y_row"))
            & (F.col("x_column") == F.col("y_column")))
    tested = F.col("y_sig") == F.col("y_leader")       # the pair was verified in the first round
    fits = (
        (F.col("x_component") != F.col("y_component")) & ~tested
        & (~F.col("y_outside") | (F.col("x_sig") < F.col("y_sig")))
        & _similar_sizes(F.col("x_n"), F.col("y_n"))
        & _sketches_meet(F.col("x_sketch"), F.col("y_sketch"))
        & _estimate_passes(F.col("x_sketch"), F.col("y_sketch"))
        & _linked(F.col("x_shingles"), F.col("y_shingles"))
    )
    return x.join(y, tile & fits).select(
        F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct()


def _classes(rows: DataFrame, names: DataFrame, whole: DataFrame) -> DataFrame:
    labelled = names.join(whole.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn(
        "component", F.coalesce("component", "sig"))
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("class_id"))
    classes = labelled.join(smallest, "component").select("sig", "class_id")
    linked = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return (
        linked.join(classes, "sig", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, with all their columns: one row per component, that of the smallest doc_id.

    A row with words gets a written key (of id and text); rows that share it are repeated
    rows, of which one is left before the search. A row without doc_id is kept only if its
    component has no other. Rows without words are linked with nothing and stay.
    """
    words = F.coalesce(F.length(F.translate("text", SPACES, "")) > 0, F.lit(False))
    unique = materialize(
        documents.filter(words).withColumn("_row_key", content_key("doc_id", "text")).dropDuplicates(["_row_key"]))
    texts = unique.select(F.col("_row_key").alias("doc_id"), "text")
    rows = materialize(sketches(texts)).filter("n > 0")
    _, whole = _connected(texts, rows)
    number = F.col("doc_id").cast("long")
    order = unique.select("_row_key", F.struct(number.isNull(), number, "_row_key").alias("place"))
    firsts = (
        rows.select(F.col("doc_id").alias("_row_key"), "sig").join(order, "_row_key")
        .groupBy("sig").agg(F.min("place").alias("place"))
        .join(whole.select(F.col("node").alias("sig"), "component"), "sig", "left")
        .groupBy(F.coalesce("component", "sig")).agg(F.min("place").alias("place"))
        .select("place._row_key")
    )
    return unique.join(firsts, "_row_key", "left_semi").select(*documents.columns).unionByName(documents.filter(~words))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))

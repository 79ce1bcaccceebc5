"""Prefix trie of conversations, rolled up by centroid decomposition (operator 13).

Conversations that begin with the same turns share nodes: a node of depth d is a
distinct sequence of d turns (role, text). It is named by its smallest member and
its depth. The sequence of a conversation's first d turns is told by 128 bits, the
exclusive or of a hash of every (place, role, text), so prefixes of all depths come
from running sums over ranges of the sorted turns; a conversation with a third of
all turns is many ranges.

Totals over subtrees (`roll_up`) follow a centroid decomposition of the parent edges:

1. A component is a connected part of the forest, named by its top node. Its centroid
   is the deepest node that holds at least half of the component. All nodes that do
   lie on one path, from the centroid up to the top, so this path is a filter.
2. The component is cut around the centroid: every child's subtree is a component,
   and so is the part above. What lies at and below the centroid is added up once per
   component and then added to the centroid and to every node of its path.
3. Components halve with every round. Those of more than LOCAL_NODES are cut in Spark,
   all at once, one round per level; smaller ones are dealt out whole and decomposed
   inside tasks.

A centroid is found from the number of nodes below each node. These are counted where
they come from: a node belongs to its smallest member, and the nodes of a member below
a depth are counted per member, so their sum per node needs no walk.

Cases: a null turn comes first, null roles and texts are empty; equal turn numbers are
ordered by role and text; rows without conv_id belong to no conversation; repeated rows
are turns each; conversations without turns are members of the root; an empty table has no
nodes; extra columns are ignored. conv_id - conv_id % 100 keeps the sign of a negative id.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from crossmer.llm.common import pieces, table
from crossmer.operators.storage import materialize

FAMILY = 100               # conversations that borrow their beginning from one another
BORROWED = 6               # at most BORROWED - 1 turns
LOCAL_NODES = 20_000       # of a component that one task decomposes
BROADCAST_COMPONENTS = 200_000
SUMS = ("n_leaves", "saved_tokens")


# --- sequences -----------------------------------------------------------------------

def _turn_bits(place: Column) -> tuple[Column, Column]:
    """128 bits of a turn at a place."""
    mark = F.concat_ws(":", place.cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text"))
    digest = F.md5(mark)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return half(1), half(17)


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text: the turns of every conversation in order."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ranges = materialize(
        turns.filter("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("_tie", F.monotonically_increasing_id())       # repeated rows do not stay together
        .repartitionByRange(*order, "_tie").withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy("conv_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = ranges.groupBy("conv_id", "_range").agg(F.count("*").alias("_n")).withColumn(
        "_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = W.partitionBy("conv_id", "_range").orderBy(*order[1:], "_tie")
    return (
        ranges.withColumn("place", F.row_number().over(inside).cast("long"))
        .join(bases, ["conv_id", "_range"])
        .select("conv_id", (F.col("place") + F.col("_base")).alias("place"), "role", "text")
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, role, text) of the rebuilt conversations, and every conv_id with its number of turns."""
    own = materialize(numbered(conversations.select("conv_id", "turn", "role", "text")))
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("own_turns"))
    borrowed = F.crc32(F.col("conv_id").cast("string")) % BORROWED
    plan = lengths.select("conv_id", "own_turns", borrowed.alias("h"),
                          (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    plan = materialize(plan.join(
        lengths.select(F.col("conv_id").alias("base"), F.col("own_turns").alias("base_turns")), "base", "left"
    ).select("conv_id", "base", "h", "own_turns", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken")))
    heads = own.filter(F.col("place") < BORROWED).select(F.col("conv_id").alias("base"), "place", "role", "text")
    begin = plan.filter("taken > 0").join(heads, "base").filter("place <= taken").select("conv_id", "place", "role", "text")
    rest = own.join(plan, "conv_id").filter("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    size = F.col("taken") + F.greatest(F.col("own_turns") - F.col("h"), F.lit(0))
    return begin.unionByName(rest), plan.select("conv_id", size.alias("turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, chars, a, b (the sequence up to here), pa, pb (up to the turn before)."""
    first, second = _turn_bits(F.col("place"))
    marks = materialize(
        turns.select("conv_id", "place", F.length("text").alias("chars"), first.alias("x"), second.alias("y"))
        .repartitionByRange("conv_id", "place").withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy("conv_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("conv_id", "_range").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    none = F.lit(0).cast("long")
    bases = marks.groupBy("conv_id", "_range").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).select(
        "conv_id", "_range", *[F.coalesce(F.bit_xor(c).over(before), none).alias(f"_{c}") for c in "xy"])
    joined = marks.join(bases, ["conv_id", "_range"])
    upto = {n: F.bit_xor(c).over(inside).bitwiseXOR(F.col(f"_{c}")) for n, c in (("a", "x"), ("b", "y"))}
    return joined.withColumns(upto).select(
        "conv_id", F.col("place").alias("depth"), "chars", "a", "b",
        F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))


# --- centroid decomposition -------------------------------------------------------------

def decompose(parents: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Sums over the subtrees of one component; a parent comes before its children, the top's parent is -1."""
    total = [[0] * len(values[0]) for _ in values]
    waiting = [list(range(len(parents)))]
    parents = list(parents)
    while waiting:
        part = waiting.pop()
        below = dict.fromkeys(part, 1)
        for v in reversed(part):
            if parents[v] >= 0:
                below[parents[v]] += below[v]
        centre = next(v for v in reversed(part) if 2 * below[v] >= len(part))
        under: dict[int, int] = {}                       # node -> the child of the centroid above it
        parts = defaultdict(list)
        held = list(values[centre])
        for v in part:
            if v == centre:
                continue
            child = v if parents[v] == centre else under.get(parents[v])
            if child is not None:
                under[v] = child
                held = [a + b for a, b in zip(held, values[v])]
            parts[-1 if child is None else child].append(v)
        at = centre
        while at >= 0:                                   # the centroid, then its path to the top
            for k, value in enumerate(held):
                total[at][k] += value
            at = parents[at]
        for child in parts:
            if child >= 0:
                parents[child] = -1
        waiting += parts.values()
    return total


def _decomposed(names: tuple[str, ...]):
    """Rows sorted by component and depth -> owner, depth and the sums of every node of the small components."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in ("owner", "depth", *names)}
        held: list[tuple] = []
        component = None

        def close() -> None:
            at = {(owner, depth): i for i, (owner, depth, *_) in enumerate(held)}
            parents = [at.get((up, depth - 1), -1) for _, depth, up, *_ in held]
            sums = decompose(parents, [row[3:3 + len(names)] for row in held])
            for (owner, depth, _, *rest), found in zip(held, sums, strict=True):
                out["owner"].append(owner)
                out["depth"].append(depth)
                for k, name in enumerate(names):
                    out[name].append(found[k] + rest[len(names) + k])
            held.clear()

        for batch in batches:
            for top, top_depth, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (top, top_depth) != component and held:
                    close()
                component = (top, top_depth)
                held.append(tuple(row))
            if len(out["owner"]) > 50_000:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                for column in out.values():
                    column.clear()
        if held:
            close()
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([(n, pa.int64()) for n in ("owner", "depth", *names)])
    return run


def roll_up(nodes: DataFrame, ancestors: DataFrame, names: tuple[str, ...] = SUMS) -> DataFrame:
    """owner, depth and, for every name, the sum over the node's subtree.

    `nodes`: owner, depth (together the node), up (owner of the parent), below (nodes of its
    subtree, itself included), top, top_depth (the topmost node of its tree) and the values.
    `ancestors`: owner, depth, node, up for every owner of a node and depth of its ancestors:
    the owner of the ancestor there and the owner of that ancestor's parent.
    """
    added = [f"{n}_added" for n in names]
    columns = ["owner", "depth", "up", "below", "top", "top_depth", *names]
    state = materialize(nodes.select(*columns, *[F.lit(0).cast("long").alias(n) for n in added]))
    small, done = [], []
    while True:
        heads = state.filter("owner = top AND depth = top_depth").select("top", "top_depth", F.col("below").alias("size"))
        large = materialize(heads.filter(F.col("size") > LOCAL_NODES))
        marked = state.join(_bounded(large), ["top", "top_depth"], "left")
        small.append(marked.filter("size IS NULL").select("top", "top_depth", "owner", "depth", "up", *names, *added))
        if large.isEmpty():
            break
        state = materialize(_cut(marked.filter("size IS NOT NULL"), ancestors, names, done))
    rest = small[0]
    for part in small[1:]:
        rest = rest.unionByName(part)
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = (
        rest.repartition(tasks, "top", "top_depth").sortWithinPartitions("top", "top_depth", "depth")
        .mapInArrow(_decomposed(names), ", ".join(f"{n} long" for n in ("owner", "depth", *names)))
    )
    for part in done:
        sums = sums.unionByName(part)
    return sums


def _cut(active: DataFrame, ancestors: DataFrame, names: tuple[str, ...], done: list[DataFrame]) -> DataFrame:
    """One level for components with their size: centroids go to `done`, the other nodes to smaller components."""
    on_path = F.lit(2) * F.col("below") >= F.col("size")
    centres = materialize(active.filter(on_path).groupBy("top", "top_depth").agg(
        F.max_by("owner", "depth").alias("c"), F.max("depth").alias("c_depth"), F.min("below").alias("c_below")))
    # the ancestor one step below the centroid's depth: a child of the centroid, if the node lies under it
    depths = centres.select((F.col("c_depth") + 1).alias("at")).distinct()
    steps = ancestors.select("owner", F.col("depth").alias("at"), F.col("node").alias("child"), F.col("up").alias("child_up")).join(
        _bounded(depths), "at", "left_semi")
    placed = materialize(
        active.join(_bounded(centres), ["top", "top_depth"]).withColumn("at", F.col("c_depth") + 1)
        .join(steps, ["owner", "at"], "left")
        .withColumn("under", F.coalesce((F.col("depth") >= F.col("at")) & (F.col("child_up") == F.col("c")), F.lit(False)))
        .withColumn("centre", (F.col("owner") == F.col("c")) & (F.col("depth") == F.col("c_depth"))))
    held = materialize(placed.filter("under OR centre").groupBy("top", "top_depth").agg(
        *[F.sum(n).alias(f"{n}_held") for n in names]))
    summed = placed.join(_bounded(held), ["top", "top_depth"])
    grown = lambda n: F.col(f"{n}_added") + F.col(f"{n}_held")
    done.append(summed.filter("centre").select("owner", "depth", *[grown(n).alias(n) for n in names]))
    either = lambda test, yes, no: F.when(test, yes).otherwise(F.col(no)).alias(no)
    return summed.filter("NOT centre").select(
        "owner", "depth", "up", either(on_path, F.col("below") - F.col("c_below"), "below"),
        either(F.col("under"), F.col("child"), "top"), either(F.col("under"), F.col("at"), "top_depth"), *names,
        *[either(on_path, grown(n), f"{n}_added") for n in names])


def _bounded(frame: DataFrame) -> DataFrame:
    """Broadcast only if counted to be small; a plain join otherwise."""
    return F.broadcast(frame) if frame.limit(BROADCAST_COMPONENTS + 1).count() <= BROADCAST_COMPONENTS else frame


# --- the trie ----------------------------------------------------------------------------

def _ends(lasts: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 from owner, depth, conv_id: digests of the ascending numbers, joined by commas.

    Ranges of a node's numbers are joined by many tasks; only the running digest goes through
    a node's ranges in order, holding one range at a time.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in pieces(batches, "numbers"):
            out: list[tuple] = []
            for owner, depth, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (owner, depth) == node:
                    state.update(f",{numbers}".encode())
                    continue
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(numbers.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(schema.types)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"owner": node[0], "depth": node[1], "ends_sha256": state.hexdigest()}], schema=schema)

    schema = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    chunks = (
        lasts.repartitionByRange("owner", "depth", "conv_id").withColumn("_range", F.spark_partition_id())
        .groupBy("owner", "depth", "_range").agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("numbers")))
    tasks = int(lasts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        chunks.repartition(tasks, "owner", "depth").sortWithinPartitions("owner", "depth", "_range")
        .select("owner", "depth", "numbers").mapInArrow(run, "owner long, depth long, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text); see the contract of `op13`."""
    turns, members = rebuilt(conversations)
    members = materialize(members)
    rows = materialize(prefixes(turns))
    found = materialize(rows.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"),
        F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb")))
    # the root's members are all conversations; without any there is no root
    root = members.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = root.select(F.col("owner").alias("top"))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("up"))
    linked = materialize(
        found.filter("depth > 1").join(above, ["depth", "pa", "pb"])
        .unionByName(found.filter("depth = 1").join(F.broadcast(top.withColumnRenamed("top", "up"))))     # one row
        .select("depth", "a", "b", "owner", "up", "n_convs", "chars"))

    ancestors = materialize(rows.select("conv_id", "depth", "a", "b").join(
        linked.select("depth", "a", "b", F.col("owner").alias("node"), "up"), ["depth", "a", "b"]
    ).select(F.col("conv_id").alias("owner"), "depth", "node", "up"))
    first = ancestors.filter("node = owner").groupBy("owner").agg(
        F.min("depth").alias("first"), F.max("depth").alias("last"))      # a member's own nodes
    own = F.coalesce(F.col("last") - F.greatest("first", "depth") + 1, F.lit(0))
    below = ancestors.join(first, "owner", "left").groupBy(F.col("node").alias("owner"), "depth").agg(F.sum(own).alias("below"))

    nodes = linked.select("owner", "depth", "up", "n_convs", "chars").unionByName(
        root.select("owner", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("up"), "n_convs",
                    F.lit(0).alias("chars")))
    children = linked.groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    all_nodes = linked.agg((F.count("*") + 1).alias("all_nodes"))
    nodes = materialize(
        nodes.join(children, ["owner", "depth"], "left").join(below, ["owner", "depth"], "left")
        .join(F.broadcast(top)).join(F.broadcast(all_nodes))              # one row each
        .select("owner", "depth", "up", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                F.coalesce("below", "all_nodes").alias("below"), "top", F.lit(0).cast("long").alias("top_depth"),
                ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long")))

    sums = roll_up(nodes, ancestors)
    ended = members.filter("turns > 0").select(F.col("conv_id").alias("owner"), F.col("turns").alias("depth"))
    lasts = ancestors.join(ended, ["owner", "depth"]).select(
        F.col("node").alias("owner"), "depth", F.col("owner").alias("conv_id")).unionByName(
        members.filter("turns = 0").join(F.broadcast(top)).select(
            F.col("top").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    return (
        nodes.select("owner", "depth", "up", "n_convs", "n_children").join(sums, ["owner", "depth"])
        .join(_ends(lasts), ["owner", "depth"], "left")
        .select(F.col("owner").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", *SUMS,
                F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    )


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


#: crc32 by its definition, eight steps a byte; subtree sums over the members of a node
OP13_SQL = """
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
lengths AS (SELECT c, count(*) AS k FROM own GROUP BY c),
plan AS (
  SELECT x.c, x.k, x.c - x.c % 100 AS base, x.h, least(x.h, coalesce(b.k, 0)) AS taken
  FROM (SELECT c, k, xor(4294967295, list_reduce(
          list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
          lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i:
            CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 6 AS h FROM lengths) x
  LEFT JOIN lengths b ON b.c = x.c - x.c % 100
),
turns AS (
  SELECT plan.c, own.p AS d, role, text FROM plan JOIN own ON own.c = plan.base WHERE own.p <= plan.taken
  UNION ALL
  SELECT plan.c, own.p - plan.h + plan.taken, role, text FROM plan JOIN own ON own.c = plan.c WHERE own.p > plan.h
),
paths AS (
  SELECT c, d, length(text) AS chars,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS path
  FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM plan
),
named AS (SELECT c, d, path, chars, min(c) OVER (PARTITION BY path) AS owner FROM paths),
ended AS (SELECT c, max(d) AS last FROM named GROUP BY c),
nodes AS (
  SELECT owner, n.d, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(n.c AS VARCHAR), ',' ORDER BY n.c) FILTER (n.d = last), '')) AS ends_sha256
  FROM named n JOIN ended USING (c) GROUP BY owner, n.d
),
parents AS (
  SELECT DISTINCT n.owner, n.d, up.owner AS parent FROM named n LEFT JOIN named up ON up.c = n.c AND up.d = n.d - 1
),
children AS (SELECT parent AS owner, d - 1 AS d, count(*) AS n_children FROM parents WHERE d > 0 GROUP BY ALL),
valued AS (
  SELECT nodes.owner, nodes.d, parent, n_convs, coalesce(n_children, 0) AS n_children, ends_sha256,
         CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved
  FROM nodes JOIN parents USING (owner, d) LEFT JOIN children USING (owner, d)
),
sums AS (
  SELECT up.owner, up.d, sum(v.leaf) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM valued v JOIN named up ON up.c = v.owner AND up.d <= v.d GROUP BY ALL
)
SELECT v.owner AS conv_id, v.d AS depth, v.parent AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s USING (owner, d)
"""

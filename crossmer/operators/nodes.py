"""Antigens grouped by identical sequence.

Every score depends on the residues alone, so pairs are searched between
distinct sequences ("nodes"). A passage copied into a third of all rows costs
one node; the aggregation that finds it combines map-side.

An antigen frame has columns ``id``, ``ordinal`` (unique input position) and
``sequence``. A node keeps the first and last ordinal of its copies: an
antigen of node A precedes one of node B in input order for some pair of
copies exactly when ``A.node < B.last``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from crossmer.operators.storage import materialize


@dataclass
class NodeSet:
    frame: DataFrame     # node, last, id, copies, length, sequence
    count: int           # distinct sequences
    antigens: int        # input antigens
    residues: int        # input residues over all copies (the E-value search space)
    longest: int         # length of the longest sequence


def build_nodes(antigens: DataFrame) -> NodeSet:
    # k-mers multiply every node by its length, so nodes are spread by hash
    # instead of being packed by their own small size
    partitions = int(antigens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frame = materialize(
        antigens.groupBy("sequence").agg(
            F.min("ordinal").alias("node"),
            F.max("ordinal").alias("last"),
            F.min_by("id", "ordinal").alias("id"),
            F.count("*").alias("copies"),
        ).withColumn("length", F.length("sequence")).repartition(partitions, "node")
    )
    total = frame.agg(
        F.count("*"), F.coalesce(F.sum("copies"), F.lit(0)),
        F.coalesce(F.sum(F.col("length") * F.col("copies")), F.lit(0)),
        F.coalesce(F.max("length"), F.lit(0)),
    ).first()
    return NodeSet(frame, *map(int, total))


def precedes(q_len: Column, q_node: Column, t_len: Column, t_last: Column) -> Column:
    """Screen order: longer first, then input order."""
    return (q_len > t_len) | ((q_len == t_len) & (q_node < t_last))


def attach(pairs: DataFrame, nodes: DataFrame, columns: list[str], sides=("q", "t")) -> DataFrame:
    """Add node columns to both ends of a pair frame as ``q_*`` and ``t_*``."""
    for side in sides:
        pairs = pairs.join(
            nodes.select(
                F.col("node").alias(f"{side}_node"),
                *[F.col(c).alias(f"{side}_{c}") for c in columns],
            ),
            f"{side}_node",
        )
    return pairs


def both_directions(pairs: DataFrame, *carried: str, ends: tuple[str, ...] = ()) -> DataFrame:
    """Unordered (a_node, b_node) -> both (q_node, t_node) rows, without a shuffle.

    ``ends`` names columns of either end (a_*, b_*), which become q_* and t_*.
    """
    way = lambda q, t: F.struct(*[
        F.col(f"{s}_{c}").alias(f"{n}_{c}") for s, n in ((q, "q"), (t, "t")) for c in ("node", *ends)])
    ways = F.explode(F.array(way("a", "b"), way("b", "a")))
    return pairs.select(ways.alias("_way"), *carried).select("_way.*", *carried)


def expand_copies(pairs: DataFrame, antigens: DataFrame, nodes: DataFrame,
                  directed: bool = True, block: int = 4096) -> DataFrame:
    """Node pairs -> antigen pairs (``query_id``, ``target_id``), directions kept.

    Input: ``q_node``/``t_node`` rows of a screen. With ``directed`` (one row
    per pair) equal lengths keep only the copies that stand in that order,
    otherwise every pair of different antigens. The output is as large as the
    antigen-level result itself; a node with many copies is cut into blocks so
    that no task holds all of them.
    """
    members = (
        antigens.join(nodes.select("sequence", "node", "copies", "length"), "sequence")
        .withColumn("blocks", F.ceil(F.col("copies") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    )

    def side(frame: DataFrame, s: str) -> DataFrame:
        ends = members.select(
            F.col("node").alias(f"{s}_node"), F.col("block").alias(f"{s}_block"),
            F.col("id").alias(f"{s}_member"), F.col("ordinal").alias(f"{s}_ordinal"),
            F.col("length").alias(f"{s}_size"),
        )
        sizes = nodes.select(
            F.col("node").alias(f"{s}_node"),
            F.explode(F.sequence(
                F.lit(0), F.ceil(F.col("copies") / block).cast("int") - 1
            )).alias(f"{s}_block"),
        )
        return frame.join(sizes, f"{s}_node").join(ends, [f"{s}_node", f"{s}_block"])

    kept = F.col("q_ordinal") != F.col("t_ordinal")
    if directed:
        kept = (F.col("q_size") > F.col("t_size")) | (F.col("q_ordinal") < F.col("t_ordinal"))
    joined = side(side(pairs, "q"), "t").filter(kept)
    helpers = [f"{s}_{c}" for s in "qt" for c in ("block", "ordinal", "size")]
    return joined.withColumn("query_id", F.col("q_member")).withColumn(
        "target_id", F.col("t_member")
    ).drop("q_member", "t_member", *helpers)

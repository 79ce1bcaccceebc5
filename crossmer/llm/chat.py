"""Chat formatting from an event log (operator 4).

A log has one event per row: conv_id, seq, kind, message, role, text. Events of a
conversation count in the order of seq, and the last role named for a message counts:

* `message` sets role and text of a message;
* `delta` appends to the text of its message;
* `edit` replaces the text;
* `regenerate` empties the text and drops all later messages of the conversation.

The fold needs no state beyond running windows over the sorted log: an event is void if
a later regeneration names an earlier message, or if its own message was set anew
later. What is left is joined per message. The log is cut into ranges of (conv_id, seq):
a range is looked through backwards, and only the smallest message that is regenerated in
each of the ranges after it is carried over, one row per range.

The template marks an assistant turn as `<s>role LF text</s> LF` and any other as
`[INST]role LF text[/INST] LF`. Inside roles and texts a backslash is doubled and one
is put after the first character of every control string, so a control string in
the output is always a mark and the texts can be read back exactly. The loss mask
is a list of character spans, one per assistant text.

Messages are rendered in ranges of (conv_id, message). A conversation is one row, unless
it is longer than BLOCK_CHARS or crosses ranges; then it goes on in further rows with
larger block numbers (range and number in it). So a conversation with a third of all rows
is folded and rendered by many tasks, and no row holds it whole. Only a digest of a
conversation goes through its blocks in order, in constant memory.

Cases: null texts and roles are empty; a null conv_id is one conversation of its
own; equal seqs are ordered by message, kind, text; unknown kinds and events that
only void others leave nothing; an empty log has no rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from crossmer.llm.common import pieces, table
from crossmer.operators.storage import materialize

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNED_ROLE = "assistant"
BLOCK_CHARS = 4 << 20
TURN = re.compile(r"(<s>|\[INST\])([^\n]*)\n(.*?)(</s>|\[/INST\])\n", re.DOTALL)
BLOCKS = ("conv_id long, block long, n_turns long, formatted string, "
          "loss array<struct<begin: long, end: long>>")

PROBE = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for mark in CONTROL:
        text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of its text."""
    opening, closing = ("<s>", "</s>") if role == LEARNED_ROLE else ("[INST]", "[/INST]")
    head, body = f"{opening}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{closing}\n", len(head), len(head) + len(body)


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn, read back."""
    for found in TURN.finditer(formatted):
        yield unescape_role(found[2]), unescape(found[3])


def _ranges(frame: DataFrame, *order: Column) -> DataFrame:
    """The rows in ranges of (conv_id, *order), numbered in `_range`; repeated rows are dealt out too."""
    return materialize(
        frame.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange("conv_id", *order, "_tie").withColumn("_range", F.spark_partition_id()))


def _same(*names: str) -> Column:
    """Join on names where null equals null."""
    out = F.lit(True)
    for name in names:
        out = out & F.col(f"x.{name}").eqNullSafe(F.col(f"y.{name}"))
    return out


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text of the final messages."""
    names = ("seq", "message", "kind", "text")
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    latest = [F.desc(n) for n in names]
    named = F.when(F.col("kind") == "regenerate", F.col("message"))
    log = _ranges(
        events.select("conv_id", F.col("seq").cast("long").alias("seq"), "kind",
                      F.col("message").cast("long").alias("message"), "role",
                      F.coalesce("text", F.lit("")).alias("text"))
        .filter(F.col("kind").isin("message", "delta", "edit", "regenerate")), *map(F.col, names))
    carried = log.groupBy("conv_id", "_range").agg(F.min(named).alias("least")).select(
        "conv_id", "_range", F.min("least").over(before("conv_id").orderBy(F.desc("_range"))).alias("later"))
    resets = F.max(F.col("kind").isin("message", "edit", "regenerate").cast("int"))
    own = before("conv_id", "message").orderBy(*latest, F.desc("_tie"))
    role_of = W.partitionBy("conv_id", "message").orderBy(*names, "_tie").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        log.withColumn("inside", F.min(named).over(before("conv_id", "_range").orderBy(*latest, F.desc("_tie")))).alias("x")
        .join(carried.alias("y"), _same("conv_id", "_range"))
        .select("x.*", F.least("inside", "later").alias("cut"))
        .filter(F.col("cut").isNull() | F.col("message").isNull() | (F.col("message") <= F.col("cut")))
        .withColumn("void", F.coalesce(resets.over(own), F.lit(0)))
        .withColumn("last_role", F.last("role", ignorenulls=True).over(role_of))
        .filter("void = 0")
        .groupBy("conv_id", "message")
        .agg(F.coalesce(F.max("last_role"), F.lit("")).alias("role"),
             F.sort_array(F.collect_list(F.struct(
                 "seq", "kind", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))).alias("parts"))
        .select("conv_id", "message", "role", F.array_join(F.col("parts.text"), "").alias("text"))
    )


def format_messages(messages: DataFrame) -> DataFrame:
    """conv_id, block, n_turns, formatted, loss: rendered conversations from conv_id, message, role, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32      # ranges are in order, so blocks are
        rows: list[tuple] = []
        held = 0
        state: dict = {"key": object(), "block": first, "parts": [], "spans": [], "at": 0, "n": 0}

        def close():
            nonlocal held
            if state["parts"]:
                rows.append((state["key"], state["block"], state["n"], "".join(state["parts"]), state["spans"]))
                held += state["at"]
            state.update(parts=[], spans=[], at=0, n=0)

        def flush():
            nonlocal held
            names = ("conv_id", "block", "n_turns", "formatted")
            columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
            columns["loss"] = [[{"begin": a, "end": b} for a, b in r[4]] for r in rows]
            held = 0
            rows.clear()
            return pa.RecordBatch.from_pydict(columns, schema=_BLOCK_SCHEMA)

        for batch in pieces(batches, "text"):
            for key, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != state["key"]:
                    close()
                    state.update(key=key, block=first)
                elif state["at"] > BLOCK_CHARS:
                    close()
                    state["block"] += 1
                segment, begin, end = render(role or "", text or "")
                if role == LEARNED_ROLE:
                    state["spans"].append((state["at"] + begin, state["at"] + end))
                state["parts"].append(segment)
                state["at"] += len(segment)
                state["n"] += 1
            if held > BLOCK_CHARS:
                yield flush()
        close()
        if rows:
            yield flush()

    columns = messages.select(F.col("conv_id").cast("long").alias("conv_id"),
                              F.col("message").cast("long").alias("message"), "role", "text")
    order = ("conv_id", "message", "role", "text")
    return (
        materialize(columns.withColumn("_tie", F.monotonically_increasing_id()))      # sampled for the ranges, then dealt out
        .repartitionByRange(*order, "_tie").sortWithinPartitions(*order).drop("_tie")
        .mapInArrow(run, BLOCKS)
    )


_BLOCK_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its formatted blocks: turns and the text under the mask."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        key, state = object(), None

        def close():
            if state is not None:
                out.append({"conv_id": key, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(),
                            "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(),
                            "formatted_chars": state["all"]})

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in pieces(batches, "formatted"):
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != key:
                    close()
                    key = row["conv_id"]
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                formatted = row["formatted"]
                for role, text in turns(formatted):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    text = unescape(formatted[span["begin"]:span["end"]])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode("utf-8", "surrogatepass"))
                state["all"] += len(formatted)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return (
        blocks.select("conv_id", "block", "formatted", "loss")
        .repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, DIGESTS)
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """A log from finished turns: one `message` event per row, numbered in the order of turns."""
    cut = _ranges(conversations.select("conv_id", "turn", "role", "text"), *map(F.col, ("turn", "role", "text")))
    before = W.partitionBy("conv_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = cut.groupBy("conv_id", "_range").agg(F.count("*").alias("n")).select(
        "conv_id", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("conv_id", "_range").orderBy("turn", "role", "text", "_tie")
    return (
        cut.withColumn("own", F.row_number().over(inside)).alias("x").join(bases.alias("y"), _same("conv_id", "_range"))
        .withColumn("seq", (F.col("own") + F.col("base")).cast("long"))
        .select("x.conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("message"), "role", "text")
    )


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(materialize(format_messages(fold(as_events(rows.unionByName(probe))))))

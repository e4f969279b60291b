"""Chat formatting: conversations rebuilt from event logs and rendered with a loss mask over what assistants say.

An event (conv_id, seq, kind, turn, role, text) changes one turn of one conversation:

* ``message`` and ``edit`` set the turn's text, ``delta`` adds to its end,
* ``regenerate`` empties the turn and takes all later turns away; what follows is written anew.

Logs are partitioned by conversation and sorted by sequence. Whether an event still counts is read from the events after it:
none of them sets the same turn again, and none regenerates an earlier turn. Both are running values of windows over the
sorted log, which spill; the deltas that count are joined into one text a turn. One shuffle by conv_id serves all of it.

The template of a turn is ``<turn ROLE>TEXT</turn>`` and a line feed. Inside a text, ``<turn`` and ``</turn`` get a backslash
behind ``<``, and so do forms that have backslashes there already, so taking one away again gives the text back. In a role,
``%``, ``<``, ``>`` and line feeds are written as ``%`` and two hexadecimal digits. Other characters stay as they are.

A formatted conversation comes in parts of whole turns, ordered by ``part``, a new one after ``PART_CHARS`` characters, so that
a conversation of any length passes through a task without being held there. ``loss`` lists the spans (code points of the
part, end exclusive) that an assistant says.

Defined cases: a null text is empty, a null role is the empty role, a null kind is ``message``; a turn's role is the last
one that its events name; events of equal seq stand in the order of turn, kind, role and text, nulls first; a null conv_id is
a conversation of its own; repeated events count as often as they stand; an empty log gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.textbytes import small_batches

PART_CHARS = 1 << 20
ASSISTANT = "assistant"
CLOSE = "</turn>\n"
TURN = re.compile(r"<turn ([^>]*)>(.*?)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"<\\(\\*)(/?turn)")
PARTS = "conv_id {}, part long, text string, loss array<struct<start:long,end:long>>"
REPORT = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the turns that a log ends with, partitioned by conv_id."""
    e = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    later = [F.col(c).desc_nulls_last() for c in ("seq", "turn", "kind", "role", "text")]
    after = Window.partitionBy("conv_id").orderBy(*later).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("conv_id", "turn").orderBy(*later).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id", "turn").orderBy(*later).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(after)
    reset = F.max((F.col("kind") != "delta").cast("int")).over(same)
    e = e.repartition("conv_id").withColumns({"cut": cut, "reset": reset, "said_by": F.first("role", ignorenulls=True).over(whole)})
    counts = e.where((F.coalesce("reset", F.lit(0)) == 0) & (F.col("cut").isNull() | F.coalesce(F.col("turn") <= F.col("cut"), F.lit(True))))
    piece = F.struct("seq", "kind", "role", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))
    turns = counts.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.first("said_by").alias("role"))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join("pieces.text", "").alias("text"))


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*/?turn)", r"<\\$1")


def unescape_text(text: str) -> str:
    return ESCAPED.sub(r"<\1\2", text)


def escape_role(role: Column) -> Column:
    for char in "%<>\n":
        role = F.replace(role, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return role


def unescape_role(role: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), role)


def format_conversations(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, text, loss): the turns of :func:`fold` rendered, by conv_id and part within each partition."""
    small_batches(turns.sparkSession)
    opening = F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">"))
    drawn = turns.withColumns({"opening": opening, "body": escape_text(F.col("text"))}).select(
        "conv_id",
        "turn",
        F.concat("opening", "body", F.lit(CLOSE)).alias("drawn"),
        F.when(F.col("role") == ASSISTANT, F.length("opening")).alias("start"),
        F.length("body").alias("size"),
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, length, texts, loss, begun = None, 0, 0, [], [], False

        def part() -> pa.RecordBatch:
            values = ([conv], [number], ["".join(texts)], [loss])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields)], names=fields.names)

        for batch in batches:
            fields = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int64()), ("text", pa.string()), ("loss", _LOSS)])
            for key, text, start, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "drawn", "start", "size"))):
                if begun and (key != conv or length + len(text) > part_chars):
                    yield part()
                    number = number + 1 if key == conv else 0
                    length, texts, loss = 0, [], []
                conv, begun = key, True
                if start is not None:
                    loss.append({"start": length + start, "end": length + start + size})
                texts.append(text)
                length += len(text)
        if begun:
            yield part()

    by_turn = drawn.sortWithinPartitions("conv_id", "turn").drop("turn")
    return by_turn.mapInArrow(assemble, PARTS.format(turns.schema["conv_id"].dataType.simpleString()))


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def read_part(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a part."""
    out, at = [], 0
    while at < len(text):
        found = TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(found[1]), unescape_text(found[2])))
        at = found.end()
    return out


def digest_parts(parts: DataFrame) -> DataFrame:
    """Turns, digests and lengths of every conversation, read back from its parts as :func:`format_conversations` leaves them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def done(kind: pa.DataType) -> pa.RecordBatch:
            turns, said, n, heard, chars = state
            values = ([conv], [n], [said.hexdigest()], [heard], [turns.hexdigest()], [chars])
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            a = [pa.array(v, t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(a, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for key, part, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "loss"))):
                if part == 0:
                    if state is not None:
                        yield done(kind)
                    conv, state = key, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, words in read_part(text):
                    state[1].update(f"{role}\n{words}\n".encode())
                    state[2] += 1
                for span in loss:
                    words = unescape_text(text[span["start"] : span["end"]])
                    state[0].update(words.encode())
                    state[3] += len(words)
                state[4] += len(text)
        if state is not None:
            yield done(kind)

    return parts.mapInArrow(scan, REPORT.format(parts.schema["conv_id"].dataType.simpleString()))


def table_events(conversations: DataFrame) -> DataFrame:
    """Every row of a table (conv_id, turn, role, text) as a message of its own, by turn, role and text, nulls first."""
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    number = F.row_number().over(order)
    return rows.select("conv_id", number.alias("seq"), number.alias("turn"), F.lit("message").alias("kind"), "role", "text")


def chat_report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Digests of all formatted conversations and of one that is made to look like control strings, numbered -7."""
    said = r"\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string")
    log = table_events(conversations.select("conv_id", "turn", "role", "text").union(odd))
    return digest_parts(format_conversations(fold(log)))

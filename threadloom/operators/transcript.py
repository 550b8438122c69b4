"""Full conversation texts, in parts of a fixed number of lines.

A conversation of ordinary length is one part: its transcript. A very long one
is several numbered parts, so no task and no row ever holds all of it; the parts
in order are the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.state import message_ordinal
from threadloom.operators.timeline import Timeline, _by_order
from threadloom.schema import KEYS

# A format parameter: how many lines a part has. Longer texts have more parts.
PART_LINES = 1000


def line() -> Column:
    return F.concat(F.col("sender"), F.lit(": "), F.col("message"))


def transcript_lines(messages: DataFrame, part_lines: int = PART_LINES,
                     timeline: Timeline | None = None) -> DataFrame:
    """Every message as a numbered line with the number of its part."""
    numbered = message_ordinal(messages, timeline)
    return numbered.select(
        *KEYS, "ts", "seq", "sender", "message", "message_number",
        F.floor((F.col("message_number") - 1) / part_lines).alias("part"),
        line().alias("line"))


def transcript(messages: DataFrame, part_lines: int = PART_LINES,
               timeline: Timeline | None = None) -> DataFrame:
    """One row per part: its lines in order, joined. Groups are bounded by size."""
    return _parts(messages, part_lines, timeline).drop("newest")


def _parts(messages: DataFrame, part_lines: int, timeline: Timeline | None) -> DataFrame:
    numbered = transcript_lines(messages, part_lines, timeline)
    rows = F.collect_list(F.struct(F.col("message_number").alias("o"), F.col("line")))
    grouped = numbered.groupBy(*KEYS, "part").agg(
        rows.alias("rows"), F.count(F.lit(1)).alias("lines"),
        F.max_by("message", "message_number").alias("newest"))
    text = F.array_join(
        F.transform(F.array_sort(F.col("rows"), _by_order), lambda r: r["line"]), "\n")
    return grouped.select(*KEYS, "part", "lines", text.alias("text"), "newest")


# The text of the reply request.
REPLY_HEAD = 'Conversation History:\n"""\n'
REPLY_MIDDLE = '\n"""\n\nLatest Customer Message:\n"""\n'
REPLY_TAIL = '\n"""'


def reply_context(messages: DataFrame, part_lines: int = PART_LINES,
                  timeline: Timeline | None = None) -> DataFrame:
    """The whole history and the newest message of every conversation, as a reply's context.

    One row per part of the history, so the context of a very long conversation is
    several rows: ``context`` of its parts in order, joined by a newline, is the whole of
    it. The first part opens the context, the last one (``is_last``) ends with the newest
    message. The history up to an earlier message is a filter on ``transcript_lines``.
    """
    parts = _parts(messages, part_lines, timeline)
    # The number of messages names the last part: the texts of a conversation's parts stay
    # where they are, none is gathered with the others to compare.
    last = F.floor((F.count(F.lit(1)) - 1) / part_lines)
    ends = messages.groupBy(*KEYS).agg(last.alias("part"), F.lit(True).alias("is_last"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*KEYS, "part")]
    parts = parts.alias("p").join(ends.alias("e"), same, "left").select(
        "p.*", F.coalesce("e.is_last", F.lit(False)).alias("is_last"))
    head = F.when(F.col("part") == 0, F.lit(REPLY_HEAD)).otherwise("")
    tail = F.when(F.col("is_last"), F.concat(F.lit(REPLY_MIDDLE), F.col("newest"), F.lit(REPLY_TAIL)))
    return parts.select(
        *KEYS, "part", "lines", "is_last",
        F.concat(head, F.col("text"), F.coalesce(tail, F.lit(""))).alias("context"))

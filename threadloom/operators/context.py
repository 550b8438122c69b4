"""Texts handed to a scorer, built from state rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import last_n, lines
from threadloom.schema import CONTEXT_MESSAGES

# The texts around the conversation.
BACKGROUND = "Background Context: "
RECENT = "\n\nRecent Conversation:\n"
CONVERSATION = "Conversation:\n"
INSTRUCTION = ("\n\nIMPORTANT: Analyze the CUSTOMER's CURRENT emotional state based on "
               "their latest message above.\n")
NO_SUMMARY = "No previous summary (start of conversation)."


def recent_text(messages: Column, n: int = CONTEXT_MESSAGES) -> Column:
    """The last ``n`` messages as ``Sender: text`` lines."""
    return lines(last_n(messages, n), F.initcap)


def context_last5(states: DataFrame, n: int = CONTEXT_MESSAGES) -> DataFrame:
    return states.withColumn("context", recent_text(F.col("recent_messages"), n))


insights_context = context_last5


def sentiment_context(states: DataFrame) -> DataFrame:
    """Summary and last five lines if there is a summary, otherwise the whole window."""
    messages = F.col("recent_messages")
    tldr = F.coalesce(F.col("summary.tldr"), F.lit(""))
    short = F.concat(F.lit(BACKGROUND), tldr, F.lit(RECENT),
                     lines(last_n(messages, CONTEXT_MESSAGES), F.upper), F.lit(INSTRUCTION))
    full = F.concat(F.lit(CONVERSATION), lines(messages, F.upper), F.lit(INSTRUCTION))
    use_summary = (tldr != "") & (F.size(messages) > 1)
    return states.withColumn("context", F.when(use_summary, short).otherwise(full))


def summary_prompt(summary: Column, sender: Column, message: Column) -> Column:
    """Previous summary (or a fixed line), then the new message."""
    previous = F.concat(
        F.lit("\nPrevious Summary:\n- TLDR: "), summary["tldr"],
        F.lit("\n- Issue: "), summary["customer_issue"],
        F.lit("\n- Key Points: "), F.array_join(summary["key_points"], ", "),
        F.lit("\n- Next Steps: "), F.array_join(summary["next_steps"], ", "), F.lit("\n"))
    head = F.when(summary.isNull(), F.lit(NO_SUMMARY)).otherwise(previous)
    return F.concat(head, F.lit("\n\nNew Message from "), sender, F.lit(":\n\""), message,
                    F.lit("\""))


def summary_context(states: DataFrame) -> DataFrame:
    newest = F.try_element_at(F.col("recent_messages"), F.lit(-1))
    return states.withColumn(
        "context", summary_prompt(F.col("summary"), newest["sender"], newest["message"]))

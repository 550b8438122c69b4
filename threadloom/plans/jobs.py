"""Whole jobs, from requests to merged records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.context import context_last5, sentiment_context
from threadloom.operators.merge import merge_intelligence_final
from threadloom.operators.messages import (dead_letters, normalize_message, valid_rows,
                                           validate_message)
from threadloom.operators.pii import pii_results
from threadloom.operators.scoring import Fold, Scorer, score, summary_fold
from threadloom.operators.state import (attach_summary_asof, conversation_final,
                                        sentiment_trigger, state_rows)
from threadloom.operators.timeline import Timeline
from threadloom.schema import KEYS, KINDS, PAYLOADS
from threadloom.sources.events import spread
from threadloom.sources.sinks import staged


@dataclass(frozen=True)
class Scorers:
    """Models of the job; a summary is made from the one before it and the new message."""

    sentiment: Scorer
    insights: Scorer
    summary: Fold


def ingest(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests to (messages, dead letters)."""
    checked = validate_message(requests)
    return normalize_message(valid_rows(checked)), dead_letters(checked)


def final_states_with_context(messages: DataFrame) -> DataFrame:
    """Final state per conversation with its last-five-messages context."""
    return context_last5(conversation_final(messages))


def as_results(scored: DataFrame, kind: str) -> DataFrame:
    return scored.filter(F.col("error").isNull()).select(
        *KEYS, F.lit(kind).alias("kind"), "ts", "seq", kind)


def score_states(states: DataFrame, scorers: Scorers) -> dict[str, DataFrame]:
    """Scored contexts by kind, failures included. ``states`` carry a summary."""
    return {
        "sentiment": score(sentiment_context(sentiment_trigger(states)), scorers.sentiment,
                           "sentiment"),
        "insights": score(context_last5(states), scorers.insights, "insights"),
    }


def intelligence(messages: DataFrame, scorers: Scorers,
                 timeline: Timeline | None = None) -> DataFrame:
    """Messages to one merged record per conversation.

    Every message gives a summary, made from the one before it; the state at a
    message knows the summary of the message before. Keys are measured once and
    the cuts used throughout. Summaries, states and results are written once, as
    several steps read them and a scorer must not be asked twice.
    """
    summaries = staged(summary_fold(messages, scorers.summary), "summaries")
    positions = messages.select(*KEYS, "ts", "seq").unionByName(
        summaries.select(*KEYS, "ts", "seq"))
    t = timeline or Timeline().measured(positions)
    states = staged(state_rows(attach_summary_asof(messages, summaries, t), t, {}), "states")
    parts = [as_results(df, kind) for kind, df in score_states(states, scorers).items()]
    parts.append(summaries.select(*KEYS, F.lit("summary").alias("kind"), "ts", "seq", "summary"))
    parts.append(pii_results(messages))
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part, allowMissingColumns=True)
    typed = results.select(*KEYS, "kind", "ts", "seq",
                           *[F.col(k).cast(PAYLOADS[k]).alias(k) for k in KINDS])
    # Packed files: a split of them has millions of rows, and a task sorts what it has read.
    return merge_intelligence_final(spread(staged(typed, "results")))

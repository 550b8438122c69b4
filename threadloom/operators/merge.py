"""The merged record per conversation: newest result of each kind, PII that stays.

The entity list of a key has two parts: the list of its first PII result, kept as
it is, and for every other (type, value) its first occurrence. At any point in
time the list is the part of those that was seen by then, so no running list has
to be built row by row, and first occurrences are a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import timeline as tl
from threadloom.operators.timeline import Timeline, latest, measured_once
from threadloom.schema import KEYS, KINDS, PII
from threadloom.sources.sinks import staged

ORDER = ("ts", "seq")


def _order() -> Column:
    return F.struct(*ORDER)


def first_seen(results: DataFrame) -> DataFrame:
    """Per key and (type, value): the entity that came first, its position and place.

    An aggregate with partial sums, for batch and as a running aggregate of a stream.
    """
    items = (results.filter(F.col("pii").isNotNull())
             .select(*KEYS, _order().alias("since"),
                     F.posexplode("pii.entities").alias("place", "entity")))
    return (items.groupBy(*KEYS, F.col("entity.type").alias("type"),
                          F.col("entity.value").alias("value"))
            .agg(F.min_by(F.struct("since", "place", "entity"),
                          F.struct("since", "place")).alias("e"))
            .select(*KEYS, "type", "value", "e.since", "e.place", "e.entity"))


def _seen_list() -> Column:
    """First occurrences of a key as one list, in order of position."""
    return F.array_sort(F.collect_list(F.struct("since", "place", "entity"))).alias("_seen")


def _opening() -> Column:
    """Position and entities of a PII result; the first of a key opens its list."""
    return F.when(F.col("pii").isNotNull(), F.struct(
        _order().alias("at"), F.col("pii.entities").alias("entities")))


def _head() -> Column:
    return F.when(F.col("pii").isNotNull(), F.struct("pii.redacted_text", "pii.timestamp"))


def _totals() -> list[Column]:
    """Everything of a merged record but the entities that came after the first PII result."""
    order = _order()
    return [*[F.max_by(k, F.when(F.col(k).isNotNull(), order)).alias(f"_{k}")
              for k in KINDS if k != "pii"],
            F.max_by(_head(), F.when(F.col("pii").isNotNull(), order)).alias("_pii"),
            F.min_by(_opening(), F.when(F.col("pii").isNotNull(), order)).alias("_open"),
            F.max("pii.has_pii").alias("_sticky"), F.max("ts").alias("last_updated")]


def merge_totals(results: DataFrame) -> DataFrame:
    """One row of fixed size per conversation, for batch and as a running aggregate."""
    return results.groupBy(*KEYS).agg(*_totals())


def merged_records(totals: DataFrame, seen: DataFrame) -> DataFrame:
    """Merged records from ``merge_totals`` and ``first_seen``."""
    lists = seen.groupBy(*KEYS).agg(_seen_list())
    return _records(totals.join(lists, list(KEYS), "left"))


def _records(joined: DataFrame) -> DataFrame:
    pii = _merged_pii(F.col("_pii"), F.col("_sticky"), F.col("_open"), F.col("_seen"))
    return joined.select(
        *KEYS, *[(pii if k == "pii" else F.col(f"_{k}")).alias(k) for k in KINDS],
        "last_updated")


def pii_entity_merge(results: DataFrame) -> DataFrame:
    """Entities of every conversation as rows.

    One row per kept entity: ``since`` is the position (ts, seq) of the result
    that brought it, ``place`` its place in that result's list; sorted by both,
    the rows are the list. Stays a table of rows however many distinct entities a
    conversation has. The input is read once: of every (type, value) the places in the
    first result that has it are kept, and of every key where its first result is.
    """
    pii = F.col("pii")
    places = F.transform(F.col("pii.entities"), lambda e, i: F.struct(
        e["type"].alias("type"), e["value"].alias("value"), i.alias("place"), e.alias("entity")))
    # one row per result and (type, value), and one for the result itself
    marks = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("type"),
                                      F.lit(None).cast("string").alias("value"))),
                     F.array_distinct(F.transform("_all", lambda e: F.struct(e["type"], e["value"]))))
    rows = (results.filter(pii.isNotNull())
            .select(*KEYS, _order().alias("since"), places.alias("_all"))
            .select(*KEYS, "since", "_all", F.explode(marks).alias("_mark")))
    own = F.filter("_all", lambda e: (e["type"] == F.col("_mark.type"))
                   & (e["value"] == F.col("_mark.value")))
    found = staged(
        rows.select(*KEYS, "since", "_mark", own.alias("_own"))
        .groupBy(*KEYS, "_mark").agg(F.min_by(F.struct("since", "_own"), "since").alias("_first"))
        .select(*KEYS, "_mark", "_first.since", "_first._own"), "entities")
    opened = found.filter(F.col("_mark.type").isNull()).select(*KEYS, F.col("since").alias("_at"))
    kept = F.when(F.col("since") == F.col("_at"), F.col("_own")).otherwise(F.slice("_own", 1, 1))
    return (found.filter(F.col("_mark.type").isNotNull()).join(opened, list(KEYS))
            .select(*KEYS, "since", F.explode(kept).alias("_e"))
            .select(*KEYS, "since", "_e.place", "_e.entity"))


def _merged_pii(newest: Column, sticky: Column, opening: Column, seen: Column,
                until: Column | None = None) -> Column:
    """The PII part: newest text, flag that stays, opening list and what came after."""
    def later(e: Column) -> Column:
        after = e["since"] > opening["at"]
        return after if until is None else after & (e["since"] <= until)

    empty = F.array().cast(PII["entities"].dataType)
    more = F.transform(F.filter(seen, later), lambda e: e["entity"])
    return F.when(newest.isNotNull(), F.struct(
        sticky.alias("has_pii"),
        F.concat(F.coalesce(opening["entities"], empty), F.coalesce(more, empty))
        .alias("entities"),
        newest["redacted_text"].alias("redacted_text"),
        newest["timestamp"].alias("timestamp")).cast(PII))


def merge_intelligence(results: DataFrame, timeline: Timeline | None = None) -> DataFrame:
    """Change log: one merged record per input result, in event order.

    A result of unknown kind gives a row too, unchanged but for ``last_updated``.
    """
    t, results = measured_once(results, timeline)
    seen = first_seen(results).groupBy(*KEYS).agg(_seen_list())
    out = t.running(results, {
        **{f"_{k}": tl.last(F.col(k)) for k in KINDS if k != "pii"},
        "_pii": tl.last(_head()),
        "_sticky": tl.any_so_far(F.col("pii.has_pii")),
        "_open": tl.first(_opening()),
    }, per_key=seen).drop(*KINDS)
    pii = _merged_pii(F.col("_pii"), F.col("_sticky"), F.col("_open"), F.col("_seen"), _order())
    return out.select(
        *KEYS, *ORDER, "kind", *[(pii if k == "pii" else F.col(f"_{k}")).alias(k) for k in KINDS],
        F.col("ts").alias("last_updated"))


def merge_intelligence_final(results: DataFrame) -> DataFrame:
    """The merged record of every conversation, as partial aggregates over one scan.

    A result gives a row for itself and one per entity. They are reduced per key and
    (type, value) first, and what is left of a key is put together after that.
    """
    none = F.lit(None).cast(PII["entities"].dataType.elementType)
    item = F.struct(F.lit(None).cast("int").alias("place"), none.alias("entity"))
    entities = F.transform(F.coalesce("pii.entities", F.array()), lambda e, i: F.struct(
        i.alias("place"), e.alias("entity")))
    rows = results.select(*KEYS, *ORDER, *KINDS, F.explode(F.concat(F.array(item), entities))
                          .alias("_item"))
    itself = F.col("_item.place").isNull()
    rows = rows.select(*KEYS, *ORDER, *[F.when(itself, F.col(k)).alias(k) for k in KINDS],
                       F.struct(_order().alias("since"), "_item.place", "_item.entity").alias("_e"))
    place = F.struct("_e.since", "_e.place")
    parts = rows.groupBy(*KEYS, F.col("_e.entity.type").alias("_type"),
                         F.col("_e.entity.value").alias("_value")).agg(
        *_totals(), F.min_by("_e", F.when(F.col("_e.place").isNotNull(), place)).alias("_e"))
    names = [f"_{k}" for k in KINDS if k != "pii"] + ["_pii", "_open", "_sticky"]
    return _records(parts.groupBy(*KEYS).agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in names],
        F.max("last_updated").alias("last_updated"),
        F.array_sort(F.collect_list("_e")).alias("_seen")))


def pii_sticky(results: DataFrame, timeline: Timeline | None = None) -> DataFrame:
    """Each PII result with whether any so far found personal data."""
    pii = results.filter(F.col("pii").isNotNull()).select(
        *KEYS, *ORDER, F.col("pii.has_pii").alias("found"))
    t, pii = measured_once(pii, timeline)
    return t.running(pii, {"has_pii": tl.any_so_far(F.col("found"))})


def running_latest(results: DataFrame, timeline: Timeline | None = None) -> DataFrame:
    """Each result with the newest payload of every kind so far."""
    t, results = measured_once(results, timeline)
    out = t.running(results, {f"latest_{k}": tl.last(F.col(k)) for k in KINDS})
    return out.drop(*KINDS)


def latest_record(results: DataFrame) -> DataFrame:
    """The newest whole record per key and kind: here a null does replace."""
    return latest(results, (*KEYS, "kind"), ORDER)


def completeness(merged: DataFrame) -> DataFrame:
    """Which of the four parts are there, and whether all are."""
    flags = {f"has_{k}": F.col(k).isNotNull() for k in KINDS}
    complete = flags["has_sentiment"]
    for k in KINDS[1:]:
        complete = complete & flags[f"has_{k}"]
    return merged.select("*", *[f.alias(n) for n, f in flags.items()],
                         complete.alias("complete"))


def change_feed(merged: DataFrame) -> DataFrame:
    """Complete records as update envelopes, with both keys."""
    return (completeness(merged).filter("complete")
            .select(F.lit("intelligence_update").alias("type"), *KEYS,
                    F.struct(*KEYS, *KINDS, "last_updated").alias("data")))

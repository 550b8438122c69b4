"""JSON texts as Variant values: presence, types and defaults of fields.

A field that is absent, a field that is null and a field of another type are
three different things in the contract; Variant keeps them apart without Python.
``with_fields`` splits a document into a struct of Variants. The small functions
below it give SQL text for a field of such a struct: the checks of a record are
hundreds of expressions, and as text they are handed over in one call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that count as booleans.
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")


def whole_json(text: Column) -> Column:
    """The one JSON value a text consists of; null if it is anything else.

    ``try_parse_json`` accepts text after the value. In brackets, such a text is
    not JSON any more, and two values in a row show up as a second element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    first = F.try_variant_get(wrapped, "$[0]", "variant")
    second = F.try_variant_get(wrapped, "$[1]", "variant")
    return F.when(second.isNull(), first)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    Later filters on columns made from it would otherwise be pushed below and
    repeat it in every place it is used. A one-element explode stops that.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def with_fields(df: DataFrame, name: str, text: Column, fields: Sequence[str],
                first_of_list: bool = False) -> DataFrame:
    """Add the fields of a JSON object as a struct of Variants, parsed once per row.

    The struct is null if the text is not one JSON object. With ``first_of_list``
    the first element stands for a list that has one. Looking into the struct is
    much cheaper than looking into the document for every check.
    """
    kind = f"struct<{', '.join(f'{f}: variant' for f in fields)}>"

    def pick(wrapped: Column) -> Column:
        one = F.try_variant_get(wrapped, "$[0]", kind)
        if first_of_list:
            one = F.coalesce(F.try_variant_get(wrapped, "$[0][0]", kind), F.when(
                F.try_variant_get(wrapped, "$[0][0]", "variant").isNull(), one))
        return F.when(F.try_variant_get(wrapped, "$[1]", "variant").isNull(), one)

    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return df.select("*", F.explode_outer(F.transform(F.array(wrapped), pick)).alias(name))


def quoted(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def get(doc: str, name: str, kind: str) -> str:
    return f"try_variant_get({doc}.{name}, '$', '{kind}')"


def field(doc: str, name: str) -> str:
    """A field as Variant: SQL null if absent, a Variant null if it is null."""
    return f"{doc}.{name}"


def string(doc: str, name: str) -> str:
    return get(doc, name, "string")


def type_of(value: str) -> str:
    return f"coalesce(schema_of_variant({value}), 'ABSENT')"


def present(doc: str, name: str) -> str:
    return f"({field(doc, name)} IS NOT NULL)"


def absent(doc: str, name: str) -> str:
    return f"({field(doc, name)} IS NULL)"


def missing_or_null(doc: str, name: str) -> str:
    """Absent, or present and null."""
    return f"({type_of(field(doc, name))} IN ('ABSENT', 'VOID'))"


def is_string(doc: str, name: str) -> str:
    return f"({type_of(field(doc, name))} = 'STRING')"


def number(doc: str, name: str) -> str:
    """Number, or text that holds one."""
    return (f"CASE WHEN {type_of(field(doc, name))} <> 'BOOLEAN' "
            f"THEN {get(doc, name, 'double')} END")


def boolean(doc: str, name: str) -> str:
    """True/false, 0/1, or one of the accepted texts; null otherwise."""
    text = f"lower({string(doc, name)})"
    return (f"CASE WHEN {text} IN ({quoted(TRUE_TEXTS)}) THEN true "
            f"WHEN {text} IN ({quoted(FALSE_TEXTS)}) THEN false END")


def strings(doc: str, name: str) -> str:
    """List of texts; null if the field is not exactly that."""
    items = get(doc, name, "array<string>")
    return (f"CASE WHEN {type_of(field(doc, name))} IN ('ARRAY<STRING>', 'ARRAY<VOID>') "
            f"AND forall({items}, x -> x IS NOT NULL) THEN {items} END")


def typed(doc: str, name: str, kind: str) -> str:
    """A field as a value of the SQL type ``kind``; no list is an empty list."""
    return {"boolean": boolean(doc, name), "double": number(doc, name),
            "array<string>": f"coalesce({strings(doc, name)}, array())",
            "string": string(doc, name)}[kind]


def first_error(*checks: tuple[str, str]) -> str:
    """Message of the first failed check, null if all hold.

    A check that is null (a comparison with a missing value) counts as failed.
    """
    cases = " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{message}'" for ok, message in checks)
    return f"CASE {cases} END"

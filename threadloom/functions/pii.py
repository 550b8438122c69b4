"""Personal data in text: detection with character offsets, and redaction.

All of it is built-in expressions, so it runs inside the scan stage. A text is searched once,
for any of the three patterns; most texts end there. The others are rewritten with a mark
around every part of a match. The k-th mark stands k places further on than in the text, so
its place among the characters gives the offset without adding up lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.spans import characters, let, replaced, union
from threadloom.functions.text import SPACE, strip
from threadloom.schema import REDACTED

# The three patterns. Word characters are letters, numbers and "_" of
# any script, so the word boundaries are spelled out.
WORD = r"[\p{L}\p{N}_]"
PHONE = rf"(?U)(?<!{WORD})\d{{8,15}}(?!{WORD})"
ACCOUNT = rf"(?iU)(account{SPACE}+(?:number{SPACE}+)?(?:ending{SPACE}+)?)(\d+)"
NAME = r"(My name is )([A-Z][a-z]+ [A-Z][a-z]+)"

SPAN = "array<struct<type:string,value:string,start_index:int,end_index:int>>"

# The three as one search. Digits after a label are a phone as well if they could stand alone.
# A name may end in the label of an account ("My name is Ann Account 5"); so what follows a
# name is looked at too, the label being partly behind.
_DIGITS = rf"(?:(\d{{8,15}})(?!{WORD})|(\d+))"
_NUMBER, _ENDING = rf"(?:number{SPACE}+)?", rf"(?:ending{SPACE}+)?"
_REST = (rf"(?<=account){SPACE}+{_NUMBER}{_ENDING}|(?<=account number){SPACE}+{_ENDING}"
         rf"|(?<=account ending){SPACE}+")
ANY = (rf"(?iU:(account{SPACE}+{_NUMBER}{_ENDING}){_DIGITS})"
       rf"|(?U:(?<!{WORD})(\d{{8,15}})(?!{WORD}))"
       rf"|(My name is )([A-Z][a-z]+ [A-Z][a-z]+)(?iU:({_REST}){_DIGITS})?")
# Not a character: texts have none, and one that does loses nothing but this code point.
MARK, OTHER, PARTS = "\ufdd0", "\ufdd1", 9
MARKED = "".join(f"${i}{MARK}" for i in range(1, PARTS + 1))
# Parts between two marks by kind: (first mark, last mark).
PHONES, ACCOUNTS, NAMES = ((0, 1), (2, 3), (6, 7)), ((0, 2), (6, 8)), ((4, 5),)


def _places(text: Column) -> Column:
    """Offsets of the marks, ``PARTS`` for each match."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(ANY), F.lit(MARKED))
    found = F.filter(F.transform(characters(marked), lambda c, i: F.when(c == MARK, i)),
                     lambda i: i.isNotNull())
    return F.transform(found, lambda at, k: at - k)


def _entities(places: Column) -> Column:
    """Entities of a text from the places of its marks: phones, then accounts, then names."""
    def of_kind(kind: str, parts: tuple) -> Column:
        def spans(m: Column) -> Column:
            def place(j: int) -> Column:
                return F.get(places, m * PARTS + j)

            return F.filter(F.array(*[F.struct(
                F.lit(kind).alias("type"), F.lit(REDACTED).alias("value"),
                place(a).alias("start_index"), place(b).alias("end_index")) for a, b in parts]),
                lambda e: e["start_index"] < e["end_index"])

        return F.flatten(F.transform(F.sequence(
            F.lit(0), (F.size(places) / PARTS).cast("int") - 1), spans))

    return F.concat(of_kind("phone", PHONES), of_kind("account_number", ACCOUNTS),
                    of_kind("name", NAMES)).cast(SPAN)


def pii(text: Column) -> Column:
    """``entities`` and ``redacted_text`` of the trimmed text, from one search."""
    def found(t: Column) -> Column:
        def rebuilt(entities: Column) -> Column:
            clean = let(characters(t), lambda chars: let(
                union(entities, F.size(chars)), lambda u: replaced(chars, u, REDACTED)))
            return F.struct(entities.alias("entities"), clean.alias("redacted_text"))

        nothing = F.struct(F.array().cast(SPAN).alias("entities"), t.alias("redacted_text"))
        return F.when(F.rlike(t, F.lit(ANY)), let(let(_places(t), _entities), rebuilt)).otherwise(
            F.when(t.isNotNull(), nothing))

    return let(strip(text), found)


def pii_entities(text: Column) -> Column:
    """Entities of the trimmed text: phones, then accounts, then names; none for null."""
    return let(strip(text), lambda t: F.when(
        F.rlike(t, F.lit(ANY)), let(_places(t), _entities)).otherwise(F.array().cast(SPAN)))


def redacted(text: Column) -> Column:
    """The trimmed text with every entity replaced once.

    Phone first: an account number of 8 to 15 digits is a phone too, and once
    replaced it matches nothing else.
    """
    t = F.regexp_replace(strip(text), PHONE, REDACTED)
    t = F.regexp_replace(t, ACCOUNT, "$1" + REDACTED)
    return F.regexp_replace(t, NAME, "$1" + REDACTED)


def has_pii(text: Column) -> Column:
    return F.rlike(strip(text), F.lit(ANY))

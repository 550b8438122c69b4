import random
import re
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions.pii import has_pii, pii_entities, redacted
from threadloom.operators.pii import detect_pii, redact_spans

CASES = [
    ("call 12345678 now", [("phone", 5, 13)], "call [REDACTED] now"),
    ("Account number ending 4421", [("account_number", 22, 26)],
     "Account number ending [REDACTED]"),
    ("My name is Ann Lee.", [("name", 11, 18)], "My name is [REDACTED]."),
    ("account 123456789 ok", [("phone", 8, 17), ("account_number", 8, 17)],
     "account [REDACTED] ok"),
    ("account ending in 4421", [], "account ending in 4421"),
    ("My name is Sarah", [], "My name is Sarah"),
    ("1234567", [], "1234567"),
    ("  12345678", [("phone", 0, 8)], "[REDACTED]"),
    ("", [], ""),
    ("12345678 and 123456789012345, not 1234567890123456",
     [("phone", 0, 8), ("phone", 13, 28)], "[REDACTED] and [REDACTED], not 1234567890123456"),
    ("é 12345678é 87654321", [("phone", 12, 20)], "é 12345678é [REDACTED]"),
    (" tel ١٢٣٤٥٦٧٨ ", [("phone", 4, 12)],
     "tel [REDACTED]"),
    ("ACCOUNT  Number 7, account 8", [("account_number", 16, 17), ("account_number", 27, 28)],
     "ACCOUNT  Number [REDACTED], account [REDACTED]"),
]
# The patterns as the contract has them.
PATTERNS = [("phone", re.compile(r"\b\d{8,15}\b"), 0),
            ("account_number",
             re.compile(r"account\s+(?:number\s+)?(?:ending\s+)?(\d+)", re.I), 1),
            ("name", re.compile(r"My name is ([A-Z][a-z]+ [A-Z][a-z]+)"), 1)]


def by_hand(text):
    t = text.strip()
    found = [(kind, m.start(g), m.end(g)) for kind, p, g in PATTERNS for m in p.finditer(t)]
    pieces, at = [], 0
    for start, end in sorted({(s, e) for _, s, e in found}):
        if start >= at:
            pieces += [t[at:start], "[REDACTED]"]
        at = max(at, end)
    out = "".join(pieces) + t[at:]
    return found, out


def detect(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", pii_entities(F.col("text")).alias("e"),
                     redacted(F.col("text")).alias("r"), has_pii(F.col("text")).alias("h"))
    return [([(e["type"], e["start_index"], e["end_index"]) for e in row["e"]], row["r"], row["h"])
            for row in rows.orderBy("i").collect()]


def test_sentences(spark):
    got = detect(spark, [c[0] for c in CASES])
    for (text, spans, clean), (found, out, flag) in zip(CASES, got):
        assert found == spans, text
        assert out == clean, text
        assert flag == bool(spans), text


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_match_a_direct_search(spark, seed):
    rng = random.Random(seed)
    parts = ["account", "Account ", "number ", " ending ", "12345678", "99", " ", "My name is ",
             "Ann Lee", "Bo ", "x", "_", "\n", "é", " ", "1234567890123456", ". ", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for text, (found, out, flag) in zip(texts, detect(spark, texts)):
        spans, clean = by_hand(text)
        assert found == spans, repr(text)
        assert out == clean, repr(text)
        assert flag == bool(spans)


def test_labels_inside_names_and_marks_in_texts(spark):
    texts = ["My name is Ann Account 123", "My name is Ann Fooaccount number ending 12345678 x",
             "My name is Account Ending 123456789", "My name is Account Number ending 5",
             "My name is Bo Account 12345678é", "account 5My name is Ann Lee", "account 12345678My",
             "My name is My name is Ann Lee", "My name is Joe My name is Bo Li", "\ufdd0 12345678 \ufdd0",
             "account account 7", "a\U0001f600 12345678 \U0001f600", "account number account 9"]
    for text, (found, out, flag) in zip(texts, detect(spark, texts)):
        spans, clean = by_hand(text)
        assert found == spans, repr(text)
        assert out == clean, repr(text)
        assert flag == bool(spans)


def one_pass(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, message string")
    return [(r["entities"], r["redacted_text"], r["has_pii"])
            for r in detect_pii(df).orderBy("i").collect()]


@pytest.mark.parametrize("seed", [3, 4])
def test_operator_matches_a_direct_search(spark, seed):
    rng = random.Random(seed)
    parts = ["Account", "account ", "Number ", " ending ", "12345678", "99", " ", "My name is ",
             "Ann ", "Lee", "Myaccount", "x", "_", "é", "My ", ". ", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts.append(None)
    for text, (found, out, flag) in zip(texts, one_pass(spark, texts)):
        spans, clean = by_hand(text) if text is not None else ([], None)
        assert [(e["type"], e["start_index"], e["end_index"]) for e in found] == spans, repr(text)
        assert out == clean and flag == bool(spans)


def test_one_search_in_the_plan_and_long_texts(spark, capsys):
    text = "call 12345678 or account 9, " * 50_000
    start = time.time()
    found, out, _ = one_pass(spark, [text])[0]
    assert time.time() - start < 30
    assert len(found) == 100_000 and out.count("[REDACTED]") == 100_000
    assert (found[49_999]["start_index"], found[50_000]["start_index"]) == (28 * 49_999 + 5, 25)
    detect_pii(spark.createDataFrame([("x",)], "message string")).explain()
    plan = capsys.readouterr().out
    assert plan.count("rlike") + plan.count("RLIKE") == 1 and plan.count("regexp_replace(") == 1


def spans_by_hand(text, spans):
    hit = [False] * len(text)
    starts = set()
    real = sorted((max(s, 0), min(e, len(text))) for s, e in spans if s is not None and e is not None)
    end = 0
    for s, e in real:
        if s < e:
            if s >= end:
                starts.add(s)
            end = max(end, e)
            hit[s:e] = [True] * (e - s)
    return "".join("[REDACTED]" if i in starts else "" if hit[i] else c for i, c in enumerate(text))


def test_spans_of_a_model(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(300):
        text = "".join(rng.choice("ab é\n\U0001f600") for _ in range(rng.randint(0, 30)))
        spans = [(rng.randint(-5, 35), rng.randint(-5, 40)) for _ in range(rng.randint(0, 8))]
        spans += [(None, 3)] if rng.random() < .2 else []
        cases.append((text, spans))
    rows = [(i, t, [{"start_index": s, "end_index": e} for s, e in spans])
            for i, (t, spans) in enumerate(cases)]
    rows += [(1000, None, [{"start_index": 0, "end_index": 1}]), (1001, "kept", None),
             (1002, "kept", [None])]
    df = spark.createDataFrame(rows, "i int, message string, "
                               "entities array<struct<start_index:int,end_index:bigint>>")
    got = {r["i"]: r["redacted_text"] for r in redact_spans(df).collect()}
    for i, (text, spans) in enumerate(cases):
        assert got[i] == spans_by_hand(text, spans), (text, spans)
    assert (got[1000], got[1001], got[1002]) == (None, "kept", "kept")


def test_many_spans_in_one_text(spark):
    text = "0123456789" * 100_000
    spans = [(i * 97 % 1_000_000, i * 97 % 1_000_000 + 5 + i % 40) for i in range(10_000)]
    df = spark.createDataFrame([(text, [{"start_index": s, "end_index": e} for s, e in spans])],
                               "message string, entities array<struct<start_index:int,end_index:int>>")
    start = time.time()
    got = redact_spans(df).first()["redacted_text"]
    assert time.time() - start < 30
    assert got == spans_by_hand(text, spans)

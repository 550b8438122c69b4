"""Whitening, the prefix trie and repetition rules: brute force, exactness, odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime
from fractions import Fraction
from itertools import accumulate
from operator import xor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import prefixes, repeats, whitening
from threadloom.llm.catalog import QUERIES
from threadloom.llm.tables import table
from threadloom.operators.timeline import Timeline

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- whitening -----------------------------------------------------------------

def _spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.asarray(values)) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 64), np.r_[np.ones(32), np.full(32, 5)], 10.0 ** -np.arange(40),
    np.r_[1 + 1e-9 * np.arange(20), 5 + 1e-12 * np.arange(20)], np.zeros(6), np.full(5, 7.0),
    [3, 3, 1, 0, 0, 0]])
def test_eigenvectors_to_double_precision(values):
    a = np.asarray(_spectrum(values), np.longdouble)
    a = (a + a.T) / 2
    value, x = whitening.eigen(a)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17
    assert np.abs(a @ x - x * value).max() <= 1e-15 * max(np.abs(a).max(), 1e-300)
    assert (np.diff(value) <= 1e-18 * max(value.max(), 1)).all()


def test_refinement_beats_its_first_guess():
    a = _spectrum(np.linspace(1, 2, 32))
    guess = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    def error(x):
        s = np.asarray(x, float).T @ a @ np.asarray(x, float)
        return np.abs(s - np.diag(np.diag(s))).max()
    assert error(guess) > 1e-9 > 1e5 * error(whitening.eigen(a)[1])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-2**52, 2**52)] * 3), max_size=20))
def test_products_are_exact(rows):
    x = np.array(rows, np.int64).reshape(-1, 3)
    exact = [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    assert whitening.exact_products(x).tolist() == exact
    assert whitening.exact_sums(x) == [sum(r[i] for r in rows) for i in range(3)]


def _whitened(rows):
    """What the query returns, from fractions and numpy: by component the values, deviations."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    centred = [[Fraction(n * c - t, n) for c, t in zip(v, s)] for v in x]
    d = len(s)
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)]
                  for i in range(d)])
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value)
    points = np.array([[float(c) for c in r] for r in centred])
    return deviation, points @ vector[:, order] / np.sqrt(value[order]), value[order] / np.trace(v)


def test_whitening_matches_brute_force(spark):
    found = table(spark, SF, "embeddings").collect()
    usable = [r for r in found if r.embedding is not None
              and all(c is not None and np.isfinite(c) for c in r.embedding)]
    deviation, values, explained = _whitened([r.embedding for r in usable])
    got = defaultdict(dict)
    for r in QUERIES["op11_whitening"](spark, SF).collect():
        got[r.vec_id][r.component] = r
    assert len(got) == len(usable)
    for k in range(8):
        column = np.array([got[r.vec_id][k + 1].whitened for r in usable])
        expected = values[:, k] * (1 if column @ values[:, k] > 0 else -1)
        np.testing.assert_allclose(column, expected, atol=1e-9)
    for r, d in zip(usable, deviation):
        one = got[r.vec_id]
        assert sorted(one) == list(range(1, 9))
        assert all(x.deviation == d and x.n == len(usable) and x.identity_error < 1e-12
                   for x in one.values())
        assert one[3].explained == pytest.approx(explained[2], rel=1e-12)


def test_whitening_of_odd_vectors(spark):
    rng = random.Random(3)
    good = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(30)]
    rows = [*good, good[0], (None, [0.5, 0.5, 0.5]), (90, []), (91, [0.25]), (92, None),
            (93, [1.0, None, 2.0]), (94, [float("nan"), 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "vec_id int, embedding array<double>, n int, key string")
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * 34 and {r.component for r in got} == {1, 2, 3}
    assert {r.n for r in got} == {34} and got[0].identity_error < 1e-12
    assert {r.vec_id for r in got} == {*range(30), None, 90, 91}
    filled = {r.vec_id: r.whitened for r in got if r.component == 1}
    same = whitening.whiten(df.where("vec_id <> 90").unionByName(spark.createDataFrame(
        [(90, [0.0, 0.0, 0.0], 1, "x")], df.schema))).collect()
    assert len(same) == 3 * 33 and filled[90] is not None


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error)
            for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = whitening.whiten(spark.createDataFrame(
        [(i, [float(i), 2.0 * i]) for i in range(9)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert line[0].identity_error < 1e-12
    far = whitening.whiten(spark.createDataFrame(
        [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [3e9, 2.0])], "vec_id int, embedding array<double>"))
    assert {r.deviation for r in far.where("vec_id = 1").collect()} == {None}


# -- prefix trie ---------------------------------------------------------------

def _trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda e: e[0])
    built = {}
    for conv, own in convs.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = convs.get(conv - int(math.fmod(conv, 20)), [])
        built[conv] = tuple(e[1:] for e in [*base[:h], *own[h:]])
    members, children = defaultdict(list), defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        parts = [below[c] for c in children[node]]
        words = len(WORD.findall(node[-1][1])) if node else 0
        below[node] = (sum(p[0] for p in parts) if parts else 1,
                       (len(members[node]) - 1) * words + sum(p[1] for p in parts))
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=60))
def test_centroid_sums(steps):
    parent = [max(i - 1 - back, -1) if back else i - 1 for i, (back, _) in enumerate(steps)]
    values = [(x, 1) for _, x in steps]
    expected = [list(v) for v in values]
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            for k in (0, 1):
                expected[parent[i]][k] += expected[i][k]
    assert [list(s) for s in prefixes.centroid_sums(parent, values)] == expected


def test_centroid_sums_of_a_long_chain():
    n = 20_000
    assert prefixes.centroid_sums([i - 1 for i in range(n)], [(1,)] * n) == [
        (n - i,) for i in range(n)]


def test_trie_matches_brute_force(spark):
    conversations = table(spark, SF, "conversations")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_prefix_trie"](spark, SF).collect()]
    assert sorted(got, key=lambda r: r[:2]) == _trie(rows)


@pytest.mark.parametrize("least, rows_per_task", [(4096, 200_000), (10, 20)])
def test_trie_of_odd_conversations(spark, least, rows_per_task):
    """One very long, snapshots after every turn, one very common, turnless ones, nulls."""
    rng = random.Random(5)
    rows = [(1, i, "u", f"w {i}") for i in range(200)]
    rows += [(100 + k, i, "u", f"s {i}") for k in range(30) for i in range(k)]
    rows += [(1000 + k, i, "u", f"same\t{i}") for k in range(150) for i in range(4)]
    rows += [(5000 + k, None if i == 0 else i, None if k % 2 else "a", f"x {rng.randint(0, 2)}")
             for k in range(60) for i in range(rng.randint(0, 6))]
    rows += [(None, 1, "u", "no id"), (-7, 1, "u", "negative"), (-27, 0, None, None),
             (-20, 0, "q", "base"), (9000, 1, "u", "twice"), (9000, 1, "u", "twice")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, "
                               "text string, depth int, a string").repartition(3)
    got = [tuple(r) for r in prefixes.trie(df, least, rows_per_task).collect()]
    assert sorted(got, key=lambda r: r[:2]) == _trie(rows)


def test_names_of_prefixes_over_cut_conversations(spark):
    """The exclusive or so far is the same for any cut, and is what the rows give."""
    rows = [(c, datetime(2025, 1, 1, 0, i // 3), i, hash((c, i))) for c in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, ts timestamp, seq long, g long")
    whole = Timeline(keys=("conv_id",))
    for timeline in (whole, whole.measured(df, 7), whole.measured(df, 7, 7)):
        got = timeline.running(df, {"s": prefixes._xor(F.col("g"))}).orderBy("conv_id", "seq").collect()
        for c in range(3):
            mine = [r for r in got if r.conv_id == c]
            assert [r.s for r in mine] == list(accumulate((r.g for r in mine), xor))


def test_trie_of_nothing_and_of_equal_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixes.trie(spark.createDataFrame([], schema)).count() == 0
    # turns at one place: some order, the same for all conversations that have them
    rows = [(20 * c, 1, "u", t) for c in range(1, 9) for t in ("one", "two", "three")]
    got = prefixes.trie(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and {r.n_convs for r in got} == {8}


# -- repetition ----------------------------------------------------------------

def _base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1
               for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def _longest(words, i):
    return max((next((k for k in range(len(words)) if i + k >= len(words) or j + k >= len(words)
                      or words[i + k] != words[j + k]), 0)
                for j in range(len(words)) if j != i), default=0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "é", "a\n", "#*", "\U0001f600"]),
                                              max_size=40).map(" ".join)), max_size=4))
def test_repeats_match_brute_force(texts):
    m = repeats.measures(texts)
    for i, text in enumerate(texts):
        assert tuple(m.iloc[i][:5]) == _base(text)
    code, _, counts, _ = repeats.words_of(texts)
    length = repeats.repeat_lengths(code, counts, 1)
    expected = [_longest(words, i) for words in (WORD.findall(t or "") for t in texts)
                for i in range(len(words))]
    assert length.tolist() == expected


def test_repetition_of_whole_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op13_repeats"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r.base_failed and r.kept)


def test_verdict_and_odd_texts(spark):
    rng = random.Random(1)
    def words(n):
        return " ".join(f"w{rng.randint(0, 10 ** 9)}" for _ in range(n))
    passage, wide = words(60), " ".join("x" * 40 + str(i) for i in range(12))
    texts = {"clean": words(500), "long": f"{words(200)} {passage} {words(200)} {passage}",
             "light": f"{words(900)} {passage} {words(900)} {passage}",
             "wide": f"{wide} {words(60)} {wide}", "short": words(5), "none": None, "empty": "",
             "blank": " \n\t", "same": "again " * 50_000, "lines": "a b\na b\r\n\na b"}
    df = spark.createDataFrame([(k, t, "x", True) for k, t in texts.items()] * 2,
                               "doc_id string, text string, repetition string, kept boolean")
    rows = repeats.judge(df).collect()
    assert len(rows) == 2 * len(texts)
    by = {r.doc_id: r for r in rows}
    assert {k for k, r in by.items() if r.kept} == {"clean", "light"}
    # the base rule lets these pass; one long repeat and many covered characters don't
    assert not by["long"].base_failed and by["long"].repetition.longest_repeat == 60
    assert not by["wide"].base_failed and by["wide"].repetition.covered_words == 24
    assert by["same"].repetition.n_repeat_words == 50_000
    assert by["same"].repetition.longest_repeat == 49_999
    assert by["lines"].repetition.n_dup_lines == 1
    first = by["long"].repetition.repeats
    assert [(s.start, s.length) for s in first] == [(200, 60), (460, 60)]
    assert repeats.judge(df.limit(0)).count() == 0

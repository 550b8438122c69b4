"""Operators on documents: brute force, exact round trips, held-out accuracy, odd inputs."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import bpe, jaccard, languages, packing, pretokens, quality, spots
from threadloom.llm.catalog import QUERIES
from threadloom.llm.tables import Parts, components, table

SF = "/root/testdata/sf0.001"
RANKS = pretokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
CODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS,
                          special_tokens={})
LONG = "word and other words " * 20_000
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "don't  we'll\u3000x²½ 1\x1c2 😀́"), (4, "again"),
       (5, "same text here, one two three four"), (6, "same text here, one two three four"),
       (7, LONG), (8, "'s's 're!!''"), (None, "no key at all"), (-3, "<|endoftext|> é\r\n")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeats, and columns whose names clash."""
    rows = [(i, t, "x", 0.5, i, 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, score double, "
                                       "part bigint, n int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]),
                                  st.sampled_from(" '\n\t\u3000\x1csrtveml1²a"))), max_size=5))
def test_pretokens_are_those_of_the_pattern(texts):
    coded, counts = pretokens.pretokenize(texts, pretokens.classes())
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    merge, at = pretokens.merger(RANKS), 0
    for text, n in zip(texts, counts):
        ids = [i for k in index[at:at + n] for i in merge(words[k])]
        at += n
        assert ids == CODER.encode_ordinary(text)


def test_pretokens_are_found_piece_by_piece():
    """The same for any piece, and without arrays over all characters at once."""
    kinds, texts = pretokens.classes(), [t for _, t in ODD]
    whole, counts = pretokens.pretokenize(texts, kinds, 1 << 30)
    for piece in (1, 30):
        coded, n = pretokens.pretokenize(texts, kinds, piece)
        assert coded.indices.equals(whole.indices) and coded.dictionary.equals(whole.dictionary)
        assert n.tolist() == counts.tolist()
    texts = [f"word{i % 977} it's {i} " * 10 for i in range(10_000)]
    tracemalloc.start()
    try:
        pretokens.pretokenize(texts, kinds)
        assert tracemalloc.get_traced_memory()[1] < 8 * sum(map(len, texts))
    finally:
        tracemalloc.stop()


def test_bpe_round_trip(odd, none):
    for chunk in (10, 1 << 20):
        rows = bpe.decode(bpe.encode(odd, RANKS, chunk=chunk), RANKS).collect()
        expected = [(i, CODER.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD]
        got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in rows]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0


def test_decode_of_unknown_and_null_ids(spark):
    df = spark.createDataFrame([(1, [0, None, 10**6, -1, 1]), (2, None), (3, [])],
                               "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, RANKS).collect()}
    assert got == {1: CODER.decode_bytes([0, 1]), 2: None, 3: b""}


def test_spots(odd, none):
    rows = spots.compare_neighbours(odd).collect()
    by = sorted(((i, t or "") for i, t in ODD), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    assert len(rows) == len(ODD)
    named = defaultdict(set)
    for (i, text), (_, following) in zip(by, by[1:] + by[:1]):
        if i == 4 or following == "again" or text == "again":
            continue  # two rows with one key: their order is that of a hash
        row, = (r for r in rows if r.doc_id == i)
        changed = spots.edited(text, following)
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.near_next == spots.likeness(spots.signatures(text), spots.signatures(following))
        named[row.fingerprint].add(text)
    assert all(len(texts) == 1 for texts in named.values())
    assert spots.compare_neighbours(none).count() == 0


def test_spot_pairs_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    sets = {r.doc_id: spots.signatures(r.text) for r in docs.collect()}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i].tobytes(), i)
    ids = sorted(i for k, i in least.items() if k)
    expected = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
                if spots.likeness(sets[a], sets[b]) >= 0.6}
    got = {(r.a, r.b) for r in spots.near_pairs(docs, 0.6).collect()}
    assert got == expected and expected


def test_languages(spark, odd, none):
    rows = QUERIES["op3_language_codes"](spark, SF).collect()
    langs = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in held]) > 0.97
    model = languages.fit(table(spark, SF, "documents"))
    said = languages.predict(odd, model).collect()
    assert len(said) == len(ODD) and all(0 <= r.score <= 1 for r in said)
    assert {r.text for r in said if r.lang_pred == "und"} == {None, "", "   \n\t "}
    empty = languages.fit(table(spark, SF, "documents").limit(0))
    assert {r.lang_pred for r in languages.predict(odd, empty).collect()} == {"und"}
    assert languages.predict(none, model).count() == 0


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_codewords_are_apart_and_decoded(n):
    code = languages.codewords(n)
    apart = (code[:, None] != code[None]).sum(2)
    assert apart[~np.eye(n, dtype=bool)].min() >= 1
    odds = languages.decode(3 * code, code, np.full(code.shape[1], 1 / code.shape[1]))
    assert (odds.argmax(1) == np.arange(n)).all()


def test_quality(spark, odd, none):
    rows = QUERIES["op6_boosted_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (None, 1), (7, None)],
                                   "doc_id bigint, quality int")
    got = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    blank = quality.score(odd, quality.fit(none, labels.limit(0))).collect()
    assert {r.score for r in blank} == {0.5}


def test_trees_learn_a_step():
    x = np.random.default_rng(0).normal(size=(2000, 3))
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    assert ((quality.walk(quality.grow(x, y), x) > 0.5) == y).mean() > 0.97


def check_pieces(rows, docs):
    whole, places = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(whole) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = CODER.encode_ordinary(text or "") + [1], 0
        for r in sorted(whole[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for sequence in places.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(length for s in places.values() for _, length in s) > 2048 * (len(places) - 1)


def test_packing(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    check_pieces(QUERIES["op5_curve_packing"](spark, SF).collect(), docs)
    ranks = packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    assert ranks == {k: v for k, v in RANKS.items()}
    pieces = packing.pack(odd, ranks).collect()
    total = sum(len(CODER.encode_ordinary(t or "")) + 1 for _, t in ODD)
    assert sum(r.length for r in pieces) == total
    assert packing.pack(none, ranks).count() == 0


def test_packing_has_the_ids_of_the_tokenizer(spark, tmp_path):
    """As the query packs: added tokens in a text have their own ids."""
    path, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    coder = tokenizers.Tokenizer.from_file(path)
    draw = random.Random(6)
    texts = [None, "", end, end * 2, f"a{end}b", f" a {end} b  {end}\n", f"don{end}'t", "<|endoftext", f"<|{end}|>",
             *("".join(draw.choice([end, "<|", " ", "x", "'s", "é\n", "1 ", "word "]) for _ in range(draw.randrange(30)))
               for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    for run in (QUERIES["op5_curve_packing"](spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        pieces = defaultdict(list)
        for r in run.collect():
            pieces[r.doc_id].append(r)
        for i, text in enumerate(texts):
            ids, at = coder.encode(text or "", add_special_tokens=False).ids + [1], 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                data = np.array(ids[at:at + r.length], "<u4").tobytes()
                assert r.start == at and r.doc_tokens == len(ids), text
                assert (r.ids_crc32 == zlib.crc32(data) if "ids_crc32" in r else bytes(r.ids) == data), text
                at += r.length
            assert at == len(ids)
        places = sorted((r.sequence_id, r.offset, r.length) for rows in pieces.values() for r in rows)
        at = 0
        for sequence, offset, length in places:
            assert sequence * 2048 + offset == at
            at += length


def test_packing_remembers_ids_as_bytes(spark, monkeypatch):
    """Ids are remembered as bytes, not as lists of numbers to flatten; and ids beyond 16 bits stay whole."""
    def lists(*_):
        raise AssertionError("ids went through lists of numbers")

    # what a task runs, in this process: a worker has modules of its own
    monkeypatch.setattr(pretokens, "flatten", lists)
    shift = 1 << 16
    wide = {token: rank + shift for token, rank in RANKS.items()}
    assert packing.id_bytes(wide, None) == 4 and packing.id_bytes(RANKS, None) == 2
    texts = [None, "", "two words", "é" * 9, "x1 " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: task)
    for ranks, kind, more in ((RANKS, "<u2", 0), (wide, "<u4", shift)):
        for out in packing.tokenized(docs, ranks)(iter([batch])):
            for r in out.to_pylist():
                want = [i + more for i in CODER.encode_ordinary(texts[r["key"]] or "")] + [1]
                assert np.frombuffer(r["ids"], kind).tolist() == want and r["n"] == len(want)


def test_hilbert_curve_takes_single_steps():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    walked = cells[np.argsort(packing.hilbert(cells, 3))]
    assert sorted(packing.hilbert(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()


def by_force(docs, percent=75):
    """Set sizes and smallest reachable keys, from all pairs."""
    sets = {}
    for i, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\v\f\r":
            lowered = lowered.replace(c, " ")
        words = [w for w in lowered.split(" ") if w]
        sets[i] = ({tuple(words[k:k + 5]) for k in range(len(words) - 4)} or {tuple(words)}) if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def grouped(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"most": 1500, "pivots": 3}])
def test_jaccard_matches_brute_force(spark, limits):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert grouped(jaccard.jaccard_groups(table(spark, SF, "documents"), **limits)) == by_force(docs)


def test_jaccard_chains_and_large_groups(spark):
    draw = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):  # a chain that drifts away from its start, with copies
        if draw.random() < 0.7:
            base = base[:]
            base[draw.randrange(len(base))] = f"x{draw.randrange(500)}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for limits in ({}, {"most": 700, "pivots": 4}):
        assert grouped(jaccard.jaccard_groups(docs, **limits)) == by_force(rows)


def test_jaccard_odd_rows(odd, none):
    rows = jaccard.jaccard_groups(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD)
    assert got[6].component_id == 5 and got[5].n_shingles == 3
    assert got[None].component_id is None and got[1].n_shingles == 0 and got[3].component_id == 3
    assert jaccard.jaccard_groups(none).count() == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 300)]
    edges += [(draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(300)]
    draw.shuffle(edges)
    got = {r.node: r.component for r in
           components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {i: root(i) for e in edges if e[0] != e[1] for i in e}


def test_parts_keep_neighbours_together(spark):
    rows = [(k % 40, k) for k in range(400)] + [(None, -1)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    parts = Parts(df, ["a", "b"], parts=6)
    dealt = parts.deal(df, guests=(-1, 1), wrap=True).collect()
    own = [r for r in dealt if r.guest == 0]
    assert sorted(((r.a, r.b) for r in own), key=str) == sorted(rows, key=str)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for p in {r.part for r in own}:
        mine = [order.index((r.a, r.b)) for r in own if r.part == p]
        before, = (order.index((r.a, r.b)) for r in dealt if r.part == p and r.guest == -1)
        assert before == (min(mine) - 1) % len(order)


def test_pipeline(spark):
    """Each stage against what it must keep; the whole as the stages one by one."""
    docs = table(spark, SF, "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.7 * len(before)
        if name == "n-gram Jaccard join":
            assert set(after) == {i for i, (_, c) in by_force(list(before.items())).items() if i == c}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(after) and {texts[i] for i in after} == set(after.values())


def templated(share, groups=60):
    """Groups of three near copies: one text all share, and a passage of their own."""
    draw = random.Random(1)
    template, rows = [f"w{draw.randrange(10 ** 8)}" for _ in range(300)], []
    for _ in range(groups):
        own = [f"w{draw.randrange(10 ** 8)}" for _ in range(int(300 * share))]
        for _ in range(3):
            changed = own[:]
            changed[draw.randrange(len(own))] = f"v{draw.randrange(10 ** 8)}"
            rows.append((len(rows), " ".join(template + changed)))
    return rows


@pytest.mark.parametrize("share", [0.8, 0.37])
def test_templated_texts_dont_multiply(spark, monkeypatch, share):
    """Unlinked documents of one template are near each other and every pivot."""
    rows, held, real = templated(share), [], jaccard.staged

    def counted(df, name):
        out = real(df, name)
        if name in ("members", "regions", "rare-regions"):
            held.append(out.agg(F.sum("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = grouped(jaccard.jaccard_groups(docs, most=1500, pivots=4))
    expected = by_force(rows)
    assert got == expected and len({c for _, c in expected.values()}) == 60
    assert max(held) < 2 * sum(n for n, _ in expected.values())


def test_keys_of_many_slices_are_packed_together():
    """A task sends a row per bucket, not one per bucket and slice."""
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(200)) for _ in range(40)]
    batches = [pa.RecordBatch.from_pydict({"key": list(range(k, k + 4)), "text": texts[k:k + 4]})
               for k in range(0, 40, 4)]
    none = np.zeros(0, np.uint64)
    hints = {"hash": none, "level": none, "word": none, "weight": none, "pivot_of": {}}
    rows = [r for b in jaccard.dealt(iter(batches), hints, 8, 5, 75) for r in b.to_pylist()]
    assert sorted(r["bucket"] for r in rows) == list(range(8))
    sets = [jaccard.shingle_sets([t])[0] for t in texts]
    assert sum(r["m"] for r in rows) == sum(len(s) - -(-75 * len(s) // 100) + 1 + int(0.05 * len(s))
                                            for s in sets)


def test_key_order_is_that_of_the_ranks(spark):
    """Rarest words first, then by hash, the same however texts are put together."""
    draw = random.Random(7)
    texts = [" ".join(draw.choice("a b c d e f g".split()) for _ in range(draw.randrange(60)))
             for _ in range(50)] + [None, "", "a"]
    words = sorted(jaccard.coded_words([w])[0][0] for w in "abc")
    hints = {"hash": np.zeros(0, np.uint64), "level": np.zeros(0, np.int64),
             "word": np.array(words, np.uint64), "weight": np.array([5, 3, 9])}

    def keys(some):
        distinct, at, counts = jaccard.coded_words(some)
        values, counts, weights = jaccard.weighed_sets(
            distinct, at, counts, jaccard._found(hints["word"], hints["weight"], distinct))
        owner, key = jaccard.keys_of(values, weights, counts, hints, 75)
        by_force = []
        for i, (c, e) in enumerate(zip(counts.tolist(), np.cumsum(counts).tolist())):
            ranks = sorted(zip(weights[e - c:e].tolist(), jaccard.mix(values[e - c:e]).tolist(),
                               values[e - c:e].tolist()))
            by_force += [(i, v) for _, _, v in ranks[:c - -(-75 * c // 100) + 1 + int(0.05 * c)] if c]
        assert list(zip(owner.tolist(), key.tolist())) == by_force
        return [set(key[owner == i].tolist()) for i in range(len(some))]

    assert keys(texts) == [keys([t])[0] for t in texts]


def test_chance_shingles_make_no_regions(spark, monkeypatch):
    """Documents that have runs of common words in common are no members of regions."""
    draw, rows, held, real = random.Random(5), [], [], jaccard.staged
    common = ["the", "of", "and", "to", "in"]
    for i in range(240):
        words = [draw.choice(common) if draw.random() < 0.75 else f"w{draw.randrange(10 ** 9)}"
                 for _ in range(150)]
        rows.append((2 * i, " ".join(words)))
        if i < 40:
            words[draw.randrange(150)] = "other"
            rows.append((2 * i + 1, " ".join(words)))

    def counted(df, name):
        out = real(df, name)
        if name == "members":
            held.append(out.agg(F.sum("n"), F.countDistinct("key")).first())
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    expected = by_force(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert grouped(jaccard.jaccard_groups(docs)) == expected
    assert sum(i != c for i, (_, c) in expected.items()) == 40
    assert held[0][1] <= 100 and held[0][0] < sum(n for n, _ in expected.values())


def test_a_poor_split_ends_in_blocks(spark):
    """Far fewer kinds of shingles than documents: no shingle is rare, pairs are compared."""
    draw = random.Random(4)
    rows = [(i, " ".join(str(draw.randrange(2)) for _ in range(40))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert grouped(jaccard.jaccard_groups(docs, most=300, pivots=2)) == by_force(rows)


def test_training_rows_are_bounded(spark):
    """One labelled id on many rows gives one row to learn from."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, None)],
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id bigint, quality int")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "grow", lambda x, y: seen.append((len(x), len(y))))
        quality.fit(docs, labels)
    assert seen == [(3, 3)]


CLASHING = ("doc_id bigint, text string, lang string, source string, score double, predicted int, "
            "lang_pred string, lang_ambiguous boolean, key string, n bigint, component_id bigint")


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents whose columns have the names the models use, with odd ids and texts."""
    texts = [(r.doc_id, r.text, r.lang) for r in table(spark, SF, "documents").collect()]
    texts += [(None, t, lang) for _, t, lang in texts[:3]] + [(texts[5][0], texts[9][1], texts[9][2])]
    texts += [(None, None, None), (None, "", "en"), (7, " \n", None), (8, LONG, None), texts[0], texts[0]]
    return spark.createDataFrame([(i, t, lang, "s", -7.0, -7, "xx", False, "k", -1, -2)
                                  for i, t, lang in texts], CLASHING)


def test_stages_overwrite_nothing(spark, clashing):
    rows = set(map(tuple, clashing.collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, clashing, SF)
        assert kept.schema == clashing.schema
        got = kept.collect()
        assert got and set(map(tuple, got)) <= rows
        assert stage(spark, clashing.limit(0), SF).count() == 0
    said = corpus_pipeline.known_language(spark, clashing, SF).collect()
    assert all(r.text and r.text.strip() for r in said)


def test_every_row_is_a_document_of_the_join(spark, clashing):
    rows = [tuple(r) for r in clashing.collect()]
    groups = by_force([(i, r[1]) for i, r in enumerate(rows)])
    kept = [tuple(r) for r in corpus_pipeline.one_of_each(spark, clashing, SF).collect()]
    by_group = defaultdict(list)
    for i, r in enumerate(rows):
        by_group[groups[i][1]].append(r)
    assert len(kept) == len(by_group)
    for same in by_group.values():
        least = min(same, key=lambda r: (r[0] is None, r[0] or 0))[0]
        assert sum(r in same and r[0] == least for r in kept) >= 1
    unlike = spark.createDataFrame([(1, "one two three four five six"), (1, "quite another text it is"),
                                    (None, "and a third one without id")], "doc_id bigint, text string")
    assert corpus_pipeline.one_of_each(spark, unlike, SF).count() == 3


def test_packed_takes_odd_rows(spark, clashing):
    pieces = corpus_pipeline.packed(spark, clashing, SF)
    total = sum(len(CODER.encode_ordinary(r.text or "")) + 1 for r in clashing.collect())
    assert pieces.agg(F.sum("length")).first()[0] == total
    assert corpus_pipeline.packed(spark, clashing.limit(0), SF).count() == 0


# -- the queries' own columns, value by value ----------------------------------

def test_bpe_columns_are_those_of_tiktoken(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op1_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = CODER.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def spots_by_hand(text):
    """Chains of a common word and the next two content words, as sets of texts."""
    words = [w for w in re.findall(r"\w+", text.lower())]
    found = set()
    for i, word in enumerate(words):
        if word in spots.COMMON:
            after = [w for w in words[i + 1:] if w not in spots.COMMON]
            if len(after) >= 2:
                found.add((word, after[0], after[1]))
    return found or ({tuple(words)} if words else {(text,)} if text else set())


def test_spot_columns_by_hand(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()),
                  reverse=True)
    got = {r.doc_id: r for r in QUERIES["op2_spot_signatures"](spark, SF).collect()}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        third = len(text) // 3
        changed = text[:len(text) - third] + following[:third] if third else text
        own, r = spots_by_hand(text), got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(own, spots_by_hand(changed)), abs=1e-12)
        assert r.near_next == pytest.approx(like(own, spots_by_hand(following)), abs=1e-12)


def test_codewords_chosen_one_by_one(spark):
    """Every prediction again, with loops over bits and languages."""
    docs = table(spark, SF, "documents")
    model = languages.fit(docs)
    said = {r.doc_id: r for r in languages.predict(docs, model).collect()}
    code, trust, bits = model["code"], model["trust"], model["code"].shape[1]
    for r in docs.collect()[::5]:
        got = said[r.doc_id]
        if got.lang_pred == "und":
            continue
        counts = languages.ngram_counts([r.text])[0]
        losses = []
        for word in code:
            loss = 0.0
            for bit in range(bits):
                margin = sum(float(counts[k]) * float(model["weights"][k, bit])
                             for k in np.flatnonzero(counts)) / counts.sum()
                loss += trust[bit] * bits * math.log1p(math.exp(
                    -languages.SHARPNESS * margin * word[bit]))
            losses.append(loss)
        odds = [math.exp(min(losses) - x) for x in losses]
        assert got.lang_pred == model["langs"][losses.index(min(losses))]
        assert got.score == pytest.approx(max(odds) / sum(odds), rel=1e-4)
        assert got.lang_ambiguous == (got.score < languages.AMBIGUOUS)


def test_trees_walked_and_split_one_by_one(monkeypatch):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(120, 4)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality.grow(x, y)

    def step(row):
        total = model["start"]
        for feature, limit, leaf in zip(model["feature"], model["limit"], model["leaf"]):
            node = 0
            while node < len(limit):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += leaf[node - len(limit)]
        return 1 / (1 + math.exp(-total))

    assert quality.walk(model, x) == pytest.approx([step(row) for row in x], abs=1e-12)
    # the first split: the best of all features and cuts, by gradients of the start
    start = 1 / (1 + math.exp(-model["start"]))
    slope, bend = start - y, np.full(len(y), start * (1 - start))

    def gain(side):
        if min(side.sum(), (~side).sum()) < quality.LEAST:
            return 0.0
        parts = [(slope[s].sum(), bend[s].sum()) for s in (side, ~side)]
        whole = slope.sum() ** 2 / (bend.sum() + quality.RIDGE)
        return sum(g * g / (h + quality.RIDGE) for g, h in parts) - whole

    best = max(gain(x[:, j] > cut) for j in range(4) for cut in np.unique(x[:, j]))
    chosen = gain(x[:, model["feature"][0, 0]] > model["limit"][0, 0])
    assert chosen == pytest.approx(best, rel=0.05) and chosen > 0


def test_spot_pairs_of_odd_rows(odd, none):
    pairs = [tuple(r)[:2] for r in spots.near_pairs(odd, 0.6).collect()]
    sets = {i: spots.signatures(t) for i, t in ODD if i is not None}
    assert all(a < b and spots.likeness(sets[a], sets[b]) >= 0.6 for a, b in pairs)
    assert spots.near_pairs(none).count() == 0

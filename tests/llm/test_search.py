"""Hard negatives, ranked search and piece encoding against brute force, with every awkward case."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crowdgauge.llm import hard_negatives, lexical
from crowdgauge.llm import sentence_pieces as S

EXTRA = "class string, m int, n string, terms int, block int, number string, asks int, id int, ids string, rank int"


def with_extra(df):
    """Columns whose names the operators use inside."""
    have = {c.lower() for c in df.columns}
    names = [part.split()[0] for part in EXTRA.split(", ")]
    return df.select("*", *(F.lit("x").alias(c) for c in names if c not in have))


# hard negatives


def mined(rows, anchors, positives=5, negatives=10):
    there = [
        (i, lab, np.floor(np.array(e, float) * 256))
        for i, e, lab in rows
        if i is not None and lab is not None and e is not None and None not in e and np.isfinite(e).all()
    ]
    out, asked = [], set()
    for i, lab, a in there:
        if i % anchors or (i, lab, a.tobytes()) in asked:
            continue
        asked.add((i, lab, a.tobytes()))
        scored = sorted((-int(a @ b), j, other == lab) for j, other, b in there if j != i and len(a) == len(b))
        for p, pos, _ in [s for s in scored if s[2]][:positives]:
            window = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, pos, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(window)]
    return sorted(out)


def clustered(n, width=8, seed=3):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(12, width))
    rows = []
    for i in range(n):
        e = centers[draw.integers(12)] + 0.1 * draw.normal(size=width)
        rows.append((i, [float(x) for x in e / np.linalg.norm(e)], int(draw.integers(4)) if i % 3 else 1))
    return rows


FORM = "vec_id bigint, embedding array<double>, label int"


def test_hard_negatives_equal_brute_force(spark):
    rows = clustered(400)
    rows += [(400 + i, rows[7][1], rows[7][2]) for i in range(60)]  # ties
    rows += [(500, None, 1), (501, [math.nan] * 8, 1), (502, [1.0, None] * 4, 2), (503, [0.0] * 8, 2), (510, [0.1], 1)]
    rows += [(520, [0.2], 2), (530, [0.3], 1), (540, [], 1), (550, [], 2), (560, [0.1] * 8, None), (None, [0.1] * 8, 1)]
    rows += [rows[10], rows[11], (20, rows[30][1], 3), (600, [1e3] * 8, 1), (610, [300.0] * 8, 2)]
    df = with_extra(spark.createDataFrame(rows, FORM))
    for sample, block in ((4_096, 256), (16, 8), (1, 3)):
        got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, sample=sample, block=block)
        assert sorted(map(tuple, got.collect())) == mined(rows, 10)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], FORM)
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 2)], FORM)
    assert hard_negatives.mine(alone, F.col("vec_id") % 10 == 0).collect() == []


def test_zone_maps_exclude_blocks_of_other_clusters():
    """On rows in clusters most blocks cannot matter, and what matters is never excluded."""
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(40, 6)) * 200
    matrix = np.floor(np.concatenate([c + 4 * draw.normal(size=(50, 6)) for c in centers]))
    edges = hard_negatives._edges({6: matrix})[6]
    cells = np.stack([np.searchsorted(edges[:, i], matrix[:, i], side="right") for i in range(6)], axis=1)
    places = hard_negatives.curve(cells, int(np.log2(len(edges) + 1)))
    order = sorted(range(len(matrix)), key=lambda i: places[i].tobytes())
    blocks = [matrix[order[i : i + 25]] for i in range(0, len(order), 25)]
    chunk = hard_negatives._block(0, 6, np.arange(40), np.ones(40, np.int64), matrix[::50])
    names = [part.split()[0] for part in hard_negatives._BLOCKS.split(", ")]
    asked = hard_negatives._Asked(dict(zip(names, chunk)), True, 5)
    exact = matrix[::50] @ matrix.T
    asked.reach = np.sort(exact, axis=1)[:, -5].astype(np.int64)
    low, high = np.array([b.min(axis=0) for b in blocks]), np.array([b.max(axis=0) for b in blocks])
    wants = asked.wants(np.ones(len(blocks), np.int64), low, high)
    assert wants.mean() < 0.2
    for j, b in enumerate(blocks):
        needed = ((matrix[::50] @ b.T) >= asked.reach[:, None]).any(axis=1)
        assert not (needed & ~wants[:, j]).any()


def test_curve_visits_neighbours():
    """Every cell once, and from one to the next a single step along one axis."""
    for bits, n in ((1, 3), (2, 2), (3, 3), (2, 5)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * n)
        cells = np.stack([a.ravel() for a in axes], axis=1)
        places = [p.tobytes() for p in hard_negatives.curve(cells, bits)]
        assert len(set(places)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=places.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return [fold(t) for t in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                for t in terms
                if b[t]
            )
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_ranked_search_equals_brute_force(spark):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdeÉß", k=draw.randint(1, 4))) for _ in range(120)] + ["A1", "a1", "Ω"]
    line = lambda n: draw.choice([" ", "-", "\n", "\x00"]).join(draw.choices(words, k=n))
    docs = [(i, line(draw.randint(0, 60))) for i in range(300)]
    copy = line(20)
    docs += [(1_000 + i, copy) for i in range(200)]  # one class of copies
    docs += [(2_000 + i, " ".join(draw.sample(copy.split(), len(copy.split())))) for i in range(30)]  # equal bags
    docs += [(5, docs[5][1]), (5, line(30)), (None, copy), (3_000, None), (3_001, ""), (3_002, " .\n"), (3_003, line(9_000))]
    items = [(f"q{i}", line(draw.randint(1, 25))) for i in range(15)] + [("copy", copy), ("copy", "a1 b"), ("none", "zzzz")]
    items += [("null", None), ("empty", ""), (None, line(5)), (None, line(5)), ("long", line(2_000))]
    d = with_extra(spark.createDataFrame(docs, "doc_id bigint, text string"))
    q = with_extra(spark.createDataFrame(items, "item_id string, text string"))
    for block in (1_000_000, 40):  # also with the items in several blocks
        got = lexical.rank(d, q, item_terms=block)
        assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items)


def test_ranked_search_of_nothing(spark):
    docs, items = "doc_id bigint, text string", "item_id bigint, text string"
    some = spark.createDataFrame([(1, "a b")], docs)
    assert lexical.rank(some, spark.createDataFrame([], items)).collect() == []
    assert lexical.rank(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a")], items)).collect() == []
    assert lexical.rank(spark.createDataFrame([(1, None)], docs), spark.createDataFrame([(1, "a")], items)).collect() == []


def test_classes_are_verified():
    """Rows of one hash with other frequencies are classes of their own."""
    import pyarrow as pa

    rows = [([1, 2], [1, 1], 9), ([1, 2], [1, 1], 9), ([1, 2], [1, 2], 9), ([1], [1], 9), ([1], [1], 8), ([1], [1], 8)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([7] * len(rows), pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([r[0] for r in rows], pa.list_(pa.int32())),
            pa.array([r[1] for r in rows], pa.list_(pa.int32())),
        ],
        names=["class", "m", "terms", "tfs"],
    )
    assert lexical._classes(batch, lexical._flat(batch.column("terms"))[1]).tolist() == [True, False, True, True, True, False]


# piece encoding

ODD = [
    "", None, " ", "  ", "a", " a", "a ", "▁", "▁a ▁▁b", "▁▁x▁", "\x00", "é\x00x\n\n\ty  ", "<s> a </s><0x41><unk>",
    "日本語 😀 " * 50, "x" * 1_000, " " * 100, "a" * 33 + "b" * 31, "\n" * 70, "the" * 11, "한국어테스트" * 30, "﻿abc d　e",
    "𝔘𝔫𝔦", "é", "word " * 20_000, "ab" * 3_000 + "日" * 3_000,
]


def coded(texts):
    import pyarrow as pa

    from crowdgauge.llm import text as X

    v, ids, back = S.pieces(), [], []
    for _, _, raw, starts in X.chunks(pa.array(texts, pa.string()), S.CHUNK):
        found, counts = S.encode_chunk(v, raw, starts, False)
        ids += [x.tolist() for x in np.split(found, np.cumsum(counts)[:-1])]
        back += S.decode_chunk(v, found, counts)
    return ids, back


def test_pieces_equal_the_library(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, "repeated"), (0, "repeated"), (None, "no id")]
    df = with_extra(spark.createDataFrame(rows, "doc_id bigint, text string"))
    sp = S.pieces().library
    expected = [(i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in rows]
    got = [(r["doc_id"], list(r["ids"]), r["decoded"]) for r in S.encode(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert S.encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abehtnd  \n.,'▁é日😀\x07<>0x1힣") | st.characters(exclude_categories=["Cs"]), max_size=90), max_size=8))
def test_any_text_is_coded_as_the_library_does(texts):
    ids, back = coded(texts)
    sp = S.pieces().library
    assert ids == [sp.encode(t) for t in texts]
    assert back == [sp.decode(i) for i in ids]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300) | st.integers(0, 31_999), max_size=20), min_size=1, max_size=8))
def test_any_ids_decode_as_in_the_library(rows):
    v = S.pieces()
    flat = np.array([i for r in rows for i in r], np.int64)
    assert S.decode_chunk(v, flat, np.array([len(r) for r in rows])) == v.library.decode(rows)


def test_the_matrix_and_the_heap_merge_alike():
    draw, v = random.Random(4), S.pieces()
    for _ in range(200):
        n = draw.randint(2, 32)
        symbols = [int(v.singles[ord(c)]) for c in draw.choices("▁ethanoisr", k=n)]
        row = np.full((1, 32), -1, np.int32)
        row[0, :n] = symbols
        merged = S.merge_rows(v, row)[0]
        assert merged[merged >= 0].tolist() == S.merge_long(v, symbols)


def test_words_that_share_a_hash_are_noticed(monkeypatch):
    """With every word under one hash, the ids no longer spell the text, so words are merged apart."""
    monkeypatch.setattr(S.X, "span_hashes", lambda raw, b, e, table: np.zeros(len(b), np.uint64))
    v = S.pieces()
    v.memory.clear()
    texts = ["one two three", "four", "one two"]
    ids, _ = coded(texts)
    v.memory.clear()
    assert ids == [v.library.encode(t) for t in texts]


def test_a_difference_from_the_library_is_an_error():
    v = S.pieces()
    raw = np.frombuffer(b" word", np.uint8)
    ids = np.array(v.library.encode("word"), np.int32)
    S._compare(v, raw, np.array([5]), ids, np.array([len(ids)]))
    with pytest.raises(ValueError):
        S._compare(v, raw, np.array([5]), ids + 1, np.array([len(ids)]))

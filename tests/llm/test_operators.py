"""Each operator against a brute-force twin on a small table with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdgauge.llm import (
    chains,
    knn_join,
    langid,
    line_dedup,
    mixing,
    multi_index,
    ngram_join,
    packing,
    rollup,
    substring,
    tokens,
)
from crowdgauge.llm import text as X

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
FORM = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, cls string, label int"


def words_of(text):
    return WORDS.findall((text or "").encode())


def corpus():
    """Copies, near copies, shared passages and lines, nulls, blanks, one word, a very long text."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(400)]
    make = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    line = lambda n: " ".join(make(n))
    passage, lines = make(70), [line(6) for _ in range(8)]
    base = make(120)
    texts = [" ".join(base)] * 30
    for _ in range(60):
        near = list(base)
        for _ in range(draw.randint(1, 6)):
            near[draw.randrange(len(near))] = draw.choice(vocabulary)
        texts.append(" ".join(near))
    for n in (0, 5, 30, 80):
        texts += [" ".join(make(n) + passage + make(n)) for _ in range(8)]
        texts.append("\n".join([line(5), *lines[:4], line(4), "", "  ", *lines[2:6], *lines[2:6]]))
    texts += [" ".join(make(n)) for n in (1, 2, 3, 9, 10, 49, 50, 51, 300)]
    texts += [None, None, "", "", "   \n\t ", "\n\n\n", "!!! 12 ###", "ÉTÉ été  x", "a b \x00c", "Ünï\r\n\r\nçø"]
    texts.append(" ".join(make(6_000)))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3]]  # repeated rows
    draw.shuffle(rows)
    return [(i, t, ("en", "fr", None)[i % 3], ("a", "a", "b", None)[i % 4], len(t or ""), i, "x", 1) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, FORM).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FORM)


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, rows, k, percent):
    def shingles(text):
        w = words_of((text or "").encode().lower().decode())
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    links = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = reach(ids, links)
    got = ngram_join.jaccard_components(docs, words=k, percent=percent, spare=0.3 if percent == 80 else 0.15).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in ids}
    assert len(links) > 400  # the table has what is looked for


def test_ngram_join_in_blocks(spark, monkeypatch):
    draw = random.Random(8)
    # a chain: every text is near the next, few are near the smallest
    words = [f"w{i}" for i in range(200)]
    chain = [(0, " ".join(words))]
    for i in range(1, 60):
        words[draw.randrange(200)] = f"x{i}"
        chain.append((i, " ".join(words)))
    table = spark.createDataFrame(chain, "doc_id bigint, text string")
    compared = []
    whole = ngram_join._within_groups
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(
        ngram_join, "_within_groups", lambda *given: compared.append(whole(*given).cache()) or compared[-1]
    )
    got = ngram_join.jaccard_components(table, words=3, percent=90).collect()
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(198)} for i, t in chain}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = reach(sets, links)
    assert {r.doc_id: r.component_id for r in got} == want
    assert compared and compared[0].count() > 0  # blocks were compared with each other


def test_ngram_join_of_nothing(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def test_blocks_agree_for_similar_sets():
    draw = np.random.default_rng(3)
    for size in (9, 10, 19, 40, 200, 1500):
        for percent, spare in ((90, 0.15), (80, 0.3)):
            bands = ngram_join.Bands(percent, 1.4, spare)
            for _ in range(30):
                whole = draw.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
                most = (100 - percent) * 2 * size // (100 + percent)
                n = int(draw.integers(0, most // 2 + 1))
                other = np.concatenate([whole[n:], draw.integers(0, 2**63, n, dtype=np.uint64)])
                a, b = np.unique(whole), np.unique(other)
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both) or n == 0:
                    continue
                assert np.intersect1d(ngram_join.block_keys(a, bands), ngram_join.block_keys(b, bands)).size


def test_packing_is_a_round_trip(docs, rows, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    pieces = packing.pack(docs, capacity=256, windows=4).collect()
    found, sequences = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert ids == want[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(want[p.doc_id])
        found[p.doc_id] = found.get(p.doc_id, 0) + len(ids)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    times = {i: sum(r[0] == i for r in rows) for i in want}
    assert found == {i: len(x) * times[i] for i, x in want.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256 and end & (end - 1) == 0  # no padding
    assert packing.pack(empty).count() == 0


def test_tokens_of_odd_texts():
    import pyarrow as pa
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    draw = random.Random(9)
    pieces = ["a", "it's", " ", "  ", "\n", "\t", " ", " ", "\u0085", "é", "漢字", "𝔘", "12", "...", "<|endoftext|>", "Ω", "\x1c", "　"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 30))) for _ in range(3000)] + [None, ""]
    got = list(tokens.encode(pa.array(texts)))
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_packing_has_the_ids_of_the_tokenizer_as_loaded(spark):
    """Its added token is found in plain text; literals do not reach over documents or into each other."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    draw = random.Random(10)
    pieces = ["a", "it's", " ", "  ", "\n", "é", "漢字", "12", "...", "<|endoftext|>", "<|endoftext", "|>", "<|"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(1500)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|>" * 3, "<|endoftext", "|> b", None, "", "<|endo", "text|>"]
    want = [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    assert 50256 in want[1500]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {}
    for p in packing.pack(table.repartition(3)).collect():
        found.setdefault(p.doc_id, {})[p.start] = np.frombuffer(p.ids, "<u4").tolist()
    for i, ids in enumerate(want):
        assert [x for _, part in sorted(found[i].items()) for x in part] == ids, repr(texts[i])


def test_line_dedup(docs, rows, empty):
    seen, want = {}, {}
    texts = dict((r[0], r[1]) for r in rows)
    windows = []
    for i in sorted(texts):
        lines = [x for x in (texts[i] or "").split("\n") if words_of(x)]
        windows += [((i, j), tuple(lines[j : j + 3])) for j in range(len(lines) - 2)]
    gone = {}
    for (i, j), w in windows:
        if w in seen:
            gone.setdefault(i, set()).update((j, j + 1, j + 2))
        seen.setdefault(w, (i, j))
    for i, text in texts.items():
        if text is None:
            want[i] = (None, 0, 0)
            continue
        kept, n = [], 0
        for x in text.split("\n"):
            if words_of(x):
                n += 1
                if n - 1 in gone.get(i, ()):
                    continue
            kept.append(x)
        want[i] = ("\n".join(kept), n, len(gone.get(i, ())))
    got = line_dedup.dedup_lines(docs, counts=True).collect()
    assert len(got) == len(rows) and gone
    for r in got:
        assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id], r.doc_id
    whole = line_dedup.dedup_lines(docs)
    assert whole.columns == docs.columns and whole.count() == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_language_id(spark, docs, rows, empty):
    draw = random.Random(2)
    speak = {"xx": "abcde", "yy": "vwxyz", "ru": "абвгд"}
    say = lambda lang, n: " ".join("".join(draw.choices(speak[lang], k=4)) for _ in range(n))
    taught = [(say(lang, 40), lang) for lang in speak for _ in range(60)] + [(None, "xx"), ("abc", None)]
    model = langid.learn(spark.createDataFrame(taught, "text string, lang string"))
    mixed = f"{say('xx', 30)} {say('yy', 20)} {say('ru', 12)}"
    asked = [(0, say("xx", 9)), (1, say("yy", 1)), (2, say("ru", 5)), (3, mixed), (4, None), (5, ""), (6, "12 !? —")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["xx", "yy", "ru", "xx", "und", "und", "und"]
    assert [s.lang for s in got[3].spans] == ["xx", "yy", "ru"] and got[4].spans == []
    assert all(0 <= r.score <= 1 for r in got.values()) and got[6].score == 0
    assert langid.identify(docs, model).count() == len(rows)
    nothing = langid.learn(empty)
    assert langid.identify(docs, nothing).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_viterbi_and_its_short_cut():
    draw = np.random.default_rng(4)
    for n in (1, 2, 5, 9):
        scores = -draw.exponential(2.0, (n, 3))
        best, at = -np.inf, None
        for code in range(3**n):
            path = [code // 3**i % 3 for i in range(n)]
            value = sum(scores[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))
            if value > best:
                best, at = value, path
        assert langid.viterbi(scores, np.array([0]), np.array([n]), 1.5)[0].tolist() == at
        model = langid.Model(["a", "b", "c"], scores, np.ones((1, 3), bool))
        assert langid._label(model, scores, np.array([0, n]), 1.5).tolist() == at


def test_mixing(docs, rows, empty):
    plan = mixing.demand(docs).cache()
    got = plan.collect()
    assert len(got) == len(rows)
    totals, target, size = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.passes)
        assert all(0 <= p.position < 1 for p in r.passes)
        totals[r.source] = totals.get(r.source, 0) + r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert {s: totals[s] for s in totals} == {s: int(t) for s, t in target.items()}
    assert all(t <= 2 * size[s] for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    positions = [r.position for r in mixing.schedule(plan).collect()]
    assert positions == sorted(positions)
    assert sorted(map(str, plan.collect())) == sorted(map(str, mixing.demand(docs.repartition(3)).collect()))
    assert mixing.demand(empty).count() == 0


def test_copies_just_below_the_centre_are_not_compared_with_each_other(spark, monkeypatch):
    """Texts alike that all just miss the smallest id: the next centre joins them, no pair each."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    base = [word() for _ in range(2_000)]

    def changed(words, places):
        out = list(words)
        for i in places:
            out[i] = word()
        return " ".join(out)

    pairs = []
    inside = ngram_join._within_groups
    monkeypatch.setattr(ngram_join, "_within_groups", lambda *a: pairs.append(n := inside(*a)) or n)
    for copies in (30, 60):
        far = changed(base, range(20, 20 + 38 * 50, 50))
        texts = [far] + [changed(base, draw.sample(range(2_000), 2)) for _ in range(copies)]
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table, words=3, percent=90).collect()}
        sets = [{tuple(t.split()[i : i + 3]) for i in range(1_998)} for t in texts]
        assert max(len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]) < 0.9
        assert got == {0: 0} | {i: 1 for i in range(1, copies + 1)}
        assert pairs[-1].count() <= copies


def test_near_duplicate_vectors(spark):
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(6, 16))
    near = [(c + 0.05 * draw.normal(size=16)) for c in centers for _ in range(25)]
    rows = [(i, v.tolist(), i % 2, 7) for i, v in enumerate(near)]
    rows += [(500 + i, rows[0][1], 0, 7) for i in range(5)] + [rows[3]]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None], [], [float("inf")] * 16]
    rows += [(600 + i, v, 1, 7) for i, v in enumerate(odd)] + [(700, rows[0][1], None, 7), (701, [1.0, 2.0], 1, 7)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cls int")
    good = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    links = []
    count = dict.fromkeys(range(len(good)), 0)
    for i, a in enumerate(good):
        for j, b in enumerate(good):
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a[0], b[0]))
                    count[i] += 1
    want = reach({r[0] for r in rows}, links)
    own = {good[i][0]: n for i, n in count.items()}
    for recall in (1.0, 0.999):
        got = multi_index.near_duplicates(table, recall=recall, codes=4).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (own.get(r.vec_id, 0), want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert multi_index.near_duplicates(table.limit(0)).count() == 0


def test_near_duplicates_beyond_the_sample(spark):
    """A tight group that the sample sees, and pairs across cell borders of which it sees hardly any."""
    draw = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    tight = unit(unit(draw.normal(size=8)) + 1e-4 * draw.normal(size=(150, 8)))
    firsts = unit(draw.normal(size=(600, 8)))
    units = np.concatenate([tight, firsts, unit(firsts + 0.05 * draw.normal(size=firsts.shape))])
    links = (units @ units.T >= 0.98).sum(axis=1) - 1
    table = spark.createDataFrame(
        [(i, u.tolist(), 1) for i, u in enumerate(units)], "vec_id bigint, embedding array<double>, label int"
    )

    def complete(**options):
        got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(table, codes=8, sample=64, **options).collect()}
        return np.mean([got[i] == n for i, n in enumerate(links) if n])

    assert complete() >= 0.999
    assert complete(asked=64) == 1.0  # too few linked ones for 0.999: every cell is visited
    assert complete(asked=300, recall=0.98) >= 0.97


def test_substring_dedup(docs, rows, empty):
    texts = dict((r[0], r[1]) for r in rows)
    first, want = {}, {}
    for i in sorted(texts):
        w, gone, own = words_of(texts[i]), set(), []
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            if key in first:
                gone.update(range(j, j + 50))
            own.append(key)
        for key in own:
            first.setdefault(key, i)
        want[i] = (b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), len(w), len(gone))
    got = substring.dedup_substrings(docs).collect()
    assert len(got) == len(rows) and sum(x[2] for x in want.values()) > 1000
    for r in got:
        assert (r.text, r.n_words, r.n_removed) == want[r.doc_id], r.doc_id
    assert substring.dedup_substrings(empty).count() == 0


def test_own_windows_of_anchors():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, top, n) for top in (1, 2, 9, 10**6) for n in (41, 42, 90, 400)]
    texts.append(np.tile(rng.integers(0, 99, 7), 40))
    for grams in (t.astype(np.uint64) for t in texts):
        at = substring.anchors(grams, 41)
        least = np.array([grams[s : s + 41].min() for s in range(len(grams) - 40)])
        first, last = substring.own_windows(grams, at, 41)
        for p, a, b in zip(at, first, last, strict=True):
            own = [s for s in range(max(0, p - 40), min(p + 1, len(least))) if least[s] == grams[p]]
            assert own == list(range(a, b + 1))


def test_substring_dedup_in_blocks(docs, monkeypatch):
    want = {tuple(r) for r in substring.dedup_substrings(docs).collect()}
    monkeypatch.setattr(substring, "BLOCK", 7)
    monkeypatch.setattr(substring, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in substring.dedup_substrings(docs).collect()} == want


def test_fm_index_counts_patterns():
    from crowdgauge.llm.fm_index import FMIndex

    draw = np.random.default_rng(8)
    texts = draw.integers(1, 5, 300)
    texts[[99, 199, 299]] = 0
    index = FMIndex(texts, depth=16)
    for n in (1, 2, 3, 6):
        for _ in range(20):
            at = int(draw.integers(0, 300 - n))
            pattern = draw.integers(1, 5, n) if draw.random() < 0.3 else texts[at : at + n]
            if 0 in pattern:
                continue  # patterns lie within a text
            low, high = np.array([0]), np.array([300])
            for s in pattern[::-1]:
                low, high = index.step(np.array([s]), low, high)
            windows = np.lib.stride_tricks.sliding_window_view(texts, n)
            assert high[0] - low[0] == (windows == pattern).all(axis=1).sum()


def test_exact_top_k(spark):
    draw = np.random.default_rng(6)
    rows = [(i, np.round(draw.normal(size=8), 1).tolist(), 3) for i in range(200)]
    rows += [(300, None, 3), (320, [float("nan")] * 8, 3), (340, [1.0, None], 3), (360, [1.0], 3), (380, rows[0][1], 3), rows[7]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    e = {}
    for i, v, _ in rows:
        if v and None not in v and np.isfinite(v).all():
            e.setdefault(i, []).append(np.floor(64 * np.float32(v).astype(float)).astype(int))
    want = set()
    for q, vs in e.items():
        if q % 20 == 0:
            others = [(-int(vs[0] @ y), j) for j, ys in e.items() for y in ys if j != q and len(y) == len(vs[0])]
            want |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(others)[:20])}
    got = knn_join.top_k(table, F.col("vec_id") % 20 == 0, pivots=5)
    assert {tuple(r) for r in got.collect()} == want
    assert knn_join.top_k(table.limit(0), F.lit(True)).count() == 0


def test_toxicity_chain(spark, empty):
    draw = random.Random(3)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(900):
        toxic, bad = i % 9 == 0, i % 5 == 0
        text = draw.choices(plain, k=60) + ["vile"] * toxic + ["spam"] * bad
        draw.shuffle(text)
        rows.append((i, " ".join(text), int(toxic), int(bad)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, low int")
    docs = table.select("doc_id", "text").unionByName(
        spark.createDataFrame([(9000, None), (9001, ""), (9002, "VILE!")], "doc_id bigint, text string")
    )
    chain = chains.learn(docs, table.filter("doc_id < 600"), ["low", "toxic"])
    got = {r.doc_id: r for r in chains.predict(docs, chain).collect()}
    held = [got[i].toxic == bool(rows[i][2]) for i in range(600, 900)]
    assert np.mean(held) > 0.98
    assert not got[9000].toxic and not got[9001].toxic and len(got) == 903
    none = chains.learn(empty, table.limit(0), ["low", "toxic"])
    assert chains.predict(docs, none).filter("toxic").count() == 0
    assert chains.predict(empty, chain).count() == 0


def test_rollup(spark, tmp_path):
    form = "op string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint"
    frame = lambda *r: spark.createDataFrame(list(r), form)
    totals = rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert totals.totals().count() == 0
    load = frame(("insert", "a", "en", "t", 10, None), ("insert", "a", None, "t", 5, None), ("insert", "a", "en", "t", None, None))
    assert totals.commit("load/1", load) and not totals.commit("load/1", load)
    assert totals.commit("fix", frame(("revise", "a", "en", "t", 7, 10), ("delete", "a", None, "t", 5, None)))
    want = {("a", "en", "t", 2, 7)}
    assert {tuple(r) for r in totals.totals().collect()} == want
    totals.compact()
    assert not totals.commit("load/1", load) and not totals.commit("fix", load)
    assert {tuple(r) for r in totals.totals().collect()} == want
    assert totals.commit("none", frame())
    with pytest.raises(Exception, match="unknown op"):
        totals.commit("wrong", frame(("upsert", "a", "en", "t", 1, None)))
    assert {tuple(r) for r in totals.totals().collect()} == want


def test_hashes_do_not_depend_on_chunks(rows):
    import pyarrow as pa

    column = pa.array([r[1] for r in rows])
    whole = [s.tolist() for s in X.shingle_sets(column, 3)]
    single = [s.tolist() for r in rows for s in X.shingle_sets(pa.array([r[1]], pa.string()), 3)]
    assert whole == single
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")

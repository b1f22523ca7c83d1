"""The pipeline on small tables, each stage against what it must keep."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, connect
from crowdgauge.llm import langid, mixing, queries
from crowdgauge.runtime import ensure_checkpoint_dir, pin

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="test tables not present")


def test_stages(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = pin(stage(spark, kept, DIRECTORY))
        assert kept.columns == columns, name
        if name != "mix_sources":
            assert kept.select("doc_id").distinct().count() == kept.count() > 100
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, DIRECTORY)
    ends = pieces.selectExpr("start + length = doc_tokens AS ends").filter("ends").count()
    assert ends == kept.count()


def test_language_id_rejects_what_was_not_learned(spark):
    draw = random.Random(4)
    noise = lambda n: " ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(5, 9))) for _ in range(n))
    planted = [noise(20), noise(400), noise(400).replace(" ", "")]
    planted.append("Rząd ogłosił, że nowa ustawa wejdzie w życie w przyszłym roku po głosowaniu w parlamencie. " * 3)
    planted.append("Hallitus ilmoitti, että uusi laki tulee voimaan ensi vuonna eduskunnan äänestyksen jälkeen. " * 3)
    planted.append("Правительство объявило, что новый закон вступит в силу в следующем году после голосования. " * 3)
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    rows = [(10**9 + i, text) for i, text in enumerate([*planted, None, "", "12 !?"])]
    more = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.language_id(spark, docs.unionByName(more, allowMissingColumns=True), DIRECTORY)
    kept = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept == clean


def test_language_id_keeps_clean_texts_of_every_length(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    model = langid.learn(docs.filter(~langid.held_out()))
    words = [r.text.split() for r in docs.filter(langid.held_out()).select("text").collect() if r.text]
    cut = [(i, " ".join(w[:n])) for n in (3, 5, 10, 30, 100, 300) for i, w in enumerate(words) if len(w) > n]
    found = langid.identify(spark.createDataFrame(cut, "doc_id bigint, text string"), model).collect()
    low = [r for r in found if r.known < (corpus_pipeline.LEAST_KNOWN_SHORT if len(r.text.encode()) < 100 else 0.5)]
    assert len(found) > 100 and not low, low


def test_mix_of_rows_without_an_id_and_with_the_same(spark):
    """All texts have four words, so each source's rows are its target over four, rounded up."""
    ids = [None] * 40 + [7] * 5 + list(range(100, 130))
    rows = [(n, f"w{i} a b c", "en", "xyz"[i % 3] if i % 11 else None, 0) for i, n in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = [r.asDict() for r in corpus_pipeline.mix_sources(spark, docs, DIRECTORY).collect()]
    sizes = {x: 4 * sum(r[3] == x for r in rows) for x in ("x", "y", "z", None)}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    for r in mixing.targets(sources).collect():
        got = [m["text"] for m in mixed if m["source"] == r.source]
        assert len(got) == -(-int(r.target) // 4), r.source
        whole = int(r.target) // r.source_size
        assert all(whole <= got.count(x[1]) <= whole + 1 for x in rows if x[3] == r.source)
    assert {tuple(m.values()) for m in mixed} <= set(rows)


CLASHES = (
    "score known spans lang_pred _repeats _lines _removed _id _position _row passes size target row digest order "
    "component_id n_shingles extra id key words turn place hashed taken cls first"
).split()


def test_extra_columns_of_any_name_pass_through(spark):
    """Every name that a stage uses inside, at once; values stay with their rows."""
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").limit(60)
    kept = pin(docs.select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in [*CLASHES, "extra column 1"])))
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = pin(stage(spark, kept, DIRECTORY))
        assert kept.columns == columns, name
        for c in CLASHES:
            assert kept.filter(F.col(c) != F.concat(F.lit(c), F.col("doc_id"))).isEmpty(), (name, c)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, DIRECTORY).count() >= kept.count() > 30


def test_near_dedup_of_rows_that_share_an_id(spark):
    """Texts of one id stay if they differ; copies go, also those without an id; every run keeps the same."""
    draw = random.Random(8)
    text = lambda: " ".join("".join(draw.choices(string.ascii_lowercase, k=6)) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, b), (1, a), (2, near), (None, a), (None, c), (None, c), (None, d), (3, c), (4, None), (4, None), (5, "")]
    rows += [(i, text()) for i in range(10, 20)]
    form = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    for shuffled in (full, full[::-1]):
        docs = spark.createDataFrame(shuffled, form).repartition(3)
        kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, DIRECTORY).collect()), key=repr)
        want = [(1, a), (1, b), (3, c), (None, d), (4, None), (4, None), (5, ""), *rows[12:]]
        assert kept == sorted(want, key=repr)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def without_repeated_lines(texts):
    """Documents by id, later windows of three lines judged on all texts as they came."""
    seen, gone = set(), {i: set() for i in texts}
    for i in sorted(texts):
        lines = [x for x in texts[i].split("\n") if words_of(x)]
        for j in range(len(lines) - 2):
            if (window := tuple(lines[j : j + 3])) in seen:
                gone[i] |= {j, j + 1, j + 2}
            seen.add(window)
    kept = {}
    for i, text in texts.items():
        number, out = -1, []
        for x in text.split("\n"):
            number += bool(words_of(x))
            if not (words_of(x) and number in gone[i]):
                out.append(x)
        kept[i] = "\n".join(out)
    return kept


def one_of_each_group(texts):
    """The smallest id of every group that links of five-word shingles, 80 in 100, reach."""
    sets, root = {}, {i: i for i in texts}
    for i, text in texts.items():
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * min(len(sets[a]), len(sets[b])) < 80 * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: texts[i] for i in ids if root[i] == i}


def times_taken(sizes, sources):
    """How often the mix takes each document: targets by filling level, then documents in hashed order."""
    held = Counter()
    for i, n in sizes.items():
        held[sources[i]] += n
    names = sorted(held, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    full, due = set(), 1.5 * sum(held.values())
    while True:
        level = (due - sum(2 * held[x] for x in full)) / sum(weight[x] for x in names if x not in full)
        over = {x for x in names if x not in full and level * weight[x] > 2 * held[x]}
        if not over:
            break
        full |= over
    taken = {}
    for x in names:
        target = 2 * held[x] if x in full else int(level * weight[x])
        passes, before = target // held[x], 0
        for i in sorted((i for i in sizes if sources[i] == x), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:16]):
            if n := (passes + (target - passes * held[x] > before)) * (sizes[i] > 0):
                taken[i] = n
            before += sizes[i]
    return taken


def test_run_equals_brute_force(spark, tmp_path):
    """All stages over the documents and planted ones: noise, copies, near copies and shared lines."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    given = docs.collect()
    draw = random.Random(21)
    long = sorted((r for r in given if 120 < len(words_of(r.text)) < 500), key=lambda r: r.doc_id)[:8]
    w = [words_of(r.text) for r in long]
    shared = [" ".join(w[3][k : k + 12]) for k in (0, 12, 24)]
    noise = lambda n: " ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(5, 9))) for _ in range(n))
    rejected = [noise(40), noise(300), None, "", "12 !?"]
    planted = [
        *rejected, " ".join(w[0]), " ".join(w[0]), " ".join([*w[1], "afterwards"]), long[1].text,
        " ".join([*w[2][:60], "elsewhere", *w[2][61:]]),
        "\n".join([" ".join(w[4][:50]), *shared, " ".join(w[5][:50])]),
        "\n".join([" ".join(w[6][:70]), *shared, *shared, " ".join(w[7][:70])]),
    ]
    rows = [(10**6 + i, t, None, ("s", None)[i % 2], len(t or "")) for i, t in enumerate(planted)]
    more = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.select(more.columns).unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))

    texts = {r.doc_id: r.text for r in given} | {r[0]: r[1] for r in rows[len(rejected) :]}
    sources = {r.doc_id: r.source for r in given} | {r[0]: r[3] for r in rows}
    lined = without_repeated_lines({i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")})
    kept = one_of_each_group(lined)
    assert 10**6 + 6 not in kept and len(kept) < len(lined) and lined[10**6 + 11] != texts[10**6 + 11]
    taken = times_taken({i: len(words_of(t)) for i, t in kept.items()}, sources)

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(kept[i], add_special_tokens=False).ids, 1] for i in taken}
    found, sequences = Counter(), {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        part = np.frombuffer(x.ids, "<u4").tolist()
        assert part == ids[x.doc_id][x.start : x.start + x.length] and x.doc_tokens == len(ids[x.doc_id])
        found.update((x.doc_id, x.start + k) for k in range(x.length))
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert found == Counter({(i, k): n for i, n in taken.items() for k in range(len(ids[i]))})
    for parts in sequences.values():
        ends = [offset + length for offset, length in sorted(parts)]
        assert [offset for offset, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0  # no padding


def test_sequences_follow_the_training_order(spark, tmp_path):
    """Files of very different sizes, read and packed in many tasks: a later task has later documents."""
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices(["alpha", "beta", "gamma"], k=draw.randint(60, 250)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    part = F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 2500, 1).otherwise(2)
    docs.repartitionByRange(3, part).sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "docs"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        read = spark.read.parquet(str(tmp_path / "docs"))
        pieces = corpus_pipeline.STAGES[-1][1](spark, read, DIRECTORY).collect()
    finally:
        spark.conf.set(key, before)
    tasks = {}
    for p in pieces:
        tasks.setdefault(p.sequence_id >> 32, []).append((p.doc_id, p.sequence_id & (1 << 31)))
    spans = [[d for d, merged in tasks[t] if not merged] for t in sorted(tasks)]
    spans = [(min(x), max(x)) for x in spans if x]
    assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)), spans
    assert {p.doc_id for p in pieces} == set(range(3000))
    own = docs.limit(20).withColumn("_metadata", F.lit(1))
    assert corpus_pipeline.STAGES[-1][1](spark, own, DIRECTORY).count() >= 20


def test_rows_are_numbered_without_a_copy_of_the_texts(spark, tmp_path):
    """What near dedup and the mix leave in the checkpoint folder is far less than the texts."""
    draw = random.Random(8)
    text = lambda: " ".join("".join(draw.choices(string.ascii_letters, k=7)) for _ in range(300))
    rows = [(i % 900 if i % 50 else None, text(), ("s", None, "t")[i % 3]) for i in range(1000)]
    rows += rows[:40]  # rows that are equal in all columns
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    size = lambda top: sum(f.stat().st_size for f in Path(top).rglob("part-*"))
    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    given, before = size(tmp_path / "docs"), size(shared)
    kept = corpus_pipeline.near_dedup(spark, read, DIRECTORY).collect()
    mixed = corpus_pipeline.mix_sources(spark, read, DIRECTORY).collect()
    assert size(shared) - before < given / 4
    assert Counter(kept) == Counter(set(docs.collect()))
    assert {r.text for r in mixed} <= {r[1] for r in rows} and len(mixed) > 1000


def test_rows_from_one_place_in_a_file_have_numbers_of_their_own(spark, tmp_path):
    """Rows made several times of a row that is read, as ``explode`` does; and what comes from no file."""
    spark.range(50, numPartitions=3).withColumn("text", F.lit("a b c")).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    twice = read.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    for docs in (read, twice, read.union(read), read.withColumn("_metadata", F.lit(1)), spark.range(50)):
        found = corpus_pipeline._numbered(docs)
        assert found.columns == [*docs.columns, "_row"]
        assert found.select("_row").distinct().count() == found.count() == docs.count()
    again = [sorted(corpus_pipeline._numbered(read).collect()) for _ in range(2)]
    assert again[0] == again[1]


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = pin(stage(spark, docs, DIRECTORY))
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    _, rows, problem = compare(
        spark, connect(DIRECTORY), name, queries.QUERIES[name], queries.ORACLES[name], DIRECTORY
    )
    assert problem is None and rows > 0, problem

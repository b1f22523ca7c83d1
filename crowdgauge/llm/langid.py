"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed text.

A word is a run of letters (every non-ASCII character counts as one while runs are cut). Its score in
a language is the sum of log probabilities of its four-byte windows, its borders included. The script
of its first character leaves only languages that were seen in that script. Viterbi over the words,
with a penalty for each change of language, labels spans; the language with most bytes is the
document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge.llm import text as X

#: First and last code point of the ranges that tell scripts apart.
SCRIPTS = (
    ("Latin", 0x41, 0x24F),
    ("Greek", 0x370, 0x3FF),
    ("Cyrillic", 0x400, 0x52F),
    ("Armenian", 0x530, 0x58F),
    ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F),
    ("Devanagari", 0x900, 0x97F),
    ("Bengali", 0x980, 0x9FF),
    ("Tamil", 0xB80, 0xBFF),
    ("Thai", 0xE00, 0xE7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0xAC00, 0xD7AF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x4E00, 0x9FFF),
)
BUCKETS = 1 << 16
UNDETERMINED = "und"
_CHUNK = 1 << 19
_GAP = 32
_OTHER = len(SCRIPTS)

_NORMAL = np.full(256, _GAP, np.uint8)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def _script_table() -> np.ndarray:
    """Script by the first two bytes of a character."""
    table = np.full((256, 256), _OTHER, np.uint8)
    for i, (_, first, last) in enumerate(SCRIPTS):
        for point in range(first, last + 1):
            lead = chr(point).encode()
            if len(lead) == 1:
                table[lead[0], :] = i
            else:
                table[lead[0], lead[1]] = i
    return table.reshape(-1)


_SCRIPT = _script_table()


def _words(raw: np.ndarray, starts: np.ndarray):
    """(bucket of every byte of a word, size of each word, its script, first word of each document,
    begin and end of each word)."""
    normal = _NORMAL[raw]
    b, e, words = X.spans(normal != _GAP, starts)
    if not len(b):
        return np.zeros(0, np.uint32), b, np.zeros(0, np.uint8), words, b, e
    wide = normal.astype(np.uint32)
    before, two, after = (np.full(len(raw), _GAP, np.uint32) for _ in range(3))
    before[1:], two[2:], after[:-1] = wide[:-1], wide[:-2], wide[1:]
    before[b] = two[b] = _GAP
    second = b + 1
    two[second[second < len(raw)]] = _GAP
    after[e - 1] = _GAP
    window = (two << 24) | (before << 16) | (wide << 8) | after
    bucket = ((window * np.uint32(2654435761)) >> np.uint32(16))[normal != _GAP]
    following = raw[np.minimum(second, len(raw) - 1)].astype(np.int64)
    return bucket, e - b, _SCRIPT[(raw[b].astype(np.int64) << 8) | following], words, b, e


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of each language's buckets and scripts, one set of rows per task."""
    totals: dict[str, np.ndarray] = {}
    for batch in X.small(batches):
        langs = batch.column("lang").to_pylist()
        for low, high, raw, starts in X.chunks(batch.column("text"), _CHUNK):
            bucket, size, script, words, _, _ = _words(raw, starts)
            names = sorted(set(langs[low:high]))
            code = np.array([names.index(x) for x in langs[low:high]])
            of_word = np.repeat(code, np.diff(words))
            of_byte = np.repeat(of_word, size)
            grams = np.bincount(of_byte * BUCKETS + bucket, minlength=len(names) * BUCKETS)
            kinds = np.bincount(of_word * (_OTHER + 1) + script, minlength=len(names) * (_OTHER + 1))
            for i, name in enumerate(names):
                total = totals.setdefault(name, np.zeros(BUCKETS + _OTHER + 1, np.int64))
                total[:BUCKETS] += grams[i * BUCKETS : (i + 1) * BUCKETS]
                total[BUCKETS:] += kinds[i * (_OTHER + 1) : (i + 1) * (_OTHER + 1)]
    for name, total in totals.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())],
            names=["lang", "bucket", "n"],
        )


@dataclass
class Model:
    """Log probabilities by bucket and language, and the languages each script allows."""

    langs: list[str]
    scores: np.ndarray
    allowed: np.ndarray


def learn(docs: DataFrame, smoothing: float = 0.5, least: float = 0.001) -> Model:
    """A model from ``docs(text, lang)``; rows with a null text or language teach nothing.

    Counts cover all given rows and are summed by Spark; the driver gets at most ``BUCKETS`` numbers
    for each language. A script belongs to a language that writes ``least`` of its words in it.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    rows = known.mapInArrow(_count, "lang string, bucket int, n bigint")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + _OTHER + 1, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[found["bucket"], found["lang"].map(place).astype(int)] = found["n"]
    grams, kinds = counts[:BUCKETS], counts[BUCKETS:]
    total = grams.sum(axis=0) + smoothing * BUCKETS
    scores = (np.log(grams + smoothing) - np.log(total)).astype(np.float32)
    allowed = kinds >= np.maximum(1, least * kinds.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True  # an unseen script rules nobody out
    return Model(langs, scores, allowed)


#: Score of a word in a language that its script rules out, below its best score.
_RULED_OUT = 30.0
#: Log probability of a byte in the unknown class, to which all windows are alike.
_UNKNOWN = -float(np.log(BUCKETS))


def _emissions(model: Model, bucket, size, script) -> tuple[np.ndarray, np.ndarray]:
    """Score of every word in every language, the best being 0, and the best's log probability."""
    first = np.cumsum(size) - size
    scores = np.add.reduceat(model.scores[bucket], first, axis=0)
    fits = model.allowed[script]
    scores = np.where(fits, scores, -np.inf)
    top = scores.max(axis=1, keepdims=True)
    scores -= top
    return np.maximum(scores, -_RULED_OUT), top[:, 0]


def viterbi(scores: np.ndarray, first: np.ndarray, stop: np.ndarray, penalty: float) -> list[np.ndarray]:
    """The best label of every word of each document [first, stop), all documents step by step.

    A label sequence scores the sum of its words' scores less ``penalty`` for each change.
    """
    order = np.argsort(first - stop, kind="stable")
    begin, size = first[order], (stop - first)[order]
    steps = int(size.max()) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    stays = np.zeros((len(scores), scores.shape[1]), bool)
    leader = np.zeros(len(scores), np.int64)
    value = scores[begin].astype(np.float64)
    for t in range(1, steps):
        n = active[t]
        now = value[:n]
        lead = now.argmax(axis=1)
        change = now[np.arange(n), lead][:, None] - penalty
        at = begin[:n] + t
        keep = now >= change
        stays[at], leader[at] = keep, lead
        value[:n] = np.where(keep, now, change) + scores[at]
    label = np.zeros(len(scores), np.int64)
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = np.where(stays[at, state[:n]], state[:n], leader[at])
    return [label[a:b] for a, b in zip(first, stop, strict=True)]


def _label(model: Model, scores, words, penalty):
    """Label of every word. A document without a stretch in which another language gains half the
    penalty over the best one has one span: no number of changes can pay there."""
    labels = np.zeros(len(scores), np.int64)
    mixed = []
    for i in range(len(words) - 1):
        a, b = words[i], words[i + 1]
        if a == b:
            continue
        own = scores[a:b]
        best = int(own.sum(axis=0).argmax())
        gain = np.zeros((b - a + 1, scores.shape[1]))
        np.cumsum(own - own[:, best : best + 1], axis=0, out=gain[1:])
        rise = gain - np.minimum.accumulate(gain, axis=0)
        if rise.max() < penalty / 2:
            labels[a:b] = best
        else:
            mixed.append(i)
    if mixed:
        at = np.array(mixed)
        for i, found in zip(mixed, viterbi(scores, words[at], words[at + 1], penalty), strict=True):
            labels[words[i] : words[i + 1]] = found
    return labels


def _predict(shared, penalty: float, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array([*model.langs, UNDETERMINED], object)
        for batch in X.small(batches):
            out = [[], [], [], [], [], [], []]
            for low, high, raw, starts in X.chunks(batch.column("text"), _CHUNK):
                for whole, part in zip(out, _predict_chunk(model, raw, starts, penalty), strict=True):
                    whole.append(part)
            lang, share, known, count, begin, end, of_span = (
                np.concatenate(x) if x else np.zeros(0, np.int64) for x in out
            )
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(count, out=offsets[1:])
            spans = pa.StructArray.from_arrays(
                [pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(names[of_span.astype(int)], pa.string())],
                names=["begin", "end", "lang"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in columns),
                    pa.array(names[lang.astype(int)], pa.string()),
                    pa.array(share, pa.float64()),
                    pa.array(known, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(offsets), spans),
                ],
                names=[*columns, "lang_pred", "score", "known", "spans"],
            )

    return run


def _predict_chunk(model: Model, raw: np.ndarray, starts: np.ndarray, penalty: float):
    """Per document: language, score, known, number of spans; per span: begin, end (bytes), language."""
    n, none = len(starts) - 1, len(model.langs)
    lang, share, known, count = np.full(n, none), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    begin, end, of_span = [], [], []
    bucket, size, script, words, b, e = _words(raw, starts)
    if len(b) and none:
        scores, top = _emissions(model, bucket, size, script)
        labels = _label(model, scores, words, penalty)
        for i in range(n):
            a, z = words[i], words[i + 1]
            if a == z:
                continue
            own = raw[starts[i] : starts[i + 1]]
            plain = ((own | 32) - np.uint8(97)) < 26
            if not plain.any() and not any(c.isalpha() for c in own.tobytes().decode()):
                continue
            label = labels[a:z]
            breaks = np.flatnonzero(np.diff(label)) + 1
            firsts, lasts = np.append(0, breaks) + a, np.append(breaks, z - a) + a - 1
            bytes_of = np.bincount(label, weights=size[a:z], minlength=none)
            best = int(bytes_of.argmax())
            total = scores[a:z].sum(axis=0, dtype=np.float64)
            # one span: how sure the whole text is; several: the text is mixed, and the share tells
            posterior = 1.0 / np.exp(np.minimum(total - total[best], 50.0)).sum() if len(firsts) == 1 else 1.0
            lang[i], share[i] = best, bytes_of[best] / bytes_of.sum() * posterior
            reached = scores[np.arange(a, z), label] + top[a:z]
            known[i] = size[a:z][reached > _UNKNOWN * size[a:z]].sum() / bytes_of.sum()
            count[i] = len(firsts)
            begin.append(b[firsts] - starts[i])
            end.append(e[lasts] - starts[i])
            of_span.append(labels[firsts])
    empty = [np.zeros(0, np.int64)]
    return lang, share, known, count, *(np.concatenate(x or empty) for x in (begin, end, of_span))


def identify(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), known (0 to 1) and spans (begin, end, lang; offsets in
    UTF-8 bytes).

    ``lang_pred`` has most bytes of letters; ``score`` is its share of them, and where all are its own,
    its probability for the whole text. Both compare the learned languages with each other; ``known`` is
    absolute: the share of bytes in words that their span's language explains better than a class to which
    all windows are alike. Random letters and languages that were not learned have little. Null and empty texts and texts without a letter are ``und`` with score 0 and
    without spans, and so is everything if nothing was learned. Only ``text`` is read; other columns
    pass unchanged, and must not be called like the four new ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(
        _predict(shared, penalty, docs.columns),
        f"{fields}, lang_pred string, score double, known double, "
        "spans array<struct<begin: int, end: int, lang: string>>",
    )


def held_out(id_column: str = "doc_id") -> F.Column:
    """Documents that are never learned from: a fifth by the checksum of the id; rows without one too."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))

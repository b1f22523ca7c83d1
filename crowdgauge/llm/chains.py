"""Classifier chains: 0/1 categories predicted one after the other by linear models on words.

Each category's logistic model sees the words of a text and the probabilities of the categories
before it. In training those probabilities are out of fold: a row's come from models that have not
seen it, so a later model learns how far to trust an earlier one on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge.llm import text as X
from crowdgauge.llm.langid import _GAP, _NORMAL
from crowdgauge.llm.ngram_join import pick
from crowdgauge.runtime import pin, unpin

_U = np.uint64


def _word_lists(column: pa.Array):
    """(first row, document of each word, its hash) of chunks; words are runs of letters, in lower case."""
    for low, high, raw, starts in X.chunks(column):
        normal = _NORMAL[raw]
        b, e, words = X.spans(normal != _GAP, starts)
        doc = np.repeat(np.arange(high - low), np.diff(words))
        yield low, high, doc, X.span_hashes(normal, b, e, X._BYTES)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.small(batches):
        lists = []
        for low, high, doc, hashes in _word_lists(batch.column("text")):
            cuts = np.searchsorted(doc, np.arange(high - low + 1))
            lists += [X.signed(np.unique(hashes[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), X.list_array(lists, pa.int64())], names=["doc_id", "words"]
        )


@dataclass
class Chain:
    """Sorted vocabulary and, for each category, weights (words, earlier categories, bias) and the
    probability from which it is predicted."""

    categories: list[str]
    words: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, doc: np.ndarray, word: np.ndarray, n: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        size = len(self.words)
        for w in self.weights:
            z = w[-1] + np.bincount(doc, weights=w[word], minlength=n)
            for j, p in enumerate(out):
                z += w[size + j] * _logit(p)
            out.append(_sigmoid(z))
        return out

    def places(self, doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, word) once for each known word of a document."""
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        both = np.unique(doc[known] * max(1, len(self.words)) + at[known])
        return np.divmod(both, max(1, len(self.words)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_logistic(
    row: np.ndarray, word: np.ndarray, more: np.ndarray, y: np.ndarray, size: int, penalty: float = 1e-3, rounds: int = 150
) -> np.ndarray:
    """Weights of words, of the columns of ``more`` and the bias: full-batch AdaGrad, from zero.

    A word counts by how far it tells the classes apart, the absolute log ratio of its shares in them,
    so that the few words that matter are not drowned by all others of a long text.
    """
    n, extra = len(y), more.shape[1]
    w = np.zeros(size + extra + 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    w[-1] = np.log(share / (1 - share))
    in_yes = np.bincount(word, weights=y[row], minlength=size) + 1
    in_no = np.bincount(word, minlength=size) + 2 - in_yes
    scale = np.abs(np.log(in_yes / (y.sum() + 2)) - np.log(in_no / (n - y.sum() + 2)))
    square = np.full(len(w), 1e-8)
    for _ in range(rounds if n else 0):
        z = w[-1] + np.bincount(row, weights=(w[:size] * scale)[word], minlength=n) + more @ w[size : size + extra]
        miss = (_sigmoid(z) - y) / n
        of_words = np.bincount(word, weights=miss[row], minlength=size) * scale
        grad = np.concatenate([of_words, miss @ more, [miss.sum()]])
        grad[:-1] += penalty * w[:-1]
        square += grad * grad
        w -= 0.3 * grad / np.sqrt(square)
    w[:size] *= scale
    return w


def _train(size: int, target: str, earlier: list[str], folds: int):
    """One model of a category without one fold's rows (``fold`` = ``folds``: with all of them), and
    its probabilities for the rows left out."""

    def run(table: pa.Table) -> pa.Table:
        left_out = table.column("left_out")[0].as_py()
        own = table.column("fold").to_numpy()
        y = table.column(target).to_numpy().astype(float)
        lists = table.column("words").combine_chunks()
        counts = np.diff(lists.offsets.to_numpy())
        word = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(y)), counts)
        more = np.stack([_logit(table.column(f"p_{c}").to_numpy()) for c in earlier], axis=1) if earlier else np.zeros((len(y), 0))
        learn = own != left_out
        new = np.cumsum(learn) - 1
        used = learn[row]
        w = fit_logistic(new[row[used]], word[used], more[learn], y[learn], size)
        z = w[-1] + np.bincount(row, weights=w[word], minlength=len(y)) + more @ w[size:-1]
        test = np.flatnonzero(~learn)
        n = len(test)
        return pa.table(
            {
                "left_out": pa.array([left_out] * (n + 1), pa.int32()),
                "row": pa.array(np.append(table.column("row").to_numpy()[test], -1), pa.int64()),
                "p": pa.array(np.append(_sigmoid(z[test]), 0.0), pa.float64()),
                "weights": pa.array([None] * n + [w.tolist()], pa.list_(pa.float64())),
            }
        )

    return run


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1; among equals the one nearest to a half."""
    best, at = -1.0, 0.5
    for t in sorted(np.arange(5, 96) / 100, key=lambda t: abs(t - 0.5)):
        hit = ((p >= t) & (y > 0)).sum()
        f1 = 2 * hit / max(1, (p >= t).sum() + (y > 0).sum())
        if f1 > best + 1e-12:
            best, at = f1, float(t)
    return at


def learn(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    sample: int = 12_000,
    vocabulary: int = 1 << 16,
    least: int = 3,
    folds: int = 5,
) -> Chain:
    """A chain over ``categories``, 0/1 columns of ``labels(doc_id, ...)``, in the given order.

    At most ``sample`` labelled rows, chosen by the hash of their id, are learned from, and at most
    ``vocabulary`` words, those of most of these texts and of ``least`` at least. The models of the
    folds are trained as tasks; what is collected is bounded by both. Rows with a null label, id or
    text teach nothing; without any, every probability is one half and nothing is predicted.
    """
    names = list(categories)
    wanted = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in names))
    chosen = pin(
        wanted.dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(sample)
    )
    ids = pin(chosen.select("doc_id").distinct())
    slim = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = pin(pick(slim, ids).mapInArrow(_distinct_words, "doc_id bigint, words array<bigint>"))
    common = (
        texts.select(F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= least)
        .orderBy(F.desc("n"), "word")
        .limit(vocabulary)
    )
    words = np.sort(np.array([r["word"] for r in common.collect()], np.int64).view(_U))
    chain = Chain(names, words)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lists = []
            for x in batch.column("words"):
                h = x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                lists.append(at[known[at] == h] if len(known) else at[:0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), X.list_array(lists, pa.int64())], names=["doc_id", "words"]
            )

    rows = pin(
        texts.mapInArrow(number, "doc_id bigint, words array<bigint>")
        .join(chosen, "doc_id")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(folds)).cast("int"))
    )
    unpin(chosen, ids, texts)
    size = len(words)
    if rows.isEmpty():
        chain.weights = [np.zeros(size + j + 1) for j in range(len(names))]
        chain.thresholds = [2.0] * len(names)
        return chain
    for j, name in enumerate(names):
        spread = rows.withColumn("left_out", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        found = pin(
            spread.groupBy("left_out").applyInArrow(
                _train(size, name, names[:j], folds), "left_out int, row bigint, p double, weights array<double>"
            )
        )
        full = found.filter(f"left_out = {folds} AND row = -1").select("weights").collect()
        chain.weights.append(np.array(full[0]["weights"]))
        out = found.filter(f"left_out < {folds} AND row >= 0").select("row", F.col("p").alias(f"p_{name}"))
        more = pin(rows.join(out, "row"))
        judged = more.select(f"p_{name}", name).toPandas()
        chain.thresholds.append(best_threshold(judged[f"p_{name}"].to_numpy(), judged[name].to_numpy()))
        unpin(rows, found)
        rows = more
    return chain


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category> ..., <category> ...) of ``docs(doc_id, text)``: probabilities, and whether
    they reach the threshold. A null or empty text has the probabilities of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.categories

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Chain = shared.value
        for batch in X.small(batches):
            parts = [[np.zeros(0)] for _ in names]
            for low, high, doc, hashes in _word_lists(batch.column("text")):
                for part, p in zip(parts, model.probabilities(*model.places(doc, hashes), high - low), strict=True):
                    part.append(p)
            found = [np.concatenate(p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(p) for p in found),
                    *(pa.array(p >= t) for p, t in zip(found, model.thresholds, strict=True)),
                ],
                names=["doc_id", *(f"p_{c}" for c in names), *names],
            )

    schema = ", ".join(["doc_id bigint", *(f"p_{c} double" for c in names), *(f"{c} boolean" for c in names)])
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, schema)

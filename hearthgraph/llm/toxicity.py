"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents are labelled. Each sentence's score is a power of a logistic function
of its words (POWER), a document's score is the noisy-or of its sentences, and the likelihood of the document labels trains the
words' weights. The same scores then rate documents and locate the offending sentences. A sentence's prior falls with the
document's number of sentences n: ln(n) / POWER is taken off its logit, so the scores of harmless sentences are about 1 / n
each and add up to the same however long the document is, and no threshold is needed below which a sentence would not
count. A toxic sentence of a long document needs that much more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, sampled

WORD = re.compile(r"[^\W\d_]+")
#: A word's features are the word itself and its beginnings of these lengths, which inflected words share.
BEGINNINGS = (3, 4, 5, 6, 7)
#: So many words' weights are kept in a task between look-ups.
CACHED_WORDS = 200_000
SENTENCE = re.compile(r"[.!?\n]+")
#: A document of the sample: its features in page order, the features of each sentence, the label.
SAMPLE = pa.schema({"_id": pa.string(), "flat": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32()), "_y": pa.int32()})
#: The power of the logistic function: the higher, the less a document's length costs each sentence.
POWER = 6


@dataclass(frozen=True)
class Settings:
    """sample_docs: about so many labelled documents of either class are fitted on. min_docs: a word needs so many of
    them to get a weight. max_share: and is in at most this share of them. bias: a sentence's logit without known words, at the start. leak: a document's score
    without any sentence. l1, l1_docs: penalty of a weight, at least that share of one toxic document. rounds, rate: of Adam."""

    sample_docs: int = 1_500
    min_docs: int = 4
    max_share: float = 0.5
    bias: float = -2.0
    leak: float = 0.01
    l1: float = 1e-4
    l1_docs: float = 0.3
    rounds: int = 150
    rate: float = 0.15


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    leak: float


def features(word: str) -> list[str]:
    """The word, and its beginnings marked with '-'."""
    return [word, *[word[:k] + "-" for k in BEGINNINGS if k < len(word)]]


class Weights(dict):
    """Word to the sum of its features' weights, filled as words come and emptied when full."""

    def __init__(self, model: Model):
        self.model = model.weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        get = self.model.get
        self[word] = w = sum(get(f, 0.0) for f in features(word))
        return w


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans between sentence ends; parts without a word are left out."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        if WORD.search(text, at, m.start()):
            out.append((at, m.start()))
        at = m.end()
    if WORD.search(text, at):
        out.append((at, len(text)))
    return out


def lowered(text: str) -> str:
    """Lower case of the same length, so that spans are the original's; letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def length_cost(n: int) -> float:
    """What n sentences take off each one's logit."""
    return math.log(max(n, 1)) / POWER


def counted(z: float) -> float:
    """What a sentence with this logit adds to the noisy-or, in training as in scoring."""
    return (1 + math.exp(-min(max(z, -30.0), 30.0))) ** -POWER


def noisy_or(p: np.ndarray, leak: float) -> float:
    return float(1 - (1 - leak) * np.exp(np.log1p(-np.clip(p, 0, 1 - 1e-12)).sum()))


def _sums(index: np.ndarray, values: np.ndarray, of: np.ndarray, n: int, block: int = 1 << 20) -> np.ndarray:
    """Sum of values[of] by index, in blocks, so that no temporary is as long as the words."""
    out = np.zeros(n)
    for lo in range(0, len(index), block):
        out += np.bincount(index[lo : lo + block], weights=values[of[lo : lo + block]], minlength=n)
    return out


def train(words: np.ndarray, sizes: np.ndarray, per_doc: np.ndarray, labels: np.ndarray, n_words: int, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias from feature numbers in page order, features a sentence and sentences a document. Deterministic."""
    words = words.astype(np.int32)
    sent = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    doc = np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc)
    y, n = labels.astype(float), len(per_doc)
    cost = (np.log(np.maximum(per_doc, 1)) / POWER)[doc]
    balance = np.where(y == 1, n / max(2 * y.sum(), 1), n / max(2 * (n - y.sum()), 1))
    theta = np.append(_log_odds(words, sent, doc, y, n_words), s.bias)
    l1 = max(s.l1, s.l1_docs / (2 * max(y.sum(), 1)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, s.rounds + 1):
        z = _sums(sent, theta, words, len(sizes)) + theta[-1] - cost
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        # 1 - p**k = (1 - p)(1 + p + ... + p**(k - 1))
        rest = sum(p**i for i in range(POWER))
        log_no = np.log1p(-s.leak) + np.bincount(doc, weights=np.log(rest) - np.logaddexp(0, z), minlength=n)
        none = np.exp(log_no)
        yes = np.clip(1 - none, 1e-9, None)
        # d log-likelihood / d z of a sentence: -d where the label is 0, d * P(none) / P(some) where it is 1, with
        # d = -d log(1 - p**k) / d z = k p**k / (1 + p + ... + p**(k - 1))
        pull = balance * np.where(y == 1, none / yes, -1.0)
        g_z = POWER * p**POWER / rest * pull[doc]
        grad = np.zeros_like(theta)
        grad[:-1] = _sums(words, g_z, sent, n_words) / n
        grad[-1] = g_z.sum() / n
        # the penalty pushes towards 0 and keeps a weight at 0 unless its gradient outweighs it
        own = grad[:-1]
        grad[:-1] = np.where(theta[:-1] == 0, np.sign(own) * np.maximum(np.abs(own) - l1, 0), own - l1 * np.sign(theta[:-1]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = s.rate * min(1.0, 2 * (1 - step / (s.rounds + 1)))
        moved = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        moved[:-1][np.sign(moved[:-1]) * np.sign(theta[:-1]) < 0] = 0
        theta = moved
    return theta[:-1], float(theta[-1])


def _log_odds(words: np.ndarray, sent: np.ndarray, doc: np.ndarray, y: np.ndarray, n_words: int) -> np.ndarray:
    """A start for the weights: each word's log odds in documents of either class, less two standard errors."""
    pos, neg = np.zeros(n_words), np.zeros(n_words)
    # documents lie one after the other, so a block of them has all their words
    bound = np.searchsorted(sent, np.searchsorted(doc, np.arange(0, len(y) + 100, 100)))
    for lo, hi in zip(bound, bound[1:], strict=False):
        w, d = np.divmod(np.unique(words[lo:hi].astype(np.int64) * len(y) + doc[sent[lo:hi]]), len(y))
        pos += np.bincount(w, weights=y[d], minlength=n_words)
        neg += np.bincount(w, weights=1 - y[d], minlength=n_words)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / (len(y) - y.sum() + 1))
    error = 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    return np.sign(odds) * np.maximum(np.abs(odds) - error, 0) if n_words else np.zeros(0)


def _numbers(low: str, a: int, b: int, number: dict[str, int]) -> list[int]:
    """The known features of a sentence's distinct words."""
    return [number[f] for w in sorted(set(WORD.findall(low, a, b))) for f in features(w) if f in number]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", s: Settings = Settings()) -> Model:
    """labelled: texts with labels 0 and 1; other labels and null texts are left out. Without rows of both classes
    nothing is learnt and every score is the leak."""
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(label_col).cast("int").alias("_y"))
    sizes = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return Model({}, s.bias, s.leak)
    chosen = [(F.col("_y") == y) & sampled(F.col("_id").cast("string"), s.sample_docs / n) for y, n in sizes.items()]
    rows = rows.where(chosen[0] | chosen[1])

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for f in {f for w in set(WORD.findall(lowered(text))) for f in features(w)}:
                    seen[f] = seen.get(f, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "docs"])

    counts = rows.select("_t").mapInArrow(words_of, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    fitted = sum(min(n, s.sample_docs) for n in sizes.values())
    usual = counts.where((F.col("docs") >= s.min_docs) & (F.col("docs") <= max(s.min_docs, s.max_share * fitted)))
    vocabulary = sorted(usual.select("word").toArrow()["word"].to_pylist())  # bounded by the sample
    number = {w: i for i, w in enumerate(vocabulary)}

    def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = [], []
            for text in batch.column(1).to_pylist():
                text = lowered(text)
                own = [_numbers(text, a, b, number) for a, b in sentences(text)]
                flat.append(np.array([f for x in own for f in x], np.int32))
                sizes.append(np.array([len(x) for x in own], np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, kind), pa.array(sizes, kind), batch.column(2)], schema=SAMPLE)

    n_words = len(vocabulary)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task holds the sample, which sample_docs bounds; the driver gets the weights only."""
        if not (held := [b for b in batches if b.num_rows]):
            return
        sample = pa.Table.from_batches(held).sort_by("_id")
        flat, sizes = sample["flat"].combine_chunks(), sample["sizes"].combine_chunks()
        per_doc, labels = sizes.value_lengths().to_numpy(), sample["_y"].to_numpy()
        flat, sizes = flat.flatten().to_numpy(), sizes.flatten().to_numpy()
        del held, sample
        theta, bias = train(flat, sizes, per_doc, labels, n_words, s)
        del flat, sizes
        give_back()  # the worker lives on for later tasks
        on = np.append(np.flatnonzero(theta), n_words)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(np.append(theta, bias)[on])], ["feature", "weight"])

    bags = rows.select(F.col("_id").cast("string").alias("_id"), "_t", "_y").mapInArrow(bags_of, "_id string, flat array<int>, sizes array<int>, _y int")
    got = bags.repartition(1).mapInArrow(trained, "feature int, weight double").toArrow()
    weights = dict(zip(got["feature"].to_pylist(), got["weight"].to_pylist()))
    bias = weights.pop(n_words, s.bias)
    model = Model({vocabulary[f]: w for f, w in weights.items()}, bias, s.leak)
    del got, weights, number, vocabulary
    give_back()
    return model


def sentence_scores(text: str, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, score) of each sentence."""
    low = lowered(text)
    spans, weights = sentences(low), Weights(model)
    base = model.bias - length_cost(len(spans))
    return [(a, b, counted(base + sum(weights[w] for w in sorted(set(WORD.findall(low, a, b)))))) for a, b in spans]


def score_text(text: str, weights: Weights, bias: float, leak: float) -> tuple[float, int, int]:
    """(score, sentences, sentences that alone make the document toxic)."""
    own = []
    for part in SENTENCE.split(lowered(text)):
        if words := set(WORD.findall(part)):
            own.append(sum(weights[w] for w in sorted(words)))
    base, log_no, offending = bias - length_cost(len(own)), math.log1p(-leak), 0
    for z in own:
        log_no += math.log1p(-min(counted(base + z), 1 - 1e-12))
        offending += counted(base + z) >= 0.5
    return 1 - math.exp(log_no), len(own), offending


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id (or the columns `keep`), score, predicted, n_sentences, n_offending. Null text counts as empty and scores the
    leak, and so does a text without words. Repeated rows stay and score alike; a kept column named like a result is refused."""
    keep = keep or [id_col]
    if clash := {"score", "predicted", "n_sentences", "n_offending"} & set(keep):
        raise ValueError(f"columns named like results: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for batch in batches:
            got = [score_text(t.as_py() or "", weights, model.bias, model.leak) for t in batch.column(0)]
            p = np.array([x[0] for x in got])
            yield pa.RecordBatch.from_arrays([
                *batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()),
            ], [*keep, "score", "predicted", "n_sentences", "n_offending"])
        del weights
        give_back()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(F.col(text_col).alias("_scored"), *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int, n_sentences long, n_offending long")


def offending(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, start, end, sentence, score: the sentences that reach `least`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, a, b, t[a:b], p) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for a, b, p in sentence_scores(t, model) if p >= least]
            cols = list(zip(*rows)) if rows else [[] for _ in range(5)]
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [id_col, "start", "end", "sentence", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, end long, sentence string, score double")

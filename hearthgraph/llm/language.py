"""Language identification with bit-sliced Bloom filters over byte n-grams.

One table of 64-bit words serves 64 languages (further languages have tables of their own at the same positions): bit l
of a word is language l's Bloom filter. And-ing the words at an n-gram's positions gives the bitmask of every language that has the n-gram in one look-up. A text's language is the
one with the largest popcount after the expected false positives are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, pieces, sampled, utf8

#: Letters: a-z and every byte of a character beyond ASCII; the rest separates words.
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class Settings:
    """n: bytes of an n-gram. sample_docs: about so many labelled documents of each language are fitted on. min_docs: an
    n-gram needs so many of them, or as many as the language's most frequent n-gram has, if those are fewer. min_share: a language has an n-gram if its rate there reaches this share of the highest rate in any
    language, so words of other languages in a language's documents don't count as its own. log2_words: size of the
    filter (8 bytes a word, broadcast). hashes: positions of an n-gram."""

    n: int = 4
    sample_docs: int = 5_000
    min_docs: int = 3
    min_share: float = 0.2
    log2_words: int = 19
    hashes: int = 3


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # most frequent first, so a tie goes to the likelier one
    words: np.ndarray  # tables of 64 languages x positions
    false_rate: np.ndarray
    settings: Settings


def grams(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, row) of all rows: words in lower case, each run of other bytes as one blank, a blank at both ends."""
    if n > 8:
        raise ValueError("an n-gram has at most 8 bytes")
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off) + 1)
    at = np.arange(len(raw)) + np.repeat(np.arange(len(off) - 1), np.diff(off)) + 1
    b = np.full(len(raw) + len(off), 32, np.uint8)  # a blank before each row and after the last
    b[at] = np.where(_LETTER[raw], raw, 32)
    rows = np.append(rows, max(len(off) - 2, 0))
    blank = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (rows[1:] != rows[:-1])
    b, rows = b[keep], rows[keep]
    m = len(b) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = np.zeros(m, U64)
    for j in range(n):
        g |= b[j : j + m].astype(U64) << U64(8 * j)
    same = rows[:m] == rows[n - 1 :]
    same |= (rows[:m] == rows[n - 2 : n - 2 + m]) & (b[n - 1 :] == 32) & (b[n - 2 : n - 2 + m] != 32)  # the next row's blank closes this row's last word
    return g[same], rows[:m][same]


def positions(g: np.ndarray, s: Settings) -> list[np.ndarray]:
    h = mix64(g)
    step = (h >> U64(32)) | U64(1)
    mask = U64((1 << s.log2_words) - 1)
    return [((h + U64(i) * step) & mask).astype(np.int64) for i in range(s.hashes)]


def masks(g: np.ndarray, model: Model) -> np.ndarray:
    """The bitmask of languages that have each n-gram: a row for each 64 languages."""
    out = None
    for p in positions(g, model.settings):
        out = model.words[:, p] if out is None else out & model.words[:, p]
    return out


def build(languages: list[str], by_gram: dict[int, list[int]], s: Settings) -> Model:
    words = np.zeros((-(-len(languages) // 64) or 1, 1 << s.log2_words), U64)
    own: list[list[int]] = [[] for _ in languages]
    for g, bits in by_gram.items():
        for bit in bits:
            own[bit].append(g)
    for bit, grams_ in enumerate(own):
        for p in positions(np.array(sorted(grams_), dtype=U64), s):
            words[bit // 64, p] |= U64(1 << bit % 64)
    fill = np.array([np.count_nonzero(words[bit // 64] & U64(1 << bit % 64)) for bit in range(len(languages))]) / words.shape[1]
    return Model(tuple(languages), words, fill**s.hashes, s)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", s: Settings = Settings()) -> Model:
    """Learn from labelled rows (null labels are left out): about `sample_docs` of each language, chosen by a hash of the id.

    Without any labelled row the model has no language and every text is 'und'. Null texts have no n-gram; a language
    without any is none. Repeated rows count each time.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    share = {r["_l"]: s.sample_docs / r["count"] for r in rows.groupBy("_l").count().collect()}
    if any(x < 1 for x in share.values()):
        rows = rows.where(sampled(F.col("_id").cast("string"), F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("_l")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                raw, off = utf8(pc.utf8_lower(batch.column(0).filter(pa.array(langs == lang))))
                for i, j in pieces(off):
                    g, row = grams(raw[off[i] : off[j]], off[i : j + 1] - off[i], s.n)
                    u, docs_, n = _per_gram(g, row)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(docs_), pa.array(n)], ["lang", "gram", "docs", "n"])

    counts = rows.select("_t", "_l").mapInArrow(count, "lang string, gram long, docs long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    size = {r["lang"]: (r["docs"], r["n"]) for r in counts.groupBy("lang").agg(F.max("docs").alias("docs"), F.sum("n").alias("n")).collect()}
    languages = sorted(size, key=lambda k: (-size[k][0], k))
    most = F.create_map(*[F.lit(x) for k in languages for x in (k, min(s.min_docs, size[k][0]))])[F.col("lang")] if languages else F.lit(1)
    counts = counts.where(F.col("docs") >= most).toArrow()  # bounded by the sample
    by_gram: dict[int, list[int]] = {}
    rates: dict[int, dict[int, float]] = {}
    bit = {k: i for i, k in enumerate(languages)}
    for lang, gram, n in zip(counts["lang"].to_pylist(), counts["gram"].to_numpy().view(U64).tolist(), counts["n"].to_pylist()):
        rates.setdefault(gram, {})[bit[lang]] = n / size[lang][1]
    for gram, own in rates.items():
        top = max(own.values())
        by_gram[gram] = [b for b, r in own.items() if r >= s.min_share * top]
    return build(languages, by_gram, s)


def _per_gram(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-gram, rows that have it, times it occurs)."""
    if not len(g):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((row, g))
    g, row = g[order], row[order]
    new = np.r_[True, g[1:] != g[:-1]]
    first = np.flatnonzero(new)
    fresh = new | np.r_[True, row[1:] != row[:-1]]
    return g[first], np.add.reduceat(fresh.astype(np.int64), first), np.diff(np.append(first, len(g)))


def popcounts(raw: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(rows x languages, n-grams found in each language's filter; n-grams of each row)."""
    n_rows, k = len(off) - 1, len(model.languages)
    out, total = np.zeros((n_rows, k)), np.zeros(n_rows)
    for i, j in pieces(off):
        g, row = grams(raw[off[i] : off[j]], off[i : j + 1] - off[i], model.settings.n)
        m = masks(g, model)
        total[i:j] = np.bincount(row, minlength=j - i)
        for bit in range(k):
            out[i:j, bit] = np.bincount(row[(m[bit // 64] >> U64(bit % 64)) & U64(1) == 1], minlength=j - i)
    return out, total


PREDICTION = "lang_pred string, score double, n_grams long"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (the winner's share of all corrected popcounts), n_grams.

    Null texts and texts without a letter are 'und' with score 0. A tie goes to the language with more training
    documents. A text none of whose n-grams is known gets that language too, with score 0.
    """
    m = model  # travels with the function, which Spark broadcasts: 2**log2_words * 8 bytes, a parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(pc.utf8_lower(batch.column(1)))
            hits, total = popcounts(raw, off, m)
            found = np.clip((hits - total[:, None] * m.false_rate) / (1 - m.false_rate), 0, None)
            best = found.argmax(axis=1) if m.languages else np.zeros(len(total), int)
            whole = found.sum(axis=1)
            score = np.divide(found.max(axis=1, initial=0), whole, out=np.zeros(len(whole)), where=whole > 0)
            names = []
            for i, b in enumerate(best):
                text = raw[off[i] : off[i + 1]]
                letters = bool(m.languages) and (bool(((text >= 97) & (text <= 122)).any()) or any(map(str.isalpha, text.tobytes().decode("utf-8"))))
                names.append(m.languages[b] if letters else "und")
                score[i] = score[i] if letters else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(total.astype(np.int64))], [id_col, "lang_pred", "score", "n_grams"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {PREDICTION}")

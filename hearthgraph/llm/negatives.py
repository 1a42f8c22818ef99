"""Hard-negative mining by exact inner-product search in an orthogonally rotated space.

Rows are rotated onto the principal axes of all rows' second moments, the strongest first. The inner product of the
leading components is exact up to rounding; the rest is at most the product of both residual norms (Cauchy-Schwarz).
A pair whose leading product, that bound and a slack for rounding together miss its threshold is discarded; the others
get further components, and those that stay to the end the integer product of the unrotated components, which alone decides.

Anchors are a fixed share of the rows. They are handled in passes of a bounded number, which is broadcast; each pass
maps over the written rows where they lie, so rows are not shuffled. Only each task's best few of an anchor are.

1. Second moments of all rows by partial sums, at most dim * dim numbers for a task.
2. A pass finds each anchor's positives: in a task, an anchor's threshold is its fifth best so far.
3. A second map finds the negatives of each positive: between the share of its score and its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back

#: Anchors of a pass: with 64 components, 16 MB are broadcast.
ANCHORS = 65_536
#: Rows and anchors compared at once; a task starts with fewer rows, whose best give the first thresholds. Pairs multiplied at once.
FIRST_ROWS, ROWS_AT_ONCE, ANCHORS_AT_ONCE, PAIRS_AT_ONCE = 64, 2048, 1024, 32_768
#: Shares of the components after which pairs are discarded.
STAGES = (1 / 8, 1 / 4, 1 / 2)
#: A pair's rounding error in double precision is below this times both norms.
SLACK = 1e-11
#: Below every product.
NONE = -(1 << 62)


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component, x as a double."""
    return F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long"))


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """_id, _label, _v of the rows that take part."""
    base = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_l"), F.col(vector_col).alias("_x"))
    whole = base.where("_id IS NOT NULL AND _l IS NOT NULL AND size(_x) > 0 AND forall(_x, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE))")
    label = F.when(F.col("_id") % 7 == 0, (F.col("_l") + 1) % 10).otherwise(F.col("_l"))
    # products of size(_x) components have to fit a long
    return whole.where("forall(_x, x -> abs(CAST(x AS DOUBLE)) < pow(2, 22) / sqrt(size(_x)))").select("_id", label.alias("_label"), whole_numbers(F.col("_x")).alias("_v"))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.int64)


def axes(rows: DataFrame, dim: int) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal axes of all rows' second moments, the strongest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            total += x.T @ x if len(x) else 0
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], ["k", "s"])

    sums = rows.select("_v").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    moments = np.zeros(dim * dim)
    for r in sums:
        moments[r["k"]] = r["s"]
    values, vectors = np.linalg.eigh(moments.reshape(dim, dim))
    return vectors[:, np.argsort(-values)]


class Rotated:
    """Vectors with their leading components and the norms of what follows each stage."""

    def __init__(self, v: np.ndarray, q: np.ndarray):
        dim = q.shape[0]
        self.v = v
        self.y = v.astype(np.float64) @ q
        self.norm = np.sqrt((self.y * self.y).sum(1))
        self.ends = sorted({min(dim, max(1, round(s * dim))) for s in STAGES})
        self.rest = [np.sqrt((self.y[:, e:] ** 2).sum(1)) for e in self.ends]


def _products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of x and j of y."""
    out = np.empty(len(i), x.dtype)
    for s in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(s, s + PAIRS_AT_ONCE)
        out[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]])
    return out


def candidates(a: Rotated, r: Rotated, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, integer product) of every pair whose product may reach the anchor's low, and some that do not."""
    e = a.ends[0]
    part = a.y[:, :e] @ r.y[:, :e].T
    need = low[:, None] - SLACK * a.norm[:, None] * r.norm[None, :] - 1e-6
    i, j = np.nonzero(part + a.rest[0][:, None] * r.rest[0][None, :] >= need)
    part, need = part[i, j], need[i, j]
    for k in range(1, len(a.ends)):
        part = part + _products(a.y[:, e : a.ends[k]], i, r.y[:, e : a.ends[k]], j)
        e = a.ends[k]
        stay = part + a.rest[k][i] * r.rest[k][j] >= need
        i, j, part, need = i[stay], j[stay], part[stay], need[stay]
    return i, j, _products(a.v, i, r.v, j)


class Best:
    """The k best (score, smallest id) of each of n lists so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def low(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        stay = score >= self.score[which, -1]
        which, score, ids = which[stay], score[stay], ids[stay]
        if not len(which):
            return
        touched = np.unique(which)
        all_which = np.concatenate([np.repeat(touched, self.k), which])
        all_score = np.concatenate([self.score[touched].ravel(), score])
        all_id = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((all_id, -all_score, all_which))
        w = all_which[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        order, w, rank = order[rank < self.k], w[rank < self.k], rank[rank < self.k]
        self.score[w, rank], self.id[w, rank] = all_score[order], all_id[order]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, k = np.nonzero(self.id != np.iinfo(np.int64).max)
        return i, self.score[i, k], self.id[i, k]


def _compared(batches: Iterator[pa.RecordBatch], q: np.ndarray, ids: np.ndarray, anchors: np.ndarray, low) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, its row's label, its row's id, product) of the pairs that stay, a block at a time; low(blocks) gives the thresholds then."""
    blocks = [(k, Rotated(anchors[k : k + ANCHORS_AT_ONCE], q)) for k in range(0, len(anchors), ANCHORS_AT_ONCE)]
    size = FIRST_ROWS
    for batch in batches:
        at, label, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
        end = 0
        while end < len(at):
            part = slice(end, end + size)
            end, size = end + size, min(2 * size, ROWS_AT_ONCE)
            rows = Rotated(v[part], q)
            for k, block in blocks:
                i, j, product = candidates(block, rows, low(k, k + len(block.v)))
                i += k
                other = at[part][j] != ids[i]
                yield i[other], label[part][j[other]], at[part][j[other]], product[other]


def _emit(best: Best, per: int) -> Iterator[pa.RecordBatch]:
    i, score, ids = best.found()
    yield pa.RecordBatch.from_arrays([pa.array((i // per).astype(np.int32)), pa.array((i % per).astype(np.int32)), pa.array(score), pa.array(ids)], ["anchor", "slot", "score", "id"])
    give_back()


_FOUND = "anchor int, slot int, score long, id long"


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k first of each anchor and slot with their rank."""
    by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _pass(rows: DataFrame, q: np.ndarray, got: pa.Table, k: int, low_share: int, high_share: int) -> DataFrame:
    """The result for at most ANCHORS anchors."""
    sc = rows.sparkSession.sparkContext
    ids, label, v = got["_id"].to_numpy(), got["_label"].to_numpy(), np.concatenate([_matrix(c) for c in got["_v"].chunks if len(c)])
    sent = sc.broadcast((ids, label, v))

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, v = sent.value
        best = Best(len(ids), k)
        for i, other, at, product in _compared(batches, q, ids, v, lambda a, b: best.low()[a:b].astype(np.float64)):
            same = other == label[i]
            best.add(i[same], product[same], at[same])
        yield from _emit(best, 1)

    near = _first(rows.mapInArrow(positives, _FOUND), k).select("anchor", "rank", "score", "id").toArrow()
    high = np.full((len(ids), k), NONE)
    who = np.zeros((len(ids), k), np.int64)
    a, r = near["anchor"].to_numpy(), near["rank"].to_numpy() - 1
    high[a, r], who[a, r] = near["score"].to_numpy(), near["id"].to_numpy()
    found = np.zeros((len(ids), k), bool)
    found[a, r] = True
    # low_share * positive <= 100 * negative <= high_share * positive, in whole numbers
    scaled = np.where(found, high, 0)
    least, most = -((-low_share * scaled) // 100), (high_share * scaled) // 100
    bounds = sc.broadcast((found & (least <= most), least, most))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, v = sent.value
        open_, least, most = bounds.value
        best = Best(len(ids) * k, k)

        def low(a: int, b: int) -> np.ndarray:
            of = np.maximum(least[a:b], best.low()[a * k : b * k].reshape(-1, k))
            return np.where(open_[a:b], of, np.inf).min(1)

        for i, other, at, product in _compared(batches, q, ids, v, low):
            new = other != label[i]
            i, at, product = i[new], at[new], product[new]
            for slot in range(k):
                fits = open_[i, slot] & (least[i, slot] <= product) & (product <= most[i, slot])
                best.add(i[fits] * k + slot, product[fits], at[fits])
        yield from _emit(best, k)

    chosen = _first(rows.mapInArrow(negatives, _FOUND), k)
    table = pa.table({"anchor": a.astype(np.int32), "slot": r.astype(np.int32), "anchor_id": ids[a], "positive_id": who[a, r], "positive_score": high[a, r]})
    names = rows.sparkSession.createDataFrame(table)
    return chosen.join(names, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, every: int = 100, k: int = 5, low_share: int = 80, high_share: int = 100, anchors: int = ANCHORS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by every. The positives of an anchor are the k rows of its label with the
    greatest integer product; each gets the k different-label rows with the greatest product between the two shares (in
    hundredths) of its own. Ties go to the smaller id. Where the id is divisible by 7 the label becomes (label + 1) % 10
    first.

    Rows without id, label or vector, with an empty vector, a null or non-finite component, or components so large that
    products may leave a long (2**22 over the root of the length, before the factor 256) take no part, nor do vectors
    of another length than most have (the smaller length in a tie). A row never meets a row of its own id. Rows repeated
    whole are partners as often as they stand; a repeated anchor is one anchor, and of anchors that differ under one id
    the one with the smallest label and vector counts. Other columns are ignored.
    """
    spark = rows.sparkSession
    base = cut(usable(rows, id_col, label_col, vector_col))
    sizes = base.groupBy(F.size("_v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], SCHEMA)
    dim = sizes[0]["dim"]
    base = base.where(F.size("_v") == dim)
    q = axes(base, dim)
    own = base.where(F.col("_id") % every == 0).groupBy("_id").agg(F.min(F.struct("_label", "_v")).alias("x")).select("_id", "x.*")
    own = cut(own)
    n = own.count()
    out = spark.createDataFrame([], SCHEMA)
    n_passes = math.ceil(n / (anchors // 2 or 1)) if n > anchors else 1
    for p in range(n_passes):
        # ids are dealt by hash, so a pass holds about half of what may be broadcast
        mine_ = own if n_passes == 1 else own.where(F.pmod(F.xxhash64("_id"), F.lit(n_passes)) == p)
        got = mine_.toArrow()
        if got.num_rows:
            done = _pass(base, q, got, k, low_share, high_share)
            out = done if n_passes == 1 else out.unionByName(cut(done))
    return out

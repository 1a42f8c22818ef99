"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

A first permutation scatters shingles over a circle of places; a second one holds the places' values. Coordinate k of a
signature is the least value over a set's places after the values are shifted k places round the circle, so two
permutations give all coordinates, and a shingle's values for all of them stand side by side in one table.

1. A map over the texts gives each document's set signature and, once for each set in a task, its bands: hashes of ROWS
   coordinates each. Equal sets are one class from here on.
2. Classes that share no band with another class are done. The sets of the others are read again.
3. First each class is compared with one leader of its buckets; a pair is linked if the whole sets reach the threshold.
   Buckets that lie in one component hold nothing new. In the others, round by round, those outside a bucket's largest
   component are compared with a member of it, drawn anew for each bucket and round, until little is left to compare or
   rounds no longer help. So a large group of near copies costs a comparison each, and a few for those that fail it.
4. What is left over: members outside a bucket's largest component meet all of the bucket, held against the sizes and
   a parity bitmap of the sets, each pair in its first common bucket only, and are compared.

Two sets of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS, 1 - 6e-11 at 0.85; every pair whose
bands meet is decided by its whole sets or lies in one component already.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, drop, mix64, pieces, snug, utf8
from .graph import closer, components
from .jaccard_join import BROADCAST_ROWS, SETS, _bitmap, _entity, shingles, signatures

#: Places on the circle, bands and coordinates in each.
PLACES, BANDS, ROWS = 1 << 20, 32, 4
#: Shingles whose values are looked up at once.
AT_ONCE = 4096
#: Words of the parity bitmap, and bands that a row carries to find out whether it is a pair's first.
WORDS, HEAD = 8, 6
#: Rounds of leaders go on while the rest would compare more pairs than this for each class, and while the last round
#: brought them below this share of what they were.
WORTHWHILE, FALLING = 32, 0.9
_BITS = [f"b{k}" for k in range(WORDS)]


class Circulant:
    """Signatures of sets of 64-bit shingle hashes. Both permutations follow from the seed."""

    def __init__(self, seed: int = 11, places: int = PLACES, bands: int = BANDS, rows: int = ROWS):
        self.places, self.bands, self.rows = U64(places), bands, rows
        self.salt = mix64(np.array([seed], U64))[0]
        values = np.random.default_rng(seed).permutation(places).astype(np.uint32)
        k = bands * rows
        # values[place - k] for k = 0, 1, ..: read downwards from the place, so stored the other way round
        ring = np.concatenate([np.resize(values[::-1], k - 1)[::-1], values])[::-1].copy()
        self.windows = np.lib.stride_tricks.sliding_window_view(ring, k)

    def places_of(self, x: np.ndarray) -> np.ndarray:
        """The first permutation: a bijection of 64-bit hashes, then their place on the circle."""
        return (mix64(x ^ self.salt) % self.places).astype(np.int64)

    def signatures(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Coordinates of each non-empty set x[bound[i]:bound[i + 1]]."""
        n = len(bound) - 1
        out = np.full((n, self.bands * self.rows), np.uint32(0xFFFFFFFF))
        at = int(self.places) - 1 - self.places_of(x)
        row = np.repeat(np.arange(n), np.diff(bound))
        for s in range(0, len(x), AT_ONCE):
            who = row[s : s + AT_ONCE]
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            least = np.minimum.reduceat(self.windows[at[s : s + AT_ONCE]], starts, axis=0)
            out[who[starts]] = np.minimum(out[who[starts]], least)
        return out

    def bands_of(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each band, different in different bands."""
        sig = self.signatures(x, bound).reshape(-1, self.bands, self.rows).astype(U64)
        h = np.broadcast_to(mix64(np.arange(1, self.bands + 1, dtype=U64)), sig.shape[:2]).copy()
        for k in range(self.rows):
            h = mix64(h * U64(0xD6E8FEB86659FD93) + sig[:, :, k] + U64(1))
        return h.view(np.int64)


def _light(k: int, make):
    """id, set signature and size of each document, and the bands of each set that a task meets first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = make(), set()
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for i, j in pieces(off):
                x, bound = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                s1, s2, n = signatures(x, bound)
                fresh = []
                for r in np.flatnonzero(n).tolist():
                    key = (int(s1[r]), int(s2[r]))
                    if key not in seen:
                        seen.add(key)
                        fresh.append(r)
                own = [x[bound[r] : bound[r + 1]] for r in fresh]
                ends = np.cumsum([0, *map(len, own)])
                bands = hasher.bands_of(np.concatenate(own), ends) if own else np.zeros((0, hasher.bands), np.int64)
                held = np.zeros(j - i, np.int64)
                held[fresh] = hasher.bands
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)].astype(np.int32)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(s1), pa.array(s2), pa.array(n.astype(np.int32)), lists], ["id", "s1", "s2", "n", "bands"])

    return run


def _ent() -> Column:
    return F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("s1", "s2")])


def _postings(light: DataFrame) -> DataFrame:
    """bucket, ent, root, n, head: a class in a bucket that it shares with another class, as its own component.

    head: its first bands before this one. Classes in a bucket are told apart by 64 bits until they are compared."""
    one = light.where("size(bands) > 0").dropDuplicates(["s1", "s2"])
    rows = one.select("s1", F.posexplode("bands").alias("k", "bucket"))
    # written first, so that only one of both shuffles of all bands lies on disk, and neither has more than a band's numbers
    shared = cut(rows.groupBy("bucket").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("bucket"))
    full = one.select("s1", _ent().alias("ent"), "n", F.slice("bands", 1, HEAD).alias("head"))
    own = rows.join(shared, "bucket", "left_semi").join(full, "s1")
    return own.select("bucket", "ent", F.col("ent").alias("root"), "n", F.slice("head", F.lit(1), F.least("k", F.lit(HEAD))).alias("head"))


def _sets(base: DataFrame, classes: DataFrame, able: DataFrame, n_able: int, k: int) -> DataFrame:
    """ent, n, ts (the whole set), b0.. (its parity bitmap) of the classes that share a bucket."""
    reps = classes.withColumn("ent", _ent()).join(able, "ent", "left_semi").select(F.col("rep").alias("id")).distinct()
    if n_able <= BROADCAST_ROWS:
        reps = F.broadcast(reps)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for i, j in pieces(off):
                x, bound = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                s1, s2, n = signatures(x, bound)
                maps = np.array([_bitmap(x[bound[r] : bound[r + 1]]) for r in range(j - i)], np.int64).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays([
                    _entity(s1, s2), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(x.view(np.int64))), *[pa.array(maps[:, w].copy()) for w in range(WORDS)],
                ], ["ent", "n", "ts", *_BITS])

    texts = base.join(reps, base["id"].eqNullSafe(reps["id"]), "left_semi").select("text")
    kind = "ent binary, n int, ts array<long>, " + ", ".join(f"{b} long" for b in _BITS)
    return cut(snug(texts.mapInArrow(whole, kind).join(able, "ent", "left_semi").dropDuplicates(["ent"]), n_able, SETS))


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets whose members are still of several components, with the components so far."""
    rows = rows.drop("root").join(roots.withColumnRenamed("node", "ent"), "ent", "left").withColumn("root", F.coalesce("root", "ent"))
    several = rows.groupBy("bucket").agg(F.min(F.xxhash64("root")).alias("lo"), F.max(F.xxhash64("root")).alias("hi")).where("lo <> hi").select("bucket")
    return rows.join(several, "bucket", "left_semi")


def _sizes(percent: int) -> str:
    return f"a_root <> b_root AND 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"


def _bits(percent: int) -> str:
    """Sets of that similarity differ in at most this many elements, and in at least as many as their bitmaps in bits."""
    return f"{100 + percent} * ({' + '.join(f'bit_count(a_{b} ^ b_{b})' for b in _BITS)}) <= {100 - percent} * (a_n + b_n)"


def _sided(rows: DataFrame, side: str, cols: list[str]) -> DataFrame:
    return rows.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in cols])


def _main(rows: DataFrame) -> DataFrame:
    """bucket, main: the largest component of each bucket that has several."""
    counts = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("bucket", F.col("m.root").alias("main"))


def _led(rows: DataFrame, r: int, percent: int) -> DataFrame:
    """a, b: classes with leaders of their buckets that are of another component.

    The first round draws by one order for all buckets, so a large group has few leaders, and a class meets the one that
    leads most of its buckets. Later each bucket and round draws a member of the bucket's largest component: only those
    outside meet it, and a class meets as many different ones as it has bands."""
    cols = ["ent", "root", "n"]
    pair = [F.least("a_ent", "b_ent").alias("a"), F.greatest("a_ent", "b_ent").alias("b")]
    if r == 0:
        lead = rows.groupBy("bucket").agg(F.min_by(F.struct(*cols), F.xxhash64("ent")).alias("x")).select("bucket", "x.*")
        met = _sided(rows, "a", cols).join(_sided(lead, "b", cols), "bucket").where(_sizes(percent))
        votes = met.groupBy("a_ent", "b_ent").agg(F.count(F.lit(1)).alias("votes"))
        return votes.groupBy("a_ent").agg(F.max(F.struct("votes", "b_ent")).alias("x")).select("a_ent", "x.b_ent").select(*pair).distinct()
    at = rows.join(_main(rows), "bucket")
    lead = at.where("root = main").groupBy("bucket").agg(F.min_by(F.struct(*cols), F.xxhash64(F.lit(r), "bucket", "ent")).alias("x")).select("bucket", "x.*")
    met = _sided(at.where("root <> main"), "a", cols).join(_sided(lead, "b", cols), "bucket").where(_sizes(percent))
    return met.select(*pair).distinct()


def _left_over(rows: DataFrame) -> int:
    """The pairs that _met would hold against their bounds."""
    counts = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(F.sum("c").alias("n"), F.max("c").alias("most"))
    return counts.agg(F.sum(F.expr("(n - most) * n"))).first()[0] or 0


def _met(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of different components that come through, each once."""
    cols = ["ent", "root", "n", "head", *_BITS]
    at = rows.join(_main(rows), "bucket").join(sets.select("ent", *_BITS), "ent")
    near = _sided(at.where("root <> main"), "a", cols).join(_sided(at, "b", cols), "bucket").where(f"{_sizes(percent)} AND {_bits(percent)} AND NOT arrays_overlap(a_head, b_head)")
    return near.select(F.least("a_ent", "b_ent").alias("a"), F.greatest("a_ent", "b_ent").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs a, b whose whole sets reach the threshold."""
    cols = ["n", "ts", *_BITS]
    left, right = (sets.select(F.col("ent").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols]) for s in "ab")
    # the bitmaps first: they spare most pairs of unlike sets the sets themselves
    slim = pairs.join(left.drop("a_ts"), "a").join(right.drop("b_ts"), "b").where(_bits(percent)).select("a", "b")
    full = slim.join(left.select("a", "a_n", "a_ts"), "a").join(right.select("b", "b_n", "b_ts"), "b")
    common = F.size(F.array_intersect("a_ts", "b_ts"))
    return full.where(100 * common >= percent * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")


def _roots(base: DataFrame, light: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """node, root for every class with a link."""
    rows = cut(_postings(light))
    able = cut(rows.select("ent").distinct())
    n_able = able.count()
    if not n_able:
        return None
    sets = _sets(base, classes, able, n_able, k)
    found = roots = None
    left = float("inf")
    for r in itertools.count():
        links = cut(snug(_verified(_led(rows, r, percent), sets, percent), n_able, SETS))
        new = links.count()
        found = links if found is None else found.unionByName(links)
        # leaders make stars, which two steps bring together; what they leave apart only stays to be compared
        roots = cut(snug(closer(roots, found, n_able, steps=2), n_able, SETS))
        before, rows = rows, cut(_open(rows, roots))
        drop(before)
        left_before, left = left, _left_over(rows) if new or r == 0 else 0
        if left <= WORTHWHILE * n_able or left > FALLING * left_before:
            break
    pairs = cut(snug(_met(rows, sets, percent), n_able, SETS))
    found = found.unionByName(cut(snug(_verified(pairs, sets, percent), n_able, SETS)))
    for table in (rows, pairs, sets):
        drop(table)
    return components(found)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85, make=Circulant) -> DataFrame:
    """id, n_shingles, component_id, kept for each row; links are pairs with 100 * intersection >= percent * union.

    Sets hold k-word shingles of the text with A-Z lowered; fewer words are one shingle. Null and empty texts and texts
    without words have none, link with nothing and stay. Equal sets are linked. Null ids take part and get null or the
    component's smallest id; such a row stays if its component has no id. Rows repeated whole are repeated and
    marked alike. Other columns are ignored. Sets are compared whole, by 64-bit hashes of their shingles, classes by
    128 bits.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    light = cut(base.mapInArrow(_light(k, make), "id long, s1 long, s2 long, n int, bands array<long>"))
    rows = light.select("id", "s1", "s2", "n")
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    roots = _roots(base, light, classes, k, percent)
    named = classes.withColumn("component_id", F.col("rep"))
    if roots is not None:
        by_root = classes.withColumn("node", _ent()).join(roots, "node")
        moved = by_root.join(by_root.groupBy("root").agg(F.min("rep").alias("least")), "root").select("s1", "s2", "least")
        named = classes.join(moved, ["s1", "s2"], "left").withColumn("component_id", F.coalesce("least", "rep"))
    # one more key than the classes are dealt by: both sides are dealt anew, and hot classes can be split
    key = F.xxhash64("s1", "s2")
    out = rows.withColumn("_k", key).join(named.select("s1", "s2", "component_id", key.alias("_k")), ["_k", "s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

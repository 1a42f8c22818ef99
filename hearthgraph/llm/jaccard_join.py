"""Similarity join of documents on word shingles, by prefix filters under several token orders.

Two sets whose Jaccard similarity reaches 3/4 differ in at most a seventh of the sum of their sizes, so under any order
of all tokens they share a token early in both. Every order gives such a filter; a pair is compared only if it passes
all of them.

1. A map over the texts gives each document's set signature; equal sets are one class from here on.
2. Under a hash order with frequent tokens last, the first 7/16 of each class's tokens are sent out by token, as 40 bits
   each. Similar sets share 3/4 of the larger set and at most 9/16 of it stays behind, so they share at least 3/16 of it
   among what is sent, and classes with fewer shared tokens are done.
3. The whole sets of the remaining classes are counted by token. Three orders, rarest token first and each with other
   ties, give each class three prefixes; tokens of no other class come first and bring no candidates.
4. The first order's prefixes are joined by token. The join itself holds a pair against the bounds that follow from both
   positions, both sizes and a parity bitmap of the tokens, and lets it through only at its first shared token.
5. Pairs that come through must share prefix tokens under the other two orders too, then their sets are compared.

Step 4 first compares each class with one leader of its lists, round by round, as long as that links many. Lists that
are known to lie in one component then hold nothing new; in the others the members outside the list's largest component are joined
with all of the list. So large groups of near copies cost a comparison each, not one for each pair, and no pair that
could add to the components is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, cut, drop, mix64, pieces, prefix_hash, snug, span_hash, utf8
from .graph import closer, components

#: Fixed by the contract: A-Z to lower case, and what separates words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A token in this share of the documents is frequent; there are at most 100 times as many as a document has tokens.
FREQUENT = 0.01
#: Up to so many rows of numbers are broadcast, else joined by key.
BROADCAST_ROWS = 500_000
ORDERS = 3
#: A further round of leaders follows one that linked at least this share of what the first round linked.
WORTHWHILE = 0.1
#: Sets to a partition, where their number is known.
SETS = 20_000
#: Words of 64 bits in a set's parity bitmap, and prefix tokens that a row carries to find out whether it is a pair's first.
WORDS, HEAD = 8, 6


def shingles(raw: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of each row's distinct shingles in ascending order, row offsets into them)."""
    n_rows = len(off) - 1
    b = _LOWER[raw]
    word = ~_SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, U64), np.zeros(n_rows + 1, np.int64)
    h = mix64(span_hash(prefix_hash(b), start, end) + (end - start).astype(U64))
    row = np.searchsorted(off, start, side="right") - 1
    count = np.bincount(row, minlength=n_rows)
    begin = np.cumsum(count) - count
    m = max(0, len(h) - k + 1)
    x = _chain([h[j : j + m] for j in range(k)])
    whole = row[:m] == row[k - 1 :] if m else np.zeros(0, bool)
    parts, rows = [x[whole]], [row[:m][whole]]
    for short in range(1, k):
        which = np.flatnonzero(count == short)
        if len(which):
            parts.append(_chain([h[begin[which] + j] for j in range(short)]) ^ U64(short))
            rows.append(which)
    x, row = np.concatenate(parts), np.concatenate(rows)
    if len(parts) > 1:
        order = np.argsort(row, kind="stable")
        x, row = x[order], row[order]
    bound = np.searchsorted(row, np.arange(n_rows + 1))
    for i in range(n_rows):
        x[bound[i] : bound[i + 1]].sort()
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[fresh], np.searchsorted(row[fresh], np.arange(n_rows + 1))


def _chain(words: list[np.ndarray]) -> np.ndarray:
    x = np.full(len(words[0]), len(words), U64)
    for w in words:
        x = mix64(x * U64(0xD6E8FEB86659FD93) + w)
    return x


def signatures(x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits and the size of each row's set."""
    size = np.diff(bound)
    out = []
    for values in (mix64(x + U64(1)), mix64(x ^ U64(0xA5A5A5A5A5A5A5A5))):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(values)])
        out.append(mix64(total[bound[1:]] - total[bound[:-1]] + size.astype(U64)).view(np.int64))
    return out[0], out[1], size


def early(n: np.ndarray | int):
    """So many of a set's tokens are sent out first."""
    return -(-7 * n // 16)


def _short(own: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The distinct 40-bit forms of tokens sent out first, and how many of them a class of n tokens must share to have a
    similar one. Tokens that fall together are taken off that number; those of two classes that do only leave more to compare."""
    short = np.unique(own & U64((1 << 40) - 1))
    return short, max(1, -(-3 * n // 16) - (len(own) - len(short)))


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows without id for tokens that are frequent within a piece of the batch."""
    for batch in batches:
        raw, off = utf8(batch.column(1))
        for i, j in pieces(off):
            x, bound = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            s1, s2, n = signatures(x, bound)
            yield _rows(batch.column(0).slice(i, j - i), s1, s2, n, True)
            token, count = np.unique(x, return_counts=True)
            often = count >= max(4, FREQUENT / 2 * (j - i))
            if often.any():
                yield _rows(pa.nulls(int(often.sum()), pa.int64()), token[often].view(np.int64), np.zeros(often.sum(), np.int64), count[often], False)


def _rows(ids, s1: np.ndarray, s2: np.ndarray, n: np.ndarray, doc: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(s1), pa.array(s2), pa.array(n.astype(np.int64)), pa.array(np.full(len(n), doc))], ["id", "s1", "s2", "n", "doc"])


def _order(x: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Ascending tokens to the first order: frequent ones last."""
    if not len(frequent) or not len(x):
        return x
    late = frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x
    return np.concatenate([x[~late], x[late]])


def _prefixes(tokens: np.ndarray, df: np.ndarray, n: int) -> list[np.ndarray]:
    """The prefixes of a set under each order: rarest first, ties by another hash in each. tokens: those that other sets
    have too, with their counts; the n - len(tokens) others stand before them under every order."""
    keep = n - -(-3 * n // 4) + 1 - (n - len(tokens))
    out = []
    for k in range(ORDERS):
        rank = df if k < 2 else np.log2(df).astype(np.int64)
        out.append(tokens[np.lexsort((mix64(tokens + U64(k)), rank))[:keep]])
    return out


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of tokens falls on i. Two sets differ in at least as many tokens as their bitmaps in bits."""
    odd = np.bincount((mix64(tokens ^ U64(0x3C6EF372FE94F82B)) % U64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _entity(s1: np.ndarray, s2: np.ndarray) -> pa.Array:
    """128 bits as 16 bytes."""
    data = np.stack([s1, s2], axis=1).astype(">i8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(s1), [None, pa.py_buffer(np.arange(0, 16 * len(s1) + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(data)])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs a, b that share prefix tokens under the other orders and whose sets reach the threshold."""
    cols = ["n", "ts", *[f"p{k}" for k in range(1, ORDERS)]]
    left = sets.select(F.col("ent").alias("a"), *[F.col(c).alias("a_" + c) for c in cols])
    right = sets.select(F.col("ent").alias("b"), *[F.col(c).alias("b_" + c) for c in cols])
    full = pairs.join(left, "a").join(right, "b").where(" AND ".join(f"arrays_overlap(a_p{k}, b_p{k})" for k in range(1, ORDERS)))
    common = F.size(F.array_intersect("a_ts", "b_ts"))
    return full.where(100 * common >= 75 * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row; links are pairs with 100 * intersection >= 75 * union.

    Null and empty texts and texts without words have no shingle, link with nothing and are their own component.
    Equal sets are linked. Null ids take part and get null or the component's smallest id. Rows repeated whole are
    repeated. Other columns are ignored. Sets are compared by 64-bit hashes of their shingles, classes by 128 bits.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    light = cut(base.mapInArrow(_light, "id long, s1 long, s2 long, n long, doc boolean"))
    rows = light.where("doc").drop("doc")
    ent = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("s1", "s2")])
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    roots = _roots(base, light, classes)
    by_root = classes.withColumn("node", ent).join(roots, "node")
    least = by_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = by_root.join(least, "root").select("s1", "s2", "n", "component_id")
    named = classes.join(moved, ["s1", "s2", "n"], "left").select("s1", "s2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    # one more key than the classes are dealt by: both sides are dealt anew, and hot classes can be split
    key = F.xxhash64("s1", "s2", "n")
    out = rows.withColumn("_k", key).join(named.withColumn("_k", key), ["_k", "s1", "s2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))


def _able(base: DataFrame, light: DataFrame) -> DataFrame:
    """s1 of the classes that share enough tokens with others under the first order. Classes are told apart by 64 bits
    here: two that agree in them can only be missed if they are similar too, and else stay for the exact steps."""
    n_docs = light.where("doc").count()
    often = light.where(~F.col("doc")).groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT * n_docs)
    frequent = np.sort(np.array([r["s1"] for r in often.collect()], np.int64).view(U64))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for i, j in pieces(off):
                x, bound = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                s1, s2, n = signatures(x, bound)
                token, size = [], []
                for r in range(j - i):
                    key = (int(s1[r]), int(s2[r]))
                    if n[r] and key not in seen:
                        seen.add(key)
                        own, need = _short(_order(x[bound[r] : bound[r + 1]], frequent)[: early(n[r])], int(n[r]))
                        token.append(own)
                        size.append((len(own), need, s1[r]))
                if token:
                    many = np.array([s[0] for s in size])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(token).view(np.int64)), pa.array(np.repeat(np.array([s[2] for s in size], np.int64), many)), pa.array(np.repeat(np.array([s[1] for s in size], np.int64), many)),
                    ], ["token", "ent", "need"])

    by_token = Window.partitionBy("token")
    sent = base.select("text").mapInArrow(postings, "token long, ent long, need long")
    shared = sent.withColumns({"_lo": F.min("ent").over(by_token), "_hi": F.max("ent").over(by_token)}).where("_lo <> _hi")
    # a class met in several tasks has its tokens several times; they lie together by token, and only numbers go on
    once = shared.select("token", "ent", "need").distinct()
    return once.groupBy("ent", "need").agg(F.count(F.lit(1)).alias("c")).where("c >= need").select(F.col("ent").alias("s1"))


def _sets(base: DataFrame, classes: DataFrame, able: DataFrame) -> tuple[DataFrame, int]:
    """ent, n, ts, u, b0.., p0.. of the classes that can have a partner: the tokens that others have too, the number of
    tokens that none has, the parity bitmap of ts, and the prefixes. Also how many classes there were before."""
    n_able = able.count()
    reps = classes.join(able.distinct(), "s1", "left_semi").select(F.col("rep").alias("id")).distinct()
    if n_able <= BROADCAST_ROWS:
        reps = F.broadcast(reps)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for i, j in pieces(off):
                x, bound = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                s1, s2, n = signatures(x, bound)
                yield pa.RecordBatch.from_arrays([_entity(s1, s2), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(x.view(np.int64)))], ["ent", "n", "tokens"])

    texts = base.join(reps, base["id"].eqNullSafe(reps["id"]), "left_semi").select("text")
    full = cut(texts.mapInArrow(whole, "ent binary, n int, tokens array<long>").where("n > 0").dropDuplicates(["ent"]))
    spread = full.select("ent", "n", F.explode("tokens").alias("token"))
    # written first, so that only one of both shuffles of all tokens lies on disk; lists of numbers take half of what structs take
    counts = cut(full.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    common = spread.join(counts, "token").groupBy("ent", "n").agg(F.collect_list("token").alias("ts"), F.collect_list("df").alias("df")).where("4 * size(ts) >= 3 * n")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, n = batch.column(2), batch.column(1).to_numpy()
            bound = np.r_[0, np.cumsum(ts.value_lengths().to_numpy(), dtype=np.int64)].astype(np.int32)
            token, df = ts.flatten().to_numpy().view(U64), batch.column(3).flatten().to_numpy()
            own = [token[i:j] for i, j in zip(bound, bound[1:], strict=False)]
            got = [_prefixes(t, df[i : i + len(t)], m) for t, i, m in zip(own, bound, n.tolist(), strict=False)]
            maps = np.array([_bitmap(t) for t in own], np.int64).reshape(-1, WORDS)
            lists = [pa.array([g[k].view(np.int64) for g in got], pa.list_(pa.int64())) for k in range(ORDERS)]
            cols = [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bound), pa.array(token.view(np.int64))), pa.array((n - np.diff(bound)).astype(np.int32)), *[pa.array(maps[:, k].copy()) for k in range(WORDS)], *lists]
            yield pa.RecordBatch.from_arrays(cols, ["ent", "n", "ts", "u", *_BITS, *[f"p{k}" for k in range(ORDERS)]])

    kind = "ent binary, n int, ts array<long>, u int, " + ", ".join(f"{b} long" for b in _BITS) + ", " + ", ".join(f"p{k} array<long>" for k in range(ORDERS))
    sets = cut(snug(common.mapInArrow(prefixes, kind), n_able, SETS))
    drop(full)
    drop(counts)
    return sets, n_able


_BITS = [f"b{k}" for k in range(WORDS)]
#: What a row of a token's list carries besides the token.
_CARRIED = ["ent", "root", "n", "u", "pos", "head", *_BITS]


def _postings(sets: DataFrame) -> DataFrame:
    """A row for each prefix token under the first order, with its position and the class as its own component."""
    rows = sets.select("ent", F.col("ent").alias("root"), "n", "u", *_BITS, F.slice("p0", 1, HEAD).alias("head"), F.posexplode("p0").alias("k", "token"))
    return rows.select("token", "ent", "root", "n", "u", (F.col("u") + F.col("k")).alias("pos"), F.slice("head", F.lit(1), F.least("k", F.lit(HEAD))).alias("head"), *_BITS)


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members are still of several components, with the components so far."""
    rows = rows.drop("root").join(roots.withColumnRenamed("node", "ent"), "ent", "left").withColumn("root", F.coalesce("root", "ent"))
    lists = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return rows.join(lists, "token", "left_semi")


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(f"{side}_{c}") for c in _CARRIED])


#: What follows from similarity where a pair meets at its first shared token: the tokens before it differ, and so do those
#: that no other set has and those behind the bits that differ.
_BOUNDS = f"""a_root <> b_root
    AND 7 * (a_n - a_pos) >= 3 * (a_n + b_n) AND 7 * (b_n - b_pos) >= 3 * (a_n + b_n) AND 7 * (a_pos + b_pos) <= a_n + b_n
    AND 7 * (a_u + b_u + {" + ".join(f"bit_count(a_{b} ^ b_{b})" for b in _BITS)}) <= a_n + b_n"""
#: Leaves out a pair's later shared tokens.
_FIRST = "NOT arrays_overlap(a_head, b_head)"


def _led(rows: DataFrame, r: int) -> DataFrame:
    """a, b: each class with the leader of another component that leads most of its lists."""
    lead = F.min_by(F.struct(*_CARRIED), F.xxhash64(F.lit(r), "ent"))
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), lead.alias("lead")).where("c > 1")
    met = _sided(rows, "a").join(lists.select("token", *[F.col(f"lead.{c}").alias(f"b_{c}") for c in _CARRIED]), "token").where(_BOUNDS)
    votes = met.groupBy(F.col("a_ent").alias("a"), F.col("b_ent").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("x")).select("a", F.col("x.b").alias("b"))


def _met(rows: DataFrame) -> DataFrame:
    """a, b: the pairs of different components that come through, each once."""
    sizes = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("token", F.col("m.root").alias("main"))
    at = rows.join(main, "token")
    near = _sided(at.where("root <> main"), "a").join(_sided(at, "b"), "token").where(f"{_BOUNDS} AND {_FIRST}")
    return near.select(F.least("a_ent", "b_ent").alias("a"), F.greatest("a_ent", "b_ent").alias("b")).distinct()


def _roots(base: DataFrame, light: DataFrame, classes: DataFrame) -> DataFrame:
    """node, root for every class with a link: the components of all similar pairs."""
    sets, n_able = _sets(base, classes, cut(_able(base, light)))
    rows, found, roots, least = cut(_postings(sets)), None, None, 0.0
    for r in itertools.count():
        links = cut(snug(_verified(_led(rows, r), sets), n_able, SETS))
        new = links.count()
        found = links if found is None else found.unionByName(links)
        roots = cut(snug(closer(roots, found, n_able), n_able, SETS))
        before, rows = rows, cut(_open(rows, roots))
        drop(before)
        least = WORTHWHILE * new if r == 0 else least
        if new <= least:
            break
    pairs = cut(snug(_met(rows), n_able, SETS))
    found = found.unionByName(cut(snug(_verified(pairs, sets), n_able, SETS)))
    for table in (rows, pairs, sets):
        drop(table)
    return components(found)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all its columns. Rows of one id stay or go together."""
    got = cut(join(docs, id_col, text_col))
    gone = cut(got.groupBy(F.col(id_col).alias("_gone")).agg(F.max(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("_stay")).where("NOT _stay").select("_gone"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]), "left_anti")

"""Removal of repeated byte strings, found by sorting suffixes with hash comparisons.

Every string of LENGTH bytes ("window") that also starts earlier, in a document with a smaller id or before in the same
one, is a repeat; the bytes that repeats cover go.

1. Each window has an anchor, its GRAM-byte string with the least hash. Consecutive windows with one anchor form a
   segment. Equal windows have equal anchors at equal distances, so only segments with one anchor hash can share any.
2. Equal segments are found by their hash: in a task first, so that text that a third of all rows hold is sent once a
   task, then over all. All but the first go whole.
3. Of different segments with one anchor, parts that share the bytes common to a short range of windows come together,
   and the suffixes at their window starts are sorted. Suffixes are compared by their common extension, found by binary
   search over prefix polynomial hashes; equal neighbours are verified byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, mix64, pieces, prefix_hash, span_hash, utf8

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM + 1
#: Windows of a segment are handled in ranges of their distance to the anchor; a range's windows share LENGTH - RANGE + 1 bytes.
RANGE = 20
#: Equal segments are looked for within so many bytes of text in a task.
TASK_BYTES = 1 << 26
#: An anchor with more different segments than this has its windows dealt singly.
HOT = 20_000
#: So many segments are cut into windows at once, and equal windows are looked for among so many in a task.
HOT_SEGMENTS, HOT_WINDOWS = 1 << 13, 1 << 21
SEGMENT = "key long, sub long, doc long, start int, n int, r int"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima inside blocks from both sides."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, np.iinfo(np.uint64).max, U64)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(raw: np.ndarray, off: np.ndarray, h: np.ndarray):
    """Runs of windows with one anchor: (row, first window, windows, anchor, hash of each GRAM), positions within raw."""
    n = len(raw) - GRAM + 1
    if n < REACH:
        e = np.zeros(0, np.int64)
        return e, e, e, e, np.zeros(0, U64)
    at = np.arange(n)
    g = mix64(span_hash(h, at, at + GRAM))
    bits = int(n).bit_length()
    low = U64((1 << bits) - 1)
    m = sliding_min((g & ~low) | at.astype(U64), REACH)
    anchor = (m & low).astype(np.int64)
    row_of = np.zeros(len(raw) + 1, np.int32)
    np.add.at(row_of, off[1:-1], 1)
    row = np.cumsum(row_of)
    w = len(anchor)
    inside = row[:w] == row[LENGTH - 1 : LENGTH - 1 + w]
    new = np.ones(w, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    stop = np.ones(w, bool)
    stop[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    return row[first], first, last - first + 1, anchor[first], g


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of byte spans within each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    first_of_doc = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(first_of_doc) - 1
    # running maximum of the ends within a document
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span) - group * span
    new = first_of_doc | np.r_[True, start[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.r_[first[1:] - 1, len(doc) - 1]]


def _batch(key, sub, doc, start, n, r) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x.view(np.int64) if x.dtype == U64 else x).astype(t)) for x, t in ((key, np.int64), (sub, np.int64), (doc, np.int64), (start, np.int32), (n, np.int32), (r, np.int32))], ["key", "sub", "doc", "start", "n", "r"])


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans travel in the same columns, marked by r = -1."""
    doc, start, end = _merged(doc, start, end)
    return _batch(mix64(doc.view(U64)), np.zeros(len(doc), np.int64), doc, start, end - start, np.full(len(doc), -1))


def _strictly_later(doc, start, first_doc, first_start) -> np.ndarray:
    return (doc > first_doc) | ((doc == first_doc) & (start > first_start))


def _firsts(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Each distinct one of the held segments once, and the spans of its repeats; held is emptied."""
    key, sub, doc, start, n, r = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.lexsort((start, doc, sub, key))
    key, sub, doc, start, n, r = (x[order] for x in (key, sub, doc, start, n, r))
    new = np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])] if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = _strictly_later(doc, start, doc[first], start[first])
    yield _batch(key[new], sub[new], doc[new], start[new], n[new], r[new])
    yield _spans(doc[later], start[later].astype(np.int64), start[later].astype(np.int64) + n[later] + LENGTH - 1)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to segments, each distinct one once per task, and to the spans that are repeats within the task."""
    held: list[tuple] = []
    size = 0

    for batch in batches:
        raw, off = utf8(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in pieces(off):
            part, base = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            h = prefix_hash(part)
            got = segments(part, base, h)
            if not len(got[0]):
                continue
            row, first, n, anchor, g = got
            r = anchor - first
            sub = mix64(span_hash(h, first, first + n + LENGTH - 1) + (r * 128 + n).astype(U64) * U64(0x9E3779B97F4A7C15))
            held.append((g[anchor], sub, ids[i + row], (first - base[row]).astype(np.int32), n.astype(np.int32), r.astype(np.int32)))
            size += len(part)
            if size >= TASK_BYTES:
                yield from _firsts(held)
                size = 0
    if held:
        yield from _firsts(held)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by key, sub, doc, start: equal segments after the first become spans, and the firsts of a key that
    has several different segments come out to be looked into. One row is carried from batch to batch."""
    last_first: tuple | None = None  # the last class's first row, and whether its key is known to have several
    several = False
    for batch in batches:
        key, sub, doc, start, n, r = (batch.column(k).to_numpy() for k in range(6))
        if not len(key):
            continue
        given = r == -1
        if given.any():
            yield _batch(key[given], sub[given], doc[given], start[given], n[given], r[given])
        key, sub, doc, start, n, r = (x[~given] for x in (key, sub, doc, start, n, r))
        if not len(key):
            continue
        carried = last_first is not None
        if carried:
            key, sub, doc, start, n, r = (np.r_[np.array([v], x.dtype), x] for v, x in zip(last_first, (key, sub, doc, start, n, r)))
        new = np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]
        f = np.flatnonzero(new)
        first = f[np.cumsum(new) - 1]
        later = _strictly_later(doc, start, doc[first], start[first])
        yield _spans(doc[later], start[later].astype(np.int64), start[later].astype(np.int64) + n[later] + LENGTH - 1)
        k = key[f]
        like = np.r_[False, k[1:] == k[:-1]]
        many = like | np.r_[like[1:], False]
        if carried and several:  # the carried class was given out already
            many[0] = False
        last_many = bool(like[-1]) or (len(f) == 1 and carried and several)
        out = f[many]
        yield _batch(key[out], sub[out], doc[out], start[out], n[out], r[out])
        last_first, several = tuple(x[f[-1]] for x in (key, sub, doc, start, n, r)), last_many
        # if only its first class is known so far, the next batch gives it out when a second one comes


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their segments of frequent anchors: as _locate, for each window of the segments."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        raw, off = utf8(batch.column(1))
        ids = batch.column(0).to_numpy()
        segs = batch.column(2)
        many = segs.value_lengths().to_numpy()
        flat = segs.flatten()
        start, n, r = (flat.field(k).to_numpy() for k in range(1, 4))
        owner, bound = np.repeat(np.arange(len(many)), many), np.r_[0, np.cumsum(many)]
        for i, j in pieces(off):
            part = raw[off[i] : off[j]]
            h, other = prefix_hash(part), prefix_hash(part ^ np.uint8(0x5A))
            for lo in range(bound[i], bound[j], HOT_SEGMENTS):
                s = slice(lo, min(lo + HOT_SEGMENTS, bound[j]))
                own = np.repeat(np.arange(s.start, s.stop), n[s])
                step = np.arange(len(own)) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
                first = start[own] + step
                at = off[owner[own]] - off[i] + first
                held.append((mix64(span_hash(h, at, at + LENGTH)), mix64(span_hash(other, at, at + LENGTH)), ids[owner[own]], first.astype(np.int32), np.ones(len(own), np.int32), (r[own] - step).astype(np.int32)))
                size += len(own)
                if size >= HOT_WINDOWS:
                    yield from _firsts(held)
                    size = 0
    if held:
        yield from _firsts(held)


PART = "part long, doc long, start int, n int, r int, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their open segments: a row per segment and range of distances, dealt by the bytes that the range shares."""
    for batch in batches:
        raw, off = utf8(batch.column(1))
        ids = batch.column(0).to_numpy()
        segs = batch.column(2)
        many = segs.value_lengths().to_numpy()
        flat = segs.flatten()
        key, start, n, r = (flat.field(k).to_numpy() for k in range(4))
        owner, bound = np.repeat(np.arange(len(many)), many), np.r_[0, np.cumsum(many)]
        for i, j in pieces(off):
            h = prefix_hash(raw[off[i] : off[j]])
            s = slice(bound[i], bound[j])
            base = off[owner[s]] - off[i]
            at, k, lo, hi = base + start[s] + r[s], key[s], r[s] - n[s] + 1, r[s]  # anchor's place, distances lo..hi
            out = []
            for a in range(0, REACH, RANGE):
                b = min(a + RANGE, REACH) - 1
                x, y = np.maximum(lo, a), np.minimum(hi, b)
                on = np.flatnonzero(x <= y)
                shared = span_hash(h, at[on] - a, at[on] + LENGTH - b)
                part = mix64(shared + k[on].view(U64) * U64(0x9E3779B97F4A7C15) + U64(a))
                out.append((part, ids[owner[s]][on], at[on] - y[on] - base[on], y[on] - x[on] + 1, y[on], at[on] - y[on], at[on] - x[on] + LENGTH))
            part, doc, first, size, dist, lo_b, hi_b = (np.concatenate(c) for c in zip(*out))
            data = raw[off[i] : off[j]].tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(part.view(np.int64)), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(dist.astype(np.int32)), pa.array([data[x:y] for x, y in zip(lo_b.tolist(), hi_b.tolist())], pa.binary()),
            ], ["part", "doc", "start", "n", "r", "bytes"])


class Suffixes:
    """Suffixes of a byte buffer, compared up to LENGTH bytes by prefix hashes."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.h = raw, prefix_hash(raw)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, up to LENGTH."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = span_hash(self.h, a, a + mid) == span_hash(self.h, b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        c = self.common(a, b)
        end = c >= LENGTH
        k = np.minimum(c, LENGTH - 1)
        return np.where(end, or_equal, self.raw[a + k] < self.raw[b + k])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes at `at` within each group (ascending runs of `group`): mergesort, all runs side by side."""
        order = np.arange(len(at))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(at)])
        width = 1
        while (big := size > width).any():
            begin = np.repeat(first[big], size[big])
            place = begin + np.arange(len(begin)) - np.repeat(np.cumsum(size[big]) - size[big], size[big])
            end = begin + np.repeat(size[big], size[big])
            rel = place - begin
            pair = begin + rel // (2 * width) * (2 * width)
            mid, stop = np.minimum(pair + width, end), np.minimum(pair + 2 * width, end)
            left = place < mid
            lo, hi = np.where(left, mid, pair), np.where(left, stop, mid)  # the other run
            other = lo.copy()
            me = at[order[place]]
            while (open_ := np.flatnonzero(lo < hi)).size:
                m = (lo[open_] + hi[open_]) >> 1
                them = at[order[m]]
                mine = me[open_]
                # an element of the left run goes before its equals in the right one
                before = np.where(left[open_], self.less(them, mine, False), self.less(them, mine, True))
                lo[open_], hi[open_] = np.where(before, m + 1, lo[open_]), np.where(before, hi[open_], m)
            target = np.where(left, place + (lo - other), pair + (place - mid) + (lo - other))
            moved = order.copy()
            moved[target] = order[place]
            order = moved
            width *= 2
        return order

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbours are equal: by hash, then byte by byte. A collision stops the sort from being trusted."""
        same = span_hash(self.h, a, a + LENGTH) == span_hash(self.h, b, b + LENGTH)
        on, span = np.flatnonzero(same), np.arange(LENGTH)
        for k in range(0, len(on), 1 << 16):
            x = on[k : k + (1 << 16)]
            if not (self.raw[a[x][:, None] + span] == self.raw[b[x][:, None] + span]).all():
                raise Collision
        return same


class Collision(Exception):
    pass


def repeats(raw: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows equal an earlier one of their group. Windows come ordered by group."""
    try:
        s = Suffixes(raw)
        order = s.sort(at, group)
        a = at[order]
        new = np.r_[True, (group[order][1:] != group[order][:-1]) | ~s.equal(a[1:], a[:-1])] if len(at) else np.zeros(0, bool)
    except Collision:  # two strings with one hash: this block is sorted by its bytes
        content = [(int(g), raw[p : p + LENGTH].tobytes()) for g, p in zip(group, at)]
        order = np.array(sorted(range(len(at)), key=content.__getitem__), np.int64)
        new = np.array([k == 0 or content[order[k]] != content[order[k - 1]] for k in range(len(order))])
    run = np.cumsum(new) - 1
    least = np.lexsort((start[order], doc[order], run))
    best = least[np.flatnonzero(np.r_[True, run[least][1:] != run[least][:-1]])] if len(at) else least
    out = np.zeros(len(at), bool)
    out[order] = _strictly_later(doc[order], start[order], doc[order][best][run], start[order][best][run])
    return out


def _sort_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by part: groups of parts are gathered to blocks and their windows' suffixes sorted."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        part, doc, start, n, r = (rows.column(k).to_numpy() for k in range(5))
        alone = np.ones(len(part), bool)
        alike = part[1:] == part[:-1]
        alone[1:] &= ~alike
        alone[:-1] &= ~alike
        keep = np.flatnonzero(~alone)
        if not len(keep):
            return
        part, doc, start, n, r = (x[keep] for x in (part, doc, start, n, r))
        raw, off = utf8(rows.column(5).take(pa.array(keep)).combine_chunks())
        own = np.repeat(np.arange(len(part)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        number = np.cumsum(np.r_[0, part[1:] != part[:-1]])
        group = number[own] * 128 + (r[own] - step)
        order = np.argsort(group, kind="stable")
        at, group = (off[own] + step)[order], group[order]
        d, s = doc[own][order], (start[own] + step)[order].astype(np.int64)
        hit = repeats(raw, at, group, d, s)
        yield _spans(d[hit], s[hit], s[hit] + LENGTH)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 1 << 24:
            rows = pa.Table.from_batches(held)
            part = rows.column(0).to_numpy()
            done = int(np.searchsorted(part, part[-1]))  # the last group may go on
            if done:
                yield from work(rows.slice(0, done))
            held, size = rows.slice(done).to_batches(), rows.slice(done).nbytes
    if held:
        yield from work(pa.Table.from_batches(held))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, text) and (doc, start, length) of the spans of repeats; spans of one document may overlap."""
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = base.mapInArrow(_locate, SEGMENT).repartition("key").sortWithinPartitions("key", "sub", "doc", "start")
    found = cut(found.mapInArrow(_match, SEGMENT))
    often = cut(found.where("r >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > HOT).select("key"))
    sorted_ = parts(base, found, often).repartition("part").sortWithinPartitions("part", "doc", "start").mapInArrow(_sort_parts, SEGMENT)
    out = found.where("r = -1").unionByName(sorted_)
    if not often.isEmpty():
        single = base.join(_by_doc(found.join(F.broadcast(often), "key", "left_semi")), "doc").mapInArrow(_windows, SEGMENT)
        out = out.unionByName(single.repartition("key").sortWithinPartitions("key", "sub", "doc", "start").mapInArrow(_match, SEGMENT).where("r = -1"))
    return base, out.select("doc", "start", F.col("n").alias("length"))


def _by_doc(found: DataFrame) -> DataFrame:
    return found.where("r >= 0").groupBy("doc").agg(F.collect_set(F.struct("key", "start", "n", "r")).alias("segs"))


def parts(base: DataFrame, found: DataFrame, often: DataFrame) -> DataFrame:
    """The rows to sort suffixes in: of segments that are left, without those whose anchor is in often (key)."""
    return base.join(_by_doc(found.join(F.broadcast(often), "key", "left_anti")), "doc").mapInArrow(_cut_out, PART)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of each row.

    Null text counts as empty. Rows without id are not compared and lose nothing. Rows repeated whole count as one
    document and lose the same bytes. Strings in smaller ids win ties. Other columns are ignored.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(1))
            rows = []
            for i, own in enumerate(batch.column(2).to_pylist()):
                text = raw[off[i] : off[i + 1]].tobytes()
                kept, at, runs, end = [], 0, 0, -1
                for x in sorted((s["start"], s["start"] + s["length"]) for s in own or []):
                    if x[0] > end:
                        runs += 1
                        kept.append(text[at : x[0]])
                    end = at = max(end, x[1])
                kept.append(text[at:])
                whole = b"".join(kept)
                rows.append((len(text), len(text) - len(whole), runs, hashlib.sha256(whole).hexdigest(), whole))
            cols = list(zip(*rows)) if rows else [[] for _ in range(5)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    base, found = spans(docs, id_col, text_col)
    own = found.groupBy("doc").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    lost = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("array<struct<start:int,length:int>>").alias("spans"))
    rows = base.join(own, "doc", "left").select("doc", "text", "spans").unionByName(lost)
    return rows.mapInArrow(apply, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("doc", id_col)

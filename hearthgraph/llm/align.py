"""Alignment of two tokenisers' segmentations by a transducer over dangling suffixes.

Both segmentations spell the same bytes. Read side by side, one of them is ahead, and what it is ahead by is a suffix
of its last token that the other has not spelt yet. That side and that residual are all that the next step depends on,
so a step is looked up by residual and next token and computed only once. Where the residual is empty both segmentations
end a token, and a group closes. Each token read while the other side leads is linked with the leading token.

Texts are cut at every single blank between characters that are no white space. Both tokenisers end a token there and
look at nothing beyond (A by its pattern, which Spans checks; B if no piece holds a blank behind its beginning, which it
checks too), so the residual is empty and what lies between two cuts is aligned once for each distinct string.

1. A map over the texts gives each document's counts, its groups' digest and its links, and each task's counts of
   documents by pair, summed inside the task. The table is written.
2. The counts are added up by pair, and a maximum is taken by A's token.
3. A map over the links looks them up in the table of pairs where that is small enough to broadcast; beyond that,
   links are grouped by groups and pair and joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, drop, give_back, pieces, utf8

#: B's tokens in a pair's code: A's number times 2**15 and B's number; fits 32 bits for vocabularies up to 65,536 by 32,768.
SHIFT = 15
#: Pairs broadcast with their counts (13 bytes each); beyond that they are joined.
BROADCAST_PAIRS = 4_000_000
#: Distinct pairs that a task holds before it sends their counts on, transitions, and bytes of strings that it
#: remembers in each of two generations.
HELD_PAIRS, HELD_STEPS, HELD_BYTES = 400_000, 1_000_000, 50_000_000
#: Bytes of text handled at once.
AT_ONCE = 1 << 20
#: Fixed: the pattern of byte-level vocabularies; strings of so many characters are left to the file's own library.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 1000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable Latin-1 for itself, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """States are a side that leads and its unmatched bytes; state 0 is the empty residual.

    a, b: the bytes of each token by number."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.sides = (a, b)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple[int, bytes], int] = {}
        self.state: list[tuple[int, bytes]] = [(0, b"")]
        self.leads = [0]
        self.step: dict[int, int] = {}

    def _at(self, side: int, residual: bytes) -> int:
        if not residual:
            return 0
        n = self.number.setdefault((side, residual), len(self.state))
        if n == len(self.state):
            self.state.append((side, residual))
            self.leads.append(side)
        return n

    def _go(self, s: int, token: int) -> int:
        """The state after the lagging side's next token (A's, where nothing dangles); -1 where the bytes differ."""
        key = s << 20 | token
        if key not in self.step:
            self.step[key] = self._new(s, token)
        return self.step[key]

    def _new(self, s: int, token: int) -> int:
        side, residual = self.state[s]
        if s == 0:
            return self._at(0, self.sides[0][token])
        other = self.sides[1 - side][token]
        if len(other) <= len(residual):
            return self._at(side, residual[len(other) :]) if residual.startswith(other) else -1
        return self._at(1 - side, other[len(residual) :]) if other.startswith(residual) else -1

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[int]] | None:
        """The groups, and the codes of all links; None where the two do not spell the same bytes."""
        if len(self.step) > HELD_STEPS:
            self._forget()
        step, leads = self.step, self.leads
        groups, links = [], []
        i = j = 0
        n_a, n_b = len(a), len(b)
        while i < n_a:
            first_a, first_b = i, j
            x = a[i]
            i += 1
            s = self._go(0, x)
            while s > 0:
                if leads[s]:
                    if i == n_a:
                        return None
                    token = x = a[i]
                    i += 1
                else:
                    if j == n_b:
                        return None
                    token = y = b[j]
                    j += 1
                links.append(x << SHIFT | y)
                t = step.get(s << 20 | token)
                s = self._go(s, token) if t is None else t
            if s < 0:
                return None
            groups.append((a[first_a:i], b[first_b:j]))
        return (groups, links) if j == n_b else None


class Spans:
    """The two tokenisers, and what is known of each string between two cuts."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        entries, table = self.a.get_vocab(with_added_tokens=True), byte_level()
        a = [b""] * (1 + max(entries.values()))
        for entry, n in entries.items():
            a[n] = bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()
        n_b = self.b.get_piece_size()
        if len(a) > 1 << 31 - SHIFT or n_b > 1 << SHIFT:
            raise ValueError("vocabularies beyond the codes of pairs")
        pieces_ = [self.b.id_to_piece(k) for k in range(n_b)]
        b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces_)]
        self.a_bytes, self.machine = a, Transducer(a, b)
        self.quick = self._ranks(a_file)
        probes = ["x 1", "x. x", "1 x", ") (", "é ü", "x ▁", "字 字"]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces_) and all(
            self._a([" " + p])[0] == self._a([" " + p.split(" ")[0]])[0] + self._a([" " + p.split(" ")[1]])[0] and self.b.encode(p) == [n for w in p.split(" ") for n in self.b.encode(w)] for p in probes
        )
        #: What was met since the last change of generations, and what was before.
        self.known: dict[str, tuple[int, str, bytes] | None] = {}
        self.before: dict[str, tuple[int, str, bytes] | None] = {}
        self.held = 0

    def _ranks(self, a_file: str) -> tiktoken.Encoding | None:
        """The same vocabulary for the quicker library, if the file's merges make its entries in the order of their numbers."""
        with open(a_file, encoding="utf-8") as f:
            said = json.load(f)
        model, before = said["model"], said["pre_tokenizer"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        vocab, table = model.get("vocab", {}), byte_level()
        plain = said["normalizer"] is None and before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not model.get("ignore_merges")
        in_order = [vocab.get(m.replace(" ", "")) for m in merges] == [*range(256, 256 + len(merges))]
        ranks = {bytes(table[c] for c in e): n for e, n in vocab.items() if n < 256 + len(merges)} if plain and in_order else {}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None

    def _a(self, texts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        encode = self.quick.encode_ordinary
        return [encode(t) if len(t) < LONG else self.a.encode(t, add_special_tokens=False).ids for t in texts]

    def split(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        return parts if parts == text.split() else _CUT.split(text)

    def learn(self, strings: list[str]) -> None:
        """(token counts and groups in one number, groups as text, links) of each string; None where bytes are lost."""
        spell, align, known = self.a_bytes, self.machine.align, self.known
        for s, a, b in zip(strings, self._a([" " + s for s in strings]), self.b.encode(strings, num_threads=1), strict=True):
            got = align(a, b) if b"".join([spell[k] for k in a]) == b" " + s.encode() else None
            if got is not None:
                groups, links = got
                said = ";".join([f"{x[0]}|{y[0]}" if len(x) == 1 == len(y) else f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups])
                got = (len(a) << 80 | len(b) << 40 | len(groups), said, array("i", links).tobytes())
                self.held += len(said) + len(got[2])
            known[s] = got
            self.held += len(s) + 300

    def digests(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        """n_a, n_b, n_groups, groups' SHA-256, links of each text."""
        if self.held > HELD_BYTES:
            self.known, self.before, self.held = {}, self.known, 0
        split = [self.split(t) if t else [] for t in texts]
        known, before, fresh = self.known, self.before, []
        for s in set(chain.from_iterable(split)).difference(known):
            if s in before:
                known[s] = before[s]
                self.held += 500
            else:
                fresh.append(s)
        for k in range(0, len(fresh), 1000):
            self.learn(fresh[k : k + 1000])
        out, mask = [], (1 << 40) - 1
        for parts in split:
            got = [known[s] for s in parts]
            if not got or None in got:
                out.append((0, 0, 0, "", b""))
                continue
            n = sum([g[0] for g in got])
            sha = hashlib.sha256(";".join([g[1] for g in got]).encode()).hexdigest()
            out.append((n >> 80, n >> 40 & mask, n & mask, sha, b"".join([g[2] for g in got])))
        return out


class Tally:
    """Documents by pair, summed over the documents of a task so far."""

    def __init__(self):
        self.codes, self.counts, self.held = [], [], 0

    def add(self, codes: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(np.ones(len(codes), np.int64))
        self.held += len(codes)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([np.zeros(0, np.int32), *self.codes]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([np.zeros(0, np.int64), *self.counts]), len(codes)).astype(np.int64)
        self.codes, self.counts, self.held = [codes], [counts], len(codes)
        return codes, counts


_ROW = "n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, code int, n_docs long"


def linked(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document (code is null) and rows of a pair's code with a number of documents that hold it."""
    kind = docs.schema[id_col].dataType
    arrow = pa.int64() if kind.simpleString() == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, tally, ids_type = Spans(a_file, b_file), Tally(), arrow

        def counted() -> pa.RecordBatch:
            codes, counts = tally.sums()
            tally.codes, tally.counts, tally.held = [], [], 0
            n = len(codes)
            none = [pa.nulls(n, pa.int64())] * 3 + [pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.nulls(n, ids_type or pa.int64()), *none, pa.array(codes), pa.array(counts)], names)

        names = [id_col, "n_a", "n_b", "n_groups", "groups_sha256", "links", "code", "n_docs"]
        for batch in batches:
            ids_type = batch.column(0).type
            raw, off = utf8(batch.column(1))
            for i, j in pieces(off, AT_ONCE):
                got = spans.digests([raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)])
                links = np.frombuffer(b"".join([g[4] for g in got]), np.int32)
                bound = np.cumsum([0, *[len(g[4]) // 4 for g in got]])
                for k in range(j - i):
                    tally.add(np.unique(links[bound[k] : bound[k + 1]]))
                if tally.held > 4 * HELD_PAIRS:
                    tally.sums()
                numbers = [pa.array([g[k] for g in got], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), *numbers, pa.array([g[3] for g in got], pa.string()), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(links)),
                    pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.int64()),
                ], names)
                if tally.held > HELD_PAIRS:
                    yield counted()
        if tally.held:
            yield counted()
        del spans
        give_back()  # the worker lives on for later tasks

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {_ROW}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """code, n_docs, best: the documents that hold each pair linked, and whether no pair of its A token has more."""
    pairs = rows.where("code IS NOT NULL").groupBy("code").agg(F.sum("n_docs").alias("n_docs")).withColumn("a", F.shiftright("code", SHIFT))
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))
    return pairs.join(most, "a").select("code", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row.

    A (a vocabulary file of the tokenizers library, byte-level BPE) reads a blank and the text, B (a SentencePiece model
    that adds the blank itself) the text, both without special tokens. Null and empty texts, and texts that either side
    does not spell byte by byte, have no tokens: zeros and an empty digest. A row counts as a document even if its id is
    null or repeated; rows repeated whole are repeated. Other columns are ignored. The files have to be at their places
    on every executor.
    """
    rows = cut(linked(docs, a_file, b_file, id_col, text_col))
    pairs = cut(pair_counts(rows))
    n = pairs.count()
    own = rows.where("code IS NULL")
    out = _looked_up(own, pairs, id_col) if n <= broadcast_pairs else _joined(own, pairs)
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _looked_up(own: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """For at most BROADCAST_PAIRS pairs."""
    got = pairs.toArrow()
    code = got["code"].to_numpy().astype(np.int32)
    order = np.argsort(code)
    table = own.sparkSession.sparkContext.broadcast((code[order], got["n_docs"].to_numpy()[order], got["best"].to_numpy(zero_copy_only=False)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = table.value
        for batch in batches:
            lists = batch.column(5)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            sums, off = [], np.r_[0, np.cumsum(size)]
            flat = lists.flatten().to_numpy()
            for i, j in pieces(off, AT_ONCE):
                at = np.searchsorted(codes, flat[off[i] : off[j]])
                total = np.zeros((2, 1 + off[j] - off[i]), np.int64)
                np.cumsum(best[at], out=total[0, 1:])
                np.cumsum(counts[at], out=total[1, 1:])
                here = total[:, off[i : j + 1] - off[i]]
                sums.append(here[:, 1:] - here[:, :-1])
            n_best, count_sum = np.concatenate([np.zeros((2, 0), np.int64), *sums], axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(5)], pa.array(size), pa.array(n_best), pa.array(count_sum)], [id_col, "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"])

    kind = own.schema[id_col].dataType.simpleString()
    return own.select(id_col, "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")


def _joined(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """For any number of pairs. Documents of the same groups have the same sums, so a text's links are joined once."""
    texts = own.where("groups_sha256 <> ''").groupBy("groups_sha256").agg(F.any_value("links").alias("links"))
    held = texts.select("groups_sha256", F.explode("links").alias("code")).groupBy("groups_sha256", "code").agg(F.count(F.lit(1)).alias("c"))
    sums = held.join(pairs, "code").groupBy("groups_sha256").agg(F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).alias("n_best"), F.sum(F.col("c") * F.col("n_docs")).alias("count_sum"))
    return own.withColumn("n_links", F.size("links").cast("long")).join(sums, "groups_sha256", "left").fillna(0, ["n_best", "count_sum"])

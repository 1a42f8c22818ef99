"""Transcript parsing with a hidden Markov model, and canonical rendering of the turns.

A transcript's lines are observations: the kind of speaker marker at the line's start and a few features of the line.
The hidden states are a role's first and later lines. Viterbi recovers the roles where markers are missing or odd.
Long transcripts are cut into chunks. A chunk is summed up as its matrix of best scores from state to state; matrices
are multiplied in blocks, and blocks again, until one is left, and the states at the seams are found on the way back down.
Each chunk is then decoded between its own two: the result is that of Viterbi over the whole, and no task holds a whole
long transcript or all matrices of one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sampled

ROLES = ("system", "user", "assistant")
#: The words that usually name a speaker's role.
SPEAKERS = {
    "system": "system sys instruction instructions context setup".split(),
    "user": "user human question q prompt customer me you client asker".split(),
    "assistant": "assistant ai bot answer a gpt model agent response reply".split(),
}
ROLE_OF = {w: r for r, words in SPEAKERS.items() for w in words}
MARKER = re.compile(r"\s*(?:(?:#{1,6}|\*\*|\[|<\|?|>)\s*)?([A-Za-z]{1,14})\s*(?:\|?>|\]|\*\*)?\s*(?:[:：]\s*(?:\*\*)?|(?<=[>\]*])\s*|$)")
#: States: role r's first line is 2r, its later lines 2r + 1. A feature's values: marker, blank line before, length, ending.
STATES = 2 * len(ROLES)
SHAPE = (4, 2, 3, 3)
#: Fixed value: a line with such a character isn't blank. The complement is what Python's strip() takes off.
INK = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Chunks to a block, and blocks to a block of blocks.
BLOCK = 256


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]  # per feature: states x values, logarithms


def marker(line: str) -> tuple[int, int]:
    """(0 without a marker, else 1 + role; where the text begins)."""
    m = MARKER.match(line)
    role = ROLE_OF.get(m[1].lower()) if m else None
    return (1 + ROLES.index(role), m.end()) if role else (0, 0)


def features(lines: list[str]) -> np.ndarray:
    """A row per line that isn't blank; a blank line is noted in the next one."""
    out, blank = [], 0
    for line in lines:
        if not line.strip():
            blank = 1
            continue
        end = line.rstrip()[-1]
        out.append((marker(line)[0], blank, (len(line) > 60) + (len(line) > 200), 1 if end == "?" else 2 if end in ".!:" else 0))
        blank = 0
    return np.array(out, np.int64).reshape(-1, len(SHAPE))


def scores(x: np.ndarray, m: Hmm) -> np.ndarray:
    return sum(e[:, x[:, k]].T for k, e in enumerate(m.emit)) if len(x) else np.zeros((0, STATES))


def estimate(counts: dict[str, np.ndarray], smooth: float = 0.5) -> Hmm:
    """From counts of starts, moves and feature values by state. A later line follows only its own role's lines."""
    allowed = np.zeros((STATES, STATES), bool)
    for a in range(STATES):
        for b in range(STATES):
            allowed[a, b] = b % 2 == 0 or a // 2 == b // 2
    start = np.where(np.arange(STATES) % 2 == 0, counts["start"] + smooth, 0)
    move = np.where(allowed, counts["move"] + smooth, 0)
    with np.errstate(divide="ignore"):
        return Hmm(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), tuple(np.log((c := counts[f"f{k}"] + smooth) / c.sum(axis=1, keepdims=True)) for k in range(len(SHAPE))))


def transfer(e: np.ndarray, m: Hmm) -> np.ndarray:
    """Best score from each state before the chunk to each state at its end."""
    t = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    for row in e:
        t = (t[:, :, None] + m.move[None]).max(axis=1) + row
    return t


def viterbi(e: np.ndarray, m: Hmm, enter: int | None, leave: int | None) -> np.ndarray:
    """The best states; enter is the state before the chunk (None: its start), leave the last one's (None: free).
    Ties go to the lower state."""
    if not len(e):
        return np.zeros(0, np.int64)
    v = (m.start if enter is None else m.move[enter]) + e[0]
    back = np.zeros((len(e), STATES), np.int64)
    for k in range(1, len(e)):
        x = v[:, None] + m.move
        back[k] = x.argmax(axis=0)
        v = x.max(axis=0) + e[k]
    out = np.zeros(len(e), np.int64)
    out[-1] = v.argmax() if leave is None else leave
    for k in range(len(e) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def stitch(mats: list[np.ndarray], first: np.ndarray, m: Hmm, enter: int | None = None, leave: int | None = None) -> list[tuple[int | None, int]]:
    """(enter, leave) of each chunk; first: best scores of the first chunk's end states from the transcript's start.
    Where the state before the first chunk (enter) or the last one's (leave) is given, the path keeps to it."""
    v, back = first if enter is None else mats[0][enter], []
    for t in mats[1:]:
        x = v[:, None] + t
        back.append(x.argmax(axis=0))
        v = x.max(axis=0)
    ends = [int(v.argmax()) if leave is None else leave]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return [(enter if k == 0 else ends[k - 1], s) for k, s in enumerate(ends)]


def multiply(mats: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of a block of chunks, and its end states' best scores if the transcript starts with it."""
    whole = mats[0]
    for t in mats[1:]:
        whole = (whole[:, :, None] + t[None]).max(axis=1)
        first = (first[:, None] + t).max(axis=0)
    return whole, first


def seams(mats: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, chunk, enter, leave from key, chunk (0, 1, ... without a gap), mat and first; enter is -1 at a transcript's start.

    At most `block` matrices come together in a task."""
    in_block = F.expr(f"chunk div {block}")

    def up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        whole, first = multiply([np.array(x).reshape(STATES, STATES) for x in group["mat"]], np.array(group["first"].iloc[0]))
        return pd.DataFrame({"key": [group["key"].iloc[0]], "chunk": [group["chunk"].iloc[0] // block], "mat": [whole.ravel().tolist()], "first": [first.tolist()]})

    def down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        given = [int(group[c].iloc[0]) for c in ("over_enter", "over_leave")]
        got = stitch([np.array(x).reshape(STATES, STATES) for x in group["mat"]], np.array(group["first"].iloc[0]), None, *[None if g < 0 else g for g in given])
        return pd.DataFrame({"key": group["key"], "chunk": group["chunk"], "enter": [-1 if a is None else a for a, _ in got], "leave": [b for _, b in got]})

    levels = [cut(mats)]
    last = levels[0].agg(F.max("chunk")).first()[0] or 0
    while last >= block:
        levels.append(cut(levels[-1].groupBy("key", in_block).applyInPandas(up, "key string, chunk long, mat array<double>, first array<double>")))
        last //= block
    known = levels[0].sparkSession.createDataFrame([], "key string, chunk long, enter int, leave int")
    for k, level in enumerate(reversed(levels)):
        over = known.select(F.col("key").alias("_k"), F.col("chunk").alias("_c"), F.col("enter").alias("over_enter"), F.col("leave").alias("over_leave"))
        rows = level.join(over, level["key"].eqNullSafe(over["_k"]) & (in_block == F.col("_c")), "left").drop("_k", "_c").fillna(-1, ["over_enter", "over_leave"])
        known = rows.groupBy("key", in_block).applyInPandas(down, "key string, chunk long, enter int, leave int")
    return known


def turns(lines: list[str], states: np.ndarray) -> list[tuple[str, list[str], bool]]:
    """(role, lines without markers, whether the turn begins here): a chunk's first turn may continue the last chunk's."""
    out: list[tuple[str, list[str], bool]] = []
    for line, s in zip((x for x in lines if x.strip()), states):
        role = ROLES[s // 2]
        text = line[marker(line)[1] :].strip() if s % 2 == 0 else line.strip()
        if s % 2 == 0 or not out:
            out.append((role, [], s % 2 == 0))
        if text:
            out[-1][1].append(text)
    return out


def render(parsed: list[tuple[str, list[str], bool]]) -> str:
    """Canonical form: <|role|>, the turn's lines, <|end|>."""
    out = []
    for role, body, begins in parsed:
        if begins:
            if out:
                out.append("<|end|>")
            out.append(f"<|{role}|>")
        out.extend(body)
    return "\n".join([*out, "<|end|>"]) if out else ""


COUNTS = ["start", "move", *[f"f{k}" for k in range(len(SHAPE))]]


def fit(chunks: DataFrame, sample: int = 20_000) -> Hmm:
    """chunks: lines array<string> and states array<int> (of the lines that aren't blank) of about `sample` labelled
    first chunks. Counts are summed in tasks; what reaches the driver is the model's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {"start": np.zeros(STATES), "move": np.zeros((STATES, STATES))} | {f"f{k}": np.zeros((STATES, n)) for k, n in enumerate(SHAPE)}
        for batch in batches:
            for lines, states in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, s = features(lines), np.array(states, np.int64)
                if len(s):
                    total["start"][s[0]] += 1
                    np.add.at(total["move"], (s[:-1], s[1:]), 1)
                    for k in range(len(SHAPE)):
                        np.add.at(total[f"f{k}"], (s, x[:, k]), 1)
        flat = [(name, i, float(c)) for name in COUNTS for i, c in enumerate(total[name].ravel())]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat]), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat])], ["name", "i", "n"])

    n = chunks.count()
    if n > sample:
        chunks = chunks.where(sampled(F.col("key"), sample / n))
    rows = chunks.select("lines", "states").mapInArrow(count, "name string, i long, n double").groupBy("name", "i").agg(F.sum("n").alias("n")).collect()
    shapes = {"start": (STATES,), "move": (STATES, STATES)} | {f"f{k}": (STATES, w) for k, w in enumerate(SHAPE)}
    counts = {name: np.zeros(int(np.prod(shapes[name]))) for name in COUNTS}
    for r in rows:
        counts[r["name"]][r["i"]] = r["n"]
    return estimate({name: c.reshape(shapes[name]) for name, c in counts.items()})


def parse(chunks: DataFrame, m: Hmm) -> DataFrame:
    """chunks: key, chunk (0, 1, ...), lines. Returns key, chunk, n_lines, states, n_turns, canonical.

    A transcript without any line that isn't blank has no turns. Null lines count as blank. n_turns counts the turns
    that begin in the chunk. Other columns are ignored; a null key is a transcript of its own like any other.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mats, first = [], []
            for lines in batch.column(2).to_pylist():
                e = scores(features([x or "" for x in lines or []]), m)
                t = transfer(e, m)
                mats.append(t.ravel().tolist())
                first.append((((m.start + e[0])[:, None] + transfer(e[1:], m)).max(axis=0) if len(e) else np.zeros(STATES)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mats, pa.list_(pa.float64())), pa.array(first, pa.list_(pa.float64()))], ["key", "chunk", "mat", "first"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lines, enter, leave in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                lines = [x or "" for x in lines or []]
                s = viterbi(scores(features(lines), m), m, None if enter is None or enter < 0 else enter, leave)
                got = turns(lines, s)
                rows.append((len(s), s.tolist(), sum(b for _, _, b in got), render(got)))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["key", "chunk", "n_lines", "states", "n_turns", "canonical"])

    chunks = chunks.select(F.col("key").cast("string"), F.col("chunk").cast("long"), "lines")
    long = chunks.where("chunk > 0").select("key").distinct()
    mats = chunks.join(long, chunks["key"].eqNullSafe(long["key"]), "left_semi").mapInArrow(sums, "key string, chunk long, mat array<double>, first array<double>")
    bounds = seams(mats).withColumnsRenamed({"key": "_k", "chunk": "_c"})
    joined = chunks.join(bounds, chunks["key"].eqNullSafe(bounds["_k"]) & (chunks["chunk"] == bounds["_c"]), "left").select("key", "chunk", "lines", "enter", "leave")
    return joined.mapInArrow(decode, "key string, chunk long, n_lines long, states array<int>, n_turns long, canonical string")


# --- transcripts made from a table of turns -------------------------------------------------------------------------

#: Ways in which transcripts mark speakers, per role.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instruction:\n", "user": "### Human: ", "assistant": "### AI: "},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "[SYS] ", "user": "Q: ", "assistant": "A: "},
    {"system": "**Context:** ", "user": "**Customer:** ", "assistant": "**Agent:** "},
)


def from_turns(turns_df: DataFrame, per_chunk: int = 64, drop_every: int = 6) -> DataFrame:
    """Raw transcripts from conv_id, turn, role, text: key, chunk, lines and the true states of its lines.

    Each conversation has one style of markers; about every `drop_every`-th turn has none, only a blank line before.
    Turns are ordered by number, role and text, so repeated rows stay; a chunk has `per_chunk` turns in that order, the
    last one fewer. Null turn numbers come first, roles that aren't known count as 'user', null text is an empty turn,
    null conversation ids are one conversation. Lines end at \\n; a line of white space alone is blank. Other columns
    are ignored.
    """
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    rows = turns_df.select(key.alias("key"), turn.alias("turn"), role.alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    style = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(len(STYLES)))
    mark = F.lit("")
    for k, names in enumerate(STYLES):
        for r, text in names.items():
            mark = F.when((style == k) & (F.col("role") == r), F.lit(text)).otherwise(mark)
    bare = F.pmod(F.crc32(F.concat_ws(":", "key", F.col("turn").cast("string")).cast("binary")), F.lit(drop_every)) == 0
    body = F.concat(F.when(bare, F.lit("\n")).otherwise(mark), "text")
    rows = _numbered(rows.select("key", "turn", "role", body.alias("body")))
    packed = rows.groupBy("key", F.expr(f"at div {per_chunk}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "role", "body"))).alias("ts"))
    lines = F.flatten(F.transform("ts", lambda t: F.split(t["body"], "\n")))
    index = F.array(*[F.lit(r) for r in ROLES])

    def states_of(t):
        number = (F.array_position(index, t["role"]) - 1).cast("int") * 2
        own = F.filter(F.split(t["body"], "\n"), lambda x: x.rlike(INK))
        return F.transform(own, lambda _, i: number + F.when(i > 0, 1).otherwise(0))

    return packed.select("key", "chunk", lines.alias("lines"), F.flatten(F.transform("ts", states_of)).alias("states"))


def _numbered(rows: DataFrame) -> DataFrame:
    """key, role, body, at: the position in the key's order. One sort deals all rows, so a key of any size is spread over
    many tasks (repeated rows by chance, their order being the same); each task counts its keys, and the counts of the
    tasks before are added."""
    dealt = rows.withColumn("_r", F.rand(7)).sort("key", "turn", "role", "body", "_r").drop("_r")
    dealt = cut(dealt.select("key", "role", "body", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")))
    counts = dealt.groupBy("key", "part").agg(F.min("i").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(counts.withColumn("before", F.coalesce(before, F.lit(0))), ["key", "part"]).select("key", "role", "body", (F.col("i") - F.col("least") + F.col("before")).alias("at"))

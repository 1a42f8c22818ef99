import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthgraph.llm import align, minhash, negatives
from hearthgraph.llm.queries import BYTE_LEVEL, PIECE_MODEL

from . import samples


def token_bytes():
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    table = align.byte_level()
    spell = {n: bytes(table[c] for c in e) for e, n in a.get_vocab(with_added_tokens=False).items()}
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    return a, b, spell, piece


def brute_align(texts):
    """Groups by byte offsets and links by overlapping ranges, from whole texts."""
    a, b, spell, piece = token_bytes()
    rows, held = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx, by = [spell.get(k, b"\0none") for k in x], [piece(k) for k in y]
        if b"".join(bx) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            rows.append(None)
            continue
        ex, ey = np.cumsum([len(t) for t in bx]), np.cumsum([len(t) for t in by])
        both = sorted(set(ex.tolist()) & set(ey.tolist()))
        groups, lo = [], 0
        for end in both:
            own = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if lo < e <= end)  # noqa: B023, E731
            groups.append(f"{own(x, ex)}|{own(y, ey)}")
            lo = end
        links = [(i, j) for i, e, t in zip(x, ex, bx) for j, f, u in zip(y, ey, by) if e - len(t) < f and f - len(u) < e]
        rows.append((len(x), len(y), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        held.update(set(links))
    most = {}
    for (i, _), c in held.items():
        most[i] = max(most.get(i, 0), c)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(held[p] == most[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4]) for r in rows]


ODD = ["<|endoftext|> and </s> <s>", "a▁b", "  two  blanks  ", "tab\tline\nend", "don't we'll I'D", "x y  z", "é ​ ﻿", "<0x41> <0x0A>", "1234567 89,000.50", "　字 字", "a\x1c b\x1c c", "🙂🙂 🙂", " ", "\0 nul"]


@pytest.mark.parametrize("most", [align.BROADCAST_PAIRS, 0])
def test_alignment_matches_byte_ranges_of_whole_texts(spark, most):
    data = samples.rows()
    data = data[:-4] + [(100 + k, t, *data[0][2:]) for k, t in enumerate([*ODD, ODD[3], "na " * 60])]
    got = {r.doc_id: r for r in align.align(samples.docs(spark, data), BYTE_LEVEL, PIECE_MODEL, broadcast_pairs=most).collect()}
    want = brute_align([r[1] for r in data])
    assert len(got) == len(data)
    for row, w in zip(data, want):
        r = got[row[0]]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, repr(row[1])[:80]


def test_alignment_null_ids_repeats_long_texts_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(align, "HELD_BYTES", 1)
    row = samples.rows()[9]
    data = [(None, *row[1:]), row, row, (5, "x" * 60_000 + " " + "né" * 9000, *row[2:])]
    for most in (align.BROADCAST_PAIRS, 0):
        got = align.align(samples.docs(spark, data), BYTE_LEVEL, PIECE_MODEL, broadcast_pairs=most).collect()
        three = [tuple(r)[1:] for r in got if r.doc_id != 5]
        assert len(got) == 4 and len(set(three)) == 1 and three[0][5] == 3 * three[0][3]
        assert align.align(samples.docs(spark, []), BYTE_LEVEL, PIECE_MODEL, broadcast_pairs=most).count() == 0


def test_transducer_by_hand():
    t = align.Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"x"])
    code = lambda *p: [i << align.SHIFT | j for i, j in p]
    assert t.align([0, 1], [0, 1]) == ([([0, 1], [0, 1])], code((0, 0), (0, 1), (1, 1)))
    assert t.align([2, 3], [2]) == ([([2, 3], [2])], code((2, 2), (3, 2)))
    assert t.align([0, 1, 2, 3], [0, 1, 2]) == ([([0, 1], [0, 1]), ([2, 3], [2])], code((0, 0), (0, 1), (1, 1), (2, 2), (3, 2)))
    assert t.align([0], [3]) is None and t.align([0], [0]) is None and t.align([0], [0, 1]) is None and t.align([], [0]) is None
    assert len({k for k in t.step}) == len(t.step) and t.align([], []) == ([], [])


def brute_mine(rows, every=100, k=5):
    v = {}
    for i, label, x in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in x])
    out = set()
    for a in v:
        if a % every:
            continue
        score = {b: sum(p * q for p, q in zip(v[a][1], v[b][1])) for b in v if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if v[b][0] == v[a][0]][:k]:
            fits = [b for b in order if v[b][0] != v[a][0] and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:k]
            out |= {(a, p, r + 1, b, score[p], score[b]) for r, b in enumerate(fits)}
    return out


VECTORS = "vec_id long, label int, embedding array<float>, anchor int, score long, _id int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, x, 1, 2, 3) for i, label, x in rows], VECTORS)


@pytest.mark.parametrize("anchors", [65_536, 4])
def test_negatives_match_brute_force(spark, anchors):
    r = np.random.default_rng(5)
    centres = r.normal(size=(4, 24))
    rows = [(i, int(i % 4) if i % 11 else None, np.float32(centres[(i // 3) % 4] + r.normal(size=24) * 0.7).tolist()) for i in range(900)]
    rows += [(1000 + i, i % 3, rows[1][2]) for i in range(40)]  # ties
    rows += [(2000, 1, None), (2100, None, rows[0][2]), (2200, 1, [float("nan")] * 24), (2300, 2, [None] * 24), (2400, 1, []), (2500, 1, [1.0]), (2600, 3, [float("inf")] * 24), (None, 1, rows[5][2]), (2700, 1, [-x for x in rows[1][2]])]
    got = [tuple(x) for x in negatives.mine(vectors(spark, rows), anchors=anchors).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_mine([x for x in rows if x[0] not in (2400, 2500)])


def test_negatives_empty_repeated_and_huge(spark):
    assert negatives.mine(vectors(spark, [])).count() == 0
    assert negatives.mine(vectors(spark, [(100, 1, [1.0, 0.5])])).count() == 0
    rows = [(100, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.5]), (3, 2, [3e9, 0.0])]
    want = {(100, 1, 1, 2, 256 * 256 + 128 * 128, 230 * 256 + 128 * 128)}
    assert {tuple(x) for x in negatives.mine(vectors(spark, rows)).collect()} == want
    twice = [tuple(x) for x in negatives.mine(vectors(spark, [*rows, rows[0], rows[2]])).collect()]
    assert sorted(x[2:4] for x in twice) == [(1, 2), (2, 2)]


def test_discarding_keeps_every_pair_that_reaches_its_threshold():
    r = np.random.default_rng(1)
    v = r.integers(-300, 300, (200, 32)) * (np.arange(32) < 8) + r.integers(-9, 9, (200, 32))
    values, q = np.linalg.eigh((v.T @ v).astype(float))
    q = q[:, np.argsort(-values)]
    exact = v @ v.T
    low = np.sort(exact, 1)[:, -5].astype(float)
    i, j, product = negatives.candidates(negatives.Rotated(v, q), negatives.Rotated(v, q), low)
    assert (product == exact[i, j]).all() and len(i) < 0.2 * exact.size
    assert set(zip(*np.nonzero(exact >= low[:, None]))) <= set(zip(i.tolist(), j.tolist()))


def words_of(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))


def brute_near(data, k=3, percent=85):
    sets = {}
    for r in data:
        w = words_of(r[1])
        sets[r[0]] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_texts(seed=2):
    r = np.random.default_rng(seed)
    pool = [f"w{k}" for k in range(400)]
    out = []
    for n in (3, 4, 7, 8, 9, 20, 60, 150, 400):
        for _ in range(4):
            text = r.choice(pool, n).tolist()
            out.append(" ".join(text))
            for changes in (1, 2, 4, 9):
                new = list(text)
                for at in r.integers(0, n, changes):
                    new[at] = str(r.choice(pool))
                out.append(" ".join(new))
            out.append(" ".join(text[: max(1, n - n // 8)]))
    return out


def test_minhash_matches_brute_force(spark):
    base = samples.rows()
    data = base + [(1000 + k, t, *base[0][2:]) for k, t in enumerate(near_texts())]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.dedup(samples.docs(spark, data)).collect()}
    assert got == brute_near(data)


def test_minhash_large_group_chain_and_unlinked_crowd(spark):
    r = np.random.default_rng(9)
    body = [f"b{k}" for k in range(120)]
    group = [" ".join([*body[:60], f"x{k}", *body[61:]]) for k in range(150)]
    crowd = [" ".join([*body[:70], *[f"c{k}_{m}" for m in range(50)]]) for k in range(80)]  # alike, but below the threshold
    chain = [" ".join(f"d{k}" for k in range(3 * s, 3 * s + 100)) for s in range(30)]
    texts = [*group, *crowd, *chain]
    r.shuffle(texts)
    base = samples.rows()
    data = [(k, t, *base[0][2:]) for k, t in enumerate(texts)]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.dedup(samples.docs(spark, data)).collect()}
    assert got == brute_near(data)


def test_minhash_leaders_are_few_at_first_and_of_the_largest_component_later(spark):
    post = [(b, f"{k:03}".encode(), f"{k:03}".encode(), 50, []) for b in range(32) for k in range(40)]
    kind = "bucket long, ent binary, root binary, n int, head array<long>"
    first = minhash._led(spark.createDataFrame(post, kind), 0, 85).collect()
    assert len(first) <= 39 and {bytes(x) for p in first for x in p} == {p[1] for p in post}
    # all but three are of one component now: only those three meet others
    later = [(b, e, e if e >= b"037" else b"000", n, h) for b, e, _, n, h in post]
    pairs = minhash._led(spark.createDataFrame(later, kind), 1, 85).collect()
    assert {bytes(p.b) for p in pairs} == {b"037", b"038", b"039"} and all(bytes(p.a) < b"037" for p in pairs)


def test_minhash_null_ids_repeats_and_empty_table(spark):
    row = samples.rows()[9]
    got = minhash.dedup(samples.docs(spark, [(None, *row[1:]), row, row])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, 9, True), (False, 9, True), (True, 9, False)]
    assert minhash.dedup(samples.docs(spark, [])).count() == 0
    assert minhash.dedup(samples.docs(spark, [(1, None, *row[2:]), (2, "", *row[2:])])).where("kept AND n_shingles = 0").count() == 2


def test_circulant_coordinates_by_definition():
    c = minhash.Circulant(seed=3, places=97, bands=4, rows=3)
    values = np.random.default_rng(3).permutation(97)
    x = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bound = np.array([0, 1, 17, 39])
    sig = c.signatures(x, bound)
    for s in range(3):
        at = c.places_of(x[bound[s] : bound[s + 1]])
        assert sig[s].tolist() == [min(values[(p - k) % 97] for p in at) for k in range(12)]


def test_circulant_agreement_estimates_similarity():
    r = np.random.default_rng(4)
    c = minhash.Circulant()
    for share in (0.5, 0.85):
        agree = defaultdict(list)
        for _ in range(40):
            u = r.integers(0, 2**63, 600).astype(np.uint64)
            both = int(600 * share)
            rest = (600 - both) // 2
            a, b = u[: both + rest], np.concatenate([u[:both], u[both + rest :]])
            s = c.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            agree[share].append((s[0] == s[1]).mean())
        assert abs(np.mean(agree[share]) - share) < 0.02


def test_registered_queries_give_the_brute_force_rows(spark):
    from hearthgraph.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(0).alias("x")).collect()
    data = [tuple(r) for r in docs]
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op11_minhash(spark, "/root/testdata/sf0.001").collect()}
    assert near == brute_near(data)
    got = {tuple(x) for x in queries.op12_negatives(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_mine([tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", "embedding").collect()])
    short = [d for d in data if len(d[1] or "") < 3000]
    table = spark.createDataFrame(short, "doc_id long, text string, x int")
    want = brute_align([d[1] for d in short])
    rows = {r.doc_id: tuple(r)[1:] for r in align.align(table, BYTE_LEVEL, PIECE_MODEL).collect()}
    assert [rows[d[0]] for d in short] == want

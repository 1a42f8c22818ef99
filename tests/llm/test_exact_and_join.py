import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from hearthgraph.llm import exact_dedup, graph, jaccard_join, suffix_dedup

from . import samples


def brute_exact(data):
    groups = defaultdict(list)
    for r in data:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "")].append((r[0], len(r[1] or "")))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0]))[0]
        for i, _ in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact_dedup_matches_brute_force(spark):
    data = samples.rows()
    got = {r[0]: tuple(r)[1:] for r in exact_dedup.classify(samples.docs(spark)).collect()}
    assert got == brute_exact(data)


def test_exact_dedup_compares_bytes_when_hashes_collide(spark):
    got = {r[0]: tuple(r)[1:] for r in exact_dedup.classify(samples.docs(spark), hash_fn=lambda n: F.substring(F.md5(n.cast("binary")), 1, 1)).collect()}
    assert got == brute_exact(samples.rows())


def test_exact_dedup_null_ids_repeats_and_empty_table(spark):
    row = samples.rows()[5]
    data = [(None, *row[1:]), row, row]
    got = exact_dedup.classify(samples.docs(spark, data)).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in got) == [(False, 5, 3, True), (False, 5, 3, True), (True, 5, 3, False)]
    assert exact_dedup.survivors(samples.docs(spark, data)).count() == 2
    assert exact_dedup.classify(samples.docs(spark, [])).count() == 0


def brute_join(data):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low))
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_join_matches_brute_force(spark):
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.join(samples.docs(spark)).collect()}
    assert got == brute_join(samples.rows())


def test_join_chains_and_large_groups_of_near_copies(spark):
    base = [f"w{k}" for k in range(60)]
    data = []
    for k in range(40):  # a chain: neighbours link, far ones don't; and many variants of one text
        data.append((k, " ".join(base[k : k + 40])))
    for k in range(60):
        words = [f"v{x}" for x in range(80)]
        words[(k * 7) % 80] = f"new{k}"
        data.append((100 + k, " ".join(words)))
    full = [(i, t, "en", "s", len(t), 0, "", 0, 0, 0, "") for i, t in data]
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.join(samples.docs(spark, full)).collect()}
    assert got == brute_join(full)


def test_what_is_sent_out_first_loses_no_similar_set():
    r = np.random.default_rng(4)
    for seed in range(600):
        n = int(r.integers(1, 90))
        # few low halves, so that tokens of one set fall together in 40 bits
        pool = r.integers(0, 60 + seed % 3 * 10_000, 200).astype(np.uint64) | (r.integers(0, 1 << 20, 200).astype(np.uint64) << np.uint64(44))
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.93], pool[n : n + int(r.integers(0, n // 8 + 1))]]))
        if 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)):
            continue
        late = np.sort(pool[::7])
        (x, x_need), (y, y_need) = (jaccard_join._short(jaccard_join._order(t, late)[: jaccard_join.early(len(t))], len(t)) for t in (a, b))
        assert len(np.intersect1d(x, y)) >= max(x_need, y_need)
    own = np.arange(1, 101, dtype=np.uint64)
    short, need = jaccard_join._short(own[: jaccard_join.early(100)], 100)
    assert len(short) == 44 and need == 19 and int(short.max()) < 1 << 40


def test_join_null_ids_and_empty_table(spark):
    row = samples.rows()[9]
    got = jaccard_join.join(samples.docs(spark, [(None, *row[1:]), row, row])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 9), (False, 9), (True, 9)]
    assert jaccard_join.join(samples.docs(spark, [])).count() == 0


def test_one_of_each_keeps_columns(spark):
    kept = jaccard_join.one_of_each(samples.docs(spark))
    assert kept.columns == samples.docs(spark).columns
    want = {i for i, (_, root) in brute_join(samples.rows()).items() if i == root}
    assert {r.doc_id for r in kept.collect()} == want


def test_near_copies_that_their_leader_does_not_link(spark):
    """A large group in which many members are like few others only."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(60)]
    data = []
    for k in range(120):
        words = list(base)
        for at in rng.choice(60, 1 if k % 3 else 3, replace=False):
            words[at] = f"x{k if k % 2 else k // 6}"
        data.append((k, " ".join(words), None, None, 0, 0, "h", 1, 2, 3, "key"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(samples.docs(spark, data)).collect()}
    assert got == brute_join(data)


def test_closer_is_never_too_close(spark):
    label = [int(x) for x in np.random.default_rng(3).permutation(60)]
    links = spark.createDataFrame([(label[k - 1], label[k]) for k in range(1, 60) if k % 20], "a long, b long")
    got = {r.node: r.root for r in graph.closer(None, links, 60).collect()}
    parts = [set(label[k : k + 20]) for k in (0, 20, 40)]
    assert set(got) == set(label) and all(any(n in p and r in p for p in parts) for n, r in got.items())


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 4), (None, 1)] + [(k, k + 1) for k in range(20, 60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {k: 20 for k in range(20, 61)}


def test_components_of_a_long_chain_with_shuffled_labels(spark):
    label = [int(x) for x in np.random.default_rng(3).permutation(600)]
    edges = [(label[k - 1], label[k]) for k in range(1, 600) if k != 400]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: min(label[:400]) for k in label[:400]} | {k: min(label[400:]) for k in label[400:]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_suffix(data, length=suffix_dedup.LENGTH):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1]) for r in data):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        runs = sum(bool(gone[k]) and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix_dedup_matches_brute_force(spark):
    got = {r[0]: (*tuple(r)[1:-1], bytes(r.kept)) for r in suffix_dedup.dedup(samples.docs(spark).repartition(3)).collect()}
    assert got == brute_suffix(samples.rows())


def test_suffix_dedup_splits_large_groups(spark, monkeypatch):
    """A passage that many documents share, with different text on both sides: no part holds a row of each."""
    rng, passage = np.random.default_rng(5), " ".join(f"word{k}" for k in range(40))
    side = lambda: "".join(rng.choice(list("ab "), 60))
    data = [(k, f"{side()}{passage}{side()}" * (1 + k % 2), "de", "s", 1) for k in range(120)]
    groups = []
    parts = suffix_dedup.parts
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(suffix_dedup, "parts", lambda *a: groups.extend([parts(*a), a[2]]) or groups[0])
    got = {r[0]: (*tuple(r)[1:-1], bytes(r.kept)) for r in suffix_dedup.dedup(spark.createDataFrame([x[:2] for x in data], "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_suffix(data)
    assert max((r["count"] for r in groups[0].groupBy("part").count().collect()), default=0) <= 20
    assert groups[1].count() > 0


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    raw = np.frombuffer((b"ab" * 60 + b"ac" * 60) * 2, np.uint8)
    at = np.array([0, 120, 240, 100])
    args = (raw, at, np.zeros(4, np.int64), np.array([3, 2, 1, 4]), np.zeros(4, np.int64))
    want = suffix_dedup.repeats(*args)
    assert want.tolist() == [True, False, False, False]
    monkeypatch.setattr(suffix_dedup, "span_hash", lambda h, a, b: np.zeros(len(a), np.uint64))
    assert suffix_dedup.repeats(*args).tolist() == want.tolist()


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    at = rng.integers(0, 2900, 500)
    group = np.sort(rng.integers(0, 4, 500))
    order = suffix_dedup.Suffixes(raw).sort(at, group)
    keys = [(group[k], raw[at[k] : at[k] + 100].tobytes()) for k in order]
    assert keys == sorted(keys) and Counter(order.tolist()) == Counter(range(500))


def test_suffix_dedup_null_ids_repeats_and_empty_table(spark):
    row = next(r for r in samples.rows() if r[1] and len(r[1]) > 300)
    got = suffix_dedup.dedup(samples.docs(spark, [(None, *row[1:]), row, row])).collect()
    assert all(r.n_removed == 0 for r in got) and len(got) == 3
    assert suffix_dedup.dedup(samples.docs(spark, [])).count() == 0

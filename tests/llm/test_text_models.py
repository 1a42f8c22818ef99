import math
import random

import numpy as np
import pytest

from hearthgraph.llm import html_blocks, language, segment, toxicity, transcripts
from hearthgraph.llm.queries import PIECE_MODEL

from . import samples

EN = "the and river stone hill sang low moon gate quiet bell amber road with from this".split()
DE = "der und fluss stein hügel sang tief mond tor ruhig glocke straße mit von dieser nicht".split()


def made(words, n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(30)) for _ in range(n)]


def test_language_on_held_out_texts(spark):
    train = [(k, t, lang) for lang, words in (("en", EN), ("de", DE)) for k, t in enumerate(made(words, 40, 1))]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    test = [(k, t) for k, t in enumerate(made(EN, 20, 2) + made(DE, 20, 3))] + [(100, None), (101, ""), (102, "☃ — 12!"), (103, "zzzz")]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert [got[k].lang_pred for k in range(40)] == ["en"] * 20 + ["de"] * 20
    assert [(got[k].lang_pred, got[k].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103].lang_pred in ("en", "de") and all(0 <= r.score <= 1 for r in got.values())


def test_language_grams_match_a_plain_reading():
    texts = ["Ab  cd", "", "x", "ÉA-b"]
    low = [t.lower().encode() for t in texts]
    raw, off = np.frombuffer(b"".join(low), np.uint8), np.cumsum([0, *map(len, low)])
    want = set()
    for k, t in enumerate(low):
        b = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in t)
        b = b" " + b" ".join(b.split()) + b" " if b.split() else b" "
        want |= {(b[i : i + 3], k) for i in range(len(b) - 2)}
    g, row = language.grams(raw, off, 3)
    assert {(int(x).to_bytes(8, "little")[:3], int(r)) for x, r in zip(g, row)} == want


def test_bloom_has_every_gram_and_few_others():
    s = language.Settings(log2_words=14)
    own = {int(x): [0] for x in np.random.default_rng(0).integers(0, 2**32, 1500)}
    model = language.build(["a", "b"], own, s)
    assert (language.masks(np.array(sorted(own), np.uint64), model) & np.uint64(1)).all()
    other = np.random.default_rng(9).integers(2**33, 2**34, 20000).astype(np.uint64)
    rate = float((language.masks(other, model) & np.uint64(1)).mean())
    assert abs(rate - model.false_rate[0]) < 0.01


def test_language_without_labels_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert [r.lang_pred for r in language.predict(samples.docs(spark), model).collect()] == ["und"] * len(samples.rows())
    assert language.predict(empty, model).count() == 0


def test_toxicity_learns_words_and_locates_sentences(spark):
    r = random.Random(5)
    data = []
    for k in range(300):
        parts = [" ".join(r.choice(EN) for _ in range(8)) for _ in range(5)]
        if k % 3 == 0:
            parts[r.randrange(5)] += " " + r.choice(["nastyword", "vilething"])
        data.append((k, ". ".join(parts), int(k % 3 == 0)))
    model = toxicity.fit(spark.createDataFrame(data, "doc_id long, text string, toxic int"))
    test = [(0, "the stone sang. a nastyword here. the hill."), (1, "the stone sang. the hill."), (2, None), (3, ""), (4, "VileThing!")]
    frame = spark.createDataFrame(test, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert [got[k].predicted for k in range(5)] == [1, 0, 0, 0, 1]
    assert got[2].score == got[3].score == pytest.approx(0.01)
    found = toxicity.offending(frame, model).collect()
    assert [(r.doc_id, r.sentence.strip()) for r in sorted(found, key=lambda r: r.doc_id)] == [(0, "a nastyword here"), (4, "VileThing")]


def test_toxicity_scores_agree_with_noisy_or():
    model = toxicity.Model({"bad": 9.0, "goo-": -1.0}, -4.0, 0.02)
    text = "bad start. good one\nplain"
    p = [s for _, _, s in toxicity.sentence_scores(text, model)]
    assert toxicity.score_text(text, toxicity.Weights(model), model.bias, model.leak)[0] == pytest.approx(toxicity.noisy_or(np.array(p), 0.02))


def test_toxicity_gradient_raises_the_likelihood():
    s = toxicity.Settings(rounds=60)
    words, sizes, per_doc = np.array([0, 1, 1, 0, 2, 1]), np.array([1, 1, 1, 1, 1, 1]), np.array([2, 1, 2, 1])
    theta, bias = toxicity.train(words, sizes, per_doc, np.array([1, 0, 1, 0]), 3, s)
    assert theta[0] > 2 > theta[1] and toxicity.counted(theta[1] + bias) < 0.1 < 0.5 < toxicity.counted(theta[0] + bias)


def test_toxicity_without_both_classes(spark):
    model = toxicity.fit(spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, toxic int"))
    assert model.weights == {} and toxicity.score(samples.docs(spark, []), model).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return segment.Vocabulary(PIECE_MODEL)


def brute_segment(text, v, n):
    text, out = v.sp.normalize(text), []

    def grow(i, ids, score):
        if i == len(text):
            out.append((score, tuple(ids)))
        for j in range(i + 1, len(text) + 1):
            p = v.id.get(text[i:j])
            if p is not None:
                grow(j, [*ids, p], score + v.score[p])
            elif j == i + 1:
                grow(j, [*ids, *v.fallback_ids(text[i])], score + v.fallback)

    grow(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])[:n]


@pytest.mark.parametrize("text", ["Hello world", "a  b☃ç", "é", "  x", "日本", "ab\ncd", "the ther"])
def test_segmentation_is_the_n_best(vocabulary, text):
    ids, best = segment.Encoder(vocabulary, 4).encode([text])[0]
    want = brute_segment(text, vocabulary, 400)
    assert [s for s, _ in best] == pytest.approx([s for s, _ in want[:4]])
    for s, change in best:
        own = segment.whole(ids, change)
        assert any(tuple(own) == w and s == pytest.approx(x) for x, w in want)
        assert segment.decode(own, vocabulary) == text


def test_long_words_agree_with_short_ones(vocabulary):
    words = ["▁" + "abcdefghij" * 4, "▁ther", "▁☃é"]
    ids, score, second = segment.search(words, vocabulary)
    for k, w in enumerate(words):
        a = segment._search_long(w, vocabulary)
        assert (a[0], a[1]) == (ids[k], pytest.approx(score[k])) and a[2] == pytest.approx(second[k])


def test_encoding_round_trips(spark):
    got = segment.encode(samples.docs(spark), PIECE_MODEL).collect()
    assert all(r.round_trip for r in got) and len(got) == len(samples.rows())
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_tokens == by_id[1].n_tokens == 0 and list(by_id[0].ids) == []
    assert all(r.n_tokens == len(r.ids) == r.best_tokens[0] for r in got)
    assert segment.encode(samples.docs(spark, []), PIECE_MODEL).count() == 0


def test_vocabulary_is_hashed_side_by_side(monkeypatch):
    step, calls = segment.Vocabulary.step, []
    monkeypatch.setattr(segment.Vocabulary, "step", staticmethod(lambda h, c: calls.append(len(h)) or step(h, c)))
    v = segment.Vocabulary(PIECE_MODEL)
    assert 0 < len(calls) <= v.longest and sum(calls) == sum(map(len, v.id))
    for p, i in [*list(v.id.items())[::97], ("qzqzqzqz", -1)]:
        h = np.zeros(1, np.uint64)
        for c in p:
            h = step(h, np.array([ord(c)], np.uint64))
        assert v.find(h).tolist() == [i]


AWKWARD = ["", " ", "a b", "  lead", "trail ", "☃ é\n日本", "\x00", "\ufffd", "▁", "a▁b", "☃▁", "ﬁ", "\U0001f600\r\n", "<0x41> <unk>", "x" * 100]


def test_restored_texts_are_those_that_decode_gives(vocabulary, monkeypatch):
    monkeypatch.setattr(segment, "SPELLED_AT_ONCE", 7)
    ids = [x for x, _ in segment.Encoder(vocabulary, 3).encode(AWKWARD)]
    wrong = [*ids, np.array([vocabulary.byte[0xE2], vocabulary.byte[0x28]]), ids[2][1:], ids[5][:-1]]
    texts = [*AWKWARD, "?", "a b", AWKWARD[5]]
    want = [segment.decode(x.tolist(), vocabulary) == t for x, t in zip(wrong, texts)]
    flat, sizes = np.concatenate(wrong).astype(np.int32), np.array([len(x) for x in wrong])
    assert segment.restored(flat, sizes, texts, vocabulary) == want
    assert segment.restored(flat[:0], sizes[:1], [""], vocabulary) == [True]
    assert want.count(False) == 6 and not any(want[-3:])
    # pieces are not walked one by one where the bytes agree
    monkeypatch.setattr(segment, "decode", None)
    plain = [k for k, t in enumerate(AWKWARD) if t and want[k] and "▁" not in t]
    assert all(segment.restored(ids[k], np.array([len(ids[k])]), [AWKWARD[k]], vocabulary)[0] for k in plain) and len(plain) == 11


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a>About us</a></li></ul></nav>
<div class="ad">Buy this now!</div><article><h1>A &amp; B</h1><p>First  par &eacute;\n one.<br>more<p>Second <b>bold</b> text here.</article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I like it.</p></div></section><footer>&copy; 2020 Us</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html_blocks.extract(pages).collect()
    want = "A & B\nFirst par é one. more\nSecond bold text here."
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert html_blocks.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("before", ["<svg/>", '<svg class="i" />', "<video>", "<object>", "<iframe src=x>", "<canvas><video><canvas>x</canvas>", "<object>a<object>b</object>c</object>", "<noscript/>"])
def test_hidden_elements_end_where_they_end(before):
    page = f"<html><body>{before}<article><p>First here.</p><svg><path d='m'/></svg><video>no</video><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article></body></html>"
    assert [b.text for b in html_blocks.blocks(page)] == ["First here.", "Let x=1 be."]
    assert html_blocks.blocks(f"{before}<style>p<p>gone") == []


@pytest.mark.parametrize("tag", ['<p title="5" tall">', '<p t">', "<p title=it's>", '<p title = "a > b" data-x=\'>\'>', '<p a="1"b="2">', '<p x=y="z>', "<p ''>", "<p =>"])
def test_quotes_open_values_only_after_an_equals_sign(tag):
    got = html_blocks.blocks(f'<article>{tag}He said "go <b>now</b>" and left.</p><p>It\'s done.</p></article>')
    assert [x.text for x in got] == ['He said "go now" and left.', "It's done."]


def test_labeller_on_held_out_pages():
    m, wrong, n = html_blocks.trained(), 0, 0
    for k in range(9_000_000, 9_000_120):
        _, own, y = html_blocks.example(k)
        if own:
            p = html_blocks.label(html_blocks.vectors([own]), m)[0]
            wrong, n = wrong + int(((p >= 0.5) != (y >= 0.5)).sum()), n + len(y)
    assert wrong / n < 0.02


def test_lstm_gradient_is_right():
    rng = np.random.default_rng(0)
    x, mask, w = rng.normal(size=(4, 2, 3)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool), rng.normal(size=(3 + 2, 8))
    d = rng.normal(size=(4, 2, 2)) * mask[:, :, None]
    hs, kept = html_blocks._run(x, mask, w, keep=True)
    grad = html_blocks._back(x, mask, w, kept, d)
    for i, j in [(0, 0), (2, 5), (4, 7), (3, 2)]:
        e = np.zeros_like(w)
        e[i, j] = 1e-6
        slope = ((html_blocks._run(x, mask, w + e)[0] - html_blocks._run(x, mask, w - e)[0]) * d).sum() / 2e-6
        assert slope == pytest.approx(grad[i, j], rel=1e-4, abs=1e-7)


def test_chunked_viterbi_equals_viterbi_over_the_whole():
    rng = np.random.default_rng(4)
    m = transcripts.Hmm(np.log(rng.dirichlet(np.ones(6))), np.log(rng.dirichlet(np.ones(6), 6)), ())
    e = np.log(rng.random((50, 6)))
    whole = transcripts.viterbi(e, m, None, None)
    parts = [e[:20], e[20:21], e[21:21], e[21:50]]
    first = ((m.start + e[0])[:, None] + transcripts.transfer(e[1:20], m)).max(axis=0)
    bounds = transcripts.stitch([transcripts.transfer(p, m) for p in parts], first, m)
    assert np.concatenate([transcripts.viterbi(p, m, *b) for p, b in zip(parts, bounds)]).tolist() == whole.tolist()


def test_transcripts_recover_roles(spark):
    turns = []
    for c in range(60):
        for t in range(6):
            turns.append((c, t, ["user", "assistant"][t % 2], "What is it?" if t % 2 == 0 else "It is a long answer that goes on for a while. " * 3))
    turns += [(1000, t, ["user", "assistant"][t % 2], f"line {t}?" if t % 2 == 0 else "yes it is so, as was said before and will be again.") for t in range(200)]
    turns += [(None, None, None, None), (7, 0, "user", "What is it?")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chunks = transcripts.from_turns(df).cache()
    got = transcripts.parse(chunks, transcripts.fit(chunks)).join(chunks.withColumnRenamed("states", "true"), ["key", "chunk"]).collect()
    right = sum(a // 2 == b // 2 for r in got for a, b in zip(r.states, r.true))
    assert right / sum(r.n_lines for r in got) > 0.97 and sum(r.key == "1000" for r in got) == 4
    assert all(r.canonical.endswith("<|end|>") for r in got if r.n_lines)
    assert transcripts.parse(chunks.limit(0), transcripts.fit(chunks)).count() == 0


def test_noisy_or_bounds():
    assert toxicity.noisy_or(np.zeros(0), 0.0) == 0.0 and math.isclose(toxicity.noisy_or(np.array([0.5, 0.5]), 0.0), 0.75)


def test_long_clean_text_stays_clean(spark):
    model = toxicity.Model({"bad": 12.0, "stone": 0.4, "moon": -0.3}, -6.0, 0.01)
    words = EN + ["stone", "moon"]
    r = random.Random(2)
    clean = ". ".join(" ".join(r.choice(words) for _ in range(5)) for _ in range(4000)) + "..." * 5000
    frame = spark.createDataFrame([(1, clean), (2, clean + ". bad one"), (2, clean + ". bad one"), (None, "..!")], "doc_id long, text string")
    got = toxicity.score(frame, model).collect()
    assert sorted((r.doc_id or 0, r.predicted, r.n_sentences) for r in got) == [(0, 0, 0), (1, 0, 4000), (2, 1, 4001), (2, 1, 4001)]
    with pytest.raises(ValueError):
        toxicity.score(frame.withColumn("score", toxicity.F.lit(1)), model, keep=["score"])


def test_more_languages_than_a_word_has_bits():
    s = language.Settings(log2_words=16)
    rng = np.random.default_rng(1)
    own = {int(g): [k % 70] for k, g in enumerate(rng.integers(0, 2**32, 7000))}
    model = language.build([f"l{k:02}" for k in range(70)], own, s)
    g = np.array(sorted(own), np.uint64)
    m = language.masks(g, model)
    assert m.shape == (2, len(g)) and all(int(m[own[int(x)][0] // 64, k]) >> (own[int(x)][0] % 64) & 1 for k, x in enumerate(g))


def test_small_tables_learn_like_large_ones(spark):
    rows = [(k, t, lang) for lang, words in (("en", EN), ("de", DE)) for k, t in enumerate(made(words, 60, 1))] + [(900, "qqxx qqxx", "xx")]
    model = language.fit(spark.createDataFrame(rows + rows[:1] + [(901, None, "zz")], "doc_id long, text string, lang string"))
    got = language.predict(spark.createDataFrame([(1, "qqxx"), (2, EN[3]), (None, "the " * 50000)], "doc_id long, text string"), model).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, "xx"), (2, "en"), (None, "en")}


def test_samples_never_become_empty(spark):
    from hearthgraph.llm.common import sampled

    ids = spark.range(200_000)
    assert 100 < ids.where(sampled(toxicity.F.col("id"), 0.001)).count() < 300
    assert 100 < ids.where(sampled(toxicity.F.col("id"), toxicity.F.lit(0.001))).count() < 300


def brute_viterbi(e, m):
    import itertools

    best = max(itertools.product(range(len(m.start)), repeat=len(e)), key=lambda p: m.start[p[0]] + e[0, p[0]] + sum(m.move[a, b] + e[k + 1, b] for k, (a, b) in enumerate(zip(p, p[1:]))))
    return list(best)


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(8)
    m = transcripts.Hmm(np.log(rng.dirichlet(np.ones(6))), np.log(rng.dirichlet(np.ones(6), 6)), ())
    for n in (1, 2, 5):
        e = np.log(rng.random((n, 6)))
        assert transcripts.viterbi(e, m, None, None).tolist() == brute_viterbi(e, m)


def test_seams_of_blocks_of_blocks(spark):
    rng = np.random.default_rng(4)
    m = transcripts.Hmm(np.log(rng.dirichlet(np.ones(6))), np.log(rng.dirichlet(np.ones(6), 6)), ())
    e = np.log(rng.random((70, 6)))
    parts = [e[2 * k : 2 * k + 2] for k in range(35)]
    first = lambda p: ((m.start + p[0])[:, None] + transcripts.transfer(p[1:], m)).max(axis=0)
    rows = [("a", k, transcripts.transfer(p, m).ravel().tolist(), first(p).tolist()) for k, p in enumerate(parts)]
    got = transcripts.seams(spark.createDataFrame(rows, "key string, chunk long, mat array<double>, first array<double>"), block=3).collect()
    by = {r.chunk: (None if r.enter < 0 else r.enter, r.leave) for r in got}
    states = np.concatenate([transcripts.viterbi(p, m, *by[k]) for k, p in enumerate(parts)])
    assert states.tolist() == transcripts.viterbi(e, m, None, None).tolist()


def test_transcripts_with_white_space_lines_and_hot_keys(spark):
    long = "\n".join(f"line {k}" for k in range(100_000))
    turns = [(c, t, r, x) for c in range(8) for t, (r, x) in enumerate([("user", "What?\r\n\r\nWell?\t\n\t\n"), ("assistant", "It is.\n\u00a0\nSo it is.\r\n")])]
    turns += [(50, 0, "user", long), (None, None, None, None), (None, None, None, "\r\n\t")] + [(60, None, "user", "same?")] * 300
    df = spark.createDataFrame([(*x, "k", 1) for x in turns], "conv_id long, turn long, role string, text string, key string, chunk int")
    chunks = transcripts.from_turns(df).cache()
    got = transcripts.parse(chunks, transcripts.fit(chunks)).collect()
    true = {(r.key, r.chunk): len(r.states) for r in chunks.collect()}
    assert {(r.key, r.chunk): len(r.states) for r in got} == true
    assert true[("50", 0)] == 100_000 and {k: n for k, n in true.items() if k[0] == "60"}.keys() == {("60", c) for c in range(5)}
    assert sum(n for k, n in true.items() if k[0] == "60") >= 300


def plain_toxicity(text, model):
    """Score and offending sentences by the formula, feature by feature."""
    import re

    parts = [set(re.findall(r"[^\W\d_]+", p)) for p in re.split(r"[.!?\n]+", toxicity.lowered(text or ""))]
    parts, none, hot = [p for p in parts if p], 1 - model.leak, 0
    for words in parts:
        z = model.bias - math.log(len(parts)) / toxicity.POWER
        for w in words:
            z += model.weights.get(w, 0) + sum(model.weights.get(w[:k] + "-", 0) for k in (3, 4, 5, 6, 7) if k < len(w))
        p = (1 / (1 + math.exp(-z))) ** toxicity.POWER
        none, hot = none * (1 - p), hot + (p >= 0.5)
    return 1 - none, len(parts), hot


def test_toxicity_equals_a_plain_reading(spark):
    model = toxicity.Model({"bad": 2.6, "vil-": 1.3, "vile": 1.3, "stone": 0.2, "moon": -0.4}, -0.4, 0.01)
    r = random.Random(9)
    words = [*EN, "bad", "vile", "villa", "Stone", "MOON", "12", "İbad"]
    texts = [None, "", " \n..", "bad", "bad" * 3, *["".join(r.choice(words) + r.choice([" ", " ", " ", ". ", "\n", "!?"]) for _ in range(r.randrange(1, 120))) for _ in range(60)]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(frame, model).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in rows)
    spans = {}
    for x in toxicity.offending(frame.dropDuplicates(["doc_id"]), model).collect():
        spans[x.doc_id] = spans.get(x.doc_id, 0) + 1
    for x in got:
        p, n, hot = plain_toxicity(texts[x.doc_id], model)
        assert x.score == pytest.approx(p) and (x.n_sentences, x.n_offending) == (n, hot) and x.predicted == (p >= 0.5)
        # one definition everywhere: a sentence that offends is located, and makes its document toxic
        assert spans.get(x.doc_id, 0) == hot and (x.predicted or not hot)
    assert sum(x.n_offending > 0 for x in got) > 5


def test_toxicity_training_climbs_the_scored_likelihood():
    """Moving any trained weight either way lowers the likelihood that the scoring formula gives (no penalty, equal classes)."""
    s = toxicity.Settings(rounds=2000, rate=0.02, l1=0.0, l1_docs=0.0)
    words, sizes, per_doc, y = np.array([0, 1, 1, 2, 0, 2, 1, 0]), np.ones(8, int), np.array([2, 2, 2, 2]), np.array([1, 0, 0, 1])
    theta, bias = toxicity.train(words, sizes, per_doc, y, 3, s)

    def likelihood(t):
        model = toxicity.Model({"abc"[k] * 2: t[k] for k in range(3)}, t[3], s.leak)
        p = [plain_toxicity(". ".join("abc"[w] * 2 for w in words[2 * d : 2 * d + 2]), model)[0] for d in range(4)]
        return sum(math.log(x if label else 1 - x) for x, label in zip(p, y))

    at = [*theta, bias]
    best = likelihood(at)
    for k in range(4):
        for step in (-0.3, 0.3):
            # a weight that is far below has nothing more to win either way
            assert likelihood([t + step * (j == k) for j, t in enumerate(at)]) < best + 1e-6


def test_toxicity_of_any_length():
    model = toxicity.Model({"bad": 4.0}, -0.4, 0.01)
    weights = toxicity.Weights(model)
    clean = [toxicity.score_text("stone sang low. " * n, weights, model.bias, model.leak)[0] for n in (1, 10, 1000, 200_000)]
    assert max(clean) < 0.07
    assert toxicity.score_text("stone sang low. " * 1000 + "bad bell", weights, model.bias, model.leak)[0] > 0.5

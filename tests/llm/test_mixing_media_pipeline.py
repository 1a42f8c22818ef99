import hashlib
import random
import struct
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from hearthgraph.llm import media, mixing
from hearthgraph.llm.queries import OP2_SQL

from . import samples

SMALL = "/root/testdata/sf0.001"


def test_mixing_equals_sql(spark):
    docs = samples.docs(spark)
    got = sorted(map(tuple, mixing.production(docs).select("doc_id", "domain", "lang", "source", "tokens", "copies").collect()))
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    want = sorted(db.sql(f"SELECT doc_id, domain, lang, source, tokens, copies FROM ({OP2_SQL})").fetchall())
    assert got == want and got


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s1", 5), ("b", "x", "s1", 1000)], "domain string, lang string, source string, tokens long")
    mix = mixing.Mix(budget_permille=400, max_epochs=1)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, mix).collect()}
    total = 2015 * 400 // 1000
    assert got[("a", "x", "s1")] == 10 and got[("a", "y", "s1")] == 5
    assert got[("a", "x", "s2")] == total // 2 - 15 and got[("b", "x", "s1")] == total // 2


def test_mixing_stays_within_budget_and_prefix(spark):
    docs = spark.createDataFrame([(k, "x" * (40 + k % 9), "en", f"src{k % 3}") for k in range(600)], "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(budget_permille=500, max_epochs=3)
    got = mixing.select(docs, mix, mixing.levels_of_documents()).collect()
    total = sum(-(-(40 + k % 9) // 4) for k in range(600))
    used = sum(r.tokens * r.copies for r in got)
    assert total * 0.5 - 60 <= used <= total * 0.5
    twice = mixing.mixed(docs, mixing.Mix(budget_permille=1500, max_epochs=2), mixing.levels_of_documents())
    assert twice.columns == docs.columns and 850 < twice.count() <= 900


def test_mixing_empty_table(spark):
    assert mixing.production(samples.docs(spark, [])).count() == 0
    assert mixing.mixed(samples.docs(spark, []), mixing.PRODUCTION, mixing.levels_of_documents()).count() == 0


def test_mixed_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, f"some text {k}", "en", "s.example.com", 7, k, "x") for k in range(60)] + [(None, "some text", None, None, 7, 0, "x")] * 2, "doc_id long, text string, lang string, source string, _copies int, __COPIES long, _mix_id string")
    got = mixing.mixed(docs, mixing.Mix(budget_permille=1000, max_epochs=2), mixing.levels_of_documents())
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all((r[4], r[6]) == (7, "x") and r[5] == (r[0] or 0) for r in rows)


def test_media_digest(spark):
    got = {r.doc_id: r for r in media.digest(samples.docs(spark)).collect()}
    for k, t, *_ in samples.rows():
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_type == "audio/wav" and r.type_corrected and r.media_sha256 == hashlib.sha256(media.wav(p)).hexdigest()
    assert got[0].feature == got[1].feature
    assert media.digest(samples.docs(spark, [])).count() == 0


def png() -> bytes:
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif() -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def bmp() -> bytes:
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"


@pytest.mark.parametrize("blob, kind", [(png(), "image/png"), (gif(), "image/gif"), (bmp(), "image/bmp"), (media.wav(bytes(64)), "audio/wav"), (zlib.compress(b"x" * 99, wbits=31), "application/gzip")])
def test_sniffing_confirms_and_carves(blob, kind):
    a = media.automaton()
    assert media.sniff(blob, "text/plain", a)[:2] == (kind, True)
    assert media.sniff(blob[:-1], kind, a)[0] == "application/octet-stream"
    host = b"junk BM RIFF PK\x03\x04" + blob + b"tail"
    assert [(f.media_type, host[f.start : f.end]) for f in media.sniff(host, None, a)[2]] == [(kind, blob)]


def test_many_headers_without_ends_take_linear_time():
    a = media.automaton()
    for head in (b"%PDF-1.4 startxref ", b"PK\x03\x04PK\x05\x06", b"%PDF-%%EOF"):
        began = time.process_time()
        media.scan(head * 60_000, a)
        assert time.process_time() - began < 10


def test_ends_by_index_equal_ends_by_search():
    rng = random.Random(5)
    parts = [b"%PDF-", b"startxref", b"%%EOF", b"x" * 7, b"PK\x03\x04", b"PK\x01\x02"]
    for _ in range(300):
        b = b"".join(rng.choices(parts, k=12))
        entry = len(b) + 4
        b += b"PK\x03\x04PK\x01\x02" + b"PK\x05\x06" + struct.pack("<8xIIH", 4, rng.choice([4, entry]), 0) + b"".join(rng.choices(parts, k=3))
        for i in range(len(b)):
            end = b.find(b"%%EOF", i)
            right = end + 5 if end >= 0 and b.find(b"startxref", i, end) >= 0 else None
            assert (x.end if (x := media._pdf(b, i)) else None) == right
            at, right = b.find(b"PK\x05\x06", i), None
            while at >= 0 and at + 22 <= len(b) and right is None:
                size, offset, note = struct.unpack_from("<IIH", b, at + 12)
                if i + offset + size == at and b[i + offset : i + offset + 4] == b"PK\x01\x02" and at + 22 + note <= len(b):
                    right = at + 22 + note
                at = b.find(b"PK\x05\x06", at + 1)
            assert (x.end if (x := media._zip(b, i)) else None) == right


def test_sniff_column(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "image/gif", 0), (2, None, None, 0), (None, bytearray(b""), "x", 0)], "id long, content binary, declared string, media_type int")
    got = {r.id: r for r in media.sniff_column(df, "id", "content", "declared").collect()}
    assert (got[1].media_type, got[1].type_corrected, got[2].type_corrected, got[None].type_corrected) == ("image/png", True, False, True)


def test_pipeline_stages_hold_against_brute_force(spark):
    import corpus_pipeline as p

    from .test_exact_and_join import brute_exact, brute_join

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*p.COLUMNS)
    rows = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SMALL).cache()
        before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        rows[name] = (before, after)
        if name != "segmentation":
            assert out.columns == p.COLUMNS and set(after) <= set(before)
        docs = out
    before, after = rows["exact_dedup"]
    assert {r[0] for r in after} == {i for i, x in brute_exact(before).items() if x[2]}
    before, after = rows["jaccard_join"]
    assert {r[0] for r in after} == {i for i, x in brute_join(before).items() if i == x[1]}
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "segmentation"]
    assert len(rows["segmentation"][1]) == len(rows["mixing"][1]) > 0
    assert docs.where(~F.col("round_trip")).count() == 0

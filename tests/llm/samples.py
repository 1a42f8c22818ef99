"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, n long, tokens long, token long, key string"


def texts(seed: int = 3) -> list[str | None]:
    r = random.Random(seed)
    words = ["the", "stone", "river", "hill", "sang", "low", "éclair", "straße", "moon", "gate", "quiet", "bell", "amber", "road"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 60))) for _ in range(6)]
    near = [b.replace(" ", "  ", 3) for b in base[:3]] + [b + " extra tail" for b in base[:2]]
    mixed = [base[3] + "\n" + base[4], base[4][:150] + " new words follow here " + base[5][20:160]]
    return [None, "", "   \n\t", "one", "One", "two words", "a b c d", "a b c d", "日本語 テキスト", *base, *near, *mixed, base[0], base[0].upper(), "na " * 2000, "na " * 2000, "x" * 5000, "☃ — !"]


def rows(seed: int = 3) -> list[tuple]:
    got = [(k, t, None if k % 7 == 3 else ["en", "de"][k % 2], None if k % 5 == 4 else f"src{k % 4}", len(t or ""), k % 2, "h", 1, 2, 3, "key") for k, t in enumerate(texts(seed))]
    return got


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)

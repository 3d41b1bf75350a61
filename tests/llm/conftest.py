import random

import pytest

WORDS = {
    "en": "the of and to in that was with this there which have from they been would their could water people after house under never light".split(),
    "de": "der die und nicht auch werden einer schön über haben zwischen straße müssen größer während würde können daß fenster wetter".split(),
}
CLASH = "id long, n long, value long, base string, spans string, hits string, redacted string, score string, rejected string, text_in string, component long, Lang_Pred string"


def prose(r: random.Random, lang: str, n: int) -> str:
    """Invented prose of n words."""
    ws = [r.choice(WORDS[lang]) + r.choice(["", "", "er", "ing" if lang == "en" else "ung"]) for _ in range(n)]
    return " ".join(w + "." * (i % 11 == 10) for i, w in enumerate(ws))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): prose with copies, near copies, nulls, empty and very long texts."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, prose(r, lang, r.randrange(20, 120)), lang))
    rows += [(200 + i, rows[i % 3][1], "en") for i in range(6)]  # copies
    for i in range(12):  # near copies of a long one
        ws = prose(random.Random(9), "en", 150).split()
        ws[(i * 13) % 150] = f"odd{i}"
        rows.append((300 + i, " ".join(ws), "en"))
    rows += [(400, None, "en"), (401, "", "de"), (402, "  \n\t ", None), (403, "12 34 -- ..", "en"), (404, "one two three", "en"), (405, "One TWO three", "en"), (406, "\U0001f600 é " * 3, None)]
    rows += [(500, prose(r, "en", 60_000), "en"), (501, "x" * 300_000, "en"), (502, "7" * 200_000, None), (503, "@" * 100_000, None), (504, "a@" * 50_000, None)]
    rows += [(0, rows[0][1], "en"), (None, rows[1][1], "de"), (None, None, None)]
    return [(i, t, lang, f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t, lang in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.selectExpr("*", *(f"cast(null as {c.split()[1]}) as `{c.split()[0]}`" for c in CLASH.split(", ")))


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")

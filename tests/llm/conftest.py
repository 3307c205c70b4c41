import random

import pytest

WORDS = "the of and to in house river stone light cloud winter summer paper garden window bridge silver orange purple yellow market letter forest harbor island meadow castle candle mirror basket".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) for _ in range(n)]
    return "".join(w + ("\n" if r.random() < 0.06 else ". " if r.random() < 0.08 else " ") for w in words).strip()


def changed(text: str, seed: int, times: int) -> str:
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(times):
        words[r.randrange(len(words))] = "changed"
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Ids and texts: prose, exact and near copies, empty, null and blank texts, one long one, a null id, a repeated row."""
    base = prose(1, 200)
    out = [(i, prose(i, 30 + 7 * i)) for i in range(10, 24)]
    out += [(i, base) for i in range(30, 36)] + [(i, changed(base, i, 2)) for i in range(40, 48)]
    out += [(50, ""), (51, None), (52, " \t\n \r\n"), (53, "word"), (54, "two words"), (55, prose(99, 6000)), (56, "ÄÖÜ straße ñandú 中文 ▁ \u00a0x\u2028y"), (57, "a" * 3000), (58, "ab" * 2500 + " end")]
    return out + [(None, base), (23, out[13][1]), (60, "Same line here again\n" * 5)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns that operators use as names of their own."""
    data = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "x") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score int, items int, component int, __text string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

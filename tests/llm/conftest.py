import pytest

from loomwork.llm.common import ready

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, k1 string, id string, n int, k2 double, `group` string, x0 string"


@pytest.fixture(autouse=True)
def session(spark):
    return ready(spark)


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside. rows: (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "a")), None if r[1] is None else len(r[1]), "own", "own", "own", 7, 0.5, "own", "own") for r in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


LONG = " ".join(f"word{i % 977} and{i}" for i in range(30000))
EDGES = [(1, None), (2, ""), (3, "   \t\n\x0b "), (None, "a text whose id is null but whose words are many enough to count here"), (4, "short"), (5, LONG), (6, LONG),
         (7, "é" * 30 + "\n" + "日本語 " * 40), (8, "same row twice"), (8, "same row twice"), (9, None), (None, None), (10, "a\r\nb\r\n\r\n\x00c")]


def same(a, b):
    """Equal rows in any order; null and repeated ids included."""
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)

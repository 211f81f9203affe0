import random

import pytest

WORDS = ("der die das und ist ein haus baum strasse wasser licht nicht mit von auf zu im ".split(),
         "the and of to in is that for with house tree street water light not from ".split())
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the input.
CLASHES = ", row long, kept string, size long, copies int, score double, n long, digest string, rank int, shingle long, starts string, cls int"


def prose(rng: random.Random, n: int, kind: int = 1) -> str:
    return " ".join(rng.choice(WORDS[kind]) + rng.choice(["", "", "a", "en", "ly"]) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in each column, empty and blank texts, a very long text, ties, equal rows, one id with two texts, odd characters."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, 60, i % 2) + (" " + passage if i % 4 == 0 else ""), ("de", "en")[i % 2], f"s{i % 3}", 0) for i in range(24)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", "s0", 0), (102, " \t\n ", None, None, 3), (103, "12 34 !! ??", "de", None, 9),
             (104, "a", "de", "s1", 1), (105, "Ünï çödé 日本語 ﬁ \u0301x " * 30, None, "s1", 9), (None, prose(rng, 40), "en", "s2", 9),
             (None, None, None, None, None), (106, prose(rng, 30_000), "en", "s0", 9), (107, "ab " * 4000, "en", "s0", 9)]
    rows += [rows[3], rows[3], (3, prose(rng, 50), "en", "s1", 9), (108, rows[5][1], "en", "s1", 9), (109, rows[5][1].upper() + " x", "en", "s1", 9)]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows, with clashing columns, in several partitions of a file, as scans give them."""
    path = _written(spark, [(*r, 1, "k", 2, 3, 0.5, 4, "d", 5, 6, "st", 7) for r in edge_rows()], SCHEMA + CLASHES)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.read.parquet(_written(spark, [], SCHEMA + CLASHES))


def _written(spark, rows: list, schema: str) -> str:
    import uuid

    from vectorloom.llm.common import prepare

    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/edge-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return path


@pytest.fixture(scope="session")
def written(spark):
    return lambda rows, schema: spark.read.parquet(_written(spark, rows, schema))

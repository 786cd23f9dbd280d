import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, ties and repeated rows."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    same = text(80)
    rows = [(i, text(rng.randrange(1, 200)), rng.choice(["en", "de", None]), f"s{i % 4}", None) for i in range(60)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", None, 0), (102, " \t\n", None, None, 3),
             (103, same, "en", "s1", 9), (104, same, "en", "s1", 9), (104, same, "en", "s1", 9),
             (None, same, None, None, None), (105, "x" * 200_000, "en", "s2", None),
             (106, text(30_000), "en", "s2", None), (107, "1 " * 20_000, "de", "s3", None),
             (108, "\n".join(["a line that comes again and again"] * 20), "en", "s3", None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """With columns whose names helpers might use."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows, SCHEMA).repartition(5)
    for name in ("row", "size", "kind", "class", "score", "component", "mix_rate", "pii_base", "n", "a", "id"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 110, 3)] + [(None, 1, 1), (5, None, None), (9999, 0, 1), (3, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """Rows with nulls in every column but doc_id, empty and long texts, exact and near copies, shared passages, ties."""
    r = random.Random(3)
    rows, passage, line = [], prose(r, 60), prose(r, 8, 30)
    for i in range(120):
        rows.append((i, prose(r, r.randrange(1, 260)), r.choice(["en", "fr", None]), r.choice(["a", "b", "é", None]), None))
    for i in range(120, 180):  # near copies of one text, in a chain of small changes
        w = rows[5][1].split() if i == 120 else rows[-1][1].split()
        w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a", 1))
    for i in range(180, 230):  # a hot group of exact copies, some of them with other white space
        rows.append((i, rows[7][1] if i % 2 else rows[7][1].replace(" ", " \t\n ", 3), "en", "a", 1))
    for i in range(230, 300):  # a passage, and a line, that many share
        rows.append((i, f"{line}\n{prose(r, 30)} {passage if i % 3 else ''} {prose(r, 30)}\n{line}", "fr", "b", 1))
    long = prose(r, 150_000, 5000)
    rows += [(300, None, None, None, None), (301, "", "en", "", 0), (302, " \t\n\x0b\x0c\r ", "en", "a", 7), (303, "a b c", "en", "a", 5), (304, "A b C", "en", "a", 5), (305, "a " * 100, "en", "a", 200), (306, long, "en", "a", len(long)), (307, long[:900_000], "en", "a", 1), (308, "z" * 700_000 + " tail of it", "de", "a", 1), (309, "été   x #*$ 12 \n12\n12 ", "fr", "a", 1), (310, "123 456 !!", None, "a", 1)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, messy):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(messy, SCHEMA).repartition(5)
    # names that the operators use inside
    for name in ("size", "bucket", "key", "sig", "n", "salt", "rank", "class", "version", "label", "position", "doc", "k_id", "keep", "run"):
        frame = frame.withColumn(name, F.lit(f"{name}!"))
    return frame


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(messy):
    return [(r[0], r[1]) for r in messy]

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) of the smallest shared table, copies and edited copies among them, and odd cases."""
    table = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table]
    rng = random.Random(5)
    longest = max((t for _, t in rows), key=len)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:20])]
    for i in range(40):  # near copies with one or two words changed
        w = longest.split(" ")
        for _ in range(1 + i % 2):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
        rows.append((1100 + i, " ".join(w)))
    rows += [
        (1200, None), (1201, ""), (1202, " \t\n\x0b\x0c\r "), (1203, "one"), (1204, "one two"), (1205, "ONE Two"),
        (1206, "a " * 3000), (1207, "ab" * 4000), (1208, "é" * 900 + "x" + "é" * 900), (1209, "\x00" * 900 + "z"),
        (1210, "a b\nc  d\t e"), (1211, "a b c d e"), (1212, " a b c d e"),
        (1213, "\n".join(["same line here"] * 30)), (1214, longest * 3), (1215, "line\r\nline\r\n" * 40),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, nulls everywhere and columns whose names the operators use inside."""
    text = " ".join(f"word{i}" for i in range(60)) + " and so on until there are quite enough bytes in it " * 9
    rows = [
        (1, text, None, "s", None), (1, text, None, "s", None), (None, text, "en", None, 3),
        (None, "other " + text, "en", None, 3), (None, None, None, None, None), (2, None, "x", "s", 1),
        (3, text, "x", "t", 1), (-5, "short", "x", "t", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "no_id", "kept", "size", "rank", "bucket", "doc", "fp", "n", "a.b", "_id", "_sha", "_text_sha", "batch",
                 "bucket_", "slot", "Shard"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")

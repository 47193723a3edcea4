import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("c0", T.StringType()), T.StructField("_text", T.LongType()), T.StructField("row", T.ArrayType(T.IntegerType())),
    T.StructField("node", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("a.b", T.StringType())])


def texts():
    """Prose with copies, near copies, shared passages, white space of all kinds, a long text and odd ones."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 8))) for _ in range(400)] + ["the", "and", "of", "is", "to"] * 20
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ".\n", ","]) for _ in range(n))
    passage = prose(60)
    out = [prose(rng.randint(1, 220)) for _ in range(40)]
    out += [out[3], out[3].replace(" ", " \t", 5), out[5], out[5]]
    for k in (0, 7, 9):
        words = out[k].split(" ")
        for _ in range(3):
            changed = list(words)
            changed[rng.randrange(len(words))] = "changed"
            out.append(" ".join(changed))
    out += [f"{prose(30)} {passage} {prose(rng.randint(0, 40))}" for _ in range(6)]
    out += ["", None, " ", "\n\t ", "x", "a b", "a b", "one two three four five", "same " * 100, "same " * 90, "naïve 中文 字 ١٢٣   x\u0085y", prose(9000),
            "<|endoftext|> tail", "  lead", "w" * 5000, "1234 5678", "THE END", "\x1c\x1d z", passage, passage + " " + passage]
    return out


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, ("en", "de", None)[i % 3], f"k{i % 4}", i, [i], "n", None, 0.5, "dot") for i, t in enumerate(texts())]
    out += [out[4], out[4], (None, "no id here", None, None, None, None, None, None, None, None), (None, "no id here", None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < -1")


@pytest.fixture(scope="session")
def single(docs):
    """Rows with an id of their own."""
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"])

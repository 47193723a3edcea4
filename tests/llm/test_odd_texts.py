"""Texts that once ended a job, and operators off the package's path."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from brushwork.llm import bpe, language, scoring, toxicity

BLANKS = [" " * 5000, "\n" * 5000, " \n\t" * 2000, "　" * 3000, " " * (1 << 20), "\n" * (1 << 22)]


@pytest.mark.parametrize("run", BLANKS, ids=lambda r: f"{len(r)}x{ord(r[0])}")
@pytest.mark.parametrize("form", ["{}", "x{}", "{}y", "x{}y", "x{}<|endoftext|>{}1", "x {} y 'll"])
def test_long_runs_of_blanks_encode_as_the_library_does(run, form):
    if len(run) > 10_000 and form not in ("x{}y", "{}"):
        pytest.skip("one long run is enough")
    text = form.replace("{}", run)
    want = Tokenizer.from_file(bpe.public()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.codec(bpe.public()).ids(text), "<u4").tolist() == want


def test_a_language_of_letterless_texts_is_not_learned(spark):
    rows = [(i, f"the quick brown fox number {i}", "en") for i in range(20)] + [(100 + i, ["", "12 34", "١٢", None][i % 4], "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.trained(docs)
    assert set(model[1]) == {"en"}
    got = {r.doc_id: r["_lang"] for r in language.predicted(docs, model).collect()}
    assert {got[i] for i in range(20)} == {"en"} and {got[i] for i in range(100, 120)} == {"und"}


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_kind(spark, toxic):
    docs = spark.createDataFrame([(i, f"plain text {i}." if i else "") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic) for i in range(40)], "doc_id long, toxic int")
    got = {r.doc_id: r["_score"] for r in toxicity.scored(docs, toxicity.trained(docs, labels)).collect()}
    assert got[0] == 0 and all((got[i] > 0.9) == bool(toxic) for i in range(1, 40)) and min(got.values()) >= 0


def test_counts_beyond_single_precision_are_exact():
    import pyarrow as pa

    words = [b"aaaa"] + [b"a%d" % i for i in range(200)]
    n = pa.array([2**33] + [1] * 200)
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([0] * 201, pa.int32()), n, n], ["word", "kind", "learned", "often"])
    both = sum(int(np.frombuffer(bpe.unpressed(r["body"])[0], np.int64).sum()) for b in scoring._summed(iter([batch])) for r in b.to_pylist())
    bits = [len(w) + (1 if scoring.Bits([w], np.zeros(1, int)).bytes.size > len(w) else 0) for w in words]
    assert both == 8 * len(scoring.ORDERS) * (2**33 * bits[0] + sum(bits[1:]))


CODE = """
import sys
sys.path.insert(0, {repo!r})
from brushwork.session import local_session
from brushwork.llm import queries
spark = local_session("away", "4", 4)
out = {out!r}
for name in ("op3_lm_scoring", "op6_bpe", "op7_language_id", "op9_toxicity", "op11_spelling_variants", "op12_quality_classifier"):
    print(name, queries()[name](spark, out).count())
"""


def test_queries_run_where_workers_have_no_copy_of_the_package(spark, tmp_path):
    rows = [(i, t, "en" if i % 2 else "de", "s", 0) for i, t in enumerate(["", None, " " * (1 << 22), "\n" * (1 << 22), "x" + " " * 300_000 + "y", "same", "same", "12 34"] + [f"some plain words number {i} there." for i in range(60)])]
    for name, data, kind in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
                             ("labels", [(i, i % 2, i % 3 // 2) for i in range(60)], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, kind).coalesce(1).write.parquet(f"{tmp_path}/data/{name}.parquet")
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=repo, out=f"{tmp_path}/data")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert {v for k, v in counts.items() if k != "op11_spelling_variants"} == {"68"}

"""Exact dedup, quality rules, toxicity and language identification."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers_llm import SPACE_RUN, split
from pyspark.sql import functions as F

from brushwork.llm import exact, language, quality, toxicity


def normal(text):
    return SPACE_RUN.sub(" ", text or "")


def test_exact_groups_against_brute_force(docs, rows):
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r[0])
    got = exact.groups(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_text[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and kept.keys() == by_text.keys()


def test_exact_dedup_keeps_one_row_with_all_columns(docs, rows):
    got = exact.exact_dedup(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    texts = [normal(r.text) for r in got.collect()]
    assert sorted(texts) == sorted({normal(r[1]) for r in rows})
    assert 3 in [r.doc_id for r in got.collect()]


@pytest.mark.parametrize("cells", [1 << 15, 1 << 20])
def test_a_full_filter_only_costs_time(docs, rows, cells, monkeypatch):
    monkeypatch.setattr(exact, "cells", lambda n: 1 << 15 if cells == 1 << 15 else cells)
    monkeypatch.setattr(exact, "_places", (lambda digest, n: [F.pmod(F.xxhash64(F.lit(i), F.col(digest)), F.lit(8)) for i in (1, 2)]) if cells == 1 << 15 else exact._places)
    assert exact.exact_dedup(docs).count() == len({normal(r[1]) for r in rows})


def test_exact_of_nothing_and_no_python(none, docs):
    assert exact.groups(none).count() == 0 and exact.exact_dedup(none).columns == none.columns
    plan = exact.groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def measures(text):
    w = split(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, docs, rows, none):
    odd = [(1000, "# a | b\n\n# a | b\n# a | b", None), (1001, "a b c d e a b c d e f a b c d e", None)]
    some = docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    got = quality.judged(some).collect()
    given = Counter((r[0], *measures(r[1])) for r in [*rows, *odd])
    assert Counter((r["_own"].doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == given
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.broken)
    assert quality.judged(none).count() == 0
    out = quality.quality_filter(docs)
    assert out.columns == docs.columns and out.count() == sum(r.kept for r in quality.judged(docs).collect())


def test_a_rule_is_one_expression(docs):
    plan = quality.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.fixture(scope="module")
def marked(spark):
    rng = np.random.default_rng(3)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(clean, 8)) for _ in range(rng.integers(1, 12))]
        toxic = i % 6 == 0
        if toxic:
            sentences[rng.integers(0, len(sentences))] += " you utter " + ["Blockhead", "rotters", "vermin"][i % 3]
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic) if i % 10 else None))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_documents_and_sentences(marked):
    docs, labels = marked
    out = toxicity.scored(docs, toxicity.trained(docs, labels)).collect()
    wrong = [r.doc_id for r in out if (r["_score"] >= toxicity.THRESHOLD) != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 6
    for r in out:
        for k in r["_offending"] or []:
            assert re.search("Blockhead|rotters|vermin", r.text.split(".")[k])
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 490


def test_length_alone_is_not_toxic(marked):
    docs, labels = marked
    model = toxicity.trained(docs, labels)
    plain = "quiet green hills lie north of town. "
    long = docs.sparkSession.createDataFrame([(1, plain), (2, plain * 20_000), (3, plain * 20_000 + "you utter vermin.")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scored(long, model).collect()}
    assert got[2]["_score"] == pytest.approx(got[1]["_score"]) and got[2]["_score"] < toxicity.THRESHOLD
    assert got[3]["_score"] >= toxicity.THRESHOLD and got[3]["_offending"] == [20_000]


def test_toxicity_of_odd_rows(docs, none, marked, rows):
    model = toxicity.trained(*marked)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["_score_"] <= 1 for r in got)
    assert all(r["_score_"] == 0 for r in got if not (r.text or "").strip())
    assert toxicity.scored(none, model).count() == 0
    unlabelled = toxicity.trained(docs, marked[1].where("doc_id < 0"))
    assert max(r["_score"] for r in toxicity.scored(docs, unlabelled, keep=["doc_id"]).select(F.col("_score_").alias("_score")).collect()) < 0.01


def test_languages_are_told_apart(spark, none):
    rng = np.random.default_rng(5)
    syllables = {"aa": ["ba", "bo", "bi"], "bb": ["kru", "kre", "tsch"], "cc": ["été", "où", "ça"]}
    rows = [(i, " ".join("".join(rng.choice(s, 3)) for _ in range(20)), lang) for i, (lang, s) in enumerate(list(syllables.items()) * 60)]
    rows += [(900, None, "aa"), (901, "123 !", "bb"), (902, "bababa", None), (903, "", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predicted(docs, language.trained(docs)).collect()}
    assert all(got[i]["_lang"] == lang for i, _, lang in rows[:180])
    assert [got[i]["_lang"] for i in (900, 901, 903)] == ["und"] * 3 and got[902]["_lang"] == "aa"
    assert all(0 <= r["_score"] <= 1 for r in got.values())
    nothing = language.trained(docs.where("lang = 'zz'"))
    assert {r["_lang"] for r in language.predicted(docs, nothing).collect()} == {"und"}
    assert language.predicted(docs.where("doc_id < 0"), language.trained(docs)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    from brushwork.llm.common import fold
    held = {r.doc_id for r in docs.where(fold("doc_id", 4) == 2).collect()}
    import zlib
    assert held == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2}
    other = docs.withColumn("lang", F.when(F.col("doc_id").isin(sorted(held)), "xx").otherwise("en"))
    assert set(language.trained(other)[1]) == {"en"}


def test_queries_match_their_sql(spark):
    from oracle import compare, connect

    from brushwork import llm
    import oracle
    folder = "/root/testdata/sf0.001"
    con = connect(folder)
    before = oracle.queries, oracle.oracle_sql
    oracle.queries, oracle.oracle_sql = llm.queries, llm.oracle_sql
    try:
        for name in llm.oracle_sql():
            assert compare(spark, con, folder, name)["status"] == "ok", name
    finally:
        oracle.queries, oracle.oracle_sql = before
    assert isinstance(con, duckdb.DuckDBPyConnection)

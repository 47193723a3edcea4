"""The quality classifier: its statistics against plain Python, its rules against the compiled column, and held-out rows."""

import math
import random
import re

import numpy as np
import pytest
from helpers_llm import split
from pyspark.sql import functions as F

from brushwork.llm import ensemble
from brushwork.llm.common import fold


def slow(text):
    """The statistics of a text, word by word."""
    data = (text or "").encode()
    words = [w.encode() for w in split(text)]
    lines = [x for x in re.split("\n", text or "") if split(x)]
    kinds = [int(ensemble.CLASS[b]) for b in data]
    n = [kinds.count(k) for k in range(10)]
    share = lambda x, of: x / max(of, 1)
    seen, gaps = {}, []
    for i, w in enumerate(words):
        gaps.append(i - seen.get(w, -1000))
        seen[w] = i
    kind = lambda b: int(ensemble.CLASS[b])
    count = len(words)
    solid = len(data) - n[ensemble.SPACE]
    stripped = [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x) for x in lines]
    copied = sum(x in stripped[:i] for i, x in enumerate(stripped))
    letters = n[ensemble.LOWER] + n[ensemble.UPPER]
    out = {
        "length": math.log1p(len(data)), "words": math.log1p(count), "word_bytes": share(solid, count), "letters": share(letters + n[ensemble.WIDE], solid),
        "wide": share(n[ensemble.WIDE], len(data)), "upper": share(n[ensemble.UPPER], letters), "digits": share(n[ensemble.DIGIT], solid),
        "symbols": share(n[ensemble.SYMBOL], count), "bars": share(n[ensemble.BAR], count), "bangs": share(n[ensemble.BANG], count), "points": share(n[ensemble.POINT], count),
        "blanks": share(n[ensemble.SPACE], len(data)), "others": share(n[ensemble.OTHER], count), "short": share(sum(len(w) <= 2 for w in words), count),
        "long": share(sum(len(w) > 20 for w in words), count), "title": share(sum(kind(w[0]) == ensemble.UPPER for w in words), count),
        "capital": share(sum(sum(kind(b) == ensemble.UPPER for b in w) >= 2 and not any(kind(b) == ensemble.LOWER for b in w) for w in words), count),
        "marked": share(sum(kind(w[-1]) in (ensemble.SYMBOL, ensemble.BAR, ensemble.BANG) for w in words), count),
        "numbered": share(sum(any(kind(b) == ensemble.DIGIT for b in w) for w in words), count), "again": share(sum(g == 1 for g in gaps), count),
        "near": share(sum(g <= ensemble.NEAR for g in gaps), count), "far": share(sum(g <= ensemble.FAR for g in gaps), count),
        "line_words": math.log1p(share(count, len(lines))), "ended": share(sum(ensemble.ENDS[x.encode()[-1]] for x in stripped), len(lines)), "copied": share(copied, len(lines))}
    return [out[k] for k in ensemble.STATISTICS]


def test_statistics_against_plain_python(docs, rows):
    keep = [c for c in docs.columns if c != "a.b"]
    got = ensemble.with_statistics(docs.select(*keep), "text", ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r)[2:] == pytest.approx(slow(r.c1)), r.c1


def test_pieces_of_long_texts_add_up(monkeypatch):
    rng = random.Random(3)
    text = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) + "." for _ in range(500))
    whole = ensemble.measured([text.encode()])[0]
    monkeypatch.setattr(ensemble, "PIECE", 1000)
    both = ensemble.measured([text.encode(), b"short"])
    assert both[0] == pytest.approx(whole) and both[1] == pytest.approx(slow("short"))
    assert np.isfinite(ensemble.measured([b"x" * 5000, b" " * 5000, b"\n" * 3000])).all()


def prose(rng, lines):
    word = lambda: "".join(rng.choice(("an", "tor", "wel", "mi", "dus", "ek")) for _ in range(rng.randint(1, 5)))
    return "\n".join(" ".join(word() for _ in range(rng.randint(6, 14))) + "." for _ in range(lines))


def table(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = prose(rng, rng.randint(1, 30))
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), "buy " * rng.randint(10, 50), text.replace(" ", "### ")])
        rows.append((i, text, "en"))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_rows_and_the_compiled_column(spark):
    docs, labels = table(spark)
    model = ensemble.trained(docs, labels)
    assert 0 < len(model.rules) < 300 and all(1 <= len(rule) <= 2 * ensemble.DEPTH for rule in model.rules) and len(model.table()) == len(model.rules)
    held = docs.where(fold("doc_id", ensemble.FOLDS) == ensemble.HELD)
    got = ensemble.scored(held, model).join(labels, "doc_id").collect()
    assert len(got) > 200 and sum((r["_score"] >= 0.5) == (r.quality == 1) for r in got) >= 0.97 * len(got)
    x = ensemble.measured([r.text.encode() for r in got])
    z = model.bias + sum(w * ensemble.held(rule, x) for rule, w in zip(model.rules, model.weights))
    assert [r["_score"] for r in got] == pytest.approx((1 / (1 + np.exp(-z))).tolist())
    plan = ensemble.scored(held, model, keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PythonUDF" not in plan and "Exchange" not in plan


def test_the_held_out_fold_teaches_nothing_and_order_does_not_matter(spark):
    docs, labels = table(spark)
    other = labels.withColumn("quality", F.when(fold("doc_id", ensemble.FOLDS) == ensemble.HELD, 1 - F.col("quality")).otherwise(F.col("quality")))
    first = ensemble.trained(docs, labels)
    again = ensemble.trained(docs.repartition(3, "text"), other)
    assert first.rules == again.rules and first.weights == pytest.approx(again.weights)


def test_length_alone_is_not_bad(spark):
    docs, labels = table(spark)
    model = ensemble.trained(docs, labels)
    good = [prose(random.Random(9), n) for n in (2, 20, 5000)]
    got = ensemble.scored(spark.createDataFrame([(i, t) for i, t in enumerate(good)], "doc_id long, text string"), model).collect()
    assert all(r["_score"] >= 0.5 for r in got)


def test_odd_rows(spark, docs, none, rows):
    made, labels = table(spark)
    model = ensemble.trained(made, labels)
    got = ensemble.scored(docs, model)
    assert got.columns == [*docs.columns, "_score_"]
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r["_score_"] <= 1 for r in got)
    assert len({r["_score_"] for r in got if not r.text}) == 1
    assert ensemble.scored(none, model).count() == 0
    assert ensemble.trained(docs, labels.where("doc_id < 0")) == ensemble.Ensemble(0.0, [], [])
    assert ensemble.trained(none, labels).rules == []
    ones = ensemble.trained(made, labels.withColumn("quality", F.lit(1)))
    assert ones.rules == [] and ones.bias > 5
    mixed = labels.unionAll(labels.selectExpr("doc_id", "0")).unionAll(labels.selectExpr("cast(null as long)", "quality")).unionAll(labels.selectExpr("doc_id", "cast(null as int)"))
    assert ensemble.trained(made, mixed).bias < -5

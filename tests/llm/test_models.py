"""Language identification and toxicity against the same models worked out text by text in plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brushwork.llm import language, toxicity

MASK = (1 << 64) - 1
WORD = re.compile(rb"[a-z\x80-\xff]+")


def spread(x):
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 & MASK
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 32)


def hashed(run, seed):
    """The polynomial of the bytes' values, and their number."""
    base, h = 0x5851F42D4C957F2D + 16 * seed, 0
    for i, b in enumerate(run):
        h += spread(b + 1000 * seed + 1) * pow(base, i, 1 << 64)
    return spread((h + len(run) * 0xBF58476D1CE4E5B9 + seed) & MASK)


def words(text):
    return WORD.findall((text or "").lower().encode())


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


# Language identification


def grams(text):
    out = Counter()
    for w in words(text):
        for size in range(1, 5):
            for at in range(len(w) - size + 1):
                edge = (at == 0) + 2 * (at + size == len(w))
                out[(hashed(w[at:at + size], 11) + edge * 0x9E3779B97F4A7C15 & MASK) >> 53] += 1
    return out


def unit(v):
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / max(norm, 1e-12) for k, x in v.items()}


def dot(a, b):
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def total(vs):
    out = Counter()
    for v in vs:
        for k, x in v.items():
            out[k] += x
    return dict(out)


def first_best(values):
    return max(range(len(values)), key=lambda k: (values[k], -k))


def languages(rows):
    """doc_id -> (language, score, rejected), of rows (doc_id, text, lang)."""
    taught = [(grams(t), lang) for i, t, lang in rows if t and lang and not held(i) and any(map(str.isalpha, t))]
    df = Counter(k for g, _ in taught for k in g)
    vector = lambda g: unit({k: math.log1p(n) * (math.log((1 + len(taught)) / (1 + df[k])) + 0.1) for k, n in g.items()})
    taught = [(vector(g), lang) for g, lang in taught]
    centres = []
    for lang in sorted({lang for _, lang in taught}):
        x = sorted((v for v, own in taught if own == lang), key=lambda v: [v.get(k, 0.0) for k in range(7, -1, -1)])
        c = [{k: s / len(x) for k, s in total(x).items()}]
        for _ in range(min(language.CENTROIDS, len(x)) - 1):
            c.append(x[min(range(len(x)), key=lambda j: (max(dot(x[j], o) for o in c), j))])
        for _ in range(10):
            near = [first_best([dot(v, o) for o in c]) for v in x]
            c = [unit(total(v for v, k in zip(x, near) if k == j)) if j in near else o for j, o in enumerate(c)]
        centres += [(lang, o) for o in c]
    mine = {}
    for v, lang in taught:
        s = [dot(v, o) if own == lang else -1.0 for own, o in centres]
        mine.setdefault(first_best(s), []).append((v, max(s)))
    final = []
    for k, (lang, o) in enumerate(centres):
        sims = [s for _, s in mine.get(k, [])]
        mean = sum(sims) / len(sims) if sims else 0.0
        spread_ = math.sqrt(max(sum(s * s for s in sims) / len(sims) - mean**2, 0)) if sims else 0.0
        final.append((lang, unit(total(v for v, _ in mine[k])) if sims else o, mean - language.REJECT * spread_))
    out = {}
    for i, t, _ in rows:
        s = [dot(vector(grams(t)), o) for _, o, _ in final]
        k = first_best(s)
        score = min(max(s[k], 0.0), 1.0)
        out[i] = (final[k][0], score, score <= 0 or score < final[k][2] - language.ROUNDING) if t and any(map(str.isalpha, t)) else ("und", 0.0, True)
    return out


def test_languages_equal_plain_python(spark):
    rng = random.Random(12)
    sounds = {"aa": ["ba", "bo", "nim", "ta"], "bb": ["kru", "kre", "tsch", "ba"], "cc": ["été", "où", "ça", "na"]}
    rows = []
    for i in range(220):
        lang = rng.choice(list(sounds))
        kind = sounds[lang][:2] if rng.random() < 0.5 else sounds[lang][1:]
        rows.append((i, " ".join("".join(rng.choice(kind) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 30))), lang))
    rows += [(300, None, "aa"), (301, "12 ! 7", "bb"), (302, "", "cc"), (303, "zzz qqq xxx", None), (304, "BA BO", None), (305, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in language.predicted(docs, language.trained(docs)).collect()}
    want = languages(rows)
    assert got.keys() == want.keys()
    for i, (lang, score, rejected) in want.items():
        assert (got[i]["_lang"], got[i]["_rejected"]) == (lang, rejected) and got[i]["_score"] == pytest.approx(score, abs=2e-6)


# Toxicity


def sentences(text):
    """Per sentence that has a word, its features."""
    out = []
    for part in re.split(r"[.!?\n]", text or ""):
        found = set()
        for w in words(part):
            found.add(hashed(w, 7) >> 44)
            found |= {(hashed(w[:k], 7) + k & MASK) >> 44 for k in toxicity.PREFIXES if len(w) > k}
        if found:
            out.append(found)
    return out


def toxic_model(rows, labels):
    """(features, bias of a text, bias of a sentence, weights) by Adam over the noisy-or's likelihood."""
    marks = {}
    for i, y in labels:
        if y is not None and not held(i):
            marks[i] = max(marks.get(i, 0), int(y > 0))
    taught = [(sentences(t), marks[i]) for i, t in rows if i in marks]
    n = Counter(y for _, y in taught)
    seen = Counter((f, y) for s, y in taught for f in set().union(*s))
    gains = {}
    for f in {f for f, _ in seen}:
        clean, toxic = seen[f, 0], seen[f, 1]
        share0, share1 = (clean + 0.5) / (n[0] + 1), (toxic + 0.5) / (n[1] + 1)
        gain = toxic * math.log(share1 / share0)
        if toxic >= 3 and share1 > 4 * share0 and gain > toxicity.LEAST_GAIN:
            gains[f] = gain
    features = sorted(sorted(gains, key=lambda f: (-gains[f], f))[:toxicity.SELECTED])
    at = {f: k for k, f in enumerate(features)}
    taught = [([hit for x in s if (hit := [at[f] for f in x if f in at])], bool(s), y) for s, y in taught]
    theta = [0.0] * len(features) + [-6.0, -6.0]
    m, v = [0.0] * len(theta), [0.0] * len(theta)
    for t in range(1, 401):
        grad = [-toxicity.PENALTY * w for w in theta[:-2]] + [0.0, 0.0]
        for found, some, y in taught:
            zs = [theta[-1] + sum(theta[k] for k in hit) for hit in found]
            clear = sum(math.log1p(math.exp(z)) for z in zs) + some * math.log1p(math.exp(theta[-2]))
            slope = -(1 - y) + y * math.exp(-clear) / max(-math.expm1(-clear), 1e-9)
            grad[-2] += slope * some / (1 + math.exp(-theta[-2]))
            for z, hit in zip(zs, found):
                g = slope / (1 + math.exp(-z))
                grad[-1] += g
                for k in hit:
                    grad[k] += g
        for k, g in enumerate(grad):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            theta[k] += 0.05 * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return at, theta


def toxic_score(text, at, theta):
    s = sentences(text)
    zs = [theta[-1] + sum(theta[at[f]] for f in x if f in at) if any(f in at for f in x) else -math.inf for x in s]
    clear = sum(math.log1p(math.exp(z)) for z in zs) + bool(s) * math.log1p(math.exp(theta[-2]))
    return -math.expm1(-clear), [k for k, z in enumerate(zs) if z > math.log(0.3 / 0.7)] or None


def test_toxicity_equals_plain_python(spark):
    rng = random.Random(21)
    plain = [f"{a}{b}" for a in ("stone", "river", "field", "grün", "ü") for b in ("", "s", "ed", "able", "water")]
    rows, labels = [], []
    for i in range(220):
        parts = [" ".join(rng.choice(plain) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 6))]
        toxic = rng.random() < 0.3
        if toxic and rng.random() < 0.9:
            k = rng.randrange(len(parts))
            parts[k] += " you " + rng.choice(["Blockhead", "blockheads", "vermin", "verminous rotter"])
        elif rng.random() < 0.1:
            parts[0] += " vermin"  # said of mice
        rows.append((i, rng.choice([". ", "! ", "\n"]).join(parts)))
        labels.append((i, None if i % 13 == 0 else int(toxic)))
    rows += [(400, None), (401, ""), (402, "... !"), (403, "VERMIN"), (404, "river"), (405, "vermin. " * 3 + "river. blockhead!")]
    labels += [(5, 1), (7, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.trained(docs, marks)
    at, theta = toxic_model(rows, labels)
    assert list(model[0]) == list(at) and len(at) > 5
    assert [*model[3], model[1], model[2]] == pytest.approx(theta, abs=1e-6)
    got = {r.doc_id: r for r in toxicity.scored(docs, model, keep=["doc_id"]).collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        score, bad = toxic_score(t, at, theta)
        assert got[i]["_score"] == pytest.approx(score, abs=1e-6) and got[i]["_offending"] == bad


def test_a_tables_own_fold_is_the_contracts(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"))
    from brushwork.llm.common import fold
    assert {r.doc_id for r in docs.where(fold("doc_id", 4) == 2).collect()} == {i for i in range(300) if held(i)}

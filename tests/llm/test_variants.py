"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from brushwork.llm import variants

LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def counted(rows, least_length=5, least_count=3):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def neighbours(words):
    """Pairs one edit apart, by words without one letter."""
    without, at = {}, {}
    for w in words:
        for i in range(len(w)):
            at.setdefault((i, w[:i] + w[i + 1:], len(w)), set()).add(w)
            without.setdefault(w[:i] + w[i + 1:], set()).add(w)
    near = {w: set() for w in words}
    for group in at.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for longer in without.get(w, ()):
            near[w].add(longer)
            near[longer].add(w)
    return near


def slow(n, ratio=2):
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def rows_of(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def vocabulary(seed, letters, lengths, size):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(size)}
    for w in rng.sample(sorted(words), min(len(words), size // 2)):
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:], w + w[-1]}
    return {w: rng.choice((3, 3, 4, 6, 7, 12, 13, 40, 200)) for w in words if w}


CASES = [("ab", (1, 9), 400), ("aabéÿ÷", (4, 7), 900), ("abcdefgh", (5, 8), 2000), ("ab", (20, 40), 200), ("xyz", (60, 120), 60)]


@pytest.mark.parametrize("letters,lengths,size", CASES)
@pytest.mark.parametrize("rows,group", [(1 << 14, 1 << 16), (8, 2)])
def test_against_plain_python(spark, monkeypatch, letters, lengths, size, rows, group):
    monkeypatch.setattr(variants, "ROWS", rows)
    monkeypatch.setattr(variants, "GROUP", group)
    n = vocabulary(size, letters, lengths, size if rows > 8 else size // 4)
    got = rows_of(variants.grouped(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)))
    assert got == slow(n)


def test_languages_that_meet_in_one_number_are_not_merged(monkeypatch):
    monkeypatch.setattr(variants, "mixed", lambda x: x & np.uint64(1))
    data = [b"ab", b"ac", b"bb", b"bd", b"a", b"c"]
    start = np.cumsum([0] + [len(d) for d in data[:-1]])
    a = variants.Acceptor(np.frombuffer(b"".join(data), np.uint8), start, start + [len(d) for d in data], np.array([0, 0, 0, 0, 1, 1]))
    root, one, two, _ = variants.composed(a)
    pairs = {(data[a.base[g] + p], data[a.base[g] + q]) for r, p, q in zip(root, one, two) for g in np.flatnonzero(a.root == r)}
    assert pairs == {(b"ab", b"ac"), (b"ab", b"bb"), (b"bb", b"bd"), (b"a", b"c")}


def test_the_acceptor_is_minimised():
    data = [x + y for x in (b"a", b"b", b"c") for y in (b"xx", b"xy", b"z")]
    start = np.cumsum([0] + [len(d) for d in data[:-1]])
    a = variants.Acceptor(np.frombuffer(b"".join(data), np.uint8), start, start + [len(d) for d in data], np.zeros(9, int))
    assert len(a.final) == 4 and len(a.letter) == 3 + 2 + 2  # initial, after a first letter, after x, and the end


def test_corpus_against_plain_python(spark, docs, rows):
    text = [(r[0], r[1]) for r in rows]
    n = counted(text)
    assert len(n) > 50 and n["wwwww"[:5]] if "wwwww" in n else len(n) > 50
    assert rows_of(variants.grouped(variants.vocabulary(docs))) == slow(n)


def test_counts_with_much_damage(spark):
    rng = random.Random(1)
    base = ["Mountain", "fountain", "École×", "straße", "MOUNTAINS", "a", "fours"]
    text = [(i if i % 5 else None, " ".join(rng.choice(base) for _ in range(40)) if i % 7 else None) for i in range(700)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in text], "doc_id long, text string, word string, n int")
    n = counted(text)
    assert any(w not in {b.translate(LOWER) for b in base} for w in n)
    assert rows_of(variants.grouped(variants.vocabulary(df))) == slow(n)


def test_long_runs_and_nothing(spark, none):
    long = "q" * 3000 + "r" * 3000
    n = {long: 9, long[1:]: 4, long[:2000] + "z" + long[2000:]: 3, long[:-1] + "s": 5, "apart": 3}
    assert rows_of(variants.grouped(spark.createDataFrame(list(n.items()), "word string, n long"))) == slow(n)
    assert variants.grouped(variants.vocabulary(none)).count() == 0
    assert rows_of(variants.grouped(spark.createDataFrame([("alone", 3)], "word string, n long"))) == [("alone", 3, 0, None, None, "alone")]

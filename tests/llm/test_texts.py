"""Substring dedup, near-dedup, BPE, packing, scoring, chat formatting, and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers_llm import split
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brushwork.llm import bpe, chat, near, packing, scoring, substring


def stripped(texts, window):
    """Texts without the words under windows that start twice or more."""
    words = [split(t) for t in texts]
    many = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if many[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window, block", [(35, 6 << 20), (5, 2000)])
def test_substrings_against_brute_force(docs, rows, window, block, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    got = substring.substring_dedup(docs, window=window, keep=["doc_id", "_text"]).collect()
    want = [(r[0], n, k, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, k, kept) in zip(rows, stripped([r[1] for r in rows], window))]
    assert Counter((r.c0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want)


def test_substring_rows_keep_their_columns(docs, none, rows):
    out = substring.without_repeats(docs)
    assert out.schema.names == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema] and out.count() == len(rows)
    assert {r.text for r in out.where("doc_id = 41").collect()} <= {rows[41][1], ""} | {k for _, _, k in stripped([r[1] for r in rows], 35)}
    assert substring.without_repeats(none).count() == 0


def shingles(text, width=5):
    w = split(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def test_near_classes_against_brute_force(single):
    rows = single.select("doc_id", "text").collect()
    sets, up = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= near.SIMILAR * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: r for r in near.classes(single).collect()}
    assert {i: r.class_id for i, r in got.items()} == {i: top(i) for i in sets}
    sizes = Counter(top(i) for i in sets)
    assert all(r.class_size == sizes[r.class_id] for r in got.values())


def test_near_rows_keep_one_of_each(docs, none, rows):
    out = near.one_of_each(docs)
    assert out.columns == docs.columns
    got = out.collect()
    ids = {r.class_id for r in near.classes(docs).where("node is not null").collect()}
    assert Counter(r.doc_id for r in got if split(r.text)) == Counter(ids)
    assert sum(not split(r.text) for r in got) == sum(not split(r[1]) for r in rows)
    assert near.one_of_each(none).count() == 0 and near.classes(none).count() == 0


@pytest.mark.parametrize("n,more", [(4, 1), (5, 1), (8, 2), (9, 2), (12, 3), (16, 4)])
def test_short_links_always_share_a_key(n, more):
    """n shingles, and the same with some more at either end: 0.8 or little above."""
    rng = random.Random(n)
    texts = []
    for i in range(3000):
        words, before = [f"w{rng.randrange(10**9)}" for _ in range(n + 4 + more)], rng.randint(0, more)
        texts += [" ".join(words).encode(), " ".join(words[before:before + n + 4]).encode()]
    keys, size = near.Shingled(texts).keys()
    assert size[0] == n + more and size[1] == n
    assert all(set(a.tolist()) & set(b.tolist()) for a, b in zip(keys[0::2], keys[1::2]))


def test_word_counts_are_handed_on_before_they_fill_a_task():
    """600,000 distinct words: no batch holds more than some 2^18 and a block's, and all are counted."""
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}" for i in range(k, k + 20_000)) for k in range(0, 600_000, 20_000)]),
                                        pa.array([1] * 30, pa.int32())], ["text", "role"])
    out = list(scoring._counted(np.zeros((scoring.KINDS, 1 << scoring.KIND_BITS), np.float32))([batch]))
    assert max(b.num_rows for b in out) < 420_000
    assert sum(sum(b.column("learned").to_pylist()) for b in out) == 600_000 + 30  # words and ends


def test_copies_with_edits_of_their_own_are_not_all_compared(spark, monkeypatch):
    """Forty copies of one text in one bucket, each with a quarter of its shingles to itself, and a near copy of two of them."""
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(40):
        own = list(words)
        for k in range(rng.randrange(20), 200, 18):
            own[k] = f"x{i}-{k}"
        rows.append((bytes([i]) * 16, own))
    for i in (7, 30):
        rows.append((bytes([100 + i]) * 16, [*rows[i][1][:-1], "end"]))
    code = lambda ws: b"".join(zlib.crc32(w.encode()).to_bytes(4, "little")[:3] for w in ws)
    codes = spark.createDataFrame([(n, code(w)) for n, w in rows], "node binary, codes binary")
    met, compared = [], near.compared
    monkeypatch.setattr(near, "compared", lambda pairs, *rest: met.append(pairs.count()) or compared(pairs, *rest))
    links = near.links(codes.select("node", F.array(F.lit(1).cast("long")).alias("keys")), codes)
    assert {(r.a[0], r.b[0]) for r in links.collect()} == {(7, 107), (30, 130)}
    assert sum(met) < 60  # 41 with the leader; all pairs are 861


def test_no_link_of_a_bucket_is_lost(spark):
    """A chain of texts in one bucket, of which the ends are far from the leader: rounds go on until no link can be missing."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    rows, text = [], list(words)
    for i in range(14):
        rows.append((bytes([i]) * 16, list(text)))
        for k in rng.sample(range(len(text)), 2):
            text[k] = f"x{i}{k}"
    far = [f"y{i}" for i in range(120)]
    rows += [(bytes([100 + i]) * 16, far[:60] + words[:60] if i else far) for i in range(2)]
    code = lambda ws: b"".join(zlib.crc32(w.encode()).to_bytes(4, "little")[:3] for w in ws)
    codes = spark.createDataFrame([(n, code(w)) for n, w in rows], "node binary, codes binary")
    nodes = codes.select("node", F.array(F.lit(1).cast("long")).alias("keys"))
    links = near.links(nodes, codes)
    got = {bytes(r.node): bytes(r.root) for r in near.components(links).collect()}
    sets = {n: set(near.distinct_shingles(code(w)).tolist()) for n, w in rows}
    up = {n: n for n in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert {n: got.get(n, n) for n in sets} == {n: top(n) for n in sets}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201)]
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in near.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 201: 200}
    assert near.components(df.where("a is null")).count() == 0


def test_alignment_is_order_sensitive():
    a = np.arange(100, dtype=np.uint64)
    assert near.aligned(a, a, 0.8) == (1.0, 1.0)
    moved = np.concatenate([a[50:], a[:50]])
    assert near.aligned(a, moved, 0.8) == (0.0, 1.0)
    assert near.aligned(a, np.concatenate([a[:95], a[95:] + np.uint64(500)]), 0.8)[0] == pytest.approx(95 / 105)
    assert near.aligned(a, a + np.uint64(1000), 0.8) == (0.0, 0.0)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.public())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bpe_of_whole_tables(docs, rows, none, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 3000)
    out = bpe.encode(docs)
    assert out.columns == [*docs.columns, "ids_"]
    got = Counter((r.doc_id, r.text, tuple(r["ids_"])) for r in out.collect())
    assert got == Counter((r[0], r[1], tuple(ids_of(tokenizer, r[1]))) for r in rows)
    back = bpe.decode(out, "ids_", keep=["doc_id", "text"]).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == len(rows)
    assert bpe.encode(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\u0085  \x1c'stlM19.<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_codec_equals_the_library(text):
    c, t = bpe.codec(bpe.public()), Tokenizer.from_file(bpe.public()) if not hasattr(test_codec_equals_the_library, "t") else test_codec_equals_the_library.t
    test_codec_equals_the_library.t = t
    ids = t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(c.ids(text), "<u4").tolist() == ids
    assert b"".join(c.pieces[i] for i in ids).decode() == t.decode(ids, skip_special_tokens=False) == text


def test_special_tokens_in_texts(tokenizer):
    c = bpe.codec(bpe.public())
    for text in ("<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b  <|endoftext|>", " <|endoftext|>\n"):
        assert np.frombuffer(c.ids(text), "<u4").tolist() == ids_of(tokenizer, text)


def test_packing_holds_every_id_once(docs, rows, none, tokenizer):
    got = packing.pack(docs, with_ids=True).toPandas()
    want = Counter()
    for r in rows:
        ids = np.array([*ids_of(tokenizer, r[1]), 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[r[0], s, min(2048, len(ids) - s), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)] += 1
    rows_of = lambda d: Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in d.itertuples())
    assert rows_of(got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.06 * got.length.sum() / 2048 + 1
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 64, 400 * (seed + 1)) if seed < 3 else np.full(50, 40)
    histogram = Counter(sizes.tolist())
    plan = packing.planned(histogram, 64)
    held = Counter()
    for used, times in plan:
        assert sum(s * n for s, n in used.items()) <= 64
        held.update({s: n * times for s, n in used.items()})
    assert held == histogram
    bins = sum(t for _, t in plan)
    known = np.array(sorted(histogram))
    bound = packing.relaxed(known, np.array([histogram[int(k)] for k in known], float), 64)[1].sum()  # of the linear program
    assert sizes.sum() / 64 <= bound + 1e-6 and math.ceil(bound - 1e-6) <= bins <= 1.01 * bound + 1
    assert packing.planned({}, 64) == []


def test_scores_against_brute_force(docs, rows, none):
    got = scoring.scored(docs).collect()
    az = str.maketrans({c: c + 32 for c in range(65, 91)})
    tokens = [[*(t.encode() for t in split((r[1] or "").translate(az))), None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    n = Counter(t for w, h in zip(tokens, held) if not h for t in w)
    total, distinct = sum(n.values()), len(n)
    want = sorted((str(r[0]), h, len(w), sum(t in n for t in w), total, round(sum(math.log10((n[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in w), 6))
                  for r, h, w in zip(rows, held, tokens))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert scoring.scored(none).count() == 0


def test_long_words_cost_bits_for_every_byte(docs):
    rng = random.Random(5)
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    words = {i: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)) for i, n in zip(held, (50, 500, 5000, 50_000))}
    long = docs.sparkSession.createDataFrame(list(words.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in scoring.scored(docs.select("doc_id", "text").unionAll(long)).collect() if r.doc_id in words}
    bits = [-got[i].score / math.log10(2) for i in held]
    assert all(b > len(words[i]) for b, i in zip(bits, held))  # random letters and digits hold more than five bits each
    assert all(7 < b / a < 13 for a, b in zip(bits[1:], bits[2:]))
    assert got[held[3]].bits_per_byte == pytest.approx(got[held[2]].bits_per_byte, rel=0.1)


def test_counters_learn_the_fitting_fold(spark):
    """Spellings that only training fold 1 holds make new words of that spelling likely."""
    rng = random.Random(2)
    folds = {k: [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == k][:60] for k in (0, 1, 2)}
    new = lambda start: start + "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = [(i, " ".join(new("mo") for _ in range(20))) for i in folds[2]]
    rows += [(i, " ".join(new("zqzq" if k % 2 else "mo") for k in range(20))) for i in folds[1]]
    rows += [(folds[0][0], "zqzqkkkk"), (folds[0][1], "qzqzkkkk")]
    got = {r.doc_id: r.bits_per_byte for r in scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[folds[0][0]] < got[folds[0][1]] - 1.5


def test_kinds_are_found_from_all_training_texts(spark, monkeypatch, tmp_path):
    """More texts than the 2,000 that kinds once started from, with copies and texts without words: every round sums all of training."""
    rng, size = random.Random(11), 1 << scoring.KIND_BITS
    word = lambda topic: f"t{topic}w{rng.randrange(30)}"
    texts = [" ".join(word(rng.randrange(8) if rng.random() < 0.4 else i % 8) for _ in range(12)) for i in range(2600)]
    rows = list(enumerate([*texts, *texts[:5], "", None, " "]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id").write.parquet(f"{tmp_path}/docs")
    seen, real = [], scoring.kinds_of

    def spied(found, *rest):
        got = found.collect()
        v = scoring.unpacked([bytes(r.cells) for r in got], [bytes(r.counts) for r in got])
        centres = real(found, *rest)
        sums = scoring.added(found.mapInArrow(scoring._gathered(centres[None]), scoring.FITTED), (1, scoring.KINDS, size + 1))[0]
        seen.append((v, centres, sums))
        return centres

    monkeypatch.setattr(scoring, "kinds_of", spied)
    monkeypatch.setattr(scoring, "KIND_ROUNDS", 40)
    scoring.trained(spark.read.parquet(f"{tmp_path}/docs"))
    (v, centres, sums), = seen
    assert len(v) == sum(zlib.crc32(str(i).encode()) % 10 != 0 for i, t in rows if t and t.strip()) > 2000
    near = v @ centres.T
    plain = np.array([v[near.argmax(axis=1) == k].sum(axis=0, dtype=float) for k in range(scoring.KINDS)])
    assert np.allclose(sums[:, :size], plain, atol=1e-3) and sums[:, size].sum() == pytest.approx(near.max(axis=1).sum(), rel=1e-5)
    moved = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    assert (v @ moved.T).max(axis=1).sum() <= near.max(axis=1).sum() * (1 + 2 * scoring.KIND_GAIN)  # another round adds next to nothing


@pytest.mark.parametrize("n,shares", [(5, [1]), (400, [0.25] * 4)])
def test_few_texts_make_few_kinds(spark, n, shares):
    _, share, _ = scoring.trained(spark.createDataFrame([(100 * i + 1, f"only{i % 4} words{i % 4}") for i in range(n)], "doc_id long, text string"))
    assert sorted(x for x in share if x > 0.01) == pytest.approx(shares, abs=0.05)


def test_fits_are_sums_over_all_words():
    """However the words are dealt out, weights and map come from all of them, by their counts."""
    words, kind = [b"the", b"then", b"of", b"x" * 400], np.array([0, 1, 0, 2])
    one, two = scoring.Model([]), scoring.Model([])
    one.learn([w for w in words for _ in range(3)], np.repeat(kind, 3))
    for _ in range(scoring.FITS):
        two.step(sum(two.slopes([w], kind[i:i + 1], np.array([3.0])) for i, w in enumerate(words)))
    two.refine(sum(two.came([w], kind[i:i + 1], np.array([3.0])) for i, w in enumerate(words)))
    assert np.allclose(one.weights, two.weights) and np.allclose(one.map, two.map)
    assert two.bits(words, 3).sum() < scoring.Model([]).bits(words, 3).sum()


def test_starts_that_words_share_are_looked_up_once():
    """What many words teach, and what they cost, is what each does alone."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 7))).encode() for _ in range(300)] + [b"\n", b"abab", b"abab"]
    kind, count = np.array([rng.randrange(scoring.KINDS) for _ in words]), np.array([rng.randint(1, 9) for _ in words])
    ended = [w if w == b"\n" else w + b" " for w in words]
    bits = scoring.Bits(words, kind)
    assert len(bits.bytes) == len({(k, w[:i + 1]) for w, k in zip(ended, kind.tolist()) for i in range(len(w))})
    assert bits.bytes[bits.spelt].tobytes() == b"".join(ended)

    def summed(*columns):
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64()))], ["word", "kind", "learned"])
        out = np.zeros((2, scoring.OFFSETS[-1]), np.int64)
        for r in (r for b in scoring._summed(iter([batch])) for r in b.to_pylist()):
            out[:, r["slice"] * scoring.SLICE:(r["slice"] + 1) * scoring.SLICE] += np.frombuffer(bpe.unpressed(r["body"])[0], np.int64).reshape(2, -1)
        return out

    some = slice(0, 20)
    assert (summed(words[some], kind[some], count[some]) == sum(summed([w], kind[i:i + 1], count[i:i + 1]) for i, w in enumerate(words[some]))).all()
    model = scoring.Model([])
    model.state[:] = np.random.default_rng(3).integers(1, 65535, len(model.state)) | np.random.default_rng(4).integers(0, 6, len(model.state)) << 16
    for of in (model.slopes, model.came):
        assert np.allclose(of(words, kind, count.astype(float)), sum(of([w], kind[i:i + 1], count[i:i + 1].astype(float)) for i, w in enumerate(words)))
    assert np.allclose(model.bits(words), np.concatenate([model.bits([w]) for w in words], axis=1))


def test_hashes_of_words_do_not_depend_on_how_many_are_taken_at_once(rows):
    w = scoring.Words([(r[1] or "").encode() for r in rows])
    for size in (1, 100, 1 << 20):
        assert (scoring.hashes(w, 91, size) == w.hashes(91)).all()
    assert len(scoring.hashes(scoring.Words([b"", b" "]), 91)) == 0


@pytest.mark.parametrize("flush", [scoring.FLUSH, 40])
def test_word_counts_against_brute_force(monkeypatch, flush):
    """Handed on in one go, or in many: the sums by word and kind of the text are the same, words of held-out texts included."""
    rng = random.Random(6)
    texts = [" ".join(f"W{rng.randrange(300)}" for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", None, " x\ny "]
    role = [rng.randrange(3) for _ in texts]
    monkeypatch.setattr(scoring, "FLUSH", flush)
    centres = np.random.default_rng(1).random((scoring.KINDS, 1 << scoring.KIND_BITS)).astype(np.float32)
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + 400]), pa.array(role[i:i + 400], pa.int32())], ["text", "role"]) for i in range(0, len(texts), 400)]
    out, got, want = list(scoring._counted(centres)(batches)), {}, {}
    for b in out:
        for w, k, *n in zip(*(b.column(i).to_pylist() for i in range(4))):
            got[w, k] = np.add(got.get((w, k), 0), n)
    for t, r in zip(texts, role):
        v = scoring.Words([(t or "").lower().encode()])
        kind = int((scoring.profiles(scoring.held(v, 1)) @ centres.T).argmax())
        for w in [*(x.lower().encode() for x in split(t)), b"\n"]:
            want[w, kind] = np.add(want.get((w, kind), 0), [r == 1, r == 2])
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items()}
    assert max(b.num_rows for b in out) <= flush


def test_blended_lengths_of_any_size():
    counts, size, unseen = np.array([[0.0, 3.0, 0.0]]), np.array([10.0]), np.array([0.25])
    got = scoring.blended(counts, size, unseen, np.array([[4.0, 4.0, 90_000.0]]))[0]
    assert got == pytest.approx([6, -math.log2(0.75 * 0.3 + 0.25 / 16), 90_002])


def test_scores_do_not_depend_on_how_many_words_are_sent(single, monkeypatch):
    """A few words on the way of frequent ones, or all: every word has taught every counter."""
    runs = []
    for most in (scoring.SENT_WORDS, 5):
        monkeypatch.setattr(scoring, "SENT_WORDS", most)
        runs.append({r.doc_id: r.score for r in scoring.scored(single).collect()})
    assert runs[0] == pytest.approx(runs[1], rel=1e-9)


def test_word_probabilities_are_a_distribution(docs):
    """Whatever word is spelt, the bits of its first byte share out all probability."""
    _, share, _ = scoring.trained(docs)
    assert share.sum() == pytest.approx(1)
    model = scoring.Model([])
    model.learn([b"the", b"then", b"of"] * 30, np.zeros(90, int))
    one = np.exp2(-model.bits([bytes([c]) + b"x" for c in range(33, 256)] + [b"\n"], 1)[0])
    first = {}
    for c in range(256):
        bits = scoring.Bits([bytes([c])], np.zeros(1, int))
        p = 1.0
        for j in range(8):
            bit, x, gate = model.inputs(bits, j)
            q, _, _ = model.refined(model.mix(x, gate), gate)
            p *= q[0] if bit[0] else 1 - q[0]
        first[c] = p
    assert sum(first.values()) == pytest.approx(1) and (one > 0).all()


def mail(rng):
    rows = []
    for c in range(40):
        sent = []
        for t in range(rng.randint(1, 9)):
            lines = []
            for _ in range(rng.randint(0, 2)):
                if sent:
                    lines += ["On Monday Bob wrote:"] * rng.randint(0, 1)
                    mark, source = rng.choice(["> ", ">", "  > "]), rng.choice(sent).split("\n")
                    lines += [mark + x for x in source] if rng.random() < 0.7 else [mark + rng.choice(source).upper()]
                    lines += [""] * rng.randint(0, 1)
            lines += [" ".join(rng.choice(["a", "b", "c", "dd", "é", "", "ee"]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 3))]
            text = rng.choice(["\n", "\r\n"]).join(lines)
            sent.append(text.replace("\r", ""))
            rows.append((c, t, rng.choice(["user", "assistant", None]), text if rng.random() < 0.95 else None))
    return rows + rows[:7] + [(None, 1, "user", "> a"), (3, None, "user", "> a")]


def test_chat_against_its_sql(spark, tmp_path):
    import duckdb
    rows = mail(random.Random(3))
    path = str(tmp_path / "conversations.parquet")
    pq.write_table(pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()),
                             "role": [r[2] for r in rows], "text": [r[3] for r in rows]}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    want = con.execute(chat.QUERIES["op8_chat_formatting"][1])
    names = [c[0] for c in want.description]
    df = chat.conversations(spark.read.parquet(path))
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(want.fetchall())
    assert df.agg(F.max("depth")).first()[0] >= 3
    assert chat.conversations(spark.read.parquet(path).where("turn < 0")).count() == 0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_chat_by_hand(spark):
    rows = [("c", 0, "user", "Hello there.\n\nHow are you?"), ("c", 1, "assistant", "> How are\n> you?\n\nFine."),
            ("c", 2, "user", "> how  ARE you?\n\nGood."), ("c", 3, "user", "On Monday X wrote:\n> Fine.\n>> How are you?\n\nThanks."), ("c", 4, None, "> nobody said this\nOk")]
    got = {r.turn: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert [got[t].reply_to for t in range(5)] == [None, 0, 0, 1, None] and [got[t].thread for t in range(5)] == [0, 0, 0, 0, 4]
    assert [got[t].depth for t in range(5)] == [0, 1, 1, 2, 0]
    assert got[3].formatted == "<|user|>\nThanks.\n" and got[3].n_quotes == 2 and got[3].n_linked == 2 and got[4].formatted == "<|unknown|>\nOk\n"


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, seen = docs, []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.dtypes == docs.dtypes
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        seen.append({r.doc_id: r.text for r in kept.collect()})
    toxic, exact, close, cut = seen
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sum(marks.get(i) == 0 for i in toxic) >= 0.95 * sum(m == 0 for m in marks.values())
    by_text = {}
    for i in sorted(toxic):
        by_text.setdefault(" ".join((toxic[i] or "").replace("\x0b", " ").split()) if (toxic[i] or "").strip() else toxic[i], i)
    assert len(exact) == len(by_text) and close.keys() <= exact.keys() and cut.keys() == close.keys()
    ids = sorted(close)
    for i, (n, k, text) in zip(ids, stripped([close[i] for i in ids], 35)):
        assert cut[i] == (text if k else close[i])
    packed = p.STAGES[-1][1](spark, kept, folder).toPandas()
    assert set(packed.doc_id) == set(cut) and (packed.groupby("sequence_id").length.sum() <= 2048).all()
    assert p.queries() == {"pipeline": p.run} and p.oracle_sql() == {}


def test_pipeline_of_nothing(spark, none, tmp_path):
    import corpus_pipeline as p
    folder = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in p.STAGES:
        assert stage(spark, empty, folder).count() == 0

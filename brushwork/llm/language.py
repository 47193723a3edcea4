"""Language identification by nearest centroid: normalised TF-IDF vectors of letter n-grams, several centroids a language.

Four steps. (1) Document frequencies of hashed n-grams over all training rows give the inverse document frequencies.
(2) Per language, spherical k-means on a sample of about SAMPLE training rows, chosen by a hash of the id, in one group of
bounded size. (3) One more round over all training rows: every row goes to the nearest centroid of its language, and the
centroids become the means of their rows, with mean and deviation of the similarities. (4) Every whole text takes the
language of its nearest centroid by cosine; it is `rejected` where it lies farther from it than REJECT deviations beyond
the mean of that centroid's own rows.

Nulls: a null text, or one without a letter, is `und` with score 0; it teaches nothing, nor do rows with a null language, so a
language that only such texts have is not learned. Where no row
teaches, every text is `und`. Ties go to the language first in order. Repeated rows are predicted alike. Texts in which no
n-gram is known still get the first language, with score 0, and are rejected. Languages are assumed to be some hundreds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .text import Sums, Words, byte_values, parts
from .toxicity import LETTER, lowered

DIMENSIONS = 2048
SIZES = (1, 2, 3, 4)  # bytes of an n-gram within a word; a word's first and last n-gram count apart
CENTROIDS = 4
SAMPLE = 400
FOLDS, HELD = 4, 2
REJECT = 4.0
ROUNDING = 1e-5  # of a cosine in single precision; a text that equals its centroid is not rejected
UNKNOWN = "und"


def counted(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams: one row per text."""
    w = Words(texts, ~LETTER)
    sums, n = Sums(byte_values(w.buffer, 11), 11), len(w.buffer)
    owner = np.full(n + 1, -1, np.int32)  # the word that each byte lies in
    inside = np.repeat(np.arange(len(w.start), dtype=np.int32), w.end - w.start)
    owner[:n][LETTER[w.buffer]] = inside
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for size in SIZES:
        at = np.flatnonzero((owner[:-size] == owner[size - 1:-1]) & (owner[:-size] >= 0)) if size <= n else np.zeros(0, np.int64)
        word = owner[at]
        edge = (w.start[word] == at) + 2 * (w.end[word] == at + size)
        place = ((sums.of(at, at + size) + edge.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)).astype(np.int64)
        out += np.bincount(w.doc[word] * DIMENSIONS + place, minlength=out.size).reshape(out.shape)
    return out


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counted(texts)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def few(texts, rows: int = 512):
    """`parts`, with at most so many texts at once, as each takes a dense vector."""
    for at, run in parts(texts):
        for k in range(0, len(run), rows):
            yield at + k, run[k:k + rows]


def _frequencies(batches):
    seen, rows = np.zeros(DIMENSIONS, np.int64), 0
    for b in batches:
        for _, run in few(lowered(b.column(0).to_pylist())):
            seen += (counted(run) > 0).sum(axis=0)
            rows += len(run)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.append([rows], seen))], ["place", "n"])


def _vectors(idf):
    def run(batches):
        for b in batches:
            for at, texts in few(lowered(b.column(0).to_pylist())):
                v = vectors(texts, idf)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * DIMENSIONS, pa.int32()), pa.array(v.ravel()))],
                    ["lang", "vector"])
    return run


def clustered(rows: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means of one language's sample, started from rows far from each other."""
    x = np.stack(rows.vector.to_list())
    x = x[np.lexsort(x.T[:8])]
    centres = x.mean(axis=0, keepdims=True)
    for _ in range(min(CENTROIDS, len(x)) - 1):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(10):
        near = (x @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (near == k).any():
                c = x[near == k].sum(axis=0)
                centres[k] = c / max(np.linalg.norm(c), 1e-12)
    return pd.DataFrame({"lang": rows.lang.iloc[0], "vector": list(centres.astype(np.float32))})


def _summed(idf, langs, centres):
    """Per centroid the sum of its rows' vectors, their number, and the sums of similarities and squares."""
    names = np.array(langs, object)

    def run(batches):
        total, size, sims, squares = np.zeros(centres.shape), np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
        for b in batches:
            own = np.array(b.column(1).to_pylist(), object)
            for at, texts in few(lowered(b.column(0).to_pylist())):
                v = vectors(texts, idf)
                s = np.where(own[at:at + len(texts), None] == names[None, :], v @ centres.T, -1.0)
                k, best = s.argmax(axis=1), s.max(axis=1)
                ok = best >= 0
                np.add.at(total, k[ok], v[ok])
                size += np.bincount(k[ok], minlength=len(centres))
                sims += np.bincount(k[ok], best[ok], len(centres))
                squares += np.bincount(k[ok], best[ok] ** 2, len(centres))
        used = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(size[used]), pa.array(sims[used]), pa.array(squares[used]),
             pa.array([total[k].tolist() for k in used], pa.list_(pa.float64()))], ["k", "n", "s", "q", "total"])
    return run


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum(np.stack(rows.total.to_list()), axis=0)
    return pd.DataFrame({"k": [rows.k.iloc[0]], "n": [rows.n.sum()], "s": [rows.s.sum()], "q": [rows.q.sum()], "total": [total]})


def trained(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id"):
    """(idf, languages, centroids, least similarities), learned outside the held-out fold; no languages if no row teaches."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (fold(doc_id, FOLDS) != HELD)).select(
        F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.col(doc_id).alias("_id"))
    got = rows.select("_text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    n = got.set_index("place").n.reindex(np.arange(-1, DIMENSIONS)).fillna(0).to_numpy(float)
    idf = (np.log((1 + n[0]) / (1 + n[1:])) + 0.1).astype(np.float32)
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    sample = rows.join(F.broadcast(sizes), "_lang").where(F.pmod(F.xxhash64(F.lit("sample"), "_id", "_text"), F.col("_n")) < SAMPLE)
    own = (sample.select("_text", "_lang").mapInArrow(_vectors(idf), "lang string, vector array<float>")
           .groupBy("lang").applyInPandas(clustered, "lang string, vector array<float>").toPandas())
    if own.empty:
        return idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0)
    own = own.sort_values("lang", kind="stable").reset_index(drop=True)
    langs, centres = own.lang.to_list(), np.stack(own.vector.to_list())
    sums = (rows.select("_text", "_lang").mapInArrow(_summed(idf, langs, centres), "k long, n long, s double, q double, total array<double>")
            .groupBy("k").applyInPandas(_merged, "k long, n long, s double, q double, total array<double>").toPandas())
    centres, least = centres.copy(), np.zeros(len(langs))
    for r in sums.itertuples():
        total = np.asarray(r.total, float)
        centres[r.k] = total / max(np.linalg.norm(total), 1e-12)
        mean = r.s / r.n
        least[r.k] = mean - REJECT * np.sqrt(max(r.q / r.n - mean**2, 0))
    return idf, langs, centres, least


def _predictor(idf, langs, centres, least):
    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            lang, score, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), [True] * len(texts)
            for at, run_ in few(lowered(texts)) if langs else ():
                s = vectors(run_, idf) @ centres.T
                k, best = s.argmax(axis=1), np.clip(s.max(axis=1), 0, 1)
                for i in range(len(run_)):
                    t = texts[at + i]
                    if t and any(map(str.isalpha, t)):
                        lang[at + i], score[at + i] = langs[k[i]], best[i]
                        out[at + i] = bool(best[i] <= 0 or best[i] < least[k[i]] - ROUNDING)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang), pa.array(score), pa.array(out)],
                                             [*b.schema.names[1:], "_lang", "_score", "_rejected"])
    return run


def predicted(docs: DataFrame, model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: the id as `doc_id`, then _lang, _score, _rejected."""
    rows = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(*model), f"doc_id {kind}, _lang string, _score double, _rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, trained(docs)).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
        F.col("_rejected").alias("rejected"))


QUERIES = {"op7_language_id": (op7_language_id, None)}

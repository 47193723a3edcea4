"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the lower-case word starts and words it holds; a document's is the noisy-or of its
sentences with selected features and of one chance for the document as a whole, 1 - prod(1 - p). That chance stands for toxic
texts without any feature; sentences without features add nothing, so length alone makes no text toxic. The weights are fitted to document labels through that formula, so the model itself finds which
sentences made a document toxic, and can point at them.

Three steps. (1) Over the training rows, documents per hashed feature and label are counted; the SELECTED features that speak
most for the label stay. (2) The weights are fitted on the driver, to which only sentences with selected features are sent.
(3) Every whole text is scored where it lies. Training rows are about SAMPLE labelled documents outside the held-out fold,
chosen by a hash of the id; their ids and labels are broadcast, so no text is shuffled.

Nulls: a null text, and one without sentences, scores 0. Rows with a null label teach nothing. A repeated row is scored each
time; an id with several labels counts as toxic if any says so. Without labels the score is 0; without features that tell them apart, also where all
labels are alike, every text with a sentence takes their share. Empty tables give
no rows. Other columns are carried along by `reject`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import fold, free_name, table
from .text import Sums, Words, byte_values, parts, slices

BITS = 20  # hashed features: 2^20
PREFIXES = (4, 5, 6, 7, 8)  # bytes of a word's start that are features, beside the whole word
SELECTED = 4096
AT_ONCE = 1 << 19  # bytes of texts that a task handles at once; its arrays take some 50 times as much
LEAST_GAIN = 12.0  # log-likelihood; less is chance among a million features
SAMPLE = 50_000
PENALTY = 0.05
FOLDS, HELD = 4, 2
THRESHOLD = 0.3

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


def featured(texts: list[bytes]):
    """Of some texts: the document of every sentence, and per feature occurrence its sentence and hash."""
    w = Words(texts, ~LETTER)
    ends = SENTENCE_END[w.buffer]
    ends[w.doc_start[1:] - 1] = True
    number = np.concatenate([[0], np.cumsum(ends)])  # of the sentence that holds each byte
    sentence, doc_of = np.unique(number[w.start], return_index=True)
    doc_of = w.doc[doc_of]
    inside = np.searchsorted(sentence, number[w.start])
    sums = Sums(byte_values(w.buffer, 7), 7)
    length, at, hashes = w.end - w.start, [inside], [sums.of(w.start, w.end)]
    for k in PREFIXES:
        long = length > k
        at.append(inside[long])
        hashes.append(sums.of(w.start[long], w.start[long] + k) + np.uint64(k))
    begin = np.flatnonzero(np.diff(np.concatenate([[-1], doc_of])))
    order = np.arange(len(doc_of)) - np.repeat(begin, np.diff(np.append(begin, len(doc_of))))
    spans = (w, sentence, ends)
    return doc_of, order, np.concatenate(at), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), spans


def lowered(texts) -> list:
    return [t.lower() if t else t for t in texts]


def runs(column: pa.Array):
    """The first row of each run of texts of about AT_ONCE bytes, and those in lower case. No more of a batch is held twice."""
    for start, n in slices(column, AT_ONCE):
        for at, run in parts(lowered(column.slice(start, n).to_pylist()), AT_ONCE):
            yield start + at, run


def _counted(batches):
    """Documents per feature and label of a partition."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    rows = np.zeros(2, np.int64)
    for b in batches:
        labels = np.array(b.column(1).to_pylist(), np.int64)
        rows += np.bincount(labels, minlength=2)
        for at, run in runs(b.column(0)):
            doc_of, _, sentence, feature, _ = featured(run)
            pairs = np.unique((doc_of[sentence] << BITS) | feature)
            for y in (0, 1):
                mine = labels[at + (pairs >> BITS)] == y
                np.add.at(seen[y], pairs[mine] & ((1 << BITS) - 1), 1)
    # Feature -1 carries the number of documents. What occurs in no toxic document can't be chosen.
    found = np.flatnonzero(seen[1])
    yield pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([[-1], found])), pa.array(np.concatenate([[rows[0]], seen[0][found]]).astype(np.int64)),
        pa.array(np.concatenate([[rows[1]], seen[1][found]]).astype(np.int64))], ["feature", "clean", "toxic"])
    clean = np.flatnonzero((seen[0] > 0) & (seen[1] == 0))
    yield pa.RecordBatch.from_arrays([pa.array(clean), pa.array(seen[0][clean].astype(np.int64)), pa.array(np.zeros(len(clean), np.int64))],
                                     ["feature", "clean", "toxic"])


def chosen(rows: DataFrame, selected: int = SELECTED) -> np.ndarray:
    """The features with the largest gain in likelihood among those more frequent in toxic documents: a bounded list."""
    counts = rows.select("_text", "_label").mapInArrow(_counted, "feature long, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialise(counts.where("toxic > 0"), "features")
    n = counts.where("feature = -1").first()
    if n is None:
        return np.zeros(0, np.int64)
    share0, share1 = (F.col("clean") + 0.5) / (n.clean + 1), (F.col("toxic") + 0.5) / (n.toxic + 1)
    gain = F.col("toxic") * F.log(share1 / share0)
    best = (counts.where((F.col("feature") >= 0) & (F.col("toxic") >= 3) & (share1 > 4 * share0) & (gain > LEAST_GAIN))
            .select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(selected))
    return np.sort(np.array([r.feature for r in best.collect()], np.int64))


def _sampled(features: np.ndarray):
    def run(batches):
        for b in batches:
            for at, texts in runs(b.column(0)):
                doc_of, _, sentence, feature, _ = featured(texts)
                place = np.minimum(np.searchsorted(features, feature), max(len(features) - 1, 0))
                hit = features[place] == feature if len(features) else np.zeros(len(feature), bool)
                pairs = np.unique(sentence[hit] * np.int64(len(features) + 1) + place[hit])
                sent, place = pairs // (len(features) + 1), pairs % (len(features) + 1)
                doc, total = doc_of[sent], np.bincount(doc_of, minlength=len(texts))
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([
                    b.column(1).slice(at, len(texts)), pa.array(total),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(sent)),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(place))], ["label", "sentences", "sentence", "place"])
    return run


def fitted(rows: DataFrame, features: np.ndarray, steps: int = 400) -> tuple[float, float, np.ndarray]:
    """Bias of a document, bias of a sentence with features, and weights that maximise the likelihood of the labels under the noisy-or, with a small penalty on weights."""
    got = rows.select("_text", "_label").mapInArrow(_sampled(features), "label long, sentences long, sentence array<long>, place array<long>").toPandas()
    y = got.label.to_numpy(float)
    if got.empty or not len(features):  # nothing tells documents apart: all that have a sentence take the share of the labels
        held = y[got.sentences.to_numpy() > 0]
        return float(np.log((held.sum() + 0.5) / (len(held) - held.sum() + 0.5))) if len(held) else -700.0, -700.0, np.zeros(len(features))
    doc = np.repeat(np.arange(len(got)), got.place.map(len))
    sent = np.concatenate([*got.sentence]).astype(np.int64)
    place = np.concatenate([*got.place]).astype(np.int64)
    keys, inside = np.unique(doc * np.int64(1 << 40) + sent, return_inverse=True)
    of = keys >> 40  # the document of each sentence with features
    some = (got.sentences.to_numpy() > 0).astype(float)
    theta, m, v = np.zeros(len(features) + 2), np.zeros(len(features) + 2), np.zeros(len(features) + 2)
    theta[-2:] = -6.0
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(inside, theta[place], len(keys))
        q, q0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-2]))
        clear = np.bincount(of, np.logaddexp(0, z), len(got)) + some * np.logaddexp(0, theta[-2])  # -log(1 - p)
        p = -np.expm1(-clear)
        # d(log-likelihood)/d(clear): -(1 - y) + y (1 - p) / p
        slope = -(1 - y) + y * np.exp(-clear) / np.maximum(p, 1e-9)
        gz = slope[of] * q
        grad = np.append(np.bincount(place, gz[inside], len(features)), [(slope * some).sum() * q0, gz.sum()])
        grad[:-2] -= PENALTY * theta[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return float(theta[-2]), float(theta[-1]), theta[:-2]


def _scorer(features: np.ndarray, whole: float, bias: float, weights: np.ndarray, text_at: int, keep: int):
    """The first `keep` columns of each batch, with scores and offending sentences of the column `text_at`."""
    dense = np.zeros(1 << BITS, np.float32)
    known = np.zeros(1 << BITS, bool)

    def run(batches):
        dense[features] = weights
        known[features] = True
        for b in batches:
            score, where = np.zeros(b.num_rows), [None] * b.num_rows
            for at, run_ in runs(b.column(text_at)):
                doc_of, order, sentence, feature, _ = featured(run_)
                hit = known[feature]
                pairs = np.unique((sentence[hit] << BITS) | feature[hit])
                z = bias + np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], len(doc_of))
                z[np.bincount(pairs >> BITS, minlength=len(doc_of)) == 0] = -np.inf
                clear = np.bincount(doc_of, np.logaddexp(0, z), len(run_)) + np.logaddexp(0, whole) * (np.bincount(doc_of, minlength=len(run_)) > 0)
                score[at:at + len(run_)] = -np.expm1(-clear)
                bad = np.flatnonzero(z > np.log(THRESHOLD / (1 - THRESHOLD)))
                for d in np.unique(doc_of[bad]):
                    where[at + d] = order[bad[doc_of[bad] == d]].tolist()
            out = [b.column(i) for i in range(keep)] + [pa.array(score)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(where, pa.list_(pa.int64()))], [f"c{i}" for i in range(len(out) + 1)])
    return run


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
            sample: int = SAMPLE) -> tuple[np.ndarray, float, float, np.ndarray]:
    """The selected features, both biases and the weights, learned from labelled rows outside the held-out fold."""
    marks = (labels.where(F.col(label).isNotNull() & (fold(doc_id, FOLDS) != HELD))
             .groupBy(F.col(doc_id).alias("_id")).agg(F.max((F.col(label) > 0).cast("long")).alias("_label")))
    n = max(marks.count(), 1)
    # By hash of the id: all of them while the table holds at most `sample`, and about as many beyond, so they can be broadcast.
    few = F.broadcast(marks.where(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(n)) < sample))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(few, "_id")
    features = chosen(rows)
    return features, *fitted(rows, features)


def scored(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, then _score and _offending: the numbers, from 0, of sentences that are toxic by themselves."""
    keep = docs.columns if keep is None else keep
    names = keep if text in keep else [*keep, text]  # a text that is kept travels once
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kinds = [rows.schema[f"c{i}"].dataType.simpleString() for i in range(len(keep))]
    n = len(keep)
    schema = ", ".join([*[f"c{i} {k}" for i, k in enumerate(kinds)], f"c{n} double", f"c{n + 1} array<bigint>"])
    out = rows.mapInArrow(_scorer(*model, names.index(text), n), schema)
    score, bad = free_name(docs, "_score"), free_name(docs, "_offending")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col(f"c{n}").alias(score), F.col(f"c{n + 1}").alias(bad))


def reject(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    out = scored(docs, trained(docs, labels, text, doc_id), text)
    return out.where(F.col(free_name(docs, "_score")) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_offending").alias("offending_sentences"))


QUERIES = {"op9_toxicity": (op9_toxicity, None)}

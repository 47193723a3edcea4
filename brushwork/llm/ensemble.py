"""Quality by a sparse rule ensemble: paths of small trees over text statistics, weighed by a lasso.

Four steps. (1) Tasks turn whole texts into the STATISTICS, numbers that say nothing of language, source or id. (2) Boosted trees
of depth DEPTH are grown to the labels, and every path from a root to a node becomes a rule, a conjunction of `statistic <=
threshold` and `statistic > threshold`. (3) A logistic model with a lasso penalty weighs the rules; most weights are zero. The
penalty is chosen on a fifth of the training rows, then all of them are fitted with it. (4) The rules left are compiled into one
Spark column, the logistic function of a sum of weights, so scoring is a projection over the statistics and a model can be read.

Training rows are about SAMPLE labelled documents outside the held-out fold, chosen by a hash of the id; ids and labels are
broadcast, so no text is shuffled, and only their statistics (some 200 bytes a row) reach the driver. All other rows are scored
where they lie. All statistics are shares that a text keeps when it grows (words seen before are looked for among the last NEAR and
FAR words only), so length alone makes no text bad. Texts are read in pieces of PIECE bytes whose sums are added up, so a text
of any length takes little memory beside itself; a word or line longer than a piece counts as several, and words are not
looked for across pieces.

Nulls: a null text counts as empty, and an empty one has a score like any other (all its statistics are 0). Rows with a null
label or id teach nothing. Repeated rows teach and are scored each time; an id with several labels counts as good if all say so.
With labels of one kind, or none, the score is their smoothed share (0.5 without labels). Empty tables give no rows. Other
columns are carried along by `scored`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, free_name, table
from .text import Sums, Words, byte_values, pieces, slices

FOLDS, HELD = 3, 1
THRESHOLD = 0.5
SAMPLE = 20_000
PIECE = 1 << 20
NEAR, FAR = 10, 100  # words back
TREES, DEPTH, SHRINK, LEAST = 80, 3, 0.15, 10  # LEAST: training rows in a leaf
CUTS = 32  # thresholds tried for a statistic
STEPS = 600  # of the lasso
PENALTIES = tuple(2.0**-k for k in range(3, 13))

#: Classes of bytes.
SPACE, LOWER, UPPER, DIGIT, SYMBOL, BAR, BANG, POINT, OTHER, WIDE = range(10)
CLASS = np.full(256, OTHER, np.int64)
CLASS[128:] = WIDE
for _kind, _chars in ((SPACE, b" \t\n\v\f\r"), (LOWER, bytes(range(97, 123))), (UPPER, bytes(range(65, 91))), (DIGIT, b"0123456789"),
                      (SYMBOL, b"#*$%&<>=+~^@_\\{}[]"), (BAR, b"|"), (BANG, b"!"), (POINT, b".,;:?")):
    CLASS[[*_chars]] = _kind
ENDS = np.zeros(256, bool)
ENDS[[*b".?!:\"'"]] = True

SUMS = ("bytes", "words", "short", "long", "title", "capital", "marked", "numbered", "again", "near", "far", "lines", "ended", "copied")
STATISTICS = ("length", "words", "word_bytes", "letters", "wide", "upper", "digits", "symbols", "bars", "bangs", "points", "blanks", "others", "short", "long",
              "title", "capital", "marked", "numbered", "again", "near", "far", "line_words", "ended", "copied")


def summed(texts: list[bytes]) -> np.ndarray:
    """Counts of byte classes and SUMS per text."""
    w = Words(texts)
    n = len(texts)
    doc_of = np.repeat(np.arange(n), np.diff(w.doc_start))
    kinds = CLASS[w.buffer]
    classes = np.bincount(doc_of * 10 + kinds, minlength=10 * n).reshape(n, 10).astype(float)
    classes[:, SPACE] -= 1  # the byte that ends each text here
    size, first, last = w.end - w.start, kinds[w.start], kinds[w.end - 1]

    def within(kind: int) -> np.ndarray:
        """How many bytes of a kind each word holds."""
        return np.add.reduceat((kinds == kind).astype(np.int32), w.start) if len(w.start) else np.zeros(0, np.int64)

    per = lambda x: np.bincount(w.doc, x, n).astype(float)
    hashes = w.hashes(19)
    order = np.lexsort((hashes, w.doc))  # stable: equal words of a text stay in their order
    gap = np.full(len(size), FAR + 1)  # words since the same word in the same text
    if len(size):
        same = (hashes[order][1:] == hashes[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
        gap[order[1:]] = np.where(same, np.diff(order), FAR + 1)
    upper = within(UPPER)
    line = np.concatenate([[0], np.cumsum(w.buffer == 10)])[w.start] if len(size) else np.zeros(0, np.int64)
    fresh = np.ones(len(size), bool)
    fresh[1:] = line[1:] != line[:-1]  # the first word of each line that has one
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], len(size)) - 1 if len(begin) else begin
    whole = Sums(byte_values(w.buffer, 23), 23).of(w.start[begin], w.end[stop]) if len(begin) else np.zeros(0, np.uint64)
    owner = w.doc[begin]
    order = np.lexsort((whole, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (whole[order][1:] == whole[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    lines = lambda x=None: np.bincount(owner, x, n).astype(float)
    sums = np.stack([
        np.diff(w.doc_start) - 1.0, per(None), per(size <= 2), per(size > 20), per(first == UPPER), per((upper >= 2) & (within(LOWER) == 0)),
        per((last == SYMBOL) | (last == BAR) | (last == BANG)), per(within(DIGIT) > 0), per(gap == 1), per(gap <= NEAR), per(gap <= FAR), lines(), lines(ENDS[w.buffer[w.end[stop] - 1]]) if len(begin) else lines(),
        np.bincount(owner[order], same, n)], axis=1)
    return np.concatenate([classes, sums], axis=1)


def statistics(sums: np.ndarray) -> np.ndarray:
    c, s = sums[:, :10], dict(zip(SUMS, sums[:, 10:].T))
    share = lambda x, of: x / np.maximum(of, 1)
    letters = c[:, LOWER] + c[:, UPPER]
    words, size, lines = s["words"], s["bytes"], s["lines"]
    out = {"length": np.log1p(size), "words": np.log1p(words), "word_bytes": share(size - c[:, SPACE], words), "letters": share(letters + c[:, WIDE], size - c[:, SPACE]),
           "wide": share(c[:, WIDE], size), "upper": share(c[:, UPPER], letters), "digits": share(c[:, DIGIT], size - c[:, SPACE]), "blanks": share(c[:, SPACE], size),
           "symbols": share(c[:, SYMBOL], words), "bars": share(c[:, BAR], words), "bangs": share(c[:, BANG], words), "points": share(c[:, POINT], words),
           "others": share(c[:, OTHER], words), "line_words": np.log1p(share(words, lines)),
           "ended": share(s["ended"], lines), "copied": share(s["copied"], lines)}
    out |= {k: share(s[k], words) for k in ("short", "long", "title", "capital", "marked", "numbered", "again", "near", "far")}
    return np.stack([out[k] for k in STATISTICS], axis=1)


def measured(texts: list[bytes]) -> np.ndarray:
    """The statistics of some texts, long ones piece by piece."""
    total = np.zeros((len(texts), 10 + len(SUMS)))
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    if short:
        total[short] = summed([texts[i] for i in short])
    for i in (i for i, t in enumerate(texts) if len(t) > PIECE):
        for piece in pieces(texts[i], PIECE):
            total[i] += summed([piece])[0]
    return statistics(total)


def _measure(text_at: int, keep: list[int]):
    def run(batches):
        for b in batches:
            for at, n in slices(b.column(text_at)):
                rows = b.slice(at, n)
                found = measured([(t or "").encode("utf-8", "surrogatepass") for t in rows.column(text_at).to_pylist()])
                columns = [rows.column(k) for k in keep] + [pa.array(np.ascontiguousarray(x)) for x in found.T]
                yield pa.RecordBatch.from_arrays(columns, [*[f"c{k}" for k in range(len(keep))], *[f"s{k}" for k in range(len(STATISTICS))]])
    return run


def with_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """c0, c1, ... the columns `keep`, and s0, s1, ... the statistics. The text travels to the tasks once, also where it is kept."""
    names = keep if text in keep else [*keep, text]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kinds = [f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return rows.mapInArrow(_measure(names.index(text), [*range(len(keep))]), ", ".join(kinds + [f"s{i} double" for i in range(len(STATISTICS))]))


# --- rules ---


def grown(x: np.ndarray, y: np.ndarray, seed: int = 1) -> list[tuple]:
    """Rules, each a tuple of (statistic, threshold, is above), from the paths of boosted trees."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for v in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)  # bin k: above cut k-1, at or below cut k
    z, rules = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        open_ = [((), np.flatnonzero(rng.random(len(y)) < 0.6))]
        leaves = []
        while open_:
            path, at = open_.pop()
            best = None
            if len(path) < DEPTH and len(at) >= 2 * LEAST:
                g, h = slope[at].sum(), curve[at].sum()
                for f, c in enumerate(cuts):
                    k = len(c) + 1
                    gs, hs = (np.cumsum(np.bincount(binned[at, f], v[at], k))[:-1] for v in (slope, curve))
                    ns = np.cumsum(np.bincount(binned[at, f], minlength=k))[:-1]
                    gain = np.where((ns >= LEAST) & (len(at) - ns >= LEAST), gs**2 / (hs + 1) + (g - gs)**2 / (h - hs + 1) - g**2 / (h + 1), 0)
                    if len(gain) and gain.max() > 1e-3 and (best is None or gain.max() > best[0]):
                        best = gain.max(), f, int(gain.argmax())
            if best is None:
                leaves.append((path, at))
                continue
            _, f, k = best
            for above in (False, True):
                step = tuple(sorted({**{(a, c): b for a, b, c in path}, (f, above): _tight(path, f, above, cuts[f][k])}.items()))
                new = tuple((a, b, c) for (a, c), b in step)
                rules[new] = None
                open_.append((new, at[(binned[at, f] > k) == above]))
        for path, at in leaves:
            value = SHRINK * slope[at].sum() / (curve[at].sum() + 1)
            z += np.where(held(path, x), value, 0) if path else value
    return list(rules)


def _tight(path, f: int, above: bool, cut: float) -> float:
    own = [b for a, b, c in path if a == f and c == above]
    return float(max([cut, *own]) if above else min([cut, *own]))


def held(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, cut, above in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights, the bias first, of the logistic model of the 0/1 columns r with `penalty` times the sum of the other weights' sizes, by accelerated proximal steps."""
    n, k = r.shape
    w = np.append(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)), np.zeros(k)) if start is None else start.copy()
    v = np.ones(k)
    for _ in range(12):  # the largest eigenvalue of r'r / n bounds the step
        v = r.T @ (r @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * ((np.linalg.norm(r @ v) ** 2) / n + 1) * 1.1)
    look, t = w.copy(), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(look[0] + r @ look[1:], -500, 500)))
        new = look - step * np.append((p - y).mean(), r.T @ (p - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / after * (new - w)
        done = np.abs(new - w).max() < 1e-6
        w, t = new, after
        if done:
            break
    return w


@dataclass
class Ensemble:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple]
    weights: list[float]

    def column(self, statistic=lambda k: F.col(f"s{k}")) -> Column:
        """The score as one Spark expression over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for f, cut, above in rule:
                holds &= statistic(f) > F.lit(cut) if above else statistic(f) <= F.lit(cut)
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def table(self) -> list[tuple[float, str]]:
        """Weights and conditions in words, heaviest first."""
        text = lambda rule: " and ".join(f"{STATISTICS[f]} {'>' if above else '<='} {cut:.6g}" for f, cut, above in rule)
        return sorted(((w, text(r)) for r, w in zip(self.rules, self.weights)), key=lambda x: -abs(x[0]))


def fitted(x: np.ndarray, y: np.ndarray) -> Ensemble:
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if len(np.unique(y)) < 2:
        return Ensemble(base, [], [])
    order = np.lexsort(np.column_stack([x, y]).T[::-1])  # one result for one set of rows, in whatever order they came
    x, y = x[order], y[order]
    rules = grown(x, y)
    r = np.stack([held(rule, x) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    _, distinct = np.unique(r, axis=1, return_index=True) if rules else (None, np.zeros(0, int))
    distinct = np.sort(distinct)
    rules, r = [rules[k] for k in distinct], r[:, distinct]
    test = np.random.default_rng(2).random(len(y)) < 0.2
    best, w = (np.inf, PENALTIES[-1]), None
    if test.any() and len(np.unique(y[~test])) == 2:
        for penalty in PENALTIES:
            w = lasso(r[~test], y[~test], penalty, w)
            z = w[0] + r[test] @ w[1:]
            best = min(best, (float(np.mean(np.logaddexp(0, z) - y[test] * z)) + 1e-9, penalty))
    w = None
    for penalty in (p for p in PENALTIES if p >= best[1]):
        w = lasso(r, y, penalty, w)
    used = np.flatnonzero(np.abs(w[1:]) > 1e-6)
    return Ensemble(float(w[0]), [rules[k] for k in used], w[1:][used].tolist())


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    marks = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold(doc_id, FOLDS) != HELD))
             .groupBy(F.col(doc_id).alias("_id")).agg(F.min((F.col(label) > 0).cast("long")).alias("_label")))
    n = max(marks.count(), 1)
    # By hash of the id: all of them while the table holds at most `sample`, and about as many beyond, so they can be broadcast.
    few = F.broadcast(marks.where(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(n)) < sample))
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(few, "_id")
    got = with_statistics(rows, "_text", ["_label"]).toPandas()
    return fitted(got[[f"s{k}" for k in range(len(STATISTICS))]].to_numpy(float), got.c0.to_numpy(float))


def scored(docs: DataFrame, model: Ensemble, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, then _score."""
    keep = docs.columns if keep is None else keep
    out = with_statistics(docs, text, keep)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], model.column().alias(free_name(docs, "_score")))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op12_quality_classifier": (op12_quality_classifier, None)}

"""Near-dedup by order MinHash, verified by banded alignment.

Shingles are five consecutive words (a shorter text is one shingle). The similarity of two texts is M / (n1 + n2 - M), where n
counts distinct shingles, by first occurrence, and M is the most of them that can be aligned in text order. It never exceeds
the Jaccard similarity of the shingle sets, and equals it unless text was moved. Pairs of SIMILAR or more are linked; classes
are the connected components.

(1) Texts with equal words are one node, so copies cost a row each. (2) Every node gets SKETCHES keys: under each of as many
hash functions, the TAKEN least occurrence-labelled shingles, in text order, with the text's length class (shingle counts
of linked texts differ by a factor of 1.25 at most, so a text takes its own class and the next). A text with repeated
shingles also gets the keys of its distinct ones. Texts of at most SHORT distinct shingles get exact keys instead, and those that
can be linked to one (EXACT at most) exact keys as well: of a text with n shingles at least ceil(0.8 n) are aligned in any link, so
the TAKEN least aligned ones under one hash are among its n - ceil(0.8 n) + TAKEN least; every choice of TAKEN of these, in text
order, is a key. No pair with a text of at most SHORT shingles is missed. A longer pair at 0.8 of u shingles in all, m aligned, shares no
key with a chance of (1 - C(m, 4) / C(u, 4))^20: 6.4e-5 for 20 of 25, the most, 4.0e-5 for 40 of 50, 2.6e-5 for long texts. (3) In every
bucket, all nodes are compared with a leader, not with each other. Nodes that are then in one component need no further
comparison; where a bucket still holds several components, it goes on with FARTHER times as many leaders, which are compared
with the nodes of other components, until every such pair has been compared or ruled out: after the first round, the shingles of
the nodes of open buckets are counted, and only those that several components hold can be aligned, which bounds a pair's similarity
from above. So no link between components is lost, nothing is capped, and a bucket of copies costs about one comparison a node. (4) Components by large-star and small-star steps.

A leader that many nodes are compared with is joined as a hot key; no bucket or class is ever gathered in one task.

Nulls: a text that is null or has no word is a class of its own; a null id stands for itself. Rows with equal words are one
class, whatever their ids; the least id names it. Repeated rows count in class_size. An empty table gives no rows. Other
columns are carried by `one_of_each`.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import meet, table
from .text import Sums, Words, mixed, parts, slices

SHINGLE = 5
SIMILAR = 0.8
SKETCHES = 20
TAKEN = 4
SHORT = 16  # distinct shingles of a text whose links all have a key
EXACT = 20  # the most that a text linked to one of SHORT has
AT_ONCE = 1 << 19  # bytes of texts that a task handles at once; its arrays take some 40 times as much
FARTHER = 16  # times as many leaders in each further round; pairs ruled out by their own shingles are not compared


def _per_text(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every shingle as numbers of words, and its text. A text of fewer words than a shingle is one."""
    n = np.diff(first)
    per = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), per)
    start = np.repeat(first[:-1] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    return start, np.minimum(start + width, first[doc + 1]), doc


def labels(shingles: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many equal shingles precede each in its text."""
    key = mixed(shingles + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    return out


def sketches(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per text and hash function, a hash of the TAKEN least values in text order. `values` are in text order, `doc` ascending."""
    n = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n)])
    # About sixteen values lie below this; a text that happens to have fewer than TAKEN there is done again in whole.
    share = np.minimum(16.0 / np.maximum(n, 1), 1.0)
    limit = np.where(share >= 1, np.uint64(0xFFFFFFFFFFFFFFFF), (share * 2.0**63).astype(np.uint64) * np.uint64(2))[doc]
    out = np.zeros((n_docs, SKETCHES), np.uint64)
    for i in range(SKETCHES):
        v = (values ^ np.uint64(0xA5A5A5A5 * (i + 1))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x1000003)
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        at = np.flatnonzero(v <= limit)
        few = np.bincount(doc[at], minlength=n_docs) < np.minimum(n, TAKEN)
        if few.any():
            at = np.union1d(at, np.concatenate([np.arange(first[d], first[d + 1]) for d in np.flatnonzero(few)]))
        at = at[np.lexsort((at, v[at], doc[at]))]
        begin = np.searchsorted(doc[at], np.arange(n_docs))
        rank = np.arange(len(at)) - begin[doc[at]]
        at = np.sort(at[rank < TAKEN])  # text order again
        rank = np.arange(len(at)) - np.searchsorted(doc[at], np.arange(n_docs))[doc[at]]
        h = np.full(n_docs, i + 1, np.uint64)
        for k in range(TAKEN):
            mine = at[rank == k]
            h[doc[mine]] = mixed(h[doc[mine]] * np.uint64(0x5851F42D4C957F2D) + values[mine])
        out[:, i] = h
    return out


def exact_keys(values: np.ndarray) -> np.ndarray:
    """Keys of texts with equally many distinct values, a row each in text order: any two at SIMILAR share one."""
    n = values.shape[1]
    taken = min(TAKEN, n)
    first = n - (4 * n + 4) // 5 + taken  # 4 n / 5, rounded up, are aligned at least
    least = np.sort(np.argsort(mixed(values), axis=1, kind="stable")[:, :first], axis=1)
    values = np.take_along_axis(values, least, axis=1)
    chosen = np.array(list(combinations(range(first), taken)))
    h = np.full((len(values), len(chosen)), 0xE8AC7, np.uint64)
    for k in range(taken):
        h = mixed(h * np.uint64(0x5851F42D4C957F2D) + values[:, chosen[:, k]])
    return h


def length_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1 / SIMILAR) + 1e-9).astype(np.int64)


class Shingled:
    """Some texts as words and shingles, and 128 bits that name each text's words."""

    def __init__(self, texts: list[bytes], width: int = SHINGLE):
        self.words = Words(texts)
        self.first = self.words.first
        one, two = self.words.hashes(51), self.words.hashes(61)
        self.one = one
        a, b = self.first[:-1], self.first[1:]
        names = np.stack([Sums(one, 52).of(a, b), Sums(two, 62).of(a, b)], axis=1)
        self.names = [None if s == e else x.tobytes() for s, e, x in zip(a, b, names)]

    def codes(self) -> list[bytes]:
        """Every text's words, three bytes each."""
        raw = (self.one >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        return [raw[s:e].tobytes() for s, e in zip(self.first[:-1], self.first[1:])]

    def keys(self, width: int = SHINGLE) -> tuple[list, np.ndarray]:
        """Bucket keys per text, and how many distinct shingles it has."""
        start, end, doc = _per_text(self.first, width)
        h, n_docs = Sums(self.one, 53).of(start, end), len(self.first) - 1
        label = labels(h, doc)
        n = np.bincount(doc[label == 0], minlength=n_docs)
        marked = mixed(h + label.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        whole = sketches(marked, doc, n_docs)
        repeats = np.bincount(doc[label > 0], minlength=n_docs) > 0
        distinct = whole.copy()
        if repeats.any():
            mine = np.flatnonzero(repeats[doc] & (label == 0))
            number = np.cumsum(repeats) - 1
            distinct[repeats] = sketches(marked[mine], number[doc[mine]], int(repeats.sum()))
        c, out = length_class(n).astype(np.uint64), []
        lower, upper = (mixed(c + np.uint64(k)) for k in (1, 2))
        for d in range(n_docs):
            own = np.concatenate([whole[d], distinct[d]]) if repeats[d] else whole[d]
            out.append(None if n[d] == 0 else np.unique(np.concatenate([mixed(own + lower[d]), mixed(own + upper[d])])).view(np.int64))
        single = np.flatnonzero((label == 0) & (n[doc] <= EXACT))
        for size in np.unique(n[doc[single]]):
            mine = single[n[doc[single]] == size]
            for d, keys in zip(doc[mine[::size]].tolist(), exact_keys(marked[mine].reshape(-1, size)).view(np.int64)):
                out[d] = np.unique(keys if size <= SHORT else np.concatenate([out[d], keys]))
        return out, n


def runs(column: pa.Array):
    """The first row of each run of texts of about AT_ONCE bytes, and those. No more of a batch is held twice."""
    for start, n in slices(column, AT_ONCE):
        for at, run in parts(column.slice(start, n).to_pylist(), AT_ONCE):
            yield start + at, run


def _sketched(batches):
    for b in batches:
        for at, run in runs(b.column(0)):
            s = Shingled(run)
            keys, n = s.keys()
            yield pa.RecordBatch.from_arrays(
                [b.column(1).slice(at, len(run)), pa.array(s.names, pa.binary()), pa.array(n), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "node", "n", "keys"])


def _coded(batches):
    for b in batches:
        for _, run in runs(b.column(0)):
            s = Shingled(run)
            yield pa.RecordBatch.from_arrays([pa.array(s.names, pa.binary()), pa.array(s.codes(), pa.binary())], ["node", "codes"])


def _named(text_at: int):
    """All columns, and the names of the texts in one of them."""
    def run(batches):
        for b in batches:
            for at, texts in runs(b.column(text_at)):
                own = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(Shingled(texts).names, pa.binary())], [*b.schema.names, "_node"])
    return run


def _forest(batches):
    """The edges of a partition as trees of depth one: every node that isn't the least of its component there, and that least node."""
    root: dict[bytes, bytes] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    rows = [(x, find(x)) for x in list(root)]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()), pa.array([y for _, y in rows], pa.binary())], ["a", "b"])


def distinct_shingles(codes: bytes, width: int = SHINGLE) -> np.ndarray:
    """A text's distinct shingles in the order of their first occurrence."""
    raw = np.frombuffer(codes, np.uint8).reshape(-1, 3).astype(np.uint64)
    words = raw[:, 0] | raw[:, 1] << np.uint64(8) | raw[:, 2] << np.uint64(16)
    start, end, _ = _per_text(np.array([0, len(words)]), width)
    h = Sums(mixed(words + np.uint64(1)), 54).of(start, end)
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def _distinct(batches):
    for b in batches:
        for at, n in slices(b.column(2), AT_ONCE):
            own = b.slice(at, n)
            shingles = [distinct_shingles(x).view(np.int64) for x in own.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(shingles, pa.list_(pa.int64()))], ["node", "_root", "shingles"])


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> tuple[float, float]:
    """(similarity if it reaches `least`, else 0; Jaccard similarity) of two sequences without repeats.

    Where the similarity reaches `least`, at most (1 - least) / (1 + least) of all shingles are unaligned, so no aligned pair
    lies farther from the diagonal: the alignment is sought in that band. As shingles don't repeat, it is the longest
    increasing run of partners' places."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    jaccard = len(i) / max(total - len(i), 1)
    if jaccard < least:
        return 0.0, jaccard
    order = np.argsort(i)
    i, j = i[order], j[order]
    inside = np.abs(i - j) <= total * (1 - least) / (1 + least) + 1
    j = j[inside]
    if (np.diff(j) > 0).all():
        m = len(j)
    else:
        tails = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k:k + 1] = [x]
        m = len(tails)
    similarity = m / max(total - m, 1)
    return (similarity if similarity >= least else 0.0), jaccard


def _compared(least: float):
    def run(batches):
        last, kept = None, None
        for b in batches:
            similar, jaccard = [], []
            for x, y in zip(b.column("left").to_pylist(), b.column("right").to_pylist()):
                if x != last:
                    last, kept = x, distinct_shingles(x)
                s, t = aligned(kept, distinct_shingles(y), least)
                similar.append(s)
                jaccard.append(t)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(similar, pa.float64()), pa.array(jaccard, pa.float64())],
                                             ["a", "b", "similarity", "jaccard"])
    return run


def compared(pairs: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with their similarity and Jaccard similarity. Many pairs may share an `a`."""
    pairs = materialise(pairs, "pairs")
    total = pairs.count()
    rows = pairs.join(codes.select(F.col("node").alias("b"), F.col("codes").alias("right")), "b")
    leaders = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_pairs")).join(codes.select(F.col("node").alias("a"), F.col("codes").alias("left")), "a")
    both = meet(rows, leaders, "a", "_pairs", total).select("a", "b", "left", "right")
    out = materialise(both.mapInArrow(_compared(least), "a binary, b binary, similarity double, jaccard double"), "compared")
    discard(pairs)
    return out


def hooked(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of the components of the links met so far, from those of earlier links and the new links alone: these join
    roots, so only the graph of roots that they span is worked on."""
    if roots is None:
        return materialise(components(links), "roots")
    of = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    ends = links
    for c in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left")
    moved = materialise(components(ends.select(of("a"), of("b"))), "moved")
    low = moved.select(F.col("node").alias("root"), F.col("root").alias("_root"))
    out = roots.join(low, "root", "left").select("node", F.coalesce("_root", "root").alias("root")).unionAll(moved)
    out = materialise(out, "roots")
    discard(roots, moved)
    return out


def opened(rooted: DataFrame) -> DataFrame:
    """The rows (key, node, root, ...) of buckets that hold several components, with the bucket's size and least node."""
    open_ = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("_low"), F.max("root").alias("_high"), F.min("node").alias("_least"))
    open_ = open_.where("_low <> _high").select("key", "size", "_least")
    return materialise(rooted.join(open_, "key"), "open")


def linkable(rest: DataFrame, codes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, of, shared) of the rows (node, root) of open buckets, where a link to another component isn't ruled out; and a table to discard.

    Of a node's distinct shingles (`of`), only those that nodes of other components hold as well (`shared`) can be aligned with one
    of these, and the similarity is at most their share. Copies with many edits of their own have too few, however many they are."""
    own = rest.select("node", F.xxhash64("root").alias("_root")).distinct().join(codes, "node").select("node", "_root", "codes")
    shingles = materialise(own.mapInArrow(_distinct, "node binary, _root long, shingles array<long>"), "shingles")
    rows = shingles.select(F.xxhash64("node").alias("_id"), "_root", F.explode("shingles").alias("shingle"))
    met = rows.groupBy("shingle").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high"), F.count(F.lit(1)).alias("_n"))
    met = materialise(met.where("_low <> _high").select("shingle", "_n"), "met")
    total = shingles.agg(F.sum(F.size("shingles"))).first()[0]
    shared = meet(rows.select("_id", "shingle"), met, "shingle", "_n", total).groupBy("_id").agg(F.count(F.lit(1)).alias("shared"))
    able = shingles.select("node", F.xxhash64("node").alias("_id"), F.size("shingles").alias("of")).join(shared, "_id")
    able = materialise(able.where(F.col("shared") / F.col("of") >= least).select("node", "of", "shared"), "linkable")
    discard(met)
    return able, shingles


def links(nodes: DataFrame, codes: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Links (a, b) between nodes that share a bucket, enough of them that the components are those of all links."""
    return searched(nodes, codes, least)[0]


def searched(nodes: DataFrame, codes: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """`links`, and (node, root) of their components for all nodes that aren't roots."""
    members = nodes.select(F.explode("keys").alias("key"), "node")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).where("size > 1")
    shared = materialise(shared, "buckets")
    total = nodes.count()
    # Round one: one leader a bucket.
    lead = materialise(meet(members, shared, "key", "size", total).select("key", "node", "size", "leader"), "members")
    pairs = lead.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    found, done, roots, leaders_each = None, None, None, 1
    rest, source = lead.where("node <> leader").select("key", "node"), lead
    keys = nodes.select("node", "keys")
    while True:
        fresh = compared(pairs, codes, least)
        done = fresh.select("a", "b") if done is None else done.unionAll(fresh.select("a", "b"))
        close = fresh.where("similarity > 0").select("a", "b")
        found = close if found is None else found.unionAll(close)
        roots = hooked(roots, close)
        # Buckets that still hold several components; who has led one has been compared with all of it.
        bounds = [c for c in ("of", "shared") if c in rest.columns]
        rest = opened(rest.join(roots, "node", "left").select("key", "node", *bounds, F.coalesce("root", "node").alias("root")))
        discard(source)
        source = rest
        if not bounds and not rest.isEmpty():  # once: what later rounds could share is less
            able, shingles = linkable(rest, codes, least)
            rest = opened(rest.select("key", "node", "root").join(able, "node"))
            discard(source, shingles)
            source = rest
        if rest.isEmpty():
            return found, roots
        # About `leaders_each` by hash, and the least node always; all, once they are as many as the nodes. A node with a low
        # hash leads in all its buckets, so that few pairs come from several of them.
        leaders_each *= FARTHER
        drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
        leads = (F.col("node") == F.col("_least")) | (drawn * F.col("size") < leaders_each)
        # Each pair is compared once: in the least of the keys that both have, whichever of the two leads there. That bucket is
        # open while their roots differ, and goes on until all of its nodes have led.
        all_keys = rest.join(keys, "node")
        lead = all_keys.where(leads).select("key", F.col("node").alias("leader"), F.col("root").alias("_root"), F.col("keys").alias("_keys"),
                                            F.col("of").alias("_of"), F.col("shared").alias("_shared"))
        most = F.least("shared", "_shared")  # that can be aligned
        may = most / (F.col("of") + F.col("_of") - most) >= least
        pairs = (all_keys.join(lead, "key").where((F.col("root") != F.col("_root")) & may & (F.array_min(F.array_intersect("keys", "_keys")) == F.col("key")))
                 .select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
                 .join(done, ["a", "b"], "left_anti"))
        rest = rest.where(~leads).select("key", "node", "of", "shared")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes with an edge (a, b) that aren't roots. Large-star
    and small-star steps in turn, until nothing changes; the number of rounds grows with the logarithm of a component's size. Every
partition first replaces its edges by trees, which leaves an edge a node at most."""
    edges = edges.select("a", "b").where("a <> b").distinct()
    edges = materialise(edges.mapInArrow(_forest, "a binary, b binary").where("a <> b").distinct(), "edges")

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while True:
        total = 2 * now[0]
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = meet(both, least, "a", "_n", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        before = edges
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
        joined = meet(down, least, "a", "_n", max(now[0], 1))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialise(small, "small")
        discard(before, large)
        was, now = now, state(edges)
        if now == was:
            break
    return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """Per row: doc_id, class_id (the least id of its class), class_size, and `node`, which names the text's words."""
    own = docs.select(F.col(text).cast("string").alias("_text"), F.col(doc_id).alias("doc_id"))
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = materialise(own.mapInArrow(_sketched, f"doc_id {kind}, node binary, n long, keys array<long>"), "sketches")
    nodes = materialise(rows.where("node is not null").groupBy("node").agg(F.first("keys").alias("keys")), "nodes")
    # Only what shares a bucket is compared, so only its words are fetched, once a node.
    members = nodes.select(F.explode("keys").alias("key"), "node")
    alone = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.max("node").alias("last")).where("n > 1").select("key")
    near = members.join(alone, "key", "left_semi").select("node").distinct()
    near = materialise(near, "near")
    words = own.select("_text").mapInArrow(_coded, "node binary, codes binary").join(near, "node", "left_semi").dropDuplicates(["node"])
    codes = materialise(words, "codes")
    roots = searched(nodes.join(near, "node", "left_semi"), codes, least)[1]
    rooted = materialise(
        nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    total = rows.count()
    per_node = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    per_root = per_node.join(rooted, "node")
    sizes = per_root.groupBy("root").agg(F.min("_id").alias("class_id"), F.sum("_n").alias("class_size"), F.count(F.lit(1)).alias("_nodes"))
    by_node = meet(per_root.select("node", "root", "_n"), sizes, "root", "_nodes", total).select("node", "class_id", "class_size", "_n")
    out = meet(rows.where("node is not null").select("doc_id", "node"), by_node, "node", "_n", total).select("doc_id", "class_id", "class_size", "node")
    none = rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "node")
    return out.unionAll(none)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """The row with the least id of each class, with all its columns; every row without words."""
    keep = classes(docs, text, doc_id, least).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("node").isNotNull())
    keep = keep.groupBy("class_id").agg(F.min("node").alias("_node"))  # rows of one id and class: one of them
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    kinds = [f.dataType.simpleString() for f in own.schema.fields] + ["binary"]
    named = own.mapInArrow(_named(docs.columns.index(text)), ", ".join(f"{n} {k}" for n, k in zip([*names, "_node"], kinds)))
    i = names[docs.columns.index(doc_id)]
    kept = (named.where("_node is not null").join(keep, (named[i].eqNullSafe(keep["class_id"])) & (named["_node"] == keep["_node"]), "left_semi")
            .dropDuplicates([i, "_node"]))
    out = kept.unionAll(named.where("_node is null"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


QUERIES = {"op10_minhash_near_dedup": (op10_minhash_near_dedup, None)}

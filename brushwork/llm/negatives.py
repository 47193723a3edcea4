"""Hard-negative mining by slot-decomposed selection.

Scores are integer inner products of an anchor with all other rows. A positive's window of scores runs from `low` to `high`
of its own score, so the windows of one anchor overlap. Their upper limits cut the scores into disjoint slots, highest first:
slot j ends below limit j+1. A combiner keeps the `top` best rows of each slot, within a task and then over all tasks. The best
rows under a limit are the first of that slot and all lower ones, one after the other, so one list an anchor answers all windows.

Work is dealt as a grid: rows lie in stripes, anchors in blocks, and a cell multiplies one with the other tile by tile. Neither
grows with the input; their numbers do, and each row travels once per block of anchors. Two passes run over the grid: positives
(only rows of the anchor's label are multiplied), then slots. A cell sends on `top` rows a slot and anchor at most.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of unequal lengths are
compared as if zeros followed. Other rows are those with another id; repeated rows count each time, but an id that several
anchors share is one anchor, with the least label and vector. Ties go to the smaller id. Scores beyond a long are cut to its
ends. An anchor without positives, and a positive whose window is empty, give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, shuffle_partitions
from .common import settled, table

ANCHORS = 1 << 14  # anchors of a block
ROWS = 1 << 17  # rows of a stripe
TILE = 1 << 10  # anchors and rows multiplied at once
TILE_BYTES = 1 << 22  # of the vectors of a tile
POSITIVES, TOP = 5, 3
SCALE = 256
EVERY = 50  # ids divisible by it are anchors
INF = np.inf

BLOCK = "cell long, ids binary, labels binary, kind string, width long, vectors binary"


def components(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and the integers of those: one row each, filled up with zeros."""
    size = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    good = np.asarray(lists.is_valid()) & (np.bincount(row, ~np.isfinite(flat), len(size)) == 0)
    out = np.zeros((len(size), int(size.max(initial=0))))
    with np.errstate(invalid="ignore", over="ignore"):
        out[row, place] = np.floor(SCALE * flat)
    return good, out[good]


class Block:
    """Ids in order, labels and vectors of some rows; `more` is per row too."""

    def __init__(self, ids, labels, vectors, *more):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.more = [m[order] for m in more]
        self.high = float(np.abs(self.vectors).max(initial=0))

    @staticmethod
    def packed(ids, labels, vectors) -> tuple:
        kind = "int16" if np.abs(vectors).max(initial=0) < 1 << 15 else "float64"
        return ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), kind, vectors.shape[1], vectors.astype(kind).tobytes()

    @classmethod
    def read(cls, row: dict, *more: np.ndarray) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["width"])
        return cls(ids, np.frombuffer(row["labels"], np.int64), vectors, *more)

    def part(self, which) -> Block:
        out = object.__new__(Block)
        out.ids, out.labels, out.vectors, out.more, out.high = self.ids[which], self.labels[which], self.vectors[which], [m[which] for m in self.more], self.high
        return out

    def tiles(self) -> Iterator[tuple[np.ndarray, Block]]:
        n = max(1, min(TILE, TILE_BYTES // (8 * max(self.vectors.shape[1], 1))))
        for k in range(0, len(self.ids), n):
            at = np.arange(k, min(k + n, len(self.ids)))
            yield at, self.part(at)


def scores(a: Block, b: Block) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b, in the smallest type that holds every partial sum."""
    width = min(a.vectors.shape[1], b.vectors.shape[1])
    most = a.high * b.high * max(width, 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.longdouble
    out = a.vectors[:, :width].astype(kind) @ b.vectors[:, :width].astype(kind).T
    return out if kind is np.longdouble else out.astype(np.float64, copy=False) if most >= 1 << 24 else out


class Best:
    """The k highest scores met so far of each of n lists, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -INF, np.longdouble), np.zeros((n, k), np.int64)

    def add(self, at: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        """`found`: scores of the lists `at` with the rows `ids`, which ascend; -inf for none. It is overwritten."""
        k = self.score.shape[1]
        every, got, who = np.arange(len(at)), [], []
        for _ in range(min(k, found.shape[1])):
            best = found.argmax(axis=1)  # the first of equals
            got.append(found[every, best])
            if not (got[-1] > -INF).any():
                break
            who.append(ids[best])
            found[every, best] = -INF
        if not who:
            return
        score = np.concatenate([self.score[at], np.stack(got[:len(who)], axis=1)], axis=1)
        own = np.concatenate([self.id[at], np.stack(who, axis=1)], axis=1)
        order = np.lexsort((own, -score), axis=1)[:, :k]
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(own, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, score and id of all that is kept."""
        at, place = np.nonzero(self.score > -INF)
        score = self.score[at, place]
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        long = np.where(score >= float(high), high, np.where(score <= float(low), low, np.clip(score, low, high - 512).astype(np.int64)))
        inner = np.abs(score) < 2.0**62
        long[inner] = score[inner].astype(np.int64)
        return at, long, self.id[at, place]


def _striped(stripes: int):
    """Blocks of rows, dealt over the stripes by the number of the task and of the block in it."""
    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            n = max(1, min(TILE, TILE_BYTES // (8 * max(int(pc.max(b.column(2).value_lengths()).as_py() or 1), 1))))
            for at in range(0, b.num_rows, n):
                piece = b.slice(at, n)
                good, vectors = components(piece.column(2))
                ids, labels = (np.asarray(piece.column(i))[good] for i in (0, 1))
                if len(ids):
                    row = ((31 * part + k) % stripes, *Block.packed(ids, labels, vectors))
                    k += 1
                    yield pa.RecordBatch.from_pylist([dict(zip(("cell", "ids", "labels", "kind", "width", "vectors"), row))], schema=STRIPED)
    return run


STRIPED = pa.schema([("cell", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("width", pa.int64()), ("vectors", pa.binary())])


def _gathered(rows: pa.Table) -> pa.Table:
    """One block of anchors with their limits, of which the first is the lowest score asked for."""
    rows = rows.combine_chunks()
    lists = rows["vector"].chunk(0) if rows["vector"].num_chunks else pa.array([], rows["vector"].type)
    _, vectors = components(lists)
    ids, labels, limits = rows["id"].to_numpy(), rows["label"].to_numpy(), rows["limits"].to_pylist()
    dense = np.full((len(ids), max(map(len, limits), default=0)), np.iinfo(np.int64).min, np.int64)
    for k, x in enumerate(limits):
        dense[k, :len(x)] = x
    ids_, labels_, kind, width, data = Block.packed(ids, labels, vectors)
    return pa.table({"block": rows["block"].slice(0, 1), "ids": [ids_], "labels": [labels_], "kind": [kind], "width": [width], "vectors": [data],
                     "limits": [dense.tobytes()]})


def _cell(find):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [find(a, (Block.read(r) for r in rows.to_pylist())) for a in anchors.to_pylist()]
        return pa.table({"anchor": np.concatenate([np.zeros(0, np.int64), *[x[0] for x in out]]), "slot": np.concatenate([np.zeros(0, np.int64), *[x[1] for x in out]]),
                         "score": np.concatenate([np.zeros(0, np.int64), *[x[2] for x in out]]), "id": np.concatenate([np.zeros(0, np.int64), *[x[3] for x in out]])})
    return run


def _positives(row: dict, blocks: Iterator[Block]):
    """The best rows of each anchor's own label."""
    a = Block.read(row)
    best = Best(len(a.ids), POSITIVES)
    of = {y: np.flatnonzero(a.labels == y) for y in np.unique(a.labels)}
    for rows in blocks:
        for y in np.intersect1d(rows.labels, a.labels):
            own = rows.part(rows.labels == y)
            for at, tile in a.part(of[y]).tiles():
                s = scores(tile, own)
                s[tile.ids[:, None] == own.ids[None, :]] = -INF
                best.add(of[y][at], s, own.ids)
    at, score, who = best.rows()
    return a.ids[at], np.zeros(len(at), np.int64), score, who


def _slots(row: dict, blocks: Iterator[Block]):
    """The best rows of other labels in each slot of an anchor."""
    n = len(row["ids"]) // 8
    limits = np.frombuffer(row["limits"], np.int64).reshape(n, -1)
    a = Block.read(row, limits)
    floor, upper = a.more[0][:, 0], a.more[0][:, 1:]
    slots = upper.shape[1]
    best = [Best(n, TOP) for _ in range(slots)]
    none = np.iinfo(np.int64).min
    for rows in blocks:
        for at, tile in a.tiles():
            s = scores(tile, rows)
            s[tile.labels[:, None] == rows.labels[None, :]] = -INF
            for j in range(slots):
                high = upper[at, j].astype(s.dtype)
                low = np.maximum(floor[at], np.where(upper[at, j + 1] == none, floor[at], upper[at, j + 1] + 1) if j + 1 < slots else floor[at]).astype(s.dtype)
                inside = (s <= np.where(upper[at, j] == none, -INF, high)[:, None]) & (s >= low[:, None])
                hit = np.flatnonzero(inside.any(axis=1))
                if len(hit):
                    best[j].add(at[hit], np.where(inside[hit], s[hit], -INF), rows.ids)
    out = [(a.ids[b[0]], np.full(len(b[0]), j), b[1], b[2]) for j, b in enumerate(x.rows() for x in best)]
    return tuple(np.concatenate([np.zeros(0, np.int64), *[o[k] for o in out]]) for k in range(4))


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """Of each list the k best of all cells."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mined(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY,
          labels=None, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20)) -> DataFrame:
    """Per anchor, an id divisible by `every`, and each of its POSITIVES best rows of the same label: the TOP best rows of other
    labels whose score is from `low` to `high` of the positive's. `labels`, a function of a frame, gives the label's column."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    rows = settled(rows.where("id is not null and label is not null and vector is not null"), "vectors")
    if labels is not None:
        rows = rows.withColumn("label", labels(F.col("id"), F.col("label")).cast("long"))
    whole = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(INF)))
    anchors = materialise(rows.where((F.col("id") % every == 0) & whole).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v"))
                          .select("id", "v.label", "v.vector"), "anchors")
    partitions = shuffle_partitions(spark)
    blocks = -(-max(anchors.count(), 1) // ANCHORS)
    stripes = max(partitions, -(-rows.count() // ROWS))
    striped = materialise(rows.select("id", "label", "vector").mapInArrow(_striped(stripes), BLOCK), "blocks")
    dealt = (striped.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .withColumn("cell", F.col("cell") + F.col("block") * F.lit(stripes).cast("long")).drop("block"))

    def over(anchors: DataFrame, find) -> DataFrame:
        packed = (anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block")
                  .applyInArrow(_gathered, "block int, ids binary, labels binary, kind string, width long, vectors binary, limits binary"))
        spread = (packed.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
                  .withColumn("cell", F.col("stripe") + F.col("block") * F.lit(stripes).cast("long")).drop("stripe", "block"))
        return (dealt.repartition(partitions, "cell").groupBy("cell").cogroup(spread.repartition(partitions, "cell").groupBy("cell"))
                .applyInArrow(_cell(find), "anchor long, slot long, score long, id long"))

    none = F.array().cast("array<long>")
    positives = _first(over(anchors.withColumn("limits", none), _positives), POSITIVES, "anchor")
    s = F.col("score")

    def share(p: int, q: int, add: int):
        """score * p / q in whole numbers: rounded down with add 0, up with add q - 1."""
        rest = F.pmod(s, F.lit(q))
        return F.call_function("div", s - rest, F.lit(q)) * p + F.call_function("div", rest * p + add, F.lit(q))

    positives = materialise(positives.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                                             share(*low, low[1] - 1).alias("low"), share(*high, 0).alias("high")), "positives")
    open_ = positives.where("low <= high")
    limits = open_.groupBy("anchor").agg(F.concat(F.array(F.min("low")), F.sort_array(F.collect_set("high"), asc=False)).alias("limits"))
    asked = anchors.join(limits.withColumnRenamed("anchor", "id"), "id")
    kept = _first(over(asked, _slots), TOP, "anchor", "slot")
    ranked = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", (-s).alias("less"), "id"))).alias("ranked")).join(limits, "anchor")
    slot = F.expr("array_position(slice(limits, 2, size(limits)), high) - 1")
    suffix = F.slice(F.filter("ranked", lambda x: x["slot"] >= F.col("first")), 1, TOP)
    inside = F.filter(F.col("suffix"), lambda x: -x["less"] >= F.col("low"))
    out = open_.join(ranked, "anchor").withColumn("first", slot).withColumn("suffix", suffix)
    return (out.select("anchor", "positive_id", "positive_score", F.posexplode(inside).alias("place", "negative"))
            .select(F.col("anchor").alias("anchor_id"), "positive_id", (F.col("place") + 1).cast("int").alias("rank"),
                    F.col("negative.id").alias("negative_id"), "positive_score", (-F.col("negative.less")).alias("negative_score")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"), labels=lambda i, y: F.when(i % 7 == 0, (y + 1) % 10).otherwise(y))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.y = r.y AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {"op13_hard_negatives": (op13_hard_negatives, SQL)}

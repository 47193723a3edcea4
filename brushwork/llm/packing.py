"""Packing by column generation for the cutting-stock problem.

(1) Every text is encoded where it lies and cut into pieces: full sequences, then what remains. (2) The histogram of lengths,
in steps of UNIT tokens, of at most CAPACITY / UNIT entries, goes to the driver. There a linear program over patterns (how
many pieces of each length share a sequence) is solved by the simplex method; new patterns are priced by a knapsack dynamic
program until none helps or the bound is near. (3) Patterns are rounded down, the largest fractions up; the few pieces left over are packed first-fit,
longest first. (4) Pieces are ranked within their length, and a rank decides pattern, copy and place. Ranks are counted in
salted groups and offsets, so the most common length is no hot key.

The size of the program depends on CAPACITY / UNIT alone, and no piece or text passes through the driver.

Nulls: a null text is empty and has the end id alone; a null id ranks first. Ties in rank are broken by id, start and content,
so only equal rows can change places. Repeated rows are packed each. An empty table gives no rows. Other columns are left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .bpe import codec, public
from .common import HOT_KEYS, table

CAPACITY = 2048
UNIT = 4
END_ID = 1
SALT_ROWS = 1_000_000
GAP = 2e-4  # relative distance to the bound at which no further pattern is sought
MAX_COLUMNS = 2000


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = codec(path).ids
        for b in batches:
            row, start, crc, total, ids = [], [], [], [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                all_ids = encode(t or "") + end
                n = len(all_ids) // 4
                for s in range(0, n, capacity):
                    piece = all_ids[4 * s:4 * (s + capacity)]
                    row.append(i)
                    start.append(s)
                    total.append(n)
                    crc.append(zlib.crc32(piece))
                    ids.append(piece)
            start, total = np.array(start, np.int64), np.array(total, np.int64)
            out = [b.column(1).take(pa.array(row, pa.int64())), pa.array(start), pa.array(np.minimum(capacity, total - start)),
                   pa.array(crc, pa.int64()), pa.array(total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)
    return run


def pieces(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and `ids` if asked for: every text cut into full sequences and a rest."""
    rows = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_cut(path or public(), capacity, end_id, with_ids), schema)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, and how often it holds each."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(sizes, c, "right")
        best[c] = best[c - 1]
        if fit:
            gain = values[:fit] + best[c - sizes[:fit]]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], last[c] = gain[k], k
    used, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            used[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), used


def started(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: the greedy pattern of the longest sizes that are left, used until one of its sizes runs out, again and
    again. Later patterns hold no size that ran out, so the basis is triangular."""
    left, patterns, times = demand.astype(float), [], []
    while (live := np.flatnonzero(left > 0)).size:
        used, room = np.zeros(len(sizes)), capacity
        for k in live[::-1]:
            if sizes[k] <= room:
                used[k] = room // sizes[k]
                room -= used[k] * sizes[k]
        share = np.where(used > 0, left / np.maximum(used, 1), np.inf)
        k = int(share.argmin())
        left = np.maximum(left - share[k] * used, 0)
        left[k] = 0
        patterns.append((k, used))
        times.append(share[k])
    missing = set(range(len(sizes))) - {k for k, _ in patterns}  # ran out together with another size
    for k in sorted(missing):
        patterns.append((k, np.eye(len(sizes))[k] * (capacity // sizes[k])))
        times.append(0.0)
    return np.array([u for _, u in patterns]), np.array(times)


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used, possibly in fractions, to meet the demand with about the fewest bins."""
    patterns, x = started(sizes, demand, capacity)
    inverse = np.linalg.inv(patterns.T)  # of the basis, whose columns are the patterns
    for _ in range(MAX_COLUMNS):
        y = inverse.sum(axis=0)
        worth, column = knapsack(sizes, np.maximum(y, 0), capacity)
        if worth <= 1 + GAP:  # x.sum() / worth is a lower bound
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        patterns[r] = column
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
    return patterns.round().astype(np.int64), x


def first_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Bins for a few pieces, longest first, each into the fullest bin that takes it."""
    room, bins = np.zeros(0, np.int64), []
    for k in np.argsort(-sizes, kind="stable"):
        for _ in range(int(counts[k])):
            ok = np.flatnonzero(room >= sizes[k])
            if len(ok):
                b = int(ok[room[ok].argmin()])
            else:
                b, room = len(bins), np.append(room, capacity)
                bins.append(np.zeros(len(sizes), np.int64))
            bins[b][k] += 1
            room[b] -= sizes[k]
    return bins


def planned(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces per size, times used) for every pattern: together they hold exactly the pieces of the histogram."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    if not len(sizes):
        return []
    patterns, x = relaxed(sizes, demand.astype(float), capacity)
    left, out = demand.copy(), []
    for k in np.argsort(-x, kind="stable"):
        used = patterns[k]
        times = int(min(np.floor(x[k] + 1e-9), (left[used > 0] // used[used > 0]).min()))
        if times > 0:
            left -= times * used
            out.append((used, times))
    for k in np.argsort(-(x - np.floor(x)), kind="stable"):  # the largest fractions once more, while their pieces are left
        if (patterns[k] > 0).any() and (left >= patterns[k]).all():
            left -= patterns[k]
            out.append((patterns[k], 1))
    out += [(b, 1) for b in first_fit(sizes, left, capacity)]
    return [({int(s): int(n) for s, n in zip(sizes, used) if n}, times) for used, times in out]


def packed(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces; `cut` is read several times, so it should be a written table."""
    spark = cut.sparkSession
    sized = cut.withColumn("_size", F.ceil(F.col("length") / F.lit(unit)))
    histogram = {int(r["_size"]): r["n"] for r in sized.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity / unit
    whole = capacity // unit
    plan = planned({s: n for s, n in histogram.items() if s < whole}, whole)
    if whole in histogram:
        plan.append(({whole: 1}, histogram[whole]))
    slots, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    for held, times in plan:
        for size, n in held.items():
            slots.append((size, used[size], used[size] + n * times, sequence, n))
            used[size] += n * times
        sequence += times
    # At most (capacity / unit) patterns, each with a few sizes, and the few bins of left-over pieces.
    slots = F.broadcast(spark.createDataFrame(slots, "_size long, _from long, _to long, _sequence long, _each long"))
    total = sum(histogram.values())
    # A length that many pieces have, of which there are HOT_KEYS at most, is ranked in as many groups as it has shares.
    shares = {s: 1 + max(n // SALT_ROWS, n * HOT_KEYS // total) for s, n in histogram.items() if n * HOT_KEYS >= total or n > SALT_ROWS}
    salts = F.lit(1)
    for size, n in shares.items():
        salts = F.when(F.col("_size") == size, n).otherwise(salts)
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), salts))
    counts = salted.groupBy("_size", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_size", "_salt", (F.sum("_n").over(Window.partitionBy("_size").orderBy("_salt")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("_size", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (salted.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["_size", "_salt"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")))
    placed = (ranked.join(slots, "_size").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
              .withColumn("sequence_id", F.col("_sequence") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each")))
              .drop("_from", "_to", "_sequence", "_each", "_salt", "_before"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_size"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long"))).drop("_size", "_rank")


def pack(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
         unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and its ids if asked for."""
    return packed(materialise(pieces(docs, path, text, doc_id, capacity, with_ids=with_ids), "pieces"), capacity, unit)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": (op4_packing, None)}

"""Substring dedup: words under a 35-word window that starts anywhere else too are removed.

(1) Texts are gathered into blocks. Every block sends a sketch of its windows: one row of a count-min sketch, as the sorted
cells it hits with their counts, cut by cell range. The sketches of all blocks are added up per range, which can only
overestimate how often a window occurs, and a block is told which of its cells hold two windows or more. (2) Only the
windows in such cells send an exact 128-bit hash, again cut by range; equal hashes of all blocks are counted, and a block
is told which of its hashes occur twice or more. (3) A block marks the words under these windows and drops them.

Blocks are asked and told through shuffles, so nothing grows on the driver, nothing is broadcast, and neither a passage that
all documents share nor a large document makes a hot key: a block sends each window once, with its count. A cell costs
about a byte and a half a window; the sketch has CELLS cells a window.

Nulls: a null text has no words and stays null in the filtered rows; other columns are carried. Rows are told apart by place,
so repeated rows count as each other's copies. A text of fewer than 35 words loses nothing. An empty table gives no rows.
Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table
from .text import Sums, Words

WINDOW = 35
BLOCK_BYTES = 2 << 20


def _blocked(batches):
    """Rows gathered into compressed blocks: the table that the later passes read."""
    block = (TaskContext.get().partitionId() << 32) - 1
    for b in batches:
        sizes = np.array([len(t) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()])
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_BYTES)) + 1
        for a, z in zip([0, *cut], [*cut, b.num_rows]):
            if a < z:
                block += 1
                rows = b.slice(int(a), int(z - a))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(rows)
                body = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([body], pa.binary())], ["block", "body"])


def opened(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all()


class Windows:
    """All windows of a block's texts, which are the last column."""

    def __init__(self, rows: pa.Table, window: int):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column(rows.num_columns - 1).to_pylist()]
        self.words = Words(texts)
        first = self.words.first
        per = np.maximum(np.diff(first) - window + 1, 0)
        self.at = np.repeat(first[:-1] - (np.cumsum(per) - per), per) + np.arange(per.sum())  # first word of each window
        self.window = window

    def hashes(self, seed: int) -> np.ndarray:
        words = self.words.hashes(seed)
        return Sums(words, seed + 1).of(self.at, self.at + self.window)


def small(values: np.ndarray) -> bytes:
    """Non-negative numbers in seven bits a byte, compressed."""
    v = values.astype(np.uint64)
    if not len(v):
        return zstandard.ZstdCompressor(level=1).compress(b"")
    wide = max(1, -(-int(v.max()).bit_length() // 7))
    more = np.stack([v >> np.uint64(7 * k) for k in range(wide)], axis=1)
    keep = more > 0
    keep[:, 0] = True
    out = (more & np.uint64(127)).astype(np.uint8)
    out[:, :-1] |= (keep[:, 1:].astype(np.uint8) << 7) if wide > 1 else 0
    return zstandard.ZstdCompressor(level=1).compress(out[keep].tobytes())


def unsmall(body: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = (b & 128) == 0
    number = np.concatenate([[0], np.cumsum(last)[:-1]])
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(b)) - start[number]
    out = np.zeros(int(last.sum()), np.uint64)
    for k in range(int(place.max()) + 1):
        at = place == k
        out[number[at]] |= (b[at] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


ASK = "range long, block long, body binary"


def _batch(names, range_, block, body):
    return pa.RecordBatch.from_arrays([pa.array(range_, pa.int64()), pa.array([block] * len(range_), pa.int64()), pa.array(body, pa.binary())], names)


def cells_of(w: Windows, ranges: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each window: its range, and its place in the range."""
    h = w.hashes(21)
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64), ((h & np.uint64(0xFFFFFFFF)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def _sketched(window: int, ranges: int, width: int):
    """A block's sketch: per range the cells hit, as steps, and where a cell is hit more than once."""
    def run(batches):
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r, c = cells_of(Windows(opened(body), window), ranges, width)
                key, n = np.unique(r * width + c, return_counts=True)
                r, c = key // width, key % width
                cuts = np.searchsorted(r, np.arange(ranges + 1))
                to = np.flatnonzero(np.diff(cuts))
                # The step's lowest bit says whether the block itself hits the cell twice.
                out = [small(np.diff(c[cuts[k]:cuts[k + 1]], prepend=0) * 2 + (n[cuts[k]:cuts[k + 1]] > 1)) for k in to]
                yield _batch(["range", "block", "body"], to, block, out)
    return run


def _added(width: int):
    """Adds the sketches of a range; tells every block which of its cells hold at least two windows."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        once, twice, cells = np.zeros(width, bool), np.zeros(width, bool), []
        for body in rows.body:
            v = unsmall(body)
            c = np.cumsum(v >> 1)
            twice[c[once[c]]] = True
            twice[c[(v & 1) == 1]] = True
            once[c] = True
        out = []
        for body in rows.body:
            c = np.cumsum(unsmall(body) >> 1)
            out.append(np.packbits(twice[c]).tobytes())
        return pd.DataFrame({"range": rows.range, "block": rows.block, "body": out})
    return run


def suspects(w: Windows, told: dict[int, bytes], ranges: int, width: int) -> np.ndarray:
    """Which windows lie in cells that the merged sketch says hold two or more."""
    r, c = cells_of(w, ranges, width)
    key, back = np.unique(r * width + c, return_inverse=True)
    cuts = np.searchsorted(key // width, np.arange(ranges + 1))
    flag = np.zeros(len(key), bool)
    for k, bits in told.items():
        a, z = cuts[k], cuts[k + 1]
        flag[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a).astype(bool)
    return flag[back]


def exact_of(w: Windows, which: np.ndarray, ranges: int):
    """Two hashes of the suspect windows, sorted, each pair once, with the windows that have it."""
    at = np.flatnonzero(which)
    a, b = w.hashes(31)[at], w.hashes(41)[at]
    order = np.lexsort((b, a))
    a, b, at = a[order], b[order], at[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    a, b = a[new], b[new]
    r = ((a >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    return a, b, np.bincount(group, minlength=len(a)), group, at, np.searchsorted(r, np.arange(ranges + 1))


def _told(rows: pd.DataFrame) -> dict[int, bytes]:
    return dict(zip(rows.range, rows.body))


def _asked_exactly(window: int, ranges: int, width: int):
    def run(key, blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        w = Windows(opened(blocks.body.iloc[0]), window)
        a, b, n, _, _, cuts = exact_of(w, suspects(w, _told(told), ranges, width), ranges)
        to = np.flatnonzero(np.diff(cuts))
        body = [a[cuts[k]:cuts[k + 1]].tobytes() + b[cuts[k]:cuts[k + 1]].tobytes() + np.packbits(n[cuts[k]:cuts[k + 1]] > 1).tobytes() for k in to]
        return pd.DataFrame({"range": to, "block": np.full(len(to), key[0], np.int64), "body": body})
    return run


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """Per hash of a range, whether it occurs twice or more in all blocks together."""
    a, b, n, size = [], [], [], []
    for body in rows.body:
        k = (8 * len(body)) // 129
        while 16 * k + (k + 7) // 8 < len(body):
            k += 1
        a.append(np.frombuffer(body, np.uint64, k))
        b.append(np.frombuffer(body, np.uint64, k, 8 * k))
        n.append(np.unpackbits(np.frombuffer(body, np.uint8, offset=16 * k), count=k))
        size.append(k)
    a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n).astype(np.int64) + 1
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    many = np.bincount(group, n)[group] >= 2
    ends = np.cumsum(size)
    return pd.DataFrame({"range": rows.range, "block": rows.block, "body": [np.packbits(many[z - k:z]).tobytes() for k, z in zip(size, ends)]})


def _cleaned(window: int, ranges: int, width: int, names: list[str]):
    """A block's rows with the words under repeated windows dropped, and what the query reports."""
    def run(left: pa.Table, told: pa.Table) -> pa.Table:
        rows = opened(left.column("body")[0].as_py())
        first, second = {}, {}
        for k, step, body in zip(told.column("range").to_pylist(), told.column("step").to_pylist(), told.column("body").to_pylist()):
            (first if step == 1 else second)[k] = body
        w = Windows(rows, window)
        a, _, _, group, at, cuts = exact_of(w, suspects(w, first, ranges, width), ranges)
        many = np.zeros(len(a), bool)
        for k, bits in second.items():
            s, z = cuts[k], cuts[k + 1]
            many[s:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=z - s).astype(bool)
        n = len(w.words.start)
        cover = np.zeros(n + 1, np.int64)
        starts = w.at[at[many[group]]]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        texts, removed, digest, data = [], [], [], w.words.bytes
        given = rows.column(rows.num_columns - 1).to_pylist()
        for i, t in enumerate(given):
            s, z = w.words.first[i], w.words.first[i + 1]
            mine = np.flatnonzero(~gone[s:z]) + s
            kept = b" ".join([data[p:q] for p, q in zip(w.words.start[mine].tolist(), w.words.end[mine].tolist())])
            removed.append(int(z - s - len(mine)))
            digest.append(hashlib.sha256(kept).hexdigest())
            texts.append(t if len(mine) == z - s else kept.decode("utf-8", "surrogatepass"))
        counts = np.diff(w.words.first)
        out = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns[:-1]]
        return pa.Table.from_arrays([*out, pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names)
    return run


def substring_dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Columns c0.. for `keep`, all by default, then kept_text (the text itself where nothing was removed), n_words, n_removed,
    kept_sha256 (of the kept words joined by one space)."""
    keep = docs.columns if keep is None else keep
    own = settled(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text")))
    splits = own.rdd.getNumPartitions()
    ranges = max(8, 2 * splits)
    width = 1 << 24  # cells of a range: of some million windows of a split, one in ten shares a cell by chance
    blocks = own.mapInArrow(_blocked, "block long, body binary")
    by_block = blocks.groupBy("block")
    first = blocks.mapInArrow(_sketched(window, ranges, width), ASK).groupBy("range").applyInPandas(_added(width), ASK)
    asked = by_block.cogroup(first.groupBy("block")).applyInPandas(_asked_exactly(window, ranges, width), ASK)
    second = asked.groupBy("range").applyInPandas(_counted, ASK)
    told = first.withColumn("step", F.lit(1)).unionAll(second.withColumn("step", F.lit(2)))
    names = [*[f"c{i}" for i in range(len(keep))], "kept_text", "n_words", "n_removed", "kept_sha256"]
    kinds = [*[own.schema[f"c{i}"].dataType.simpleString() for i in range(len(keep))], "string", "long", "long", "string"]
    return by_block.cogroup(told.groupBy("block")).applyInArrow(
        _cleaned(window, ranges, width, names), ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns, the text without the words under repeated windows."""
    out = substring_dedup(docs, text, window)
    return out.select(*[(F.col("kept_text") if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("c0").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


QUERIES = {"op2_substring_dedup": (op2_substring_dedup, None)}

"""Byte-level BPE encoding and decoding by way of a table of distinct words.

A word here is what lies between two single spaces that stand between other characters, with its space in front: no
piece of the tokenizer's pattern reaches over such a space, so words encode independently.

(1) Every task splits its texts into words. A block of texts keeps the sequence of its words as numbers, and asks the bucket
of each distinct word for it. (2) A bucket is asked for all occurrences of its words, encodes each distinct word once, and
answers every block. (3) A block joins the ids to its sequence by position. Numbers, distinct words of blocks, and their ids
are all that is shuffled; frequent words are sent once a block, so no word is a hot key. Decoding joins ids to pieces
through a table that the vocabulary bounds.

The merges themselves are run by tiktoken on the ranks of the given tokenizer file, which gives the ids of the tokenizers
library (tested) several times faster. Runs of over LONG blanks, at which its pattern would backtrack without end, are cut by the
pattern's rule beforehand: all but the last blank are one piece, and at the end of a text all are.

Nulls: a null text is empty and has no ids; other columns, null or not, are carried. Rows are told apart by place, so repeated
rows and ids are fine. An empty table gives no rows. A special token's string in a text becomes its id.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, settled, table
from .text import parts

BLOCK_BYTES = 8 << 20
PLACED_WORDS = 1 << 17
CACHED_WORDS = 200_000  # a worker's bound
VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the pattern of byte-level BPE that cuts text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: the characters that the pattern's \\s stands for.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 1000
LONG_BLANKS = re.compile(f"[{BLANKS}]{{{LONG},}}")

LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
TWO_SPACES = re.compile(r"\s\s")


def words(text: str) -> list[str]:
    """The text cut at single spaces between other characters; the spaces are left out."""
    if not text:
        return []
    if text[0].isspace() or text[-1].isspace() or TWO_SPACES.search(text):
        return LONE_SPACE.split(text)
    return text.split(" ")


class Cache(dict):
    """Ids, as little-endian 32-bit numbers, by word; filled up to a bound."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(self.before + word), "<u4").tobytes()
        if len(self) < CACHED_WORDS and len(word) < 64:
            self[word] = ids
        return ids


class Codec:
    """A byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path} is not plain byte-level BPE")
        # The alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the others for 256 and up.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.first, self.later = Cache(self.encode, ""), Cache(self.encode, " ")
        self.added = added
        self.pieces = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for piece, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.pieces[i] = piece

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG or not LONG_BLANKS.search(text):
            return self.encoding.encode(text, allowed_special="all")
        out: list[int] = []
        marks = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        for part in re.split(f"({marks})", text) if marks else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            at = 0
            for run in LONG_BLANKS.finditer(part):
                stop = run.end() if run.end() == len(part) else run.end() - 1
                out += self.encoding.encode(part[at:run.start()], allowed_special="all")
                out += self.encoding._encode_single_piece(part[run.start():stop])
                at = stop
            out += self.encoding.encode(part[at:], allowed_special="all")
        return out

    def ids(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit numbers."""
        w = words(text)
        return self.first[w[0]] + b"".join(map(self.later.__getitem__, w[1:])) if w else b""


def codec(path: str) -> Codec:
    """One codec a worker process and file."""
    from tiktoken import registry

    key = f"brushwork {path}"
    if key not in registry.ENCODINGS:
        registry.ENCODINGS[key] = Codec(path)
    return registry.ENCODINGS[key]


def public(name: str = VOCABULARY) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pressed(*arrays) -> bytes:
    """Arrays of numbers, or bytes, as one compressed value."""
    flat = [a if isinstance(a, bytes) else np.ascontiguousarray(a, "<i4").tobytes() for a in arrays]
    head = np.array([len(flat), *map(len, flat)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(flat))


def unpressed(value: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    cuts = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n, 8))])
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def numbers(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<i4")


ROW = "bucket long, block long, body binary"
WORDS_KIND, ROWS_KIND = 0, 1


def _rows(bucket, block, body) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(body, pa.binary())],
        ["bucket", "block", "body"])


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers below 256^width, first all low bytes, then the next ones: what repeats is side by side."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def unplaned(value: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(value, np.uint8).reshape(width, -1)
    return sum(raw[k].astype(np.int64) << (8 * k) for k in range(width))


def _asked(buckets: int, kind: int):
    """Blocks of texts. WORDS_KIND: for every bucket the block's distinct words there. ROWS_KIND: for the block itself its rows
    and the sequence of its words, by rank of frequency. Both number words alike."""
    def run(batches):
        block = (TaskContext.get().partitionId() << 32) - 1
        for b in batches:
            own = b.select(b.schema.names[:-1])
            for at, run_ in parts(b.column(b.num_columns - 1).to_pylist(), BLOCK_BYTES):
                block += 1
                first, later, codes, sizes = {}, {}, [], []
                for t in run_:
                    w = words(t.decode("utf-8", "surrogatepass"))
                    sizes.append(len(w))
                    if w:
                        codes.append(-1 - first.setdefault(w[0], len(first)))
                        codes += [later.setdefault(x, len(later)) for x in w[1:]]
                codes = np.array(codes, np.int64)
                codes[codes < 0] = len(later) - 1 - codes[codes < 0]
                texts = [(" " + w).encode() for w in later] + [w.encode() for w in first]
                by_rank = np.argsort(-np.bincount(codes, minlength=len(texts)), kind="stable")
                rank = np.empty(len(texts), np.int64)
                rank[by_rank] = np.arange(len(texts))
                texts = [texts[i] for i in by_rank.tolist()]
                goal = np.fromiter((zlib.crc32(t) % buckets for t in texts), np.int64, len(texts))
                if kind == ROWS_KIND:
                    kept = own.slice(at, len(run_))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, kept.schema) as out:
                        out.write_batch(kept)
                    yield _rows([0], [block], [pressed(np.array(sizes), sink.getvalue().to_pybytes(), planes(rank[codes], 4), planes(goal, 4))])
                    continue
                body, to = [], []
                by_goal = np.argsort(goal, kind="stable")
                cuts = np.searchsorted(goal[by_goal], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    mine = [texts[i] for i in by_goal[cuts[k]:cuts[k + 1]].tolist()]
                    body.append(pressed(planes(np.fromiter(map(len, mine), np.int64, len(mine)), 4), b"".join(mine)))
                    to.append(int(k))
                yield _rows(to, [block] * len(to), body)
    return run


def _answered(path: str):
    """A bucket's distinct words are encoded once; every block that asked gets its words' ids."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        encode, known, out = codec(path).encode, {}, []
        for r in rows.itertuples():
            sizes, text = unpressed(r.body)
            ends = np.cumsum(unplaned(sizes, 4))
            ids, lengths = [], []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                w = text[a:b]
                if w not in known:
                    known[w] = encode(w.decode())
                ids += known[w]
                lengths.append(len(known[w]))
            out.append(pressed(planes(np.array(lengths, np.int64), 4), planes(np.array(ids, np.int64), 4)))
        return pd.DataFrame({"bucket": rows.bucket, "block": rows.block, "body": out})
    return run


def _placed():
    """A block's ids in the order of its words."""
    def run(answers: pa.Table, rows: pa.Table) -> pa.Table:
        bucket, body = answers.column("bucket").to_pylist(), answers.column("body")
        sizes, own, sequence, goal = unpressed(rows.column("body")[0].as_py())
        sizes, sequence, goal = numbers(sizes).astype(np.int64), unplaned(sequence, 4), unplaned(goal, 4)
        length, source, flat, used = np.zeros(len(goal), np.int64), np.zeros(len(goal), np.int64), [], 0
        for i, k in enumerate(bucket):
            n, ids = (unplaned(x, 4) for x in unpressed(body[i].as_py()))
            mine = np.flatnonzero(goal == k)
            length[mine], source[mine] = n, used + np.cumsum(n) - n
            flat.append(ids.astype(np.int32))
            used += len(ids)
        flat = np.concatenate([*flat, np.zeros(0, np.int32)])
        n = length[sequence]
        ends = np.cumsum(n)
        out = np.empty(int(n.sum()), np.int32)
        for a in range(0, len(sequence), PLACED_WORDS):  # in runs, as the numbers of ids take more room than ids
            z = min(a + PLACED_WORDS, len(sequence))
            some, begin = n[a:z], ends[a] - n[a]
            out[begin:ends[z - 1]] = flat[np.repeat(source[sequence[a:z]] - (ends[a:z] - some - begin), some) + np.arange(ends[z - 1] - begin)]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        got = pa.ipc.open_stream(own).read_all().combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(out, pa.int32()))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns]
        return pa.Table.from_arrays([*columns, lists], [f"c{i}" for i in range(got.num_columns + 1)])
    return run


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, all by default, and `ids`."""
    keep = docs.columns if keep is None else keep
    path = path or public()
    docs = settled(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text")))
    # One piece per block and bucket: twice as many buckets as input splits keeps both sides about as large as a split.
    buckets = max(8, 2 * docs.rdd.getNumPartitions())
    # The texts are split twice, so that what a block keeps is shuffled once.
    answered = docs.mapInArrow(_asked(buckets, WORDS_KIND), ROW).groupBy("bucket").applyInPandas(_answered(path), ROW)
    own = docs.mapInArrow(_asked(buckets, ROWS_KIND), ROW)  # blocks are numbered by split and place, so both passes agree
    n = len(keep)
    schema = ", ".join([*[f"c{i} {docs.schema[f'c{i}'].dataType.simpleString()}" for i in range(n)], f"c{n} array<int>"])
    out = answered.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_placed(), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col(f"c{n}").alias(free_name(docs.select(*[F.lit(0).alias(c) for c in keep]), "ids")))


def _joined(path: str):
    def run(batches):
        piece = codec(path).pieces.__getitem__
        for b in batches:
            lists = b.column(b.num_columns - 1)
            ids, ends = lists.flatten().to_numpy(), np.cumsum(np.array([n or 0 for n in pa.compute.list_value_length(lists).to_pylist()], np.int64))
            texts = [b"".join(map(piece, ids[a:z].tolist())).decode("utf-8", "replace") if ok else None
                     for a, z, ok in zip([0, *ends[:-1].tolist()], ends.tolist(), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], b.schema.names[:-1] + ["decoded"])
    return run


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, and `decoded`: the pieces of the ids, side by side. The table of pieces is as large as the vocabulary."""
    keep = rows.columns if keep is None else keep
    own = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(ids).alias("_ids"))
    schema = ", ".join([*[f"c{i} {own.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))], "decoded string"])
    return own.mapInArrow(_joined(path or public()), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "decoded")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    out = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                     F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    return (decode(out, keep=["doc_id", "n_tokens", "ids_sha256"])
            .select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")))


QUERIES = {"op6_bpe": (op6_bpe, None)}

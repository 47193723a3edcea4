"""Exact dedup: two passes over a Bloom filter of text hashes, in DataFrame functions only.

Pass one counts, up to two, the filter's cells that the hashes fall into; the cells hit twice are packed into bitmaps. Pass
two looks every row up: a row with a cell that nobody else hit is alone and passes straight through. Only the others
shuffle, and are grouped by the SHA-256 of their text, so false positives of the filter cost time, never results.

The filter has about sixteen cells a row and at most 2^29 (64 MB of bitmaps), which bounds what is broadcast. Past some
thirty million rows it gets fuller and lets more single rows through to the grouping; results stay the same.

Nulls: a null text is empty; a null doc_id comes after every other id. Rows equal in text and id: one of them stays.
Empty texts are equal to each other. An empty table gives no rows. Other columns, of whatever name, are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import SPACE, meet, table

CELLS_A_ROW = 16
MAX_CELLS = 1 << 29
BITMAP = 15  # bits of a cell number within one bitmap of 4 KB


def normalised(text: str | Column) -> Column:
    """White space of any length as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, " ")


def cells(rows: int) -> int:
    return min(MAX_CELLS, 1 << max(BITMAP, (CELLS_A_ROW * max(rows, 1)).bit_length()))


def _places(digest: str, n: int) -> list[Column]:
    """The two cells of a hash."""
    return [F.pmod(F.xxhash64(F.lit(i), F.col(digest)), F.lit(n)) for i in (1, 2)]


def repeated_cells(rows: DataFrame, digest: str, n: int) -> DataFrame:
    """Pass one: bitmaps of the cells hit at least twice, as (_part, _bits)."""
    hits = rows.select(F.explode(F.array(*_places(digest, n))).alias("_cell")).groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    return (hits.where(F.col("_n") >= 2)
            .groupBy(F.shiftright("_cell", BITMAP).alias("_part"))
            .agg(F.bitmap_construct_agg(F.col("_cell").bitwiseAND((1 << BITMAP) - 1)).alias("_bits")))


def maybe_repeated(rows: DataFrame, digest: str, filter_: DataFrame, n: int, name: str) -> DataFrame:
    """Pass two: adds whether both cells of each hash were hit at least twice. The bitmaps are bounded by MAX_CELLS bits."""
    out = rows
    for i, place in enumerate(_places(digest, n)):
        bits = F.broadcast(filter_.select(F.col("_part").alias(f"_part{i}"), F.col("_bits").alias(f"_bits{i}")))
        out = out.withColumn(f"_cell{i}", place).withColumn(f"_part{i}", F.shiftright(f"_cell{i}", BITMAP)).join(bits, f"_part{i}", "left")
    hit = F.lit(True)
    for i in (0, 1):
        at = F.col(f"_cell{i}").bitwiseAND((1 << BITMAP) - 1)
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = hit & F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias(name))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, keep_id (the least id among equal texts), group_size, kept (true once in a group), text_sha256."""
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(text), 256).alias("text_sha256")), "digests")
    total = rows.count()
    n = cells(total)
    seen = materialise(repeated_cells(rows, "text_sha256", n), "bloom")
    flagged = maybe_repeated(rows, "text_sha256", seen, n, "_maybe")
    alone = flagged.where(~F.col("_maybe")).select(
        "text_sha256", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("_same"))
    # Rows equal in text and id count as one here, so that exactly one of them stays below.
    ids = flagged.where("_maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("_same"))
    sizes = ids.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("_same").alias("group_size"), F.count(F.lit(1)).alias("_ids"))
    shared = meet(ids, sizes, "text_sha256", "_ids", total).select("text_sha256", "doc_id", "keep_id", "group_size", "_same")
    out = alone.unionAll(shared)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same"))).alias("_copy")
    return out.select("*", copy).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the least id. Rows that the filter knows to be
    alone are not shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("tie"))
    hashed = docs.select(row, order.alias("order"), F.sha2(normalised(text), 256).alias("digest"))
    digests = materialise(hashed.select("digest"), "digests")
    n = cells(digests.count())
    seen = materialise(repeated_cells(digests, "digest", n), "bloom")
    flagged = maybe_repeated(hashed, "digest", seen, n, "maybe")
    first = flagged.where("maybe").groupBy("digest").agg(F.min_by("row", "order").alias("row"))
    out = flagged.where("not maybe").select("row").unionAll(first.select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)"""),
}

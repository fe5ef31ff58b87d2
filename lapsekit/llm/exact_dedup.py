"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts the filter slots that the text hashes hit and keeps those hit twice as bitmaps. Pass 2 tests every
row against the bitmaps: rows that can't have a copy pass straight through, the others are grouped by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapsekit.llm.common import LOWER, UPPER, cut_table, salted_lookup, with_unique_ids

HASHES = 2
#: The filter has 16 slots a row, and at most this many: 2^27 bits are 16 MB, which bounds what is broadcast.
#: With more rows than that serves, more unique rows count as possible copies and are grouped; results are the same.
MAX_SLOTS = 1 << 27
PAGE = 1 << 15  # bits in a page of bitmap_construct_agg


def _slots(n_rows: int) -> int:
    return max(PAGE, min(MAX_SLOTS, 1 << max(0, (16 * n_rows - 1).bit_length())))


def repeated_pages(digests: DataFrame, slots: int) -> DataFrame:
    """Pass 1: pages (page, bits) of the Bloom filter of slots that were hit more than once."""
    slot = F.explode(F.array(*[F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(slots)) for i in range(HASHES)]))
    hit = digests.select(slot.alias("slot")).groupBy("slot").count().filter("count > 1")
    return hit.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def mark_possible(digests: DataFrame, pages: DataFrame, slots: int) -> DataFrame:
    """Pass 2: column ``possible``, false only for rows whose digest occurs once."""
    out, possible = digests, F.lit(True)
    for i in range(HASHES):
        slot = F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(slots))
        out = out.withColumn(f"_slot{i}", slot).withColumn(f"_page{i}", F.bitmap_bucket_number(F.col(f"_slot{i}")))
        out = out.join(F.broadcast(pages.select(F.col("page").alias(f"_page{i}"), F.col("bits").alias(f"_bits{i}"))),
                       f"_page{i}", "left")
        at = F.bitmap_bit_position(F.col(f"_slot{i}"))
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10)
        bit = F.getbit(byte.cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1
        possible = possible & F.coalesce(bit, F.lit(False))
    return out.select(*digests.columns, possible.alias("possible"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text equals the empty one. The row with the
    largest id stays (a null id counts as the smallest; rows that share an id are separate, and of equal texts
    among them one stays). An empty table gives an empty result; other columns are ignored.
    """
    rows = with_unique_ids(docs, id_col, text_col)
    norm = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    digests = cut_table(rows.select("_id", "doc_id", F.unhex(F.sha2(norm, 256)).alias("digest")))
    slots = _slots(digests.count())
    marked = mark_possible(digests, cut_table(repeated_pages(digests, slots)), slots)
    alone = marked.filter(~F.col("possible")).select(
        "_id", "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.col("_id").alias("_keep"),
        F.lit(1).cast("long").alias("group_size"))
    some = marked.filter("possible").select("_id", "doc_id", "digest")
    groups = some.groupBy("digest").agg(F.max(F.struct("_id", "doc_id")).alias("last"),
                                        F.count("*").alias("group_size"))
    found = salted_lookup(some, groups, ["digest"], "_id").select(
        "_id", "doc_id", "digest", F.col("last.doc_id").alias("keep_id"), F.col("last._id").alias("_keep"), "group_size")
    return alone.unionByName(found).select(
        "doc_id", "keep_id", "group_size", (F.col("_id") == F.col("_keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))

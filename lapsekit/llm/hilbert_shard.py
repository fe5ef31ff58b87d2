"""Sharding along a Hilbert curve over quantised metadata, so that shards cover small boxes of every dimension."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lapsekit.llm.common import cut_table, global_rank, salted_lookup, with_unique_ids

BITS = 8  # a dimension has 2^8 cells


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``cells`` (n x d whole numbers below 2^bits).

    The coordinates are turned into the transposed index in place, from the highest bit to the lowest: invert or
    exchange the lower bits that the curve mirrors, Gray-encode, then interleave the bits.
    """
    x = [np.ascontiguousarray(cells[:, i]).astype(np.int64) for i in range(cells.shape[1])]
    d, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[i]
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()], axis=1)))


def _category(name: str) -> Column:
    """Cell of a category: 8 bits of its hash, so cells don't depend on which categories a table holds."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(1 << BITS)).cast("int")


def hilbert_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                   categories: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Cut the documents, in curve order, into ``n_shards`` runs whose counts are at most one apart (law ``rows``).

    The dimensions are the two categories and the logarithm of the size. Equal texts take the metadata of their
    smallest id and sort side by side, so a group is split only where a cut meets it. Returns doc_id, size,
    text_crc32, law, shard, slot, grown_shard (null: only the law ``key`` has one) and curve_index. A null text has
    no bytes and the checksum of the empty one, null categories are a cell of their own, null or shared ids are
    separate rows, and with fewer rows than shards some shards stay empty.
    """
    plain = docs.select(id_col, text_col, *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(categories)])
    rows = with_unique_ids(plain, id_col, text_col, carry=True).select(
        "_id", "doc_id", "text", F.col("_row._c0").alias("_c0"), F.col("_row._c1").alias("_c1"))
    body = F.coalesce("text", F.lit(""))
    small = cut_table(rows.select(
        "_id", "doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("_hash"), _category("_c0").alias("_a"), _category("_c1").alias("_b")))
    first = small.groupBy("_hash", "text_crc32", "size").agg(F.min(F.struct("_id", "_a", "_b")).alias("_first"))
    placed = salted_lookup(small.drop("_a", "_b"), first, ["_hash", "text_crc32", "size"], "_id")
    cell = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2("size") * 8)).cast("int")
    curve = placed.withColumn("curve_index", _curve("_first._a", "_first._b", cell)).drop("_first")
    order = [F.col(c) for c in ("curve_index", "_hash", "text_crc32", "_id")]
    ranked = global_rank(curve, order)
    n = small.count()
    shard = F.expr(f"(rank * {n_shards}) div {max(n, 1)}")
    first_rank = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return (ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first_rank)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "curve_index"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as one folder a shard, in slot order, for readers that prune by shard or by statistics.

    Rows with a null or shared id are told apart by size and checksum, and equal ones by number, so each row is
    written once."""
    own = ["_doc_id", "_size", "_crc"]
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{id_col}`").cast("long").alias("_doc_id"),
                       (F.octet_length(body) + 16).cast("long").alias("_size"), F.crc32(body).alias("_crc"),
                       F.to_json(F.struct(*rest)).alias("_order"))
    left = left.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy("_order"))).drop("_order")
    right = shards.select(F.col("doc_id").alias("_doc_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"),
                          "shard", "slot")
    right = right.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy("shard", "slot")))
    same = [left[c].eqNullSafe(right[c]) for c in [*own, "_n"]]
    (left.join(right, same).select("_row.*", "shard", "slot")
     .repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))

"""SimHash near-dedup with multi-index hashing over distinct fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lapsekit.llm.common import buffers, cut_table, salted_lookup, with_unique_ids

SEED = 42
HALF = 32
DOCS = 2000  # documents that a Python worker gets at a time


def simhash(text: bytes, words: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half the hashes of the word shingles."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_udf(words: int):
    @F.arrow_udf("long")
    def fingerprint(text: pa.Array) -> pa.Array:
        data, offsets = buffers(text)
        return pa.array([simhash(data[offsets[i]:offsets[i + 1]].tobytes(), words) for i in range(len(text))], pa.int64())

    return fingerprint


def _half(i: int):
    return F.shiftrightunsigned("fp", HALF) if i else F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))


def links(fingerprints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) that differ in 1 to ``max_bits`` bits, for components.

    A pair within three bits differs in at most one bit of one 32-bit half, so that half of one lies in the ball of
    radius one around the other's. Of two halves at distance one, the one with evenly many bits set looks up the
    other. Matches are verified on all 64 bits. Pairs that ``chains`` has put together already are left out.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with balls of radius one serve at most 3 bits")
    known = cut_table(chains(fingerprints, max_bits))
    label = cut_table(components(known))
    nodes = cut_table(fingerprints.join(label, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("pre")))
    half = F.array(*[F.struct(F.lit(i).alias("side"), _half(i).alias("value")) for i in (0, 1)])
    table = nodes.select("fp", "pre", F.explode(half).alias("h")).select("fp", "pre", "h.side", "h.value")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(HALF)])
    even = F.bit_count("value") % 2 == 0
    ball = F.when(even, F.transform(flips, lambda m: F.col("value").bitwiseXOR(m))).otherwise(F.array("value"))
    probes = table.select(F.col("fp").alias("a"), F.col("pre").alias("pre_a"), "side", F.explode(ball).alias("value"))
    right = table.select(F.col("fp").alias("b"), F.col("pre").alias("pre_b"), F.col("side"), F.col("value"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    found = probes.join(right, ["side", "value"]).filter(apart & (F.col("pre_a") != F.col("pre_b"))).select("a", "b")
    return known.unionByName(found)


def chains(fingerprints: DataFrame, max_bits: int) -> DataFrame:
    """Links between neighbours when fingerprints that share a half are sorted by the other: each has two at most.

    They join the bulk of a dense group without listing its pairs; the balls find all links that are missing.
    """
    from pyspark.sql import Window

    out = None
    for i in (0, 1):
        at = Window.partitionBy(_half(i)).orderBy("fp")
        near = fingerprints.select(F.col("fp").alias("a"), F.lag("fp").over(at).alias("b"))
        near = near.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        out = near if out is None else out.unionByName(near)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with the smallest node reachable from it.

    Alternates large-star and small-star steps; each writes its edges to the shared folder. A star's centre is
    pre-aggregated before the shuffle and looked up over several tasks.
    """
    now = cut_table(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = salted_lookup(both, least, ["u"], "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_table(large.filter("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_lookup(large, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        now = cut_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                  max_bits: int = 3) -> DataFrame:
    """Per document: _id, doc_id, fp (signed), fingerprint (16 hex digits), component_id, keeper (its ``_id``).

    Documents link when their fingerprints differ in at most ``max_bits`` bits; component_id is the smallest doc_id
    reachable. Texts without words (null or empty ones too) have fingerprint zero and link like any other. A null
    id counts as the smallest, rows that share an id are separate; an empty table gives an empty result.
    """
    rows = with_unique_ids(docs, id_col, text_col)
    marked = cut_table(rows.select("_id", "doc_id", fingerprint_udf(words)("text").alias("fp")), DOCS)
    classes = cut_table(marked.groupBy("fp").agg(F.min(F.struct("_id", "doc_id")).alias("first")))
    joined = components(links(classes.select("fp"), max_bits))
    named = classes.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    table = salted_lookup(named.select("fp", "component"), smallest, ["component"], "fp").select("fp", "least")
    return salted_lookup(marked, table, ["fp"], "_id").select(
        "_id", "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"), F.col("least._id").alias("keeper"))

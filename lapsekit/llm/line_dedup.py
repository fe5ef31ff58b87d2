"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

The state is three tables. ``postings`` has a row for every (line key, document); ``counts`` is the exact reference
count and the owner (largest document) of each key; ``filters`` holds, for each shard of the key space, a cuckoo
filter of the keys in at least ``min_docs`` documents. Lines are first tested against their shard's filter; only
those that it may hold meet the exact counts. Inserting or deleting documents touches only their keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lapsekit.llm.common import buffers, cut_table, release, releasing, salted_lookup, with_unique_ids
from lapsekit.operators.ordering import small

SPACES = b" \t\n\x0b\x0c\r"
#: Line rows a shard serves; the number of shards follows the table.
SHARD_ROWS = 1 << 17
#: Groups that share the lines of a shard; one with more lines than ``SHARD_ROWS``, as a line found everywhere makes it, gets
#: more of them, so no group is larger.
SALTS = 4
DOCS = 500  # documents that a Python worker gets at a time


class CuckooFilter:
    """Cuckoo filter of 64-bit hashes with 16-bit fingerprints, four to a bucket; it doubles when it is full."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of each key."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        mark = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (keys & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return (bucket ^ (np.asarray(mark).astype(np.int64) * 0x5BD1E995)) & (len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._at(keys)
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a fingerprint found no place; the filter is then to be built anew with more buckets."""
        rng = np.random.default_rng(len(keys))
        for mark, first, second in zip(*(x.tolist() for x in self._at(keys))):
            bucket = first if (self.table[first] == 0).any() else second
            for _ in range(self.KICKS):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
                slot = int(rng.integers(self.SLOTS))
                mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
                bucket = int(self._other(bucket, mark))
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint of each key; the keys must be in the filter."""
        for mark, first, second in zip(*(x.tolist() for x in self._at(keys))):
            for bucket in (first, second):
                slots = np.flatnonzero(self.table[bucket] == mark)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 64
        while buckets * cls.SLOTS * 0.8 < len(keys):
            buckets *= 2
        while not (made := cls(buckets)).insert(keys):
            buckets *= 2
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], np.ndarray]:
    """Lines of a text, and the 128-bit hash of each line's key as two signed words (0, 0 if the key is too short)."""
    lines = text.split(b"\n")
    digests = []
    for line in lines:
        key = line.strip(SPACES).lower()
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            digests.append(bytes(16))
        else:
            digests.append(xxhash.xxh3_128_digest(key))
    return lines, np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _postings(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            keys, at = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
            for i in range(len(offsets) - 1):
                own = line_keys(data[offsets[i]:offsets[i + 1]].tobytes(), min_chars)[1]
                own = own[own.any(axis=1)]
                if len(own) > 1:
                    own = np.unique(own, axis=0)
                keys.append(own)
                at.append(np.full(len(own), i))
            keys = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])),
                 batch.column(0).take(pa.array(np.concatenate(at)))], names=["h1", "h2", "_id"])

    return releasing(run)


def postings(rows: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, _id): each key of at least ``min_chars`` code points once per document. rows: _id, text."""
    return rows.select("_id", "text").mapInArrow(_postings(min_chars), "h1 long, h2 long, _id long")


def _count(of: DataFrame) -> DataFrame:
    return of.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.max("_id").alias("owner"))


def _shard(shards: int):
    return F.pmod(F.col("h2"), F.lit(shards)).cast("int")


@dataclass
class LineState:
    """postings (h1, h2, _id), counts (h1, h2, refs, owner), filters (shard, filter) and their parameters."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int
    min_docs: int


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(pdf["h1"].to_numpy()).to_bytes()]})


def _filters(hot: DataFrame, shards: int) -> DataFrame:
    return hot.select(_shard(shards).alias("shard"), "h1").groupBy("shard").applyInPandas(_build, "shard int, filter binary")


def build_state(rows: DataFrame, min_chars: int = 40, min_docs: int = 5) -> LineState:
    """State of all documents in ``rows`` (_id, text)."""
    post = cut_table(postings(rows, min_chars), DOCS)
    shards = max(1, -(-post.count() // SHARD_ROWS))
    counts = cut_table(_count(post))
    return LineState(post, counts, cut_table(_filters(counts.filter(F.col("refs") >= min_docs), shards)),
                     shards, min_chars, min_docs)


def _revise(key: tuple, filters: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
    own = CuckooFilter.from_bytes(filters["filter"].iloc[0]) if len(filters) else CuckooFilter.of(np.zeros(0, np.int64))
    own.delete(moved.loc[~moved["up"], "h1"].to_numpy())
    fits = own.insert(moved.loc[moved["up"], "h1"].to_numpy())  # if not, a larger one is built from the counts
    return pd.DataFrame({"shard": [key[0]], "filter": [own.to_bytes() if fits else None]})


def update_state(state: LineState, added: DataFrame | None = None, removed: DataFrame | None = None) -> LineState:
    """Insert the documents ``added`` (_id, text) and delete those in ``removed`` (_id). Only their keys are recounted.

    Deleting what was inserted gives the counts of before. A document that is there already is replaced.
    """
    old = state.postings
    gone = [x.select("_id") for x in (added, removed) if x is not None]
    out = gone[0].unionByName(gone[-1]).distinct() if gone else None
    kept, touched = old, None
    if out is not None:
        lost = old.join(out, "_id", "left_semi")
        kept, touched = old.join(out, "_id", "left_anti"), lost.select("h1", "h2")
    if added is not None:
        new = cut_table(postings(added, state.min_chars), DOCS)
        kept, touched = kept.unionByName(new), touched.unionByName(new.select("h1", "h2"))
    if touched is None:
        return state
    kept, touched = cut_table(kept), cut_table(touched.distinct())
    recounted = _count(kept.join(touched, ["h1", "h2"], "left_semi"))
    counts = cut_table(state.counts.join(touched, ["h1", "h2"], "left_anti").unionByName(recounted))
    hot = lambda of: of.join(touched, ["h1", "h2"], "left_semi").filter(F.col("refs") >= state.min_docs)
    was, now = hot(state.counts), hot(counts)
    moved = (now.join(was, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(True).alias("up"))
             .unionByName(was.join(now, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(False).alias("up")))
             .withColumn("shard", _shard(state.shards)))
    revised = cut_table(state.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(
        _revise, "shard int, filter binary"))
    full = revised.filter("filter is null").select("shard")
    anew = _filters(counts.filter(F.col("refs") >= state.min_docs).withColumn("shard", _shard(state.shards))
                    .join(full, "shard", "left_semi"), state.shards)
    return LineState(kept, counts, cut_table(revised.filter("filter is not null").unionByName(anew)),
                     state.shards, state.min_chars, state.min_docs)


def _screen(key: tuple, lines: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(filters) or not len(lines):
        return lines.iloc[:0][["h1", "h2", "_id"]]
    own = CuckooFilter.from_bytes(filters["filter"].iloc[0])
    return lines.loc[own.contains(lines["h1"].to_numpy()), ["h1", "h2", "_id"]]


def dropped_keys(state: LineState, of: DataFrame | None = None) -> DataFrame:
    """(_id, drop: array of keys): the keys each document loses. of: the postings to judge (default: the state's)."""
    lines = (of or state.postings).withColumn("shard", _shard(state.shards))
    crowded = lines.groupBy("shard").count().filter(F.col("count") > SHARD_ROWS).select(
        "shard", (F.ceil(F.col("count") / SHARD_ROWS) * SALTS).cast("int").alias("salts"))
    crowded = small(cut_table(crowded))
    salts = F.coalesce("salts", F.lit(SALTS))
    lines = lines.join(crowded, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("_id"), salts).cast("int")).drop("salts")
    copies = state.filters.join(crowded, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    maybe = lines.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(
        _screen, "h1 long, h2 long, _id long")
    hot = state.counts.filter(F.col("refs") >= state.min_docs)
    lost = salted_lookup(maybe, hot, ["h1", "h2"], "_id").filter("_id != owner")
    return lost.groupBy("_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))


RESULT = "struct<text:string,n_lines:bigint,n_dropped:bigint>"


def _rebuild(min_chars: int):
    @F.arrow_udf(RESULT)
    def rebuild(text: pa.Array, drop: pa.Array) -> pa.Array:
        data, offsets = buffers(text)
        texts, n_lines, n_dropped = [], [], []
        for i, keys in enumerate(drop):
            own = data[offsets[i]:offsets[i + 1]].tobytes()
            if not keys.is_valid:
                texts.append(own)
                n_lines.append(own.count(b"\n") + 1)
                n_dropped.append(0)
                continue
            out = {(k["h1"], k["h2"]) for k in keys.as_py()}
            lines, found = line_keys(own, min_chars)
            kept = [line for line, key in zip(lines, found.tolist()) if tuple(key) not in out]
            texts.append(b"\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        release()
        return pa.StructArray.from_arrays(
            [pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), pa.array(n_lines, pa.int64()),
             pa.array(n_dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])

    return rebuild


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5, carry: bool = False) -> DataFrame:
    """Per document: _id, doc_id, text (what stays), n_lines, n_dropped; with ``carry``, its other columns in _row.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least ``min_chars``
    code points in at least ``min_docs`` documents loses all its lines, except in the largest document holding it.
    A null or empty text is one empty line. Null ids count as the smallest; rows that share an id are separate
    documents, ordered by text. An empty table gives an empty result; other columns are ignored.
    """
    rows = with_unique_ids(docs, id_col, text_col, carry)
    drop = dropped_keys(build_state(rows, min_chars, min_docs))
    done = rows.join(drop, "_id", "left").select(
        "_id", "doc_id", _rebuild(min_chars)("text", "drop").alias("r"), *["_row"] * carry)
    return done.select("_id", "doc_id", "r.text", "r.n_lines", "r.n_dropped", *["_row"] * carry)

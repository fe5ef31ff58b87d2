"""Helpers shared by the training-data operators: stable ids, written tables, salted lookups, global ranks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of a looked-up row, so that rows of one hot key are spread over as many tasks.
SALTS = 16


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Folders that this process's ``cut_table`` calls have written and that are still there, oldest first.
WRITTEN: list[str] = []


def cut_table(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    It cuts the lineage like ``checkpoint()``, but the copy is columnar: later reads prune columns, and a lost
    executor costs a re-read of a file and no recomputation. ``batch_rows`` bounds the rows that Python workers get
    at a time while it is written, for rows that are large.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    try:
        if batch_rows:
            spark.conf.set(BATCH, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark, paths: list[str]) -> None:
    """Delete folders of ``cut_table``. Only for those that no lazy frame in use reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        WRITTEN.remove(path)


def with_unique_ids(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Columns ``_id`` (unique, never null), ``doc_id`` and ``text`` of every row of ``df``.

    ``_id`` equals the id when ids are unique and not null. Otherwise rows are numbered by (id, nulls first; text),
    so order by ``_id`` still follows the id and rows that share an id stay separate documents. With ``carry``, all
    other columns of the row come along in the struct ``_row``.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    ids = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                    *[F.struct(*rest).alias("_row")] * carry)
    odd = ids.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return ids.select(F.col("doc_id").alias("_id"), *ids.columns)
    fixed = cut_table(ids.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "_h", "text").withColumn("_at", F.monotonically_increasing_id()))
    return _ranked(fixed, "_at", "_id").select("_id", *ids.columns)


def _ranked(df: DataFrame, at: str, rank: str) -> DataFrame:
    """Turn (partition, index) numbers of ``monotonically_increasing_id`` in a written table into gapless ranks.

    Only one count per partition reaches the driver.
    """
    part, index = F.shiftright(F.col(at), 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in df.groupBy(part.alias("p")).count().collect())
    total, rows = 0, []
    for p, n in counts:
        rows.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(rows, "_p long, _first long")
    return (df.withColumn("_p", part).join(F.broadcast(offsets), "_p", "left")
            .withColumn(rank, F.col("_first") + index).drop("_p", "_first", at))


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rank every row from 0 by ``order`` (which must end in a unique column) with one range shuffle.

    The range-partitioned, sorted rows are written first, so ranks stay the same when a task is run again.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return _ranked(cut_table(placed.withColumn("_at", F.monotonically_increasing_id())), "_at", rank)


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, how: str = "inner",
                  salts: int = SALTS) -> DataFrame:
    """Join ``rows`` to ``table`` (at most one row a key) on ``keys``.

    ``table`` is copied ``salts`` times and ``rows`` pick a copy by ``spread``, so a key that holds a third of
    all rows is met by ``salts`` tasks.
    """
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    picked = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return picked.join(copies, [*keys, "_salt"], how).drop("_salt")


FAN_IN = 32


def _add_up(batches):
    import pyarrow as pa

    total = None
    for batch in batches:
        for value in batch.column(0):
            part = np.frombuffer(value.as_buffer(), np.float64)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


def tree_sum(parts: DataFrame, width: int, batch_rows: int | None = None, run=None) -> np.ndarray:
    """Sum of the vectors of ``width`` doubles in the one binary column of ``parts``.

    ``run`` makes the vectors out of the rows of ``parts``, as for mapInArrow, in the Python worker that adds them up: two
    mapInArrow on end are two workers a task, and all of an executor's workers live on.
    Tasks add up ``FAN_IN`` vectors at a time until there are no more than that, so the driver gets few of fixed size.
    """
    added = parts.toDF("part").mapInArrow(_add_up, "part binary") if run is None else parts.mapInArrow(lambda b: _add_up(run(b)), "part binary")
    parts = cut_table(added, batch_rows)
    n = parts.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = cut_table(parts.repartition(n).mapInArrow(_add_up, "part binary"))
    total = np.zeros(width)
    for row in parts.toLocalIterator():
        total += np.frombuffer(row[0], np.float64)
    return total


def release() -> None:
    """Give memory that is free again back to the system; Python workers live on after a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def releasing(run):
    """``run`` for mapInArrow, with ``release`` at the end of its partition."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of an Arrow string or binary array; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int):
    """Runs (first, end) of rows holding about ``size`` bytes each; a longer row makes a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, end
        first = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.zeros((2, 0), np.uint64)


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values times powers of an odd base, and inverse powers: the hash of values[a:b] is
    ``(sums[b] - sums[a]) * inverse[a]``, all modulo 2^64."""
    global _powers
    if _powers.shape[1] < len(values) + 1:
        n = len(values) + 1
        _powers = np.stack([np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, p, np.uint64)]))
                            for p in (_BASE, _BASE_INVERSE)])
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers[0, :len(values)], out=sums[1:])
    return sums, _powers[1]


_BLOCK = 1 << 18
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of the documents in ``data``: 64-bit hash with A-Z lower-cased, start, end, and the first word of each
    document (n + 1). Words are runs of bytes for which the table ``inside`` is true; none crosses documents."""
    within = inside[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = len(data) > 0 and within[0], len(data) > 0 and within[-1]
    np.not_equal(within[1:], within[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    cuts = offsets[1:-1]  # a word that goes on over the end of a document is two
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):
        own = np.searchsorted(start, cuts, side="right") - 1
        mid = (own >= 0) & (start[own] < cuts) & (end[own] > cuts)
        if mid.any():
            start = np.sort(np.concatenate([start, cuts[mid]]))
            end = np.sort(np.concatenate([end, cuts[mid]]))
    values = _BYTE_VALUES.copy()
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    hashes = np.empty(len(start), np.uint64)
    first = np.searchsorted(start, np.arange(0, len(data) + _BLOCK, _BLOCK))
    for a, b in zip(first[:-1], first[1:]):  # a block of text at a time, for the sake of memory
        if a < b:
            low = start[a]
            sums, inverse = prefix_sums(values[data[low:end[b - 1]]])
            hashes[a:b] = (sums[end[a:b] - low] - sums[start[a:b] - low]) * inverse[start[a:b] - low]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes, start, end, np.searchsorted(start, offsets)

"""Best-fit packing of tokenized documents into fixed-length sequences, in bulk-synchronous steps.

Pieces are range-sorted by length, longest first. Lengths are whole numbers up to the capacity, so the sorted pieces
are at most ``capacity`` runs of equal length, and sequences with the same gap form runs too. A superstep takes one
run of pieces, matches it to the successor gaps (the smallest that hold it) by sweeping the sorted gap runs, settles
which piece gets which sequence by rank, updates the gaps and goes on with the next run. Only runs, never rows, take
part in the sweep; rows find their place afterwards by their global rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapsekit.llm.common import buffers, cut_table, global_rank, pieces, releasing, with_unique_ids
from lapsekit.llm.words import word_ids

CAPACITY = 4096
END_ID = 1
#: Bytes of text tokenized at a time, so that what repeats in them is tokenized once.
CHUNK = 4 << 20
DOCS = 2000  # documents that a Python worker gets at a time


def _cut(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(vocabulary)
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for first, end in pieces(offsets, CHUNK):
                low = offsets[first]
                ids, ends = own.encode(data[low:offsets[end]], offsets[first:end + 1] - low)
                rows: list[tuple] = []
                for i in range(end - first):
                    doc = np.append(ids[ends[i]:ends[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for k, start in enumerate(range(0, len(doc), capacity)):
                        part = doc[start:start + capacity]
                        rows.append((first + i, k, start, len(part), zlib.crc32(part)))
                at, k, start, length, crc = (np.array(x, np.int64) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(k, pa.int32()),
                     pa.array(start), pa.array(length), pa.array(crc)],
                    names=["_id", "doc_id", "piece", "start", "length", "ids_crc32"])

    return releasing(run)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of ``counts`` (length -> pieces, longest first) as runs of ranks.

    Returns arrays first_rank (ascending), first_sequence, step and offset: the k-th piece of a run lies at
    ``offset`` in sequence ``first_sequence + k // step``, behind ``k % step`` others of its own length.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # gap -> runs (first sequence, count)
    runs: list[tuple[int, int, int, int]] = []
    rank = sequences = 0
    open_gaps = np.zeros(capacity + 1, bool)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for gap in (np.flatnonzero(open_gaps[size:]) + size).tolist():  # successors, the smallest gap first
            each = gap // size
            while left and gaps[gap]:
                first, many = gaps[gap].pop()
                full = min(many, left // each)
                if full:
                    runs.append((rank, first, each, capacity - gap))
                    rank, left = rank + full * each, left - full * each
                    _add(gaps, open_gaps, gap - each * size, first, full)
                if full < many and left:  # fewer pieces than this one sequence still holds
                    runs.append((rank, first + full, left, capacity - gap))
                    _add(gaps, open_gaps, gap - left * size, first + full, 1)
                    rank, full, left = rank + left, full + 1, 0
                if full < many:
                    gaps[gap].append((first + full, many - full))
            open_gaps[gap] = bool(gaps[gap])
            if not left:
                break
        if left:
            each = capacity // size
            full, rest = divmod(left, each)
            if full:
                runs.append((rank, sequences, each, 0))
                _add(gaps, open_gaps, capacity - each * size, sequences, full)
                rank, sequences = rank + full * each, sequences + full
            if rest:
                runs.append((rank, sequences, rest, 0))
                _add(gaps, open_gaps, capacity - rest * size, sequences, 1)
                rank, sequences = rank + rest, sequences + 1
    table = np.array(runs, np.int64).reshape(-1, 4)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()


def _add(gaps, open_gaps, gap: int, first: int, count: int) -> None:
    if gap:
        gaps[gap].append((first, count))
        open_gaps[gap] = True


def _place(runs):
    first_rank, first_sequence, step, offset = runs.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(first_rank, rank, side="right") - 1
            k = rank - first_rank[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(first_sequence[at] + k // step[at]), pa.array(offset[at] + k % step[at] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    A document is its token ids and an end id; only a longer one is cut, into pieces of ``capacity`` tokens and a
    rest. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id
    alone, null or shared ids are separate documents, and an empty table gives no pieces.
    """
    spark = docs.sparkSession
    rows = with_unique_ids(docs, id_col, text_col)
    cut = cut_table(rows.mapInArrow(_cut(vocabulary, capacity),
                                    "_id long, doc_id long, piece int, start long, length long, ids_crc32 long"), DOCS)
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    ranked = global_rank(cut, [F.desc("length"), F.col("_id"), F.col("piece")])
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    return ranked.mapInArrow(_place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                           "sequence_id long, offset long")

"""Dedup of repeated byte strings with suffix arrays built by two-stage sorting.

Every 100-byte string picks an anchor, the smallest hash of the 36-byte strings in it; equal strings pick equal
anchors. A run of starts with one anchor is a segment. Segments meet by anchor: a segment that repeats whole goes
at once, and of anchors with different segments the first copy of each goes into a suffix array, where neighbours
with a common prefix of 100 bytes give the strings that start earlier elsewhere. No string is lost on the way: all
its copies meet under its anchor, and the earliest of them lies in the first copy of its segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lapsekit.llm.common import buffers, cut_table, pieces, prefix_sums, ragged, release, releasing, with_unique_ids

SPAN = 100
ANCHOR = 36
MAX_STARTS = 256  # in a segment; a longer run makes several
TWICE = 512  # added to the number of starts of a segment that holds its anchor twice
CHUNK = 1 << 20  # bytes hashed at a time
STEP = 1 << 22  # a longer document is hashed in overlapping parts of this size
ARRAY_BYTES = 4 << 20  # of segments in a suffix array; an anchor with more makes a larger one

_A, _B, _P = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes from each position, put together from strings of 1, 2, 4, ... bytes."""
    n = len(data) - width + 1
    now = (data.astype(np.uint64) + np.uint64(1)) * _P
    now ^= now >> np.uint64(31)
    out, at, size = np.zeros(n, np.uint64), 0, 1
    while True:
        if width & size:
            out *= _A
            out += now[at:at + n]
            out ^= out >> np.uint64(33)
            at += size
            if at == width:
                return out
        now = now[:-size] * _B + now[size:]
        now ^= now >> np.uint64(29)
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    now, size = values, 1
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    rest = width - size
    return np.minimum(now[:-rest], now[rest:]) if rest else now


def segments(data: np.ndarray, offsets: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segments of the documents in ``data``: document index, start in it, number of starts, anchor, run hash, and
    whether the anchor occurs twice in it (only then can a string repeat within the segment)."""
    empty = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    whole = np.flatnonzero(sizes >= span)
    if not len(whole):
        return empty, empty, empty, empty, empty, empty.astype(bool)
    hashes = gram_hashes(data, anchor)
    least = sliding_min(hashes, span - anchor + 1)
    lengths = sizes[whole] - span + 1
    at = ragged(offsets[whole], lengths)
    value = least[at]
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(value[1:], value[:-1], out=first[1:])
    ends = np.cumsum(lengths)
    first[ends[:-1]] = True
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(at)))
    parts = -(-count // MAX_STARTS)
    if parts.max() > 1:
        index = ragged(np.zeros(len(parts), np.int64), parts)
        begin = np.repeat(begin, parts) + index * MAX_STARTS
        count = np.minimum(np.repeat(count, parts) - index * MAX_STARTS, MAX_STARTS)
    start = at[begin]
    sums, inverse = prefix_sums(hashes)
    run = (sums[start + count + span - anchor] - sums[start]) * inverse[start] + count.astype(np.uint64)
    doc = whole[np.searchsorted(ends, begin, side="right")]
    # anchors are positions that are smallest in some window; few lie in a segment
    width = span - anchor + 1
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(~sliding_min(~padded, width) == hashes)
    low = np.searchsorted(chosen, start)
    many = np.searchsorted(chosen, start + count + width - 1) - low
    which = np.repeat(np.arange(len(start)), many)
    like = hashes[chosen[ragged(low, many)]] == value[begin][which]
    twice = np.bincount(which[like], minlength=len(start)) > 1
    return doc, start - offsets[doc], count, value[begin].view(np.int64), run.view(np.int64), twice


def _chunks(data: np.ndarray, offsets: np.ndarray, span: int):
    """Parts of a batch to hash at a time: (data, offsets, first document, start of the part in it)."""
    for first, end in pieces(offsets, CHUNK):
        low, high = offsets[first], offsets[end]
        if high - low <= STEP:
            yield data[low:high], offsets[first:end + 1] - low, first, 0
        else:  # one long document
            for at in range(0, high - low, STEP):
                part = data[low + at:min(high, low + at + STEP + span - 1)]
                yield part, np.array([0, len(part)]), first, at


def _emit(span: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            found = []
            for part, own, first, base in _chunks(data, offsets, span):
                doc, start, count, value, run_hash, twice = segments(part, own, span, anchor)
                found.append((ids[doc + first], start + base, count + TWICE * twice, value, run_hash))
            if not found:
                continue
            doc, start, count, value, run_hash = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, run_hash))
            doc, start, count, value, run_hash = (x[order] for x in (doc, start, count, value, run_hash))
            again = np.zeros(len(doc), bool)
            if len(doc) > 1:
                again[1:] = (run_hash[1:] == run_hash[:-1]) & (value[1:] == value[:-1])
            # what repeats within the batch needs no meeting: it spreads by document and carries a negative count
            value = np.where(again, doc * 0x2545F491, value)
            run_hash = np.where(again, start, run_hash)
            count = np.where(again, -(count % TWICE), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (value, run_hash, doc, start, count.astype(np.int32))],
                names=["anchor", "run", "_id", "start", "starts"])

    return releasing(run)


def meet(rows: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """Segments that matter: (_id, start, starts, anchor, sure). ``sure`` ones repeat whole; the others are the first
    copies of their segment under an anchor that has several, or that may repeat within themselves."""
    seen = rows.select("_id", "text").mapInArrow(
        _emit(span, anchor), "anchor long, run long, _id long, start long, starts int")
    at = Window.partitionBy("anchor").orderBy("run", "_id", "start")
    whole = Window.partitionBy("anchor")
    before = F.lag(F.struct("run", "starts")).over(at)
    x = seen.withColumn("before", before).withColumn("last", F.max("run").over(whole))
    own = F.col("starts") > 0
    same = own & (F.col("before.run") == F.col("run")) & (F.col("before.starts") > 0)
    sure = ~own | F.coalesce(same, F.lit(False))
    several = F.col("before").isNotNull() | (F.col("last") != F.col("run")) | (F.col("starts") > TWICE)
    return x.withColumn("sure", sure).filter(F.col("sure") | several).select(
        "_id", "start", (F.abs("starts") % TWICE).alias("starts"), "anchor", "sure")


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; the text is taken to go on with zeros."""
    now = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        now = (now[:-size] << np.uint64(8 * size)) | now[size:]
    return now[:len(text)]


def _sort_direct(at: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` sorted by the ``depth`` bytes that follow, eight at a time, going on with ties only."""
    at = at[np.argsort(word[at])]
    low, n = 8, len(word)
    group = np.cumsum(np.concatenate([[0], word[at[1:]] != word[at[:-1]]])) if len(at) else at
    todo = np.arange(len(at))
    while low < depth and len(todo):
        own = group[todo]
        tied = np.zeros(len(own), bool)
        same = own[1:] == own[:-1]
        tied[1:] = same
        tied[:-1] |= same
        todo, own = todo[tied], own[tied]
        if not len(todo):
            break
        place = at[todo]
        key = np.where(place + low < n, word[np.minimum(place + low, n - 1)], np.uint64(0))
        order = np.lexsort((key, own))
        at[todo] = place[order]
        key = key[order]
        step = np.concatenate([[0], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
        group[todo] = np.cumsum(step)
        low += 8
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (bytes) sorted by the ``depth`` bytes that follow, by two-stage sorting.

    Suffixes smaller than their successor are sorted directly. The others are induced: buckets of first bytes are
    scanned in order, and a suffix takes the next free place of its bucket when its successor is met.
    """
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # types: compare with the next byte that differs
    upward = np.zeros(n, bool)
    if len(change):
        rising = text[change] < text[change + 1]
        which = np.searchsorted(change, np.arange(n))
        inside = which < len(change)
        upward[inside] = rising[which[inside]]
    direct = _sort_direct(np.flatnonzero(upward), words(text), depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[text[n - 1]].append(np.array([n - 1]))  # larger than the empty suffix after it
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        bucket = []
        while len(wave):  # a byte before its like goes into the same bucket
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        bucket.append(direct[edges[c]:edges[c + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[text[before] > c]
        if len(before):
            order = np.argsort(text[before], kind="stable")
            before = before[order]
            cut = np.flatnonzero(np.diff(text[before])) + 1
            for part in np.split(before, cut):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(word: np.ndarray, left: np.ndarray, right: np.ndarray, span: int) -> np.ndarray:
    """Common prefix length, up to ``span``, of the suffixes at ``left`` and ``right`` (which hold span bytes)."""
    out = np.zeros(len(left), np.int64)
    todo = np.arange(len(left))
    for low in range(0, span, 8):
        width = min(8, span - low)
        differ = (word[left[todo] + low] ^ word[right[todo] + low]) >> np.uint64(8 * (8 - width))
        equal = np.full(len(todo), width)
        for b in range(width):  # bytes before the first that differs
            equal = np.where(differ >> np.uint64(8 * (width - 1 - b)) != 0, np.minimum(equal, b), equal)
        out[todo] += equal
        todo = todo[equal == width]
    return out


def repeats(texts: list[bytes], ids: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of every ``span`` bytes of the segments that also start earlier in them, sorted."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)  # 0xFF, in no UTF-8 text, ends each
    begin = np.cumsum(sizes + 1) - sizes - 1
    many = sizes - span + 1
    valid = ragged(begin, many)
    which = np.full(len(joined), -1, np.int32)
    which[valid] = np.repeat(np.arange(len(texts), dtype=np.int32), many)
    order = suffix_array(joined, span)
    order = order[which[order] >= 0]
    word = words(joined)
    same = common_prefixes(word, order[:-1], order[1:], span) >= span
    group = np.concatenate([[0], np.cumsum(~same)])
    tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order, group = order[tied], group[tied]
    doc = ids[which[order]]
    place = starts[which[order]] + order - begin[which[order]]
    by = np.lexsort((place, doc, group))
    doc, place, group = doc[by], place[by], group[by]
    later = np.concatenate([[False], group[1:] == group[:-1]]) if len(group) else np.zeros(0, bool)
    doc, place = doc[later], place[later]
    by = np.lexsort((place, doc))
    return doc[by], place[by]


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows = batch.column("segments")
            flat = rows.flatten()
            counts = np.diff(rows.offsets.to_numpy())
            start, many = flat.field("start").to_numpy(), flat.field("starts").to_numpy()
            doc = np.repeat(np.arange(len(counts)), counts)
            low = offsets[doc] + start
            parts = [data[a:b].tobytes() for a, b in zip(low.tolist(), (low + many + span - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [flat.field("anchor"), batch.column("_id").take(pa.array(doc)), pa.array(start),
                 pa.array(parts, pa.binary())], names=["anchor", "_id", "start", "part"])

    return releasing(run)


def _sort(span: int):
    def result(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        doc, start = repeats(table["part"].to_pylist(), table["_id"].to_numpy(), table["start"].to_numpy(), span)
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])) if len(doc) else doc
        count = np.diff(np.append(first, len(doc)))
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first]), pa.array(count.astype(np.int32))],
                                          names=["_id", "start", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; an array is built whenever enough bytes of whole anchors are there."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                anchors = batch.column("anchor").to_numpy()
                lengths = np.diff(buffers(batch.column("part"))[1])
                full = int(np.searchsorted(np.cumsum(lengths), ARRAY_BYTES - size))
                if full >= batch.num_rows:
                    held.append(batch)
                    size += int(lengths.sum())
                    break
                at = anchors[full]
                end = full + int(np.searchsorted(anchors[full:] != at, True))
                if end == batch.num_rows:  # the anchor may go on in the next batch
                    begin = int(np.searchsorted(anchors == at, True))
                    if begin:
                        yield result([*held, batch.slice(0, begin)])
                        held, size = [], 0
                        batch = batch.slice(begin)
                        lengths = lengths[begin:]
                    elif held and held[-1].column("anchor")[-1].as_py() != at:
                        yield result(held)
                        held, size = [], 0
                    held.append(batch)
                    size += int(lengths.sum())
                    break
                yield result([*held, batch.slice(0, end)])
                held, size, batch = [], 0, batch.slice(end)
        if held:
            yield result(held)

    return releasing(run)


DONE = "struct<n_bytes:bigint,spans:array<struct<start:bigint,end:bigint>>,kept:binary>"


def _remove(span: int):
    @F.arrow_udf(DONE)
    def remove(text: pa.Array, ranges: pa.Array) -> pa.Array:
        data, offsets = buffers(text)
        kept, spans, sizes = [], [], np.diff(offsets)
        flat = ranges.flatten()
        start, many = flat.field("start").to_numpy(), flat.field("starts").to_numpy().astype(np.int64)
        valid = ranges.is_valid().to_numpy(zero_copy_only=False)
        counts = np.where(valid, np.diff(ranges.offsets.to_numpy()), 0)
        ends = np.cumsum(counts)
        for i in range(len(sizes)):
            own = data[offsets[i]:offsets[i + 1]]
            a = start[ends[i] - counts[i]:ends[i]]
            if not len(a):
                kept.append(own.tobytes())
                spans.append([])
                continue
            b = np.minimum(a + many[ends[i] - counts[i]:ends[i]] + span - 1, sizes[i])
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            low, high = a[first], b[np.append(first[1:], len(a)) - 1]
            stay = np.ones(len(own), bool)
            stay[ragged(low, high - low)] = False
            kept.append(own[stay].tobytes())
            spans.append([{"start": x, "end": y} for x, y in zip(low.tolist(), high.tolist())])
        release()
        return pa.StructArray.from_arrays(
            [pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(kept, pa.binary())], names=["n_bytes", "spans", "kept"])

    return remove


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed byte ranges, maximal), kept (remaining bytes).

    Every byte covered by ``span`` bytes that also start earlier (in a smaller document, or earlier in the same one)
    goes; overlaps count, and all is judged on the input. A null text has no bytes, a text shorter than ``span``
    stays whole. Null ids count as the smallest; rows that share an id are separate documents, ordered by text. An
    empty table gives an empty result; other columns are ignored.
    """
    if span <= ANCHOR:
        raise ValueError(f"span must be over {ANCHOR}")
    rows = with_unique_ids(docs, id_col, text_col)
    met = cut_table(meet(rows, span))
    texts = rows.select("_id", "doc_id", "text").repartition("_id")  # one shuffle serves both joins
    each = met.filter("not sure").groupBy("_id").agg(F.collect_list(F.struct("start", "starts", "anchor")).alias("segments"))
    parts = texts.join(each, "_id").select("_id", "text", "segments").mapInArrow(
        _cut(span), "anchor long, _id long, start long, part binary")
    found = parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _sort(span), "_id long, start long, starts int")
    ranges = met.filter("sure").select("_id", "start", "starts").unionByName(found)
    each = ranges.groupBy("_id").agg(F.collect_list(F.struct("start", "starts")).alias("ranges"))
    done = texts.join(each, "_id", "left").select("doc_id", _remove(span)("text", "ranges").alias("r"))
    return done.select("doc_id", "r.n_bytes", "r.spans", "r.kept")


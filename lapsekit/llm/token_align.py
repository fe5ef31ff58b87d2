"""Alignment of the tokens of two vocabularies, A (byte-level) and B (pieces), by their bytes.

Both encodings of a text cover the same bytes; places where tokens of both end cut it into groups. Nearly all groups
are one A token and the B token of the same bytes: an array of A ids names those pairs, and vectors of the
vocabulary's length count the documents that hold them. Only pairs of other groups enter a shuffle, each once for a
chunk of documents, and come back to the chunk with their counts. Text is cut before blanks, where tokens of both
vocabularies end; equal pieces of a worker are encoded and aligned once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapsekit.llm.bpe_prefix import Encoder, distinct_strings, joined
from lapsekit.llm.common import buffers, cut_table, pieces, ragged, releasing, salted_lookup, tree_sum

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text aligned at a time; the documents of a chunk share one row of pairs.
CHUNK = 1 << 20
DOCS = 1000  # documents that a Python worker gets at a time
CHUNKS = 4  # rows of chunks that a Python worker gets at a time
#: Pieces a worker remembers; at this many it starts anew, which only costs work.
KEPT = 60_000
LEARNED = 1 << 14  # new pieces encoded and aligned at a time

LINK_SCHEMA = ("doc_id array<long>, groups array<string>, stats binary, own_ends binary, own_a binary, own_n binary, "
               "far_ends binary, far_at binary, far_n binary, pairs binary, pair_docs binary")


def wide_space_ends(data: np.ndarray) -> np.ndarray:
    """True at the last bytes of white-space characters beyond ASCII."""
    one, two = np.zeros_like(data), np.zeros_like(data)
    one[1:], two[2:] = data[:-1], data[:-2]
    found = (one == 0xC2) & ((data == 0x85) | (data == 0xA0)) | (two == 0xE1) & (one == 0x9A) & (data == 0x80)
    found |= (two == 0xE2) & (one == 0x80) & ((data >= 0x80) & (data <= 0x8A) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF))
    return found | (two == 0xE2) & (one == 0x81) & (data == 0x9F) | (two == 0xE3) & (one == 0x80) & (data == 0x80)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``ends`` (n + 1)."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Pool:
    """Rows of numbers of different lengths, to which rows are added."""

    def __init__(self, kinds: list[type]):
        self.columns = [np.zeros(1 << 16, k) for k in kinds]
        self.starts, self.lengths, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, lengths: np.ndarray, *columns: np.ndarray) -> None:
        n = int(lengths.sum())
        while self.used + n > len(self.columns[0]):
            self.columns = [np.concatenate([c, np.zeros_like(c)]) for c in self.columns]
        for own, new in zip(self.columns, columns):
            own[self.used:self.used + n] = new
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += n

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        at = ragged(self.starts[rows], self.lengths[rows])
        return tuple(c[at] for c in self.columns)


class Aligner:
    """Aligned pieces of text; remembers them."""

    def __init__(self, a_file: str, b_file: str):
        import public_tokenizers
        import sentencepiece

        self.a = Encoder(a_file, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        self.b_size = self.b.get_piece_size()
        tokens = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                  for i, p in enumerate(map(self.b.id_to_piece, range(self.b_size)))]
        self.blank = self.b.piece_to_id("▁")
        self.b_lengths = np.array([len(t) for t in tokens], np.int64)
        self.b_pool, self.b_starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.b_lengths) - self.b_lengths
        ids: dict[bytes, int] = {}
        for i, token in enumerate(tokens):  # a piece of characters rather than the byte of the same value
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (token not in ids or self.b.is_byte(ids[token])):
                ids[token] = i
        self.same = np.array([ids.get(t, -1) for t in self.a.vocabulary.bytes], np.int64)
        self.a_size = len(self.same)
        most = max(self.a_size, self.b_size)
        self.digits = np.array([list(str(i).encode().ljust(len(str(most)) + 1, b" ")) for i in range(most)], np.uint8)
        self.n_digits = np.array([len(str(i)) for i in range(most)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.stats = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, 1 if the bytes differ
        self.own, self.far = Pool([np.int32, np.int32]), Pool([np.int64, np.int64])

    def forget(self) -> None:
        """Give up what is remembered: an executor's workers live on, and the next task's chunks have other pieces."""
        self._forget()
        self.a.forget()

    def _b_ids(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """B ids of pieces that begin with a blank, which the tokenizer itself puts there."""
        lists = self.b.encode([u[1:].decode() for u in found], num_threads=1)
        lists = [x if len(u) > 1 else [self.blank] for x, u in zip(lists, found)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum())), counts

    def _learn(self, found: list[bytes]) -> None:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        data, ends = np.frombuffer(b"".join(found), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        b, b_counts = self._b_ids(found)
        b_ends = np.concatenate([[0], np.cumsum(b_counts)])
        sizes = self.b_lengths[b]
        wrong = _sums(sizes, b_ends) != lengths
        if not wrong.all():
            right = np.flatnonzero(~wrong)
            own = b[ragged(b_ends[right], b_counts[right])]
            spelled = self.b_pool[ragged(self.b_starts[own], self.b_lengths[own])]
            differ = spelled != data[ragged(ends[right], lengths[right])]
            wrong[right] = _sums(differ, np.concatenate([[0], np.cumsum(lengths[right])])) > 0
        right = np.flatnonzero(~wrong)
        data = data[ragged(ends[right], lengths[right])]
        unit_ends = np.concatenate([[0], np.cumsum(lengths[right])])
        b = b[ragged(b_ends[right], b_counts[right])]
        a, a_first = self.a.encode(data, unit_ends)
        self._align(len(found), right, unit_ends, a.astype(np.int64), a_first, b, np.concatenate([[0], np.cumsum(b_counts[right])]))
        self.known.update(zip(found, range(len(self.known), len(self.known) + len(found))))

    def _align(self, n: int, right, unit_ends, a, a_first, b, b_first) -> None:
        """Groups of the pieces ``right`` of ``n``, whose tokens are given one after the other."""
        a_ends, b_ends = np.cumsum(self.a.vocabulary.lengths[a], dtype=np.int64), np.cumsum(self.b_lengths[b])
        both = np.zeros(int(unit_ends[-1]) + 1, np.int8)
        both[a_ends] = 1
        both[b_ends] += 2
        before = np.cumsum(both == 3) - (both == 3)  # ends of groups before a byte
        a_group, b_group = before[a_ends], before[b_ends]
        n_groups = int((both == 3).sum())
        many_a, many_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        links = many_a * many_b
        group_first = np.cumsum(both == 3)[unit_ends]
        stats = np.zeros((n, 5), np.int64)
        stats[:, 4] = 1
        stats[right, 4] = 0
        for k, x in enumerate((np.diff(a_first), np.diff(b_first), np.diff(group_first), _sums(links, group_first))):
            stats[right, k] = x
        self.stats = np.concatenate([self.stats, stats])
        self._spell(n, right, a, b, a_group, b_group, many_a, many_b, np.asarray(a_first) + np.asarray(b_first))
        # pairs: one A token and the B token of its bytes, or all others
        sum_a, sum_b = np.cumsum(many_a), np.cumsum(many_b)
        plain = (many_a == 1) & (many_b == 1)
        plain[plain] = self.same[a[sum_a[plain] - 1]] == b[sum_b[plain] - 1]
        group_unit = np.repeat(right, np.diff(group_first))
        plain_at = np.flatnonzero(plain)
        x, x_n = _merged(a_group[~plain[a_group]] * self.a_size + a[~plain[a_group]], np.ones(int((~plain[a_group]).sum()), np.int64))
        y, y_n = _merged(b_group[~plain[b_group]] * self.b_size + b[~plain[b_group]], np.ones(int((~plain[b_group]).sum()), np.int64))
        x_group, y_group = x // self.a_size, y // self.b_size
        y_first, y_end = np.searchsorted(y_group, x_group), np.searchsorted(y_group, x_group, side="right")
        at = ragged(y_first, y_end - y_first)
        times = y_end - y_first
        pair_a, pair_b = np.repeat(x % self.a_size, times), y[at] % self.b_size
        pair_n, pair_unit = np.repeat(x_n, times) * y_n[at], np.repeat(group_unit[x_group], times)
        same = self.same[pair_a] == pair_b
        units = np.concatenate([group_unit[plain_at], pair_unit[same]])
        keys, counts = _merged(units * self.a_size + np.concatenate([a[sum_a[plain_at] - 1], pair_a[same]]),
                               np.concatenate([np.ones(len(plain_at), np.int64), pair_n[same]]))
        self.own.add(np.bincount(keys // self.a_size, minlength=n), keys % self.a_size, counts)
        width = self.a_size * self.b_size
        order = np.argsort(pair_unit[~same], kind="stable")
        code = (pair_a[~same] * self.b_size + pair_b[~same])[order]
        assert n < (1 << 62) // width  # units of a chunk are fewer than its bytes
        keys, counts = _merged(pair_unit[~same][order] * width + code, pair_n[~same][order])
        self.far.add(np.bincount(keys // width, minlength=n), keys % width, counts)

    def _spell(self, n, right, a, b, a_group, b_group, many_a, many_b, first) -> None:
        """Texts ``a1,a2|b1;`` of the groups of every piece."""
        sum_a, sum_b = np.cumsum(many_a), np.cumsum(many_b)
        ids, ends = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        place = np.arange(len(a)) + (sum_b - many_b)[a_group]
        ids[place] = a
        ends[place[sum_a - 1]] = ord("|")
        place = np.arange(len(b)) + sum_a[b_group]
        ids[place] = b
        ends[place[sum_b - 1]] = ord(";")
        rows = self.digits[ids]
        sizes = self.n_digits[ids]
        rows[np.arange(len(ids)), sizes] = ends
        flat = rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes()
        cut = np.concatenate([[0], np.cumsum(sizes + 1)])[first].tolist()
        texts = [b""] * n
        for i, start, end in zip(right.tolist(), cut[:-1], cut[1:]):
            texts[i] = flat[start:end]
        self.texts += texts

    def rows(self, data: np.ndarray, offsets: np.ndarray, digest: bool):
        """Of a chunk of texts: stats (n x 4), groups, (document, A id, count) of same-byte pairs, (document, pair, count)
        of the others; the last two sorted."""
        n = len(offsets) - 1
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            texts = [data[x:y].tobytes().decode("utf-8", "replace").encode() for x, y in zip(offsets[:-1], offsets[1:])]
            return self.rows(*joined(texts), digest)
        filled = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][filled], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        mark = np.zeros(len(data) + 1, bool)
        if len(data):
            white = wide_space_ends(data)
            white |= (data == 32) | (data >= 9) & (data <= 13)
            mark[1:-1] = (data[1:] == 32) & ~white[:-1]
        mark[offsets] = True
        cuts = np.flatnonzero(mark)
        found, which = distinct_strings(data, cuts)
        if len(self.known) + len(found) > KEPT:
            self._forget()
        new = [u for u in found if u not in self.known]
        for i in range(0, len(new), LEARNED):
            self._learn(new[i:i + LEARNED])
        at = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))[which]
        ends = np.searchsorted(cuts, offsets)
        stats = np.stack([_sums(self.stats[at, k], ends) for k in range(5)], axis=1)
        good = stats[:, 4] == 0
        stats = np.where(good[:, None], stats[:, :4], 0)
        texts, order = self.texts, at.tolist()
        groups = [b"".join([texts[i] for i in order[x:y]])[:-1] if ok else b"" for x, y, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), good.tolist())]
        groups = [hashlib.sha256(g).hexdigest() if digest and g else g.decode() for g in groups]
        doc = np.repeat(np.arange(n), np.diff(ends))
        keep = good[doc]
        units, times = _merged(doc[keep] * len(self.known) + at[keep], np.ones(int(keep.sum()), np.int64))
        doc, unit = units // max(1, len(self.known)), units % max(1, len(self.known))
        a, a_n = self.own.take(unit)
        many = self.own.lengths[unit]
        own = _merged(np.repeat(doc, many) * self.a_size + a, np.repeat(times, many) * a_n)
        code, code_n = self.far.take(unit)
        many = self.far.lengths[unit]
        pairs, place = np.unique(code, return_inverse=True)
        far = _merged(np.repeat(doc, many) * max(1, len(pairs)) + place, np.repeat(times, many) * code_n)
        return stats, groups, own, far, pairs


_workers: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    if (a_file, b_file) not in _workers:
        _workers[a_file, b_file] = Aligner(a_file, b_file)
    return _workers[a_file, b_file]


def _link(a_file: str, b_file: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_file, b_file)
        try:
            yield from linked(own, batches)
        finally:
            own.forget()

    def linked(own: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, end in pieces(offsets, CHUNK):
                low, n = offsets[first], end - first
                stats, groups, same, far, pairs = own.rows(data[low:offsets[end]], offsets[first:end + 1] - low, digest)
                same_doc, far_doc = same[0] // own.a_size, far[0] // max(1, len(pairs))
                far_at = far[0] % max(1, len(pairs))
                ends = np.arange(n + 1)
                values = [stats.astype("<i8"), np.searchsorted(same_doc, ends).astype("<i8"), (same[0] % own.a_size).astype("<i4"),
                          same[1].astype("<i8"), np.searchsorted(far_doc, ends).astype("<i8"), far_at.astype("<i4"),
                          far[1].astype("<i8"), pairs.astype("<i8"), np.bincount(far_at, minlength=len(pairs)).astype("<i8")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0).slice(first, n).to_pylist()], pa.list_(pa.int64())), pa.array([groups], pa.list_(pa.string()))]
                    + [pa.array([v.tobytes()], pa.binary()) for v in values],
                    names=["doc_id", "groups", "stats", "own_ends", "own_a", "own_n", "far_ends", "far_at", "far_n", "pairs", "pair_docs"])

    return releasing(run)


def _count_same(size: int):
    """Documents of each partition that hold the same-byte pair of an A id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), "<i4"), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, docs in zip(*(batch.column(c) for c in range(3))):
            pairs, docs = np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(docs.as_buffer(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk.as_py())), pa.array(np.arange(len(pairs), dtype=np.int32)),
                                              pa.array(pairs), pa.array(docs)], names=["chunk", "at", "pair", "docs"])


def _score(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, best, b_size = counts.value
        number = lambda x, kind="<i8": np.frombuffer(x.as_buffer(), kind)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                docs = row["doc_id"].values
                stats = number(row["stats"]).reshape(-1, 4)
                a, n, ends = number(row["own_a"], "<i4"), number(row["own_n"]), number(row["own_ends"])
                n_best, count_sum = _sums(n * (same[a] == best[a]), ends), _sums(n * same[a], ends)
                pairs = number(row["pairs"])
                if len(pairs):
                    found = row["counts"].values
                    total = np.zeros(len(pairs), np.int64)
                    total[found.field("at").to_numpy()] = found.field("total").to_numpy()
                    at, n, ends = number(row["far_at"], "<i4"), number(row["far_n"]), number(row["far_ends"])
                    n_best += _sums(n * (total[at] == best[pairs[at] // b_size]), ends)
                    count_sum += _sums(n * total[at], ends)
                yield pa.RecordBatch.from_arrays(
                    [docs, *[pa.array(stats[:, k]) for k in range(4)], pa.array(n_best), pa.array(count_sum), row["groups"].values],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return releasing(run)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE,
                 digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` spells the ids ``a1,a2|b1;a3|b2,b3`` (with ``digest`` its SHA-256 instead, which is far shorter). All
    pairs of an A and a B token of one group are links; a pair's count is the number of documents that hold it linked.
    ``n_best`` counts links whose count is the highest of their A id, ``count_sum`` adds up the counts of all links.
    Null and empty texts, and texts whose tokens spell other bytes than a blank and the text (as with U+2581 in them),
    have no tokens: zeros and ''. Bytes that are not UTF-8 count as U+FFFD. Rows with null or shared ids are separate
    documents, other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    a_size, b_size = vocabulary_sizes(a_file, b_file)
    linked = rows.mapInArrow(_link(a_file, b_file, digest), LINK_SCHEMA).withColumn("chunk", F.monotonically_increasing_id())
    linked = cut_table(linked, DOCS)
    same = tree_sum(linked.select("own_a"), a_size, CHUNKS, _count_same(a_size)).astype(np.int64)
    pairs = cut_table(linked.select("chunk", "pairs", "pair_docs").mapInArrow(_pairs, "chunk long, at int, pair long, docs long"), CHUNKS)
    totals = cut_table(pairs.groupBy("pair").agg(F.sum("docs").alias("total")))
    best = same.copy()
    for a, most in totals.groupBy(F.expr(f"pair div {b_size}")).agg(F.max("total")).toLocalIterator():  # at most one row an A id
        best[a] = max(best[a], most)
    counts = salted_lookup(pairs.select("chunk", "at", "pair"), totals, ["pair"], "chunk")
    counts = counts.groupBy("chunk").agg(F.collect_list(F.struct("at", "total")).alias("counts"))  # a chunk's pairs
    shared = spark.sparkContext.broadcast((same, best, b_size))
    scored = linked.join(counts, "chunk", "left").drop("chunk", "pair_docs").mapInArrow(
        _score(shared), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return cut_table(scored, CHUNKS)


def vocabulary_sizes(a_file: str, b_file: str) -> tuple[int, int]:
    """Ids of both vocabularies; the vectors' length."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(a_file)).get_vocab(with_added_tokens=True)
    return max(a.values()) + 1, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_file)).get_piece_size()

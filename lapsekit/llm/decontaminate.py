"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to features and documents cut into passages. One pass over all passages counts in how many each
feature occurs and applies their co-occurrence matrix to a random matrix; a singular value decomposition of that
sketch, with inverse document frequencies put in, gives the latent space. A second pass folds windows of several
lengths into it and takes those whose cosine to a benchmark passage is high. What the latent space leaves out, it
finds by words: every stretch of a document that holds as many of a passage's words as a match needs. Candidates are
checked word by word: the longest common subsequence with the passage, and for a looser match also with its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.llm.common import buffers, cut_table, pieces, ragged, release, releasing, tree_sum, word_hashes

FEATURES = 2048
RANK, SKETCH = 48, 64
PASSAGE = 128  # words
BLOCK = 4  # words between windows
#: Window lengths in blocks, for passages of about as many words. Longer passages are searched by pieces of the last.
LENGTHS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 20, 25, 32, 40, 50, 64, 80, 100, 128)
COSINE = 0.65
#: A document holds a passage if the longest common subsequence of a stretch of it and the passage has this share of
#: the passage's words, or the smaller share and that much of the answer, in order.
OVERLAP, PARAPHRASE, ANSWER = 0.7, 0.5, 0.8
#: A passage is looked for in all stretches of a document of up to this many times its words.
SPAN = 2.0
FREQUENT = 0.001  # words with this share of the text are taken to be found wherever a passage is looked for
WINDOWS = 4096  # stretches compared at a time
TABLE = 1 << 22  # words times passages in a table
ITEMS = 512  # passages searched at a time
BLOCKS = 8  # blocks of passages that a task holds
CHUNK = 1 << 20  # bytes of text worked on at a time
DOCS = 2000  # documents that a Python worker gets at a time

#: Bytes of words: letters, digits and all of other scripts; punctuation and space part words. ``_texts`` leaves of
#: other characters only letters, marks and digits, and parts the letters of scripts without spaces.
LETTERS = np.zeros(256, bool)
LETTERS[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    LETTERS[_c] = True


OTHER = r"[^\x00-\x7f\p{L}\p{M}\p{N}]"
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def _texts(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of about ``CHUNK`` bytes of a string array."""
    data, offsets = buffers(column)
    for a, b in pieces(offsets, CHUNK):
        own, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        if own.size and own.max() > 127:
            plain = pc.replace_substring_regex(column.slice(a, b - a).cast(pa.large_string()), OTHER, " ")
            own, at = buffers(pc.replace_substring_regex(plain, UNSPACED, r" \1 "))
        yield a, own, at


def _sketch_matrix() -> np.ndarray:
    return np.random.default_rng(5).normal(size=(FEATURES, SKETCH)).astype(np.float32)


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(53)).astype(np.int64)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: number of passages, passages with each feature, and co-occurrences times the random matrix."""
    omega = _sketch_matrix()
    passages, frequency = 0, np.zeros(FEATURES)
    sketch = np.zeros((FEATURES, SKETCH))
    for batch in batches:
        for _, data, offsets in _texts(batch.column(0)):
            hashes, _, _, first = word_hashes(data, offsets, LETTERS)
            if not len(hashes):
                continue
            words = np.diff(first)
            many = -(-words // PASSAGE)
            base = np.cumsum(many) - many
            doc = np.repeat(np.arange(len(words)), words)
            row = base[doc] + (np.arange(len(hashes)) - first[doc]) // PASSAGE
            cell = row * FEATURES + _feature(hashes)
            n = int(many.sum())
            for start in range(0, n, 512):
                end = min(n, start + 512)
                lo, hi = np.searchsorted(row, [start, end])
                counts = np.bincount(cell[lo:hi] - start * FEATURES, minlength=(end - start) * FEATURES)
                counts = counts.reshape(end - start, FEATURES).astype(np.float32)
                frequency += np.count_nonzero(counts, axis=0)
                sketch += counts.T @ (counts @ omega)
            passages += n
    yield pa.RecordBatch.from_arrays(
        [pa.array([np.concatenate([[passages], frequency, sketch.ravel()]).tobytes()], pa.binary())], names=["part"])


@dataclass
class LatentSpace:
    """fold: (FEATURES, RANK), what a word adds to its passage's place, inverse document frequency included."""

    fold: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text") -> LatentSpace:
        """From all passages of all documents. Partial sums are added up by tasks before they reach the driver."""
        texts = docs.select(F.lower(F.col(text_col)).alias("text"))
        total = tree_sum(texts, 1 + FEATURES * (1 + SKETCH), DOCS, releasing(_statistics))
        return cls(cls._decompose(total[0], total[1:1 + FEATURES], total[1 + FEATURES:].reshape(FEATURES, SKETCH)))

    @staticmethod
    def _decompose(passages: float, frequency: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """Single-pass randomised decomposition: the sketch of the co-occurrences gives them in factors, to which the
        inverse document frequencies are applied; singular vectors over singular values fold passages in."""
        idf = np.log((passages + 1) / (frequency + 1)) + 1
        omega = _sketch_matrix().astype(float)
        if not sketch.any():
            return np.zeros((FEATURES, RANK), np.float32)
        core = omega.T @ sketch
        core = (core + core.T) / 2
        value, vector = np.linalg.eigh(core)
        ok = value > 1e-10 * value.max()
        factor = sketch @ (vector[:, ok] / np.sqrt(value[ok]))
        u, s, _ = np.linalg.svd(idf[:, None] * factor, full_matrices=False)
        k = min(RANK, int((s > 1e-3 * s[0]).sum()))
        out = np.zeros((FEATURES, RANK))
        out[:, :k] = u[:, :k] / s[:k] * idf[:, None]
        return (out / np.abs(out).max()).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None], 1e-12)


@dataclass
class Passages:
    """Benchmark passages: ids, word hashes, answer word hashes (may be empty)."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Passages:
        """rows: (item id, text, answer or None). Without an answer, a passage's last sentence is taken for it."""
        ids, words, answers = [], [], []
        for item, text, answer in rows:
            own = _words(text or "")
            if len(own):
                ids.append(item)
                words.append(own)
                if answer is None:
                    answer = (text or "").rstrip(" .!?\n").replace("?", ".").replace("!", ".").rpartition(".")[2]
                answers.append(_words(answer))
        return cls(ids, words, answers)


def _words(text: str) -> np.ndarray:
    column = pa.array([text.encode("utf-8", "replace").decode()])
    return np.concatenate([np.zeros(0, np.uint64), *[word_hashes(data, at, LETTERS)[0] for _, data, at in _texts(column)]])


def common_subsequence(masks: dict[int, int], length: int, text: list[int]) -> int:
    """Length of the longest common subsequence of ``text`` and the sequence whose words' places are in ``masks``."""
    full = (1 << length) - 1
    row = full
    for word in text:
        hit = masks.get(word)
        if hit is not None:
            taken = row & hit
            row = ((row + taken) | (row - taken)) & full
    return length - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _least(share: float, words: np.ndarray) -> np.ndarray:
    """Least whole numbers that are this share of ``words``."""
    low = np.floor(share * words).astype(np.int64)
    return np.where(low / np.maximum(words, 1) >= share, low, low + 1)


def _table(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int32)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


class Group:
    """Passages that are looked for together: their distinct words in hash buckets, and which passage has which."""

    def __init__(self, items: list[int], passages: Passages):
        own, answers = [passages.words[i] for i in items], [passages.answers[i] for i in items]
        words = np.unique(np.concatenate(own + answers))
        bucket = (words & np.uint64((1 << (4 * len(words)).bit_length()) - 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.items, self.words = np.array(items), words[order]
        self.first = np.searchsorted(bucket[order], np.arange((1 << (4 * len(words)).bit_length()) + 1)).astype(np.int32)
        self.chain = int(np.diff(self.first).max())
        own, answers = [self.rows(w) for w in own], [self.rows(w) for w in answers]
        self.own, self.answers = _table(own), _table(answers)  # rows of the words, then zeros
        self.size, self.answer = (np.array([len(w) for w in x]) for x in (own, answers))
        self.most, self.least = _least(OVERLAP, self.size), _least(PARAPHRASE, self.size)
        self.told = np.where(self.answer > 0, _least(ANSWER, self.answer), 1 << 40)  # no answer, no looser match
        self.step = np.maximum(self.size // 2, 2 * BLOCK)
        self.wide = self.step + (SPAN * self.size).astype(np.int64) + 4 * BLOCK
        pair = np.unique(np.concatenate([w.astype(np.int64) * len(items) + k for x in (own, answers) for k, w in enumerate(x)]))
        row, self.holder = np.divmod(pair, len(items))
        self.postings = np.searchsorted(row, np.arange(len(words) + 2))
        inside = [np.unique(np.concatenate([w.astype(np.int64) * len(items) + k for k, w in enumerate(x)])) for x in (own, answers)]
        self.kind = np.isin(pair, inside[0]) + 2 * np.isin(pair, inside[1])  # bits: in the passage, in its answer
        self.bits = None  # places of a word in a passage
        if self.size.max() <= 64:
            self.bits = np.zeros((len(words) + 1, len(items)), np.uint64)
            for k, w in enumerate(own):
                np.bitwise_or.at(self.bits[:, k], w, np.uint64(1) << np.arange(len(w), dtype=np.uint64))

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Place + 1 of each hash in ``words``, 0 for others."""
        bucket = (hashes & np.uint64(len(self.first) - 2)).astype(np.int64)
        low, high = self.first[bucket], self.first[bucket + 1]
        out = np.zeros(len(hashes), np.int32)
        for k in range(self.chain):
            at = np.flatnonzero(low + k < high)
            at = at[self.words[low[at] + k] == hashes[at]]
            out[at] = low[at] + (k + 1)
        return out

    def stretches(self, rows: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, first word, end, passage) of all windows that can pass the check by the words they hold.

        A document's windows start every half a passage, so a stretch of ``SPAN`` passages lies in one of them. Words
        that are frequent in the text are taken to be found: the others must make up the rest. Passages for which
        that asks nothing have all their words counted.
        """
        words = np.diff(first)
        frequent = np.bincount(rows, minlength=len(self.words) + 1) > max(FREQUENT * len(rows), 4)
        frequent[0] = False
        free = frequent[self.own].sum(axis=1)
        most, least, told = self.most - free, self.least - free, self.told - frequent[self.answers].sum(axis=1)
        sparse = (most > 0) & (np.maximum(least, told) > 0)

        at = np.flatnonzero((rows > 0) & ~frequent[rows])
        many = self.postings[rows[at] + 1] - self.postings[rows[at]]
        pair = ragged(self.postings[rows[at]], many)
        at = np.repeat(at, many)
        keep = sparse[self.holder[pair]]
        at, pair = at[keep], pair[keep]
        k = self.holder[pair]
        doc = np.searchsorted(first, at, side="right") - 1
        place, step, wide = at - first[doc], self.step[k], self.wide[k]
        last = np.maximum(-(-(words[doc] - wide) // step), 0)
        low = np.maximum((place - wide) // step + 1, 0)
        many = np.minimum(last, place // step) - low + 1
        window = ragged(low + first[doc] + doc + k * (len(rows) + len(words)), many)
        found = np.sort(window * 4 + np.repeat(self.kind[pair], many))  # a window's words side by side, with their kinds
        start = np.flatnonzero(np.diff(found >> 2, prepend=-1))
        held, answer = (np.add.reduceat(found >> bit & 1, start) if len(start) else start for bit in (0, 1))
        k, window = np.divmod(found[start] >> 2, len(rows) + len(words))
        ok = (held >= most[k]) | (held >= least[k]) & (answer >= told[k])
        k, window = k[ok], window[ok]
        starts = first[:-1] + np.arange(len(words))
        doc = np.searchsorted(starts, window, side="right") - 1
        low = first[doc] + (window - starts[doc]) * self.step[k]
        yield doc, low, np.minimum(low + self.wide[k], first[doc + 1]), k

        sums = np.zeros((2, len(rows) + 1), np.int64)
        for k in np.flatnonzero(~sparse):
            for out, own in zip(sums, (self.own[k, :self.size[k]], self.answers[k, :self.answer[k]])):
                mine = np.zeros(len(self.words) + 1, bool)
                mine[own] = True
                np.cumsum(mine[rows], out=out[1:])
            many = np.maximum(-(-(words - self.wide[k]) // self.step[k]), 0) + (words > 0)
            doc = np.repeat(np.arange(len(words)), many)
            low = ragged(np.zeros(len(many), np.int64), many) * self.step[k] + first[doc]
            high = np.minimum(low + self.wide[k], first[doc + 1])
            held, answer = sums[:, high] - sums[:, low]
            ok = (held >= self.most[k]) | (held >= self.least[k]) & (answer >= self.told[k])
            yield doc[ok], low[ok], high[ok], np.full(ok.sum(), k)

    def common(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each stretch and its passage, by ``bits``."""
        left = np.full(len(k), ~np.uint64(0))
        for t in range(int((high - low).max())):
            at = low + t
            hit = self.bits[np.where(at < high, rows[np.minimum(at, len(rows) - 1)], 0), k] & left
            left = (left + hit) | (left - hit)
        unused = (64 - self.size[k]).astype(np.uint64)
        return self.size[k] - np.bitwise_count(left << unused).astype(np.int64)


def _groups(passages: Passages) -> list[Group]:
    """Passages of about one length together, as many as the table of their words has room for."""
    out, own, words = [], [], 0
    for i in sorted(range(len(passages.words)), key=lambda i: len(passages.words[i])):
        n, many = len(passages.words[i]), len(passages.words[i]) + len(passages.answers[i])
        if own and ((words + many) * (len(own) + 1) > TABLE or (n > 64) != (len(passages.words[own[0]]) > 64)):
            out.append(Group(own, passages))
            own, words = [], 0
        own.append(i)
        words += many
    return out + ([Group(own, passages)] if own else [])


class Search:
    """Finds the passages in batches of documents."""

    def __init__(self, space: LatentSpace, passages: Passages):
        self.passages = passages
        self.fold = np.concatenate([space.fold, np.zeros((1, RANK), np.float32)])  # the last row pads blocks
        self.sizes = np.array([len(w) for w in passages.words])
        longest = LENGTHS[-1] * BLOCK
        cuts = [(i, a) for i, n in enumerate(self.sizes) for a in range(0, max(n - longest // 2, 1), longest // 2)]
        own = [passages.words[i][a:a + longest] for i, a in cuts]
        self.owner = np.array([i for i, _ in cuts])
        self.places = _unit(np.stack([space.fold[_feature(w)].sum(axis=0) for w in own]))
        self.masks = [_masks(w) for w in passages.words]
        self.answer_masks = [_masks(w) for w in passages.answers]
        self.member = np.zeros((len(passages.ids), 1 << 14), bool)
        for i, w in enumerate(passages.words):
            self.member[i, (w & np.uint64((1 << 14) - 1)).astype(np.int64)] = True
        by: dict[int, list[int]] = {}
        for i, w in enumerate(own):
            blocks = -(-len(w) // BLOCK)
            by.setdefault(max(x for x in LENGTHS if x <= max(blocks, 1)), []).append(i)
        self.classes = {n: np.array(items) for n, items in by.items()}
        self.groups = self.tables = _groups(passages)  # looked for by words; and what checks candidates
        self.group_of, self.at = np.zeros((2, len(passages.ids)), np.int64)
        for g, group in enumerate(self.tables):
            self.group_of[group.items], self.at[group.items] = g, np.arange(len(group.items))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float]]:
        """(document, passage, share of its words) for every passage that a document holds."""
        hashes, _, _, first = word_hashes(data, offsets, LETTERS)
        if not len(hashes):
            return []
        words = np.diff(first)
        blocks = -(-words // BLOCK)
        base = np.concatenate([[0], np.cumsum(blocks)])
        doc = np.repeat(np.arange(len(words)), words)
        padded = np.full(base[-1] * BLOCK, FEATURES)
        padded[base[doc] * BLOCK + np.arange(len(hashes)) - first[doc]] = _feature(hashes)
        sums = np.zeros((base[-1] + 1, RANK), np.float32)
        np.cumsum(self.fold[padded].reshape(-1, BLOCK, RANK).sum(axis=1), axis=0, out=sums[1:])
        of_block = np.repeat(np.arange(len(words)), blocks)
        short = (hashes & np.uint64((1 << 14) - 1)).astype(np.int64)
        best: dict[tuple[int, int], float] = {}
        rows = [group.rows(hashes) for group in self.tables]
        for n, items in self.classes.items():
            step = 1 if n < 8 else 2 if n < 32 else n // 16
            many = -(-blocks // step)  # from every step of each document, and none crosses its end
            at = np.repeat(base[:-1], many) + ragged(np.zeros(len(many), np.int64), many) * step
            windows = _unit(sums[np.minimum(at + n, np.repeat(base[1:], many))] - sums[at])
            cosine = windows @ self.places[items].T
            window, item = np.divmod(np.flatnonzero(cosine >= COSINE), len(items))
            if len(window):
                self._verify(best, at[window], n, self.owner[items[item]], hashes, short, first, base, of_block, rows)
        for group, own in zip(self.groups, rows):
            self._by_words(best, group, own, hashes, first)
        return [(d, i, share) for (d, i), share in best.items()]

    def _by_words(self, best, group: Group, rows: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> None:
        """Check every stretch that holds enough of a passage's words: no common subsequence is longer than their
        count, so no passage is missed that the latent space leaves out."""
        for found in group.stretches(rows, first):
            for a in range(0, len(found[0]), WINDOWS):
                doc, low, high, k = (x[a:a + WINDOWS] for x in found)
                if group.bits is not None:
                    length = group.common(rows, low, high, k)
                    ok = np.flatnonzero(length >= group.least[k])
                    doc, low, high, k, length = doc[ok], low[ok], high[ok], k[ok], length[ok].tolist()
                for j, (d, i) in enumerate(zip(doc.tolist(), group.items[k].tolist())):
                    if best.get((d, i), 0) < 1:
                        text, n = hashes[low[j]:high[j]].tolist(), len(self.passages.words[i])
                        own = length[j] if group.bits is not None else common_subsequence(self.masks[i], n, text)
                        self._settle(best, d, i, own / n, text)

    def _settle(self, best, d: int, i: int, share: float, text: list[int]) -> None:
        if share < PARAPHRASE or share <= best.get((d, i), 0):
            return
        if share < OVERLAP:
            answer = len(self.passages.answers[i])
            if not answer or common_subsequence(self.answer_masks[i], answer, text) < ANSWER * answer:
                return
        best[d, i] = share

    def _verify(self, best, block, n, item, hashes, short, first, base, of_block, rows) -> None:
        """Check windows of ``n`` blocks, with half as many words more on both sides, against their passage; around
        a piece of a long passage, 1.5 times the passage's words more."""
        doc = of_block[block]
        start = first[doc] + (block - base[doc]) * BLOCK
        size = self.sizes[item]
        margin = np.where(size > LENGTHS[-1] * BLOCK, size * 3 // 2, (n * BLOCK) // 2 + BLOCK)
        low = np.maximum(start - margin, first[doc])
        high = np.minimum(start + n * BLOCK + margin, first[doc + 1])
        sizes = self.sizes
        width = int((high - low).max())
        for a in range(0, len(doc), max(1, (1 << 20) // width)):
            b = a + max(1, (1 << 20) // width)
            place = low[a:b, None] + np.arange(width)
            inside = place < high[a:b, None]
            hits = self.member[item[a:b, None], short[np.minimum(place, len(short) - 1)]] & inside
            # no common subsequence is longer than the words that occur in the passage at all
            some = np.flatnonzero(hits.sum(axis=1) >= PARAPHRASE * sizes[item[a:b]]) + a
            for g in np.unique(self.group_of[item[some]]).tolist():
                group, own = self.tables[g], some[self.group_of[item[some]] == g]
                if group.bits is not None:
                    k = self.at[item[own]]
                    length = group.common(rows[g], low[own], high[own], k)
                    enough = length >= group.least[k]
                    own, length = own[enough], length[enough].tolist()
                for j, w in enumerate(own.tolist()):
                    d, i = int(doc[w]), int(item[w])
                    if best.get((d, i), 0) < 1:
                        text, size = hashes[low[w]:high[w]].tolist(), int(sizes[i])
                        common = length[j] if group.bits is not None else common_subsequence(self.masks[i], size, text)
                        self._settle(best, d, i, common / size, text)


def search_udf(search: Search):
    """Column function: text -> array of (item_id, share)."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))

    @F.arrow_udf("array<struct<item_id:bigint,share:double>>")
    def find(text: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(text))]
        for a, data, offsets in _texts(text):
            for d, i, share in search.run(data, offsets):
                out[a + d].append({"item_id": search.passages.ids[i], "share": share})
        release()
        return pa.array([sorted(x, key=lambda m: m["item_id"]) for x in out], kind)

    return find


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", answer_col: str | None = None, into: str = "leaks") -> DataFrame:
    """``docs`` with an array column ``into`` of (item_id, share): the benchmark passages each document holds.

    A document holds a passage of n words if some stretch of at most ``SPAN`` * n of its words has a longest common
    subsequence with the passage of at least ``OVERLAP`` * n words; or of at least ``PARAPHRASE`` * n words, if the
    stretch also has a common subsequence with the passage's answer of at least ``ANSWER`` of the answer's words (the
    answer column, else the passage's last sentence). Words are runs of letters and digits without regard to case, and
    single characters in scripts without spaces. ``share`` is the largest found. Stretches a little longer may match too.

    The benchmark is the query set; it is searched in blocks of ``ITEMS`` passages against all documents, ``BLOCKS`` blocks
    a pass, so neither the driver nor a task ever holds more than a pass's passages. Null or
    empty texts and passages hold and match nothing; passages that repeat are all listed; a null item id is listed
    as null. An empty benchmark leaves every array empty.
    """
    space = LatentSpace.fit(docs, text_col)
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    rows = (tuple(r) for r in benchmark.select(F.col(item_col).cast("long"), F.lower(F.col(item_text)), F.lower(answer)).toLocalIterator())

    def searches(rows: Iterator[tuple]) -> list[Search]:
        blocks = (Passages.of(list(islice(rows, ITEMS))) for _ in range(BLOCKS))
        return [Search(space, p) for p in blocks if p.ids]

    def found(own: list[Search], text: Column) -> Column:
        text = F.lower(F.coalesce(text, F.lit("")))
        none = F.array().cast("array<struct<item_id:bigint,share:double>>")
        return F.concat(*[search_udf(s)(text) for s in own]) if own else none

    own, more = searches(rows), next(rows, None)
    if more is None:
        return docs.withColumn(into, found(own, F.col(text_col)))
    keyed = cut_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                  F.monotonically_increasing_id().alias("n")), DOCS)
    parts = [cut_table(keyed.select("n", found(own, F.col(f"row.`{text_col}`")).alias("leaks")).filter(F.size("leaks") > 0), DOCS)]
    while more is not None:
        rows = chain([more], rows)
        own, more = searches(rows), next(rows, None)
        parts.append(cut_table(keyed.select("n", found(own, F.col(f"row.`{text_col}`")).alias("leaks")).filter(F.size("leaks") > 0), DOCS))
    leaks = reduce(DataFrame.unionByName, parts).groupBy("n").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return keyed.join(leaks, "n", "left").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns],
                                                 F.coalesce("leaks", found([], F.lit(""))).alias(into))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **columns) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids (ascending), best_share. ``with_leaks`` says what counts; null or
    shared ids are separate rows, an empty table gives an empty result, other columns are ignored."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = with_leaks(own, benchmark, "text", **columns)
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"),
                      F.array_sort(F.array_distinct(F.col("leaks.item_id"))).alias("item_ids"),
                      F.coalesce(F.array_max("leaks.share"), F.lit(0.0)).alias("best_share"))

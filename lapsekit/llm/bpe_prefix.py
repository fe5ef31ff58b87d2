"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a pre-token has one last token. A suffix automaton over all tokens names the tokens
that end at a position, longest first; the one whose pair with the last token before it survives byte-pair merging is
the last token there. Following the last tokens back from the end gives the ids. All new pre-tokens of a chunk
advance together, one position at a time, in numpy. Equal pre-tokens of a worker are encoded once.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lapsekit.llm.common import buffers, pieces, ragged, releasing
from lapsekit.llm.words import BYTE_CHARACTERS

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text encoded at a time.
CHUNK = 2 << 20
#: Pre-tokens a worker remembers; at this many it starts anew, which only costs work.
KEPT = 250_000
#: Pre-tokens of more bytes go through the same recurrence one by one.
LONG = 48
NEVER = np.int32(1 << 30)

#: Fixed values of the byte-level pre-tokenizer: endings cut off after an apostrophe, its white space below OTHER_SCRIPTS.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0]
#: Texts with characters from here on are cut by the tokenizer's own rule, as its Unicode tables may differ from Python's.
OTHER_SCRIPTS = 0x530
LETTER, NUMBER, MARK, SPACE, ODD = range(5)


def _kinds() -> np.ndarray:
    kinds = np.full(OTHER_SCRIPTS + 1, MARK, np.uint8)
    for c in range(OTHER_SCRIPTS):
        kinds[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], MARK)
    kinds[WHITE] = SPACE
    kinds[OTHER_SCRIPTS] = ODD
    return kinds


KINDS = _kinds()


def distinct_strings(data: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings between neighbouring ``cuts`` (the first is 0, the last ``len(data)``), and which each is."""
    n = len(cuts) - 1
    if n <= 0:
        return [], np.zeros(0, np.int64)
    units = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = units.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


class Vocabulary:
    """Tokens of a byte-level vocabulary file as arrays: bytes, halves, birth order, automaton."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = (spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("ignore_merges")
                 and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]))
        if not plain:
            raise ValueError(f"{name} is not a plain byte-level vocabulary")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in BYTE_CHARACTERS.items()}
        ids = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            self.bytes[i] = token
        self.lengths = np.array([len(t) for t in self.bytes], np.int32)
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._births(model["merges"], model["vocab"], ids, size)
        self._automaton(ids, size)

    def _births(self, merges: list, names: dict[str, int], ids: dict[bytes, int], size: int) -> None:
        """left, right and born (0 for bytes, else 1 + the merge's place); ``keys``/``times`` list all merges by pair."""
        pairs = np.array([[names[x] for x in (m if isinstance(m, list) else m.split(" "))] for m in merges], np.int64)
        made = np.array([ids[self.bytes[a] + self.bytes[b]] for a, b in pairs], np.int64)
        self.left, self.right, self.born = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for k in range(len(made) - 1, -1, -1):  # the first merge that makes a token counts
            self.left[made[k]], self.right[made[k]], self.born[made[k]] = pairs[k, 0], pairs[k, 1], k + 1
        self.size = size
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.times = keys[order], (order + 1).astype(np.int32)
        self.merge_time = dict(zip(keys.tolist(), range(1, len(keys) + 1)))

    def _automaton(self, ids: dict[bytes, int], size: int) -> None:
        """States are prefixes of tokens. ``branch`` finds the state one byte longer, ``suffix`` the longest proper suffix
        that is a state, ``longest`` the longest token that ends a state, ``shorter`` the longest token that is a
        proper suffix of a token (-1: none)."""
        number: dict[bytes, int] = {b"": 0}
        for token in ids:
            for k in range(1, len(token) + 1):
                number.setdefault(token[:k], 0)
        order = sorted(number, key=len)
        number = {s: i for i, s in enumerate(order)}
        self.branch = {number[s[:-1]] << 8 | s[-1]: i for i, s in enumerate(order) if i}
        self.longest, self.shorter = np.full(len(order), -1, np.int32), np.full(size, -1, np.int32)
        self.suffix = np.zeros(len(order), np.int32)
        for i, state in enumerate(order):  # shorter states first, so a suffix is whole before it is read
            if len(state) > 1:
                self.suffix[i] = self.next_state(int(self.suffix[number[state[:-1]]]), state[-1])
            own = ids.get(state, -1)
            if own >= 0:
                self.shorter[own] = self.longest[self.suffix[i]]
            self.longest[i] = own if own >= 0 else self.longest[self.suffix[i]]
        keys = np.array(sorted(self.branch), np.int32)
        self.branch_keys, self.branch_ends = keys, np.array([self.branch[k] for k in keys.tolist()], np.int32)
        self.first = np.zeros(256, np.int32)
        for byte in range(256):
            self.first[byte] = self.branch.get(byte, 0)

    def next_state(self, state: int, byte: int) -> int:
        """Longest suffix of the state and the byte that is a state."""
        while (found := self.branch.get(state << 8 | byte)) is None:
            if not state:
                return 0
            state = int(self.suffix[state])
        return found

    def next_states(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.first[byte]  # where no longer suffix goes on
        at = np.flatnonzero(state)
        state = state[at]
        while len(at):
            key = state << 8 | byte[at]
            place = np.minimum(np.searchsorted(self.branch_keys, key), len(self.branch_keys) - 1)
            found = self.branch_keys[place] == key
            out[at[found]] = self.branch_ends[place[found]]
            at, state = at[~found], self.suffix[state[~found]]
            go = state > 0
            at, state = at[go], state[go]
        return out

    def _times(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """When byte-pair merging would join the tokens; NEVER without such a merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.times[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of the two tokens leaves exactly these two: no merge joins parts across their border.

        Merging is run backwards: of the two parts at the border, the one born later splits into its halves. A merge
        across comes first if its time is before the left part is taken up by its whole, or no later than the right
        one is (of equal merges the leftmost comes first).
        """
        out = np.ones(len(left), bool)
        at = np.arange(len(left))
        x, y = left.copy(), right.copy()
        until_x, until_y = np.full(len(x), NEVER), np.full(len(y), NEVER)
        while len(at):
            across = self._times(x, y)
            clash = (across < until_x) & (across <= until_y) & (across != NEVER)
            out[at[clash]] = False
            born_x, born_y = self.born[x], self.born[y]
            go = ~clash & ((born_x > 0) | (born_y > 0))
            at, x, y, until_x, until_y, born_x, born_y = (v[go] for v in (at, x, y, until_x, until_y, born_x, born_y))
            back_x = born_x > born_y
            until_x, until_y = np.where(back_x, born_x, until_x), np.where(back_x, until_y, born_y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return out

    def last_tokens(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Last token of every prefix of the pre-tokens ``data[starts[i]:starts[i] + lengths[i]]``, at its last byte."""
        last = np.zeros(len(data), np.int32)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.zeros(len(starts), np.int32)
        active = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1 if len(lengths) else 1), side="right")
        for position, n in enumerate(active.tolist()):
            at = starts[:n] + position
            state = self.next_states(state[:n], data[at])
            token = self.longest[state]
            while len(at):
                size = self.lengths[token]
                whole = size == position + 1
                fits = whole.copy()
                rest = np.flatnonzero(~whole)
                fits[rest] = self.compatible(last[at[rest] - size[rest]], token[rest])
                last[at[fits]] = token[fits]
                at, token = at[~fits], self.shorter[token[~fits]]
                if len(token) and token.min() < 0:
                    raise ValueError("the vocabulary's merges leave a prefix without a last token")
        return last

    def _one_compatible(self, x: int, y: int) -> bool:
        until_x = until_y = int(NEVER)
        while True:
            across = self.merge_time.get(x * self.size + y)
            if across is not None and across < until_x and across <= until_y:
                return False
            born_x, born_y = int(self.born[x]), int(self.born[y])
            if not born_x and not born_y:
                return True
            if born_x > born_y:
                until_x, x = born_x, int(self.right[x])
            else:
                until_y, y = born_y, int(self.left[y])

    def encode_long(self, pretoken: bytes) -> list[int]:
        """Ids of one pre-token by the same recurrence, for those too long for steps over all of a chunk."""
        last, state, seen = [], 0, {}
        for position, byte in enumerate(pretoken):
            state = self.next_state(state, byte)
            token = int(self.longest[state])
            while True:
                size = int(self.lengths[token])
                if size == position + 1:
                    break
                pair = (last[position - size], token)
                fits = seen.get(pair)
                if fits is None:
                    fits = seen[pair] = self._one_compatible(*pair)
                if fits:
                    break
                token = int(self.shorter[token])
                if token < 0:
                    raise ValueError("the vocabulary's merges leave a prefix without a last token")
            last.append(token)
        ids, end = [], len(pretoken)
        while end:
            ids.append(last[end - 1])
            end -= int(self.lengths[ids[-1]])
        return ids[::-1]

    def encode_many(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        short = lengths <= LONG
        data = np.frombuffer(b"".join(p for p, s in zip(pretokens, short.tolist()) if s), np.uint8)
        own = lengths[short]
        ends = np.cumsum(own)
        last = self.last_tokens(data, ends - own, own)
        counts, back = np.zeros(len(own), np.int64), []
        at, which = ends.copy(), np.arange(len(own))
        while len(at):  # one token back from the end in every pre-token that has more
            token = last[at - 1]
            back.append((which, token))
            counts[which] += 1
            at = at - self.lengths[token]
            more = at > (ends - own)[which]
            at, which = at[more], which[more]
        total = np.zeros(len(pretokens), np.int64)
        total[short] = counts
        long = {i: self.encode_long(pretokens[i]) for i in np.flatnonzero(~short).tolist()}
        for i, ids in long.items():
            total[i] = len(ids)
        ids_end = np.cumsum(total)
        flat = np.zeros(int(ids_end[-1]) if len(ids_end) else 0, np.uint32)
        place = ids_end[short]
        for k, (which, token) in enumerate(back):
            flat[place[which] - 1 - k] = token
        for i, ids in long.items():
            flat[ids_end[i] - len(ids):ids_end[i]] = ids
        return flat, total


class Encoder:
    """Ids of texts; remembers pre-tokens."""

    def __init__(self, name: str, special: bool = True):
        self.vocabulary = Vocabulary(name)
        self.special = self.vocabulary.special if special else {}  # strings that are tokens of their own
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def _learn(self, pretokens: list[bytes]) -> None:
        flat, lengths = self.vocabulary.encode_many(pretokens)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(flat)
        self.known.update(zip(pretokens, range(len(self.known), len(self.known) + len(pretokens))))

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where pre-tokens begin, and the end.

        A run of letters, of numbers or of other marks takes one blank before it along; white space before that is one
        pre-token; an apostrophe that starts a pre-token takes one of ENDINGS along and no more.
        """
        if not len(data):
            return np.zeros(1, np.int64)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        code = data[at].astype(np.int32)
        two = np.flatnonzero((code >= 0xC0) & (code < 0xE0))
        code[two] = ((code[two] & 0x1F) << 6) | (data[np.minimum(at[two] + 1, len(data) - 1)] & 0x3F)
        code[data[at] >= 0xE0] = OTHER_SCRIPTS
        kind = KINDS[np.minimum(code, OTHER_SCRIPTS)]
        n = len(at)
        first = np.zeros(n + 3, bool)
        docs = np.searchsorted(at, offsets)
        first[docs] = True
        mark = first.copy()
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        change = change[~first[change]]
        after = change[kind[change - 1] == SPACE]
        mark[after - 1] = True
        joined = code[after - 1] == 32
        mark[after[~joined]] = True
        mark[change[kind[change - 1] != SPACE]] = True
        quote = np.flatnonzero((code == ord("'")) & mark[:n])
        quote = quote[(quote + 1 < n) & ~first[quote + 1]]
        padded = np.concatenate([code, [0, 0, 0]])
        for ending in ENDINGS:
            hit = quote[(padded[quote + 1] == ord(ending[0])) & ((padded[quote + 2] == ord(ending[-1])) if len(ending) == 2 else True)]
            if len(ending) == 2:
                hit = hit[~first[hit + 2]]
            mark[hit + 1] = False
            mark[hit + 1 + len(ending)] = True
        if (odd := np.flatnonzero(kind == ODD)).size:
            for i in np.unique(np.searchsorted(docs, odd, side="right") - 1).tolist():
                text = data[offsets[i]:offsets[i + 1]].tobytes().decode()
                mark[docs[i]:docs[i + 1]] = False
                mark[docs[i] + np.array([a for _, (a, _) in self.vocabulary.split(text)], np.int64)] = True
        return np.append(at[np.flatnonzero(mark[:n])], len(data))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in ``data``, and where each document's begin (n + 1)."""
        raw = data.tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return self.encode(*joined(texts))
        special = [s for s in self.special if s in raw]
        if special:
            return self._encode_special(raw, offsets, special)
        cuts = self.cuts(data, offsets)
        found, which = distinct_strings(data, cuts)
        if len(self.known) + len(found) > KEPT:
            self.forget()
        new = [p for p in found if p not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))[which]
        sizes = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(cuts, offsets)]
        return self.pool[ragged(self.starts[at], sizes)], ends

    def _encode_special(self, raw: bytes, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts that hold special tokens: what lies between them is encoded apart."""
        pattern = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + b")")
        parts: list[bytes] = []
        firsts = [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            parts += pattern.split(raw[a:b])
            firsts.append(len(parts))
        own = np.array([self.special.get(p, -1) for p in parts], np.int64)
        texts = [b"" if s >= 0 else p for p, s in zip(parts, own.tolist())]
        ids, ends = self.encode(*joined(texts))
        at = np.flatnonzero(own >= 0)
        ids = np.insert(ids, ends[at], own[at].astype(np.uint32))
        return ids, (ends + np.concatenate([[0], np.cumsum(own >= 0)]))[np.array(firsts)]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


_workers: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This process's encoder for the vocabulary file."""
    if name not in _workers:
        _workers[name] = Encoder(name)
    return _workers[name]


def binary_rows(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow binary array whose row i is the bytes of ``flat[ends[i]:ends[i + 1]]``."""
    flat = np.ascontiguousarray(flat)
    offsets = np.ascontiguousarray(ends * flat.itemsize, np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, end in pieces(offsets, CHUNK):
                low = offsets[first]
                ids, ends = own.encode(data[low:offsets[end]], offsets[first:end + 1] - low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), binary_rows(ids.astype("<u4"), ends)], names=["doc_id", "ids"])

    return releasing(run)


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name).vocabulary
        pool, lengths = own.pool, own.lengths.astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, end in pieces(offsets, CHUNK):
                ids = np.frombuffer(data[offsets[first]:offsets[end]].tobytes(), "<u4").astype(np.int64)
                if len(ids) and ids.max() >= len(lengths):
                    raise ValueError(f"{int(ids.max())} is no id of {name}")
                sizes = lengths[ids]
                flat = pool[ragged(starts[ids], sizes)]
                ends = np.concatenate([[0], np.cumsum(sizes)])[(offsets[first:end + 1] - offsets[first]) // 4]
                texts = [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(texts, pa.string())],
                                                 names=["doc_id", "text"])

    return releasing(run)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Ids of every whole text: doc_id, ids (little-endian unsigned 32-bit integers).

    The ids are those of the tokenizers library with this byte-level file and no special tokens added; a special
    token's string in a text is that token. A null or empty text has no ids. Rows are separate whatever their ids
    (null and shared ones too), other columns are ignored, an empty table gives an empty result. Bytes that are not
    UTF-8 count as U+FFFD.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_encode(vocabulary), "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts of ids as ``bpe_encode`` gives them: doc_id, text. Special tokens stay as their strings, bytes that form no
    character become U+FFFD, null or empty ids are the empty text, and an id outside the vocabulary is an error."""
    rows = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("binary").alias("ids"))
    return rows.mapInArrow(_decode(vocabulary), "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Encode every text and decode the ids again, in one pass: doc_id, ids, text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for coded in _encode(vocabulary)(batches):
            plain = pa.Table.from_batches(_decode(vocabulary)(iter([coded])))
            yield pa.RecordBatch.from_arrays([coded.column(0), coded.column(1), plain.column("text").combine_chunks()],
                                             names=["doc_id", "ids", "text"])

    return rows.mapInArrow(run, "doc_id long, ids binary, text string")

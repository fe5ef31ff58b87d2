"""Token ids of texts, word by word: each distinct word of a batch is tokenized once."""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np
import regex

from lapsekit.llm.common import ragged, word_hashes

#: Words and pre-tokens a worker remembers. At this many it forgets the words that it met in one call only, and all
#: pre-tokens. Both only save work.
WORDS_KEPT, PRETOKENS_KEPT = 900_000, 500_000

#: True for bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Fixed value of the vocabulary file: its pre-token pattern. A space is added, to tell words apart.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")


def _byte_characters() -> dict[int, str]:
    """Byte-level alphabet, as ``str.translate`` takes it: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARACTERS = _byte_characters()


class WordIds:
    """Ids by a tokenizer that drops white space and never joins tokens across it, as ``word_bpe_49k.json`` does.

    Such a tokenizer's ids of a text are those of its words in order. Words are told apart by a 64-bit hash with A-Z
    lower-cased, since the tokenizer lower-cases too.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special_bytes = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pre: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)  # met in a later call than the one that added or last kept them
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def _forget(self) -> None:
        """Keep the words met again, if they leave half of the table free, and none otherwise."""
        if 2 * self.again.sum() > WORDS_KEPT:
            return self.clear()
        lengths = self.lengths[self.again]
        flat = self.pool[ragged(self.starts[self.again], lengths)]
        self.hashes, self.lengths, self.starts = self.hashes[self.again], lengths, np.cumsum(lengths) - lengths
        self.again = np.zeros(len(lengths), bool)
        self.pool[:len(flat)], self.used = flat, len(flat)

    def _pretokens(self, found: list[str]) -> np.ndarray:
        """Indices of pre-tokens in the table; 0 is the space."""
        if len(self.pre) > PRETOKENS_KEPT or not self.pre:
            self.pre, self.pre_lengths, self.pre_pool = {" ": 0}, np.zeros(1, np.int64), np.zeros(0, np.uint32)
        new = list(set(found).difference(self.pre))
        tokenize = self.tokenizer.model.tokenize
        texts = [p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARACTERS) for p in new]
        ids = [[t.id for t in tokenize(text)] for text in texts]
        self.pre.update(zip(new, range(len(self.pre), len(self.pre) + len(new))))
        self.pre_lengths = np.concatenate([self.pre_lengths, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.pre_pool = np.concatenate([self.pre_pool, np.fromiter(chain.from_iterable(ids), np.uint32)])
        get = self.pre.__getitem__
        return np.fromiter(map(get, found), np.int64, len(found))

    def _direct(self, texts: list[bytes]) -> list[list[int]]:
        """Ids by the tokenizer itself, a few texts at a time: its results are large."""
        out: list[list[int]] = []
        for i in range(0, len(texts), 256):
            part = [t.decode("utf-8", "replace") for t in texts[i:i + 256]]
            out += [e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
        return out

    def _odd(self, text: bytes) -> bool:
        """A capital sigma, whose small form depends on its place; a special token; bytes that are not UTF-8."""
        if b"\xce\xa3" in text or b"<|" in text and any(s in text.lower() for s in self.special_bytes):
            return True
        try:
            text.decode()
        except UnicodeDecodeError:
            return True
        return False

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        joined = b" ".join(words).decode()
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined)
        at = self._pretokens(PRETOKEN.findall(joined.lower()))
        own = self.pre_lengths[at]
        flat = self.pre_pool[ragged((np.cumsum(self.pre_lengths) - self.pre_lengths)[at], own)]
        ends = np.cumsum(own)[np.append(np.flatnonzero(at == 0), len(at) - 1)]
        return flat, np.diff(np.concatenate([[0], ends]))

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Add words to the table; hashes are sorted."""
        if self._odd(b" ".join(words)):
            odd = np.array([self._odd(w) for w in words])
            if not odd.all():
                self._learn(hashes[~odd], [w for w, o in zip(words, odd) if not o])
            hashes = hashes[odd]
            ids = self._direct([w for w, o in zip(words, odd) if o])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        else:
            flat, lengths = self._plain(words)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(flat)] = flat
        at = np.searchsorted(self.hashes, hashes)  # both are sorted
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(lengths) - lengths)
        self.lengths = np.insert(self.lengths, at, lengths)
        self.again = np.insert(self.again, at, False)
        self.used += len(flat)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct word hashes (sorted), the place in them of every word, the first word of each document (n + 1),
        and the place of each distinct word in this object's table, which holds its ids until the next call."""
        hashes, start, end, first = word_hashes(data, offsets, NOT_SPACE)
        order = np.argsort(hashes)
        ranked = hashes[order]
        first_of = np.ones(len(ranked), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=first_of[1:])
        distinct, index = ranked[first_of], order[first_of]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(first_of) - 1
        if len(self.hashes) + len(distinct) > WORDS_KEPT:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct
            self.again[at[~new]] = True
        if new.any():
            raw = data.tobytes()
            places = index[new]
            words = [raw[a:b] for a, b in zip(start[places].tolist(), end[places].tolist())]
            self._learn(distinct[new], words)
            at = np.searchsorted(self.hashes, distinct)
        return distinct, which, first, at

    def ids(self, at: np.ndarray) -> np.ndarray:
        """Ids of the table's words ``at``, one after the other."""
        return self.pool[ragged(self.starts[at], self.lengths[at])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in ``data``, and where each document's begin (n + 1)."""
        _, which, first, at = self.split(data, offsets)
        at = at[which]
        ends = np.concatenate([[0], np.cumsum(self.lengths[at])])[first]
        ids = self.ids(at)
        raw = data.tobytes().lower()
        if any(s in raw for s in self.special_bytes):  # a special token's case matters, which the words' hash drops
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if any(s in raw[a:b] for s in self.special_bytes):
                    parts[i] = np.array(self._direct([data[a:b].tobytes()])[0], np.uint32)
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ids, ends


_workers: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """This process's object for the vocabulary file."""
    if vocabulary not in _workers:
        _workers[vocabulary] = WordIds(vocabulary)
    return _workers[vocabulary]

"""Language ID with a byte convolutional network trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows; each filter's largest response in a window
feeds a softmax over the languages. A document's prediction is the mean over all its windows, by their bytes.
A filter of width w is w tables of 256 numbers, one a position, so applying it is looking bytes up and adding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.llm.common import buffers, pieces, release

WIDTHS = (2, 3, 4)
FILTERS = 16  # a width
WINDOW = 256
UNKNOWN = "und"
#: Training documents a language, and characters of each: the bounds of the sample.
PER_LANGUAGE, SAMPLE_CHARACTERS = 400, 1 << 17
BATCH_BYTES = 1 << 19


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    table[ord("0"):ord("9") + 1] = ord("0")
    table[[9, 10, 11, 12, 13]] = 32
    return table


FOLD = _fold()


@dataclass
class ByteConvNet:
    """filters[w]: (w, 256, FILTERS); bias[w]: (FILTERS,); weights: (3 * FILTERS, languages); offset: (languages,)."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> ByteConvNet:
        k = len(WIDTHS) * FILTERS
        return cls(languages, {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
                   {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
                   rng.normal(0, 1 / np.sqrt(k), (k, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, tables of byte pairs (65,536 rows) and, for an odd width, of the last byte."""
        out = {}
        for w, f in self.filters.items():
            pairs = [(f[i][:, None, :] + f[i + 1][None, :, :]).reshape(65536, FILTERS) for i in range(0, w - 1, 2)]
            out[w] = pairs + ([f[w - 1]] if w % 2 else [])
        return out

    def scores(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Probabilities (windows x languages)."""
        codes = (windows[:, :-1].astype(np.uint16) << 8) | windows[:, 1:]
        peaks = []
        for w, parts in tables.items():
            n = windows.shape[1] - w + 1
            total = parts[0][codes[:, :n]]
            for i, part in enumerate(parts[1:], 1):
                at = codes[:, 2 * i:2 * i + n] if len(part) > 256 else windows[:, 2 * i:2 * i + n]
                total += part[at]
            peaks.append(np.maximum(total.max(axis=1) + self.bias[w], 0))
        return _softmax(np.concatenate(peaks, axis=1) @ self.weights + self.offset)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class _Adam:
    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-6)


def train(texts: list[bytes], labels: list[str], steps: int = 700, batch: int = 96, seed: int = 0) -> ByteConvNet:
    """Fit on random windows of whole texts, languages in equal parts; windows of all lengths, so short texts fit."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    by = [[i for i, x in enumerate(labels) if x == name] for name in languages]
    net = ByteConvNet.new(languages, rng)
    arrays = [*net.filters.values(), *net.bias.values(), net.weights, net.offset]
    adam = _Adam(arrays, 0.01)
    folded = [FOLD[np.frombuffer(t, np.uint8)] for t in texts]
    for _ in range(steps):
        target = rng.integers(len(languages), size=batch)
        x = np.full((batch, WINDOW), 32, np.uint8)
        for row, c in enumerate(target):
            own = folded[by[c][rng.integers(len(by[c]))]]
            size = int(min(len(own), WINDOW if rng.random() < 0.6 else rng.integers(8, WINDOW)))
            at = int(rng.integers(len(own) - size + 1))
            x[row, :size] = own[at:at + size]
        peaks, tops = [], []
        for w, f in net.filters.items():
            n = WINDOW - w + 1
            total = f[0][x[:, :n]]
            for i in range(1, w):
                total += f[i][x[:, i:i + n]]
            top = total.argmax(axis=1)  # batch x filters
            peaks.append(np.take_along_axis(total, top[:, None, :], axis=1)[:, 0, :] + net.bias[w])
            tops.append(top)
        peak = np.concatenate(peaks, axis=1)
        hidden = np.maximum(peak, 0)
        prob = _softmax(hidden @ net.weights + net.offset)
        prob[np.arange(batch), target] -= 1
        prob /= batch
        back = (prob @ net.weights.T) * (peak > 0)
        grads_f, grads_b = [], []
        for k, (w, f) in enumerate(net.filters.items()):
            part = back[:, k * FILTERS:(k + 1) * FILTERS].astype(np.float32)
            grad = np.zeros_like(f)
            for i in range(w):  # only the byte under the largest response learns
                np.add.at(grad[i], (x[np.arange(batch)[:, None], tops[k] + i], np.arange(FILTERS)[None, :]), part)
            grads_f.append(grad)
            grads_b.append(part.sum(axis=0))
        adam.step([*grads_f, *grads_b, hidden.T @ prob + 1e-4 * net.weights, prob.sum(axis=0)])
    return net


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int,
                    seed: int = 7) -> tuple[list[bytes], list[str]]:
    """About ``per_language`` labelled documents a language, drawn by a hash of the id over the whole table."""
    ok = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = ok.groupBy(F.col(label_col).alias("label")).count()
    share = {r["label"]: min(1.0, 1.5 * per_language / r["count"]) for r in counts.collect()}
    if not share:
        return [], []
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col(label_col)]
    spare = F.greatest(F.length(text_col) - SAMPLE_CHARACTERS, F.lit(0)) + 1  # a longer text gives a stretch drawn by the hash
    text = F.substr(F.col(text_col), (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), spare.cast("long")) + 1).cast("int"), F.lit(SAMPLE_CHARACTERS))
    rows = ok.filter(draw < rate).select(draw.alias("draw"), text.alias("text"), F.col(label_col).alias("label")).collect()
    texts, labels, seen = [], [], dict.fromkeys(share, 0)
    for r in sorted(rows, key=lambda r: (r["draw"], r["label"], r["text"])):
        if seen[r["label"]] < per_language:
            seen[r["label"]] += 1
            texts.append(r["text"].encode("utf-8", "replace"))
            labels.append(r["label"])
    return texts, labels


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> ByteConvNet | None:
    """Net trained on the labelled documents outside the held-out part; None if there are none."""
    texts, labels = training_sample(docs.filter(~held_out(id_col)), id_col, text_col, label_col, per_language)
    return train(texts, labels) if texts else None


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict_udf(net: ByteConvNet | None):
    """Column function (text, has_letter) -> struct(lang, score). ``und`` with score 0 for a text without letters."""
    state = {}

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array, letter: pa.Array) -> pa.Array:
        if net is not None and not state:
            state["tables"] = net.tables()
        data, offsets = buffers(text)
        known = np.asarray(letter.to_pylist(), object) == True  # noqa: E712  (null: no letter)
        known &= net is not None
        langs, scores = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        names = np.array(net.languages, object) if net else np.zeros(0, object)
        step = WINDOW - max(WIDTHS) + 1  # windows overlap, so every filter sees every position
        for first, end in pieces(offsets, BATCH_BYTES):
            if not known[first:end].any():
                continue
            total = np.zeros((end - first, len(names)))
            weight = np.zeros(end - first)
            sizes = np.diff(offsets[first:end + 1])
            many = np.where(sizes > 0, np.maximum(1, -(-(sizes - max(WIDTHS) + 1) // step)), 0)
            doc = np.repeat(np.arange(end - first), many)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            low = offsets[first:end][doc] + nth * step
            size = np.minimum(offsets[first + 1:end + 1][doc] - low, WINDOW)
            padded = np.concatenate([FOLD[data[offsets[first]:offsets[end]]], np.full(WINDOW, 32, np.uint8)])
            view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
            for a in range(0, len(doc), 1024):
                b = a + 1024
                x = view[low[a:b] - offsets[first]]
                x[np.arange(WINDOW) >= size[a:b, None]] = 32
                np.add.at(total, doc[a:b], net.scores(x, state["tables"]) * size[a:b, None])
                np.add.at(weight, doc[a:b], size[a:b])
            total /= np.maximum(weight, 1)[:, None]
            own = known[first:end]
            best = total.argmax(axis=1)
            langs[first:end][own] = names[best][own]
            scores[first:end][own] = np.minimum(total.max(axis=1), 1)[own]
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang", "score"])

    return predict


def with_language(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into`` (lang, score). A null or empty text, or one without letters, is ``und``;
    so is every text if there was nothing to learn from."""
    text = F.col(text_col)
    return docs.withColumn(into, predict_udf(net)(F.coalesce(text, F.lit("")), F.coalesce(text.rlike(r"\p{L}"), F.lit(False))))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (0 to 1). Rows that share an id, or have none, are predicted
    each from its own text; null labels teach nothing; an empty table gives an empty result."""
    net = fit(docs, id_col, text_col, label_col)
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = with_language(own, net)
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))

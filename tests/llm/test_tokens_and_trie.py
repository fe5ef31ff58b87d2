"""Operators 11 to 13 against brute force: every distinct opening, the libraries' own ids, all links of all documents."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from helpers import ODD, corpus, frame
from hypothesis import given, settings, strategies as st

from lapsekit.llm import bpe_prefix, prefix_trie, token_align
from lapsekit.llm.common import buffers

TURNS = "conv_id long, turn long, role string, text string"


# --- operator 11

def brute_trie(rebuilt: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p)).encode()).hexdigest()
    return {(min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], sha(p))
            for p, own in members.items()}


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(t, key=lambda t: t[0])] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def talks(n, seed, hot=0.0):
    rng, rows = np.random.default_rng(seed), []
    for c in range(n):
        same = rng.random() < hot
        for turn in range(3 if same else int(rng.integers(1, 9))):
            rows.append((c, turn, ["user", "assistant"][turn % 2], "the same" if same else f"ü{int(rng.integers(0, 3))}"))
    return rows


def got_trie(spark, rows):
    frame = prefix_trie.with_openings(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)))
    out = prefix_trie.prefix_trie(frame).select(*prefix_trie.RESULT).collect()
    assert len(out) == len(set(map(tuple, out)))
    return {tuple(r) for r in out}


@pytest.mark.parametrize("seed,hot", [(0, 0.0), (1, 0.6)])
def test_trie_is_that_of_all_openings(spark, seed, hot):
    rows = talks(200, seed, hot)
    assert got_trie(spark, rows) == brute_trie(rebuilt(rows))


def test_trie_does_not_depend_on_shards_or_width(spark, monkeypatch):
    rows = talks(150, 2, 0.4)
    rows += [(500, t, "user", f"{t}") for t in range(90)] + [(505, t, "user", f"{t}") for t in range(70)]  # long ones
    want = brute_trie(rebuilt(rows))
    monkeypatch.setattr(prefix_trie, "WIDTH", 2)
    monkeypatch.setattr(prefix_trie, "SHARD", 1 << 10)
    assert got_trie(spark, rows) == want


def test_trie_of_odd_turns(spark):
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 1, None, "a"),
            (4, 2, "u:", ""), (8, 0, "user", None), (8, 1, "user", "x" * 200_000), (-7, 0, "user", "a")]
    clash = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS turns", "2 AS seq", "3 AS base", "4 AS key", "5 AS digest")
    out = prefix_trie.prefix_trie(prefix_trie.sequences(clash)).collect()
    own = collections.defaultdict(list)
    for c, turn, role, text in rows[1:]:
        own[c].append((role or "", text or ""))
    assert {tuple(r[c] for c in prefix_trie.RESULT) for r in out} == brute_trie(own)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert got_trie(spark, []) == set()
    rows = spark.createDataFrame([(2, []), (9, [])], "conv_id long, turns array<struct<turn:long,digest:string,size:long>>")
    assert [tuple(r[c] for c in prefix_trie.RESULT) for r in prefix_trie.prefix_trie(rows).collect()] == [
        (2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,9").hexdigest())]


# --- operator 13

def library(special=False):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = not special
    return out


PARTS = [*"abcdeThe \n\t\r'.,!?123éüßδж中🙂", "  ", "'s", "'ll", "'Re", " the", "<|endoftext|>", "<s>", "▁", " ", "　", "\x1c", "՘", "é", "\r\n\r\n"]
TEXTS = st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=30), max_size=20)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(texts):
    import pyarrow as pa

    ids, ends = bpe_prefix.encoder(bpe_prefix.VOCABULARY).encode(*buffers(pa.array(texts, pa.string())))
    own = library(special=True)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_token_and_pair_of_tokens_is_encoded_as_by_the_library():
    vocabulary = bpe_prefix.encoder(bpe_prefix.VOCABULARY).vocabulary
    rng = np.random.default_rng(5)
    pretokens = [t for t in vocabulary.bytes if t] + [vocabulary.bytes[a] + vocabulary.bytes[b] for a, b in rng.integers(0, 50256, (20_000, 2))]
    flat, counts = vocabulary.encode_many(pretokens)
    names = {b: c for b, c in bpe_prefix.BYTE_CHARACTERS.items()}
    model, at = library().model, 0
    for token, n in zip(pretokens, counts.tolist()):
        if token not in vocabulary.special:
            assert flat[at:at + n].tolist() == [t.id for t in model.tokenize("".join(names[b] for b in token))]
        at += n


def test_long_pretokens_follow_the_same_recurrence():
    vocabulary = bpe_prefix.encoder(bpe_prefix.VOCABULARY).vocabulary
    rng = np.random.default_rng(6)
    for text in [b"a" * 500, b" " * 333, b"ab" * 200, bytes(rng.integers(97, 101, 400, dtype=np.uint8)), b"=" * 4000]:
        ids = vocabulary.encode_long(text)
        names = "".join(bpe_prefix.BYTE_CHARACTERS[b] for b in text)
        assert ids == [t.id for t in library().model.tokenize(names)]


def test_round_trip_of_odd_rows(spark):
    own = library(special=True)
    rows = ODD + [(9, "a <|endoftext|> b<|endoftext|>", None, None, 0)] + corpus(60)
    got = bpe_prefix.bpe_round_trip(frame(spark, rows)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in got) == sorted((x[0] is not None, x[0] or 0, x[1] or "") for x in rows)
    want = collections.Counter((x[0], np.array(own.encode(x[1] or "", add_special_tokens=False).ids, "<u4").tobytes()) for x in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert bpe_prefix.bpe_round_trip(frame(spark, [])).collect() == []


def test_encode_then_decode_are_the_round_trip(spark):
    docs = frame(spark, corpus(30))
    back = bpe_prefix.bpe_decode(bpe_prefix.bpe_encode(docs))
    assert {r.doc_id: r.text for r in back.collect()} == {r[0]: r[1] for r in corpus(30)}
    part = spark.createDataFrame([(1, np.array([447, 35], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in bpe_prefix.bpe_decode(part).collect()} == {1: library().decode([447, 35]), 2: ""}


# --- operator 12

def brute_links(texts):
    import public_tokenizers
    import sentencepiece

    own, pieces = library(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: b for b, c in bpe_prefix.BYTE_CHARACTERS.items()}
    a_bytes = {i: bytes(back[c] for c in t) for t, i in own.get_vocab(with_added_tokens=False).items()}
    spell = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], collections.Counter()
    for text in texts:
        a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        x, y = [a_bytes[i] for i in a], [spell(i) for i in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            docs.append(None)
            continue
        a_ends, b_ends = np.cumsum([len(t) for t in x]).tolist(), np.cumsum([len(t) for t in y]).tolist()
        groups, low = [], 0
        for end in sorted(set(a_ends) & set(b_ends)):
            groups.append(([i for i, e in zip(a, a_ends) if low < e <= end], [i for i, e in zip(b, b_ends) if low < e <= end]))
            low = end
        docs.append((len(a), len(b), groups))
        counts.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    best: dict[int, int] = collections.Counter()
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for g in doc[2] for p in g[0] for q in g[1]]
        out.append((doc[0], doc[1], len(doc[2]), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
                    ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in doc[2])))
    return out


def odd_texts(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(PARTS, int(rng.integers(0, 50)))) for _ in range(n)]


def test_links_are_those_of_all_documents(spark):
    texts = ["", None, " ", "  ", "a ", "\n", " ▁x", "x" * 300, "ab" * 200, " " * 90 + "x", *odd_texts(250, 1), *[r[1] for r in corpus(60)]]
    want = brute_links(texts)
    got = token_align.align_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    got = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_links_do_not_depend_on_chunks(spark, monkeypatch):
    rows = list(enumerate(odd_texts(60, 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    key = lambda f: sorted(map(tuple, f.collect()))
    want = key(token_align.align_tokens(docs))
    monkeypatch.setattr(token_align, "CHUNK", 200)
    assert key(token_align.align_tokens(docs)) == want


def test_links_of_odd_rows(spark):
    out = token_align.align_tokens(frame(spark, ODD), digest=True).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(x[0] for x in ODD)
    assert all((r.groups == "") == (r.n_a == 0) for r in out) and sum(r.n_a == 0 for r in out) == 3
    assert token_align.align_tokens(frame(spark, [])).collect() == []


def test_alignment_chunks_are_small():
    """A worker aligns 1 MB of text at a time, and gets no more than a few such chunks at once."""
    import pyarrow as pa

    text = "and the words of it " * 5000
    rows = pa.RecordBatch.from_arrays([pa.array(list(range(25))), pa.array([text] * 25)], names=["doc_id", "text"])
    chunks = list(token_align._link(token_align.A_FILE, token_align.B_FILE, True)([rows]))
    assert sum(len(c.column(0)[0]) for c in chunks) == 25
    assert max(len(c.column(0)[0]) for c in chunks) * len(text) <= 1 << 20
    assert token_align.DOCS <= 1000 and token_align.KEPT <= 60_000


def test_alignment_workers_stay_small(spark, monkeypatch):
    """No task has two Python workers, which would both live on, and none remembers pieces after its task."""
    import pyarrow as pa

    from lapsekit.llm import common

    nested, cut = [], common.cut_table

    def watched(df, *args):
        nested.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return cut(df, *args)

    monkeypatch.setattr(common, "cut_table", watched)
    monkeypatch.setattr(token_align, "cut_table", watched)
    docs = spark.createDataFrame([(i, f"word {i} of the text") for i in range(20)], "doc_id long, text string")
    assert token_align.align_tokens(docs).count() == 20
    assert max(nested) == 1
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one more text", "and another"])], names=["doc_id", "text"])
    assert len(list(token_align._link(token_align.A_FILE, token_align.B_FILE, True)([rows]))) == 1
    own = token_align.aligner(token_align.A_FILE, token_align.B_FILE)
    assert not own.known and not own.a.known and not own.texts


def test_alignment_learns_pieces_in_parts(monkeypatch):
    own = token_align.aligner(token_align.A_FILE, token_align.B_FILE)
    data, offsets = token_align.joined([f"{w} \u2581 {w}é, {i}" .encode() for i, w in enumerate(["one", "two", "three", "an", "unseen"] * 4)])
    want = own.rows(data, offsets, False)
    own.forget()
    monkeypatch.setattr(token_align, "LEARNED", 3)
    got = own.rows(data, offsets, False)
    assert (got[0] == want[0]).all() and got[1] == want[1] and (got[4] == want[4]).all()
    assert all((x == y).all() for k in (2, 3) for x, y in zip(got[k], want[k]))

"""Each operator against a brute-force version on a small corpus."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import corpus, frame

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").encode().translate(FOLD)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def test_exact_dedup(docs, rows):
    from lapsekit.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(low(r[1])).hexdigest()].append(r[0])
    want = {(i, max(g), len(g), i == max(g), h) for h, g in groups.items() for i in g}
    assert {tuple(r) for r in exact_dedup(docs).collect()} == want
    assert any(len(g) > 1 for g in groups.values())


def test_bloom_pages_have_no_false_negative(spark, docs):
    from lapsekit.llm import exact_dedup as E

    digests = docs.selectExpr("doc_id _id", "doc_id", "unhex(sha2(text, 256)) digest")
    marked = E.mark_possible(digests, E.repeated_pages(digests, 1 << 15), 1 << 15)
    again = {r[0] for r in digests.groupBy("digest").count().filter("count > 1").collect()}
    got = marked.select("digest", "possible").collect()
    assert all(r.possible for r in got if r.digest in again)
    assert sum(r.possible for r in got) < len(got) / 2


def brute_spans(texts, span):
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            gone[i:i + span] |= t[i:i + span] in seen
            seen.add(t[i:i + span])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append([(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])])
    return out


def test_suffix_dedup(docs, rows):
    from lapsekit.llm.suffix_dedup import suffix_dedup

    want = brute_spans([r[1].encode() for r in rows], 100)
    got = {r.doc_id: r for r in suffix_dedup(docs).collect()}
    assert sum(map(len, want)) > 10
    for r, spans in zip(rows, want):
        assert [(s.start, s.end) for s in got[r[0]].spans] == spans
        data = r[1].encode()
        keep = b"".join(data[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(data)]))
        assert bytes(got[r[0]].kept) == keep and got[r[0]].n_bytes == len(data)


def test_suffix_dedup_of_periodic_text(spark):
    from lapsekit.llm.suffix_dedup import suffix_dedup

    rng = np.random.default_rng(1)
    texts = ["a" * 700, "ab" * 300, "x" + "a" * 450, "".join(rng.choice(list("ab"), 900)), "0123456789" * 45, "9" + "0123456789" * 30]
    got = sorted(suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [[(s.start, s.end) for s in r.spans] for r in got] == brute_spans([t.encode() for t in texts], 100)


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array_sorts(letters):
    from lapsekit.llm.suffix_dedup import suffix_array

    text = np.random.default_rng(letters).integers(1, letters + 1, 1500).astype(np.uint8)
    order = suffix_array(text, 100)
    data = text.tobytes()
    assert sorted(order.tolist()) == list(range(1500))
    cut = [data[i:i + 100] for i in order]
    assert cut == sorted(cut)


def brute_simhash(text):
    w = low(text).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = list(range(len(nodes)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(nodes))]


def test_simhash_dedup(docs, rows):
    from lapsekit.llm.simhash import simhash_dedup

    marks = [brute_simhash(r[1]) for r in rows]
    group = brute_components(marks, lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r.doc_id: r for r in simhash_dedup(docs).collect()}
    for r, mark, g in zip(rows, marks, group):
        assert got[r[0]].fingerprint == f"{mark:016x}"
        assert got[r[0]].component_id == rows[g][0]


def test_links_between_fingerprints(spark):
    """Chains of fingerprints 1 to 4 bits apart, dense groups included: the components are those of all pairs."""
    from lapsekit.llm.simhash import components, links

    rng = np.random.default_rng(3)
    marks = set()
    for _ in range(25):
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(int(rng.integers(1, 12))):
            marks.add(x - (1 << 64) if x >= 1 << 63 else x)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
    marks = sorted(marks)
    want = brute_components(marks, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    frame = spark.createDataFrame([(m,) for m in marks], "fp long")
    got = {r.node: r.component for r in components(links(frame)).collect()}
    assert [got.get(m, m) for m in marks] == [marks[g] for g in want]


def brute_lines(rows, min_chars=40, min_docs=5):
    spaces = " \t\n\x0b\x0c\r"
    key = lambda line: low(line.strip(spaces)).decode()
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    return {i: [line for line in (text or "").split("\n") if hot.get(key(line), i) == i] for i, text, *_ in rows}


def test_line_dedup(docs, rows):
    from lapsekit.llm.line_dedup import line_dedup

    want = brute_lines(rows)
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert any(r.n_dropped for r in got.values())
    for i, text, *_ in rows:
        assert got[i].text == "\n".join(want[i])
        assert (got[i].n_lines, got[i].n_dropped) == (text.count("\n") + 1, text.count("\n") + 1 - len(want[i]))


def test_line_dedup_is_reversible(spark, rows):
    """Insert and delete documents: drops are those of a state built from what is left."""
    from lapsekit.llm.line_dedup import build_state, dropped_keys, update_state

    make = lambda part: spark.createDataFrame([(r[0], r[1]) for r in part], "_id long, text string")
    drops = lambda s: {(r._id, tuple(sorted(map(tuple, r["drop"])))) for r in dropped_keys(s).collect()}
    first, rest = build_state(make(rows[:70])), rows[70:]
    both = update_state(first, added=make(rest))
    assert drops(both) == drops(build_state(make(rows))) != drops(first)
    back = update_state(both, removed=make(rest))
    assert drops(back) == drops(first)
    assert sorted(back.counts.collect()) == sorted(first.counts.collect())


def test_cuckoo_filter():
    from lapsekit.llm.line_dedup import CuckooFilter

    keys = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 5000)
    own = CuckooFilter.of(keys[:4000])
    assert own.contains(keys[:4000]).all() and own.contains(keys[4000:]).mean() < 0.02
    own.delete(keys[:2000])
    again = CuckooFilter.from_bytes(own.to_bytes())
    assert again.contains(keys[2000:4000]).all() and again.contains(keys[:2000]).mean() < 0.02


def test_decontaminate(spark, rows):
    from lapsekit.llm.decontaminate import decontaminate

    rng = np.random.default_rng(4)
    items = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)) + ". The answer is so and so." for n in (12, 30, 60, 140)]
    held = {3: (0, items[0].upper()), 11: (1, items[1].replace(" ", ",  ")), 20: (2, items[2]), 41: (3, items[3])}
    words = items[2].split()
    held[50] = (2, " ".join(w for i, w in enumerate(words) if i % 7))  # a paraphrase: one word in seven is gone
    made = [(r[0], r[1] + " " + held[r[0]][1] + " " + rows[0][1] if r[0] in held else r[1], *r[2:]) for r in rows]
    half = " ".join(words[:20])
    made[60] = (60, made[60][1] + " " + half, *made[60][2:])  # a third of a passage is no leak
    benchmark = spark.createDataFrame([*enumerate(items), (9, None), (None, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(frame(spark, made), benchmark).collect()}
    assert {i: r.item_ids for i, r in got.items() if r.contaminated} == {i: [k] for i, (k, _) in held.items()}
    assert len(got) == len(rows)


def test_common_subsequence():
    from lapsekit.llm.decontaminate import _masks, common_subsequence

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, int(rng.integers(1, 90))), rng.integers(0, 6, int(rng.integers(0, 90)))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert common_subsequence(_masks(a), len(a), b.tolist()) == table[-1, -1]


def test_single_pass_svd_of_low_rank_matrix():
    """The folding of a matrix of low rank, found from its sketch, spans the true right singular vectors."""
    from lapsekit.llm import decontaminate as D

    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (300, 20)) @ rng.poisson(0.3, (20, D.FEATURES))
    frequency = (x > 0).sum(axis=0).astype(float)
    fold = D.LatentSpace._decompose(300, frequency, x.T @ (x @ D._sketch_matrix().astype(float)))
    idf = np.log(301 / (frequency + 1)) + 1
    true = np.linalg.svd(x * idf, full_matrices=False)[2][:20]
    span = np.linalg.svd((fold / idf[:, None]).astype(float), full_matrices=False)[0][:, :20]
    assert not fold[:, 20:].any()  # nothing beyond the rank
    assert np.linalg.svd(true @ span)[1].min() > 0.99


def test_language_id(docs, rows):
    from lapsekit.llm.language_id import language_id

    got = {r.doc_id: r for r in language_id(docs).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in out}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in out]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_net_windows():
    """Scores by byte-pair tables equal those of the filters applied one byte at a time."""
    from lapsekit.llm import language_id as L

    rng = np.random.default_rng(0)
    net = L.ByteConvNet.new(["a", "b"], rng)
    x = rng.integers(0, 256, (3, L.WINDOW)).astype(np.uint8)
    peaks = [max(0.0, max(sum(f[i][x[r, t + i], k] for i in range(w)) for t in range(L.WINDOW - w + 1)) + net.bias[w][k])
             for r in range(3) for w, f in net.filters.items() for k in range(L.FILTERS)]
    z = np.array(peaks).reshape(3, -1) @ net.weights + net.offset
    assert np.allclose(net.scores(x, net.tables()), np.exp(z) / np.exp(z).sum(axis=1, keepdims=True), atol=1e-4)


def test_lm_base_score(docs, rows):
    from lapsekit.llm.lm_score import lm_score

    tokens = {r[0]: [*low(r[1]).split(), None] for r in rows}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    count = Counter(t for i, own in tokens.items() if i not in held for t in own)
    total, distinct = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm_score(docs).collect()}
    for i, own in tokens.items():
        r = got[i]
        base = sum(math.log10((count[t] + 1) / (total + 1 * (distinct + 1))) for t in own)
        assert r.base_score == pytest.approx(base) and r.train_tokens == total
        assert (r.n_tokens, r.n_known, r.held_out) == (len(own), sum(count[t] > 0 for t in own), i in held)
    assert sum((c + 1) / (total + distinct + 1) for c in [*count.values(), 0]) == pytest.approx(1)
    # The model spells words that training lacks, for which the base has one probability whatever they are; so it is held
    # against a distribution over the same subwords: their smoothed counts.
    from lapsekit.llm.lm_score import SIZE
    from lapsekit.llm.words import word_ids

    own = word_ids("word_bpe_49k.json")
    ids = {r[0]: own.encode(np.frombuffer((r[1] or "").encode(), np.uint8), np.array([0, len((r[1] or "").encode())]))[0].tolist() for r in rows}
    subwords = Counter(x for i, x in ((i, x) for i in ids if i not in held for x in [*ids[i], None]))
    n = sum(subwords.values())
    unigram = sum(math.log10((subwords[x] + 1) / (n + SIZE)) for i in held for x in [*ids[i], None])
    assert unigram < sum(got[i].score for i in held) < 0


def small_model(seed=0):
    from lapsekit.llm import lm_score as L

    rng = np.random.default_rng(seed)
    class_of = rng.integers(0, L.CLASSES, L.SIZE)
    return L.AttentionModel.new(class_of, L.inner_log(class_of, rng.integers(0, 50, L.SIZE).astype(float)), seed)


def test_lm_windows_score_each_subword_once():
    """Overlapping windows, many documents at once, equal a plain pass over each document token by token."""
    from lapsekit.llm import lm_score as L

    model, rng = small_model(), np.random.default_rng(1)
    model.shared["bias"] = rng.normal(size=2 * L.HALF).astype(np.float32)
    docs = [rng.integers(0, L.SIZE, n) for n in (1, 5, 16, 17, 40, 33)]
    got = L._windows(model, np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    s = {k: v.astype(float) for k, v in model.shared.items()}
    for own, score in zip(docs, got):
        ids = np.concatenate([[L.BEGIN], own[:-1]])
        h = model.embed(ids).astype(float)
        total = 0.0
        for t, goal in enumerate(own):
            low = max(0, t // L.HALF * L.HALF - L.HALF)
            w = np.array([h[t] @ s["query"] @ (h[j] @ s["key"]) / 4 + s["bias"][t - j] for j in range(low, t + 1)])
            w = np.exp(w - w.max())
            z = h[t] + (w / w.sum()) @ (h[low:t + 1] @ s["value"]) @ s["out"]
            z = z + np.maximum(z @ s["up"] + s["up0"], 0) @ s["down"]
            logits = z @ s["top"] + s["top0"]
            total += logits[model.class_of[goal]] - np.log(np.exp(logits).sum()) + model.inner[goal]
        assert score == pytest.approx(total, rel=1e-4)


def test_lm_gradients():
    from lapsekit.llm import lm_score as L

    model, rng = small_model(), np.random.default_rng(2)
    ids, goal = rng.integers(0, L.SIZE, (2, 2 * L.HALF)), rng.integers(0, L.SIZE, (2, L.HALF))
    hidden = np.zeros(ids.shape, bool)
    hidden[0, :7] = True
    _, grads, _ = model.step(ids, goal, hidden)
    for name in L.NAMES:
        x = model.shared[name]
        at = tuple(int(rng.integers(n)) for n in x.shape)
        if name == "classes":
            at = (int(model.class_of[ids[1, 20]]), 3)
        old, diff = x[at], []
        for d in (2e-2, -2e-2):
            x[at] = old + d
            diff.append(model.step(ids, goal, hidden)[0])
        x[at] = old
        assert (diff[0] - diff[1]) / 4e-2 == pytest.approx(grads[name][at], abs=2e-3)


def test_hilbert_curve():
    """Every cell once, and neighbours on the curve differ by one step in one dimension."""
    from lapsekit.llm.hilbert_shard import hilbert_index

    for d, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        index = hilbert_index(cells, bits)
        assert sorted(index.tolist()) == list(range(side ** d))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_hilbert_shards(docs, rows, tmp_path):
    from lapsekit.llm.hilbert_shard import hilbert_shards, write_shards

    out = hilbert_shards(docs).cache()
    got = out.collect()
    shard = defaultdict(list)
    for r in got:
        shard[r.shard].append(r)
        text = rows[r.doc_id][1].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
    sizes = [len(v) for v in shard.values()]
    assert set(shard) == set(range(40)) and max(sizes) - min(sizes) <= 1
    for own in shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in order] == sorted(r.curve_index for r in order)
    place = defaultdict(list)
    for k, r in enumerate(order):
        place[rows[r.doc_id][1]].append(k)
    assert all(max(v) - min(v) == len(v) - 1 for v in place.values())  # equal texts lie side by side
    write_shards(docs.drop("shard"), out, str(tmp_path / "shards"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "shards")).filter("shard = 7").count() == len(shard[7])


def test_best_fit_pack(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lapsekit.llm.packing import best_fit_pack

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1] for r in rows}
    for capacity in (4096, 50):
        got = best_fit_pack(docs, capacity=capacity).collect()
        found, sequence = defaultdict(list), defaultdict(list)
        for r in got:
            found[r.doc_id].append(r)
            sequence[r.sequence_id].append((r.offset, r.length))
            part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == r.piece * capacity
        assert all(sum(r.length for r in found[i]) == len(x) and len(found[i]) == -(-len(x) // capacity) for i, x in ids.items())
        for own in sequence.values():
            own.sort()
            ends = np.cumsum([n for _, n in own])
            assert [a for a, _ in own] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert len(sequence) == plain_best_fit(sorted((r.length for r in got), reverse=True), capacity)


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in lengths:
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_word_ids_equal_the_tokenizer():
    from lapsekit.llm.words import WordIds

    own = WordIds("word_bpe_49k.json")
    texts = [r[1] for r in corpus(40, 3)] + ["", "  ", "don't we'll 12ab3 x<|endoftext|>y", "ΟΔΟΣ ΣΑΣ İx",
                                             "a b é é —!? \U0001f600", "<|ENDOFTEXT|>", "　中文 क्ष"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    ids, ends = own.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert ids[ends[i]:ends[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
        one, end = own.encode(np.frombuffer(data[i], np.uint8), np.array([0, len(data[i])]))
        assert one[:end[-1]].tolist() == ids[ends[i]:ends[i + 1]].tolist()


PAGES = [
    ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li>"
     "<li><a href=/x>News</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy this now.</div><article><h1>A title &amp; more</h1><p><b>First  line&#33;<br>"
     "<p>Second\n paragraph.</p><p>Third.</article><footer>&copy; site &middot; text</footer>", "A title & more\nFirst line!\nSecond paragraph.\nThird."),
    ("<body><header><a href=/>Site</a></header><main><h1>Head</h1><p>Some text of the page here.</p><div class='ad'>Buy.</div><p>More.</p></main>"
     "<aside class=sidebar><h3>Popular</h3><p>Something long that looks like text, with commas, and so on.</p></aside><section class=comments>"
     "<h2>Comments</h2><div class=comment><p>I like this very much, thanks for writing it.</p></div></section><form><label>Mail</label></form></body>",
     "Head\nSome text of the page here.\nMore."),
    ("<p>Just a paragraph.</p><p>Another one.</p>", "Just a paragraph.\nAnother one."), ("<nav><a href=x>Home</a></nav>", ""), ("", ""), (None, "")]


def test_html_extract(spark):
    from lapsekit.llm.html_extract import extract_main_text

    pages = spark.createDataFrame([(i, None if i else "u", h, "own") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert (got[i].text, got[i].n_chars) == (text, len(text))


def test_html_model_on_other_labelled_pages():
    from lapsekit.llm import html_extract as H

    pages, labels = H.labelled_pages(120, seed=99)
    right = [(x > 0) == (y > 0) for p, own in zip(pages, labels) for t, x, y in zip(p.text, H.default_model().marginals(p), own) if t]
    assert np.mean(right) > 0.97


def test_html_messages_are_exact():
    """Marginals by messages equal those summed over all states of the tree."""
    from lapsekit.llm import html_extract as H

    page = H.parse("<div class=a><p>Text one</p><ul><li>x</li></ul></div><footer>y</footer>")
    rng = np.random.default_rng(0)
    names = {f for i in range(len(page.tag)) for f in H.features(page, i)}
    model = H.TreeModel({f: float(rng.normal()) for f in names}, {"text": 0.7, "own": 0.3, "part": 0.5})
    n, top, bottom = len(page.tag), np.zeros(len(page.tag)), 0.0
    own = [sum(model.weights[f] for f in H.features(page, i)) for i in range(n)]
    for bits in range(1 << n):
        s = np.array([1 if bits >> i & 1 else -1 for i in range(n)])
        p = math.exp(sum(s * own) + sum(model.couplings[H.kind(page.tag[i])] * s[i] * s[page.parent[i]] for i in range(1, n)))
        top += p * (s > 0)
        bottom += p
    assert np.allclose(1 / (1 + np.exp(-np.array(model.marginals(page)))), top / bottom)


def test_html_deep_nesting():
    from lapsekit.llm import html_extract as H

    source = "<div>" * 5000 + "deep" + "</div>" * 4000 + "<p>" + "long text " * 50000
    assert "long text" in H.main_text(source, H.default_model())


def test_tree_sum_of_many_parts(spark):
    from lapsekit.llm.common import FAN_IN, tree_sum

    def vectors(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([np.array([ids.sum(), len(ids), 0.0]).tobytes()], pa.binary())], names=["part"])

    n = 3 * FAN_IN
    parts = spark.range(n).repartition(n).mapInArrow(vectors, "part binary")
    assert tree_sum(parts, 3).tolist() == [n * (n - 1) / 2, n, 0]


def test_ranks_cover_every_row_once(spark):
    from pyspark.sql import functions as F

    from lapsekit.llm.common import global_rank

    rows = [(i, i % 3 if i % 2 else 0) for i in range(500)]
    got = global_rank(spark.createDataFrame(rows, "id long, v int").repartition(7), [F.col("v"), F.col("id")]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [i for i, v in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(r["rank"] for r in got) == list(range(500))


def test_lookup_of_a_hot_key(spark):
    from lapsekit.llm.common import salted_lookup

    rows = spark.range(600).selectExpr("id", "case when id % 3 = 0 then 0 else id end AS k")
    table = spark.range(600).selectExpr("id AS k", "id * 2 AS v")
    got = {r["id"]: r["v"] for r in salted_lookup(rows, table, ["k"], "id").collect()}
    assert got == {i: 0 if i % 3 == 0 else 2 * i for i in range(600)}


def page_texts(source):
    from lapsekit.llm.html_extract import parse

    return [t for t in parse(source).text if t]


def test_quotes_in_names_and_values_end_no_text():
    assert page_texts("<p title=it's>Hello world.</p><p>Second one, don't go.</p><p>Third.</p>") == ["Hello world.", "Second one, don't go.", "Third."]
    assert page_texts("<p it's \"x>a</p><p a=\"x>y\" b='\">'>b</p>") == ["a", "b"]
    assert page_texts("<p class=\"open>a</p><p>b</p>") == ["a", "b"]  # never closed: the tag ends at the next >
    assert page_texts("a < b and c > d <3 <") == ["a < b and c > d <3 <"]
    assert page_texts("<p>a<!-- x > y --><p>b<!-- never closed <p>c") == ["a", "b"]


def test_formulas_and_drawings_keep_their_text_in_line():
    source = ("<p>Let <math><mi>e</mi><mo>=</mo><mn>1</mn><annotation>\\e</annotation></math> be "
              "<svg><title>icon</title><path d='M0'/><text>small</text></svg>.</p>")
    assert page_texts(source) == ["Let e=1 be small."]


@pytest.mark.parametrize("piece", ['<a b="', "<a b='\">", "<!", "<textarea>", '<a x=">" ', "</p", "<p title=it's ", "<!--", "<svg "])
def test_pages_are_read_in_linear_time(piece):
    import time

    began = time.time()
    page_texts("<p>a" + piece * 40_000)
    assert time.time() - began < 5


def test_shards_of_a_long_text_with_shared_ids(spark):
    """A text beyond the limit of JSON strings, in a row that shares its id."""
    from pyspark.sql import functions as F

    from lapsekit.llm.hilbert_shard import hilbert_shards

    docs = spark.range(3).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("abcdefg "), 2_700_000))
                                 .when(F.col("id") == 1, F.lit("x")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = sorted((r["size"], r["text_crc32"]) for r in hilbert_shards(docs, 2).select("size", "text_crc32").collect())
    assert got == [(16, 0), (17, zlib.crc32(b"x")), (21_600_016, zlib.crc32(b"abcdefg " * 2_700_000))]


def test_every_language_can_be_learned(spark):
    from lapsekit.llm.language_id import SAMPLE_CHARACTERS, training_sample

    rows = [(i, "word " * (3 + i % 2 * 30_000), f"l{i % 300}") for i in range(600)]
    texts, labels = training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 5)
    assert set(labels) == {f"l{i}" for i in range(300)} and max(map(len, texts)) == SAMPLE_CHARACTERS


def test_many_benchmark_blocks(spark, monkeypatch):
    """Passages searched one by one in several passes give what one pass gives."""
    from lapsekit.llm import decontaminate as D

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choice(words, 20)) + "." for _ in range(7)]
    docs = [(i, " ".join(rng.choice(words, 30)) + " " + (passages[i % 7] if i % 3 else "")) for i in range(40)] + [(None, None), (3, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'own' AS leaks_", "1 AS _n", "2 AS row")
    bench = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    key = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", str(r.leaks)) for r in df.collect())
    want = key(D.with_leaks(docs, bench))
    monkeypatch.setattr(D, "ITEMS", 2)
    monkeypatch.setattr(D, "BLOCKS", 2)
    got = D.with_leaks(docs, bench)
    assert got.columns == [*docs.columns, "leaks"] and key(got) == want and sum(len(r.leaks) > 0 for r in got.collect()) == 26


def test_a_line_in_half_of_all_documents_makes_no_large_group(spark, monkeypatch):
    from lapsekit.llm import line_dedup as L

    common = "a line that stands in half of all documents, whatever they are"
    rows = [(i, f"{common}\nown line number {i} that is long enough to be a key of forty" if i % 2 else f"a line of document {i} alone, which is a key too") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.text) for r in L.line_dedup(docs).collect())
    sizes, screen = spark.sparkContext.accumulator(0), L._screen
    monkeypatch.setattr(L, "SHARD_ROWS", 40)

    def watched(key, lines, filters):
        if len(lines) > 40:
            sizes.add(1)
        return screen(key, lines, filters)

    monkeypatch.setattr(L, "_screen", watched)
    assert sorted((r.doc_id, r.text) for r in L.line_dedup(docs).collect()) == want
    assert sizes.value == 0 and sum(common in t for _, t in want) == 1


def test_lm_word_counts_in_crowded_buckets(spark, docs, monkeypatch):
    """A word that all chunks have makes no large group, and the counts stay those of the corpus."""
    from lapsekit.llm import lm_score as L

    want = sorted((r.doc_id, r.n_known, round(r.base_score, 9)) for r in L.lm_score(docs).collect())
    largest, hand_back = spark.sparkContext.accumulator(0), L._hand_back
    monkeypatch.setattr(L, "BUCKET_WORDS", 64)
    monkeypatch.setattr(L, "PARTIAL_WORDS", 300)
    monkeypatch.setattr(L, "CHUNK", 2000) if hasattr(L, "CHUNK") else None
    monkeypatch.setattr(L, "_hand_back", lambda key, dealt, totals: (largest.add(sum(len(x) // 8 for x in dealt["hashes"]) > 64 * 8), hand_back(key, dealt, totals))[1])
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 9)) for r in L.lm_score(docs).collect()) == want
    assert largest.value == 0


def test_lm_learns_from_every_training_document(spark, docs, rows, monkeypatch):
    """Each subword of each training document is a target once, in whatever chunk it is; held-out ones never are."""
    from lapsekit.llm import lm_score as L
    from lapsekit.llm.words import word_ids

    monkeypatch.setattr(L, "CHUNK", 2000)
    own = word_ids(L.VOCABULARY)
    text = lambda r: np.frombuffer((r[1] or "").encode(), np.uint8)
    want = Counter(x for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2
                   for x in [*own.encode(text(r), np.array([0, len(text(r))]))[0].tolist(), L.END])
    got, windows = Counter(), L._training_windows

    def seen(row):
        for batch in windows(row):
            learned.add(int(batch[3].sum()))
            yield batch

    learned = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(L, "_training_windows", seen)
    assert L.lm_score(docs).count() == len(rows) and learned.value == sum(want.values())
    ids = docs.select("doc_id", "doc_id", L.held_out("doc_id").alias("held"), "text")
    for row in L._rows(ids.toDF("_id", "doc_id", "held", "text").coalesce(1).mapInArrow(L._chunk(L.VOCABULARY), L.CHUNKS).toArrow().to_batches()):
        for _, targets, _, valid in windows(row):
            got.update(targets[valid].tolist())
    assert got == want


def plain_lm_step(model, ids, targets, hidden):
    """Loss and gradients with keys, values and both softmaxes written out, window by window."""
    from lapsekit.llm.lm_score import CLASSES, HALF, WIDTH

    s, b = model.shared, len(ids)
    root = np.float32(1 / np.sqrt(WIDTH))
    h = model.embed(ids)
    q, k, v = h[:, HALF:] @ s["query"], h @ s["key"], h @ s["value"]
    weight = np.where(hidden[:, None, :], np.float32(-1e9), q @ k.transpose(0, 2, 1) * root + model.mask())
    weight = np.exp(weight - weight.max(axis=2, keepdims=True))
    weight /= weight.sum(axis=2, keepdims=True)
    seen = weight @ v
    z = h[:, HALF:] + seen @ s["out"]
    f = np.maximum(z @ s["up"] + s["up0"], 0)
    z2 = z + f @ s["down"]
    logits = z2 @ s["top"] + s["top0"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    at = (np.arange(b)[:, None], np.arange(HALF)[None, :], model.class_of[targets])
    loss = -np.log(p[at]).mean()
    p[at] -= 1
    p /= b * HALF
    flat = lambda x: x.reshape(-1, x.shape[-1])
    dz2 = p @ s["top"].T
    df = (dz2 @ s["down"].T) * (f > 0)
    dz = dz2 + df @ s["up"].T
    dseen = dz @ s["out"].T
    dweight, dv = dseen @ v.transpose(0, 2, 1), weight.transpose(0, 2, 1) @ dseen
    ds = weight * (dweight - (dweight * weight).sum(axis=2, keepdims=True))
    dq, dk = ds @ k * root, ds.transpose(0, 2, 1) @ q * root
    dh = dk @ s["key"].T + dv @ s["value"].T
    dh[:, HALF:] += dz + dq @ s["query"].T
    far = np.clip(np.arange(HALF)[:, None] + HALF - np.arange(2 * HALF)[None, :], 0, 2 * HALF - 1)
    return loss, {
        "top": flat(z2).T @ flat(p), "top0": flat(p).sum(axis=0), "down": flat(f).T @ flat(dz2), "up": flat(z).T @ flat(df),
        "up0": flat(df).sum(axis=0), "out": flat(seen).T @ flat(dz), "query": flat(h[:, HALF:]).T @ flat(dq), "key": flat(h).T @ flat(dk),
        "value": flat(h).T @ flat(dv), "bias": np.bincount(far.ravel(), ds.sum(axis=0).ravel(), 2 * HALF),
        "classes": np.stack([np.bincount(model.class_of[ids].ravel(), x, CLASSES) for x in flat(dh).T], axis=1)}


def test_lm_step_is_the_plain_one_at_less_cost():
    import time

    from lapsekit.llm import lm_score as L

    model, rng = small_model(), np.random.default_rng(3)
    ids, goal = rng.integers(0, L.SIZE, (L.BATCH, 2 * L.HALF)), rng.integers(0, L.SIZE, (L.BATCH, L.HALF))
    hidden = np.zeros(ids.shape, bool)
    hidden[:5, :L.HALF] = True
    loss, grads, _ = model.step(ids, goal, hidden)
    want_loss, want = plain_lm_step(model, ids, goal, hidden)
    assert loss == pytest.approx(want_loss, rel=1e-5)
    for name in L.NAMES:
        assert np.abs(grads[name] - want[name]).max() < 1e-4 * np.abs(want[name]).max(), name

    def cost(run):
        began = time.thread_time()
        for _ in range(5):
            run(ids, goal, hidden)
        return time.thread_time() - began

    both = [(cost(model.step), cost(lambda *x: plain_lm_step(model, *x))) for _ in range(9)]
    assert min(a for a, _ in both) < 0.85 * min(b for _, b in both)


def test_lm_step_of_runs_is_that_of_their_windows():
    """A run of windows shares the embeddings of its halves; loss and gradients are those of the windows one by one."""
    from lapsekit.llm import lm_score as L

    model, rng = small_model(), np.random.default_rng(4)
    model.shared["top0"] = rng.normal(size=L.CLASSES).astype(np.float32)
    ids = rng.integers(0, L.SIZE, (6, (L.RUN + 1) * L.HALF))
    goal = rng.integers(0, L.SIZE, (6, L.RUN * L.HALF))
    hidden = np.zeros((6 * L.RUN, 2 * L.HALF), bool)
    hidden[::5, :L.HALF] = True
    windows = np.concatenate([ids[:, i * L.HALF:(i + 2) * L.HALF] for i in range(L.RUN)], axis=1).reshape(-1, 2 * L.HALF)
    loss, grads, _ = model.step(ids, goal, hidden)
    want_loss, want = plain_lm_step(model, windows, goal.reshape(-1, L.HALF), hidden)
    assert loss == pytest.approx(want_loss, rel=1e-5)
    for name in L.NAMES:
        assert np.abs(grads[name] - want[name]).max() < 1e-4 * np.abs(want[name]).max(), name


def test_words_met_again_are_kept(monkeypatch):
    """A full table keeps the words that come back, so they are not learned again; ids stay the tokenizer's."""
    from lapsekit.llm import words as W

    monkeypatch.setattr(W, "WORDS_KEPT", 300)
    own, learned, learn = W.WordIds("word_bpe_49k.json"), Counter(), W.WordIds._learn
    monkeypatch.setattr(W.WordIds, "_learn", lambda self, hashes, words: (learned.update(words), learn(self, hashes, words))[1])
    common = [f"again{i}" for i in range(40)]
    for n in range(40):
        text = " ".join([*common, *(f"once{n}x{i}" for i in range(50))])
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = own.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own.hashes) <= 300
    assert all(learned[w.encode()] == 1 for w in common) and len(learned) == 40 + 40 * 50
    everything = " ".join(f"full{i}" for i in range(290))  # words met again that leave too little room go too
    for text in (everything, everything, "more " * 20 + " ".join(f"new{i}" for i in range(40))):
        data = np.frombuffer(text.encode(), np.uint8)
        assert own.encode(data, np.array([0, len(data)]))[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.hashes) == 41

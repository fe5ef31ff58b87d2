"""Decontamination against brute force: the longest common subsequence of every document and every passage."""

import numpy as np
import pyarrow as pa

from lapsekit.llm import decontaminate as D
from lapsekit.llm.common import buffers


def search(docs, items):
    """The search for passages (id, text, answer) in the latent space of the documents."""
    batch = pa.RecordBatch.from_arrays([pa.array(docs)], names=["text"])
    (part,) = D._statistics(iter([batch]))
    total = np.frombuffer(part.column(0)[0].as_buffer(), np.float64)
    n = 1 + D.FEATURES
    space = D.LatentSpace(D.LatentSpace._decompose(total[0], total[1:n], total[n:].reshape(D.FEATURES, D.SKETCH)))
    return D.Search(space, D.Passages.of(items))


def brute(docs, passages):
    masks, answers = ([D._masks(w) for w in x] for x in (passages.words, passages.answers))
    out = {}
    for d, text in enumerate(docs):
        words = D._words(text).tolist()
        for i, own in enumerate(passages.words):
            share = D.common_subsequence(masks[i], len(own), words) / len(own)
            answer = len(passages.answers[i])
            told = answer and D.common_subsequence(answers[i], answer, words) >= D.ANSWER * answer
            if share >= D.OVERLAP or share >= D.PARAPHRASE and told:
                out[d, i] = share
    return out


def changed(rng, words, replaced, inserted, pool):
    out = [pool[rng.integers(len(pool))] if rng.random() < replaced else w for w in words]
    return [x for w in out for x in ([w, pool[rng.integers(len(pool))]] if rng.random() < inserted else [w])]


def test_finds_all_that_brute_force_finds():
    rng = np.random.default_rng(0)
    common = ["the", "of", "and", "to", "in", "is"]
    rare = ["".join(rng.choice(list("abcdefghijk"), 6)) for _ in range(3000)]
    draw = lambda n, share: [str(rng.choice(common)) if rng.random() < share else str(rng.choice(rare)) for _ in range(n)]
    items, docs = [], [" ".join(draw(int(rng.integers(5, 300)), 0.5)) for _ in range(100)]
    for i in range(60):
        words = draw(int(rng.integers(12, 90)), rng.choice([0.2, 0.5, 0.9]))
        answer = " ".join(words[-6:]) if i % 3 else rng.choice(common)
        items.append((i, " ".join(words), answer))
        for replaced, inserted in ((0.1, 0), (0.25, 0), (0.4, 0), (0, 0.5), (0, 0.9), (0.2, 0.4)):
            docs.append(" ".join(changed(rng, words, replaced, inserted, common + rare)[:2 * len(words)]))
    own = search(docs, items)
    true = {k: v for k, v in brute(docs, own.passages).items()
            if len(docs[k[0]].split()) <= D.SPAN * len(own.passages.words[k[1]])}
    data, offsets = buffers(pa.array(docs))
    got = {(d, i): share for d, i, share in own.run(data, offsets)}
    assert len(true) > 250 and sum(v < D.OVERLAP for v in true.values()) > 20
    assert {k: got.get(k) for k in true} == true
    assert set(got) <= set(brute(docs, own.passages))


def test_windows_belong_to_one_document():
    """A short trimmed copy is found by the latent space wherever it lies, alone, first or last in a batch, and what a
    document holds does not depend on its neighbours."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijk"), 6))
    passage = [word() for _ in range(59)]
    copy = " ".join(passage[4:54])
    others = [" ".join(word() for _ in range(n)) for n in (8, 20, 45, 400)]
    own = search([*others, copy], [(7, " ".join(passage), None)])
    own.groups = []

    def found(docs):
        return {(d, i) for d, i, _ in own.run(*buffers(pa.array(docs)))}

    assert found([copy]) == {(0, 0)}
    for other in others:
        assert found([copy, other]) == {(0, 0)}
        assert found([other, copy]) == {(1, 0)}
        assert found([other, "", copy]) == {(2, 0)}
    assert found([*others, copy]) == {(4, 0)}
    assert found([copy, *others, copy]) == {(0, 0), (5, 0)}


def test_long_passages():
    """A copy of a passage of thousands of words is found by the latent space and by words alone."""
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdefghijk"), 6)) for _ in range(4000)]
    draw = lambda n: [str(w) for w in rng.choice(pool, n)]
    items = [draw(n) for n in (700, 1600, 2500)]
    docs = [" ".join(draw(3000)) for _ in range(3)]
    docs += [" ".join(draw(300) + x + draw(300)) for x in items]
    docs += [" ".join(changed(rng, x, 0.15, 0, pool)) for x in items]
    want = {(3 + i, i) for i in range(3)} | {(6 + i, i) for i in range(3)}
    for words in (True, False):
        own = search(docs, [(i, " ".join(x), "no such answer") for i, x in enumerate(items)])
        own.groups = own.groups if words else []
        got = {(d, i): share for d, i, share in own.run(*buffers(pa.array(docs)))}
        assert set(got) == want
        assert all(got[3 + i, i] == 1 for i in range(3))
        own.classes = {}
        assert {(d, i) for d, i, _ in own.run(*buffers(pa.array(docs)))} == (want if words else set())


def test_words_of_other_scripts_and_punctuation(spark):
    """Punctuation beyond ASCII parts words, and text without spaces is words of one character."""
    latin = "die größe der straße wächst und mañana canta el niño über die brücke"
    chinese = "春天来了花园里的桃树开满了粉红色的花朵孩子们在树下唱歌"
    docs = [(1, " — ".join(f"“{w}”…" for w in latin.split())), (2, latin.replace(" ", " ")),
            (3, "昨天老师对我们说" + chinese + "然后大家一起回家"), (4, "昨天老师对我们说然后大家一起回家，没有别的"), (5, "größer straßen")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, latin), (2, chinese)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.decontaminate(frame, items).collect()}
    assert got == {1: [1], 2: [1], 3: [2], 4: [], 5: []}

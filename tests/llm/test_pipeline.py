"""The pipeline's stages against brute force, and on odd input."""

import pytest
from helpers import CLASH, ODD, corpus, frame
from test_operators import brute_components, brute_lines, brute_simhash

import corpus_pipeline as P


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents with two that the language stage rejects and one that holds a benchmark passage."""
    root = tmp_path_factory.mktemp("sf")
    rows = corpus(90, 5)
    passage = "zeta kappa lambda omega sigma theta iota delta gamma alpha beta epsilon phi chi psi rho tau upsilon"
    rows[30] = (30, rows[30][1] + "\n" + passage, "en", "src1", 0)
    rows += [(90, "12 34", None, "src1", 5), (91, None, "en", None, None)]
    frame(spark, rows, clash=False).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows


def test_stages(spark, sf):
    root, rows = sf
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out, columns = {}, docs.columns
    for name, stage in P.STAGES:
        docs = P.cut_table(stage(spark, docs, root))
        out[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    text = {r[0]: r[1] for r in rows}
    assert {r.doc_id: r.text for r in out["language_id"]} == {i: t for i, t in text.items() if i < 90}
    left = [(r.doc_id, r.text) for r in out["language_id"]]
    want = {i: "\n".join(x) for i, x in brute_lines(left).items()}
    assert {r.doc_id: r.text for r in out["line_dedup"]} == want and all(r.n_chars == len(r.text) for r in out["line_dedup"])
    left = sorted(want.items())
    group = brute_components([brute_simhash(t) for _, t in left], lambda a, b: (a ^ b).bit_count() <= 3)
    kept = {left[g][0] for g in group}
    assert {r.doc_id for r in out["simhash_dedup"]} == kept
    assert {r.doc_id for r in out["decontaminate"]} == kept - {30}
    assert {r.doc_id for r in out["best_fit_pack"]} == kept - {30}


def test_run(spark, sf):
    import os

    from lapsekit.llm.common import WRITTEN

    there = list(WRITTEN)
    out = P.run(spark, sf[0])
    assert out.count() > 0 and len(WRITTEN) - len(there) <= 5  # the last stage's, and the result it read
    assert all(os.path.isdir(p.removeprefix("file:")) for p in WRITTEN[len(there):])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontaminate", "best_fit_pack"]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_input(spark, sf, rows):
    docs = frame(spark, rows)
    for _, stage in P.STAGES[:-1]:
        docs = P.cut_table(stage(spark, docs, sf[0]))
        assert all(r[f] == f"own {f}" for r in docs.collect() for f in CLASH)
    assert docs.columns == frame(spark, rows).columns
    assert (P.STAGES[-1][1](spark, docs, sf[0]).count() > 0) == bool(rows)


def test_stages_bound_the_rows_of_a_worker(spark, sf, monkeypatch):
    """A stage whose last step is a column function writes its result with few documents at a time."""
    from lapsekit.llm import decontaminate, language_id, line_dedup

    largest = spark.sparkContext.accumulator(0)
    for module in (language_id, line_dedup, decontaminate):
        read = module.buffers
        monkeypatch.setattr(module, "buffers", lambda column, read=read: (largest.add(len(column) > 10), read(column))[1])
    monkeypatch.setattr(P, "DOCS", 10, raising=False)
    monkeypatch.setattr(line_dedup, "DOCS", 10)
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").coalesce(1)
    for stage in (P.language, P.lines, P.decontamination):
        before = largest.value
        stage(spark, docs, sf[0]).write.format("noop").mode("overwrite").save()
        assert largest.value - before <= (stage is P.decontamination) * 1  # fitting its space reads larger batches

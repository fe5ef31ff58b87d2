"""Odd rows, empty tables and clashing column names: every operator and stage gives its defined result."""

import pytest
from helpers import ODD, SCHEMA, frame

from lapsekit.llm import decontaminate, exact_dedup, hilbert_shard, language_id, line_dedup, lm_score, packing, simhash, suffix_dedup

BENCHMARK = "item_id long, text string"


def operators(spark):
    bench = spark.createDataFrame([(1, "the and of them a b c d e f g h i j k."), (None, None)], BENCHMARK)
    return {
        "op1": language_id.language_id, "op2": suffix_dedup.suffix_dedup, "op3": exact_dedup.exact_dedup, "op4": simhash.simhash_dedup,
        "op5": line_dedup.line_dedup, "op6": lambda d: decontaminate.decontaminate(d, bench), "op8": lm_score.lm_score,
        "op9": hilbert_shard.hilbert_shards, "op10": packing.best_fit_pack}


NAMES = ["op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9", "op10"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    got = operators(spark)[name](frame(spark, ODD)).collect()
    if name == "op10":
        got = [r for r in got if r.piece == 0]
    key = lambda x: (x is not None, x)
    assert sorted((r.doc_id for r in got), key=key) == sorted((r[0] for r in ODD), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    empty = frame(spark, []) if name != "op1" else spark.createDataFrame([], SCHEMA)
    assert operators(spark)[name](empty).collect() == []


def test_exact_dedup_of_odd_rows(spark):
    got = exact_dedup.exact_dedup(frame(spark, ODD)).collect()
    empty = [r for r in got if r.group_size == 3]  # the null text and both empty ones
    assert len(empty) == 3 and {r.keep_id for r in empty} == {1} and sum(r.kept for r in empty) == 1


def test_suffix_dedup_of_odd_rows(spark):
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, [r for r in ODD if r[0] not in (None, 1)])).collect()}
    assert (got[3].n_bytes, len(got[3].spans), len(got[3].kept)) == (150000, 1, 5)  # all but the first word comes again
    assert got[6].spans and not got[7].spans


def test_simhash_of_odd_rows(spark):
    got = simhash.simhash_dedup(frame(spark, ODD)).collect()
    none = [r for r in got if r.fingerprint == "0" * 16]
    assert len(none) == 4 and {r.component_id for r in none} == {None}  # null, two empty ones and white space link


def test_line_dedup_of_odd_rows(spark):
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, [r for r in ODD if r[0] not in (None, 1)]), min_docs=1).collect()}
    assert all(r.n_dropped == 0 for r in got.values())  # the only document with a key is the largest one with it
    assert got[6].n_lines == 8


def test_language_of_odd_rows(spark):
    got = {r.doc_id: r for r in language_id.language_id(frame(spark, [r for r in ODD if r[0] not in (None, 1)])).collect()}
    assert got[7].lang_pred == got[2].lang_pred == "und" and got[7].score == 0
    assert got[3].lang_pred in ("en", "de")


def test_lm_of_odd_rows(spark):
    got = [r for r in lm_score.lm_score(frame(spark, ODD)).collect() if r.doc_id == 1]
    assert sorted(r.n_tokens for r in got) == [1, 1, 14]


def test_ties_in_id_and_text_are_separate_rows(spark):
    rows = [(5, "same text", "en", "a", 9)] * 3
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert [r.group_size for r in got] == [3, 3, 3] and sum(r.kept for r in got) == 1


def test_pages_without_rows(spark):
    from lapsekit.llm.html_extract import extract_main_text

    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    got = extract_main_text(spark.createDataFrame([(None, None, None), (1, "u", "<p>a b.</p>"), (1, "u", "<p>a b.</p>")], "page_id long, url string, html string"))
    assert sorted(r.n_chars for r in got.collect()) == [0, 4, 4]

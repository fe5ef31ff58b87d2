"""Training-data pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents. A null text is an empty one, null or shared ids are separate rows, and other
columns come along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsekit.llm.common import WRITTEN, cut_table, remove_tables, with_unique_ids
from lapsekit.llm.decontaminate import with_leaks
from lapsekit.llm.language_id import UNKNOWN, fit, with_language
from lapsekit.llm.line_dedup import line_dedup
from lapsekit.llm.packing import best_fit_pack
from lapsekit.llm.simhash import simhash_dedup

#: The language stage rejects texts without letters and those for which no language is this likely.
MIN_SCORE = 0.35
#: Documents that a Python worker gets at a time where a stage's last step is a column function.
DOCS = 500


def _packed(docs: DataFrame) -> DataFrame:
    """The text, and the other columns as one struct, so that no new column can clash with one of them."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(rest.alias("row"), F.col("text").cast("string").alias("text"))


def _unpacked(out: DataFrame, columns: list[str]) -> DataFrame:
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: ``und``, or a score under ``MIN_SCORE``."""
    out = with_language(_packed(docs), fit(docs))
    out = out.filter((F.col("language.lang") != UNKNOWN) & (F.col("language.score") >= MIN_SCORE))
    return cut_table(_unpacked(out, docs.columns), DOCS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines. Every document stays, perhaps with an empty text; n_chars follows the text."""
    out = line_dedup(docs, carry=True)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    out = out.select(*[made[c].alias(c) if c in made else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return cut_table(out, DOCS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies (SimHash of 3 words, 3 bits)."""
    rows = with_unique_ids(docs, "doc_id", "text", carry=True)
    kept = simhash_dedup(rows.select("_id", "text"), id_col="_id").filter("_id = keeper").select("_id")
    out = rows.join(kept, "_id", "left_semi")
    return out.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return cut_table(_unpacked(with_leaks(_packed(docs), benchmark).filter(F.size("leaks") == 0), docs.columns), DOCS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: one row per piece."""
    return best_fit_pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_dedup", near_duplicates),
          ("decontaminate", decontamination), ("best_fit_pack", packing)]

#: Training and iteration are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again. What a stage wrote on the way,
    and the result before it, are deleted as soon as its own result is there; the last stage's tables stay, for
    its frame is lazy."""
    out, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        first = len(WRITTEN)
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out = cut_table(out)
            remove_tables(spark, [*before, *WRITTEN[first:-1]])
            before = WRITTEN[-1:]
    return out

"""Registered queries of the training-data operators and their oracle SQL; the pipeline is registered with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def put(run):
        QUERIES[name] = (run, sql)
        return run

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document (operator 1)."""
    from lapsekit.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings that repeat within or across documents (operator 2)."""
    from lapsekit.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d""")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document (operator 3)."""
    from lapsekit.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_simhash_dedup")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by fingerprint (operator 4)."""
    from lapsekit.llm.simhash import simhash_dedup

    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op5_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, hot.key IS NOT NULL AND k.doc_id <> hot.owner AS lost FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents (operator 5)."""
    from lapsekit.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_decontaminate")
def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages (operator 6)."""
    from lapsekit.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_html_extract")
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page (operator 7)."""
    from lapsekit.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op8_lm_score")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document (operator 8)."""
    from lapsekit.llm.lm_score import lm_score

    return lm_score(table(spark, sf_dir, "documents"))


@query("op9_hilbert_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hilbert-curve shards of every document (operator 9)."""
    from lapsekit.llm.hilbert_shard import hilbert_shards

    return hilbert_shards(table(spark, sf_dir, "documents"))


@query("op10_best_fit_pack")
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens from every document (operator 10)."""
    from lapsekit.llm.packing import best_fit_pack

    return best_fit_pack(table(spark, sf_dir, "documents"))


@query("op12_token_align")
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two vocabularies in every document (operator 12)."""
    from lapsekit.llm.token_align import align_tokens

    out = align_tokens(table(spark, sf_dir, "documents"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


@query("op13_bpe_round_trip")
def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text decoded from them (operator 13)."""
    from lapsekit.llm.bpe_prefix import bpe_round_trip

    out = bpe_round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op11_prefix_trie", """
WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(4294967295, list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
      FROM t),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS s
      FROM h c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, d, s[1:d] AS p, len(s) AS n FROM r, unnest(range(0, len(s) + 1)) u(d)),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(strlen(p[d].x)), 0) AS size,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
      FROM m GROUP BY d, p),
k AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
j AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, p)),
s AS (SELECT e AS d, p[1:e] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
      FROM j, unnest(range(0, d + 1)) u(e) GROUP BY ALL)
SELECT j.conv_id, j.d AS depth, a.conv_id AS parent_conv_id, j.n_convs, j.n_children, s.n_leaves, s.saved_tokens, j.ends_sha256
FROM j JOIN s USING (d, p) LEFT JOIN n a ON a.d = j.d - 1 AND a.p = j.p[1:j.d - 1]""")
def trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings that conversations share, as a trie (operator 11)."""
    from lapsekit.llm.prefix_trie import prefix_trie, sequences, with_openings

    return prefix_trie(with_openings(sequences(table(spark, sf_dir, "conversations"))))

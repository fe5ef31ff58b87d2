"""Written shards hold every row once, whatever its id."""

from collections import Counter

from helpers import ODD, frame


def test_null_and_shared_ids_are_written_once(spark, tmp_path):
    from lapsekit.llm.hilbert_shard import hilbert_shards, write_shards

    docs = frame(spark, [*ODD, (1, None, "en", "a", 0), (1, "", "de", "b", 0), (None, "the and of them.", "en", None, 3)], clash=False)
    shards = hilbert_shards(docs, 4).cache()
    write_shards(docs, shards, str(tmp_path / "shards"))
    got = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(map(tuple, got.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    place = lambda df: Counter(map(tuple, df.select("doc_id", "shard", "slot").collect()))
    assert place(got) == place(shards)

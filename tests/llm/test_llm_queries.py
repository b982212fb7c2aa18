"""The registered queries over the smallest tables: columns, row counts and, where there is one, their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import common, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_token_counts": ["doc_id", "n_tokens", "n_crossing", "outside", "section_tokens"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op4_license_scan": ["doc_id", "n_matches", "licenses", "best_coverage"],
    "op5_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op6_chat_formatting": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op7_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9_sentencepiece": ["doc_id", "n_tokens", "n_bytes", "ids_sha256", "round_trip"],
    "op10_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op11_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op12_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op13_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    got = sorted(map(tuple, df.collect()), key=str)
    source, more = ("embeddings", 0) if name.startswith("op3_") else ("conversations", 1) if name.startswith("op6_") else ("documents", 0)
    of = spark.read.parquet(f"{SF}/{source}.parquet")
    assert name in ("op12_source_divergence", "op13_prefix_trie") or len(got) == more + (of.select("conv_id").distinct().count() if source == "conversations" else of.count())
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        found = con.execute(queries.oracle_sql()[name])
        at = [[d[0] for d in found.description].index(c) for c in df.columns]
        assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_helper_columns_never_clash(spark):
    df = spark.createDataFrame([(1, "mine", 2)], "id long, __computed string, out long")
    got = common.add_columns(df, ["id"], [("out", "long")], lambda: lambda ids: ids.to_frame("out") + 1)
    assert [tuple(r) for r in got.collect()] == [(1, "mine", 2)] and got.columns == ["id", "__computed", "out"]
    assert common.free_name(df.withColumn("___computed", F.lit(0)), "__computed") == "____computed"

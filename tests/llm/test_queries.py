"""The registered queries over whole small tables: their contracts' columns, and SQL where it is given."""

import os

import duckdb
import pytest

from spanveil.llm import queries as registered

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_url_filter": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op2_lm_scoring": ("documents", "doc_id bigint, n_words bigint, log_likelihood double"),
    "op3_media_columns": ("documents", "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"),
    "op4_language": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op5_simhash": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op6_embedding_links": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op7_mixing": ("documents", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
    "op8_pii": ("documents", "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"),
    "op9_sharding": ("documents", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    "op10_packing": ("documents", "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"),
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_all_are_registered():
    assert set(registered.queries()) == set(CONTRACTS)


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, name):
    table, columns = CONTRACTS[name]
    df = registered.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    for column in columns.split(", "):
        c, kind = column.split()
        assert kinds[c] == kind
    key = df.columns[0]
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    rows = df.collect()
    assert {r[key] for r in rows} == {r[0] for r in whole.select(whole.columns[0]).collect()}
    if name != "op10_packing":
        assert len(rows) == whole.count()
    if name in registered.oracle_sql():
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registered.oracle_sql()[name]}) AS q").fetchall()
        assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_language_accuracy_on_held_out_documents(spark):
    got = registered.op4_language(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)

"""The contract queries on the smallest tables, against their SQL where there is one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

D = "/root/testdata/sf0.001"


def registered():
    from roadtrace.llm import queries

    return queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


COLUMNS = {
    "op1_": "doc_id start n_tokens ids_crc32", "op2_": "doc_id n_words n_hit n_items items_sha256 contaminated", "op3_": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_": "doc_id n_lines n_dropped kept_sha256", "op5_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op6_": "doc_id class_id n_links",
    "op7_": "doc_id held_out lang_pred score", "op8_": "doc_id shard depth doc_bytes shard_bytes", "op9_": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op10_": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_": "lang rank phrase a l r n score", "op12_": "page_id host path rule verdict", "op13_": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("prefix", sorted(COLUMNS))
def test_query(spark, con, prefix):
    queries, oracles = registered()
    (name,) = [q for q in queries if q.startswith(prefix)]
    got = queries[name](spark, D).toPandas()
    assert list(got.columns)[: len(COLUMNS[prefix].split())] == COLUMNS[prefix].split()
    table = "pages" if prefix in ("op3_", "op12_") else "documents"
    assert len(got) >= (1 if prefix == "op11_" else spark.read.parquet(f"{D}/{table}.parquet").count())
    if name in oracles:
        want = con.sql(oracles[name]).df()
        order = sorted(want.columns)
        a, b = (x[order].astype(object).where(x[order].notna(), None).sort_values([c for c in ("page_id", "doc_id", "part", "filter_order", "step", "lang", "rank") if c in order]).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)

"""Every query runs at the smallest scale with the columns of its contract, and the SQL agrees where there is one."""

from __future__ import annotations

import duckdb
import pytest

from gristmill.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "item_id"], "op2": ["doc_id", "held_out", "lang_pred", "score"], "op3": ["doc_id", "fingerprint", "component_id"], "op4": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op6": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["doc_id", "n_tokens"], "op9": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op10": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    want = COLUMNS[name.split("_")[0]]
    assert df.columns[: len(want)] == want
    got = df.toPandas()
    if name in queries.SQL:
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
        con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
        sql = con.sql(queries.SQL[name]).df()
        cols = sorted(sql.columns)
        both = [x[cols].astype(object).where(x[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True) for x in (sql, got)]
        assert both[0].equals(both[1])
    elif name not in ("op1_decontamination", "op6_warc"):
        assert len(got) >= 200

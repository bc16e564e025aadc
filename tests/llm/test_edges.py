"""Every query over tables with nulls, extremes, ties and clashing columns, and over empty tables."""

import pytest
from conftest import PAGES, rows

from skein.llm.entry import QUERIES

COLUMNS = {
    "op1_flac_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_gru_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_quality_classifier": "doc_id held_out score predicted",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op8_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_pii_disclosure": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_rows_come_through(spark, tables, name):
    df = QUERIES[name](spark, tables)
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    found = df.collect()
    want = [r[0] for r in (PAGES if name == "op9_warc" else rows())]
    ids = [r["page_id" if name == "op9_warc" else "doc_id"] for r in found]
    if name == "op4_best_fit_packing":
        assert {*ids} == {*want}
    else:
        assert sorted(ids, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).collect() == []

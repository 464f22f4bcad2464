"""What the driver sees."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op2_exact_dedup"])
def test_equals_duckdb(spark, name):
    from skein.llm.registry import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, SF)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(c.sql(ORACLE_SQL[name]).select(*cols).fetchall())


COLUMNS = {
    "op1_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    from skein.llm.registry import QUERIES

    have = [f"{c} {t}" for c, t in QUERIES[name](spark, SF).dtypes]
    want = COLUMNS[name].split(", ")
    assert have[: len(want)] == want


def test_no_machine_local_checkpoints_on_a_cluster():
    from types import SimpleNamespace

    from skein.llm.common import checkpointed, one_process

    assert one_process("local") and one_process("local[4]") and not one_process("local-cluster[3,2,900]") and not one_process("yarn")
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc, conf={}))
    with pytest.raises(ValueError, match="checkpoint"):
        checkpointed(df)

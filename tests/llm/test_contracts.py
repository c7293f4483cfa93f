"""The registered queries' columns, and SQL where there is any."""

import duckdb
import pytest
from evidex.llm import queries

COLUMNS = {
    "op1": "page_id bigint, url string, text string, n_chars bigint",
    "op2": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5": "page_id bigint, host string, path string, rule string, verdict string",
    "op6": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8": "doc_id bigint, fingerprint string, component_id bigint",
    "op9": "doc_id bigint, n_bytes bigint, prefix bigint, depth int, overflow bigint",
    "op10": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op11": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op12": "lang string, source string, part string, item string, value bigint, rank int",
    "op13": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    for column in COLUMNS[name.split("_")[0]].split(", "):
        assert kinds[column.split()[0]] == column.split()[1], column
    if name.startswith(("op12", "op13")):  # rows of groups, not of documents
        assert df.count() > 0
        return
    pages = name.startswith(("op1_", "op5", "op6"))
    n = spark.read.parquet(f"{sf}/{'pages' if pages else 'documents'}.parquet").count()
    assert df.count() == n if not name.startswith("op10") else df.count() >= n


def test_warc_against_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rows = db.execute(queries.ORACLES["op6_warc"]).fetchall()
    got = queries.QUERIES["op6_warc"](spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(rows)

"""Quotes of one or two words against the query's SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from evidex.plans import ORACLES, QUERIES


def test_quotes_without_inner_words(spark, tmp_path):
    texts = ["One two three four", "some  TWO\nThree more", "twofold", "none of it", ""]
    pq.write_table(pa.table({"doc_id": range(5), "text": texts}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": range(5), "text": ["two", "Two  three", "one two three", "absent", "two three four"]}), tmp_path / "benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = sorted(db.execute(ORACLES["c06_quote_location"]).fetchall())
    assert {r[0] for r in want} == {0, 1, 2, 4}
    assert sorted(tuple(r) for r in QUERIES["c06_quote_location"](spark, str(tmp_path)).collect()) == want

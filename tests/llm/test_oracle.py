"""The queries that have SQL give its rows, nulls and ties among them."""

import duckdb
import pytest

from obsengine.llm import queries

DOCS = [(i, None if i % 17 == 0 else " ".join(["w"] * (i % 23)), [None, "en", "de", "fr"][i % 4], f"src{i % 5}" if i % 7 else None) for i in range(400)] + [(3, "w w", "fr", "src3")]
TURNS = [(1, 0, "system", "be \\ brief"), (1, 1, "user", None), (1, 2, "assistant", "### </turn>\n" + "word " * 700), (1, 3, "assistant", "é😀"), (1, None, None, ""), (2, 0, "user:\n", "a"), (2, 0, "user:\n", "a")]
TURNS += [(3, t, ["system", "user", "assistant"][min(t, 1 + t % 2)], f"turn {t} " * (t * 7 % 90)) for t in range(60)]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_rows_equal_sql(spark, tmp_path, name):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(tmp_path))
    found = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())

import zlib

import duckdb
import pytest

from tarn.llm.crc_sql import crc32_sql
from tarn.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_shards", "op11_spelling", "op12_periodic_runs"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    rows = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in rows.collect())


def test_crc_of_any_characters():
    con = duckdb.connect()
    texts = ["", "a", "123456789", "é€🙂 ÿ߿ࠀ￿", "x" * 3000, "é̂ 👨‍👩‍👧\r\n"]
    found = con.execute(f"SELECT t, {crc32_sql('t')} FROM (SELECT unnest(?) AS t)", [texts]).fetchall()
    assert dict(found) == {t: zlib.crc32(t.encode()) for t in texts}

"""Tables repeated under shifted keys: every symbol has copies with equal bars, whose ranks have to tie in query and SQL."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

SOURCE = Path(__file__).resolve().parents[2] / "testdata" / "sf0.001"
COPIES = 6


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    path = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    for name, keys in (("lineitem", {"l_suppkey": 25000, "l_orderkey": 10_000_000}), ("supplier", {"s_suppkey": 25000})):
        moved = ", ".join(f"CAST({c} + i * {by} AS BIGINT) AS {c}" for c, by in keys.items())
        con.execute(f"COPY (SELECT t.* REPLACE ({moved}) FROM '{SOURCE}/{name}.parquet' t, range({COPIES}) r(i)) TO '{path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["validate_rankings", "score_configs"])
def test_copies_tie_as_in_sql(spark, copies, name):
    path, con = copies
    got = catalog.QUERIES[name](spark, str(path))
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    found = sorted(tuple(r[c] for c in names) for r in got.collect())
    assert len(found) > 0 and found == sorted(want.fetchall())
    at = names.index("rank")
    assert all((r[at] - 1) % COPIES == 0 for r in found) or name == "validate_rankings"

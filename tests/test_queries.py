"""Every query over the logs against its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lamina.plans import stored as logs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(logs.SQL))
def test_query_matches_sql(spark, tables, name):
    df = logs.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = tables.sql(logs.SQL[name])
    assert columns == sorted(want.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_log_queries_without_sql(spark):
    import zlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.crc for r in logs.QUERIES["log_checksums"](spark, SF).collect()} == {k: zlib.crc32(b"\x01" + v) for k, v in docs.items()}
    assert {r.doc_id: r["size"] for r in logs.QUERIES["log_roundtrip"](spark, SF).collect()} == {k: len(v) for k, v in docs.items()}


def test_manifest_of_more_segments_than_the_numbers_of_copies(spark, tables, tmp_path):
    """A log of 2,003 segments has 1002 and 2002 itself: a copy of that number comes beside the one, and the other stays."""
    spark.range(0, 2002 * 2500 + 1, 1, 8).selectExpr("id AS event_id", "id % 7 AS user_id", "IF(id % 5 = 0, 'error', 'view') AS event_type", "'p' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = logs.QUERIES["manifest_apply"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = c.sql(logs.SQL["manifest_apply"]).project(", ".join(got.columns)).fetchall()
    assert len(want) == 2003 and sorted(map(tuple, got.collect())) == sorted(want)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

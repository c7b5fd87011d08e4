"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from windrow.catalog import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, D)
    columns = sorted(got.columns)
    want = duck.execute(ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    rows = lambda found: sorted((tuple(plain(x) for x in r) for r in found), key=repr)
    assert rows(map(tuple, got.select(columns).collect())) == rows(tuple(r[order.index(c)] for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_labels_without_length_and_near_ties(spark, tmp_path):
    """Of the given tables no error event is of value 0, so none of their labels is without length; larger ones hold some."""
    stride = 14_400_000_000
    first = 118_346 * stride + 60_000_000  # labels move back a minute, to the start of the flow's first window
    later = 118_406 * stride + 3_660_000_000
    # id, time, value: at the first window's start; two whose IoUs differ by less than 1e-9, the smaller of an attack; alone in its windows; a second label beside one without length
    events = [(1, first, 0.0), (3, first + 1_000, 48.0), (16, first + 1_010, 48.0), (19, first + 9, 0.0), (20, later, 0.0), (32, later + 10 * stride, 0.0), (33, later + 10 * stride, 0.5)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, make_timestamp(?), 0, 'error', ?, '{}')", events)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("label_align", "label_stats"):
        want = con.execute(ORACLES[name])
        order = [d[0] for d in want.description]
        rows = [tuple(plain(x) for x in r) for r in QUERIES[name](spark, str(tmp_path)).select(order).collect()]
        assert sorted(rows) == sorted(tuple(plain(x) for x in r) for r in want.fetchall())
    got = {r.win_start_us: (r.label, r.n_candidates) for r in QUERIES["label_align"](spark, str(tmp_path)).collect()}
    assert got[118_346 * stride] == ("BENIGN", 3) and got[118_406 * stride] == ("Web Attack - XSS", 1) and got[118_416 * stride] == ("BENIGN", 2)

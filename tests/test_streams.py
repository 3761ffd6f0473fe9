"""The windows of the streaming queries are those of their SQL, also for events next to the end of a window."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidelens.plans import registered

QUERIES, SQL = registered()


def at(*time):
    return dt.datetime(2024, 1, 1, *time)


CASES = {
    "last half second": [at(5, 59, 59, 499_999), at(5, 59, 59, 500_000), at(5, 59, 59, 999_999), at(6), at(11, 59, 59, 600_000), at(23)],
    "latest just before a close": [at(1), at(2), at(6, 59, 59, 700_000)],
    "latest at a close": [at(1), at(2), at(7)],
    "latest just before an end": [at(1), at(7), at(17, 59, 59, 700_000)],
}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("name", ["streaming_window_means", "streaming_anomalies"])
def test_windows_at_their_ends(spark, tmp_path, name, case):
    duckdb = pytest.importorskip("duckdb")
    times = CASES[case]
    rows = {"event_id": range(len(times)), "ts": times, "user_id": [1] * len(times), "event_type": ["view"] * len(times), "value": [float(10**k) for k in range(len(times))], "props": ["{}"] * len(times)}
    pq.write_table(pa.table(rows, schema=pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])), tmp_path / "events.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(SQL[name]).df()[df.columns].itertuples(index=False, name=None))

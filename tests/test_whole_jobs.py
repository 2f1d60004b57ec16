"""Queries whose job had been made smaller: every row of their input counts."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["stream_stage_latency", "stream_sessions"])
def test_open_windows_and_late_rows_count(spark, tmp_path, name):
    day, hour = pd.Timestamp("2024-01-01"), pd.Timedelta(hours=1)
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    files = {
        "a": [(1, day + 40 * hour, 1, "view", 1.0, ""), (2, day + 41 * hour, 2, "buy", 2.0, "")],
        "b": [(3, day + 1 * hour, 1, "view", 4.0, ""), (4, day + 40 * hour, 1, None, 3.0, "")],  # the first is far behind
        "c": [(5, day + 2 * hour, 1, None, 8.0, ""), (6, day + 42 * hour, 2, "buy", 16.0, ""), (7, day + 40 * hour, 2, None, 32.0, "")],
    }
    for n, rows in files.items():
        df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        df.astype({"ts": "datetime64[us]"}).to_parquet(folder / f"{n}.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/*.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    order = sorted(got.columns)
    assert plain(got.select(*order).collect()) == plain(want.select(", ".join(f'"{x}"' for x in order)).fetchall())


def test_dates_know_their_entry(spark):
    """One row for each dated token of the jobs, with its entry: the years of a job and its open end are one entry's."""
    sf = "/root/testdata/sf0.001"
    roles, grouped = entry.queries()["date_roles"](spark, sf), entry.queries()["group_entries"](spark, sf)
    key = ["doc_id", "page", "line_index", "token_index", "entry_id"]
    assert roles.count() == roles.join(grouped, key).count() > 0
    assert roles.groupBy("doc_id", "entry_id").count().agg({"count": "max"}).first()[0] == 2

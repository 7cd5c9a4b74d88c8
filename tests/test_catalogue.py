"""Every registered query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from spanloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    # Whole numbers are compared exactly, others to six digits.
    show = lambda v: None if pd.isna(v) else str(int(v)) if isinstance(v, (int, float)) and float(v).is_integer() and not isinstance(v, bool) else f"{v:.6g}" if isinstance(v, float) else str(v)
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, (tuple(map(show, r)) for r in frame.itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA).toPandas()
    if name in catalogue.oracle_sql():
        wanted = duck.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    else:
        assert len(found) > 0


def test_flagship(spark):
    assert catalogue.flagship(spark, DATA).count() > 0


def test_ledger_restore_before_1970(spark, tmp_path):
    ends = {0: (-30_995, -995), 1: (-50_007, -40_001), 2: (-20_003, -10_009), 3: (-5_991, 2_013)}  # blocked, suggested, applied, applied
    events = pd.DataFrame({"event_id": list(ends), "user_id": 1, "event_type": "view", "ts": pd.to_datetime([s for s, _ in ends.values()], unit="ms").astype("datetime64[us]"), "value": [(e - s + 0.5) / 600_000 for s, e in ends.values()]})
    events.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = rows(catalogue.ledger_restore(spark, str(tmp_path)).toPandas())
    assert found == rows(con.sql(catalogue.oracle_sql()["ledger_restore"]).df())
    assert found == rows(pd.DataFrame([(1, -50_000, -39_990), (1, -30_990, -20_000), (1, -9_990, -5_990)], columns=["rec", "s", "e"]))

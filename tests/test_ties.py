"""Values right at a bound: query and SQL must decide them alike, at any order of the rows."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same

import __spark_entry__  # noqa: F401
from arborlens.plans.registry import ORACLE_SQL, QUERIES


def events(tmp_path, rows):
    """rows: (event_id, ts, user_id, event_type); the confidence follows from event_id."""
    own = {"event_id": [r[0] for r in rows], "ts": [r[1] for r in rows], "user_id": [r[2] for r in rows], "event_type": [r[3] for r in rows]}
    t = pa.table({**own, "value": [1.0] * len(rows), "props": ["p"] * len(rows)})
    pq.write_table(t.set_column(1, "ts", t["ts"].cast(pa.timestamp("us"))), f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    for name in "lineitem orders customer part embeddings".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    return c


def test_ages_to_the_microsecond(spark, tmp_path):
    at, day, us = dt.datetime(2025, 6, 1), dt.timedelta(days=1), dt.timedelta(microseconds=1)
    rows = [(i, t, 1, "view") for i, t in enumerate([at - day, at - day + us, at - 365 * day, at - 365 * day - us, at + us, at + day, at + day + us])]
    duck = events(tmp_path, rows)
    got = {r.id: (r.days, r.stale) for r in QUERIES["fn_as_of"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, False), 1: (0, False), 2: (365, False), 3: (365, True), 4: (-1, False), 5: (-1, False), 6: (-2, False)}
    same(QUERIES["fn_as_of"](spark, str(tmp_path)), duck.execute(ORACLE_SQL["fn_as_of"]))


@pytest.mark.parametrize("turn", [1, -1])
def test_means_and_spreads_at_a_bound(spark, tmp_path, turn):
    at = dt.datetime(2024, 1, 1)
    own = lambda *hundredths: [next(i for i in range(100 * k, 100 * k + 100) if i * 37 % 100 == h) for k, h in enumerate(hundredths)]
    # mean 0.60 of 0.70, 0.40, 0.70 and so on in many orders, 0.85, 0.50, and spreads of 0.30
    groups = {1: own(70, 40, 70), 2: own(59, 61, 60), 3: own(84, 86, 85, 85), 4: own(49, 51, 50), 5: own(80, 50), 6: own(40, 10), 7: own(57, 63, 49, 71), 8: own(70, 71, 99, 99, 86, 85), 9: own(35, 64, 51), 10: own(57, 75, 61, 47), 11: own(47, 61, 75, 57)}
    rows = [(i, at, user, "view") for user, ids in groups.items() for i in ids][::turn]
    duck = events(tmp_path, rows)
    assert not {r.taxon for r in QUERIES["q_queue_gaps"](spark, str(tmp_path)).collect()} & {1, 2, 7, 10, 11}
    states = {r.taxon: r.state for r in QUERIES["q_queue_context"](spark, str(tmp_path)).where("field = 'view'").collect()}
    assert (states[1], states[3], states[4], states[5], states[6], states[8], states[9]) == ("fair", "strong", "fair", "fair", "weak", "strong", "fair")
    for name in ("q_queue_gaps", "q_queue_context"):
        same(QUERIES[name](spark, str(tmp_path)), duck.execute(ORACLE_SQL[name]))


def test_a_tasks_share_of_occurrences_is_bounded(spark, data, duck, monkeypatch):
    """Partitions follow from the rows, and the results stay."""
    from arborlens.plans import analogue

    monkeypatch.setattr(analogue, "ROWS_A_TASK", 500)
    rows = analogue.table(spark, data, "lineitem").count()
    assert analogue.occ(spark, data).rdd.getNumPartitions() == -(-rows // 500) > spark.sparkContext.defaultParallelism
    same(QUERIES["agg_map_explode_sum"](spark, data), duck.execute(ORACLE_SQL["agg_map_explode_sum"]))


def test_equal_means_are_not_parted_by_rounding(spark):
    """Means of 5 by one weight and by three, whose sums in doubles fall short of 5: taxa follow their number."""
    from arborlens.operators.ranking import leaf_scores

    occ = spark.createDataFrame([(1, 2, 5), (2, 2, 5), (3, 2, 5), (1, 1, 5)], "tile long, taxon long, n long")
    eco = spark.createDataFrame([(1, 1, 0.1), (2, 2, 0.2), (3, 3, 0.4)], "tile long, eco long, weight double")
    none = spark.createDataFrame([], "taxon long")
    got = {r.taxon: (r.affinity, r.leaf_score) for r in leaf_scores(occ, eco, none, none).collect()}
    assert got == {1: (5.0, 0.0), 2: (5.0, 100.0)}

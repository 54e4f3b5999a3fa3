"""SQL that states one result, however its engine orders equal rows."""

import duckdb

from tideline.plans import registry


def test_widened_windows_sql_leaves_no_ties():
    """Equal spans are one span: which of them comes first may not decide whether an island starts there."""
    db = duckdb.connect()
    db.execute(
        """CREATE TABLE lineitem AS SELECT hash(i) % 50 AS l_suppkey, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * CAST(hash(i + 1) % 3000 AS INTEGER) AS l_shipdate,
        CASE WHEN hash(i * 3) % 2 = 0 THEN 'N' ELSE 'R' END AS l_returnflag, 1.0 + hash(i * 7) % 2 AS l_quantity FROM range(400000) t(i)"""
    )
    got = set(db.sql(registry.ORACLES["widened_windows"]).fetchall())
    pad, hour, spans = 21_600_000_000, 3_600_000_000, {}
    for g, us, flag, hours in db.sql("SELECT l_suppkey, epoch_us(l_shipdate), l_returnflag, CAST(l_quantity AS BIGINT) FROM lineitem").fetchall():
        spans.setdefault(g, []).append((us - pad, us + pad, True) if flag == "N" else (us, us + hours * hour, False))
    want = set()
    for g, rows in spans.items():
        low = high = None
        fresh = False
        for lo, hi, new in [*sorted(rows), (float("inf"), 0, False)]:
            if low is not None and lo <= high:
                high, fresh = max(high, hi), fresh or new
                continue
            if fresh:
                want.add((g, low, high))
            low, high, fresh = lo, hi, new
    assert got == want


def test_retag_due_reads_the_vectors(spark, tmp_path):
    """Pictures without a vector count nowhere, and statistics that moved are told from groups that grew."""
    rows = [(i, [1.0 if i % 3 else 9.0], 1) for i in range(60)] + [(100 + 3 * i + 1, [2.0], 2) for i in range(45)] + [(900 + i, None, 2) for i in range(30)] + [(1000 + i, [1.0], 3) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in registry.QUERIES["retag_due"](spark, str(tmp_path)).collect()}
    assert got == {(1, 60, True, True), (2, 45, False, False), (3, 30, False, False)}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert set(db.sql(registry.ORACLES["retag_due"]).fetchall()) == got


def test_interest_scores_take_each_line_once(spark, tmp_path):
    """Two distinct counts don't copy the lines, and orders that the table holds twice count them twice, as the SQL says."""
    orders = [(i, i * 7, "FOP"[i % 3]) for i in range(40)] + [(3, 21, "F"), (3, 22, "F"), (5, 35, None)]
    lines = [(i % 45, i * 11 % 60, None if i % 13 == 0 else i % 7, i % 4 + 1, None if i % 17 == 0 else i % 9 / 100, i % 5 / 100, [None, "R", "N"][i % 3]) for i in range(300)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    for name in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("interest_scores", "place_stats_routine"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(db.sql(registry.ORACLES[name]).fetchall(), key=key)

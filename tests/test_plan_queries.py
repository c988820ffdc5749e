"""Registered queries without SQL over small tables of their own."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from stratalens.plans import loader_queries, queries


def test_sgml_udtf_keeps_every_turn(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(45)]
    rows += [(2, None, "user", "no turn"), (2, 0, None, "a"), (2, 25, "user", None), (2, 25, "user", "again"), (3, 7, "user", "two\nlines")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["sgml_udtf"](spark, str(tmp_path)).select("path", "filename", "type", "n_chars", "error").collect())
    want = [("1", f"t{t}.txt", "user" if t % 2 == 0 else "assistant", len(f"text {t}"), "") for t in range(45)]
    want += [("2", "t.txt", "user", 7, ""), ("2", "t0.txt", "", 1, ""), ("2", "t25.txt", "user", 0, ""), ("2", "t25.txt", "user", 5, "duplicate_name"), ("3", "t7.txt", "user", 9, "")]
    assert got == sorted(want)


def test_alias_components_over_all_rows(spark, tmp_path):
    """One giant component, small ones, links in several years, repeated and null rows; against union-find."""
    rnd = random.Random(4)
    rows = [(rnd.randrange(60), rnd.randrange(40)) for _ in range(80)] + [(k, 7) for k in range(25)] + [(100 + k, 100 + k) for k in range(10)] + [(3, 9)] * 3
    parent: dict[str, str] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for o, p in rows:
        a, b = sorted((root(f"o{o}"), root(f"p{p}")))
        parent[b] = a
    table = [(o, p, datetime(1992 + k % 7, 1 + k % 12, 1)) for k, (o, p) in enumerate(rows)] + [(None, 1, None), (1, None, None)]
    spark.createDataFrame(table, "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in queries.QUERIES["alias_components"](spark, str(tmp_path)).collect()]
    assert len(got) == len(parent) and dict(got) == {n: root(n) for n in parent}


def test_rounded_conflicts_at_the_edge_of_two_intervals(spark, tmp_path):
    """18.33 and 18.43 to one decimal would touch as decimals; as SQL casts the doubles, they don't."""
    day = datetime(2024, 1, 10, 1)
    rows = [(1, day, 137, "view", 18.33, '{"k": 98}'), (2, day, 137, "view", 18.43, '{"k": 32}'), (3, day, 138, "view", 18.33, '{"k": 98}'), (4, day, 138, "view", 18.40, '{"k": 32}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r["user_id"], r["n_facts"]) for r in queries.QUERIES["dup_fact_rounded_conflict"](spark, str(tmp_path)).collect()]
    import duckdb

    sql = duckdb.execute(f"with events as (from '{tmp_path}/events.parquet/*.parquet') select user_id, n_facts from ({queries.ORACLE['dup_fact_rounded_conflict']})").fetchall()
    assert got == sql == [(137, 2)]


def test_empty_first_part_is_no_diagnostic(spark, tmp_path):
    """Spark writes a first part file without rows where the first split of the orders has none."""
    row = (1, 2, "F", 10.5, datetime(1995, 1, 2), "5-LOW")
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame([row], schema).where(F.col("o_orderkey") > 1).write.parquet(f"{tmp_path}/none/orders.parquet")
    rows, bad = loader_queries.loaded(spark, f"{tmp_path}/none")
    assert rows.count() == 0 and bad.count() == 0


def test_precedence_by_columns(spark):
    from stratalens.operators import registry

    table = spark.createDataFrame([("a", 1, "F1", "r1"), ("a", 1, "F1", "r1"), ("a", 2, "F2", "r2"), ("a", 2, "F3", "r3"), ("b", 5, "F5", "r5"), ("b", 6, "F6", "r6"), ("c", 1, "F7", "r7")], "id_type string, id_value long, figi string, row_id string")
    rows = spark.createDataFrame([(1, 5, 9), (2, 5, 9), (3, 5, 9), (3, 8, 9), (None, 6, None), (None, None, None), (9, None, 1)], "x long, y long, z long")
    kinds = [("a", "x"), ("b", "y"), ("c", "z")]
    each = rows.select("*", F.posexplode(F.array(*(F.struct(F.lit(k).alias("id_type"), F.col(c).alias("id_value")) for k, c in kinds))).alias("pos", "k")).select(*rows.columns, "pos", "k.*")
    got = registry.by_columns(rows, table, kinds)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(registry.by_precedence(each, table, rows.columns).collect(), key=key)

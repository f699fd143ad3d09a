"""The messy sales rows: numbered in order whatever keys repeat, and cleaned without meeting their keys again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from registered import cleaning, inputs, matching


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with keys that repeat, are null, or meet nothing."""
    root = str(tmp_path_factory.mktemp("tables"))
    made = {
        "region": ("r_regionkey int, r_name string", [(0, "WEST")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "PERU", 0), (0, "PERU B", 0), (1, "CHAD", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(k, f"Customer#{k}", k % 2, 1.0, "TOOLS") for k in range(6)] + [(1, "Customer#1 again", 0, 1.0, "TOOLS"), (None, "Nobody", 0, 1.0, "TOOLS")]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(k, f"Supplier#{k}", 0, 1.0) for k in (0, 1, 1, None)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
                 [(k, f"part {k}", "B", "T", 1, 2.0) for k in (0, 1, 2, 2, 2, None)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate date", None),
        "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double",
                     [(k % 40 if k % 37 else None, k % 3 if k % 5 else None, k % 4, k % 3, float(k), 10.5 + k % 2) for k in range(400)] * 2),
    }
    for name, (schema, rows) in made.items():
        if rows is None:
            df = spark.range(45).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.expr("date_add(date'2020-01-30', cast(id AS int))").alias("o_orderdate"))
            df = df.unionByName(df.filter("o_orderkey % 9 = 0"))
        else:
            df = spark.createDataFrame(rows, schema)
        df.write.parquet(f"{root}/{name}.parquet")
    return root


def test_rows_and_their_order(spark, tables):
    got = inputs.messy_sales(spark, tables).collect()
    want = inputs.run(spark, tables, inputs.MESSY_SALES)
    assert Counter(tuple(r[c] for c in want.columns) for r in got) == Counter(map(tuple, want.collect())) and len(got) > 500
    assert len({r.pos for r in got}) == len(got) and min(r.pos for r in got) >= 0
    key = lambda r: tuple((r[c] is not None, r[c] or 0) for c in inputs.ORDER_KEY)
    assert [key(r) for r in sorted(got, key=lambda r: r.pos)] == sorted(map(key, got))


@pytest.mark.parametrize("query", [cleaning.project_schema, cleaning.dropped_rows, matching.conform_sheet, matching.conformed])
def test_cleaned_rows_keep_their_keys_without_a_join(spark, tables, query):
    plan = query(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_first_of_equal_rows_keeps_its_own_keys(spark, tables):
    own = {tuple(r[c] for c in inputs.ORDER_KEY): r.sku_raw for r in inputs.messy_sales(spark, tables).collect()}
    got = cleaning.dedupe_exact(spark, tables).collect()
    assert got and all(own[tuple(r[c] for c in inputs.ORDER_KEY)] == r.sku for r in got)


def test_numbers_are_made_before_the_names_arrive(spark, tables, monkeypatch):
    seen = []
    monkeypatch.setattr(inputs, "derived_once", lambda name, s, d, build: seen.append(build()) or seen[0])
    plan = inputs.messy_sales(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan

"""The bucketed dimension store: typed null-safe keys, loads that share keys, and the plans."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import declared as D, siblings as S
from ledgerloom.sources.staging import Store


def column(table, name, type_, role, source="", references=""):
    return {"table": table, "name": name, "type": type_, "role": role, "source": source, "references": references}


SPEC = D.StarSpec(
    [{"table": "dim_place", "kind": "dimension", "natural_key": ["country", "code"]}, {"table": "dim_pair", "kind": "dimension", "natural_key": []},
     {"table": "fact_visits", "kind": "fact", "natural_key": []}],
    [column("dim_place", "place_key", "integer", "pk"), column("dim_place", "country", "text", "attribute", "S.country"),
     column("dim_place", "code", "integer", "attribute", "S.code"), column("dim_place", "label", "text", "attribute", "S.label"),
     column("dim_pair", "pair_key", "integer", "pk"), column("dim_pair", "code", "integer", "attribute", "S.code"), column("dim_pair", "country", "text", "attribute", "S.country"),
     column("fact_visits", "visit_key", "integer", "pk"), column("fact_visits", "place_key", "integer", "fk", "", "dim_place.place_key"),
     column("fact_visits", "pair_key", "integer", "fk", "", "dim_pair.pair_key"), column("fact_visits", "n", "integer", "measure", "S.n")],
)
SCHEMA = [{"name": n, "source": n, "include": True} for n in ("country", "code", "label", "n")]


def tabs(spark, rows, pos="long"):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pos long, country string, code long, label string, n long").repartition(3)
    df = df if pos == "long" else df.withColumn("pos", F.struct("pos", F.lit("x").alias("y")))
    return {"S": S.Tab.of("S", df, SCHEMA)}


def places(store):
    return {(r.country, r.code): r.label for r in D.read_declared(store, "dim_place").collect()}


@pytest.fixture
def store(spark, tmp_path):
    st = Store(spark, str(tmp_path / "star"), "ai_")
    D.ensure_tables(st, SPEC)
    return st


FIRST = [("de", 1, "a", 1), ("de", 1, "later", 2), ("de", None, "gap", 3), (None, 1, "gap too", 4), (None, None, "none", 5), ("1", None, None, 6), ("fr", 2, None, 7)]
SECOND = [("fr", 2, "known", 8), ("it", 3, "new", 9), (None, 1, "known", 10), ("it", 3, "new later", 11)]


def test_loads_that_share_keys_do_not_double_rows(spark, store):
    for upload, rows, pos in (("u1", FIRST, "long"), ("u2", SECOND, "struct"), ("u1", FIRST, "struct")):
        D.load(store, SPEC, tabs(spark, rows, pos), upload)
    assert places(store) == {("de", 1): "a", ("de", None): "gap", (None, 1): "gap too", ("1", None): None, ("fr", 2): None, ("it", 3): "new"}
    assert D.read_declared(store, "dim_place").count() == 6 and D.read_declared(store, "dim_pair").count() == 6
    facts, dim = D.read_declared(store, "fact_visits"), D.read_declared(store, "dim_place")
    got = {(r.n, r.country, r.code) for r in facts.join(dim, "place_key").collect()}
    assert got == {(n, c, k) for c, k, _, n in FIRST + SECOND if (c, k) != (None, None)}
    assert facts.filter("place_key IS NULL").select("n").collect() == [(5,)]
    assert facts.count() == facts.select("visit_key").distinct().count() == 11
    assert {r.orphans for r in D.fk_orphans(store, SPEC).collect()} == {0}


def test_only_touched_buckets_are_written(spark, store):
    many = [("de", k, "x", k) for k in range(200)]
    D.load(store, SPEC, tabs(spark, many), "u1")
    files = lambda: {r.f for r in spark.read.parquet(store.data_path("dim_place")).select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    assert len(before) > 20
    D.load(store, SPEC, tabs(spark, many[:50]), "u2")
    assert files() == before
    D.load(store, SPEC, tabs(spark, [("it", 1, "y", 1)]), "u3")
    assert len(before - files()) <= 1 and len(files() - before) == 1
    assert D.read_declared(store, "dim_place").count() == 201


def test_colliding_surrogate_keys_are_told_apart(spark, store, monkeypatch):
    plain = D._hash
    # the first choice of every key of the table meets in three values
    monkeypatch.setattr(D, "_hash", lambda c, *first: F.pmod(plain(c, *first), F.lit(3)) if len(first) == 1 else plain(c, *first))
    D.load(store, SPEC, tabs(spark, [("de", k, "x", k) for k in range(20)]), "u1")
    D.load(store, SPEC, tabs(spark, [("de", k, "x", k) for k in range(30)]), "u2")
    dim = D.read_declared(store, "dim_place")
    assert dim.count() == dim.select("place_key").distinct().count() == 30


def test_widened_dimensions_keep_old_rows_and_an_empty_upload_takes_its_facts_back(spark, store):
    D.load(store, SPEC, tabs(spark, FIRST), "u1")
    wider = D.StarSpec(SPEC.tables, [*SPEC.columns, column("dim_place", "again", "text", "attribute", "S.label")])
    D.ensure_tables(store, wider)
    D.load(store, wider, tabs(spark, SECOND), "u2")
    assert {(r.country, r.code): r.again for r in D.read_declared(store, "dim_place").collect() if r.again} == {("it", 3): "new"}
    D.load(store, wider, tabs(spark, []), "u1")
    assert len(places(store)) == 6 and D.read_declared(store, "fact_visits").count() == 4


def test_a_load_without_new_keys_moves_no_source_rows_for_them(spark, store, monkeypatch):
    D.load(store, SPEC, tabs(spark, FIRST), "u1")
    made, plain = {}, D.durable
    monkeypatch.setattr(D, "durable", lambda df, label, *by: made.setdefault(label, df) and plain(df, label, *by))
    D.load(store, SPEC, tabs(spark, FIRST), "u1")
    assert made["missing-dim_place"].count() == 0 and not any(label.startswith(("new-", "old-", "clash-")) for label in made)
    # keys whose number is their hash are not looked up
    assert made["odd-dim_place"].count() == 0 and made["odd-dim_pair"].count() == 0


def test_facts_find_keys_that_have_other_numbers(spark, store, monkeypatch):
    plain = D._hash
    with monkeypatch.context() as m:
        m.setattr(D, "_hash", lambda c, *first: F.pmod(plain(c, *first), F.lit(3)) if len(first) == 1 else plain(c, *first))
        D.load(store, SPEC, tabs(spark, [("de", k, "x", k) for k in range(20)] + [(None, None, "none", 99)]), "u1")
    # numbers that the first load gave are no hashes of their keys for the second one
    D.load(store, SPEC, tabs(spark, [("de", k, "x", k) for k in range(10, 30)]), "u2")
    facts, dim = D.read_declared(store, "fact_visits"), D.read_declared(store, "dim_place")
    assert facts.join(dim, "place_key").filter("code = n AND country = 'de'").count() == 40
    assert facts.filter("place_key IS NULL").select("n").collect() == [(99,)]

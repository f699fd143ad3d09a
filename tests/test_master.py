"""Fold, golden records, staging and star invariants."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import fold as FO, master as M, star as W
from ledgerloom.operators.grouping import connected_components
from ledgerloom.plans.mastering import MasterState, rebuild_star
from ledgerloom.session import scratch_path
from ledgerloom.sources.delimited import scan_delimited
from ledgerloom.sources.staging import Staging
from test_functions import token_set_model


def walk(names):
    """The fold as a plain loop over buckets in order."""
    root = {}
    for i, a in enumerate(names):
        if i in root:
            continue
        for j in range(i + 1, len(names)):
            if j not in root and names[i] and names[j] and token_set_model(a, names[j]) >= 90:
                root[j] = i
    return {(names[j], names[i]) for j, i in root.items()}


def spellings(seed, n):
    rnd = random.Random(seed)
    words = ["liquors", "lavallette", "bottle", "shop", "wine", "bar", "cook", "grill", "harbor", "spritz", "venetian", "house"]
    out = []
    for _ in range(n):
        name = rnd.sample(words, rnd.randint(1, 4))
        kind = rnd.random()
        if kind < 0.4:
            w = list(name[0])
            at = rnd.randrange(len(w))
            if rnd.random() < 0.5:
                del w[at]
            else:
                w.insert(at, rnd.choice("abcxyz"))
            name[0] = "".join(w)
        elif kind < 0.6:
            name.append("liquors")
        out.append(" ".join(name))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("names", [
    spellings(5, 220),
    [f"customer {i * 37 % 1000:09d}" for i in range(150)],
    ["a", "b", "ab", "a b", "", "abc", "abd", "abcd", "x y z", "z y x", "y", "aa", "aaa", "aaaa"],
    ["the very long trading company of the northern harbor and its many daughters limited " + "abcdefghij"[i % 10] * (i % 4) + str(i // 10) for i in range(40)],
])
def test_fold_equals_walk(spark, names):
    names = list(dict.fromkeys(names))
    df = spark.createDataFrame([(n, n, i) for i, n in enumerate(names)], "key string, name string, first_pos bigint")
    got = {(r["key"], r["root"]) for r in FO.fold_names(df).collect()}
    assert got == walk(names)


def test_fold_in_parts_equals_walk_and_stores_few_pairs(spark, monkeypatch):
    """Texts that nearly all match each other: the rest looks up roots only."""
    monkeypatch.setattr(FO, "FEW", 30)
    monkeypatch.setattr(FO, "PAIRS", 4)
    rnd, stored = random.Random(6), []
    names = [f"customer {rnd.randint(0, 99999):09d}" for _ in range(80)] + spellings(8, 10)
    rnd.shuffle(names)
    names = list(dict.fromkeys(names))
    real = FO.durable
    monkeypatch.setattr(FO, "durable", lambda df, label, by=None: (lambda out: (stored.append((label, out.count())), out)[1])(real(df, label)))
    df = spark.createDataFrame([(n, n, i) for i, n in enumerate(names)], "key string, name string, first_pos bigint")
    got = {(r["key"], r["root"]) for r in FO.fold_names(df).collect()}
    assert got == walk(names)
    assert sum(n for label, n in stored if label == "fold-edges") <= 12 * len(names) and sum(label == "fold-head" for label, _ in stored) >= 1


def test_fold_finds_every_matching_pair(spark):
    names = sorted({" ".join(sorted(set(n.split()))) for n in spellings(11, 200)})
    sigs = spark.createDataFrame([(n, len(n), i) for i, n in enumerate(names)], "sig string, a int, pos bigint")
    got = {(r["a"], r["b"]) for r in FO.matching_pairs(sigs).collect()}
    want = {(x, y) for i, x in enumerate(names) for y in names[i + 1:] if token_set_model(x, y) >= 90}
    assert got == want


def test_fold_looks_up_few_pairs_among_equal_beginnings(spark):
    """Names of one length next to a few of other lengths: only those that differ by a letter meet."""
    names = [f"customer {i * 7919 % 100000:09d}" for i in range(150)] + ["custome 000007919", "customers 000007919 x"]
    sigs = spark.createDataFrame([(" ".join(sorted(n.split())), len(n), i) for i, n in enumerate(names)], "sig string, a int, pos bigint")
    assert FO.lookups(sigs).most_pairs() <= 10 * len(names)


def test_fold_finds_pairs_whose_words_change_places(spark):
    names = ["axxxxxxxx mm", "mm zxxxxxxxx", "bc defghijklmno", "bcdefghijklmnoq", "ab cdefghijk lm", "abcdefghijkx lm", "m abcdefghijklm", "n abcdefghijklm"]
    names = [" ".join(sorted(n.split())) for n in names]
    sigs = spark.createDataFrame([(n, len(n), i) for i, n in enumerate(names)], "sig string, a int, pos bigint")
    got = {tuple(sorted((r["a"], r["b"]))) for r in FO.matching_pairs(sigs).collect()}
    want = {tuple(sorted((x, y))) for i, x in enumerate(names) for y in names[i + 1:] if token_set_model(x, y) >= 90}
    assert got == want and len(want) >= 3


def test_hot_token_is_salted_not_dropped(spark, monkeypatch):
    monkeypatch.setattr(FO, "ROWS_PER_SALT", 3)
    names = [f"liquors {w}" for w in ("alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma")] + ["liquors"]
    sigs = spark.createDataFrame([(" ".join(sorted(n.split())), len(n), i) for i, n in enumerate(names)], "sig string, a int, pos bigint")
    got = {tuple(sorted((r["a"], r["b"]))) for r in FO.matching_pairs(sigs).collect()}
    assert len(got) == 7 and all("liquors" in p for p in got)


def test_components(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("f", "g")], "a string, b string")
    got = {r["id"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", "g": "f"}


def rows(spark, data):
    return spark.createDataFrame(
        [(i, "sales", "u", *r) for i, r in enumerate(data)],
        "pos bigint, source_table string, upload_id string, customer_id string, customer string, product_code string, product string, vendor string, region string, amount double",
    )


DATA = [
    ("C1", "Bar One", "P1", "Sera Luce Spritz", "V", None, 1.0), ("c1", "BAR ONE", "P1", "Sera Luce Spritz", "V", "NJ", 2.0),
    (None, "Cook Bar", None, 'Sera Luce "Venetian Spritz" Cocktail', "V", "NY", 3.0), (None, "Bar Cook", None, "Sera Luce - Venetian Spritz", "W", "PA", 4.0),
    (None, "  ", "P2", None, None, None, 5.0), (None, "Lavallette Liquors", "P2", "Keg", "W", None, 6.0), (None, "Lavalette Liquors", "P2", "Keg", "W", "CT", 7.0),
]


def test_keys_are_made_for_couples_of_id_and_name(spark):
    rows = spark.createDataFrame(
        [(1, "s", "A-1", "Tom"), (2, "s", "a 1", "Tom"), (3, "s", None, "Tom#2"), (4, "s", " ", "tom 2"), (5, "s", None, None), (6, "s", "A-1", "Tom"), (7, "s", "A-1", None)],
        "pos long, source_table string, customer_id string, customer string")
    found = M.instances(rows, M.SPECS["customer"])
    assert sorted((r.key, r.name or "", r.id or "", r.n, r.first_pos) for r in found.collect()) == [
        ("a 1", "", "A-1", 1, 7), ("a 1", "Tom", "A-1", 2, 1), ("a 1", "Tom", "a 1", 1, 2), ("name:tom 2", "Tom#2", "", 1, 3), ("name:tom 2", "tom 2", "", 1, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    grouped, _, rows_plan = plan.partition("+- ")
    assert "regexp_replace" in grouped and "regexp_replace" not in rows_plan


def test_golden_records(spark):
    got = {r["name"]: r for r in M.golden_records(rows(spark, DATA), "customer").collect()}
    assert set(got) == {"Bar One", "Cook Bar", "Lavallette Liquors"}
    assert got["Bar One"]["ids"] == ["C1", "c1"] and got["Bar One"]["region"] == "NJ"
    assert got["Cook Bar"]["name_variants"] == ["Bar Cook", "Cook Bar"] and got["Cook Bar"]["region"] == "NY"
    assert got["Lavallette Liquors"]["instance_count"] == 2 and got["Lavallette Liquors"]["region"] == "CT"
    products = {r["name"] for r in M.golden_records(rows(spark, DATA), "product").collect()}
    assert 'Sera Luce "Venetian Spritz" Cocktail' in products and "Sera Luce - Venetian Spritz" not in products
    key = spark.range(1).select(M.golden_id("customer", F.lit("name:bar"))).first()[0]
    assert key == "cus_38ac4b38a5"


def test_golden_ids_ignore_physical_order(spark):
    df = rows(spark, DATA)
    a = sorted(r["golden_id"] for r in M.golden_records(df, "customer").collect())
    b = sorted(r["golden_id"] for r in M.golden_records(df.orderBy(F.rand(3)).repartition(5), "customer").collect())
    assert a == b


def test_star_and_foreign_keys(spark):
    root = scratch_path(spark, "star-test")
    star = W.build_star(rows(spark, DATA), ["sales"])
    W.publish(star, root)
    stored = W.read_star(spark, root)
    assert stored.fact_sales.count() == len(DATA)
    assert all(r["violations"] == 0 for r in W.fk_violations(stored.fact_sales, stored.tables()).collect())
    view = W.sales_view(stored, limit=3).collect()
    assert [r["amount"] for r in view] == [1.0, 2.0, 3.0] and view[0]["customer"] == "Bar One"
    star.fact_sales = star.fact_sales.withColumn("vendor_golden_id", F.lit("ven_0000000000"))
    with pytest.raises(W.ForeignKeyError):
        W.publish(star, root)
    assert W.read_star(spark, root).fact_sales.filter("vendor_golden_id = 'ven_0000000000'").count() == 0


def test_staging_is_idempotent_and_widens(spark):
    st = Staging(spark, scratch_path(spark, "staging-test"))
    df = spark.createDataFrame([(2, "1,000", "x"), (1, "bad", " ")], "pos bigint, amount string, name string")
    assert st.write("Sales 1", df, {"amount": "decimal"}, "u1")["added_columns"] == ["amount"]
    for _ in range(2):
        done = st.write("Sales 1", df, {"amount": "string", "name": "string"}, "u2")
    assert done["rows"] == 2 and st.columns("Sales 1") == {"amount": "decimal", "name": "string"}
    assert st.read("Sales 1").count() == 4 and st.read("Sales 1").filter("upload_id = 'u1' and name is not null").count() == 0
    assert [r["amount"] for r in st.read_table("Sales 1", 4).collect()] == [None, 1000.0, None, 1000.0]
    assert st.write("Sales 1", df.limit(0), {"amount": "decimal"}, "u1")["rows"] == 0
    assert st.list_tables().first()["partitions"] == ["u2"]
    assert st.delete_upload("u2") == 1 and st.read("Sales 1").count() == 0


@pytest.mark.parametrize("multiline", [True, False])
def test_delimited_files(spark, tmp_path, multiline):
    quoted = '"two\nlines"' if multiline else '"two, parts"'
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + f'Name,Code\n"He said ""hi""",007\n\n{quoted},1.50,extra\n'.encode())
    (tmp_path / "b.tsv").write_text("A\tB, C\tD\n1\t2\t3\n")
    got = scan_delimited(spark, str(tmp_path), multiline=multiline).orderBy("file", "row_no").collect()
    grid = [[c and (c["kind"], c["text"]) for c in r["cells"]] for r in got]
    assert grid[0] == [("str", "Name"), ("str", "Code")]
    assert grid[1] == [("str", 'He said "hi"'), ("int", "7")]
    assert grid[2] == [("str", "two\nlines" if multiline else "two, parts"), ("float", "1.5"), ("str", "extra")]
    assert grid[3:] == [[("str", "A"), ("str", "B, C"), ("str", "D")], [("int", "1"), ("int", "2"), ("int", "3")]]


def test_states_of_uploads_equal_a_full_rebuild(spark):
    """A rebuild after one more upload reads states only, and gives what all rows give."""
    rng, st = random.Random(4), Staging(spark, scratch_path(spark, "state-test"))
    state = MasterState(st)
    types = {"customer_id": "string", "customer": "string", "vendor": "string", "region": "string", "amount": "decimal"}
    names = spellings(3, 60)

    def upload(u, n):
        data = [(k, rng.choice([None, f"C{rng.randint(0, 20)}"]), rng.choice([None, *names]), rng.choice(["V", "W", None]), rng.choice(["NJ", "NY", None]), "1") for k in range(n)]
        st.write("Sales", spark.createDataFrame(data, "pos long, " + ", ".join(f"{c} string" for c in types)), types, u)

    def shown(golden):
        return {e: (sorted(map(str, g.records.collect())), *(sorted(map(tuple, x.collect())) for x in (g.ids, g.names, g.sources))) for e, g in golden.items()}

    for u, n in (("a", 80), ("c", 60)):
        upload(u, n)
    assert state.catch_up() == 2 and state.catch_up() == 0
    upload("b", 5)
    state.update("Sales", "b")
    assert state.catch_up() == 0
    rows = st.harvest()
    assert shown(state.golden()) == shown({e: M.golden(M.instances(rows, M.SPECS[e]), e) for e in M.SPECS})
    assert all("/master/" in f for e in M.SPECS for f in state.read(e).inputFiles())
    # an upload that is replaced, emptied or removed leaves nothing behind
    upload("c", 0)
    state.update("Sales", "c")
    st.delete_upload("a")
    state.delete_upload("a")
    assert shown(state.golden()) == shown({e: M.golden(M.instances(st.harvest(), M.SPECS[e]), e) for e in M.SPECS})
    star = rebuild_star(st)
    facts = star.fact_sales.orderBy("fact_id").collect()
    assert [f["fact_id"] for f in facts] == [1, 2, 3, 4, 5] and [f["pos"] for f in facts] == sorted(f["pos"] for f in facts)
    assert [r["fact_id"] for r in W.sales_view(star, 2).collect()] == [1, 2]


def test_golden_ids_that_meet_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(M, "golden_id", lambda entity, key: F.concat(F.lit("cus_"), F.length(key).cast("string")))
    got = {r["key"]: r["golden_id"] for r in M.unique_ids(spark.createDataFrame([("aa", 1), ("bb", 2), ("ccc", 3)], "key string, x int"), "customer").collect()}
    assert got["aa"] == "cus_2" and got["ccc"] == "cus_3" and len(got["bb"]) == 44 and len(set(got.values())) == 3


def indexes(spark, ids, names):
    return M.Index(spark.createDataFrame(ids, "id string, golden_id string"), spark.createDataFrame(names, "name_form string, golden_id string"))


def test_a_row_meets_one_number_for_each_entity(spark):
    """Couples are looked up by id, else by name; rows move once for each entity, without texts that nobody uses."""
    data = [(1, "A", "Tom"), (2, "A", None), (3, "B", "Tom"), (4, None, "Tom"), (5, None, " "), (6, "X", "Nobody"), (7, " ", None), (8, "Tom", None)]
    df = spark.createDataFrame(data, "pos long, customer_id string, customer string")
    found = {"customer": indexes(spark, [("A", "cus_00000000aa"), ("B", "cus_" + "0b" * 20)], [("tom", "cus_00000000cc")])}
    want = {1: "cus_00000000aa", 2: "cus_00000000aa", 3: "cus_" + "0b" * 20, 4: "cus_00000000cc", 5: None, 6: None, 7: None, 8: None}
    assert {r.pos: r.customer_golden_id for r in M.lookups(df, found).collect()} == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = M.lookups(df, found).select("pos", "customer_golden_id")
        plan = moved._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and {r.pos: r.customer_golden_id for r in moved.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_golden_ids_of_other_forms_and_equal_numbers(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"C{k}", None) for k in range(20)], "pos long, customer_id string, customer string")
    found = {"customer": indexes(spark, [(f"C{k}", f"cus_Z{k}") for k in range(20)], [])}
    real, seeds = M._couple, []
    # the first seed gives two couples one number, the second one that is kept free
    monkeypatch.setattr(M, "_couple", lambda i, n, seed: (seeds.append(seed), F.length(i).cast("long") + 9000 if seed == 0 else F.substring(i, 2, 9).cast("long") if seed == 1 else real(i, n, seed))[1])
    got = M.lookups(df, found).collect()
    assert {r.pos: r.customer_golden_id for r in got} == {k: f"cus_Z{k}" for k in range(20)} and max(seeds) == 2


def test_foreign_keys_are_counted_in_one_pass(spark):
    fact = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), ("b", "x"), (None, None)], "k string, m string")
    dims = {"d": spark.createDataFrame([("a",)], "golden_id string"), "e": spark.createDataFrame([("x",), ("y",)], "golden_id string")}
    lost = W.fk_violations(fact, dims, {"k": "d", "m": "e"})
    assert {(r["foreign_key"], r["references"], r["violations"]) for r in lost.collect()} == {("k", "d", 2), ("m", "e", 0)}
    assert lost._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [k#") == 1


def test_upload_rows_are_cleaned_once_and_not_copied(spark, monkeypatch):
    from registered import warehouse as R

    made = []
    monkeypatch.setattr(R, "durable", lambda df, label, by=None: made.append(label))
    monkeypatch.setattr(R, "conformed", lambda s, d: s.createDataFrame([(k, k, f"C{k}") for k in range(9)], "pos long, l_orderkey long, customer string"))
    monkeypatch.setattr(R, "products", lambda s, d: s.createDataFrame([(0, "P", "p", 1.0, "2")], "pos long, product_code string, product string, unit_price double, unit_size string"))
    st = R.warehouse(spark, scratch_path(spark, "no-tables"))
    assert st.read("Sales").count() == 9 and "conformed" not in made

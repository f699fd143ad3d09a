"""Dense numbering against plain Python."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators.numbering import free_name, numbered


def test_numbers_follow_the_order_without_gaps(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"] + ["hot"] * 4), rng.randint(0, 50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, _mid long").repartition(7)
    got = numbered(df, [F.desc("v"), F.asc("_mid")], "n", total="all").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert [(r.g, r.v, r._mid) for r in sorted(got, key=lambda r: r.n)] == want
    assert [r.n for r in sorted(got, key=lambda r: r.n)] == list(range(1, 3001)) and {r["all"] for r in got} == {3000}


def test_numbers_within_groups_and_of_nothing(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"] + ["hot"] * 4), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(5)
    got = numbered(df, [F.asc_nulls_first("g"), F.asc("k")], "n", per=["g"], total="size").collect()
    for g in (None, "a", "b", "hot"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.n)
        assert [r.k for r in own] == sorted(k for x, k in rows if x == g)
        assert [r.n for r in own] == list(range(1, len(own) + 1)) and {r["size"] for r in own} == {len(own)}
    assert numbered(df.limit(0), [F.asc("k")], "n").count() == 0
    assert free_name(df, "G") == "_G"


def test_numbers_in_blocks_move_rows_once_and_write_none(spark, monkeypatch):
    from ledgerloom.operators import numbering as N

    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(3)
    places = [None, *rng.sample(range(-50, 4000), 900), *rng.sample(range(1 << 41, (1 << 41) + 900), 300)]
    df = spark.createDataFrame([(p, k) for k, p in enumerate(places)], "pos long, k int").repartition(6)
    begin, written = N.block_starts(df.select("pos")), []
    monkeypatch.setattr(N, "durable", lambda *a: written.append(a))
    numbered_rows = N.numbered_in_blocks(df, "pos", "n", begin)
    got = sorted(numbered_rows.collect(), key=lambda r: r.n)
    assert [r.pos for r in got] == sorted(places, key=lambda p: (p is not None, p or 0)) and [r.n for r in got] == list(range(1, len(places) + 1))
    assert not written and "rangepartitioning" not in numbered_rows._jdf.queryExecution().executedPlan().toString()


def test_starts_add_up_what_smaller_keys_have(spark):
    from ledgerloom.operators.numbering import starts

    counts = {k: 1 + k * 7 % 5 for k in range(-300, 3000, 3)} | {None: 4}
    got = {r.k: r.at for r in starts(spark.createDataFrame(list(counts.items()), "k long, n long").repartition(5), "k", "n", "at").collect()}
    total = 0
    for k in sorted(counts, key=lambda k: (k is not None, k or 0)):
        assert got[k] == total
        total += counts[k]

"""Text, casts and ratios against plain Python models."""

import random

from pyspark.sql import functions as F, types as T

from ledgerloom.functions import casts, similarity as S, text as X


def one(spark, values, schema, expr):
    df = spark.createDataFrame([(v,) for v in values], f"v {schema}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_cells_are_typed(spark):
    got = one(spark, ["007", "-.5", ".", "1.2.3", "1e5", "-", "-0", "5.", "", None, "x"], "string", casts.typed_cell)
    assert [None if c is None else (c["kind"], c["text"]) for c in got] == [
        ("int", "7"), ("float", "-0.5"), ("str", "."), ("str", "1.2.3"), ("str", "1e5"), ("str", "-"), ("int", "0"), ("float", "5.0"),
        None, None, ("str", "x"),
    ]
    kept = one(spark, ["007"], "string", lambda c: casts.typed_cell(c, keep_leading_zeros=True))
    assert (kept[0]["kind"], kept[0]["text"]) == ("str", "007")


def test_blank_test_trims_only_what_may_be_blank(spark):
    blank = ["", " ", None, *X.WHITE_SPACE, X.WHITE_SPACE, "\u3000 \t"]
    filled = ["!", "~", "a", "\x7f", "\x00", "\u200b", "é", " a ", "a\u3000", "\u3000a", "名", "\U0001f600", "0"]
    assert one(spark, blank + filled, "string", X.is_blank) == [True] * len(blank) + [False] * len(filled)
    assert one(spark, blank + filled, "string", X.blank_to_null) == [None] * len(blank) + filled
    for test in (X.is_blank, X.blank_to_null):
        plan = spark.range(1).select(test(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
        assert 0 <= plan.find(">= !") < plan.find("btrim")


def test_dates_times_and_numbers_are_computed_once(spark):
    dates = ["1/2/98", " 01/02/1998 x", "1/2/123", "1998-1-2T", "98-1-2", "1/2/12345", "x", "", None]
    assert one(spark, dates, "string", casts.iso_date) == [
        "2098-01-02", "1998-01-02", "20123-01-02", "1998-01-02", "98-1-2", "1234-01-02", "x", "", None]
    times = ["1:05", "x11:05:0", "01:05:099", "1:5", "", None]
    assert one(spark, times, "string", casts.time_of_day) == ["01:05:00", "11:05:00", "01:05:09", "00:00:00", "00:00:00", "00:00:00"]
    for made in (casts.iso_date, casts.time_of_day, casts.to_number, lambda c: casts.coerce(c, "decimal")):
        plan = spark.range(1).select(made(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        # one pattern for each text, on a text that is cut to shape once
        assert plan.count("regexp_extract(") + plan.lower().count("rlike") == 1 and plan.count("translate(") <= 1, plan


def test_numbers(spark):
    got = one(spark, ["$1,234.50", "(12)", "5%", "1d", "nan", "inf", "1e5", "", None, " 7 "], "string", casts.to_number)
    assert got == [1234.5, None, 5.0, None, None, None, 1e5, None, None, 7.0]
    assert one(spark, ["1,234.9", "-2.7", "x", "1e30"], "string", lambda c: casts.coerce(c, "integer")) == [1234, -2, None, None]


def test_double_text_matches_python(spark):
    rnd = random.Random(3)
    values = [58.0, 58.25, 1e7, 12345678.5, 1e-4, 1e16, 1.5e22, 1e-5, -1e7, 0.0] + [float(f"{rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 14):.12g}") for _ in range(500)]
    got = one(spark, values, "double", lambda c: X.text_of(c, T.DoubleType()))
    assert got == [str(v) for v in values]


def test_dates_and_times(spark):
    dates = one(spark, ["1/2/24", "1/2/123", "2024-1-5", "2024-01-05T10:00", " abc ", "13/45/2024", None], "string", casts.iso_date)
    assert dates == ["2024-01-02", "20123-01-02", "2024-01-05", "2024-01-05", "abc", "2024-13-45", None]
    times = one(spark, ["12:30", "1:30 PM", "at 9:05:07", "none", "", None], "string", casts.time_of_day)
    assert times == ["12:30:00", "01:30:00", "09:05:07", "00:00:00", "00:00:00", "00:00:00"]
    assert one(spark, ["1:30 PM", "12:10 am"], "string", lambda c: casts.time_of_day(c, ampm=True)) == ["13:30:00", "00:10:00"]
    assert one(spark, [0.0, 0.5, 0.999999, 45000.25], "double", lambda c: casts.time_of_day(c, T.DoubleType())) == [
        "00:00:00", "12:00:00", "24:00:00", "06:00:00"
    ]
    assert one(spark, ["", None, "2024-1-5"], "string", lambda c: casts.date_and_time(c, F.lit("1:00"))) == [None, None, "2024-01-05T01:00:00"]


def test_names(spark):
    assert one(spark, ["Qty Ordered", "2nd Col", "  ", None, "Supplier's SKU"], "string", X.snake) == [
        "qty_ordered", "col_2nd_col", "column", "column", "supplier_s_sku"
    ]
    assert one(spark, ["Bar & Grill #2", "  X  "], "string", X.norm_name) == ["bar grill 2", "x"]
    assert one(spark, ["", " \t", "　", "a", None], "string", X.is_blank) == [True, True, True, False, True]


def lcs_model(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def ratio_model(a, b):
    return 200.0 * lcs_model(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_model(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0

    def best(s, t):
        return max(ratio_model(s, t[max(0, i): i + len(s)]) for i in range(1 - len(s), len(t)))

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def token_set_model(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    i, p, q = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if i and (not p or not q):
        return 100.0
    if not i:
        return ratio_model(p, q)
    return max(ratio_model(i, f"{i} {p}"), ratio_model(i, f"{i} {q}"), ratio_model(f"{i} {p}", f"{i} {q}"))


def test_ratios_match_models(spark):
    rnd = random.Random(1)

    def word(n):
        return "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, n))).strip()

    rows = [(" ".join(word(20).split()), " ".join(word(20).split())) for _ in range(150)] + [(" ".join(word(90).split()), " ".join(word(90).split())) for _ in range(20)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    parts = S.token_set_parts(F.array_distinct(S.sorted_tokens(a)), F.array_distinct(S.sorted_tokens(b)))
    out = df.withColumns(parts).select(
        "a", "b", S.ratio(a, b).alias("r"), S.partial_ratio(a, b).alias("p"), S.token_set_ratio(F.col("shared"), F.col("only_a"), F.col("only_b")).alias("t")
    ).collect()
    for r in out:
        assert abs(r.r - ratio_model(r.a, r.b)) < 1e-9
        assert abs(r.p - partial_model(r.a, r.b)) < 1e-9
        assert abs(r.t - token_set_model(r.a, r.b)) < 1e-9, (r, token_set_model(r.a, r.b))


def test_cells_of_odd_texts(spark):
    texts = ["", "0", "-0", "-", ".", "-.", "00", "-007", "007", "12", "-12", "1.50", ".5", "-.5", "5.", "1-2", "--1", "1.2.3", "1/2", "+1", "a1", "$1", " 1", "1 ", "9" * 30, "1e5", "é", "-x", "0x"]
    want = {"0": ("int", "0"), "-0": ("int", "0"), "00": ("int", "0"), "-007": ("int", "-7"), "007": ("int", "7"), "12": ("int", "12"), "-12": ("int", "-12"), "1.50": ("float", "1.5"),
            ".5": ("float", "0.5"), "-.5": ("float", "-0.5"), "5.": ("float", "5.0"), "9" * 30: ("int", "9" * 30)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for keep in (False, True):
        got = {r.t: r.c and tuple(r.c) for r in df.select("t", casts.typed_cell(F.col("t"), keep).alias("c")).collect()}
        kept = {t: ("str", t) for t in ("00", "-007", "007")} if keep else {}
        assert got == {t: None if t == "" else {**want, **kept}.get(t, ("str", t)) for t in texts}
    # a text that is no number by its first letter meets no pattern, and none is tried more than once
    plan = df.select(casts.typed_cell(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 3


def test_usual_doubles_are_written_as_they_are(spark):
    xs = [0.0, -0.0, 1e-3, 9.99e-4, 9999999.0, 9999999.5, 1e7, 1e16, 1.5e-5, -2.25, 1e300, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(X.text_of(F.col("x"), T.DoubleType())).collect()] == [repr(x) for x in xs]
    # the first branch is the plain text
    plan = df.select(X.text_of(F.col("x"), T.DoubleType()).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("THEN cast(x") < plan.index("isnan") if "isnan" in plan else "THEN cast(x" in plan

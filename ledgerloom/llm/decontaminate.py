"""Benchmark decontamination by a prefix-filtered set join (operator 1). DataFrame functions only.

A window of an item is a set of word shingles. A document can only hold the window if it holds all of them, so the
window's rarest shingle (the prefix that containment needs, by count over all documents) is the one that is joined.
The shingle's place in the window and the length of the document bound where the window can start; what is left is
compared word by word. Documents are cut into parts that overlap by a window, so no row grows with its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import keyed, let, lower_ascii, table
from ledgerloom.session import durable

WINDOW = 10
SHINGLE = 5
#: Words of a document part, the overlap not counted.
PART = 2000
#: Up to so many benchmark shingles (16 bytes each) go to every task; more are joined by shuffle.
SMALL = 2_000_000
#: Between words: all ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEYS = ["key", "key2"]


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def hashed(parts: Column, size: int) -> Column:
    """Hash of the shingle of ``size`` words at each place of an array of words (a plain column)."""
    last = F.size(parts) - size
    at_each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(parts, i + k) for k in range(size)]))
    return F.when(last >= 0, at_each).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item (the id as text), window_id, words: each window of each item."""
    split = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    each = let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0))), lambda i: F.slice(w, i + 1, window)))
    return split.select("item", F.explode(each).alias("words")).select("item", F.sha2(F.array_join("words", " "), 256).alias("window_id"), "words").distinct()


def document_parts(docs: DataFrame, window: int) -> DataFrame:
    """key, key2, n_words, part, w: the words of each document in parts, each with the begin of the next one."""
    cut = let(
        words(F.col("text")),
        lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.floor((F.size(w) - 1) / PART), F.lit(0)).cast("int")),
            lambda k: F.struct(F.size(w).alias("n_words"), F.slice(w, k * PART + 1, PART + window - 1).alias("w")),
        ),
    )
    return keyed(docs).select(*KEYS, F.posexplode(cut).alias("part", "p")).select(*KEYS, F.col("p.n_words").alias("n_words"), "part", F.col("p.w").alias("w"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text keys (key, key2), n_words, n_hit, items.

    Items (item_id, text) with fewer words than a window are one window; without words they have none. ``items`` lists
    the ids of those that occur, sorted as text; an item without an id marks words but is not listed. Null texts have no
    words; null and repeated ids keep their rows.
    """
    owners = durable(item_windows(items, window), "windows")
    windows = owners.select("window_id", "words", F.size("words").alias("length")).distinct()
    # a window of fewer words than a shingle is one shingle of its own length
    size = F.least("length", F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(size).distinct().collect())
    base = keyed(docs).select("doc_id", *KEYS, let(words(F.col("text")), F.size).cast("long").alias("n_words"))
    if not sizes:
        return base.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    index = None
    for s in sizes:
        own = windows.filter(size == s).select("window_id", "length", F.lit(s).alias("size"), F.posexplode(hashed(F.col("words"), s)).alias("offset", "shingle"))
        index = own if index is None else index.unionByName(own)
    index = durable(index, "shingles")
    wanted = durable(index.select("size", "shingle").distinct(), "wanted")
    near = F.broadcast if wanted.count() <= SMALL else (lambda df: df)

    parts = document_parts(docs, window)
    each = F.array(*[F.struct(F.lit(s).alias("size"), hashed(F.col("w"), s).alias("shingles")) for s in sizes])
    seen = parts.select(*KEYS, "n_words", "part", F.explode(each).alias("s")).select(
        *KEYS, "n_words", "part", F.col("s.size").alias("size"), F.posexplode("s.shingles").alias("place", "shingle")
    )
    found = durable(
        seen.filter(F.col("place") < PART).join(near(wanted), ["size", "shingle"]).select(*KEYS, "n_words", (F.col("part") * PART + F.col("place")).alias("at"), "size", "shingle"),
        "found",
    )
    rarity = found.groupBy("size", "shingle").agg(F.count("*").alias("n"))
    rarest = index.join(rarity, ["size", "shingle"]).groupBy("window_id", "length", "size").agg(
        F.min(F.struct("n", "offset", "shingle")).alias("rare"), F.count("*").alias("known")
    )
    # a window with a shingle that no document has cannot occur
    prefix = durable(
        rarest.filter(F.col("known") == F.col("length") - F.col("size") + 1).select("window_id", "length", "size", "rare.offset", "rare.shingle")
        .join(windows.select("window_id", "words"), "window_id"),
        "prefix",
    )
    start = F.col("at") - F.col("offset")
    candidates = found.join(prefix, ["size", "shingle"]).filter((start >= 0) & (start + F.col("length") <= F.col("n_words"))).select(
        *KEYS, F.floor(start / PART).cast("int").alias("part"), F.struct((start % PART).alias("place"), "window_id", "words").alias("c")
    ).distinct()
    by_part = candidates.groupBy(*KEYS, "part").agg(F.collect_list("c").alias("cs"))
    # texts are dealt as strings, a third of the size of arrays
    texts = parts.select(*KEYS, "part", F.array_join("w", " ").alias("w"))
    own = let(F.split("w", " "), lambda w: F.filter("cs", lambda c: F.slice(w, c["place"] + 1, F.size(c["words"])) == c["words"]))
    verified = durable(
        texts.join(by_part, [*KEYS, "part"]).select(*KEYS, "part", F.explode(own).alias("c"))
        .select(*KEYS, (F.col("part") * PART + F.col("c.place")).alias("start"), F.size("c.words").alias("length"), F.col("c.window_id").alias("window_id")).distinct(),
        "verified",
    )
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy(*KEYS).orderBy("start", "length", "window_id").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(end - F.greatest(F.coalesce(before, F.lit(0)), F.col("start")), F.lit(0))
    covered = verified.select(*KEYS, fresh.alias("fresh")).groupBy(*KEYS).agg(F.sum("fresh").alias("n_hit"))
    listed = verified.select(*KEYS, "window_id").distinct().join(owners.select("window_id", "item"), "window_id").groupBy(*KEYS).agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = covered.join(listed, KEYS)
    return base.join(told, KEYS, "left").select(
        "doc_id", *KEYS, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH split AS (SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark),
b AS (SELECT id AS item, least(len(w),10) AS n, unnest(range(1, greatest(len(w)-9,1)+1)) AS p, w FROM split WHERE kind='b' AND len(w)>0),
win AS (SELECT DISTINCT item, n, array_to_string(w[p:p+n-1],' ') AS win FROM b),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT id, w, n, unnest(range(1, len(w)-n+2)) AS p FROM split, sizes WHERE kind='d' AND len(w)>=n),
hit AS (SELECT d.id, d.p, win.n, win.item FROM (SELECT id, n, p, array_to_string(w[p:p+n-1],' ') AS win FROM d) d JOIN win ON d.win=win.win AND d.n=win.n),
pos AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p+n)) AS q FROM hit) GROUP BY 1),
its AS (SELECT id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT id, item::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT s.id AS doc_id, len(w) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM split s LEFT JOIN pos ON s.id=pos.id LEFT JOIN its ON s.id=its.id WHERE kind='d'
"""

"""Fold names that differ only in spelling, word order or extra words into the earliest one.

Two names match when their token set ratio is at least 90. Nobody compares all pairs: a name is
looked up by a few rare tokens and rare letter pairs, chosen so that no matching pair is missed.
With a = |sorted distinct tokens joined by blanks|:

* Shared words decide (all words of one name inside the other, or the extra words X of a name satisfy
  |X| + 1 <= a / 5.5). Rarest tokens whose lengths + 1 add up to more than a / 5.5 cannot all be extra,
  so at least one of them is in the other name.
* Spelling decides. Then at most D letters are inserted or deleted, D being (a + b) / 10 rounded down to
  the parity of a + b, hence b is between 9/11 a and 11/9 a. One insertion removes at most one letter
  pair of a text and one deletion at most two, so both texts share at least 1 + (a + b) / 2 - 1.5 D of
  their a + 1 and b + 1 letter pairs, counted with repetition. Among the rarest
  (a + 1) - shared + 2 pairs of either text two are therefore common: texts are looked up by lengths
  and such couples of letter pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.similarity import lcs, sorted_tokens, token_set_parts
from ledgerloom.operators.numbering import numbered
from ledgerloom.session import durable

# Tasks get these helpers with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Couples grow with the square of the length, so names that are long together use single letter pairs.
COUPLE_MAX = 128
ROWS_PER_SALT = 20_000
# Pairs stored for each text, texts whose pairs are stored whatever their number, and pairs that one task may walk as numbers.
PAIRS = 100
FEW = 2048
WALKED = 4_000_000


def _signatures(names: DataFrame) -> DataFrame:
    """One row per set of tokens: its text, length, and the earliest bucket that has it."""
    tokens = F.array_distinct(sorted_tokens(F.col("name")))
    sig = F.array_join(tokens, " ")
    return (
        names.withColumn("sig", sig)
        .filter(F.col("sig") != "")
        .groupBy("sig")
        .agg(F.min(F.struct("first_pos", "key")).alias("first"))
        .select("sig", F.length("sig").alias("a"), F.col("first.first_pos").alias("pos"))
    )


def _salted(probe: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Join on ``key``; both sides carry ``weight``, the index rows of the key, and a heavy key is cut into salts, so that no task gets all of it."""
    salts = F.ceil(F.col("weight") / F.lit(ROWS_PER_SALT)).cast("int")
    left = probe.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("weight")
    right = index.withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).drop("weight")
    return left.join(right, [key, "salt"]).drop("salt", key)


@dataclass
class Lookups:
    """Keys under which texts find each other. ``old`` tells texts apart when only pairs of an old and a new one are asked for.

    words: token, a, old, weight, looked up in word_index: token, b, old, weight. same: key, sig, old, weight of texts of one length,
    for keys that two texts have. spelled: key, a, old, weight, looked up in spelling_index: key, b, old, weight.
    """

    words: DataFrame
    word_index: DataFrame
    same: DataFrame
    spelled: DataFrame
    spelling_index: DataFrame

    def most_pairs(self) -> int:
        """No fewer than the pairs that the keys lead to."""
        total = F.coalesce(F.sum("weight"), F.lit(0))
        looked_up = sum(df.agg(total).first()[0] for df in (self.words, self.spelled))
        return looked_up + self.same.agg(F.coalesce(F.sum(F.col("weight") - 1), F.lit(0))).first()[0] // 2


def lookups(sigs: DataFrame, cross: bool = False) -> Lookups:
    """With ``cross``, keys that no old text or no new text has are left out where that is cheap."""
    if "old" not in sigs.columns:
        sigs = sigs.withColumn("old", F.lit(False))
    words = sigs.select(F.col("sig").alias("a"), F.col("a").alias("n"), "old", F.explode(F.split("sig", " ")).alias("token"))
    tokens = durable(words.groupBy("token").agg(F.count(F.lit(1)).alias("weight")), "token-weights")
    rare_first = Window.partitionBy("a").orderBy("weight", "token")
    before = F.coalesce(F.sum(F.length("token") + 1).over(rare_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighted = words.join(tokens, "token")
    probe = weighted.withColumn("before", before).filter(F.col("before") * 11 <= F.col("n") * 2).select("token", "a", "old", "weight")
    # A word or key held by one text only leads nowhere.
    probe = durable(probe.filter(F.col("weight") > 1), "probes")
    index = weighted.join(probe.select("token").distinct(), "token", "left_semi").select("token", F.col("a").alias("b"), "old", "weight")
    lengths = _length_pairs(sigs)
    return Lookups(probe, index, _same_length_keys(sigs, lengths, cross), *_spelling_keys(sigs, lengths))


def _sides(left: DataFrame, right: DataFrame, cross: bool) -> list[tuple[DataFrame, DataFrame]]:
    """What is to meet: everything, or old with new."""
    if not cross:
        return [(left.drop("old"), right.drop("old"))]
    return [(left.filter(F.col("old") == o).drop("old"), right.filter(F.col("old") != o).drop("old")) for o in (False, True)]


def shared_word_candidates(look: Lookups, cross: bool) -> DataFrame:
    """Pairs ``(a, b)`` of texts that can match because of the words they share."""
    found = [_salted(p, i, "token") for p, i in _sides(look.words, look.word_index, cross)]
    return reduce(DataFrame.unionByName, found).filter(F.col("a") != F.col("b"))


def _most_edits(total: Column) -> Column:
    """Letters inserted or deleted between matching texts of ``total`` letters, at most."""
    return F.floor(total / 10) - F.pmod(total + F.floor(total / 10), F.lit(2))


def _length_pairs(sigs: DataFrame) -> DataFrame:
    """``n, m, edits, indexed, probing``: lengths that occur and can match, and whether texts of length n are looked up or look up.

    The length with fewer texts is the one that is looked up; equal lengths do both. One row per pair of lengths.
    """
    sizes = durable(sigs.groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("size")), "lengths")
    other = sizes.select(F.col("n").alias("m"), F.col("size").alias("others"))
    edits = _most_edits(F.col("n") + F.col("m"))
    mine, theirs = F.struct("size", "n"), F.struct("others", "m")
    pairs = sizes.crossJoin(other).withColumn("edits", edits).filter((F.col("edits") > 0) & (F.abs(F.col("n") - F.col("m")) <= F.col("edits")))
    return durable(pairs.select("n", "m", "edits", (mine <= theirs).alias("indexed"), (mine >= theirs).alias("probing")), "length-pairs")


def _one_letter_less(text: Column) -> Column:
    """The sorted tokens of ``text`` after any one letter, or the blank between any two tokens, is left out."""
    tokens = F.split(text, " ")

    def without(i: Column, *gone: Column) -> Column:
        return F.filter(tokens, lambda _, k: reduce(lambda x, y: x & y, [k != g for g in (i, *gone)]))

    def joined(rest: Column, token: Column) -> Column:
        return F.array_join(F.array_sort(F.concat(rest, F.array(token))), " ")

    def letters(t: Column, i: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda p: joined(without(i), F.concat(t.substr(F.lit(1), p - 1), t.substr(p + 1, F.length(t)))))

    def blanks(t: Column, i: Column) -> Column:
        return F.filter(
            F.transform(tokens, lambda u, j: F.when(i < j, joined(without(i, j), F.concat(t, u)))), lambda x: x.isNotNull()
        )

    return F.array_distinct(F.flatten(F.concat(F.transform(tokens, letters), F.transform(tokens, blanks))))


def _same_length_keys(sigs: DataFrame, lengths: DataFrame, cross: bool) -> DataFrame:
    """``key, sig, old, weight``: texts of one length that differ by a letter left out of each, under what is left.

    Few texts have a key in common: there are only so many letters to put back.
    """
    close = lengths.filter((F.col("n") == F.col("m")) & (F.col("edits") == 2)).select(F.col("n").alias("a"))
    keyed = sigs.join(close, "a").select("sig", "old", F.explode(_one_letter_less(F.col("sig"))).alias("left_over"), F.concat_ws(",", F.col("a").cast("string"), "left_over").alias("key"))
    held = Window.partitionBy("key")
    weighted = keyed.select("key", "sig", "old", F.count(F.lit(1)).over(held).alias("weight"), F.count_if("old").over(held).alias("olds"))
    useful = (F.col("olds") > 0) & (F.col("olds") < F.col("weight")) if cross else F.col("weight") > 1
    return durable(weighted.filter(useful).drop("olds"), "one-letter-keys")


def _numbered_pairs(text: Column) -> Column:
    """Letter pairs of the padded text; equal pairs are numbered so that repetition counts."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: padded.substr(i, F.lit(2))))
    return F.transform(pairs, lambda p, i: F.concat(p, (i - F.array_position(pairs, p) + 1).cast("string")))


def _spelling_keys(sigs: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that texts of lengths n and m share if they are spelled almost alike: those that look up, and those looked up."""
    lengths = lengths.filter((F.col("n") != F.col("m")) | (F.col("edits") > 2))
    if lengths.isEmpty():
        none = sigs.sparkSession.createDataFrame([], "key string, sig string, old boolean, weight long")
        return none.withColumnRenamed("sig", "a"), none.withColumnRenamed("sig", "b")
    used = sigs.join(lengths.select(F.col("n").alias("a")).distinct(), "a")
    grams = used.select("sig", F.col("a").alias("n"), "old", F.explode(_numbered_pairs(F.col("sig"))).alias("gram"))
    weights = durable(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("weight")), "gram-weights")
    # Letter pairs of each text, rarest first; the list is as long as the text.
    ordered = durable(
        grams.join(weights, "gram").groupBy("sig", "n", "old")
        .agg(F.array_sort(F.collect_list(F.struct("weight", "gram"))).alias("g"))
        .withColumn("g", F.transform("g", lambda x: x["gram"])), "gram-lists"
    )
    n, m = F.col("n"), F.col("m")
    total = n + m
    least_shared = F.floor((2 + total - 3 * F.col("edits") + 1) / 2)
    reach = (n + 1 - least_shared + 1).cast("int")
    listed = ordered.join(lengths, "n").withColumns({"reach": reach, "couple": total <= COUPLE_MAX})
    rare = F.slice("g", F.lit(1), F.col("reach") + F.when(F.col("couple"), 1).otherwise(0))

    def both(x: Column, y: Column) -> Column:
        return F.concat(F.least(x, y), F.greatest(x, y))

    listed = listed.withColumn("r", rare)
    couples = F.flatten(F.transform("r", lambda x, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda y: both(x, y))))
    length_pair = F.concat_ws(",", F.least(n, m).cast("string"), F.greatest(n, m).cast("string"), F.lit(""))
    keys = F.transform(F.when(F.col("couple"), couples).otherwise(F.col("r")), lambda k: F.concat(length_pair, k))

    def keyed(role: str, name: str) -> DataFrame:
        return listed.filter(role).select(F.explode(keys).alias("key"), F.col("sig").alias(name), "old", (n == m).alias("equal"))

    index = durable(keyed("indexed", "b"), "spelling-index")
    held = durable(index.groupBy("key", "equal").agg(F.count(F.lit(1)).alias("weight")).filter(~F.col("equal") | (F.col("weight") > 1)).drop("equal"), "spelling-weights")
    probe = durable(keyed("probing", "a").drop("equal").join(held, "key"), "spelling-probes")
    return probe, index.drop("equal").join(held, "key")


def spelling_candidates(look: Lookups, cross: bool) -> DataFrame:
    """Pairs ``(a, b)`` of texts that can match because they are spelled almost alike."""
    left, right = (look.same.select("key", F.col("sig").alias(c), "old", "weight") for c in ("a", "b"))
    # the side with itself: one order of each pair of old and new will do
    sides = _sides(left, right, cross)[:1]
    found = [_salted(x, y, "key") for x, y in [*sides, *_sides(look.spelled, look.spelling_index, cross)]]
    return reduce(DataFrame.unionByName, found).filter(F.col("a") != F.col("b"))


def matching_pairs(sigs: DataFrame, look: Lookups | None = None, cross: bool = False) -> DataFrame:
    """All pairs ``(a, b)``, a < b, whose token set ratio is at least 90; with ``cross`` those of an old and a new text."""
    look = look or lookups(sigs, cross)
    found = shared_word_candidates(look, cross).unionByName(spelling_candidates(look, cross))
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    parts = token_set_parts(F.split("a", " "), F.split("b", " "))
    known = pairs.withColumns(parts)
    i, x, y = F.length("shared"), F.length("only_a"), F.length("only_b")
    gap = F.when(i > 0, 1).otherwise(0)
    total = 2 * (i + gap) + x + y
    contained = (i > 0) & ((x == 0) | (y == 0))
    dominated = (i > 0) & ((10 * (1 + x) <= 2 * i + 1 + x) | (10 * (1 + y) <= 2 * i + 1 + y))
    budget = _most_edits(total)
    sure = durable(
        known.withColumns({"sure": contained | dominated, "budget": budget})
        # Levenshtein distance never exceeds the insert/delete distance and stops early at the budget.
        .filter(F.col("sure") | ((F.abs(x - y) <= F.col("budget")) & (F.call_function("levenshtein", F.col("only_a"), F.col("only_b")) <= F.col("budget")))),
        "name-pairs",
    )
    open_ = sure.filter(~F.col("sure")).withColumn("common", lcs(F.col("only_a"), F.col("only_b")))
    close = open_.filter(x + y - 2 * F.col("common") <= F.col("budget"))
    return sure.filter("sure").select("a", "b").unionByName(close.select("a", "b"))


def _walked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the texts that an earlier root takes, from all pairs ``(lo, hi)`` of places of a few texts."""
    pairs = pd.concat(list(parts), ignore_index=True)
    if not len(pairs):
        return
    pairs = pairs.sort_values("lo")
    hi = pairs["hi"].to_numpy()
    firsts, starts = np.unique(pairs["lo"].to_numpy(), return_index=True)
    gone = np.zeros(int(max(hi.max(), firsts[-1])) + 1, dtype=bool)
    for lo, start, end in zip(firsts, starts, [*starts[1:], len(hi)]):
        if not gone[lo]:
            gone[hi[start:end]] = True
    yield pd.DataFrame({"place": np.flatnonzero(gone)})


def _absorbed(edges: DataFrame, sigs: DataFrame) -> DataFrame:
    """Texts that an earlier root takes, given edges ``(lo, hi)`` from earlier to later texts, at most ``WALKED``.

    Whether a text is a root hangs on all texts before it, in chains about as long as the names are alike, so rounds of
    jobs would be many. One task walks the pairs as numbers instead; their number is bounded.
    """
    placed = durable(numbered(sigs.select("sig", "pos"), [F.asc("pos"), F.desc("sig")], "place").select("sig", "place"), "fold-places")
    lo, hi = (placed.select(F.col("sig").alias(c), F.col("place").alias(f"p_{c}")) for c in ("lo", "hi"))
    pairs = edges.join(lo, "lo").join(hi, "hi").select(F.col("p_lo").alias("lo"), F.col("p_hi").alias("hi"))
    return durable(pairs.repartition(1).mapInPandas(_walked, "place long").join(placed, "place").select("sig"), "fold-gone")


def _edges(pairs: DataFrame, place: DataFrame) -> DataFrame:
    """Pairs from the earlier to the later text: lo, hi, lo_pos."""
    first, second = (place.select(F.col("sig").alias(c), F.col("pos").alias(f"p{c}")) for c in ("a", "b"))
    early = F.col("pa") < F.col("pb")
    return pairs.join(first, "a").join(second, "b").select(
        F.when(early, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(early, F.col("b")).otherwise(F.col("a")).alias("hi"), F.least("pa", "pb").alias("lo_pos")
    )


def _earliest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("hi").agg(F.min_by("lo", "lo_pos").alias("root_sig")).select(F.col("hi").alias("sig"), "root_sig")


def settle(sigs: DataFrame, n: int, part: bool = False) -> tuple[DataFrame, DataFrame]:
    """Roots (sig, a, pos) and the absorbed texts with the root that takes each (sig, root_sig), in order of ``pos``.

    Few texts are settled whole. Of more, the first eighth is settled alone, the others look up its roots only, and what no
    root takes is settled after. Those two parts are settled whole if their pairs are few. So pairs are stored for few texts
    at a time, however much these resemble each other.
    """
    look = lookups(sigs) if part or n <= FEW else None
    if n <= FEW or (look and look.most_pairs() <= min(PAIRS * n, WALKED)):
        edges = durable(_edges(matching_pairs(sigs, look), sigs), "fold-edges")
        gone = _absorbed(edges, sigs)
        roots = durable(sigs.join(gone, "sig", "left_anti"), "fold-roots")
        to_roots = edges.join(gone.select(F.col("sig").alias("lo")), "lo", "left_anti").join(gone.select(F.col("sig").alias("hi")), "hi")
        return roots, _earliest(to_roots)
    cut = sigs.agg(F.percentile_approx("pos", 1 / 8)).first()[0]
    head, tail = sigs.filter(F.col("pos") <= cut), sigs.filter(F.col("pos") > cut)
    head = durable(head, "fold-head")
    roots, taken = settle(head, head.count(), part=True)
    both = durable(roots.withColumn("old", F.lit(True)).unionByName(tail.withColumn("old", F.lit(False))), "fold-both")
    hits = durable(_earliest(_edges(matching_pairs(both, cross=True), both)), "fold-hits")
    rest = durable(tail.join(hits.select("sig"), "sig", "left_anti"), "fold-rest")
    left = rest.count()
    if not left:
        return roots, taken.unionByName(hits)
    more, also = settle(rest, left, part=True)
    return roots.unionByName(more), taken.unionByName(hits).unionByName(also)


def fold_names(names: DataFrame) -> DataFrame:
    """Who is absorbed by whom: ``key, root, first_pos`` for absorbed buckets only.

    ``names(key, name, first_pos)`` has one row per bucket; ``name`` is normalised. Buckets are
    walked in order of ``first_pos``: each is a root unless an earlier root matches it, and an
    absorbed bucket joins its earliest matching root.
    """
    names = durable(names.select("key", "name", "first_pos"), "fold-names")
    sigs = durable(_signatures(names), "fold-signatures")
    _, taken = settle(sigs, sigs.count())
    keyed = names.withColumn("sig", F.array_join(F.array_distinct(sorted_tokens(F.col("name"))), " ")).filter(F.col("sig") != "")
    # Buckets with the same words as an earlier one match it fully and share its fate.
    heads = durable(keyed.groupBy("sig").agg(F.min_by("key", "first_pos").alias("root")), "fold-heads")
    target = heads.select(F.col("sig").alias("root_sig"), "root")
    joined = heads.select("sig").join(durable(taken, "fold-taken"), "sig", "left").withColumn("root_sig", F.coalesce("root_sig", "sig")).join(target, "root_sig").select("sig", "root")
    return keyed.join(joined, "sig").filter(F.col("key") != F.col("root")).select("key", "root", "first_pos")

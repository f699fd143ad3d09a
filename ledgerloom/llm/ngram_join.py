"""Jaccard join of documents on word n-grams as a blocked sparse matrix product (operator 10).

The matrix has a row per distinct n-gram set and a column per n-gram. Its product with itself counts the overlap of
every pair, so work goes to what can count towards a link:

1. Rows. Of the ``p`` smallest hashes of a set, two linked sets share a number that follows from their sizes. Tasks
   cut these entries into column blocks, one binary value per task and block, and a block counts which are shared.
   Rows with too few shared entries cannot be linked and leave. Most documents leave here.
2. Columns. N-grams that only one of the remaining sets has add nothing to a product and are dropped; the others are
   ordered by rarity, and each set keeps the few rarest that a linked set must have one of.
3. Products. Sets that share such a column, directly or by others, are a cluster; no link leaves it. A cluster is cut
   into blocks of rows, and a task takes the product of two blocks at a time: rare columns pair by pair, others as dense
   tiles. It keeps the counts to itself, drops those under the bound of the two sizes, and gives out only what
   connects the rows, never pairs. So a large group of near copies moves each set once for each block of its cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import keyed, table
from ledgerloom.llm.graph import components
from ledgerloom.session import durable

N = 4
PERCENT = 85
#: Sets for which one block of columns is made, at least 256 blocks, and entries a task gathers at most.
PER_BLOCK = 20_000
GATHERED = 3_000_000
#: Rows of a block of a large cluster; two blocks are a cell, the work of one task at a time.
ROWS_PER_BLOCK = 512
#: Columns with so many rows are multiplied as dense tiles of so many columns, others pair by pair.
DENSE, TILE = 32, 2048


class Shingles:
    """64-bit hashes of the distinct word n-grams of a text; a text with fewer words is one n-gram."""

    def __init__(self, n: int, limit: int = 1_000_000):
        self.n, self.limit = n, limit
        self.seen: dict[bytes, int] = {}
        mixed = [int.from_bytes(hashlib.blake2b(b"%d" % k, digest_size=8).digest(), "little") | 1 for k in range(n + 1)]
        self.factors = np.array(mixed, np.uint64)

    def word(self, w: bytes) -> int:
        import xxhash

        h = self.seen[w] = xxhash.xxh64_intdigest(w)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # bytes: A-Z only, and white space \\x09-\\x0d and \\x20
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.seen) > self.limit:
            self.seen.clear()
        seen, new = self.seen, self.word
        x = np.array([seen[w] if w in seen else new(w) for w in words], np.uint64)
        m = min(self.n, len(x))
        out = np.full(len(x) - m + 1, (self.n - m) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for k in range(m):
            out += x[k : len(x) - m + 1 + k] * self.factors[k]
        out ^= out >> np.uint64(32)
        out *= self.factors[-1]
        out ^= out >> np.uint64(29)
        return np.unique(out)


def least_shared(n, percent: int = PERCENT):
    """Entries of a set of ``n`` that a linked set has at least."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Entries a set of ``n`` puts out, its smallest hashes, and how many of them it shares with a linked set at least.

    Of the entries put out, a set has at most ``n`` less the overlap that the linked set lacks. As the smaller of the two
    puts out fewer, the entries are two more than twice what a linked set may lack; with one more, 7 and 6 would not do.
    """
    lacks = n - int(least_shared(n, percent))
    return min(n, 2 * lacks + 2), min(lacks + 1, n - lacks)


def shared_rows(docs: DataFrame, n: int, percent: int, blocks: int) -> DataFrame:
    """Both kinds of rows of the first pass over the texts: a row per document (block null) and the blocks' entries."""

    def run(batches):
        from pyspark import TaskContext

        base, flushed = TaskContext.get().partitionId() << 24, 0
        shingles = Shingles(n)
        rows: list[tuple] = []
        known: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        held = 0

        def flush():
            src = base + flushed
            owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(h)))
            # what two sets of this task share needs no other task; one entry tells the others
            local = np.bincount(owner[np.repeat(size > 1, size)], minlength=len(parts)) if len(h) else np.zeros(len(parts), np.int64)
            own = np.where(size > 1, -1, owner[first]).astype(np.int32)
            h = h[first]
            yield doc_rows(rows, src, local)
            marks = np.fromiter((int.from_bytes(d[:8], "little", signed=True) for d in known), np.int64, len(known))
            where = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            cuts = np.searchsorted(where, np.arange(blocks + 1))
            ids, data = [], []
            for b in range(blocks):
                lo, hi = cuts[b], cuts[b + 1]
                if hi > lo:
                    used = own[lo:hi]
                    used = np.unique(used[used >= 0])
                    ids.append(b)
                    data.append(np.array([hi - lo, len(used)], np.int64).tobytes() + h[lo:hi].tobytes() + own[lo:hi].tobytes() + used.tobytes() + marks[used].tobytes())
            yield entry_rows(ids, src, data)

        for ids, texts in keyed_slices(batches):
            for id_, key, text in zip(*ids, texts):
                h = shingles(text)
                digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                if digest not in known:
                    known[digest] = len(known)
                    parts.append(h[: prefix(len(h), percent)[0]])
                    held += len(parts[-1])
                rows.append((id_, key, len(h), digest, known[digest]))
            if held > GATHERED:
                yield from flush()
                flushed, held, rows, known, parts = flushed + 1, 0, [], {}, []
        if rows:
            yield from flush()

    return keyed(docs).select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key long, n long, c1 long, c2 long, src long, place int, local long, block int, data binary"
    )


def keyed_slices(batches, rows: int = 512):
    for b in batches:
        for start in range(0, b.num_rows, rows):
            part = b.slice(start, rows)
            yield (part.column(0).to_pylist(), part.column(1).to_pylist()), part.column(2).to_pylist()


ROWS = ["doc_id", "key", "n", "c1", "c2", "src", "place", "local", "block", "data"]


def doc_rows(rows: list[tuple], src: int, local: np.ndarray) -> pa.RecordBatch:
    id_, key, n, digest, place = zip(*rows)
    half = lambda k: pa.array([int.from_bytes(d[k : k + 8], "little", signed=True) for d in digest], pa.int64())
    long = lambda x: pa.array(x, pa.int64())
    cols = [long(id_), long(key), long(n), half(0), half(8), long([src] * len(rows)), pa.array(place, pa.int32()), long(local[list(place)]), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=ROWS)


def entry_rows(ids: list[int], src: int, data: list[bytes]) -> pa.RecordBatch:
    none = [pa.nulls(len(ids), pa.int64())] * 5
    cols = [*none, pa.array([src] * len(ids), pa.int64()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.int64()), pa.array(ids, pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=ROWS)


def count_blocks(entries: DataFrame) -> DataFrame:
    """entries (block, src, data) to (src, place, shared): how many entries of a task's set others have too."""

    def count(src: list[int], data: list[bytes]) -> pa.RecordBatch:
        hs, owners, marks, who = [], [], [], []
        for k, d in enumerate(data):
            n, m = np.frombuffer(d, np.int64, 2)
            h = np.frombuffer(d, np.uint64, n, 16)
            own = np.frombuffer(d, np.int32, n, 16 + 8 * n)
            used = np.frombuffer(d, np.int32, m, 16 + 12 * n)
            mark = np.frombuffer(d, np.int64, m, 16 + 12 * n + 4 * m)
            single = own >= 0
            of = np.zeros(n, np.int64)
            of[single] = mark[np.searchsorted(used, own[single])]
            hs.append(h)
            owners.append(own)
            marks.append(of)
            who.append(np.full(n, k, np.int32))
        h, own, mark, who = map(np.concatenate, (hs, owners, marks, who))
        order = np.lexsort((mark, h))
        h, own, mark, who = h[order], own[order], mark[order], who[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        run = np.cumsum(new) - 1
        other = np.concatenate(([False], (mark[1:] != mark[:-1]) & ~new[1:])) | (own < 0)
        shared = (np.bincount(run, other) > 0)[run] & (own >= 0)
        pair, n = np.unique(who[shared].astype(np.int64) << 32 | own[shared], return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(src, np.int64)[pair >> 32]), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], names=["src", "place", "shared"]
        )

    def run(batches):
        block, src, data = None, [], []
        for b in batches:
            for k, s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if k != block and data:
                    yield count(src, data)
                    src, data = [], []
                block = k
                src.append(s)
                data.append(d.as_py())
        if data:
            yield count(src, data)

    return entries.repartition("block").sortWithinPartitions("block", "src").mapInArrow(run, "src long, place int, shared long")


def set_hashes(texts: DataFrame, n: int) -> DataFrame:
    """texts (id, n, text) to (id, n, hashes)."""

    def run(batches):
        shingles = Shingles(n)
        for (ids, sizes), values in keyed_slices(batches):
            sets = [shingles(t).view(np.int64) for t in values]
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["id", "n", "hashes"])

    return texts.mapInArrow(run, "id long, n long, hashes array<long>")


def numbered(sets: DataFrame) -> DataFrame:
    """A whole number ``id`` for each (c1, c2): a hash, with the first seed that keeps them all apart."""
    for seed in range(64):
        out = sets.withColumn("id", F.xxhash64(F.lit(seed), "c1", "c2"))
        if out.groupBy("id").count().filter("count > 1").isEmpty():
            return out
    raise ValueError("no seed keeps the sets apart")


def overlaps(owner: np.ndarray, column: np.ndarray, b: int) -> np.ndarray:
    """Upper triangle of the product of a sparse 0-1 matrix of ``b`` rows with its transpose, from its entries by row."""
    out = np.zeros((b, b), np.int32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    first = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1]))) if len(column) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(column)))
    for d in np.unique(size[(size > 1) & (size < DENSE)]).tolist():
        rows = owner[first[size == d][:, None] + np.arange(d)]
        x, y = np.triu_indices(d, 1)
        step = max(1, 4_000_000 // len(x))
        for k in range(0, len(rows), step):
            np.add.at(out, (rows[k : k + step][:, x].ravel(), rows[k : k + step][:, y].ravel()), 1)
    full = np.flatnonzero(size >= DENSE)
    for k in range(0, len(full), TILE):
        own = full[k : k + TILE]
        tile = np.zeros((b, len(own)), np.float32)
        tile[owner[np.concatenate([np.arange(first[c], first[c] + size[c]) for c in own])], np.repeat(np.arange(len(own)), size[own])] = 1
        out += (tile @ tile.T).astype(np.int32)
    return np.triu(out, 1)


def connected(n: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """For each row the first row it is connected to by links."""
    linked = (both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
    linked |= linked.T
    label = np.arange(len(n))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(n)).min(1, initial=len(n)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def products(cells: DataFrame, percent: int) -> DataFrame:
    """cells (cluster, p, q, id, n, hashes) to links (a, b) that connect what is linked within each cell."""

    def cell(ids, n, sets):
        if len(ids) < 2:
            return None
        order = np.argsort(ids)
        ids, n, sets = np.array(ids)[order], np.array(n, np.int64)[order], [sets[k] for k in order]
        column = np.unique(np.concatenate(sets), return_inverse=True)[1]
        label = connected(n, overlaps(np.repeat(np.arange(len(ids)), [len(x) for x in sets]), column, len(ids)), percent)
        moved = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"]) if moved.any() else None

    def run(batches):
        key, held = None, ([], [], [])
        for b in batches:
            hashes = b.column(5)
            for k, (*now, id_, n) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
                if now != key:
                    if (out := cell(*held)) is not None:
                        yield out
                    key, held = now, ([], [], [])
                for x, v in zip(held, (id_, n, hashes[k].values.to_numpy())):
                    x.append(v)
        if (out := cell(*held)) is not None:
            yield out

    by = ["cluster", "p", "q"]
    return cells.select(*by, "id", "n", "hashes").repartition(*by).sortWithinPartitions(*by, "id").mapInArrow(run, "a long, b long")


def near_sets(sets: DataFrame, percent: int) -> DataFrame:
    """sets (id, n, hashes) to (node, root) of those that are linked."""
    each = sets.select("id", "n", F.explode("hashes").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    least = F.ceil(F.lit(percent) * F.col("n") / 100).cast("int")
    kept = each.join(common.hint("merge"), "h").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("e")).filter(F.size("e") >= least)
    kept = durable(kept.select("id", "n", F.col("e.h").alias("hashes")), "sets")
    # entries no other set has are the rarest, and use up the front of the prefix
    prefix = durable(kept.select("id", F.explode(F.slice("hashes", F.lit(1), F.size("hashes") - least + 1)).alias("h")), "columns")
    low = prefix.groupBy("h").agg(F.min("id").alias("low"))
    clusters = components(prefix.join(low, "h").select(F.col("id").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())
    clusters = durable(clusters, "clusters")
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / ROWS_PER_BLOCK).cast("int").alias("m"))
    placed = clusters.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    # a large cluster is cut into blocks of rows, and every two blocks meet in one cell
    others = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda k: (k != F.col("own")) | (F.col("m") == 1))
    cells = placed.select("root", "node", "own", F.explode(others).alias("k")).select(
        F.col("root").alias("cluster"), F.least("own", "k").alias("p"), F.greatest("own", "k").alias("q"), F.col("node").alias("id")
    )
    return components(products(cells.join(kept, "id"), percent))


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, key, n_shingles, component_id, stays.

    ``stays`` marks one row of each component: that of its smallest id (repeated rows, with the same keys, alike).

    A null or empty text has no n-grams and is alone; its component is its own id. Null ids are never a component's
    smallest unless all its ids are null. Rows with repeated ids are linked by their texts like all others.
    """
    blocks = max(256, docs.count() // PER_BLOCK)
    first = durable(shared_rows(docs, n, percent, blocks), "first")
    rows = first.filter("block IS NULL")
    remote = count_blocks(first.filter("block IS NOT NULL").select("block", "src", "data")).groupBy("src", "place").agg(F.sum("shared").alias("remote"))
    own = rows.filter("n > 0").groupBy("src", "place", "c1", "c2", "n", "local").agg(F.min("key").alias("key"))
    total = F.col("local") + F.coalesce("remote", F.lit(0))
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    need = F.least(F.col("n") - least + 1, least)
    alive = own.join(remote, ["src", "place"], "left").filter(total >= need).groupBy("c1", "c2", "n").agg(F.min("key").alias("key"))
    alive = durable(numbered(durable(alive, "alive")), "alive")
    # the same join at every size: texts are dealt by key once, and a repeated row is hashed once
    texts = keyed(docs).select("key", "text").join(alive.select("key", "id", "n").hint("merge"), "key").dropDuplicates(["key"]).select("id", "n", "text")
    sets = durable(set_hashes(texts, n), "hashes")
    roots = near_sets(sets, percent)
    first_row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    least = durable(rows.groupBy("c1", "c2").agg(F.min(first_row).alias("least")), "classes")
    of_root = alive.select("c1", "c2", "id").join(roots, alive.id == roots.node).select("c1", "c2", "root").join(least, ["c1", "c2"])
    low = of_root.groupBy("root").agg(F.min("least").alias("component"))
    named = durable(of_root.join(low, "root").select("c1", "c2", "component"), "components")
    whole = durable(least.join(named, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("component", "least").alias("least")), "components")
    some = F.col("n") > 0
    return rows.join(whole, ["c1", "c2"]).select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.when(some, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~some | (F.col("key") == F.col("least.key"))).alias("stays"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p+3],' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-3,1)+1)) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS ov FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * ov >= 85 * (x.n + y.n - ov)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""

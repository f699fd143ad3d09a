"""Merkle manifest of a dataset, with proofs, by time-forward processing (operator 12).

Leaves are numbered within their source by prefix sums, so a node's label (level, place) tells its parent's. Messages go
along the edges in the order of labels: a queue delivers the digests of children to their parent, whose digest is the
next message. Inside a block of 16^3 consecutive leaves the queue is a heap in one task; between blocks it is Spark's
external sort by label, in rounds that each take up three levels. So a hot source is many blocks, and a task holds one
block's messages only. A second sweep takes the nodes in reverse and delivers to each child its siblings and the path
above them, which at a leaf is the proof. The subroots of the sources are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import lower_ascii, remainder, table
from ledgerloom.operators.numbering import numbered
from ledgerloom.session import durable

WIDTH = 16
#: Levels that one round takes up.
HEIGHT = 3
BLOCK = WIDTH**HEIGHT
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Characters of a digest.
HEX = 64


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """H of the values, each with its length in bytes in front; a null is ``-``."""
    one = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat(*one).cast("binary"), 256)


def by_block(batches, columns: list[str]):
    """(group, block), rows of each block in turn; rows come sorted, group and block first."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ["group", "block", *columns])):
            if r[:2] != key:
                if rows:
                    yield key, rows
                key, rows = r[:2], []
            rows.append(r[2:])
    if rows:
        yield key, rows


def sweep_up(n: int, digests: list[str]):
    """Nodes over one block's digests, as (level, place in the block, digests of the children, own digest), by label.

    A tree of ``n`` leaves in all ends with its root; part of a larger one goes up all levels of a round.
    """
    queue = [((0, p), p, d) for p, d in enumerate(digests)]  # ascending labels are a heap
    level, left = 0, len(digests)
    while level < HEIGHT and (n > BLOCK or left > 1):
        # messages of this level by parent; each parent's digest is the message for its own
        run: list[str] = []
        level += 1
        for k in range(left):
            _, place, digest = heapq.heappop(queue)
            run.append(digest)
            if len(run) == WIDTH or k == left - 1:
                children, run = "".join(run), []
                own = sha(children)
                yield level, place // WIDTH, children, own
                heapq.heappush(queue, ((level, place // WIDTH), place // WIDTH, own))
        left = -(-left // WIDTH)


NODES = "group long, block long, n long, level int, place long, children string, digest string, top boolean"


def nodes_over(items: DataFrame) -> DataFrame:
    """Nodes of one round over items (group, place from 0, n items of the group, digest), and one row with ``top`` for
    each block: the digest that stands for it."""

    def run(batches):
        for (group, block), rows in by_block(batches, ["place", "n", "digest"]):
            n = rows[0][1]
            out = [(group, block, n, level, place, children, digest, False) for level, place, children, digest in sweep_up(n, [r[2] for r in rows])]
            top = out[-1][6] if out else rows[0][2]
            out.append((group, block, n, HEIGHT + 1, 0, None, top, True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)

    dealt = items.select("group", F.floor(F.col("place") / BLOCK).alias("block"), "place", "n", "digest")
    return dealt.repartition("group", "block").sortWithinPartitions("group", "block", "place").mapInArrow(run, NODES)


NAMES = [c.split()[0] for c in NODES.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]


@dataclass
class Forest:
    """One tree for each group: the items and nodes of each round, and the roots (group, n, digest)."""

    rounds: list[tuple[DataFrame, DataFrame]]
    roots: DataFrame


def grow(items: DataFrame, most: int) -> Forest:
    """Trees over items (group, place, n, digest); ``most`` is the largest n."""
    rounds, roots, size = [], None, items.select("group", F.col("n").alias("all")).distinct()
    size = durable(size, "sizes")
    while True:
        nodes = durable(nodes_over(items), "nodes")
        rounds.append((items, nodes))
        tops = nodes.filter("top")
        done = tops.filter(F.col("n") <= BLOCK).select("group", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if most <= BLOCK:
            return Forest(rounds, durable(roots.join(size, "group").select("group", F.col("all").alias("n"), "digest"), "roots"))
        most = -(-most // BLOCK)
        items = tops.filter(F.col("n") > BLOCK).select("group", F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).alias("n"), "digest")


def reversed_sweep(rows):
    """Paths to one block's items, in reverse order of labels, from rows (depth, place, children, path, item...).

    The first row brings the path above the block; it goes to the first node, the block's top. Every node finds its path
    in the queue and leaves one for each child: the digests left and right of it, then the path above.
    """
    above, queue = None, []
    for depth, place, children, path, *item in rows:
        if path is not None:
            above = path
            continue
        if above is not None:
            queue, own, above = [], above, None
        else:
            _, own = heapq.heappop(queue)
        if children is None:
            yield place, own, item
            continue
        for k in range(len(children) // HEX):
            siblings = f"{children[: k * HEX]},{children[(k + 1) * HEX :]};"
            heapq.heappush(queue, ((depth + 1, place * WIDTH + k), siblings + own))


def paths(forest: Forest, above: DataFrame, payload: list[str], finish, schema: str) -> DataFrame:
    """The path of every item, ``left,right;`` for each level from the item up, then the path ``above`` its tree.

    above: group, n, path. ``payload`` are further columns of the first round's items; ``finish`` makes Arrow columns of
    their (group, place, path, payload) rows.
    """
    below = None
    for k in reversed(range(len(forest.rounds))):
        items, nodes = forest.rounds[k]
        # trees that end in this round get the path above them here
        ends = (F.col("n") <= BLOCK ** (k + 1)) & ((F.col("n") > BLOCK**k) if k else F.lit(True))
        start = above.filter(ends).select("group", F.lit(0).cast("long").alias("block"), "path")
        if below is not None:
            start = start.unionByName(below.select("group", F.col("place").alias("block"), "path"))
        extra = payload if k == 0 else []
        none = F.lit(None).cast("string")
        kinds = dict(items.select(*extra).dtypes)

        def row(df, depth, place, children, path, own, block):
            # a node's level counts down, so ascending depth is the reverse order of time
            return df.select("group", block.alias("block"), depth.cast("int").alias("depth"), place.cast("long").alias("place"), children.alias("children"), path.alias("path"),
                             *[(F.col(c) if own else F.lit(None).cast(kinds[c])).alias(c) for c in extra])

        inner = nodes.filter("NOT top")
        stream = row(start, F.lit(-1), F.lit(0), none, F.col("path"), False, F.col("block"))
        stream = stream.unionByName(row(inner, HEIGHT - F.col("level"), F.col("place"), F.col("children"), none, False, F.col("block")))
        stream = stream.unionByName(row(items, F.lit(HEIGHT), F.col("place") % BLOCK, none, none, True, F.floor(F.col("place") / BLOCK)))
        last = k == 0

        def run(batches, extra=extra, last=last):
            for (group, block), rows in by_block(batches, ["depth", "place", "children", "path", *extra]):
                found = [(group, block * BLOCK + place, path, *item) for place, path, item in reversed_sweep(rows)]
                if found:
                    yield finish(found) if last else pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["group", "place", "path"])

        dealt = stream.repartition("group", "block").sortWithinPartitions("group", "block", "depth", "place")
        out = dealt.mapInArrow(run, schema if last else "group long, place long, path string")
        below = out if last else durable(out, "paths")
    return below


def fold(digest: str, path: str) -> str:
    """The root that a leaf's digest gives with its proof."""
    for level in path.split(";")[:-1]:
        left, right = level.split(",")
        digest = sha(left + digest + right)
    return digest


def plain(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["group", "place", "path"])


@dataclass
class Manifest:
    """leaves (group, place, n, doc_id, source, digest, shown), the trees of the sources, and the tree of subroots."""

    leaves: DataFrame
    sources: Forest
    top: Forest
    root: str

    def proofs(self, finish, schema: str, payload: list[str]) -> DataFrame:
        above = self.top.roots.select("group", "n", F.lit("").alias("path"))
        to_sources = durable(paths(self.top, above, [], plain, "group long, place long, path string"), "proofs")
        counts = self.sources.roots.select(F.col("group").alias("place"), "n")
        return paths(self.sources, to_sources.select("place", "path").join(counts, "place").select(F.col("place").alias("group"), "n", "path"), payload, finish, schema)


def manifest(docs: DataFrame, shown: Column | None = None) -> Manifest | None:
    """The Merkle trees over ``docs`` (doc_id, source, lang, n_chars, text); None if there are no rows.

    A leaf is a row. Leaves ascend by doc_id within their source, a null id first, then by digest, so rows that repeat an
    id are all there, next to each other. Rows without a source are a source of their own, before all others. ``shown`` is
    a text to check in place of the row's own. Other columns are not read. A text is hashed whole and goes no further.
    """
    text = docs["text"] if shown is None else shown
    own = [F.col(c) for c in FIELDS]
    # the digests are written before rows are sorted, so texts are read once
    digests = durable(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest(own).alias("digest"), leaf_digest([*own[:-1], text]).alias("shown")),
        "digests",
    )
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("digest")]
    placed = durable(numbered(digests, order, "place", per=["source"], total="n"), "placed")
    sources = durable(numbered(placed.select("source", "n").distinct(), [F.asc_nulls_first("source")], "number", total="all"), "sources")
    size = sources.agg(F.max("n").alias("most"), F.max("all").alias("sources")).first()
    if size["most"] is None:
        return None
    numbers = sources.select(F.col("source").alias("_source"), (F.col("number") - 1).alias("group"))
    leaves = durable(placed.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).withColumn("place", F.col("place") - 1).drop("_source"), "leaves")
    trees = grow(leaves, size["most"])
    top = grow(trees.roots.select(F.lit(0).cast("long").alias("group"), F.col("group").alias("place"), F.lit(size["sources"]).cast("long").alias("n"), "digest"), size["sources"])
    return Manifest(leaves, trees, top, top.roots.first()["digest"])


SEALED = "doc_id long, group long, leaf string, proof_sha256 string, folded_root string"


def sealed(rows) -> pa.RecordBatch:
    out = [(doc_id, group, digest, sha(path.replace(",", "").replace(";", "")), fold(shown, path)) for group, _, path, doc_id, digest, shown in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])], names=[c.split()[0] for c in SEALED.split(", ")])


def verified(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof of the row's own leaf is applied to the leaf of the ``shown`` text, and the result held against the root.
    """
    m = manifest(docs, shown)
    if m is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    done = m.proofs(sealed, SEALED, ["doc_id", "digest", "shown"])
    subroots = m.sources.roots.select("group", F.col("digest").alias("subroot"))
    return done.join(subroots, "group").select("doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == m.root).alias("verified"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verified(docs, F.when(remainder(F.col("doc_id"), 5) == 0, lower_ascii(F.col("text"))).otherwise(F.col("text")))


def oracle(levels: int = 4, source_levels: int = 3) -> str:
    """DuckDB SQL, with a step for each level that trees may have (16^levels leaves in a source, 16^source_levels sources)."""
    h = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR END"
    fields = [h.format(c) for c in FIELDS]
    lowered = h.format("(CASE WHEN crc(doc_id::VARCHAR) % 5 = 0 THEN translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') ELSE text END)")
    steps = f"""
WITH crcs AS (SELECT doc_id, {CRC.format("doc_id::VARCHAR")} AS c FROM documents),
d AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
  sha256({" || ".join(fields)}) AS leaf, sha256({" || ".join([*fields[:-1], lowered.replace("crc(doc_id::VARCHAR)", "c")])}) AS shown FROM documents JOIN crcs USING (doc_id)),
n0 AS (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS c FROM d),
p0 AS (SELECT doc_id, g, i, leaf, shown AS f, '' AS proof FROM d)"""
    for k in range(levels + source_levels):
        if k == levels:
            steps += f""",
sub AS (SELECT g, d AS subroot FROM n{k}), n{k}s AS (SELECT 0 AS g, g AS i, d, count(*) OVER () AS c FROM n{k}), p{k}s AS (SELECT doc_id, 0 AS g, g AS i, leaf, f, proof, g AS own FROM p{k})"""
        s = "s" if k == levels else ""
        own = ", own" if k >= levels else ""
        steps += f""",
r{k} AS (SELECT g, i // 16 AS i, c, list(d ORDER BY i) AS ds FROM n{k}{s} GROUP BY g, i // 16, c),
n{k + 1} AS (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS c FROM (SELECT g, i, CASE WHEN c > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM r{k})),
p{k + 1} AS (SELECT doc_id, p.g, p.i // 16 AS i, leaf{own}, CASE WHEN c > 1 THEN sha256(array_to_string(ds[:p.i % 16], '') || f || array_to_string(ds[p.i % 16 + 2:], '')) ELSE f END AS f,
  CASE WHEN c > 1 THEN proof || array_to_string(ds[:p.i % 16], '') || array_to_string(ds[p.i % 16 + 2:], '') ELSE proof END AS proof FROM p{k}{s} p JOIN r{k} r ON p.g = r.g AND p.i // 16 = r.i)"""
    z = levels + source_levels
    return steps + f"""
SELECT doc_id, leaf, subroot, root.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.d AS verified
FROM p{z} JOIN sub ON p{z}.own = sub.g, (SELECT d FROM n{z}) root
"""


#: Unsigned crc32 of a text, for DuckDB.
CRC = "xor(list_reduce(list_transform(range(octet_length(encode({0}))), lambda k: ('0x' || substr(hex(encode({0})), 2 * k + 1, 2))::BIGINT), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"

ORACLE = oracle()

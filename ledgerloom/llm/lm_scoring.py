"""Language-model scores of whole texts from an Elias-Fano n-gram trie (operator 9).

Texts are coded once, in blocks with a dictionary of their own. The dictionaries are dealt by word to merging tasks, a
binary value for each block and share of the words; their counts in all training texts and their numbers come back the
same way. All words of the training texts are tokens, and so are the end of a text and the unknown word, of which there
is one, as in the base score; it has what the discounts of the words leave. A block deals its distinct n-grams to shards
by a hash of their context. A shard's task adds up the counts, builds an Elias-Fano trie of the n-grams seen at least
LEAST times, saves it as a file in the shared folder, and answers the blocks from the mapped file. The number of shards
goes by the number of tokens; neither words nor n-grams come to the driver.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import remainder, table
from ledgerloom.llm.ngram_trie import ContextTrie
from ledgerloom.llm.warc import file_system
from ledgerloom.session import durable, scratch_path

#: Tokens of a block.
BLOCK = 2_000_000
#: Documents for which one share of the words is made, at least 64 shares.
PER_SHARE = 20_000
#: Tokens for which one shard of the n-grams is made, at least 64 shards.
PER_SHARD = 1_000_000
#: Occurrences in the training texts from which an n-gram is in the trie, and bits of a token in a context.
LEAST = 2
BITS = 31


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length byte by byte, so that equal bytes come together, and compressed."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def widened(data: bytes, *types) -> list[np.ndarray]:
    n, out, at = int.from_bytes(data[:8], "little"), [], 0
    size = [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(data[8:], n * sum(size), "zstd", asbytes=True), np.uint8)
    for t, k in zip(types, size):
        out.append(np.ascontiguousarray(raw[at : at + n * k].reshape(k, n).T).reshape(-1).view(t))
        at += n * k
    return out


def packed(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(8, "little") + first + second


def unpacked(data: bytes) -> tuple[bytes, bytes]:
    at = 8 + int.from_bytes(data[:8], "little")
    return data[8:at], data[at:]


def zipped(words: list[bytes]) -> bytes:
    text = b" ".join(words)
    return len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def unzipped(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True).split(b" ")


def coded(docs: DataFrame, shares: int) -> DataFrame:
    """docs (doc_id, held_out, text) to two kinds of rows: a block's words of one share (kind 0: src, share, data), and a
    block (kind 1: src, texts and tokens to learn from, all words, ids, held, sizes, data: the words' places in its dictionary)."""

    def run(batches):
        from pyspark import TaskContext

        base, blocks = TaskContext.get().partitionId() << 24, 0
        local: dict[bytes, int] = {}
        ids, held, sizes, codes, total = [], [], [], [], 0

        def flush():
            src = base + blocks
            code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            size, out = np.array(sizes, np.int64), np.array(held, bool)
            train = np.repeat(~out, size)
            n = np.bincount(code[train], minlength=len(local)).astype(np.int64)
            words = list(local)
            share = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shares
            order = np.argsort(share, kind="stable")
            cuts = np.searchsorted(share[order], np.arange(shares + 1)).tolist()
            some = [k for k in range(shares) if cuts[k + 1] > cuts[k]]
            data = []
            for k in some:
                own = order[cuts[k] : cuts[k + 1]]
                data.append(packed(squeezed(n[own], own.astype(np.int32)), zipped([words[i] for i in own.tolist()])))
            m = len(some)
            none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())]
            if m:
                yield pa.RecordBatch.from_arrays([pa.array([src] * m), pa.array([0] * m, pa.int8()), pa.array(some, pa.int32()), *none, pa.array(data, pa.binary())], names=NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.array([src]), pa.array([1], pa.int8()), pa.nulls(1, pa.int32()), pa.array([int((~out).sum())]), pa.array([int(train.sum())]), pa.array([len(code)]),
                 pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (out.tobytes(), size.tobytes(), squeezed(code)))], names=NAMES)

        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                for id_, out, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                    # bytes: A-Z only, and white space \\x09-\\x0d and \\x20
                    words = text.encode().lower().split() if text else []
                    got = list(map(local.get, words))
                    if None in got:
                        for k, c in enumerate(got):
                            if c is None:
                                got[k] = local.setdefault(words[k], len(local))
                    ids.append(id_)
                    held.append(out)
                    sizes.append(len(words))
                    codes.append(np.array(got, np.int32))
                    total += len(words)
                    if total >= BLOCK:
                        yield from flush()
                        local, ids, held, sizes, codes, total, blocks = {}, [], [], [], [], 0, blocks + 1
        if ids:
            yield from flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


SCHEMA = "src long, kind byte, share int, texts long, tokens long, words long, ids array<long>, held binary, sizes binary, data binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def merged(dictionaries: DataFrame) -> DataFrame:
    """dictionaries (src, share, data) to their words' counts in all training texts (src, share, data: counts, places and
    numbers within the share, -1 for words of no training text), and a row for each share (src null): its distinct words,
    and those seen once and twice."""

    def words_of(data: bytes):
        told, words = unpacked(data)
        return *widened(told, np.int64, np.int32), unzipped(words)

    def share_rows(share, src, data):
        total: dict[bytes, int] = {}
        for d in data:
            n, _, words = words_of(d)
            for w, k in zip(words, n.tolist()):
                total[w] = total.get(w, 0) + k
        number = {w: k for k, w in enumerate(sorted(w for w, n in total.items() if n))}
        none = pa.nulls(1, pa.int64())
        for s, d in zip(src, data):
            _, places, words = words_of(d)
            c = np.fromiter(map(total.__getitem__, words), np.int64, len(words))
            name = np.array([number.get(w, -1) for w in words], np.int32)
            blob = squeezed(c, places, name)
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([share], pa.int32()), pa.array([blob], pa.binary()), none, none, none], names=MERGED_NAMES)
        c = np.fromiter(total.values(), np.int64, len(total))
        yield pa.RecordBatch.from_arrays(
            [none, pa.array([share], pa.int32()), pa.nulls(1, pa.binary()), *(pa.array([int(x.sum())]) for x in (c > 0, c == 1, c == 2))], names=MERGED_NAMES)

    def run(batches):
        share, src, data = None, [], []
        for b in batches:
            for k, s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if k != share and src:
                    yield from share_rows(share, src, data)
                    src, data = [], []
                share = k
                src.append(s)
                data.append(d.as_py())
        if src:
            yield from share_rows(share, src, data)

    return dictionaries.select("share", "src", "data").repartition("share").sortWithinPartitions("share", "src").mapInArrow(run, MERGED)


MERGED = "src long, share int, data binary, distinct long, once long, twice long"
MERGED_NAMES = [c.split()[0] for c in MERGED.split(", ")]


class BlockGrams:
    """The distinct n-grams of two and three tokens of a block, by shard, then by context and token.

    A context is its token, or both with the first one from 1 on. N-grams with the unknown word are left out: no training
    text has one. ``two`` and ``three`` are each token's places among the n-grams, -1 for none."""

    def __init__(self, tokens: np.ndarray, start: int, unknown: int, shards: int):
        n = len(tokens)
        two = np.flatnonzero((tokens[1:] != start) & (tokens[1:] != unknown) & (tokens[:-1] != unknown)) + 1
        pair, of = np.unique(tokens[two - 1] << BITS | tokens[two], return_inverse=True)
        place = np.full(n, -1, np.int64)
        place[two] = of
        three = two[place[two - 1] >= 0]
        triple, of3 = np.unique(place[three - 1] << BITS | tokens[three], return_inverse=True)
        mask = (1 << BITS) - 1
        before = pair[triple >> BITS]
        context = np.concatenate((pair >> BITS, before + (1 << BITS)))
        token = np.concatenate((pair & mask, triple & mask)).astype(np.int32)
        mixed = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        shard = ((mixed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        self.context, self.token, self.shard = context[order], token[order], shard[order]
        self.cuts = np.searchsorted(self.shard, np.arange(shards + 1)).tolist()
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        del context, token, mixed, shard, order, place
        self.two, self.three = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.two[two], self.three[three] = back[of], back[len(pair) + of3]

    def counts(self, learnt: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.token), np.int32)
        for place in (self.two, self.three):
            some = place[learnt]
            out += np.bincount(some[some >= 0], minlength=len(out)).astype(np.int32)
        return out


def sequences(codes: np.ndarray, sizes: np.ndarray, values: np.ndarray, start, end) -> np.ndarray:
    """The values of the texts' words, each text between ``start`` and ``end``."""
    out = np.empty(len(codes) + 2 * len(sizes), values.dtype)
    begin = np.cumsum(sizes + 2) - sizes - 2
    inside = np.ones(len(out), bool)
    inside[begin] = inside[begin + sizes + 1] = False
    out[inside] = values[codes]
    out[begin], out[begin + sizes + 1] = start, end
    return out


def answered(grams: DataFrame, folder: str) -> DataFrame:
    """grams (shard, src, data: contexts' steps, tokens, counts) to answers (src, shard, data): the values of the shard's codes
    and the codes of each n-gram. A task holds one shard at a time."""

    def shard_rows(shard, src, data):
        parts = [widened(d, np.int64, np.int32, np.int32) for d in data]
        context, token, n = (np.concatenate(x) for x in zip(*((np.cumsum(c), t, n) for c, t, n in parts)))
        seen = n > 0
        context, token, n = context[seen], token[seen], n[seen]
        order = np.lexsort((token, context))
        context, token, n = context[order], token[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (token[1:] != token[:-1])))) if len(n) else np.zeros(0, np.int64)
        n = np.add.reduceat(n.astype(np.int64), first) if len(n) else n
        path = f"{folder}/{shard}-{uuid.uuid4().hex}"
        save(ContextTrie.of(context[first], token[first], n, LEAST), path)
        model = load(path)
        tables = [np.concatenate(([0.0], 10.0 ** model.levels[2]["values"])), np.concatenate(([1.0], 10.0 ** model.levels[1]["weights"]))]
        head = b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in tables)
        for s, (steps, t, _) in zip(src, parts):
            blob = head + squeezed(*model.codes(np.cumsum(steps), t))
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["src", "shard", "data"])

    def run(batches):
        shard, src, data = None, [], []
        for b in batches:
            for k, s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if k != shard and src:
                    yield from shard_rows(shard, src, data)
                    src, data = [], []
                shard = k
                src.append(s)
                data.append(d.as_py())
        if src:
            yield from shard_rows(shard, src, data)

    return grams.select("shard", "src", "data").repartition("shard").sortWithinPartitions("shard", "src").mapInArrow(run, "src long, shard int, data binary")


def answers_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Probability told and weight left of each n-gram."""
    tables, at = [], 0
    for _ in range(2):
        n = int.from_bytes(data[at : at + 8], "little")
        tables.append(np.frombuffer(data, np.float64, n, at + 8))
        at += 8 + 8 * n
    told, left = widened(data[at:], np.uint16, np.uint16)
    return tables[0][told], tables[1][left]


def save(model: ContextTrie, path: str) -> None:
    fs, at = file_system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(model.to_bytes())


def load(path: str) -> ContextTrie:
    """The trie in a file: a memory map where the folder is mounted, else its bytes."""
    from pyarrow import fs as pafs

    fs, at = file_system(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return ContextTrie.from_buffer(pa.memory_map(at).read_buffer())
    with fs.open_input_file(at) as f:
        return ContextTrie.from_buffer(f.read_buffer())


def scored(docs: DataFrame, held_out) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a condition on doc_id; other rows are learnt from. Null and empty texts have the end token alone.
    Null and repeated ids keep their rows. The probabilities of all known words, the unknown word and the end sum to one at
    most in every context.
    """
    spark = docs.sparkSession
    shares = max(64, docs.count() // PER_SHARE)
    first = durable(coded(docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text"), shares), "coded")
    blocks = first.filter("kind = 1")
    train, texts, everything = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "texts", "words"))).first()
    total = train + texts
    words = durable(merged(first.filter("kind = 0")), "words")
    told = words.filter("src IS NULL").select("share", "distinct", "once", "twice").collect()
    # words are numbered share by share
    offset, kinds = {}, 0
    for r in sorted(told, key=lambda r: r.share):
        offset[r.share], kinds = kinds, kinds + r.distinct
    unknown, end, start = kinds, kinds + 1, kinds + 2
    if start >= 1 << BITS:
        raise ValueError("more words than the tokens of a context can tell apart")
    distinct = kinds + (texts > 0)
    once, twice = sum(r.once for r in told), sum(r.twice for r in told)
    # the usual estimate of absolute discounting
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    # without any word, or any text, there is still a chance of one
    rest, ends = discount * kinds or 1.0, max(texts, 1)
    mass = train - discount * kinds + rest + ends
    shards = max(64, everything // PER_SHARD)
    dealt = (
        words.filter("src IS NOT NULL").select("src", F.lit(0).cast("byte").alias("kind"), "share", "data")
        .unionByName(blocks.select("src", "kind", "ids", "held", "sizes", "data"), allowMissingColumns=True)
        .repartition("src").sortWithinPartitions("src", "kind", "share").select("src", "kind", "share", "data", "ids", "held", "sizes")
    )
    base_of = total + 0.5 * (distinct + 1)

    def count(batches):
        held: list[tuple[int, bytes]] = []
        for b in batches:
            for k, kind in enumerate(b.column(1).to_pylist()):
                if kind == 0:
                    held.append((b.column(2)[k].as_py(), b.column(3)[k].as_py()))
                    continue
                n = sum(int.from_bytes(d[:8], "little") for _, d in held)
                c, cls = np.zeros(n, np.int64), np.full(n, unknown, np.int64)
                for share, d in held:
                    seen, place, name = widened(d, np.int64, np.int32, np.int32)
                    c[place] = seen
                    cls[place[name >= 0]] = offset[share] + name[name >= 0].astype(np.int64)
                held = []
                yield from block(b.column(0)[k].as_py(), b.slice(k, 1), c, cls)

    def block(src, row, c, cls):
        held = np.frombuffer(row.column(5)[0].as_py(), bool)
        sizes = np.frombuffer(row.column(6)[0].as_py(), np.int64)
        data = row.column(3)[0].as_py()
        codes = widened(data, np.int32)[0]
        of = np.repeat(np.arange(len(sizes)), sizes)
        sums = lambda values: np.bincount(of, values[codes], len(sizes))
        base = sums(np.log10((c + 0.5) / base_of)) + math.log10((texts + 0.5) / base_of)
        grams = BlockGrams(sequences(codes, sizes, cls, start, end), start, unknown, shards)
        n = grams.counts(np.repeat(~held, sizes + 2))
        told = [row.column(4), *(pa.array([x.astype(t).tolist()], pa.list_(k)) for x, t, k in (
            (held, bool, pa.bool_()), (sizes, int, pa.int64()), (sums((c > 0).astype(np.int64)) + (texts > 0), int, pa.int64()), (base, float, pa.float64())))]
        yield pa.RecordBatch.from_arrays([pa.array([src]), pa.nulls(1, pa.int32()), pa.array([data], pa.binary()), *told, pa.array([squeezed(cls.astype(np.int32), c)], pa.binary())], names=OUT)
        some = [k for k in range(shards) if grams.cuts[k + 1] > grams.cuts[k]]
        for lo in range(0, len(some), 64):
            now, blobs = some[lo : lo + 64], []
            for k in now:
                at = slice(grams.cuts[k], grams.cuts[k + 1])
                blobs.append(squeezed(np.diff(grams.context[at], prepend=0), grams.token[at], n[at]))
            m = len(now)
            none = [pa.nulls(m, t) for t in (*(pa.list_(x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([src] * m), pa.array(now, pa.int32()), pa.array(blobs, pa.binary()), *none], names=OUT)

    counted = durable(dealt.mapInArrow(count, OUT_SCHEMA), "counted")
    grams = counted.filter("shard IS NOT NULL").select("shard", "src", "data")
    answers = answered(grams, scratch_path(spark, "model"))

    def score(batches):
        held: dict[int, bytes] = {}
        for b in batches:
            for k, shard in enumerate(b.column(1).to_pylist()):
                if shard is not None:
                    held[shard] = b.column(2)[k].as_py()
                    continue
                ids, out, size, known, base = (b.column(x)[k].values for x in range(3, 8))
                codes = widened(b.column(2)[k].as_py(), np.int32)[0]
                cls, c = widened(b.column(8)[k].as_py(), np.int32, np.int64)
                own = np.where(c > 0, c - discount, rest) / mass
                sizes = size.to_numpy()
                grams = BlockGrams(sequences(codes, sizes, cls.astype(np.int64), start, end), start, unknown, shards)
                told, left = np.zeros(len(grams.token) + 1), np.ones(len(grams.token) + 1)
                for s, data in held.items():
                    at = slice(grams.cuts[s], grams.cuts[s + 1])
                    told[at], left[at] = answers_of(data)
                held = {}
                p = sequences(codes, sizes, own, 1.0, ends / mass)
                # the last place stands for an n-gram that no training text has
                for place in (grams.two, grams.three):
                    p = told[place] + left[place] * p
                of = np.repeat(np.arange(len(sizes)), sizes + 2)
                score = np.bincount(of, np.log10(p), len(sizes))
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(sizes + 1), known, pa.array(np.full(len(ids), total)), base, pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # answers before the block they belong to
    both = answers.unionByName(counted.filter("shard IS NULL"), allowMissingColumns=True).select(*OUT)
    rows = both.repartition("src").sortWithinPartitions("src", F.col("shard").asc_nulls_last())
    return rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


OUT_SCHEMA = "src long, shard int, data binary, ids array<long>, held array<boolean>, sizes array<long>, known array<long>, base array<double>, tokens binary"
OUT = [c.split()[0] for c in OUT_SCHEMA.split(", ")]


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 1)

"""Toxicity of texts whose words may be disguised (operator 3).

A disguised word is decoded as the likeliest path through a lattice of characters: leetspeak symbols may stand for
letters, runs of a letter may be shorter, and single characters set apart may belong together, each at the cost of a
noisy channel; a character language model of the whole corpus weighs the paths (Viterbi). The restored words are then
scored by what labelled training texts tell of them and of their parts.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import remainder, slices, table
from ledgerloom.llm.warc import file_system
from ledgerloom.session import durable, scratch_path

#: What symbols may stand for (fixed values), and the cost of each step of the channel in natural logarithms.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
SWAP, SHORTEN, CLOSE_UP, LEAVE_OUT, KEEP = 1.0, 1.0, 0.5, 2.0, 6.0
GAPS = " .-_*"
EDGES = ".,;:?!\"'()[]{}<>*_-…“”„«»|/\\"
AS_LETTERS = str.maketrans({c: letters[0] for c, letters in LEET.items()})
WORD = re.compile(r"[^\W\d_]+")
DOUBLED = re.compile(r"(.)\1")
APART = re.compile(r"[^\W_](?:[.\-_*][^\W_]){2,}")
RUN = re.compile(r"((.)\2*)", re.DOTALL)
#: Pieces of a word set apart may have marks between them. Of two pieces of up to SMALL characters the likelier reading
#: decides; if one is longer, closing up has to be likelier by so much (natural logarithm), since any two words may meet.
PIECES = re.compile(r"[^\W_]+(?:[.\-_*]+[^\W_]+)+")
SMALL, SURE = 3, 3.0
#: Bound of the labelled rows the classifier is fitted on: those with the smallest hashes.
FIT_ROWS = 20_000
#: Features of a word: itself, and its beginnings of so many characters; each as present so many times at least.
BEGINNINGS = (3, 4, 5, 6)
TIMES = (1, 2, 3, 5, 8)
#: A feature is either telling, and so many of its texts are toxic, or not, and as many are as of all texts; so many
#: are telling beforehand. Features count from a chance of LEAST on.
TELLING, BEFORE, LEAST = 0.95, 1e-4, 0.05
THRESHOLD = 0.7


# --- the character language model ---------------------------------------------------------------------
def trigram_counts(docs: DataFrame) -> DataFrame:
    """Counts of the character trigrams of all words: key (three code points of 21 bits) and n."""

    def run(batches):
        for _, texts in slices(batches):
            words = Counter(w for t in texts if t for w in t.lower().split())
            if not words:
                continue
            sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
            weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
            code = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            start = np.repeat(np.cumsum(sizes + 2) - sizes - 2, sizes) + np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = code[start] << 42 | code[start + 1] << 21 | code[start + 2]
            keys, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, weight).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def packed(gram: str) -> int:
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return key


class StoredCounts:
    """Counts of characters in a row, as sorted arrays in files of the shared folder: first key, rows and path of each.

    Where the folder is mounted the files are mapped, so all workers of a machine share them."""

    def __init__(self, files: list[tuple[int, int, str]]):
        self.files = sorted(files)
        self.first = [f[0] for f in self.files]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def arrays(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            from pyarrow import fs as pafs

            _, rows, path = self.files[k]
            fs, at = file_system(path)
            if isinstance(fs, pafs.LocalFileSystem):
                data = pa.memory_map(at).read_buffer()
            else:
                with fs.open_input_file(at) as f:
                    data = f.read_buffer()
            self.open[k] = np.frombuffer(data, np.int64, rows), np.frombuffer(data, np.int64, rows, 8 * rows)
        return self.open[k]

    def __getitem__(self, gram: str) -> int:
        key = packed(gram)
        k = bisect_right(self.first, key) - 1
        if k < 0:
            return 0
        keys, n = self.arrays(k)
        at = int(np.searchsorted(keys, key))
        return int(n[at]) if at < len(keys) and keys[at] == key else 0

    def get(self, gram: str, other: int = 0) -> int:
        return self[gram] or other


def stored(counts: DataFrame, label: str) -> StoredCounts:
    """counts (key, n), each key once, written by tasks as sorted files."""
    folder = scratch_path(counts.sparkSession, label)

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            keys, n = (np.concatenate(x) for x in zip(*held))
            path = f"{folder}/{uuid.uuid4().hex}"
            fs, at = file_system(path)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(at, compression=None) as out:
                out.write(keys.tobytes())
                out.write(n.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([int(keys[0])]), pa.array([len(keys)]), pa.array([path])], names=["first", "rows", "path"])

    told = counts.select("key", "n").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "first long, rows long, path string")
    return StoredCounts([tuple(r) for r in told.collect()])


def char_model(counts: DataFrame) -> CharModel:
    """The model of all trigrams of :func:`trigram_counts`. Shorter counts are summed from all of them; those of single
    characters, no more than there are characters, come to the driver."""
    three = durable(counts, "trigrams")
    of = lambda key: three.groupBy(key.alias("key")).agg(F.sum("n").alias("n"))
    pair, two = of(F.shiftright("key", 21)), of(F.col("key").bitwiseAND(2**42 - 1))
    one = lambda key: Counter({chr(r.key): r.n for r in of(key).collect()})
    last, middle = F.col("key").bitwiseAND(2**21 - 1), F.shiftright("key", 21).bitwiseAND(2**21 - 1)
    return CharModel(stored(three, "three"), shorter=(stored(pair, "pair"), stored(two, "two"), one(middle), one(last)))


class CharModel:
    """Trigram model with shorter ones mixed in. ``counts`` maps three characters to their count; ``shorter`` has the
    counts of the first two, the last two, the middle one and the last one, if they are not to be summed from ``counts``."""

    def __init__(self, counts: dict[str, int] | StoredCounts, mix: float = 5.0, shorter: tuple | None = None):
        self.mix, self.three = mix, counts
        if shorter is None:
            shorter = Counter(), Counter(), Counter(), Counter()
            for (a, b, c), n in counts.items():
                for total, x in zip(shorter, (a + b, b + c, b, c)):
                    total[x] += n
        self.pair, self.two, self.single, self.one = shorter
        self.total = sum(self.one.values())
        self.kinds = len(self.one) + 1
        self.known: dict[str, float] = {}

    def __call__(self, gram: str) -> float:
        if gram not in self.known:
            if len(self.known) > 250_000:
                self.known.clear()
            p = (self.one[gram[2]] + 0.5) / (self.total + 0.5 * self.kinds)
            p = (self.two[gram[1:]] + self.mix * p) / (self.single[gram[1]] + self.mix)
            self.known[gram] = math.log((self.three.get(gram, 0) + self.mix * p) / (self.pair[gram[:2]] + self.mix))
        return self.known[gram]


# --- decoding -----------------------------------------------------------------------------------------
@lru_cache(4096)
def ways(run: str) -> tuple[tuple[str, float], ...]:
    """What a run of one character may stand for, with its cost. A gap may close up or part words."""
    c, n = run[0], len(run)
    if c in GAPS and c not in LEET:
        return ("", CLOSE_UP), (" ", 0.0)
    if c.isalpha():
        return (run, 0.0), *((c * k, SHORTEN) for k in sorted({1, min(2, n - 1)}) if n > 1)
    return ("", LEAVE_OUT), (" ", KEEP), *((x * k, SWAP * k) for x in LEET.get(c, "") for k in sorted({1, n}))


def runs(text: str) -> list[str]:
    return [run for run, _ in RUN.findall(text)]


def likeliest(places: list[str], model: CharModel, state: str = "^^", ends: bool = True) -> str:
    """The likeliest reading of a lattice's places (runs of a character) behind ``state``, the two characters before.

    A path keeps a link to the path it goes on from, so time and memory are linear in the places.
    """
    best: dict[str, tuple[float, tuple | None]] = {state: (0.0, None)}
    for run in places:
        new: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for written, cost in ways(run):
                s, total = state, score - cost
                for c in written:
                    if c == " ":
                        if s == "^^":
                            continue
                        total += model(s + "$")
                        s = "^^"
                    else:
                        total += model(s + c)
                        s = s[1] + c
                if s not in new or total > new[s][0]:
                    new[s] = (total, (path, written))
        best = new
    _, path = max(((score + (model(s + "$") if ends and s != "^^" else 0.0), path) for s, (score, path) in best.items()), key=lambda x: x[0])
    read = []
    while path:
        path, written = path
        read.append(written)
    return "".join(reversed(read))


def decode(text: str, model: CharModel, known: dict | None = None) -> str:
    """The likeliest reading of a disguised text: letters, with blanks between words.

    Behind two letters that stand for themselves all paths are in one state, so the lattice falls into stretches that
    are decoded on their own. ``known`` keeps the readings of the shorter stretches.
    """
    out: list[str] = []
    places: list[str] = []
    state, calm = "^^", 0

    def close(ends: bool):
        key = (state, "".join(places), ends)
        if known is None or len(places) > 64:
            return likeliest(places, model, state, ends)
        if key not in known:
            known[key] = likeliest(places, model, state, ends)
        return known[key]

    for run in runs(text):
        certain = len(run) == 1 and run.isalpha()
        if not places and certain:
            out.append(run)
            state = state[1] + run
            continue
        places.append(run)
        calm = calm + 1 if certain else 0
        if calm == 2:
            out.append(close(False))
            state, places, calm = places[-2] + run, [], 0
    if places:
        out.append(close(True))
    return "".join(out)


class Restorer:
    """Restored words of texts. What tokens and stretches stand for is kept, up to ``limit`` of them."""

    def __init__(self, model: CharModel, limit: int = 150_000):
        self.model, self.limit = model, limit
        self.known: dict[str, tuple[tuple[str, ...], tuple | None]] = {}
        self.joins: dict[str, float] = {}
        self.stretches: dict[tuple, str] = {}
        self.groups: dict[str, list[str]] = {}

    def told(self, words) -> tuple[str, ...]:
        return tuple(words)

    def decode(self, text: str) -> list[str]:
        return decode(text, self.model, self.stretches).split()

    def token(self, token: str) -> tuple[tuple[str, ...], tuple | None]:
        """The restored words of a token, and its pieces as in :meth:`pieces`."""
        core = token.strip(EDGES)
        plain = core.isalpha()
        twice = DOUBLED.search(core)
        if plain and not twice:
            out = (core,)
        elif plain and not DOUBLED.search(core, twice.end()) and core[twice.end() :][:1] != twice[1]:
            # one doubled letter: one stretch, up to the second letter behind it
            start, end = twice.start(), twice.end() + 2
            key = ("^^" + core[:start])[-2:], core[start:end], len(core) < end
            if key not in self.stretches:
                self.stretches[key] = likeliest(runs(key[1]), self.model, key[0], key[2])
            read = core[:start] + self.stretches[key] + core[end:]
            out = (core,) if read == core else (read, core)
        elif APART.search(core):
            out = tuple(self.decode(core))
        else:
            # with symbols that may be letters at the edges
            wide = token.strip("".join(c for c in EDGES if c not in LEET)) if any(c in LEET for c in token) else core
            letters = sum(map(str.isalpha, wide))
            if letters and (DOUBLED.search(wide) or any(c in LEET for c in wide)):
                out = tuple(dict.fromkeys([*self.decode(wide), *WORD.findall(wide)]))
            else:
                out = tuple(WORD.findall(core))
        entry = self.known[token] = self.told(out), self.pieces(token, core, plain)
        return entry

    def words(self, text: str | None) -> Counter:
        """What is to be told of the restored words of a whole text, the words themselves unless ``told`` says
        otherwise, and how often."""
        tokens = text.lower().split() if text else []
        if not tokens:
            return Counter()
        for kept in (self.known, self.joins, self.stretches, self.groups):
            if len(kept) > self.limit:
                kept.clear()
        known, new = self.known, self.token
        entries = [known[t] if t in known else new(t) for t in tokens]
        out = Counter(chain.from_iterable([told for told, _ in entries]))
        single: Counter = Counter()
        short = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        if len(short) > 2 and (short[:-2] & short[1:-1] & short[2:]).any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], short.astype(np.int8), [0]))))
            for lo, hi in zip(edge[::2], edge[1::2]):
                if hi - lo > 2:
                    # the outer ones may carry a mark
                    lo -= lo > 0 and len(tokens[lo - 1].strip(EDGES)) == 1
                    hi += hi < len(tokens) and len(tokens[hi].strip(EDGES)) == 1
                    single.update(self.decode(" ".join(t.strip(EDGES) or t for t in tokens[lo:hi])))
        # both ways may find the same word
        found = self.joined([pieces for _, pieces in entries])
        out.update(self.told((single | Counter(found)).elements() if single else found))
        return out

    @staticmethod
    def pieces(token: str, core: str, plain: bool) -> tuple | None:
        """The pieces of a word that a token may be: none for marks alone, null for other tokens.

        Each comes with its last two and first two characters as letters, and with whether it is small."""
        out: tuple[str, ...] | None = None
        if plain:
            return ((core, core[-2:] if len(core) > 1 else "^" + core, core[:2] if len(core) > 1 else core + "$", len(core) <= SMALL),)
        if not core:
            if all(c in GAPS for c in token):
                out = ()
            elif len(token) == 1:
                out = (token,)
        elif all(c.isalpha() or c in LEET for c in core):
            if len(core) <= SMALL or any(map(str.isalpha, core)):
                out = (core,)
        elif PIECES.fullmatch(core) and not APART.search(core):
            out = tuple(re.split(r"[.\-_*]+", core))
        return out and tuple((p, ("^" + p)[-2:].translate(AS_LETTERS), (p + "$")[:2].translate(AS_LETTERS), len(p) <= SMALL) for p in out)

    def gain(self, beside: str) -> float:
        """How much likelier a gap closes up than it parts words, by the two characters on either side of it."""
        m, end, begin = self.model, beside[:2], beside[2:]
        out = m(end + begin[0]) + m(end[1] + begin) - CLOSE_UP - m(end + "$") - m("^^" + begin[0]) - m("^" + begin)
        self.joins[beside] = out
        return out

    def together(self, left: str, right: str) -> float:
        """Above 0 if two small neighbours have to be decoded together. Between two of two letters or more, the reading
        of the gap depends on the letters beside it alone, so the model tells at once."""
        apart = len(left) > 1 < len(right) and left.isalpha() and right.isalpha() and not DOUBLED.search(left) and not DOUBLED.search(right)
        out = self.joins[f"{left} {right}"] = self.gain(left[-2:] + right[:2]) if apart else math.inf
        return out

    def joined(self, tokens: list[tuple | None]) -> list[str]:
        """Words that runs of pieces stand for, without those that are there as tokens."""
        joins, out = self.joins, []

        def close(group: list[str]):
            text = " ".join(group)
            if text not in self.groups:
                own = set(group)
                self.groups[text] = [w for w in self.decode(text) if w not in own] if any(map(str.isalpha, "".join(group))) else []
            out.extend(self.groups[text])

        group: list[str] = []
        before, end, small = "", "", False
        for own in tokens:
            if own is None:
                if group:
                    close(group)
                    group = []
                before = ""
                continue
            for piece, last, first, tiny in own:
                if before:
                    if small and tiny:
                        beside = f"{before} {piece}"
                        up = (joins[beside] if beside in joins else self.together(before, piece)) > 0
                    else:
                        beside = end + first
                        up = (joins[beside] if beside in joins else self.gain(beside)) > SURE
                    if up:
                        if group:
                            group.append(piece)
                        else:
                            group = [before, piece]
                    elif group:
                        close(group)
                        group = []
                before, end, small = piece, last, tiny
        if group:
            close(group)
        return out


# --- the classifier -----------------------------------------------------------------------------------
def features(word: str) -> list[str]:
    """The word and its beginnings. A mark at the end tells the word from a longer one's beginning."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def feature_counts(fit: DataFrame, model) -> DataFrame:
    """fit (toxic, text) to feature, toxic and clean texts that have it."""

    def run(batches):
        restorer = Restorer(model.value)
        for marks, texts in slices(batches):
            seen = {0: Counter(), 1: Counter()}
            of: dict[str, list[str]] = {}
            for mark, text in zip(marks.to_pylist(), texts):
                own: Counter = Counter()
                for w, n in restorer.words(text).items():
                    if w not in of:
                        of[w] = features(w)
                    for f in of[w]:
                        own[f] += n
                seen[mark].update(f"{k}{f}" for f, n in own.items() for k in TIMES if k <= n)
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "clean"])

    return fit.select("mark", "text").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The labelled training texts: mark (0 or 1) and text, each text once. At most ``rows`` ids; hashes decide which."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(remainder(F.col("doc_id"), 3) != 1)
    ids = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("mark")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` ids of 16 bytes
    return docs.select("doc_id", "text").join(F.broadcast(durable(ids, "labels")), "doc_id").filter("text IS NOT NULL").groupBy("text").agg(F.max("mark").alias("mark"))


def trained(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """(character model, evidence of each feature). The model's counts stay in files, the evidence is bounded by the
    fit's rows."""
    model = char_model(trigram_counts(docs))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fit = durable(fit_rows(docs, labels, rows), "fit")
    marked = fit.groupBy("mark").count().collect()
    n = {r.mark: r["count"] for r in marked}
    share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    # chance that a feature is telling, by the texts it is in
    odds = math.log(BEFORE / (1 - BEFORE)) + F.col("toxic") * math.log(TELLING / share) + F.col("clean") * math.log((1 - TELLING) / (1 - share))
    toxic = (F.col("toxic") + share) / (F.col("toxic") + F.col("clean") + 1)
    found = feature_counts(fit, sent).filter("toxic > 1").withColumn("p", toxic / (1 + F.exp(-odds))).filter(F.col("p") >= LEAST)
    known = {r.feature: (r.p, (r.toxic + share) / (r.toxic + r.clean + 1), r.clean) for r in found.collect()}
    # the fit's bounded rows again, as the telling features they have
    texts = present(fit, sent, by_name(known)).collect()
    return sent, by_name(decision_list(known, [(set(r.features), r.mark) for r in texts], share))


def decision_list(known: dict[str, tuple[float, float, int]], texts: list[tuple[set, int]], share: float) -> dict[str, tuple[int, float]]:
    """Place and score of each feature, the most telling first. A text is scored by its first feature.

    A feature's score is the share of toxic texts among those without a feature before it. ``known`` has the features'
    chance to be telling, the share of toxic texts among all with the feature, and the number of clean ones; a feature that
    has no text left counts by the former two if no clean text has it.
    """
    of: dict[str, list[int]] = {}
    for k, (own, _) in enumerate(texts):
        for f in own:
            of.setdefault(f, []).append(k)
    left = [True] * len(texts)

    def rate(f: str) -> tuple[float, int, str]:
        marks = [texts[k][1] for k in of.get(f, ()) if left[k]]
        return -(sum(marks) + share) / (len(marks) + 1), -len(marks), f

    heap = [rate(f) for f in known]
    heapify(heap)
    out: dict[str, tuple[int, float]] = {}
    while heap:
        top = heappop(heap)
        now = rate(top[2])
        if now != top:
            heappush(heap, now)
            continue
        r, n, f = top
        if not n:
            break
        out[f] = (len(out), -r)
        for k in of[f]:
            left[k] = False
    rest = sorted((-p * share_of, f) for f, (p, share_of, clean) in known.items() if f not in out and not clean)
    return out | {f: (len(out) + k, -r) for k, (r, f) in enumerate(rest)}


def by_name(weights: dict) -> dict[str, list[tuple]]:
    """Weights of features by their name, without the number in front: (number, weight)."""
    out: dict[str, list[tuple]] = {}
    for f, w in weights.items():
        out.setdefault(f[1:], []).append((int(f[0]), w))
    return out


class Judge(Restorer):
    """Texts by a decision list; of their words only the list's features are told."""

    def __init__(self, model: CharModel, weights: dict[str, list[tuple]]):
        super().__init__(model)
        self.weights = weights
        # all features of a word begin alike
        self.heads = {f[:3] for f in weights}

    def told(self, words) -> tuple[str, ...]:
        weights, heads = self.weights, self.heads
        found = [w for w in words if f"{w[:3]}$"[:3] in heads]
        return tuple(f for w in found for f in features(w) if f in weights) if found else ()

    def __call__(self, text: str | None) -> tuple | None:
        """The first feature of a text in the decision list, as ((place, score), feature), or none."""
        return min(((w, f"{k}{f}") for f, n in self.words(text).items() for k, w in self.weights[f] if k <= n), default=None)

    def present(self, text: str | None) -> list[str]:
        return [f"{k}{f}" for f, n in self.words(text).items() for k, _ in self.weights[f] if k <= n]


def present(fit: DataFrame, model, weights: dict[str, list[tuple]]) -> DataFrame:
    """fit (mark, text) to mark and the features of ``weights`` that the text has."""
    told = fit.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        judge = Judge(model.value, told.value)
        for marks, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([marks, pa.array([judge.present(t) for t in texts], pa.list_(pa.string()))], names=["mark", "features"])

    return fit.select("mark", "text").mapInArrow(run, "mark long, features array<string>")


def with_scores(docs: DataFrame, labels: DataFrame, carry: list[str], name: str = "score", rows: int = FIT_ROWS) -> DataFrame:
    """The columns ``carry`` of ``docs`` (doc_id, text, ...) and the score of each row's text, from 0 to 1.

    labels (doc_id, toxic) are learnt from where crc32 of the id modulo 3 is not 1; without any toxic one all scores
    are 0. The score of a text is that of its most telling feature; null and empty texts have 0. Null and repeated ids
    keep their rows.
    """
    model, evidence = trained(docs, labels, rows)
    told = docs.sparkSession.sparkContext.broadcast(evidence)
    given = docs.select(F.col("text").alias("_text"), *carry)

    def run(batches):
        judge = Judge(model.value, told.value)
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                best = [judge(t) for t in part.column(0).to_pylist()]
                score = pa.array([x[0][1] if x else 0.0 for x in best], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], score], names=[*carry, name])

    return given.mapInArrow(run, T.StructType([*given.schema.fields[1:], T.StructField(name, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score and predicted (1 from the threshold on) of each row of ``docs``, as in :func:`with_scores`."""
    return with_scores(docs, labels, ["doc_id"], rows=rows).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")

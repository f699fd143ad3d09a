"""N-gram trie with Elias-Fano levels, for language models over whole-number tokens.

A level holds the last tokens of its n-grams, grouped by parent, as one monotone sequence (each group counted on from
the last value of the one before), and pointers to the groups of children; both are Elias-Fano coded. Probabilities and
backoff weights are quantised to 256 values, rounded down, so the probabilities of all tokens still sum to one at most.
The whole trie is one file whose parts are used in place, so a memory map of it serves all workers of a machine.
"""

from __future__ import annotations

import json

import numpy as np

DISCOUNT = 0.75


class EliasFano:
    """A monotone sequence of ``n`` values up to ``top``, in about 2 + log2(top / n) bits each, with random access."""

    def __init__(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray, n: int, bits: int):
        self.low, self.high, self.rank, self.n, self.bits = low, high, rank, n, bits

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, int(v[-1] // n).bit_length() - 1) if n and v[-1] >= n else 0
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(at[-1]) if n else 0) // 64 + 1
        high = np.zeros(size, np.uint64)
        np.bitwise_or.at(high, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        rank = np.concatenate(([0], np.cumsum(np.bitwise_count(high)))).astype(np.uint32)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            place = np.arange(n) * bits
            part = v & np.uint64((1 << bits) - 1)
            off = (place % 64).astype(np.uint64)
            np.bitwise_or.at(low, place // 64, part << off)
            over = place % 64 + bits > 64
            np.bitwise_or.at(low, place[over] // 64 + 1, part[over] >> (np.uint64(64) - off[over]))
        return cls(low, high, rank, n, bits)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.rank, i, "right") - 1
        rest = (i - self.rank[word]).astype(np.int64)
        bits = self.high[word]
        # the place of the rest-th one in the word: halve the word six times
        place = np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << half) - 1)
            ones = np.bitwise_count(bits & mask).astype(np.int64)
            up = rest >= ones
            place += np.where(up, half, 0)
            rest -= np.where(up, ones, 0)
            bits = np.where(up, bits >> np.uint64(half), bits & mask)
        value = word * 64 + place - i
        if self.bits:
            at = i * self.bits
            off = (at % 64).astype(np.uint64)
            lower = self.low[at // 64] >> off
            over = off + np.uint64(self.bits) > 64
            lower = np.where(over, lower | (self.low[at // 64 + 1] << ((np.uint64(64) - off) % np.uint64(64))), lower)
            value = (value << self.bits) | (lower & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return value

    def parts(self) -> dict:
        return {"low": self.low, "high": self.high, "rank": self.rank, "n": self.n, "bits": self.bits}


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their values; a code's value is never above what it stands for."""
    levels = np.unique(np.quantile(x, np.linspace(0, 1, 256), method="lower")) if len(x) else np.zeros(1)
    return (np.searchsorted(levels, x, "right") - 1).astype(np.uint8), levels


class NgramTrie:
    """Interpolated absolute discounting over tokens 0 to ``kinds`` - 1; ``start`` is only ever a context."""

    def __init__(self, order: int, kinds: int, start: int, levels: list[dict]):
        self.order, self.kinds, self.start, self.levels = order, kinds, start, levels

    @classmethod
    def build(cls, kinds: int, bits: int, start: int, single: np.ndarray, keys: list[tuple[np.ndarray, np.ndarray]]) -> NgramTrie:
        """single: count of each token (of ``start``: the sequences); keys: for 2, 3, ... tokens the packed n-grams,
        ``bits`` a token, and their counts. With an n-gram, all n-grams in it must be there."""
        single = single.astype(np.float64)
        seen = single.copy()
        seen[start] = 0
        p = seen / max(seen.sum(), 1)
        levels, before, context = [], np.arange(kinds, dtype=np.int64), single
        for k in range(len(keys) + 1):
            last = k == len(keys)
            level: dict = {}
            if k:
                level["ids"] = ids
            if not last:
                key, count = keys[k]
                order = np.argsort(key)
                key, count = key[order].astype(np.int64), count[order].astype(np.float64)
                parent = np.searchsorted(before, key >> bits)
                told = np.maximum(count - DISCOUNT, 0) / context[parent]
                left = np.maximum(1.0 - np.bincount(parent, told, len(before)), 1e-12)
                token = key & ((1 << bits) - 1)
                children = np.bincount(parent, minlength=len(before))
                level["pointers"] = EliasFano.of(np.concatenate(([0], np.cumsum(children))))
                # groups follow each other: each is counted on from the last value of the one before
                ends = np.cumsum(children)[children > 0] - 1
                base = np.concatenate(([0], np.cumsum(token[ends])[:-1])) if len(ends) else np.zeros(0, np.int64)
                ids = EliasFano.of(token + np.repeat(base, children[children > 0]))
                suffix = key & ((1 << bits * (k + 1)) - 1)
                lower = suffix if k == 0 else np.searchsorted(before, suffix)
                level["weight"], level["weights"] = quantised(np.log10(left))
                nextp = told + left[parent] * p[lower]
            level["code"], level["values"] = quantised(np.log10(np.maximum(p, 1e-300)))
            levels.append(level)
            if not last:
                before, context, p = key, count, nextp
        return cls(len(keys) + 1, kinds, start, levels)

    def child(self, level: int, parent: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Index in ``level`` of each parent's successor ``token``, -1 if there is none: a search in the parent's group."""
        pointers, ids = self.levels[level - 1]["pointers"], self.levels[level]["ids"]
        out = np.full(len(parent), -1, np.int64)
        lo, hi = pointers[parent], pointers[parent + 1]
        some = np.flatnonzero(hi > lo)
        if not len(some):
            return out
        lo, hi, token = lo[some], hi[some], token[some]
        want = token + np.where(lo > 0, ids[np.maximum(lo - 1, 0)], 0)
        end = hi.copy()
        active = np.arange(len(some))
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            below = ids[mid] < want[active]
            lo[active] = np.where(below, mid + 1, lo[active])
            hi[active] = np.where(below, hi[active], mid)
            active = active[lo[active] < hi[active]]
        at = np.minimum(lo, end - 1)
        good = (lo < end) & (ids[at] == want)
        out[some[good]] = at[good]
        return out

    def log10(self, tokens: np.ndarray) -> np.ndarray:
        """log10 probability of each token of sequences one after the other, each begun by ``start`` (0 there)."""
        n = len(tokens)
        nodes = [tokens.astype(np.int64)]
        for k in range(1, self.order):
            node = np.full(n, -1, np.int64)
            at = np.flatnonzero((nodes[-1][:-1] >= 0) & (tokens[1:] != self.start)) + 1
            if len(at):
                pair, where = np.unique(nodes[-1][at - 1] * self.kinds + tokens[at], return_inverse=True)
                node[at] = self.child(k, pair // self.kinds, pair % self.kinds)[where]
            nodes.append(node)
        out = np.zeros(n)
        found = np.zeros(n, bool)
        for k in range(self.order - 1, -1, -1):
            level = self.levels[k]
            own = (nodes[k] >= 0) & ~found
            out[own] += level["values"][level["code"][nodes[k][own]]]
            found |= own
            if k:
                # not found with this much context: the weight of the context, if it is known
                before = np.concatenate(([-1], nodes[k - 1][:-1]))
                back = ~found & (before >= 0)
                weight = self.levels[k - 1]
                out[back] += weight["weights"][weight["weight"][before[back]]]
        out[tokens == self.start] = 0.0
        return out

    # --- one file -------------------------------------------------------------------------------------
    def to_bytes(self) -> bytes:
        parts, at, told = [], 0, []
        for level in self.levels:
            entry = {}
            for name, value in level.items():
                arrays = value.parts() if isinstance(value, EliasFano) else {"": value}
                entry[name] = {}
                for part, a in arrays.items():
                    if isinstance(a, np.ndarray):
                        data = a.tobytes() + bytes(-a.nbytes % 8)
                        entry[name][part] = [str(a.dtype), len(a), at]
                        parts.append(data)
                        at += len(data)
                    else:
                        entry[name][part] = int(a)
            told.append(entry)
        head = json.dumps({"order": self.order, "kinds": self.kinds, "start": self.start, "levels": told}).encode()
        head += b" " * (-len(head) % 8)
        return len(head).to_bytes(8, "little") + head + b"".join(parts)

    @classmethod
    def from_buffer(cls, data) -> NgramTrie:
        """From the bytes of the file, in place."""
        size = int(np.frombuffer(data, np.int64, 1)[0])
        head = json.loads(bytes(memoryview(data)[8 : 8 + size]))

        def read(x):
            return np.frombuffer(data, x[0], x[1], 8 + size + x[2]) if isinstance(x, list) else x

        levels = []
        for entry in head["levels"]:
            levels.append({name: read(parts[""]) if "" in parts else EliasFano(**{k: read(v) for k, v in parts.items()}) for name, parts in entry.items()})
        return cls(head["order"], head["kinds"], head["start"], levels)


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where they are not."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class ContextTrie(NgramTrie):
    """One shard of a model: a root, contexts as whole numbers below it, and the tokens seen after each context."""

    @classmethod
    def of(cls, context: np.ndarray, token: np.ndarray, count: np.ndarray, least: int) -> ContextTrie:
        """From distinct n-grams in the order of context and token. Those under ``least`` are left to shorter contexts, with
        their part of the context's count."""
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        total = np.bincount(of, count, len(first))
        kept = count >= least
        told = (count[kept] - DISCOUNT) / total[of[kept]]
        children = np.bincount(of[kept], minlength=len(first))
        left = np.maximum(1.0 - np.bincount(of[kept], told, len(first)), 1e-12)
        some = children > 0
        contexts, children, left, token = context[first][some], children[some], left[some], token[kept].astype(np.int64)
        ends = np.cumsum(children) - 1
        base = np.concatenate(([0], np.cumsum(token[ends])[:-1])) if len(ends) else np.zeros(0, np.int64)
        weight, weights = quantised(np.log10(left))
        code, values = quantised(np.log10(told))
        return cls(3, 0, -1, [
            {"pointers": EliasFano.of(np.array([0, len(contexts)]))},
            {"ids": EliasFano.of(contexts), "pointers": EliasFano.of(np.concatenate(([0], np.cumsum(children)))), "weight": weight, "weights": weights},
            {"ids": EliasFano.of(token + np.repeat(base, children)), "code": code, "values": values},
        ])

    def sorted_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts, and context's place and token of each n-gram, read from the sequences once for many searches."""
        if not hasattr(self, "keys"):
            ids, pointers, tokens = self.levels[1]["ids"], self.levels[1]["pointers"], self.levels[2]["ids"]
            ends = pointers[np.arange(pointers.n)]
            size, value = np.diff(ends), tokens[np.arange(tokens.n)]
            base = np.concatenate(([0], value[ends[1:-1] - 1])) if len(size) else np.zeros(0, np.int64)
            self.keys = ids[np.arange(ids.n)], np.repeat(np.arange(len(size)), size) << 31 | value - np.repeat(base, size)
        return self.keys

    def codes(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the probability told and of the weight left for each n-gram, from 1 on; 0 where there is none. Equal
        contexts follow each other."""
        told, left = np.zeros(len(token), np.uint16), np.zeros(len(token), np.uint16)
        if not len(token):
            return told, left
        contexts, leaves = self.sorted_keys()
        new = np.concatenate(([True], context[1:] != context[:-1]))
        node = found(contexts, context[new])[np.cumsum(new) - 1]
        at = np.flatnonzero(node >= 0)
        left[at] = self.levels[1]["weight"][node[at]].astype(np.uint16) + 1
        leaf = found(leaves, node[at] << 31 | token[at].astype(np.int64))
        seen = leaf >= 0
        told[at[seen]] = self.levels[2]["code"][leaf[seen]].astype(np.uint16) + 1
        return told, left


def windows(tokens: np.ndarray, bits: int, size: int, start: int) -> np.ndarray:
    """Packed n-grams of ``size`` tokens; none runs over the begin of a sequence."""
    if len(tokens) < size:
        return np.zeros(0, np.int64)
    key = np.zeros(len(tokens) - size + 1, np.int64)
    good = np.ones(len(key), bool)
    for k in range(size):
        part = tokens[k : k + len(key)]
        key = key << bits | part
        if k:
            good &= part != start
    return key[good]

"""SentencePiece BPE by vectorised merge rounds: whole batches of words as flat numpy symbol arrays.

No vocabulary piece joins a character to a blank mark behind it, so a text falls apart into words (a run of blank marks
and what follows), most of which repeat: a worker keeps the ids of those it has met. New words of a batch are settled
together. Every round takes, in each word, the lowest rank among its neighbouring pairs (a segmented minimum), merges
the pairs of that rank from the left, closes the gaps, and looks up only the pairs beside a merge, until no word has
a pair left. Merging all pairs of a word's lowest rank at once is what one merge after the other gives, as long as no
longer piece made with the merged one ranks as low or lower; where one does, only the leftmost pair merges in a round.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import islice

import numpy as np

BLANK = "▁"
NONE = np.iinfo(np.int32).max
#: Tells whether a model's normaliser does more than mark blanks.
PROBE = " ﬁ  Ａ\t́e　x\r\n "
#: A word of more symbols whose lowest pair must merge alone is settled by a queue, one merge after the other.
ALONE = 64


class Pieces:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback; ``limit`` bounds the words kept.

    Models of another kind, without byte fallback, or with user-defined or unused pieces are refused.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = m.id_to_piece(list(range(n)))
        other = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) for i in range(n)]
        self.bytes_at = np.full(256, -1, np.int64)
        for i in range(n):
            if m.is_byte(i):
                self.bytes_at[int(names[i][3:5], 16)] = i
        if any(m.is_unused(i) for i in range(n)) or (self.bytes_at < 0).any():
            raise ValueError("only BPE models with byte fallback and plain pieces are known here")
        self.plain = m.normalize(PROBE) == self.marked(PROBE)
        if any(BLANK in p.lstrip(BLANK) for p, o in zip(names, other) if not o):
            raise ValueError("a piece holds a blank behind another character")
        self.pairs([(p, i, m.get_score(i)) for i, (p, o) in enumerate(zip(names, other)) if not o], n)
        shown = [b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.leads = np.array([not o and p.startswith(BLANK) for p, o in zip(names, other)])
        self.is_byte = np.array([bool(m.is_byte(i)) for i in range(n)])
        self.ends_text = (m.bos_id(), m.eos_id())
        self.limit = limit
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    # --- tables ------------------------------------------------------------------------------------
    def pairs(self, pieces: list[tuple[str, int, float]], n: int) -> None:
        """Symbols of characters and the sorted table of pairs that make a piece."""
        number = {p: i for p, i, _ in pieces}
        # characters that occur in pieces without being one are symbols too
        for c in sorted({c for p, _, _ in pieces for c in p} - number.keys()):
            number[c] = n + len(number)
        scores = sorted({s for p, _, s in pieces if len(p) > 1}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        made = {}
        for p, i, s in pieces:
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    made[a << 32 | b] = (i, place[s])
        keys = sorted(made)
        self.keys = np.array(keys + [NONE << 32], np.int64)
        self.makes = np.array([made[k][0] for k in keys] + [-1], np.int64)
        self.ranks = np.array([made[k][1] for k in keys] + [NONE], np.int64)
        own = {i: place[s] for p, i, s in pieces if len(p) > 1}
        alone = set()
        for k in keys:
            rank = made[k][1]
            for part in (k >> 32, k & 0xFFFFFFFF):
                if own.get(part, -1) >= rank:
                    alone.add(own[part])
        self.alone = np.zeros(len(scores) + 1, bool)
        self.alone[list(alone)] = True
        self.symbol = np.full(0x110000, -1, np.int64)
        for p, i in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.size = n
        near = sorted({number[a] << 32 | number[b] for p, _, _ in pieces for a, b in zip(p, p[1:])})
        self.near = np.array(near + [NONE << 32], np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece each pair makes (-1: none) and its rank."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[(left < 0) | (right < 0)] = len(self.keys) - 1
        at[self.keys[at] != key] = len(self.keys) - 1
        return self.makes[at], self.ranks[at]

    # --- merge rounds ------------------------------------------------------------------------------
    def segments(self, codes: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Number of the run each symbol is in: words, cut where no piece holds the two characters side by side."""
        cut = np.zeros(len(codes), bool)
        key = symbols[:-1] << 32 | symbols[1:]
        known = self.near[np.searchsorted(self.near, key)] == key
        cut[1:] = ~known | (symbols[:-1] < 0) | (symbols[1:] < 0)
        cut[starts] = True
        return np.cumsum(cut)

    def merged(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that remain, and the place of the first character of each."""
        place = np.arange(len(symbols))
        settled = np.full(len(symbols), -2, np.int64)
        makes, rank = np.full(len(symbols), -1, np.int64), np.full(len(symbols), NONE, np.int64)
        same = np.flatnonzero(segment[:-1] == segment[1:])
        makes[same], rank[same] = self.look(symbols[same], symbols[same + 1])
        while len(symbols):
            first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            lowest = np.repeat(low, size)
            over = lowest == NONE
            if over.any():
                settled[place[over]] = symbols[over]
                stay = ~over
                place, symbols, segment, makes, rank, lowest = (x[stay] for x in (place, symbols, segment, makes, rank, lowest))
                live = low != NONE
                low, size = low[live], size[live]
                first = np.cumsum(size) - size
                if not len(symbols):
                    break
            single = self.alone[low]
            if (long := single & (size > ALONE)).any():
                self.by_queue(symbols, rank, makes, place, settled, first[long], size[long])
                stay = ~np.repeat(long, size)
                place, symbols, segment, makes, rank = (x[stay] for x in (place, symbols, segment, makes, rank))
                continue
            at = np.flatnonzero(rank == lowest)
            if single.any():
                group = segment[at]
                leftmost = np.append(True, group[1:] != group[:-1])
                at = at[leftmost | ~np.repeat(single, size)[at]]
            # of pairs that share a symbol every other one merges, from the left
            run = np.append(True, np.diff(at) != 1)
            begin = np.flatnonzero(run)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            symbols[at] = makes[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            place, symbols, segment, makes, rank = (x[stay] for x in (place, symbols, segment, makes, rank))
            at = at - np.arange(len(at))
            for k in (at, at[at > 0] - 1):
                both = np.minimum(k + 1, len(symbols) - 1)
                makes[k], rank[k] = self.look(symbols[k], symbols[both])
                apart = k[(segment[k] != segment[both]) | (both == k)]
                makes[apart], rank[apart] = -1, NONE
        left = np.flatnonzero(settled != -2)
        return settled[left], left

    def by_queue(self, symbols, rank, makes, place, settled, first, size) -> None:
        """Settle long runs whose pairs must merge one at a time, such as runs of blanks: lowest rank first, then leftmost."""
        for a, n in zip(first.tolist(), size.tolist()):
            own, made = symbols[a : a + n].tolist(), makes[a : a + n].tolist()
            after, before = [*range(1, n), -1], [-1, *range(n - 1)]
            queue = [(r, k, own[k], own[k + 1]) for k, r in enumerate(rank[a : a + n - 1].tolist()) if r != NONE]
            heapq.heapify(queue)
            while queue:
                _, k, left, right = heapq.heappop(queue)
                j = after[k]
                if own[k] != left or j < 0 or own[j] != right:
                    continue
                own[k], own[j] = self.pair(left, right)[0], -2
                after[k] = after[j]
                if after[k] >= 0:
                    before[after[k]] = k
                for p in (before[k], k):
                    q = after[p] if p >= 0 else -1
                    if q >= 0 and (got := self.pair(own[p], own[q]))[1] != NONE:
                        heapq.heappush(queue, (got[1], p, own[p], own[q]))
            settled[place[a : a + n]] = own

    def pair(self, left: int, right: int) -> tuple[int, int]:
        if left < 0 or right < 0:
            return -1, NONE
        at = int(np.searchsorted(self.keys, left << 32 | right))
        return (int(self.makes[at]), int(self.ranks[at])) if self.keys[at] == left << 32 | right else (-1, NONE)

    def settle(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(length) - length
        first = self.symbol[codes]
        symbols, place = self.merged(first.copy(), self.segments(codes, first, starts))
        # what is no piece is written as its bytes
        other = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        c = codes[place[other]]
        width = np.ones(len(symbols), np.int64)
        width[other] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        ends = np.cumsum(width)
        ids = np.repeat(symbols, width)
        for k in range(4):
            # byte k of the characters that have one
            has = width[other] > k
            o, code = other[has], c[has]
            shift = 6 * (width[o] - 1 - k)
            lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0])[width[o]] if k == 0 else np.full(len(o), 0x80)
            ids[ends[o] - width[o] + k] = self.bytes_at[lead | (code >> shift if k == 0 else code >> shift & 0x3F)]
        total = np.append(0, ends)
        upto = np.searchsorted(place, starts + length)
        return ids, np.diff(np.append(0, total[upto]))

    # --- texts -------------------------------------------------------------------------------------
    @staticmethod
    def marked(text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def words(self, text: str) -> list[str]:
        shown = self.marked(text) if self.plain else self.model.normalize(text)
        if not shown:
            return []
        if BLANK + BLANK in shown or "\0" in shown:
            return WORD.findall(shown)
        parts = shown.replace(BLANK, "\0" + BLANK).split("\0")
        return parts if parts[0] else parts[1:]

    def codes(self, words: list[str]) -> np.ndarray:
        """Place of each word among those kept; new ones are settled together."""
        out = list(map(self.known.get, words))
        if None in out:
            fresh = list(dict.fromkeys(w for w, c in zip(words, out) if c is None))
            if len(self.known) + len(fresh) > self.limit:
                self.forget(self.limit // 2)
                fresh = [w for w in dict.fromkeys(words) if w not in self.known]
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            for part in by_size(fresh):
                ids, sizes = self.settle(part)
                self.ids.frombytes(ids.astype(np.uint32).tobytes())
                self.ends.frombytes((np.cumsum(sizes) + self.ends[-1]).astype(np.int64).tobytes())
            out = list(map(self.known.__getitem__, words))
        return np.array(out, np.int64)

    def forget(self, keep: int) -> None:
        """Keep the words met first, which are the frequent ones."""
        self.known = dict(islice(self.known.items(), keep))
        del self.ends[len(self.known) + 1 :]
        del self.ids[self.ends[-1] :]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, with begin and end ids, and how many each text has."""
        split = [self.words(t) for t in texts]
        words = [w for s in split for w in s]
        many = np.array([len(s) for s in split], np.int64)
        codes = self.codes(words)
        ends = np.frombuffer(self.ends, np.int64)
        size, at = ends[codes + 1] - ends[codes], ends[codes]
        upto = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(many))]
        body = np.frombuffer(self.ids, np.uint32)[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        begin, end = self.ends_text
        ids = np.insert(body, np.stack([upto[:-1], upto[1:]], 1).ravel(), np.tile(np.array([begin, end], np.uint32), len(texts)))
        return ids, np.diff(upto) + 2

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The text of each run of ids, in UTF-8."""
        ids = ids.astype(np.int64)
        width = self.shown_size[ids]
        flat = self.shown[np.repeat(self.shown_at[ids] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))].tobytes()
        ends = np.append(0, np.cumsum(sizes))
        cut = np.append(0, np.cumsum(width))[ends].tolist()
        out = []
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            own = slice(int(ends[k]), int(ends[k + 1]))
            visible = np.flatnonzero(width[own][:16]) if len(width[own]) else []
            if not len(visible):
                visible = np.flatnonzero(width[own])
            # the blank put before a text is taken off again
            lead = bool(len(visible)) and bool(self.leads[ids[own][visible[0]]])
            text = flat[a + lead : b]
            # an invisible id ends a run of bytes
            if (width[own][1:-1] == 0).any():
                text = self.mended(ids[own])[lead:]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self.mended(ids[own])[lead:]
            out.append(text)
        return out

    def mended(self, ids: np.ndarray) -> bytes:
        """Decoded ids whose bytes do not all make characters: each byte left over becomes a replacement character."""
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.shown[self.shown_at[i] : self.shown_at[i] + 1].tobytes()
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        run[:n].decode()
                        out.append(run[:n])
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("�".encode())
                run = run[n:]
            if i is not None:
                out.append(self.shown[self.shown_at[i] : self.shown_at[i] + self.shown_size[i]].tobytes())
        return b"".join(out)


WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def by_size(words: list[str], most: int = 1 << 20):
    """The words in runs of about ``most`` characters."""
    part, held = [], 0
    for w in words:
        part.append(w)
        held += len(w)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The encoder of this worker process, kept between tasks."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]

"""Byte-level BPE ids and counts of whole texts, put together from cached units, with exact prefix counts.

A unit is a run of white space and the run of other characters behind it. The tokenizer's own splitting never
joins characters across the end of a unit, whatever follows, so ids and counts of a text, or of any prefix of
it, are those of its units one after the other. Most units repeat, so each is encoded once per worker.
"""

from __future__ import annotations

import os
import re
from array import array

import ahocorasick
import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space but the blank and the line feed.
OTHER_SPACE = "\t\x0b-\r\x85\xa0  -     　"
UNIT = re.compile(f"[ \n{OTHER_SPACE}]*[^ \n{OTHER_SPACE}]+|[ \n{OTHER_SPACE}]+")
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks a cached unit that is written out; others leave out the blank they begin with.
LITERAL = "\0"


def byte_alphabet() -> list[str]:
    """The stand-in of each byte in a byte-level vocabulary: itself if printable, else a character from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Units:
    """Encodes texts by units. ``limit`` bounds the number of cached units; beyond it the half that recurs most stays."""

    def __init__(self, path: str, limit: int = 1_500_000, pairs: int = 500_000):
        from tokenizers import Tokenizer

        self.pairs = pairs

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.marks = {m: self.encode(m) for m in ".,"}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])
        self.used = np.zeros(1024, np.uint32)  # texts that each cached unit was found in

    def halve(self) -> None:
        """Forget all but the units of two texts or more, and of these the rarer ones beyond half of the limit."""
        used = self.used[: len(self.known)]
        kept = np.flatnonzero(used > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(used[kept], kind="stable")[-(self.limit // 2) :]])
        names, sizes = list(self.known), self.sizes(kept)
        self.ids = array("I", self.taken(kept).tobytes())
        self.ends = array("q", np.cumsum([0, *sizes]).tobytes())
        self.known = {names[k]: n for n, k in enumerate(kept.tolist())}
        self.used = np.maximum(used[kept] // 2, 1)

    def encode(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def shown(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.alphabet)

    def unit_ids(self, unit: str) -> list[int]:
        """A blank with letters is one piece for the tokenizer, and so is a full stop or comma behind letters."""
        word = unit[1:] if unit[0] == " " else unit
        tail = word[-1:] if word[-1:] in self.marks else ""
        head = unit[: len(unit) - len(tail)]
        if LETTERS.fullmatch(word[: len(word) - len(tail)]):
            return [t.id for t in self.tok.model.tokenize(self.shown(head))] + (self.marks[tail] if tail else [])
        return self.encode(unit)

    def add(self, keys: list[str]) -> None:
        """Cache new units."""
        for key in keys:
            self.known[key] = len(self.known)
            self.ids.extend(self.unit_ids(self.unit(key)))
            self.ends.append(len(self.ids))

    @staticmethod
    def unit(key: str) -> str:
        return key[1:] if key[0] == LITERAL else key if key[0] == "\n" else " " + key

    @staticmethod
    def keys(text: str) -> list[str]:
        if not text:
            return []
        if "\0" in text or text.split() != text.replace("\n", " ").split(" "):
            return [LITERAL + u for u in UNIT.findall(text)]
        # single blanks and line feeds between words only
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = LITERAL + parts[0]
        return parts

    def codes(self, keys: list[str]) -> np.ndarray:
        """Place of each unit in the cache."""
        if len(self.known) > self.limit:
            self.halve()
        out = list(map(self.known.get, keys))
        if None in out:
            self.add(list(dict.fromkeys(k for k, code in zip(keys, out) if code is None)))
            out = list(map(self.known.get, keys))
        codes = np.array(out, np.int64)
        if len(self.known) > len(self.used):
            self.used = np.concatenate([self.used, np.zeros(len(self.known), np.uint32)])
        self.used[codes] += 1  # once a text
        return codes

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of each unit. No view of the growing array is kept."""
        ends = np.frombuffer(self.ends, np.int64)
        return ends[codes + 1] - ends[codes]

    def prefix(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the text up to the end of each unit."""
        keys = self.keys(text)
        return np.cumsum(self.chars(keys)), np.cumsum(self.sizes(self.codes(keys)))

    @staticmethod
    def chars(keys: list[str]) -> list[int]:
        return [len(k) - 1 if k[0] == LITERAL else len(k) if k[0] == "\n" else len(k) + 1 for k in keys]

    def text_ids(self, text: str) -> np.ndarray:
        return self.taken(self.codes(self.keys(text)))

    def taken(self, codes: np.ndarray) -> np.ndarray:
        """Ids of cached units, one unit after the other."""
        size, first = self.sizes(codes), np.frombuffer(self.ends, np.int64)[codes]
        total = int(size.sum())
        if not total:
            return np.zeros(0, np.uint32)
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)
        return np.frombuffer(self.ids, np.uint32)[at]

    # --- exact counts inside a unit ---------------------------------------------------------------
    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their characters are encoded together."""
        if len(self.fits) > self.pairs:
            self.fits.clear()
        name = self.tok.id_to_token
        out = self.fits[left << 32 | right] = [t.id for t in self.tok.model.tokenize(name(left) + name(right))] == [left, right]
        return out

    def piece_counts(self, piece: str) -> list[int]:
        """Token count of each prefix of a piece (in byte stand-ins), by dynamic programming.

        The last token of a prefix is the one token ending there that fits behind the last token of the
        prefix before it, so each place is settled from shorter ones without encoding anything again.
        Line feeds, which are no stand-ins, part several pieces; each begins anew behind an entry of 0.
        """
        text = "\n" + piece
        last, count, settled, fits = [-1] * len(text), [0] * len(text), -1, self.fits
        # the tokens that end at each place, the longest first
        for end, (token, size) in self.endings.iter(text):
            if end == settled:
                continue
            before = last[end - size]
            if before >= 0:
                pair = before << 32 | token
                if not (fits[pair] if pair in fits else self.fit(before, token)):
                    continue
            last[end], count[end], settled = token, count[end - size] + 1, end
        return count

    @property
    def endings(self) -> ahocorasick.Automaton:
        """Finds the tokens, as id and size, that end at each place of a text."""
        if not hasattr(self, "_endings"):
            self._endings = ahocorasick.Automaton()
            for token, n in self.tok.get_vocab(with_added_tokens=False).items():
                self._endings.add_word(token, (n, len(token)))
            self._endings.make_automaton()
        return self._endings

    def unit_counts(self, unit: str) -> list[int]:
        """Token count of each prefix of a unit, by characters; entry 0 is the empty prefix."""
        if any(s in unit for s in self.special):
            return [len(self.encode(unit[:n])) for n in range(len(unit) + 1)]
        blank = len(unit) - len(unit.lstrip(f" \n\t\x0b\x0c\r\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))))
        at = lambda text: np.cumsum([0, *(len(c.encode()) for c in text)])
        lead = [self.piece_counts(self.shown(unit[:blank]))[b] for b in at(unit[:blank])]
        out = lead + [0] * (len(unit) - blank)
        before = 0
        for piece, (start, end) in self.tok.pre_tokenizer.pre_tokenize_str(unit):
            counts = self.piece_counts(piece)
            places = at(unit[start:end])
            for n in range(start + 1, end + 1):
                if n > blank:
                    # a contraction such as 're is one piece only when whole
                    cut = unit[start] == "'" and n < end and unit[start + 1].isalpha() if end - start > 1 else False
                    out[n] = before + (len(self.encode(unit[start:n])) if cut else counts[places[n - start]])
            before += counts[-1]
        return out

    def truncate(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens.

        Every unit has a token, so a longer prefix that fits can only end inside the first unit that is too much.
        """
        chars, total = self.prefix(text)
        k = int(np.searchsorted(total, budget, "right"))
        if k == len(chars):
            return len(text)
        start, left = (int(chars[k - 1]), budget - int(total[k - 1])) if k else (0, budget)
        inside = self.unit_counts(text[start : int(chars[k])])
        return start + max(n for n, c in enumerate(inside) if c <= left)


class UnitCounts(Units):
    """Token counts of units without their ids: the dynamic program counts the new units of a text in one go, and words
    with and without a mark behind them once."""

    def __init__(self, *args, **kwargs):
        self.heads: dict[str, int] = {}
        super().__init__(*args, **kwargs)

    def add(self, keys: list[str]) -> None:
        if len(self.heads) > self.limit // 2:
            self.heads.clear()
        counts, words, owners, pieces, others = [0] * len(keys), [], [], [], []
        for n, key in enumerate(keys):
            unit = self.unit(key)
            word = unit[1:] if unit[0] == " " else unit
            tail = word[-1:] if word[-1:] in self.marks else ""
            if LETTERS.fullmatch(word[: len(word) - len(tail)]):
                head = unit[: len(unit) - len(tail)]
                counts[n] = len(self.marks[tail]) if tail else 0
                if head in self.heads:
                    counts[n] += self.heads[head]
                else:
                    words.append(head)
                    owners.append(n)
            elif any(s in unit for s in self.special):
                counts[n] = len(self.encode(unit))
            else:
                own = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(unit)]
                pieces += own
                others += [n] * len(own)
        # words have no line feed of their own
        shown = self.shown("\n".join(words)).replace(self.alphabet[10], "\n").split("\n") if words else []
        lines = shown + pieces
        at, total, whole = 0, self.piece_counts("\n".join(lines)), []
        for n, line in zip(owners + others, lines):
            at += len(line)
            counts[n] += total[at]
            whole.append(total[at])
            at += 1
        self.heads.update(zip(words, whole))
        for key, n in zip(keys, counts):
            self.known[key] = len(self.known)
            self.ends.append(self.ends[-1] + n)

    def taken(self, codes: np.ndarray) -> np.ndarray:
        return np.zeros(0, np.uint32)


_units: dict[tuple[type, str], Units] = {}


def units(path: str, kind: type = Units) -> Units:
    """The encoder (or counter) of this worker process, kept between tasks."""
    if (kind, path) not in _units:
        _units[kind, path] = kind(path)
    return _units[kind, path]

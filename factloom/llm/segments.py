"""Exact tokenizer ids at corpus speed.

The pre-tokenizers of both vocabularies never let a token cross a single space or line feed between two
non-space characters, nor the place between an ASCII letter or digit and the ASCII marks that close a
word. A text may therefore be cut there, and each distinct unit needs to be encoded once per worker; the
ids of a text are those of its units in a row. Cutting, looking units up (an open-addressing table whose
hits are verified on the units' bytes) and gathering ids work on arrays; new units are encoded many at a
time, as one text in which a mark that is a token of its own stands between them. Tests compare all this
with encoding whole texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from factloom.llm.words import mix

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space beyond ASCII, and characters that some library counts as such.
_ODD = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_BLANK = np.zeros(256, bool)  # ASCII white space and separators; 0 stands between texts
_BLANK[[0, *range(9, 14), *range(28, 33)]] = True
_WORDLY = np.zeros(256, bool)
_WORDLY[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = ~_WORDLY[33:127]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_WIDE = 16  # bytes of a unit that the table holds; longer ones are in a dict


class _Table:
    """Slots of units of up to 16 bytes: open addressing on a hash, verified on the bytes themselves."""

    def __init__(self, bits: int) -> None:
        self.mask = np.int64((1 << bits) - 1)
        self.hashes, self.slots = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = hashes.astype(np.int64) & self.mask
        slots = self.slots[at]
        other = np.flatnonzero((slots >= 0) & (self.hashes[at] != hashes))
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            slots[other] = self.slots[at[other]]
            other = other[(slots[other] >= 0) & (self.hashes[at[other]] != hashes[other])]
        return slots

    def add(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        """Enter distinct hashes that are not in the table."""
        at, left = hashes.astype(np.int64) & self.mask, np.arange(len(hashes))
        while len(left):
            own = at[left]
            free = np.flatnonzero(self.slots[own] < 0)
            winners = left[free[np.unique(own[free], return_index=True)[1]]]
            self.hashes[at[winners]], self.slots[at[winners]] = hashes[winners], slots[winners]
            left = np.setdiff1d(left, winners, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs of ``sizes`` from ``starts``, one run behind another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class SegmentEncoder:
    """Encodes lists of texts with one tokenizer file, as ``encode(text, add_special_tokens=False)`` does.

    fold: whether the tokenizer lower-cases, so that ASCII letters may be folded beforehand. capacity:
    distinct units that a worker remembers before it forgets those met once; bounds its memory.
    specials_as_text: read the strings of special tokens as ordinary text (the library's
    ``encode_special_tokens``) instead of as those tokens.
    """

    def __init__(self, tokenizer_file: str, fold: bool = False, capacity: int = 500_000, specials_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = specials_as_text
        # Texts with the beginning of a special token are cut by the library's own rules.
        self.specials = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.fold, self.capacity = fold, capacity
        # Where white space gives tokens, a line feed is the mark between units; elsewhere a bar between spaces is.
        self.between, bar = (b"\n", "\n") if (line := self._ids(["\n"])[0]) else (b" | ", "|")
        mark = line or self._ids(["|"])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.barred = ord(bar)
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _clear(self) -> None:
        self.table = _Table(max(10, (2 * self.capacity - 1).bit_length()))
        self.others: dict[str, int] = {}  # long units, and segments of odd texts
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.known = 0
        room = self.capacity + 1
        self.hash, self.low, self.high = (np.zeros(room, np.uint64) for _ in range(3))
        self.starts, self.sizes, self.uses = (np.zeros(room, kind) for kind in (np.int64, np.int32, np.int32))

    def _grow(self, n: int) -> np.ndarray:
        """``n`` new slots."""
        new = np.arange(self.known, self.known + n)
        self.known += n
        if self.known > len(self.hash):
            room = max(self.known, len(self.hash) * 5 // 4) - len(self.hash)
            for name in ("hash", "low", "high", "starts", "sizes", "uses"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(room, old.dtype)]))
        if 2 * self.known > len(self.table.slots):
            wider = _Table(int(4 * self.known - 1).bit_length())
            some = np.flatnonzero(self.table.slots >= 0)
            wider.add(self.table.hashes[some], self.table.slots[some])
            self.table = wider
        return new

    def _store(self, slots: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids) * 3 // 2) - len(self.ids), np.uint32)])
        self.ids[self.used : need] = ids
        self.starts[slots], self.sizes[slots] = starts + self.used, sizes
        self.used = need

    def _encode_alone(self, slots: np.ndarray, texts: list[str]) -> None:
        for a in range(0, len(texts), 64):
            found = self._ids(texts[a : a + 64])
            sizes = np.array([len(x) for x in found], np.int64)
            self._store(slots[a : a + 64], np.array([i for x in found for i in x], np.uint32), np.cumsum(sizes) - sizes, sizes)

    def _encode_units(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slots: np.ndarray, group: int = 128) -> None:
        """Encode units of ``buffer``, ``group`` of them as one text."""
        where = _ragged(starts, sizes)
        inside = _BLANK[buffer[where]] | (buffer[where] == self.barred)
        heads = np.cumsum(sizes) - sizes
        inside[heads] &= buffer[starts] != 32
        alone = np.logical_or.reduceat(inside, heads) if len(heads) else np.zeros(0, bool)
        if self.mark is None:
            alone[:] = True
        joint = np.flatnonzero(~alone)
        gap = len(self.between)
        own = sizes[joint]
        places = np.cumsum(own + gap) - own - gap
        out = np.zeros(int((own + gap).sum()), np.uint8)
        for k, byte in enumerate(self.between):
            out[places + own + k] = byte
        out[_ragged(places, own)] = buffer[_ragged(starts[joint], own)]
        failed = [np.flatnonzero(alone)]
        edges = np.append(places[::group], len(out))
        texts = [out[a : b - gap].tobytes().decode() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        for a in range(0, len(texts), 32):
            for k, found in enumerate(self._ids(texts[a : a + 32]), a):
                ids = np.array(found, np.uint32)
                marks = np.flatnonzero(ids == self.mark)
                part = joint[k * group : (k + 1) * group]
                if len(marks) != len(part) - 1:
                    failed.append(part)
                    continue
                first = np.append(0, marks + 1)
                self._store(slots[part], ids, first, np.append(marks, len(ids)) - first)
        left = np.concatenate(failed)
        self._encode_alone(slots[left], [buffer[a : a + n].tobytes().decode() for a, n in zip(starts[left].tolist(), sizes[left].tolist())])

    def _others(self, keys: list[str]) -> list[int]:
        """Slots of strings kept in the dict; what is new is encoded."""
        new = [k for k in dict.fromkeys(keys) if k not in self.others]
        slots = self._grow(len(new))
        self.others.update(zip(new, slots.tolist()))
        self._encode_alone(slots, new)
        return [self.others[k] for k in keys]

    def _thin(self) -> None:
        """Forget the units that were met only once; all of them, where that frees too little."""
        keep = np.flatnonzero(self.hash[: self.known].astype(bool) & (self.uses[: self.known] > 1))
        old = {name: getattr(self, name)[keep] for name in ("hash", "low", "high", "starts", "sizes")}
        ids = self.ids
        self._clear()
        if len(keep) > self.capacity // 2:
            return
        slots = self._grow(len(keep))
        self.hash[slots], self.low[slots], self.high[slots], self.uses[slots] = old["hash"], old["low"], old["high"], 1
        self.table.add(old["hash"], slots.astype(np.int32))
        self._store(slots, ids[_ragged(old["starts"], old["sizes"])], np.cumsum(old["sizes"]) - old["sizes"], old["sizes"])

    def _look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all units of texts without odd characters, and their number by text."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        buffer = np.frombuffer(b"\0" + b"\0".join(t.encode() for t in texts) + b"\0" * (_WIDE + 1), np.uint8)
        if self.fold:
            buffer = _LOWER[buffer]
        length = len(buffer) - _WIDE
        solid = ~_BLANK[buffer]
        ends = np.flatnonzero(buffer[:length] == 0)
        cut = np.zeros(length, bool)
        cut[ends] = True
        cut[ends[:-1] + 1] = True
        spaces, lines = np.flatnonzero(buffer[:length] == 32), np.flatnonzero(buffer[:length] == 10)
        cut[spaces] = solid[spaces - 1] & solid[spaces + 1]
        lines = lines[solid[lines - 1] & solid[lines + 1]]
        cut[lines] = cut[lines + 1] = True
        cut[ends[:-1] + 1] = True
        starts = np.flatnonzero(cut)
        # Words that close with a few marks: one more cut.
        marked = np.flatnonzero(_MARK[buffer[starts[1:] - 1]])
        last, least = starts[marked + 1] - 1, starts[marked]
        for _ in range(8):
            last -= _MARK[buffer[last]] & (last > least)
        cut[last[_WORDLY[buffer[last]]] + 1] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=length)
        real = buffer[starts] != 0
        upto = np.cumsum(real)[np.searchsorted(starts, ends)]
        starts, sizes = starts[real], sizes[real]

        eight = np.ndarray((len(buffer) - 7,), np.uint64, buffer=buffer, strides=(1,))
        low = eight[starts] & _KEEP[np.minimum(sizes, 8)]
        high = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(sizes > 8)
        high[more] = eight[starts[more] + 8] & _KEEP[np.minimum(sizes[more] - 8, 8)]
        hashes = mix(low + high * _SPREAD) | np.uint64(1)
        slots = self.table.find(hashes)
        wide = sizes > _WIDE
        slots[wide] = 0
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            found, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new = self._grow(len(found))
            own = missing[first]
            self.hash[new], self.low[new], self.high[new] = found, low[own], high[own]
            self.table.add(found, new.astype(np.int32))
            self._encode_units(buffer, starts[own], sizes[own], new)
            slots[missing] = new[back]
        wrong = np.flatnonzero(wide | (self.low[slots] != low) | (self.high[slots] != high))  # the latter: equal hashes
        if len(wrong):
            slots[wrong] = self._others([buffer[a : a + n].tobytes().decode() for a, n in zip(starts[wrong].tolist(), sizes[wrong].tolist())])
        return slots, np.diff(upto)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and the number of ids of each text."""
        if self.known > self.capacity or len(self.others) > self.capacity // 10:
            self._thin()
        odd = [k for k, t in enumerate(texts) if "\0" in t or not t.isascii() and _ODD.search(t) or any(s in t for s in self.specials)]
        strange = set(odd)
        slots, counts = self._look_up([t for k, t in enumerate(texts) if k not in strange])
        if odd:
            parts: list[np.ndarray] = np.split(slots, np.cumsum(counts)[:-1]) if len(counts) else []
            for k in odd:
                head, *tail = _CUT.split(texts[k])
                parts.insert(k, np.array(self._others([head, *(" " + s for s in tail)]), np.int64))
            slots, counts = np.concatenate(parts).astype(np.int64), np.array([len(p) for p in parts], np.int64)
        self.uses += np.bincount(slots, minlength=len(self.uses)).astype(np.int32)
        sizes = self.sizes[slots].astype(np.int64)
        ids = self.ids[_ragged(self.starts[slots], sizes)]
        filled, ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.cumsum(counts)
        return ids, filled[ends] - filled[ends - counts]


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, fold: bool = False) -> SegmentEncoder:
    """The worker's encoder, which the tasks it runs one after another share."""
    return SegmentEncoder(tokenizer_file, fold)


def chunks(values: list, sizes, most: int):
    """Runs of ``values`` whose sizes sum to about ``most``: (first, last) index pairs."""
    at, total = 0, 0
    for k, size in enumerate(sizes):
        total += size
        if total >= most:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(values):
        yield at, len(values)

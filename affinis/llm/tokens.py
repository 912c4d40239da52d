"""Token ids of whole texts by the `tokenizers` library.

A byte-level tokenizer first splits a text into pieces: runs of letters, digits or other characters, each with the
one space before it, and runs of white space. A text may be cut at borders of pieces that don't depend on what lies
further away, and the ids of the parts, one after the other, are the ids of the text. Parts repeat; each process
keeps the ids of those of up to 23 bytes in a hash table of arrays, whose keys are the parts' own bytes, so
that equal keys are equal parts. Texts with the spelling of a special token are encoded whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from affinis.llm.common import process_cache, release

#: Slots of the table (a power of two), which is emptied when five eighths are full; it changes speed, never ids.
SLOTS = 1 << 21
#: Bytes of text that are cut and looked up at a time, about; fewer than the slots that are free when the table isn't emptied.
SLICE = 1 << 19
#: Parts that are joined for a call of the library.
LINES = 32
#: The longest part that the table holds: three words of eight bytes, the last byte for the length.
LONGEST = 23


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# classes of bytes: what is sure from one byte alone
_OTHER, _SPACE, _BREAK, _LETTER, _DIGIT, _SIGN, _QUOTE, _LEAD = range(8)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x27] = _QUOTE  # begins 's, 't and the like
_CLASS[0x20] = _SPACE
_CLASS[0x09:0x0E] = _BREAK
_CLASS[0xC3:0xF5] = _LEAD  # first byte of a character that isn't white space; those of E1, E2, E3 may be
_CLASS[0xE1:0xE4] = _OTHER
_INK = np.array([c in (_LETTER, _DIGIT, _SIGN, _QUOTE) for c in range(8)])
#: (class before, class here): a border of pieces between two ASCII characters
_BORDER = np.zeros((8, 8), bool)
for _a in (_LETTER, _DIGIT, _SIGN, _QUOTE):
    _BORDER[_a, _BREAK] = True
    for _b in (_LETTER, _DIGIT, _SIGN, _QUOTE):
        _BORDER[_a, _b] = _a != _QUOTE and _a != _b and {_a, _b} != {_SIGN, _QUOTE}
_BORDER = _BORDER.ravel()


def borders(b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a cut may lie before each byte; first: whether a text begins there."""
    c = _CLASS[b]
    out = first.copy()
    if len(b) > 1:
        out[1:] |= _BORDER[c[:-1] * np.uint8(8) + c[1:]]
        # a space and the character after it make one piece, wherever they stand
        out[:-1] |= (c[:-1] == _SPACE) & (c[1:] > _BREAK) & ~first[1:]
    if len(b) > 2:  # a line break alone between two characters
        out[2:] |= _INK[c[:-2]] & (c[1:-1] == _BREAK) & _INK[c[2:]]
    return out


class Encoder:
    """ids(column, end) gives the ids of each text of an Arrow column, the end id last."""

    def __init__(self, path: str, slots: int | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.by_line = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.by_line.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # in the byte-level alphabet each byte is one character
            self.n_bytes[i] = len(token)
        self.line = self.whole(["\n"])[0]
        self.slots = slots or SLOTS
        self._empty()

    def _empty(self):
        #: three words of the part's bytes and length, and its place in the pool with its count; a row is a cache line's half
        self.table = np.zeros((self.slots, 4), np.uint64)
        self.row = np.zeros(self.slots, np.int32)
        self.pool, self.filled, self.held = np.zeros(1 << 20, np.uint32), 0, 0

    def whole(self, texts: list[str], by=None) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Puts the ids of parts into the pool; their places and counts. They are encoded some at a time, a line each, and
        cut by their lengths; None if the ids don't allow that. single: each part is one piece, so lines may split at their ends alone.
        """
        ends = np.cumsum(lengths + 1)
        joined = np.full(int(ends[-1]), 10, np.uint8)
        own = np.ones(len(joined), bool)
        own[ends - 1] = False
        first = ends - lengths - 1
        joined[own] = data[np.repeat(starts - (first - np.arange(len(starts))), lengths) + np.arange(int(lengths.sum()))]
        raw, cuts = joined.tobytes(), [0, *ends[LINES - 1 :: LINES].tolist()]
        if cuts[-1] < len(raw):
            cuts.append(len(raw))
        ids = np.concatenate(self.whole([raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)], self.by_line if single else None))
        at = np.cumsum(self.n_bytes[ids])
        if single:  # the ends of lines have no ids
            ends = np.cumsum(lengths)
        cut = np.minimum(np.searchsorted(at, ends), len(at) - 1)
        if (at[cut] != ends).any() or not single and (ids[cut] != self.line[0]).any():
            return None
        begin = np.concatenate(([0], cut[:-1] + 1))
        return self._keep(ids) + begin, cut - begin + single

    def _fresh(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes parts of data; their places in the pool and counts."""
        place, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        head, last = _CLASS[data[starts]], data[starts + lengths - 1]
        second = _CLASS[data[np.minimum(starts + 1, len(data) - 1)]]
        fine = np.where(head == _SPACE, (lengths > 1) & (second > _BREAK), head > _BREAK)  # begins with ink, or one space before it
        inked = _INK[_CLASS[last]]
        for k in np.flatnonzero(fine & (last >= 128)).tolist():
            inked[k] = data[starts[k] : starts[k] + lengths[k]].tobytes().decode()[-1].isalpha()
        fine &= inked
        # letters, digits or signs without quotes: cuts lie at each change among them, so there is but one piece
        strange = np.concatenate(([0], np.cumsum(~np.isin(_CLASS, (_LETTER, _DIGIT, _SIGN))[data])))
        single = fine & (strange[starts + lengths] == strange[starts + (head == _SPACE)])
        done = np.zeros(len(starts), bool)
        for some, one in ((single, True), (fine & ~single, False)):
            rows = np.flatnonzero(some)
            if len(rows) and (one or len(self.line) == 1) and (found := self._lines(data, starts[rows], lengths[rows], one)):
                place[rows], size[rows] = found
                done[rows] = True
        rest = np.flatnonzero(~done)
        if len(rest):
            ids = self.whole([data[a : a + k].tobytes().decode() for a, k in zip(starts[rest].tolist(), lengths[rest].tolist(), strict=True)])
            size[rest] = [len(x) for x in ids]
            place[rest] = self._keep(np.concatenate(ids)) + np.cumsum(size[rest]) - size[rest]
        return place, size

    def _keep(self, ids: np.ndarray) -> int:
        """Puts ids into the pool; where they begin."""
        at, self.filled = self.filled, self.filled + len(ids)
        if self.filled > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[at : self.filled] = ids
        return at

    def _look_up(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts of data, one after the other, and how many each part has."""
        if self.held > self.slots // 8 * 5 or self.filled > 4 * self.slots:
            self._empty()
        n = len(starts)
        place, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        small = np.flatnonzero(lengths <= LONGEST)
        words = np.ndarray((len(data) + 17,), "<u8", data.tobytes() + bytes(24), strides=(1,))
        s, m = starts[small], lengths[small]
        key = np.zeros((len(small), 4), np.uint64)
        key[:, 0] = words[s] & _MASKS[np.minimum(m, 8)]
        key[:, 2] = m.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(m > 8)
        key[long, 1] = words[s[long] + 8] & _MASKS[np.minimum(m[long] - 8, 8)]
        long = long[m[long] > 16]
        key[long, 2] |= words[s[long] + 16] & _MASKS[m[long] - 16]
        h = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ key[:, 2] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        slot = (h >> np.uint64(64 - (self.slots.bit_length() - 1))).astype(np.int64)
        new_slots, new_rows = [], []
        at, wanted, todo = slot, key, np.arange(len(small))
        while len(todo):
            there = self.table[at]
            free = np.flatnonzero(there[:, 2] == 0)  # a kept part has its length there
            if len(free):  # of the parts that want a slot, the last one gets it
                here, rows = at[free], todo[free]
                self.row[here] = rows
                won = self.row[here] == rows
                self.table[here[won]] = key[rows[won]]
                new_slots.append(here[won])
                new_rows.append(rows[won])
                there[free] = self.table[here]
            off = np.flatnonzero((there[:, 0] != wanted[:, 0]) | (there[:, 1] != wanted[:, 1]) | (there[:, 2] != wanted[:, 2]))
            todo = todo[off]
            at = slot[todo] = (at[off] + 1) & (self.slots - 1)
            wanted = wanted[off]
        if new_rows:
            here, rows = np.concatenate(new_slots), np.concatenate(new_rows)
            self.held += len(here)
            where, many = self._fresh(data, s[rows], m[rows])
            self.table[here, 3] = (where << 8 | many).astype(np.uint64)  # at most 23 ids
        kept = self.filled  # what longer parts put into the pool doesn't stay
        found = self.table[slot, 3].astype(np.int64)
        place[small], size[small] = found >> 8, found & 255
        large = np.flatnonzero(lengths > LONGEST)
        if len(large):
            place[large], size[large] = self._fresh(data, starts[large], lengths[large])
        ids = self.pool[np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self.filled = kept
        return ids, size

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[bounds[k] : bounds[k + 1]], one after the other, and how many each text has."""
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        at, step, done = 0, SLICE, 0
        ids, upto = [], np.zeros(len(bounds), np.int64)
        while at < len(data):
            stop = min(len(data), at + step)
            cuts = at + np.flatnonzero(borders(data[at:stop], first[at:stop]))
            cuts = cuts[cuts > at]
            if stop < len(data):  # a slice ends at the last cut that it is sure of
                cuts = cuts[cuts < stop - 1]
                if not len(cuts):
                    step *= 2
                    continue
                stop, cuts = int(cuts[-1]), cuts[:-1]
            edges = np.concatenate(([at], cuts, [stop]))
            some, n = self._look_up(data[at:stop], edges[:-1] - at, np.diff(edges))
            ids.append(some)
            a, b = np.searchsorted(bounds, (at, stop), side="right")  # bounds that this slice reaches; each ends a part
            total = np.concatenate(([done], done + np.cumsum(n)))
            upto[a:b] = total[np.searchsorted(edges[1:], bounds[a:b], side="right")]
            at, step, done = stop, SLICE, int(total[-1])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.diff(upto)

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) with the end id after each, unsigned 32-bit, and where each text's begin (one more bound last)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        data, bounds = _bytes(texts)
        plain = data.tobytes() if self.special else b""
        if not self.cuts or any(t in plain for t in self.special):
            return self._mixed(texts, end)
        return _with_end(*self._cut(data, bounds), end)

    def _mixed(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts that must be encoded whole, between runs of others."""
        found = []
        run: list[str] = []

        def flush():
            if run:
                found.append(_with_end(*self._cut(*_bytes(pa.array(run, pa.large_string()))), end))
                run.clear()

        for t in texts.to_pylist():
            if self.cuts and not any(s in t.encode() for s in self.special):
                run.append(t)
                continue
            flush()
            ids = self.whole([t])[0]
            found.append(_with_end(ids, np.array([len(ids)]), end))
        flush()
        if not found:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        sizes = np.concatenate([np.diff(bounds) for _, bounds in found])
        return np.concatenate([ids for ids, _ in found]), np.concatenate(([0], np.cumsum(sizes)))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls and where each begins (one more bound last)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    own = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return own, bounds - bounds[0]


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.empty(int(bounds[-1]), np.uint32)
    own = np.ones(len(out), bool)
    own[bounds[1:] - 1] = False
    out[own] = ids
    out[bounds[1:] - 1] = end
    return out, bounds


def binary(ids: np.ndarray, bounds: np.ndarray, kind: str = "<u4") -> pa.Array:
    """An Arrow column of each text's ids as little-endian integers."""
    data = ids.astype(kind, copy=False)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def encoder(path: str, slots: int | None = None) -> Encoder:
    """This process's encoder; its table has so many slots (a power of two), which changes speed and memory, never ids."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    release()
    cache = process_cache("encoders")
    if (path, slots) not in cache:
        cache.clear()
        cache[path, slots] = Encoder(path, slots)
        release()
    return cache[path, slots]

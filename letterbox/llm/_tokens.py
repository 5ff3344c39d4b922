"""Columns of whole texts to token ids, exactly as the tokenizers library gives them, through a piece cache.

All ids come from the library. Handed whole texts it works at two or three MB a second and core, mostly in its
normalizer and splitter. Here the bytes of a whole Arrow column are lower-cased and cut at once, in numpy, into
the pieces that its splitter makes of ASCII and of Latin-1 letters; a hash table of piece -> ids (keys are the
bytes themselves, compared in full) answers for known pieces, and unknown ones go through the library's model
together, by a tokenizer of the same vocabulary that parts its input at line ends only. A blank-separated chunk
with any other character goes to the library as it is and is kept too.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Spark runs a task a core; the library must not start threads of its own
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: pieces the cache holds before it starts anew; bounds a worker's memory, not what is encoded
CACHE = 400_000
#: bytes of unknown pieces that go through the model in one call
BLOCK = 1 << 16
#: bytes of texts that are cut at once
SLICE = 1 << 20
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
#: the class of each byte; two-byte Latin-1 letters are found apart
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b" \n\t\r")] = _BLANK
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: masks of the first n bytes of a word of eight
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: the longest piece that the tables hold
LONGEST = 24
_ENCODERS: dict[str, "Encoder"] = {}


class _Table:
    """Open addressing from ``words`` unsigned 64-bit words (the first never 0) to a run of the pool."""

    def __init__(self, words: int):
        self.words, self.n = words, 0
        self._make(1 << 12)

    def _make(self, slots: int) -> None:
        self.bits = slots.bit_length() - 1
        self.keys = [np.zeros(slots, np.uint64) for _ in range(self.words)]
        self.at, self.num = np.zeros(slots, np.int32), np.zeros(slots, np.int32)

    def _slots(self, keys: list[np.ndarray]) -> np.ndarray:
        mixed = keys[0] * _MIX[0]
        for k, mix in zip(keys[1:], _MIX[1:]):
            mixed = (mixed ^ k) * mix
        return ((mixed ^ (mixed >> np.uint64(32))) * _MIX[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The slot of each key, -1 where it is not there."""
        slot = self._slots(keys)
        out = np.full(len(slot), -1, np.int64)
        open_ = None
        while True:
            there = [t[slot] for t in self.keys]
            mine = keys if open_ is None else [k[open_] for k in keys]
            hit = there[0] == mine[0]
            for t, m in zip(there[1:], mine[1:], strict=True):
                hit &= t == m
            if open_ is None:
                np.copyto(out, slot, where=hit)
                open_ = np.flatnonzero(~hit & (there[0] != 0))
                slot = slot[open_]
            else:
                out[open_[hit]] = slot[hit]
                on = ~hit & (there[0] != 0)
                open_, slot = open_[on], slot[on]
            if not len(open_):
                return out
            slot = (slot + 1) & ((1 << self.bits) - 1)

    def add(self, keys: list[np.ndarray], at: np.ndarray, num: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.n + len(at)) > 1 << self.bits:
            full = np.flatnonzero(self.keys[0])
            old = [t[full] for t in self.keys], self.at[full], self.num[full]
            self._make(1 << (4 * (self.n + len(at))).bit_length())
            self._put(*old)
        self._put(keys, at, num)
        self.n += len(at)

    def _put(self, keys: list[np.ndarray], at: np.ndarray, num: np.ndarray) -> None:
        slot, left = self._slots(keys), np.arange(len(at))
        while len(left):
            free = self.keys[0][slot] == 0
            here, first = np.unique(slot[free], return_index=True)  # one key to a slot
            put = left[free][first]
            for t, k in zip(self.keys, keys, strict=True):
                t[here] = k[put]
            self.at[here], self.num[here] = at[put], num[put]
            on = np.ones(len(left), bool)
            on[np.flatnonzero(free)[first]] = False
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.known = _is_known_shape(spec)
        self._forget()
        if self.known:
            mark = spec["model"]["end_of_word_suffix"]
            names = {i: x for x, i in spec["model"]["vocab"].items()}
            self.ends = np.array([names.get(i, "").endswith(mark) for i in range(max(names) + 1)], bool)
            lines = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
            spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [lines, spec["pre_tokenizer"]["pretokenizers"][1]]}, "added_tokens": [], "post_processor": None}
            self.model = Tokenizer.from_str(json.dumps(spec))

    def _forget(self) -> None:
        self.short, self.long = _Table(1), _Table(LONGEST // 8)
        self.odd: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """One result for each text, in order."""
        return self.encode_column(pa.array(list(texts), pa.string()))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an Arrow array (null: empty), in order."""
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            part, edges = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            if len(part) <= SLICE:
                yield from self._encode(part, edges)
            else:  # one long text, taken apart at blanks, where ids never join
                yield b"".join(x for a, b in _stretches(part) for x in self._encode(part[a:b], np.array([0, b - a])))
            at = to

    def _library(self, text: bytes) -> np.ndarray:
        return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        if not self.known or any(x in raw for x in self.special):
            edges = offsets.tolist()
            if not self.known or len(edges) == 2:
                return [self._library(raw[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
            return [x for a, b in zip(edges, edges[1:]) for x in self._encode(data[a:b], np.array([0, b - a]))]
        if self.short.n + self.long.n + len(self.odd) > CACHE:
            self._forget()
        low, starts, ends, odd = _pieces(data, offsets)
        at, num = self._runs(low, starts, ends, odd)
        total = np.cumsum(num)
        edges = np.concatenate(([0], total))[np.searchsorted(starts, offsets)]
        shift = at - (total - num)
        ids = self.pool[np.repeat(shift, num) + np.arange(total[-1] if len(total) else 0)].tobytes()
        edges = (4 * edges).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]

    def _runs(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the place and number of its ids in the pool; unknown pieces are learnt."""
        size = ends - starts
        words = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # the eight bytes from every place on
        at, num = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        short = np.flatnonzero((size <= 8) & ~odd)
        long = np.flatnonzero((size > 8) & (size <= LONGEST) & ~odd)
        rest = np.flatnonzero((size > LONGEST) | odd)
        keyed = []
        for table, rows in ((self.short, short), (self.long, long)):
            some = starts[rows]
            keys = [words[some + 8 * k] & _MASK[np.clip(size[rows] - 8 * k, 0, 8)] for k in range(table.words)]
            keyed.append((table, rows, keys, table.find(keys)))
        raw = low.tobytes() if len(rest) or any((slot < 0).any() for *_, slot in keyed) else b""
        missing = {raw[a:b] for _, rows, _, slot in keyed for a, b in zip(starts[rows[slot < 0]].tolist(), ends[rows[slot < 0]].tolist())}
        if missing:
            self._learn(list(missing))
        for table, rows, keys, slot in keyed:
            if missing and len(new := np.flatnonzero(slot < 0)):
                slot = table.find(keys)  # learning may have moved the table
            at[rows], num[rows] = table.at[slot], table.num[slot]
        for k, a, b in zip(rest.tolist(), starts[rest].tolist(), ends[rest].tolist()):
            piece = raw[a:b]
            if (run := self.odd.get(piece)) is None:
                ids = self._library(piece)
                run = self.odd[piece] = self._keep(ids), len(ids)
            at[k], num[k] = run
        return at, num

    def _keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        begin = self.used
        self.pool[begin : begin + len(ids)] = ids
        self.used += len(ids)
        return begin

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces of at most ``LONGEST`` bytes into the tables, many to a call of the model."""
        begin, size = 0, 0
        for k, piece in enumerate(pieces, 1):
            size += len(piece)
            if size < BLOCK and k < len(pieces):
                continue
            some = pieces[begin:k]
            ids = np.array(self.model.encode_batch_fast([b"\n".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1  # only the last token of a piece ends a word
            if len(ends) != len(some):
                each = [self._library(x) for x in some]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            num = np.diff(ends, prepend=0)
            at = self._keep(ids) + ends - num
            length = np.fromiter(map(len, some), np.int64, len(some))
            keys = np.frombuffer(b"".join([x.ljust(LONGEST, b"\0") for x in some]), "<u8").reshape(-1, LONGEST // 8)
            for table, rows in ((self.short, length <= 8), (self.long, length > 8)):
                table.add([keys[rows, j] for j in range(table.words)], at[rows], num[rows])
            begin, size = k, 0


def _stretches(text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about ``SLICE`` bytes that end before a blank."""
    begin = 0
    while begin < len(text):
        end = begin + SLICE
        while end < len(text):
            blank = np.flatnonzero(_CLASS[text[end : end + SLICE]] == _BLANK)
            if len(blank):
                end += int(blank[0])
                break
            end += SLICE
        yield begin, min(end, len(text))
        begin = end


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (padded), starts and ends of the pieces of all texts, and which are odd chunks.

    Odd chunks keep their case and go to the library whole.
    """
    n = len(data)
    kind = _CLASS[data]
    low = np.zeros(n + LONGEST + 8, np.uint8)
    np.take(_LOWER, data, out=low[:n])
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    if len(lead):
        second = data[lead + 1]
        letter = (second >= 0x80) & (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[second <= 0x9E] + 1
        low[upper] += 0x20
    solid = kind != _BLANK
    cut = np.ones(n + 1, bool)  # a text or a class begins here
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n]) if n else None
    cut[:n] |= kind == _DIGIT
    cut[offsets[offsets < n]] = True
    starts = np.flatnonzero(cut[:n] & solid)
    ends = np.flatnonzero(solid & cut[1:]) + 1
    # the contractions of the splitter: an apostrophe that is a run of its own, before letters
    quote = np.flatnonzero((ends - starts == 1) & (data[starts] == 39))
    quote = quote[quote + 1 < len(starts)]
    if len(quote):
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        quote = quote[(starts[quote + 1] == ends[quote]) & (kind[ends[quote]] == _LETTER) & ~fresh[ends[quote]]]
        a, b = low[ends[quote]], low[ends[quote] + 1]
        one = np.isin(a, list(b"stmd"))
        two = (ends[quote + 1] - starts[quote + 1] >= 2) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        more = np.where(one, 1, np.where(two, 2, 0))
        ends[quote] += more
        starts[quote + 1] += more
        full = ends > starts
        starts, ends = starts[full], ends[full]
    odd = np.zeros(len(starts), bool)
    other = np.flatnonzero(kind == _OTHER)
    if len(other):
        edge = np.ones(n + 1, bool)
        edge[1:n] = ~solid[:-1]
        edge[offsets] = True
        first = np.flatnonzero(edge[:n] & solid)
        edge[:n] |= ~solid
        last = np.flatnonzero(solid & edge[1:]) + 1
        chunk = np.unique(np.searchsorted(first, other, side="right") - 1)
        mark = np.zeros(n + 1, np.int8)
        mark[first[chunk]] += 1
        np.subtract.at(mark, last[chunk], 1)
        inside = np.cumsum(mark[:n]).astype(bool)
        low[:n][inside] = data[inside]
        stay = ~inside[starts]
        starts, ends = np.concatenate([starts[stay], first[chunk]]), np.concatenate([ends[stay], last[chunk]])
        odd = np.concatenate([np.zeros(int(stay.sum()), bool), np.ones(len(chunk), bool)])
        order = np.argsort(starts, kind="stable")
        starts, ends, odd = starts[order], ends[order], odd[order]
    return low, starts, ends, odd


def _is_known_shape(spec: dict) -> bool:
    """Whether the pipeline is the one that ``_pieces`` restates; any other takes the library's path."""
    norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        norm == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        and cut[0]["pattern"] == {"Regex": _PATTERN}
        and spec["model"]["type"] == "BPE"
        and bool(spec["model"].get("end_of_word_suffix"))
    )


def encoder(path: str) -> Encoder:
    """The worker's own encoder for this vocabulary; Python workers are reused between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

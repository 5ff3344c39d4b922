"""Secret scan with a recursive decoding worklist.

A text is scanned as it is; its encoded parts (URL escapes, Unicode escapes and entities, base64, compressed data
in base64 or in URL escapes) are unwrapped into new layers, each scanned and unwrapped in turn until nothing new
comes out. A layer maps runs of its characters to places in the layer it came from, so that a find in any depth is
reported where it stands in the text. A layer that equals one met before at the same places is not entered again,
which ends cycles; the same text at another place is.

Escapes of escapes (``%2525..41``) are read to their end at once. Deflate data without a frame is tried where a run
of base64 begins, all else also behind separators in it. A base64 run of under 16 characters decodes to
fewer bytes than any find has. Compressed data is opened in blocks that end where no find and no encoded part can
go on, so its size is not limited and memory is; only a stretch of ``LONGEST`` characters without any such place
is parted there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.entities import html5
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterbox.llm._common import slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
#: a run of 32 is the run of one or more of which shorter ones are dropped
_HEX = re.compile("[0-9a-f]{32,}")
_HINTS = ("passw", "secret", "token", "api")
#: %25 before two digits is an escaped escape
_ESCAPED_URL = re.compile("(?:%(?:25)*[0-9A-Fa-f]{2})+")
_ONE_URL = re.compile("%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPED_UNICODE = re.compile(r"(?:\\(?:u005[cC]|x5[cC])*(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}))+")
_ONE_UNICODE = re.compile(r"\\(?:u005[cC]|x5[cC])*(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8}))")
_ENTITIES = re.compile(r"(?:&(?:(?:amp|#0*38|#[xX]0*26);)*(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)+")
_ONE_ENTITY = re.compile(r"&(?:(?:amp|#0*38|#[xX]0*26);)*(?:#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]{1,31}));")
_BASE64 = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")
_NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_SEPARATOR = re.compile("[/_+-]")
_PACKED_URL = re.compile("%1[fF]%8[bB](?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()-])+")
#: what no find, escape or base64 run, wrapped ones included, reaches across
_APART = re.compile(r"""[^A-Za-z0-9+/_.=\-"'\x20:%\\{}&#;\r\n\t]""")
#: characters of opened data that are looked at together, and the longest stretch that is held for want of a parting
BLOCK, LONGEST = 1 << 22, 1 << 28


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the finds in one layer."""
    out = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(x in low for x in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


Decoded = list[tuple[str, int, int]]


def _url(match: re.Match) -> Decoded:
    """Characters with their places in the run; bytes that are no UTF-8 each stand for themselves."""
    units = [(m.start(), m.end()) for m in _ONE_URL.finditer(match[0])]
    data = bytes(int(match[0][b - 2 : b], 16) for _, b in units)
    out, k = [], 0
    while k < len(data):
        n = 1 if data[k] < 0xC0 else 2 if data[k] < 0xE0 else 3 if data[k] < 0xF0 else 4
        try:
            char = data[k : k + n].decode()
        except UnicodeDecodeError:
            char, n = "\ufffd", 1
        out.append((char, units[k][0], units[k + n - 1][1]))
        k += n
    return out


def _char(code: int) -> str:
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\ufffd"


def _unicode(match: re.Match) -> Decoded:
    out = []
    units = [(m.start(), m.end(), int(next(filter(None, m.groups())), 16)) for m in _ONE_UNICODE.finditer(match[0])]
    k = 0
    while k < len(units):
        a, b, code = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][2] < 0xE000:
            code, b, k = 0x10000 + (code - 0xD800 << 10) + units[k + 1][2] - 0xDC00, units[k + 1][1], k + 1
        out.append((_char(code), a, b))
        k += 1
    return out


def _entities(match: re.Match) -> Decoded:
    out = []
    for m in _ONE_ENTITY.finditer(match[0]):
        text = html5.get(f"{m[3]};", m[0]) if m[3] else _char(int(m[1]) if m[1] else int(m[2], 16))
        out.append((text, m.start(), m.end()))
    return out


class Layer:
    """A decoded text and where its characters stand in the text it came from.

    Segment k begins at character ``starts[k]``. With ``width[k]`` > 0 its characters lie side by side from
    ``begin[k]`` on, each that wide; with a negative width all of them stand for the same -width characters.
    """

    def __init__(self, text: str, parent: Layer | None, starts: list[int], begin: list[int], width: list[int]):
        self.text, self.parent, self.starts, self.begin, self.width = text, parent, starts, begin, width

    @classmethod
    def whole(cls, text: str) -> Layer:
        return cls(text, None, [0], [0], [1])

    def inside(self, text: str, start: int, end: int) -> Layer:
        """A text that the characters from start to end stand for as a whole."""
        return Layer(text, self, [0], [start], [start - end])

    def _up(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.starts, i) - 1
        a, w = self.begin[k], self.width[k]
        return (a, a - w) if w < 0 else (a + (i - self.starts[k]) * w, a + (i - self.starts[k] + 1) * w)

    def place(self, start: int, end: int) -> tuple[int, int]:
        """Where the characters from start to end stand in the original text."""
        layer: Layer | None = self
        while layer is not None:
            start, end = layer._up(start)[0], layer._up(end - 1)[1]
            layer = layer.parent
        return start, end

    def key(self) -> bytes:
        """The same for two layers exactly when text and places agree."""
        ends = [*self.starts[1:], len(self.text)]
        places = [(s, *self.place(s, s + 1), *self.place(e - 1, e)) for s, e in zip(self.starts, ends, strict=True)]
        head = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"))
        head.update(np.array(places, np.int64).tobytes())
        return head.digest()

    def unescape(self, pattern: re.Pattern, decode: Callable[[re.Match], Decoded]) -> Layer | None:
        """The text with all its escapes read; None where there is none."""
        parts: list[str] = []
        starts, begin, width = [], [], []
        n = at = 0

        def put(text: str, a: int, w: int) -> None:
            nonlocal n
            if not (width and w > 0 and width[-1] == w and begin[-1] + (n - starts[-1]) * w == a):
                starts.append(n)
                begin.append(a)
                width.append(w)
            parts.append(text)
            n += len(text)

        for m in pattern.finditer(self.text):
            if m.start() > at:
                put(self.text[at : m.start()], at, 1)
            for char, a, b in decode(m):
                put(char, m.start() + a, b - a if len(char) == 1 else a - b)
            at = m.end()
        if not at:
            return None
        if at < len(self.text):
            put(self.text[at:], at, 1)
        text = "".join(parts)
        return None if text == self.text else Layer(text, self, starts, begin, width)


def _stream(data: bytes) -> io.BufferedIOBase | None:
    """A reader of compressed data by its first bytes; None where they show none."""
    if data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 0x8F == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return _Inflate(data, 47)
    if data[:3] == b"BZh" and data[4:10] == b"1AY&SY":
        return bz2.open(io.BytesIO(data))
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.open(io.BytesIO(data))
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    return None


class _Inflate(io.RawIOBase):
    """Deflate data of any frame, members one after another."""

    def __init__(self, data: bytes, wbits: int):
        self.data, self.wbits, self.engine = data, wbits, zlib.decompressobj(wbits)

    def read(self, size: int = -1) -> bytes:
        while True:
            out = self.engine.decompress(self.data, size)
            self.data = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
            if out:
                return out
            if self.engine.eof:
                if self.data[:2] != b"\x1f\x8b":
                    return b""
                self.engine = zlib.decompressobj(self.wbits)
            elif not self.data:
                return b""


_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def _blocks(stream: io.BufferedIOBase) -> Iterator[str]:
    """Opened data as texts that end where nothing goes on; what comes before damage is kept."""
    read, held, sound = codecs.getincrementaldecoder("utf-8")("replace"), "", True
    while sound:
        try:
            data = stream.read(BLOCK)
            sound = bool(data)
        except _BROKEN:
            data, sound = b"", False
        held += read.decode(data, not sound)
        while len(held) >= BLOCK and sound:
            cut = next((m.end() for m in _APART.finditer(held, BLOCK // 2)), len(held) if len(held) >= LONGEST else 0)
            if not cut:
                break
            yield held[:cut]
            held = held[cut:]
    if held:
        yield held


def _deflated(data: bytes) -> str | None:
    """Deflate data without a frame shows itself only by ending where the data ends, in readable text."""
    engine = zlib.decompressobj(-15)
    try:
        out = engine.decompress(data, BLOCK)
        if engine.eof and not engine.unused_data and len(out) >= 12:
            return out.decode()
    except (zlib.error, UnicodeDecodeError):
        pass
    return None


def _texts(data: bytes) -> Iterator[str]:
    """What bytes hold: UTF-8 or UTF-16 text, opened compressed data, or deflate data without a frame."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = ""
    if text:
        yield text
    opened = False
    if (stream := _stream(data)) is not None:
        for block in _blocks(stream):
            opened = True
            yield block
    if len(data) >= 8 and len(data) % 2 == 0 and (not any(data[1:64:2]) or data[:2] in (b"\xff\xfe", b"\xfe\xff")):
        yield data.decode("utf-16" if data[0] >= 0xFE else "utf-16-le", "replace")
    elif not text and not opened:
        if (text := _deflated(data)) is not None:
            yield text
        elif (stream := _long_deflated(data)) is not None:
            yield from _blocks(stream)


def _long_deflated(data: bytes) -> io.BufferedIOBase | None:
    """The same for results beyond a block: their beginning must be readable text."""
    try:
        out = zlib.decompressobj(-15).decompress(data, BLOCK)
        codecs.getincrementaldecoder("utf-8")().decode(out)
    except (zlib.error, UnicodeDecodeError):
        return None
    return _Inflate(data, -15) if len(out) == BLOCK else None


def _from_base64(raw: str) -> list[str] | Iterator[str]:
    """The texts a run holds, none where it is no base64 of any."""
    body = raw.rstrip("=")
    if len(body) % 4 == 1:
        return []
    try:
        data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return []
    return _texts(data)


_ESCAPES = (("%", _ESCAPED_URL, _url), ("\\", _ESCAPED_UNICODE, _unicode), ("&", _ENTITIES, _entities))


def _unwrap(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    for mark, pattern, decode in _ESCAPES:
        if mark in text and pattern.search(text) and (inner := layer.unescape(pattern, decode)) is not None:
            yield inner
    if "%1" in text:
        for m in _PACKED_URL.finditer(text):
            if (stream := _stream(unquote_to_bytes(m[0]))) is not None:
                for inner in _blocks(stream):
                    yield layer.inside(inner, m.start(), m.end())
    done = 0
    for m in _BASE64.finditer(text):
        if m.start() < done:
            continue
        for end, raw in _wrapped(text, m):
            found = False
            for inner in _from_base64(raw):
                yield layer.inside(inner, m.start(), end)
                found = True
            if found:
                done = end
                break
        else:
            for at, inner in _parts(m[0]):
                yield layer.inside(inner, m.start() + at, m.end())


def _wrapped(text: str, first: re.Match) -> Iterator[tuple[int, str]]:
    """(end, characters) of base64 that goes on over lines as long as the first, the longest reading first."""
    raw, at, reads = first[0], first.end(), []
    parts, width = [raw], len(raw)
    while not parts[-1].endswith("=") and len(parts[-1]) == width and (m := _NEXT_LINE.match(text, at)) and len(m[1]) <= width:
        parts.append(m[1])
        at = m.end()
        reads.append(at)
    if reads:
        yield reads[-1], "".join(parts)
        if len(reads) > 1:  # the last line may be a word of the text after it
            yield reads[-2], "".join(parts[:-1])


def _parts(run: str) -> Iterator[tuple[int, str]]:
    """(place, decoded text) of a run, and of what follows a separator where the run before it is misaligned."""
    met = []
    for at in (0, *(m.end() for m in _SEPARATOR.finditer(run))):
        if len(run) - at < 16 or any((at - x) % 4 == 0 for x in met) or at and not _promising(run[at : at + 16]):
            continue
        for inner in _from_base64(run[at:]):
            if at not in met:
                met.append(at)
            yield at, inner
            if at == 0 and inner.isprintable():
                return


def _promising(head: str) -> bool:
    """Whether what 16 characters of base64 decode to may begin a text or framed compressed data."""
    data = base64.b64decode(head[: len(head.rstrip("=")) // 4 * 4].replace("-", "+").replace("_", "/"))
    if _stream(data) is not None or not any(data[1::2]):
        return True
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data)
    except UnicodeDecodeError:
        return False
    return True


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Finds of the text itself, and those of all layers, each sorted by start, kind and end."""
    base = sorted(scan(text))
    found, seen = set(base), set()
    # depth first: only the layers between the text and the one at hand are held
    work = [_unwrap(Layer.whole(text))]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        elif (key := inner.key()) not in seen:
            seen.add(key)
            for start, kind, end in scan(inner.text):
                a, b = inner.place(start, end)
                found.add((a, kind, b))
            work.append(_unwrap(inner))
    return base, sorted(found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id with ``base`` and ``spans``: arrays of (kind, start, end), code points, end exclusive.

    ``base`` has what the patterns find in the text as it is, ``spans`` also what decoding adds. Null texts
    are empty. Every row is scanned alone and whole; repeated rows give repeated results.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [find(x or "") for x in batch.column(1).to_pylist()]
            cols = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x[i]] for x in both], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")

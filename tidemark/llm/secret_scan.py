"""Secrets in texts and in what is encoded inside them, by a recursive decoding worklist.

A text is the first layer. Each layer is scanned for secrets, then unwrapped: URL and
Unicode escapes are replaced in place, base64 runs and compressed data give layers of their
own, which are read byte by byte where they are not UTF-8, so compressed data inside them
is unpacked in its turn: gzip and zlib with any header, bzip2 and xz anywhere, bare deflate as the whole of a base64
run. New layers join the worklist until none is left; a layer seen before (same content, same place) is not
taken up again, so cycles end. Every character of a layer carries the range of source characters it came
from, which maps a find in any layer back.

What unpacks to more than PIECE bytes is a stream that can be read again, and is read in pieces that overlap. What is
encoded inside it and goes on beyond a piece is a stream again, decoded from where it begins to where it
ends, so no run is cut, and memory holds a few pieces for each step down. All of it has the place of the packed data.

A null text is empty and has no spans. Spans of the source layer follow the stated
patterns exactly; deeper layers only add spans. Equal spans count once, ties in start are in order of kind, then end.
Null ids, repeated rows and columns of any name pass as they are; an empty table gives no rows. Very long
texts are scanned whole. Rows are independent: no shuffle, and memory is bounded by a text and a chain of
layers, none longer than that or two pieces.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblock import column_bytes, release, slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
def _packed_heads() -> str:
    """How packed data may begin, as characters: zlib's two bytes for deflate are a multiple of 31, without a dictionary."""
    second = lambda first: [f for f in range(256) if (first << 8 | f) % 31 == 0 and not f & 32]
    zlibs = [f"{re.escape(chr(first))}[{''.join(re.escape(chr(f)) for f in second(first))}]" for first in range(8, 128, 16)]
    return "|".join(["\x1f\x8b\x08", "BZh[1-9]", "\xfd7zXZ\x00", *zlibs])


_PACKED = re.compile(_packed_heads(), re.DOTALL)
_PACKED_BYTES = re.compile(_packed_heads().encode("latin-1"), re.DOTALL)
_BYTES = re.compile("[\x00-\xff]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs on lines that follow each other.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)+")
_LINE, _BREAK = re.compile(r"[^\r\n]+"), re.compile(r"\r?\n")
_NOT_IN_RUN = re.compile(rb"[^A-Za-z0-9+/_\r\n-]")
_ESCAPED = re.compile(rb"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: Bytes of unpacked data that are a layer of their own, those that two neighbours share, and those unpacked at once.
PIECE, OVERLAP, STEP = 8 << 20, 1 << 20, 1 << 18
#: Bytes that an escape has at most.
ESCAPE = 12
#: A stream of bytes that can be read from its start again.
Opened = Callable[[], Iterator[bytes]]


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets in one layer, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """Text, and for each of its characters the source range it came from."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self._start, self._end = text, start, end
        #: Of a piece: the stream, the piece's place in it, whether it is the last one, and the stream's digest.
        self.stream: tuple[Opened, int, bool, bytes] | None = None

    def span(self, s: int, e: int) -> tuple[int, int]:
        return (s, e) if self._start is None else (int(self._start[s]), int(self._end[e - 1]))

    def replaced(self, parts: list[tuple[int, int, str, list[int]]]) -> Layer:
        """A layer with [s, e) replaced by new text; its characters end at the given offsets from s."""
        start = np.arange(len(self.text)) if self._start is None else self._start
        end = np.arange(1, len(self.text) + 1) if self._end is None else self._end
        text, starts, ends, at = [], [], [], 0
        for s, e, new, offs in parts:
            text += [self.text[at:s], new]
            first = np.array([s, *[s + o for o in offs[:-1]]], np.int64)
            last = np.array([s + o - 1 for o in offs], np.int64)
            starts += [start[at:s], start[first[: len(new)]]]
            ends += [end[at:s], end[last]]
            at = e
        text.append(self.text[at:])
        return Layer("".join(text), np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]]))

    def inner(self, place: np.ndarray, new: str, sizes: list[int] | None) -> Layer:
        """A layer for text decoded from the characters at place; sizes: base64, the bytes of each
        character, which has its own digits."""
        n, most = len(new), len(place) - 1
        if sizes is None:  # all of it has one range
            s, e = self.span(int(place[0]), int(place[-1]) + 1)
            return Layer(new, np.broadcast_to(s, n), np.broadcast_to(e, n))
        at = np.cumsum([0, *sizes])
        lo, hi = place[np.minimum(at[:-1] * 4 // 3, most)], place[np.minimum(-(-at[1:] * 4 // 3) - 1, most)]
        if self._start is None:
            return Layer(new, lo, hi + 1)
        return Layer(new, self._start[lo], self._end[hi])


def _texts(data: bytes) -> Iterator[tuple[str, list[int]]]:
    """(text, bytes of each character) for each way to read data; what is not UTF-8 is read byte by byte."""
    try:
        text = data.decode()
        yield text, [len(c.encode()) for c in text]
        plain = text.isascii()
    except UnicodeDecodeError:
        plain = False
    if not plain:
        yield data.decode("latin-1"), [1] * len(data)
    if b"\0" in data:
        for code in ("utf-16-le", "utf-16-be"):
            text = data.decode(code, "replace")
            yield text, [4 if c > "\uffff" else 2 for c in text]


class _Unpack:
    """What packed data at the start of chunks holds, over all its members; `used` counts the bytes it took, and
    `short` says that the chunks ended before it did."""

    def __init__(self, chunks: Iterator[bytes], bare: bool = False):
        self.chunks, self.bare, self.left, self.taken, self.short = chunks, bare, b"", 0, False

    @property
    def used(self) -> int:
        return self.taken - len(self.left)

    def _more(self) -> bool:
        new = next(self.chunks, None)
        if new is None:
            return False
        self.left, self.taken = self.left + new, self.taken + len(new)
        return True

    def _tool(self):
        if self.bare:
            return zlib.decompressobj(-15)
        while len(self.left) < 6 and self._more():
            pass
        if not _PACKED_BYTES.match(self.left):
            return None
        return bz2.BZ2Decompressor() if self.left[:1] == b"B" else lzma.LZMADecompressor() if self.left[:1] == b"\xfd" else zlib.decompressobj(47)

    def __iter__(self) -> Iterator[bytes]:
        while tool := self._tool():
            zipped = not hasattr(tool, "needs_input")
            try:
                while not tool.eof:
                    before = len(self.left)
                    new = tool.decompress(self.left, STEP)
                    self.left = tool.unused_data if tool.eof else tool.unconsumed_tail if zipped else b""
                    if new:
                        yield new
                    elif not tool.eof and (len(self.left) == before or not self.left) and (zipped or tool.needs_input) and not self._more():
                        self.short = True
                        return
            except (zlib.error, lzma.LZMAError, OSError):
                return
            if self.bare:
                return


def _from(stream: Opened, at: int) -> Iterator[bytes]:
    """A stream's chunks from a place on."""
    for chunk in stream():
        if at < len(chunk):
            yield chunk[at:]
        at = max(0, at - len(chunk))


def _latin(text: str, at: int) -> Iterator[bytes]:
    """The bytes that a text's characters from a place on are, to the first that is none; a few at first."""
    end, step = len(text), 1 << 8
    while at < end:
        part = _BYTES.match(text, at, min(end, at + step))[0]
        if part:
            yield part.encode("latin-1")
        if len(part) < min(step, end - at):
            return
        at, step = at + len(part), STEP


def _pieces(stream: Opened) -> Iterator[tuple[bytes, int, bool]]:
    """(bytes, their place, whether they are the last) of pieces that overlap."""
    held, at = b"", 0
    for chunk in stream():
        held += chunk
        while len(held) > PIECE + OVERLAP:
            yield held[:PIECE], at, False
            held, at = held[PIECE - OVERLAP :], at + PIECE - OVERLAP
    yield held, at, True


def _unescaped(stream: Opened) -> Opened:
    """A stream with its escapes replaced by the bytes they are."""

    def byte(m: re.Match) -> bytes:
        if m[1] or m[3]:
            return bytes.fromhex((m[1] or m[3]).decode())
        code = int(m[2] or m[5], 16) if m[4] is None else int(m[4])
        return (chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "�").encode()

    def run() -> Iterator[bytes]:
        held = b""
        for chunk in stream():
            held += chunk
            begun = re.search(rb"[%\\&]", held[-ESCAPE:])
            cut = len(held) - min(ESCAPE, len(held)) + begun.start() if begun else len(held)
            yield _ESCAPED.sub(byte, held[:cut])
            held = held[cut:]
        yield _ESCAPED.sub(byte, held)

    return run


def _decoded(stream: Opened, at: int, skip: int) -> Opened:
    """What the base64 digits of a stream from a place on hold, over line breaks, without the first `skip` digits."""

    def run() -> Iterator[bytes]:
        held, left = b"", skip
        for chunk in _from(stream, at):
            end = _NOT_IN_RUN.search(chunk)
            part = chunk[: end.start() if end else len(chunk)].translate(bytes.maketrans(b"-_", b"+/"), b"\r\n")
            held, left = held + part[left:], max(0, left - len(part))
            whole = len(held) - len(held) % 4
            yield base64.b64decode(held[:whole])
            held = held[whole:]
            if end:
                break
        if len(held) > 1:
            yield base64.b64decode(held + b"=" * (-len(held) % 4))

    return run


def _streamed(layer: Layer, start: int, end: int, stream: Opened) -> Iterator[Layer]:
    """The layers of a stream that stands at [start, end) of a layer: its pieces byte by byte, and, where it has
    escapes or zeros, the streams without them."""
    escaped, zeros, digest = False, False, hashlib.sha256()
    for chunk in stream():
        digest.update(chunk)
    for data, at, last in _pieces(stream):
        escaped, zeros = escaped or _ESCAPED.search(data) is not None, zeros or b"\0" in data
        piece = layer.inner(np.array([start, end - 1]), data.decode("latin-1"), None)
        piece.stream = stream, at, last, digest.digest()
        yield piece
    if zeros:
        yield from _streamed(layer, start, end, lambda: (c.replace(b"\0", b"") for c in stream()))
    if escaped:
        yield from _streamed(layer, start, end, _unescaped(stream))


def _opened(layer: Layer, start: int, open_packed: Callable[[], _Unpack]) -> tuple[Iterator[Layer], _Unpack]:
    """(the layers of packed data that stands at start of a layer, the reader that has read it all)."""
    reader, held, size = open_packed(), [], 0
    for part in reader:
        size += len(part)
        held = [*held, part] if size <= PIECE else []
    if reader.bare and (reader.short or reader.left):
        size = 0  # any bytes begin like deflate, but few end like it
    place = np.array([start, max(start, min(start + reader.used, len(layer.text)) - 1)])
    if size > PIECE:
        return _streamed(layer, start, int(place[1]) + 1, lambda: iter(open_packed())), reader
    return (layer.inner(place, new, None) for new, _ in (_texts(b"".join(held)) if size else ())), reader


def _from_percent(run: str) -> tuple[str, list[int]]:
    data = bytes.fromhex(run.replace("%", ""))
    try:
        text = data.decode()
        sizes = [len(c.encode()) for c in text]
    except UnicodeDecodeError:
        text, sizes = data.decode("latin-1"), [1] * len(data)
    return text, (np.cumsum(sizes) * 3).tolist()


def _bytewise(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("latin-1")


def _from_escape(m: re.Match) -> str:
    code = int(m[1] or m[2] or m[4], 16) if m[3] is None else int(m[3])
    return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "�"


def _from_base64(layer: Layer, run: str, place: np.ndarray) -> Iterator[Layer]:
    """The layers of a run of base64 digits, which stand at place; what it holds may begin at any of them,
    so each of the four alignments is read."""
    run = run.replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = run[skip:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        own = place[skip : skip + len(part)]
        for new, sizes in _texts(data):
            yield layer.inner(own, new, sizes)
        if len(own):
            for inner in _opened(Layer(run), 0, lambda data=data: _Unpack(iter([data]), bare=True))[0]:
                s, e = layer.span(int(own[0]), int(own[-1]) + 1)
                inner._start, inner._end = np.broadcast_to(s, len(inner.text)), np.broadcast_to(e, len(inner.text))
                yield inner


def _in_piece(layer: Layer) -> Iterator[Layer]:
    """The layers one step below a piece of a stream. What may go on in the next piece is left to that if it begins
    in what both share; else it is a stream from there on."""
    text, (stream, at, last, _) = layer.text, layer.stream
    size = len(text)
    shared = size if last else size - OVERLAP
    done = 0
    for m in _PACKED.finditer(text):
        start = m.start()
        if start < done:
            continue
        inner, reader = _opened(layer, start, lambda start=start: _Unpack(_latin(text, start)))
        if last or not reader.short:
            done = start + reader.used if reader.used else start
            yield from inner
        elif start < shared:
            done = size
            yield from _streamed(layer, 0, size, lambda start=start: iter(_Unpack(_from(stream, at + start))))
    for m in (*_BASE64.finditer(text), *_WRAPPED.finditer(text)):
        if m.end() == size and not last:
            if m.start() < shared:
                for skip in range(4):
                    yield from _streamed(layer, 0, size, _decoded(stream, at + m.start(), skip))
        else:
            place = np.arange(m.start(), m.end())[[c not in "\r\n=" for c in m[0]]]
            yield from _from_base64(layer, re.sub("[\r\n=]", "", m[0]), place)


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers one step below."""
    if layer.stream:
        yield from _in_piece(layer)
        return
    text = layer.text
    parts = []
    if "%" in text:
        parts += [(m.start(), m.end(), *_from_percent(m[0])) for m in _PERCENT.finditer(text)]
    if "\\" in text or "&#" in text:
        parts += [(m.start(), m.end(), _from_escape(m), [m.end() - m.start()]) for m in _ESCAPE.finditer(text)]
    if parts:
        yield layer.replaced(sorted(parts))
    if "%" in text and _PACKED.search(_PERCENT.sub(_bytewise, text)):
        # packed bytes may look like UTF-8 in part
        yield layer.replaced([(m.start(), m.end(), _bytewise(m), list(range(3, m.end() - m.start() + 1, 3))) for m in _PERCENT.finditer(text)])
    done = 0
    for m in _PACKED.finditer(text):
        start = m.start()
        if start >= done:
            inner, reader = _opened(layer, start, lambda start=start: _Unpack(_latin(text, start)))
            found = next(inner, None)
            if found is not None:
                done = start + reader.used
                yield found
                yield from inner
    for m in _BASE64.finditer(text):
        run = m[0].rstrip("=")
        yield from _from_base64(layer, run, np.arange(m.start(), m.start() + len(run)))
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            place = np.array([p for line in _LINE.finditer(text, m.start(), m.end()) for p in range(line.start(), line.end())])
            yield from _from_base64(layer, _BREAK.sub("", m[0]), place)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the text itself, spans of all layers), by start, then kind as listed, then end."""
    base = find(text)
    mark = lambda layer: (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.span(0, 1)[0] if layer.text else 0, layer.stream[1:] if layer.stream else None)
    whole = Layer(text)
    # depth first, and layers as they are asked for, so only those of one chain are held
    spans, todo, seen = set(base), [unwrapped(whole)], {mark(whole)}
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        key = mark(layer)
        if key not in seen:
            seen.add(key)
            spans |= {(k, *layer.span(s, e)) for k, s, e in find(layer.text)}
            todo.append(unwrapped(layer))
    rank = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=rank), sorted(spans, key=rank)


def written_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with spans, joined where they overlap, replaced by a mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans[, redacted]) for each document."""
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", *["redacted"] * redact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = column_bytes(batch.column(1))
            for a, b in slices(offs):
                rows = []
                for t in batch.column(1).slice(a, b - a).to_pylist():
                    base, every = scan(t or "")
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    rows.append((*counts, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(every), *[redacted(t or "", every)] * redact))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string()] * (2 + redact)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * redact
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text_col, encoded ones too, replaced by a mark; null texts stay null."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column(place)
            for a, b in slices(column_bytes(texts)[1]):
                new = [t and redacted(t, scan(t)[1], mark) for t in texts.slice(a, b - a).to_pylist()]
                cols = [c.slice(a, b - a) for c in batch.columns]
                cols[place] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

"""Secret scans that look through URL, Unicode, base64 and compressed layers."""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import doc_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_SAFE_TO_STANDARD = str.maketrans("-_", "+/")
#: Lines of base64 under one another.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{16,}+)*\r?\n[ \t]*[A-Za-z0-9+/_-]++={0,2}")
#: Where compressed bytes may start in base64: a gzip header anywhere, a zlib header at a start or after a separator.
_PACKED = re.compile(r"H4sI|(?<![A-Za-z0-9])[CGKOSWae][A-Za-z0-9+/_-]")
#: A percent-encoded gzip or zlib stream; what needs no escape may stand as it is.
_URL_PACKED = re.compile(r"(?:%1[Ff]%8[Bb]|(?:x|%78)(?:%01|%5[Ee]|\^|%9[Cc]|%[Dd][Aa]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+^-])*")
#: No run of base64, of a value or of an escape goes over such a byte.
_BREAK = re.compile(rb"[^A-Za-z0-9+/_=.%\\&#;{}\s-]")
#: Decompressed text is scanned in blocks of so many bytes or more, which overlap by OVERLAP or more and hold whole runs.
BLOCK, OVERLAP = 8 << 20, 1 << 16
#: Streams in streams that are read through one another.
STREAMS = 32

_ROW = "doc_id long, secrets array<struct<kind: string, start: long, end: long, layers: string, value: string>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in one layer: leftmost non-overlapping matches of each kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


class _Layer:
    """Decoded text; a[i] and b[i] are the span of the document that its character i came from. ``whole``: the one span of all characters."""

    __slots__ = ("text", "a", "b", "path", "whole")

    def __init__(self, text: str, a: np.ndarray | None, b: np.ndarray | None, path: str, whole: tuple[int, int] | None = None):
        self.text, self.a, self.b, self.path, self.whole = text, a, b, path, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.whole or ((start, end) if self.a is None else (int(self.a[start:end].min()), int(self.b[start:end].max())))

    def part(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(start, end), np.arange(start + 1, end + 1)) if self.a is None else (self.a[start:end], self.b[start:end])


def _rewritten(layer: _Layer, pattern: re.Pattern, decode, name: str) -> _Layer | None:
    """The layer with every match of ``pattern`` replaced by what it stands for; each new character maps to its match."""
    parts, at, starts, ends, changed = [], 0, [], [], False
    for m in pattern.finditer(layer.text):
        new = decode(m)
        if new is None:
            continue
        changed = True
        parts += [layer.text[at : m.start()], new]
        if layer.whole:
            at = m.end()
            continue
        a, b = layer.part(at, m.start())
        first, last = layer.span(m.start(), m.end())
        starts += [a, np.full(len(new), first)]
        ends += [b, np.full(len(new), last)]
        at = m.end()
    if not changed:
        return None
    if layer.whole:
        return _Layer("".join([*parts, layer.text[at:]]), None, None, f"{layer.path}{name}>", layer.whole)
    a, b = layer.part(at, len(layer.text))
    return _Layer("".join([*parts, layer.text[at:]]), np.concatenate([*starts, a]), np.concatenate([*ends, b]), f"{layer.path}{name}>")


def _url(m: re.Match) -> str | None:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _unicode(m: re.Match) -> str | None:
    code = int(m[6]) if m[6] else int(next(x for x in m.groups()[:5] if x), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _packed(raw: bytes) -> bool:
    """Whether bytes start as gzip or as zlib (any window and level)."""
    return raw[:3] == b"\x1f\x8b\x08" or (len(raw) > 1 and raw[0] & 15 == 8 and raw[0] < 128 and (raw[0] << 8 | raw[1]) % 31 == 0)


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces of concatenated gzip or zlib streams; what precedes a fault still counts, and what follows the last stream comes as it is."""
    stream, rest = zlib.decompressobj(zlib.MAX_WBITS | 32), b""
    for chunk in chunks:
        rest += chunk
        while rest:
            before = stream.copy()
            try:
                block = stream.decompress(rest, BLOCK)
            except zlib.error:
                yield from _up_to_fault(before, rest)
                return
            if block:
                yield block
            rest = stream.unconsumed_tail
            if stream.eof:
                rest = stream.unused_data
                while rest and not _packed(rest):
                    if len(rest) < 3 and (more := next(chunks, b"")):
                        rest += more
                        continue
                    yield rest
                    yield from chunks
                    return
                stream = zlib.decompressobj(zlib.MAX_WBITS | 32)
        while not stream.eof:  # what is made from input taken in before
            try:
                block = stream.decompress(b"", BLOCK)
            except zlib.error:
                return
            if not block:
                break
            yield block


def _up_to_fault(stream, rest: bytes) -> Iterator[bytes]:
    """What a stream still gives before the fault in ``rest``, such as a wrong checksum at its very end."""
    at = 0
    for step in (1 << 12, 1 << 6, 1):
        while at < len(rest):
            ahead = stream.copy()
            try:
                block = ahead.decompress(rest[at : at + step])
            except zlib.error:
                break
            stream, at = ahead, at + step
            if block:
                yield block


def _unpacked(chunks: Iterator[bytes], path: str, whole: tuple[int, int]) -> Iterator[_Layer]:
    """Layers of a compressed stream. A stream in it is unwrapped before anything is read as text, unless it unwraps to itself.

    Streams in streams are read through one another, STREAMS at a time; then what has come through is held as bytes, so that
    neither depth nor one large stream inflates without bound.
    """
    above: set[bytes] = set()
    depth = 0
    while True:
        pieces = _inflated(chunks)
        first = b""
        while len(first) < 3 and (piece := next(pieces, b"")):
            first += piece
        if not first:
            return
        path += "compressed>"
        digest = hashlib.blake2b(first, digest_size=16).digest()
        # nothing inflated: text that only looks like a stream
        if not _packed(first) or digest in above or next(_inflated(iter([first])), None) is None:
            break
        above.add(digest)
        depth += 1
        chunks = itertools.chain([first], pieces)
        if depth % STREAMS == 0:
            chunks = iter([b"".join(chunks)])
    held, size = [first], len(first)
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size < BLOCK:
            continue
        block = b"".join(held)
        cut = _last_break(block)
        held, size = [block], 0
        if cut is not None:
            yield _Layer(block.decode("utf-8", "replace"), None, None, path, whole)
            held = [block[cut:]]
    yield _Layer(b"".join(held).decode("utf-8", "replace"), None, None, path, whole)


def _last_break(block: bytes) -> int | None:
    """Where the last run that ends OVERLAP bytes before the end or later starts; none if that is the whole block."""
    end = len(block) - OVERLAP
    while end > 0:
        begin = max(0, end - OVERLAP)
        found = [m.end() for m in _BREAK.finditer(block, begin, end)]
        if found:
            return found[-1]
        end = begin
    return None


def _base64(layer: _Layer) -> Iterator[_Layer]:
    """Each run at all four alignments, so a payload behind a path or a separator is read as it was written; runs over lines joined."""
    for pattern in (_BASE64, _LINES):
        for m in pattern.finditer(layer.text):
            at = None
            run = m[0].rstrip("=")
            if pattern is _LINES:
                at = np.array([m.start() + i for i, c in enumerate(run) if not c.isspace()])
                run = "".join(run.split())
            place = lambda i, j: (m.start() + i, m.start() + j) if at is None else (int(at[i]), int(at[j - 1]) + 1)  # noqa: B023, E731
            standard = run.translate(_SAFE_TO_STANDARD)
            for k in range(4):
                yield from _text(layer, _bytes(standard[k:]), k, len(run), at, m.start())
            starts = {0} | {x.start() for x in _PACKED.finditer(run)}
            if at is not None:
                starts |= {0, *(np.flatnonzero(np.diff(at) > 1) + 1).tolist()}
            for k in sorted(starts):
                if _packed(_bytes(standard[k : k + 8])):
                    first, last = place(k, len(run))
                    yield from _unpacked(iter([_bytes(standard[k:])]), f"{layer.path}base64>", layer.span(m.start() if k == 0 else first, m.end() if k == 0 else last))


def _bytes(run: str) -> bytes:
    run = run[:-1] if len(run) % 4 == 1 else run
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return b""


def _text(layer: _Layer, raw: bytes, k: int, end: int, at: np.ndarray | None, start: int) -> Iterator[_Layer]:
    """Decoded bytes as text, UTF-8 or else a character a byte, mapped to the characters that hold them."""
    if not raw:
        return
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        size = np.ones(len(text), np.int64)
    else:
        size = np.array([len(c.encode()) for c in text]) if not text.isascii() else np.ones(len(text), np.int64)
    if layer.whole:
        yield _Layer(text, None, None, f"{layer.path}base64>", layer.whole)
        return
    last = np.cumsum(size)  # bytes up to and with each character
    from_char, to_char = k + (last - size) * 8 // 6, np.minimum(k + (last * 8 + 5) // 6, end)
    if at is None:
        a, b = layer.part(start, start + end)
    else:
        a, b = (at, at + 1) if layer.a is None else (layer.a[at], layer.b[at])
    yield _Layer(text, a[from_char], b[to_char - 1], f"{layer.path}base64>")


def _url_packed(layer: _Layer) -> Iterator[_Layer]:
    for m in _URL_PACKED.finditer(layer.text):
        raw = urllib.parse.unquote_to_bytes(m[0])
        if _packed(raw):
            yield from _unpacked(iter([raw]), f"{layer.path}url>", layer.span(m.start(), m.end()))


def _children(layer: _Layer) -> Iterator[_Layer | None]:
    """What a layer unwraps to, made one at a time; the layer itself is let go before the last of them is entered."""
    yield from _base64(layer)
    yield from _url_packed(layer)
    url = _URL.search(layer.text) is not None
    if "\\" in layer.text or "&#" in layer.text:
        child = _rewritten(layer, _UNICODE, _unicode, "unicode")
        if not url:
            del layer
        yield child
        child = None
    if url:
        child = _rewritten(layer, _URL, _url, "url")
        del layer
        yield child


def scan(text: str) -> list[tuple[int, int, str, str, str]]:
    """All secrets of a text as (start, end, kind, layers, value); every layer is scanned.

    Depth first: a layer is searched when it is made, then unwrapped in every way that changes it and let go, so only the layers
    above the current one are held, and a digest of each. A layer whose text was seen before (in the same place, as far out) is not
    entered again, so cycles end. A span found in several layers is reported once, by the outermost of them.
    """
    found: dict[tuple[str, int, int], tuple[int, str, str]] = {}
    seen: dict[bytes, int] = {}
    stack: list[Iterator[_Layer | None]] = [iter([_Layer(text, None, None, "")])]
    while stack:
        layer = next(stack[-1], stack)
        if layer is stack:
            stack.pop()
            continue
        if layer is None or not layer.text:
            continue
        depth = layer.path.count(">")
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass") + b"|%d,%d" % layer.span(0, len(layer.text)), digest_size=16).digest()
        if seen.get(key, depth + 1) <= depth:
            continue
        seen[key] = depth
        for start, end, kind in base_spans(layer.text):
            at = (kind, *layer.span(start, end))
            if at not in found or found[at][0] > depth:
                found[at] = (depth, layer.path, layer.text[start:end])
        stack.append(_children(layer))
        del layer
    return _ordered({k: v[1:] for k, v in found.items()})


def _ordered(found: dict) -> list[tuple[int, int, str, str, str]]:
    rows = [(start, end, kind, path.rstrip(">"), value) for (kind, start, end), (path, value) in found.items()]
    return sorted(rows, key=lambda r: (r[0], KINDS.index(r[2]), r[1]))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, secrets of every document; secrets by start, kind (assign, access, hex), end; layers "" for the text itself.

    Offsets are code points of the document's text, end exclusive; a secret in a decoded layer has the span that it was
    decoded from (characters for URL and Unicode escapes, the characters that hold its bytes for base64, the whole run for
    compressed data). Null or empty text: no secrets. Repeated rows: scanned each. Null doc_id: kept. Empty table: no
    rows. Ties (one span in several layers): the outermost. A very long text is held once with its offsets in each layer above the
    current one. Other columns are left out. Documents are independent: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string()), ("value", pa.string())]))
        for batch, texts in doc_batches(batches):
            results = [scan(t.decode("utf-8", "replace")) for t in texts]
            secrets = [[{"start": s, "end": e, "kind": k, "layers": p, "value": v} for s, e, k, p, v in rows] for rows in results]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(secrets, kind_of)], ["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(run, _ROW)


def spans_text(secrets: Column) -> Column:
    """kind:start:end of the secrets, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

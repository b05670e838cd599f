"""Secrets in texts and in whatever is encoded inside them.

Three kinds of secrets: `assign` (a password, token or key that is assigned a value of 8 or more characters), `access`
(access key identifiers) and `hex` (32 or more lower-case hex digits); per kind leftmost matches that do not
overlap. Their spans in the text as it stands are the base.

Beyond it a worklist unwraps what is encoded, layer by layer, until nothing new turns up:

* URL escapes (`%41`) and Unicode escapes (`\\u0041`, `\\U00000041`, `\\u{41}`, `\\x41`, `%u0041`, `&#65;`, `&#x41;`, any number of
  backslashes): a new layer is the whole layer with all escapes of one sort replaced, so a secret may be encoded in part;
* base64, plain or URL-safe, also in lines of equal length: a new layer is what a run of 19 or more characters stands for (the shortest
  secret needs as many). A run that gives neither text nor a compressed stream is tried from its next three characters on,
  as a word may stand before it, and scanned, but not unwrapped further;
* gzip, zlib, bzip2, xz and zstd streams among the bytes so found, read in windows of bounded size; a damaged stream is read
  as far as it goes.

Every layer is scanned again. A layer keeps for each of its characters where it comes from in the text, so spans found in it
are spans of the text (from the first to the last character involved; all of the run for a compressed one). Layers with the
same content from the same place are unwrapped once, which ends cycles (streams that unpack to themselves). A span found
in several layers counts once, base spans among them.

Positions are code points, ends exclusive. Null is an empty text; texts of any length are scanned whole, one at a time. Every
row gives a row, so repeated rows, null identifiers, ties and empty tables need no rule; the input row is carried as one
struct, so its column names are free.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import ship_package

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_VALUE = 8
# Runs of one class: all of a run matches or, where it is too short, nothing of it.
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
_HEX = re.compile("[0-9a-f]{32,}")

#: Unpacked bytes that are scanned at a time, and how many of them again with the next ones.
WINDOW, AGAIN = 1 << 24, 1 << 16


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the secrets a text shows."""
    low = text.lower()
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= _VALUE] if any(n in low for n in _NAMES) else []
    out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    return out + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


class Layer:
    """A text and, per character, the first and the end position it stands for in the original text (one pair for all
    characters where they come from one stream)."""

    def __init__(self, text: str, first: np.ndarray, end: np.ndarray, path: tuple[str, ...]) -> None:
        self.text, self.first, self.end, self.path = text, first, end, path

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (int(self.first[0]), int(self.end[0])) if len(self.first) != len(self.text) else (int(self.first[start]), int(self.end[end - 1]))

    def part(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original positions of new characters that each stand for [first, end) of this layer."""
        if len(self.first) != len(self.text):
            return self.first[:1], self.end[:1]
        return self.first[first], self.end[end - 1]


_BYTE_ESCAPES = {"url": re.compile("%([0-9A-Fa-f]{2})"), "unicode": re.compile(r"\\+x([0-9A-Fa-f]{2})")}
_CHARACTER = re.compile(r"(?:\\+u|%u)(?:([0-9A-Fa-f]{4})|\{([0-9A-Fa-f]{1,6})\})|\\+U([0-9A-Fa-f]{8})|&#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));", re.ASCII)


def _characters(data: bytes) -> tuple[str, np.ndarray]:
    """Text of bytes, and each character's first byte: UTF-8, two-byte little-endian where every other byte is zero, else one
    character per byte."""
    try:
        text = data.decode("utf-8")
        if len(text) == len(data):
            if len(data) >= 4 and len(data) % 2 == 0 and not any(data[1::2]) and all(data[::2]):
                return data[::2].decode("latin-1"), np.arange(0, len(data), 2)
            return text, np.arange(len(data))
        return text, np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    except UnicodeDecodeError:
        return data.decode("latin-1"), np.arange(len(data))


def _escapes(sort: str, text: str) -> list[tuple[int, int, str, np.ndarray, np.ndarray]]:
    """Runs of escapes: start, end, the characters they stand for, and each one's first and end position in the text."""
    out, run = [], []

    def close() -> None:
        if run:
            made, at = _characters(bytes(v for _, _, v in run))
            starts, ends = np.array([s for s, _, _ in run]), np.array([e for _, e, _ in run])
            out.append((run[0][0], run[-1][1], made, starts[at], ends[np.r_[at[1:] - 1, len(run) - 1]]))
            run.clear()

    for m in _BYTE_ESCAPES[sort].finditer(text):
        if run and run[-1][1] != m.start():
            close()
        run.append((m.start(), m.end(), int(m[1], 16)))
    close()
    if sort == "unicode":
        units = []
        for m in _CHARACTER.finditer(text):
            value = int(m[5]) if m[5] else int(next(g for g in m.groups()[:4] if g), 16)
            if value > 0x10FFFF:
                continue
            high = units[-1] if units else None
            if 0xDC00 <= value < 0xE000 and high and high[1] == m.start() and 0xD800 <= high[2] < 0xDC00:
                units[-1] = (high[0], m.end(), 0x10000 + ((high[2] - 0xD800) << 10) + value - 0xDC00)
            else:
                units.append((m.start(), m.end(), value))
        out += [(s, e, chr(v) if not 0xD800 <= v < 0xE000 else "�", np.array([s]), np.array([e])) for s, e, v in units]
        out.sort(key=lambda x: x[0])
    return out


def _unescaped(layer: Layer, sort: str) -> Layer | None:
    found = _escapes(sort, layer.text)
    if not found:
        return None
    texts, firsts, ends, at = [], [], [], 0
    for start, end, made, first, last in found:
        if start < at:
            continue
        texts += [layer.text[at:start], made]
        firsts += [np.arange(at, start), first]
        ends += [np.arange(at, start) + 1, last]
        at = end
    rest = np.arange(at, len(layer.text))
    first, end = layer.part(np.concatenate([*firsts, rest]).astype(np.int64), np.concatenate([*ends, rest + 1]).astype(np.int64))
    return Layer("".join(texts) + layer.text[at:], first, end, (*layer.path, sort))


_RUN = re.compile(r"(?:[A-Za-z0-9+/]{40,76}\r?\n)+[A-Za-z0-9+/]{2,76}={0,2}|[A-Za-z0-9+/_-]{19,}={0,2}", re.ASCII)
_STANDARD = str.maketrans("-_", "+/")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
_MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}


def _readable(data: bytes) -> bool:
    text = _characters(data)[0]
    return not _CONTROL.search(text) and (text.isascii() or len(text) < len(data))


def _stream(data: bytes) -> str | None:
    if len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and not data[1] & 32 and (data[0] * 256 + data[1]) % 31 == 0:
        return "zlib"
    return next((name for magic, name in _MAGIC.items() if data.startswith(magic)), None)


def unpacked(data: bytes, sort: str) -> Iterator[bytes]:
    """What a stream unpacks to, in overlapping windows of at most WINDOW bytes and a piece."""
    reader = {"gzip": lambda: zlib.decompressobj(47), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}.get(sort)
    held = bytearray()
    try:
        if reader is None:
            with zstandard.ZstdDecompressor().stream_reader(data) as source:
                while piece := source.read(1 << 20):
                    held += piece
                    if len(held) >= WINDOW:
                        yield bytes(held)
                        del held[:-AGAIN]
        else:
            left = data
            while left:  # members may follow each other
                one = reader()
                while left or not getattr(one, "needs_input", True):
                    piece = one.decompress(left, 1 << 20)
                    left = one.unconsumed_tail if hasattr(one, "unconsumed_tail") else b""
                    held += piece
                    if len(held) >= WINDOW:
                        yield bytes(held)
                        del held[:-AGAIN]
                    if one.eof or not piece:
                        break
                left = one.unused_data if one.eof else b""
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass
    if held:
        yield bytes(held)


def _runs(text: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Base64 runs and the places of their characters; several readings of a run over more lines, the longest first."""
    for m in _RUN.finditer(text):
        places = np.arange(m.start(), m.end())
        if "\n" not in m[0]:
            yield [(m[0], places)]
            continue
        lines = [(x[0], places[x.start() : x.end()]) for x in re.finditer(r"[^\r\n]+", m[0])]
        joined = lambda some: ("".join(t for t, _ in some), np.concatenate([p for _, p in some]))
        yield [joined(lines), joined(lines[:-1])]


def _blobs(layer: Layer) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, str, bool]]:
    """Byte strings that runs of a layer stand for: bytes, each byte's first and end position in the layer, sort, and whether
    to unwrap it further."""
    for readings in _runs(layer.text):
        tries = []
        for run, places in readings:
            body = run.rstrip("=").translate(_STANDARD)
            for skip in range(4):
                code = body[skip:]
                code = code[:-1] if len(code) % 4 == 1 else code
                data = base64.b64decode(code + "=" * (-len(code) % 4))
                at = np.arange(len(data)) * 8
                tries.append((data, places[skip + at // 6], places[skip + (at + 7) // 6] + 1, "base64"))
        sound = next((t for t in tries if _stream(t[0]) or _readable(t[0])), None)
        if sound:
            yield *sound, True
        else:
            for one in tries:
                yield *one, False
    for sort in _BYTE_ESCAPES:  # streams written as escaped bytes
        run = []
        for m in _BYTE_ESCAPES[sort].finditer(layer.text):
            if run and run[-1][1] != m.start():
                yield from _escaped_stream(run, sort)
                run = []
            run.append((m.start(), m.end(), int(m[1], 16)))
        yield from _escaped_stream(run, sort)


def _escaped_stream(run: list[tuple[int, int, int]], sort: str) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, str, bool]]:
    data = bytes(v for _, _, v in run)
    if len(data) > 8 and _stream(data):
        yield data, np.array([s for s, _, _ in run]), np.array([e for _, e, _ in run]), sort, True


def find(text: str | None) -> list[tuple[int, str, int, str]]:
    """All spans (start, kind, end, path) by start, kind as listed, end. The path names the layers unwrapped, empty for the base."""
    text = text or ""
    out = {(s, k, e): "" for s, k, e in base_spans(text)}
    if not _worth(text):
        return _in_order(out)
    positions = np.arange(len(text))
    work: list = [Layer(text, positions, positions + 1, ())]
    seen: set = set()

    def new(content: bytes, first: int, end: int) -> bool:
        key = hashlib.blake2b(content, digest_size=16).digest(), first, end
        if key in seen:
            return False
        seen.add(key)
        return True

    def unpack(data: bytes, first: np.ndarray, end: np.ndarray, path: tuple[str, ...], further: bool) -> None:
        """Put the layer that bytes stand for on the list."""
        if not data or not new(data, int(first[0]), int(end[-1])):
            return
        sort = _stream(data) if further else None
        if sort:
            windows = unpacked(data, sort)
            one = next(windows, None)
            if one is not None:
                work.append((chain([one], windows), np.array([first[0]]), np.array([end[-1]]), (*path, sort)))
                return
        made, at = _characters(data)
        if len(first) == len(data):
            first, end = first[at], end[np.r_[at[1:] - 1, len(data) - 1]]
        found = Layer(made, first, end, path)
        if further:
            work.append(found)
        else:
            add(found)

    def add(layer: Layer) -> None:
        for s, kind, e in base_spans(layer.text):
            s, e = layer.span(s, e)
            out.setdefault((s, kind, e), ">".join(layer.path))

    while work:
        layer = work.pop()
        if isinstance(layer, tuple):  # a stream: its next window, then the rest
            window = next(layer[0], None)
            if window is not None:
                work.append(layer)
                unpack(window, *layer[1:], True)
            continue
        if layer.path:
            add(layer)
        for sort in _BYTE_ESCAPES:
            made = _unescaped(layer, sort)
            if made and made.text and new(made.text.encode("utf-8", "surrogatepass"), int(made.first[0]), int(made.end[-1])):
                work.append(made)
        for data, first, end, sort, further in _blobs(layer):
            unpack(data, *layer.part(first, end), (*layer.path, sort), further)
    return _in_order(out)


_ENCODED = re.compile(r"%[0-9A-Fa-fu]|\\[uUx]|&#|[A-Za-z0-9+/_-]{19}", re.ASCII)


def _worth(text: str) -> bool:
    return _ENCODED.search(text) is not None


def _in_order(spans: dict) -> list[tuple[int, str, int, str]]:
    return sorted(((s, k, e, path) for (s, k, e), path in spans.items()), key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


_SPAN = "array<struct<kind: string, start: long, end: long, path: string>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row` (a struct of all input columns) and `found`, the array of all spans: kind, start, end, and the path of layers
    they were found under (empty for the base)."""
    ship_package(docs.sparkSession)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e, "path": p} for s, k, e, p in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], names=["row", "found"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, found {_SPAN}")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base(found: Column) -> Column:
    return F.filter(found, lambda s: s["path"] == "")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, with every span of their text replaced by its kind in brackets; overlapping spans by the first one's."""
    rows = scan(docs, text)
    source, rest = F.col("row")[text], lambda state: F.greatest(state["at"], F.lit(1))
    step = lambda state, s: F.struct(
        F.concat(state["out"], F.when(s["start"] + 1 >= state["at"], F.concat(F.substring(source, rest(state), (s["start"] + 1 - state["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise("")).alias("out"),
        F.greatest(state["at"], s["end"].cast("int") + 1).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    clean = F.aggregate("found", start, step, lambda state: F.concat(state["out"], F.substring(source, state["at"], F.length(source))))
    return rows.select(*[F.when(source.isNotNull(), clean).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])

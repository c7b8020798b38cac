"""Secret scans through nested encodings.

Each text starts a worklist of layers. A layer is scanned; then each decoding that changes it
(percent escapes, Unicode, octal and named character escapes, base64 words, also wrapped over lines, base64 of compressed data) makes a further layer
in which the decoded parts stand in their place, so that a key name outside an encoded value still
belongs to it. Layers go on the list until nothing new appears; a layer that was seen before (a
cycle) isn't taken up again. Every character of a layer knows the span of the original text that
it comes from, so all findings are reported as spans of the original.

Defined results for odd input:
- a null or empty text has no findings;
- decoded bytes are read as UTF-8, UTF-16 or else byte by byte, whatever control characters are in between; only those
  without a run of printable characters that could hold anything (twelve) are left as they are;
- what is compressed in several members, or breaks off, counts with all that can be unpacked;
- compressed data that would unpack to more than ``most`` bytes isn't unpacked but reported as a
  span of kind ``packed``, so that nothing goes by unseen;
- repeated documents are scanned row by row; extra columns are passed on.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.llm.frames import column_index, numbered, pick, table, with_results

KINDS = ("assign", "access", "hex", "packed")
#: Bytes that one compressed value may unpack to.
MOST_UNPACKED = 16 << 20

# The patterns of the three kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is taken whole, so shorter ones needn't be matched first
LEAST_VALUE, LEAST_ACCESS = 12, 18

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z]{2,31};)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
_FULL_LINE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?=\r?\n[\x20\t]*[A-Za-z0-9+/_-])")
_NEXT_LINE = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
_LINE_BEFORE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+\r?\n[\x20\t]*")
_PART = re.compile(r"[\s\S]+")
_STRUCT = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

Span = tuple[int, int, int]  # start, kind, end: in this order they sort as they are reported


def scan_layer(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class TooLong(Exception):
    pass


def _engine(data: bytes):
    """What unpacks data that begin like a compressed format that is at hand."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] == 0x78 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=64 << 20)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=64 << 20)
    return None


def _unpack(data: bytes, most: int) -> bytes | None:
    """What data unpacks to, all of its members, and what follows the last one; None if nothing does."""
    out, any_member = b"", False
    while data and (engine := _engine(data)) is not None:
        try:
            if hasattr(engine, "stream_reader"):
                with engine.stream_reader(data, read_across_frames=True) as reader:
                    part, data = reader.read(most + 1 - len(out)), b""
            else:
                part = engine.decompress(data, most + 1 - len(out))
                data = engine.unused_data if engine.eof else b""
        except Exception:  # noqa: BLE001  only looks like compressed data, or breaks off
            break
        out, any_member = out + part, any_member or bool(part)
        if len(out) > most:
            raise TooLong
    return out + data[: most - len(out)] if any_member else None


def _readable(data: bytes) -> tuple[str, list[int]] | None:
    """Text and the number of bytes of each of its characters, or None if there can't be anything in it."""
    pairs = len(data) // 2
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") or (pairs >= 6 and max(data[0 : 2 * pairs : 2].count(0), data[1 : 2 * pairs : 2].count(0)) > 0.7 * pairs):
        big = data[:2] == b"\xfe\xff" or (data[:2] != b"\xff\xfe" and data[0::2].count(0) > data[1::2].count(0))
        text = data[: 2 * pairs].decode("utf-16-be" if big else "utf-16-le", "replace")
        return text, [2 + 2 * (ord(c) > 0xFFFF) for c in text]
    try:
        text = data.decode("utf-8")
        if text and (text.translate(_LINE_SPACE).isprintable() or _RUN.search(data)):
            return text, [len(c.encode()) for c in text]
        return None
    except UnicodeDecodeError:
        return (data.decode("latin-1"), [1] * len(data)) if _RUN.search(data) else None


_LINE_SPACE = {9: 32, 10: 32, 13: 32}
_RUN = re.compile(rb"[\x20-\x7e]{12}")


def _percent(m: re.Match, most: int) -> tuple[str, list[tuple[int, int]]] | None:
    raw = bytes.fromhex(m[0].replace("%", ""))
    text, spans, at = raw.decode("utf-8", "replace"), [], 0
    if text.count("�") > raw.count(b"\xef\xbf\xbd"):
        text = raw.decode("latin-1")
        return text, [(m.start() + 3 * i, m.start() + 3 * i + 3) for i in range(len(raw))]
    for c in text:
        n = 3 * len(c.encode())
        spans.append((m.start() + at, m.start() + at + n))
        at += n
    return text, spans


def _escape(m: re.Match, most: int) -> tuple[str, list[tuple[int, int]]] | None:
    body = m[0]
    if body[0] == "&" and body[1] != "#":
        text = html5.get(body[1:])
        return None if text is None else (text, [(m.start(), m.end())] * len(text))
    if body[0] == "\\" and body[1] in "0123":
        code = int(body[1:], 8)
    else:
        code = int(body[2:-1]) if body[:2] == "&#" and body[2] not in "xX" else int(re.sub(r"[^0-9A-Fa-f]", "", body[2:].lstrip("xX")), 16)
    if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
        return None
    return chr(code), [(m.start(), m.end())]


def _base64(m: re.Match, most: int) -> tuple[str, list[tuple[int, int]]] | None:
    return _decode64(m[0], range(m.start(), m.end()), most)


class Wrapped:
    """Finds base64 that is wrapped into lines of one length, like a pattern.

    A shorter line before or after may belong to it or be a word of the text, so each is tried with and without."""

    def __init__(self, before: bool, after: bool) -> None:
        self.before, self.after = before, after

    def finditer(self, text: str) -> Iterator[re.Match]:
        at = done = 0
        while (m := _FULL_LINE.search(text, at)) is not None:
            start, end, width = m.start(), m.end(), m.end() - m.start()
            while (n := _NEXT_LINE.match(text, end)) is not None:
                size = n.end(1) - n.start(1)
                if size == width or (size < width and self.after):
                    end = n.end()
                if size != width or n[1].endswith("="):
                    break
            if self.before:
                lo = text.rfind("\n", done, max(done, text.rfind("\n", done, start))) + 1
                for n in _LINE_BEFORE.finditer(text, max(done, lo), start):
                    if n.end() == start and len(n[0].rstrip()) < width:
                        start = n.start()
                        break
            at = end
            if "\n" in text[start:end]:
                yield _PART.match(text, start, end)
                done = end


def _wrapped(m: re.Match, most: int) -> tuple[str, list[tuple[int, int]]] | None:
    """The lines joined; each character keeps its place."""
    at_of = [i for x in _LINE.finditer(m[0]) for i in range(m.start() + x.start(), m.start() + x.end())]
    return _decode64("".join(_LINE.findall(m[0])), at_of, most)


def _decode64(run: str, at_of, most: int) -> tuple[str, list[tuple[int, int]]] | None:
    """What a run of base64 says, with spans; at_of[i] is where its i-th character stands."""
    word = run.rstrip("=")
    if len(word) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(word.replace("-", "+").replace("_", "/") + "=" * (-len(word) % 4), validate=True)
    except binascii.Error:
        return None
    inner = _unpack(raw, most)
    read = _readable(raw if inner is None else inner)
    if read is None:
        return None
    text, widths = read
    if inner is not None:
        return text, [(at_of[0], at_of[-1] + 1)] * len(text)
    spans, at = [], 0
    for n in widths:
        spans.append((at_of[at // 3 * 4 + at % 3], at_of[min(len(run), (at + n + 2) // 3 * 4) - 1] + 1))
        at += n
    return text, spans


DECODERS = ((_PERCENT, _percent, "%"), (_ESCAPE, _escape, None), (_BASE64, _base64, None), *((Wrapped(before, after), _wrapped, "\n") for before in (False, True) for after in (False, True)))


class Layer:
    """A text and, unless it is the original, the original's span for each of its characters."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def back(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start:end].min()), int(self.ends[start:end].max()))

    def decoded(self, pattern: re.Pattern, decode, most: int, too_long: set[tuple[int, int]]) -> Layer | None:
        """This layer with every place of the pattern decoded, or None if nothing changes."""
        parts, spans, at = [], [], 0
        for m in pattern.finditer(self.text):
            try:
                got = decode(m, most)
            except TooLong:
                too_long.add(self.back(m.start(), m.end()))
                continue
            if got is not None:
                parts += [self.text[at : m.start()], got[0]]
                spans += [(at, m.start(), None), (0, 0, got[1])]
                at = m.end()
        if not parts:
            return None
        parts.append(self.text[at:])
        spans.append((at, len(self.text), None))
        one = [np.column_stack((np.arange(a, b), np.arange(a, b) + 1)) if s is None else np.array(s, dtype=np.int64).reshape(-1, 2) for a, b, s in spans]
        both = np.concatenate(one)
        if self.starts is not None and len(both):
            both = np.column_stack((self.starts[both[:, 0]], self.ends[both[:, 1] - 1]))
        return Layer("".join(parts), both[:, 0], both[:, 1])


def scan_text(text: str, most: int = MOST_UNPACKED) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and all spans together with those of the layers below."""
    base = sorted(scan_layer(text))
    every, work, seen, too_long = set(base), [Layer(text)], {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}, set()
    while work:
        layer = work.pop()
        for pattern, decode, needs in DECODERS:
            if needs is not None and needs not in layer.text:
                continue
            below = layer.decoded(pattern, decode, most, too_long)
            if below is None:
                continue
            mark = hashlib.sha256(below.text.encode("utf-8", "surrogatepass")).digest()
            if mark in seen:
                continue
            seen.add(mark)
            work.append(below)
            for start, kind, end in scan_layer(below.text):
                a, b = below.back(start, end)
                every.add((a, kind, b))
    every |= {(a, 3, b) for a, b in too_long}
    return base, sorted(every)


def _spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _run(at: int, most: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every, digest = [], [], []
            for value in batch.column(at):
                own, found = scan_text(value.as_py() or "", most)
                base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own])
                every.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
                digest.append(hashlib.sha256(_spell(own).encode()).hexdigest())
            new = [pa.array(v, type=schema.field(batch.num_columns + i).type) for i, v in enumerate((base, every, digest))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=schema)

    return run


def find_secrets(docs: DataFrame, text: str = "text", most: int = MOST_UNPACKED) -> DataFrame:
    """docs with base_spans, all_spans (kind, start, end in code points) and base_sha256."""
    df, names = numbered(docs)
    at = column_index(docs, text)
    df = df.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    shape = T.StructType([*df.schema.fields, T.StructField("base_spans", _STRUCT), T.StructField("all_spans", _STRUCT), T.StructField("base_sha256", T.StringType())])
    return with_results(df.mapInArrow(_run(at, most, to_arrow_schema(shape)), shape), names, ["base_spans", "all_spans", "base_sha256"])


def spelled(spans: str):
    """A column of spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = find_secrets(docs)
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), "base_sha256", spelled("all_spans").alias("spans"))

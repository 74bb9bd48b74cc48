"""Secret scan through nested encodings.

A worklist starts with the text. Each layer is scanned with the rules. Then new layers
are made of it: the whole layer with all its URL escapes decoded in place, with all its
Unicode and markup escapes, and with all its base64 that is plain text, so a rule sees
a decoded value with what stands about it; and by itself whatever each stretch of base64
decodes to, text or not, at each alignment, and whatever compressed bytes expand to. A
layer whose content was already met at the same place is not taken up again, so cycles
end, and the list is empty at the fixpoint. Every layer knows for each of its characters
which span of the original text it came from, so findings have spans of the original.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxweave.runtime import prepare

RESULT = "doc_id long, kind string, layers string, start int, end int, digest string"
MASK, MOST = "[SECRET]", 64 << 20

#: kind, words one of which must occur (in lower case) for the rule to run, the rule; group 1, if there is one, is the secret.
RULES: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    ("cloud_access_key", ("akia", "asia"), re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("code_host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b")),
    ("chat_token", ("xox",), re.compile(r"\bxox[abprs]-[0-9A-Za-z-]{10,}")),
    ("api_key", ("aiza",), re.compile(r"\bAIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")),
    ("payment_key", ("sk_live_", "rk_live_"), re.compile(r"\b[sr]k_live_[0-9A-Za-z]{16,}")),
    ("signed_token", ("eyj",), re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("private_key", ("private key-----",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----.*?(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----|\Z)", re.S)),
    ("url_password", ("://",), re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]{1,20}://[^\s/:@\"']{1,256}:([^\s/@\"']{3,256})@")),
    ("assigned_secret", ("token", "secret", "passw", "key", "auth"), re.compile(r"(?i)(?<![a-z])(?:[a-z0-9]+[_-])*(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth)(?:[_-](?:key|token|id))?[\"']?\s{0,8}(?:=|:|=>)\s{0,8}[\"']?([A-Za-z0-9_\-+/.=~]{16,})")),
]
_URL = re.compile(r"%25(?:25)*|%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"(?P<again>\\x5[cC](?:x5[cC])+|\\u005[cC](?:u005[cC])+|&amp;(?:amp;)+)|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|&[a-zA-Z]{2,8};")
_BREAK = r"(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>]*)"
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_BREAKS = re.compile(_BREAK)
_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\u\{0{0,4}([0-9A-Fa-f]{1,2})\}|\\U000000([0-9A-Fa-f]{2})|&#[xX]0{0,4}([0-9A-Fa-f]{1,2});|&#(0{0,4}[0-9]{1,3});|(\\[abfnrtv0\\'\"])")
_SIMPLE = dict(zip("abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\""))
_MAGIC = ((b"\x1f\x8b", "gzip"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x78\x01", "zlib"), (b"\x78\x5e", "zlib"), (b"\x78\x9c", "zlib"), (b"\x78\xda", "zlib"))
_STARTS = re.compile(b"|".join(re.escape(magic) for magic, _ in _MAGIC), re.S)


@dataclass
class Layer:
    text: str
    start: np.ndarray | None  # None: the original
    end: np.ndarray | None
    chain: tuple[str, ...]

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a]), int(self.end[b - 1])


Part = tuple[int, int, str, np.ndarray | None, np.ndarray | None]


def _substituted(layer: Layer, parts: list[Part], name: str) -> Layer:
    """The layer with its stretches (a, b) replaced by texts, whose characters lie at the given spans of the original, or at the whole stretch."""
    out, starts, ends, at = [], [], [], 0

    def copy(a: int, b: int) -> None:
        if a < b:
            out.append(layer.text[a:b])
            starts.append(np.arange(a, b) if layer.start is None else layer.start[a:b])
            ends.append(np.arange(a + 1, b + 1) if layer.start is None else layer.end[a:b])

    for a, b, new, first, last in parts:
        copy(at, a)
        s, e = layer.span(a, b)
        out.append(new)
        starts.append(np.full(len(new), s) if first is None else first)
        ends.append(np.full(len(new), e) if last is None else last)
        at = b
    copy(at, len(layer.text))
    return Layer("".join(out), np.concatenate(starts), np.concatenate(ends), (*layer.chain, name))


def _url_layers(layer: Layer) -> Iterator[Layer]:
    """The whole layer with its URL escapes decoded; a percent sign escaped many times over is one."""
    if "%" not in layer.text:
        return
    parts: list[Part] = []
    found = [m.span() for m in _URL.finditer(layer.text)]
    raw = bytes(int(layer.text[x + 1 : x + 3], 16) for x, _ in found)
    k = 0
    while k < len(raw):  # one character at a time, for its span
        for size in (1, 2, 3, 4):
            joined = k + size <= len(raw) and all(found[j][1] == found[j + 1][0] for j in range(k, k + size - 1))
            try:
                char = raw[k : k + size].decode("utf-8") if joined else ""
            except UnicodeDecodeError:
                continue
            if char:
                break
        else:
            char, size = chr(raw[k]), 1
        parts.append((found[k][0], found[k + size - 1][1], char, None, None))
        k += size
    if parts:
        yield _substituted(layer, parts, "url")


def _escape_layers(layer: Layer) -> Iterator[Layer]:
    """The whole layer with its Unicode and markup escapes decoded; a sign escaped many times over is one."""
    if "\\" not in layer.text and "&" not in layer.text:
        return
    parts: list[Part] = []
    high = None
    for m in _ESCAPE.finditer(layer.text):
        code = next((g for g in m.groups() if g), None)
        if m.lastgroup == "again":
            new = m.group()[0]
        elif code is None:
            new = html.unescape(m.group())
            if new == m.group():
                continue
        else:
            point = int(code, 16)
            if 0xD800 <= point < 0xDC00:
                high = (m.start(), m.end(), point)
                continue
            if 0xDC00 <= point < 0xE000:
                if high and high[1] == m.start():
                    parts.append((high[0], m.end(), chr(0x10000 + ((high[2] - 0xD800) << 10) + point - 0xDC00), None, None))
                high = None
                continue
            if point > 0x10FFFF:
                continue
            new = chr(point)
        parts.append((m.start(), m.end(), new, None, None))
    if parts:
        yield _substituted(layer, parts, "unicode")


def views(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """What the bytes may be as text, whatever they are, and the byte where each character starts, with an end.

    UTF-8, where a byte that is none is a character of its own; with zero bytes also UTF-16 and UTF-32 of either order at each alignment.
    """
    text = raw.decode("utf-8", "surrogateescape")
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    yield text, np.concatenate(([0], np.cumsum(np.where((c >= 0xDC80) & (c <= 0xDCFF), 1, size))))
    for width in (2, 4):
        if b"\0" * (width - 1) not in raw:
            continue
        for order in "<>":
            for at in range(min(width, len(raw))):
                c = np.frombuffer(raw, f"{order}u{width}", (len(raw) - at) // width, at)
                text = np.where(c > 0x10FFFF, 0xFFFD, c).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                yield text, at + width * np.arange(len(c) + 1)


def _expand(raw: bytes, most: int) -> tuple[bytes, str, int] | None:
    """(content of all members, name of the compression, bytes that were used) of compressed bytes; raises OverflowError past `most` bytes."""
    for magic, name in _MAGIC:
        if not raw.startswith(magic):
            continue
        out, size, rest = [], 0, raw
        try:
            while name == "zstd" and rest.startswith(magic):
                d, k = zstandard.ZstdDecompressor().decompressobj(), 0
                while k < len(rest) and not d.eof:  # some bytes at a time, as it takes no bound on what comes out
                    part = d.decompress(rest[k : k + 256])
                    k += 256
                    out.append(part)
                    size += len(part)
                    if size > most:
                        raise OverflowError
                rest = d.unused_data + rest[k:]
            while name != "zstd" and rest.startswith(magic[:2]):
                d = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[name]()
                part = d.decompress(rest, most + 1 - size)
                out.append(part)
                size += len(part)
                if size > most:
                    raise OverflowError
                rest = d.unused_data.lstrip(b"\0") if d.eof else b""
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError, zstandard.ZstdError):
            pass
        if size:
            return b"".join(out), name, len(raw) - len(rest)
    return None


def _unpacked(raw: bytes, layer: Layer, name: str, begin: np.ndarray, finish: np.ndarray, room: list[int]) -> Iterator[Layer]:
    """Layers of what is compressed anywhere in the bytes; begin and finish: where each byte lies in the original."""
    at = 0
    while m := _STARTS.search(raw, at):
        at = m.start() + 1
        packed, inner, chain, used = set(), raw[m.start() :], (*layer.chain, name), 0
        while inner not in packed and room[0] >= 0:
            packed.add(inner)
            try:
                opened = _expand(inner, room[0])
            except OverflowError:
                yield Layer("", begin[m.start() : m.start() + 1], finish[-1:], (*chain, "too_large"))
                at = len(raw)
                used = 0
                break
            if opened is None:
                break
            inner, kind, n = opened
            used = used or n
            room[0] -= len(inner)
            chain = (*chain, kind)
        if used:
            s, e = int(begin[m.start()]), int(finish[m.start() + used - 1])
            for text, _ in views(inner):
                yield Layer(text, np.full(len(text), s), np.full(len(text), e), chain)
            at = max(at, m.start() + used) if len(inner) >= 4 else at


def _places(layer: Layer, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The original's spans of the layer's stretches from characters a to b."""
    return (a, b) if layer.start is None else (layer.start[a], layer.end[b - 1])


def _byte_layers(layer: Layer, room: list[int]) -> Iterator[Layer]:
    """What is compressed in bytes that are written as URL or other escapes, over the whole layer, as white space may stand for itself."""
    for name, sign in (("url", "%"), ("unicode", "\\&")):
        if not any(c in layer.text for c in sign):
            continue
        out, first, last, at, high = bytearray(), [], [], 0, False
        for m in _BYTE.finditer(layer.text):
            if m.group()[0] not in sign:
                continue
            number = next((g for g in m.groups()[:6] if g), None)
            value = int(number, 16) if number else int(m.group(7)) if m.group(7) else _SIMPLE[m.group(8)[1]]
            if value > 255:
                continue
            for k in range(at, m.start()):
                c = layer.text[k].encode("utf-8", "surrogatepass")
                out += c
                first += [k] * len(c)
                last += [k + 1] * len(c)
            out.append(value)
            first.append(m.start())
            last.append(m.end())
            at = m.end()
            high |= value > 126 or value < 32
        if not high:
            continue
        for k in range(at, len(layer.text)):
            c = layer.text[k].encode("utf-8", "surrogatepass")
            out += c
            first += [k] * len(c)
            last += [k + 1] * len(c)
        yield from _unpacked(bytes(out), layer, name, *_places(layer, np.array(first), np.array(last)), room)


def _base64_layers(layer: Layer, room: list[int]) -> Iterator[Layer]:
    """Decoded at each of four alignments, as what stands before the payload may belong to the alphabet; across line breaks. At the end the layer with all that is plain text in place."""
    parts: list[Part] = []
    for m in _BASE64.finditer(layer.text):
        body, a, place = m.group().rstrip("="), m.start(), None
        if "\n" in body or "\\" in body:
            keep, k = [], 0
            for x in _BREAKS.finditer(body):
                keep.append(np.arange(k, x.start()))
                k = x.end()
            place = np.concatenate([*keep, np.arange(k, len(body))])
            body = _BREAKS.sub("", body)
        body = body.replace("-", "+").replace("_", "/")
        place = a + (np.arange(len(body)) if place is None else place)
        for shift in range(4):
            own = body[shift:]
            own = own[: len(own) - (len(own) % 4 == 1)]
            raw = base64.b64decode(own + "=" * (-len(own) % 4))
            k = np.arange(len(raw))
            begin, finish = _places(layer, place[shift + k * 4 // 3], place[shift + (k * 8 + 7) // 6] + 1)
            for text, first in views(raw):
                if len(text):
                    spans = begin[first[:-1]], finish[first[1:] - 1]
                    yield Layer(text, *spans, (*layer.chain, "base64"))
                    if shift == 0 and text.isascii() and text.isprintable():
                        parts.append((m.start(), m.end(), text, *spans))
            yield from _unpacked(raw, layer, "base64", begin, finish, room)
    if parts:
        yield _substituted(layer, parts, "base64")


def scan(text: str, most: int = MOST) -> list[tuple[str, str, int, int, str]]:
    """(kind, layers, start, end, digest) of each secret, by place; what a layer shows again of the layer it was made of is told once.

    `most` bounds the bytes that one text's compressed layers may expand to; a stretch
    that would pass it is itself reported, as kind "too_large".
    """
    found: dict[tuple[str, int, int, str], set[tuple[str, ...]]] = {}
    work, room = [Layer(text, None, None, ())], [most]

    def add(kind: str, chain: tuple[str, ...], s: int, e: int, digest: str) -> None:
        found.setdefault((kind, s, e, digest), set()).add(chain)

    met: set[tuple] = set()
    while work:
        layer = work.pop()
        if layer.chain and layer.chain[-1] == "too_large":
            add("too_large", layer.chain[:-1], int(layer.start[0]), int(layer.end[0]), "")
            continue
        if layer.chain:
            key = (layer.text, *layer.span(0, len(layer.text)))
            if key in met:
                continue
            met.add(key)
        low = layer.text.lower()
        for kind, anchors, rule in RULES:
            if any(a in low for a in anchors):
                for m in rule.finditer(layer.text):
                    g = 1 if rule.groups else 0
                    s, e = layer.span(m.start(g), m.end(g))
                    add(kind, layer.chain, s, e, hashlib.sha256(m.group(g).encode("utf-8", "surrogatepass")).hexdigest()[:16])
        for new in (*_byte_layers(layer, room), *_base64_layers(layer, room), *_escape_layers(layer), *_url_layers(layer)):
            if new.text or new.chain[-1] == "too_large":
                work.append(new)
    own = lambda chains: (c for c in chains if not any(c[:k] in chains for k in range(len(c))))
    return sorted(((kind, ">".join(c), s, e, digest) for (kind, s, e, digest), chains in found.items() for c in own(chains)), key=lambda x: (x[2], x[3], x[0], x[1]))


def redact(text: str, mask: str = MASK, most: int = MOST) -> str:
    """The text with every secret's span, decoded or not, replaced by the mask."""
    spans = sorted((s, e) for _, _, s, e, _ in scan(text, most))
    out, at = [], 0
    for s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out.append(text[at:s])
            out.append(mask)
        at = e
    return text if not spans else "".join(out) + text[at:]


def find_secrets(docs: DataFrame, most: int = MOST) -> DataFrame:
    """RESULT: a row for each secret of each document; start and end count characters.

    layers names the encodings it lies in, outermost first, empty for none. The secret
    itself isn't in the result, only a digest. Null and empty texts give nothing; a
    null doc_id stays null; repeated rows are scanned each by itself. Other columns are
    not read. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for x in scan(t, most)]
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "kind", "layers", "start", "end", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).mapInArrow(run, RESULT)


def redact_documents(docs: DataFrame, text: str = "text", length: str = "n_chars", mask: str = MASK, most: int = MOST) -> DataFrame:
    """The documents with secrets masked in their text, and the length column, if there is one, brought up to date.

    All rows and columns stay, whatever their names. Null and empty texts stay as they
    are, and so does the length beside a text without secrets, right or wrong. Repeated
    rows are masked alike. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index(text)
    n_at = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t if not t else redact(t, mask, most) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if n_at is not None:
                cols[n_at] = pa.array([n if x is y or x == y else len(y) for n, x, y in zip(b.column(n_at).to_pylist(), old, new)], b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)

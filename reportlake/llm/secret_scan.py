"""Secret scans through nested encodings.

Every text starts a worklist as its layer 0. A layer is scanned for secrets;
then its encoded stretches are unwrapped, each into a new layer:

* URL escapes (``%41``, ``%u0041``) and Unicode escapes (``\\u0041``, ``\\x41``,
  ``\\U00000041``), decoded in place, so every decoded character knows the stretch
  it came from; bytes that are no UTF-8 become a mark. What is nested more than
  ``LEVELS`` deep is decoded to the end in one pass: no escape's characters can be
  part of a secret, so what an inner level shows the last one shows too;
* base64 runs (standard and URL-safe alphabets, also wrapped over lines): each
  is decoded from all four places of its character grid, so a prefix glued to
  it does no harm, and every printable stretch (of single bytes or of UTF-16)
  that is long enough for a secret is a layer, whatever bytes stand beside it;
* compressed streams (gzip, zlib, Zstandard) that start anywhere in a run, with
  all they inflate to before they end or break off, as windows that overlap.

All that is looked for is ASCII, so bytes beyond it only part the stretches.

New layers join the worklist, the last one first, until none is left, so few
are held at a time. A layer whose text was already seen in the same document
with the same origins is not entered again (its digest is remembered), so cycles
end (equal texts of two places are both entered); each decoding shortens a text
or inflates a stream, so the rest ends too. Spans found in a layer are mapped back, layer by layer, to the
smallest stretch of the document that holds them.

One pass over the documents, no shuffle. Only texts that hold an encoded
stretch or a secret cost more than a few pattern searches.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reportlake.llm.common import map_rows

KINDS = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII)
_ASSIGN_GATE = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal: a match starts where a run does and takes all of it

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNI = re.compile(r"[\\%]u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}")
#: Any escape at the end of a text.
_TAIL = re.compile(r"(?:%|\\x)([0-9A-Fa-f]{2})$|[\\%]u([0-9A-Fa-f]{4})$|\\U([0-9A-Fa-f]{8})$")
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
#: Levels of nested escapes that are layers of their own.
LEVELS = 8
_MARK = "\ufffd"
#: A run of base64 characters, whole or wrapped over lines (indented or not).
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*"
                  r"|[A-Za-z0-9+/_-]+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+)={0,2}")
_B64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_STANDARD = str.maketrans("-_", "+/")
#: Characters of a run and bytes of a stretch that are long enough to hold a secret (``token=`` and six more).
MIN_RUN, MIN_BYTES = 16, 12
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % MIN_BYTES)
#: The same in UTF-16, of either byte order.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){%d,}[\t\n\r\x20-\x7e]\0?" % (MIN_BYTES - 1))
#: How gzip, zlib (without a dictionary) and Zstandard streams start in base64.
_STREAM = re.compile(r"(?=H4sI|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])|KLUv/[Q-Za-f])")
#: Characters of a run inflated at once.
_STEP = 256

#: Bytes of an inflated stream scanned at once, and how far each window reaches back into the last.
WINDOW, OVERLAP = 4 << 20, 1 << 16
#: A Zstandard stream that needs a larger window than this to be read at all is
#: reported as kind ``packed``.
MAX_ZSTD_WINDOW = 128 << 20


def scan(text: str) -> list[tuple[str, int, int]]:
    """Secrets of one layer: (kind, start, end), leftmost and non-overlapping per kind."""
    out = []
    lower = text.lower()
    if any(x in lower for x in _ASSIGN_GATE):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


@dataclass
class Layer:
    """A decoded text and the stretch of the document behind each part of it.

    ``pieces`` are (start in this text, end, start in the document, end, even);
    an even piece maps character by character, any other maps whole.
    """

    text: str
    pieces: list[tuple[int, int, int, int, bool]]
    path: tuple[str, ...]

    def key(self) -> bytes:
        """Equal for layers that hold the same text from the same places."""
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        digest.update(repr(self.pieces).encode())
        return digest.digest()

    def depth(self) -> int:
        """How many of the last decodings were escapes."""
        n = 0
        while n < len(self.path) and self.path[-1 - n] in ("url", "unicode"):
            n += 1
        return n

    def origin(self, start: int, end: int) -> tuple[int, int]:
        lo = hi = None
        for i in range(self._first(start), len(self.pieces)):
            a, b, x, y, even = self.pieces[i]
            if a >= end:
                break
            if b <= start:
                continue
            s, e = (x + max(start - a, 0), x + min(end, b) - a) if even else (x, y)
            lo = s if lo is None else min(lo, s)
            hi = e if hi is None else max(hi, e)
        return lo, hi

    def _first(self, start: int) -> int:
        lo, hi = 0, len(self.pieces)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.pieces[mid][1] <= start:
                lo = mid + 1
            else:
                hi = mid
        return lo


def _rewritten(layer: Layer, found: list[tuple[int, int, list[tuple[str, int, int]]]], name: str) -> Layer | None:
    """The layer's text with stretches replaced; ``found`` has each stretch and
    its decoded characters with the stretch of the layer behind each."""
    if not found:
        return None
    texts, pieces, at, last = [], [], 0, 0

    def keep(a: int, b: int) -> None:
        nonlocal at
        if a == b:
            return
        texts.append(layer.text[a:b])
        for i in range(layer._first(a), len(layer.pieces)):
            p, q, x, y, even = layer.pieces[i]
            if p >= b:
                break
            s, e = max(p, a), min(q, b)
            if s < e:
                pieces.append((at + s - a, at + e - a, *((x + s - p, x + e - p) if even else (x, y)), even))
        at += b - a

    for a, b, chars in found:
        keep(last, a)
        for c, s, e in chars:
            texts.append(c)
            pieces.append((at, at + len(c), *layer.origin(s, e), False))
            at += len(c)
        last = b
    keep(last, len(layer.text))
    return Layer("".join(texts), pieces, (*layer.path, name))


def _utf8_chars(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Characters of UTF-8 bytes, each with the stretch of its bytes; a mark for any other byte."""
    out, k = [], 0
    for c in raw.decode("utf-8", "surrogateescape"):
        odd = 0xDC80 <= ord(c) <= 0xDCFF
        n = 1 if odd else len(c.encode())
        out.append((_MARK if odd else c, spans[k][0], spans[k + n - 1][1]))
        k += n
    return out


def unwrap_nested(layer: Layer) -> Layer | None:
    """All escapes decoded to the end, in one pass: each character joins those
    already decoded, and whatever escape they end with is decoded at once."""
    out: list[tuple[str, int, int]] = []
    tail, decoded = "", False
    for at, c in enumerate(layer.text):
        out.append((c, at, at + 1))
        tail = tail[-9:] + c
        while c in _HEX_DIGITS and (m := _TAIL.search(tail)):
            code = int(m[1] or m[2] or m[3], 16)
            if 0xD800 <= code < 0xE000 or code > 0x10FFFF:
                break
            n = len(m[0])
            start, decoded = out[-n][1], True
            c = chr(code) if code < 128 or m[1] is None else _MARK
            del out[-n:]
            out.append((c, start, at + 1))
            tail = "".join(x for x, _, _ in out[-10:])
    if not decoded:
        return None
    found = [(a, b, [(c, a, b)]) for c, a, b in out if b - a > 1]
    return _rewritten(layer, found, "unicode")


def unwrap_url(layer: Layer) -> Layer | None:
    found = []
    if "%" in layer.text:
        for m in _URL.finditer(layer.text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            chars = _utf8_chars(raw, [(m.start() + 3 * i, m.start() + 3 * i + 3) for i in range(len(raw))])
            if chars:
                found.append((*m.span(), chars))
    return _rewritten(layer, found, "url")


def unwrap_unicode(layer: Layer) -> Layer | None:
    found = []
    if any(x in layer.text for x in ("\\u", "\\x", "\\U", "%u")):
        for m in _UNI.finditer(layer.text):
            code = int(m[0][2:], 16)
            if not 0xD800 <= code < 0xE000 and code <= 0x10FFFF:
                found.append((*m.span(), [(chr(code), *m.span())]))
    return _rewritten(layer, found, "unicode")


class TooLarge(Exception):
    pass


def _opened(head: bytes):
    """A reader of the compressed stream that starts here, None if none does."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard
        try:
            window = zstandard.get_frame_parameters(head).window_size
        except zstandard.ZstdError:
            return None
        if window > MAX_ZSTD_WINDOW:
            raise TooLarge
        return zstandard.ZstdDecompressor(max_window_size=MAX_ZSTD_WINDOW).decompressobj()
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    return None


class Inflated:
    """What the compressed streams at the start of a run hold, up to their end or to
    where they are damaged, piece by piece; ``used``, how many of the bytes belong
    to them, is known when all pieces are read."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.used = parts, 0

    def __iter__(self) -> Iterator[bytes]:
        fed, rest, d = 0, b"", None
        for part in itertools.chain(self.parts, [b""]):
            fed += len(part)
            rest += part
            # the longest head of a stream, but for the end of the run
            while len(rest) >= (18 if part else 4) or (rest and d is not None):
                if d is None:
                    d = _opened(rest)
                    if d is None:
                        self.used = fed - len(rest)
                        return
                kept = d.copy() if hasattr(d, "copy") else None
                try:
                    out = d.decompress(rest)
                except MemoryError:
                    raise
                except Exception:  # noqa: BLE001 - a damaged stream: byte by byte up to the damage
                    try:
                        for k in range(len(rest) if kept else 0):
                            yield kept.decompress(rest[k:k + 1])
                    except Exception:  # noqa: BLE001
                        pass
                    self.used = fed
                    return
                yield out
                rest = d.unused_data if d.eof else b""
                if d.eof:
                    d = None
        self.used = fed - len(rest)


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of all pieces in windows that overlap."""
    held, fresh = bytearray(), 0
    for piece in pieces:
        for k in range(0, len(piece), WINDOW):
            held += piece[k:k + WINDOW]
            fresh += len(piece[k:k + WINDOW])
            if len(held) >= WINDOW:
                yield bytes(held)
                held, fresh = held[-OVERLAP:], 0
    if fresh:
        yield bytes(held)


def _printable(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Printable stretches of bytes: text, first byte, bytes of a character."""
    for m in _PRINTABLE.finditer(raw):
        yield m[0].decode("ascii"), m.start(), 1
    if b"\0" in raw:
        for m in _WIDE.finditer(raw):
            yield m[0].replace(b"\0", b"").decode("ascii"), m.start(), 2


def _decoded(chars: str) -> bytes:
    """Bytes of base64 characters; a last character that holds no whole byte is left out."""
    chars = chars[:len(chars) - (len(chars) % 4 == 1)]
    return base64.b64decode(chars + "=" * (-len(chars) % 4))


def unwrap_base64(layer: Layer) -> Iterator[Layer | tuple[int, int]]:
    """Layers of the base64 runs; the stretch alone of a stream that cannot be read."""
    for m in _B64.finditer(layer.text):
        if m.end() - m.start() < MIN_RUN:
            continue
        lines = [x.span() for x in _B64_LINE.finditer(layer.text, *m.span())]
        run = "".join(layer.text[a:b] for a, b in lines).translate(_STANDARD)
        if len(run) < MIN_RUN:
            continue
        firsts = [0, *itertools.accumulate(b - a for a, b in lines)]

        def place(i: int, firsts=firsts, lines=lines) -> int:
            """Where a character of the run stands in the layer."""
            k = bisect.bisect_right(firsts, i) - 1
            return lines[k][0] + i - firsts[k]

        def origin(i: int, j: int, m=m, n=len(run), place=place) -> tuple[int, int]:
            return layer.origin(place(i), place(j - 1) + 1 if j < n else m.end())

        for shift in range(4):
            for text, first, step in _printable(_decoded(run[shift:])):
                # three bytes come from four characters; a character maps to the quantum of its byte
                quanta = [(first + step * k) // 3 for k in range(len(text))]
                cuts = [0, *[k for k in range(1, len(quanta)) if quanta[k] != quanta[k - 1]], len(quanta)]
                pieces = [(a, b, *origin(shift + 4 * quanta[a], min(shift + 4 * quanta[a] + 4, len(run))), False)
                          for a, b in zip(cuts[:-1], cuts[1:])]
                yield Layer(text, pieces, (*layer.path, "base64"))
        for start in (x.start() for x in _STREAM.finditer(run)):
            def inflated(start=start, run=run) -> Inflated:
                return Inflated(_decoded(run[i:i + _STEP]) for i in range(start, len(run), _STEP))

            try:
                whole = inflated()
                size = sum(map(len, whole))
            except TooLarge:
                yield origin(start, len(run))
                continue
            if size < MIN_BYTES:
                continue
            end = start + 4 * ((whole.used + 2) // 3)
            for window in _windows(inflated()):
                at = origin(start, min(end, len(run)))
                path = (*layer.path, "base64+inflate")
                text = window.decode("latin-1")
                yield Layer(text, [(0, len(text), *at, False)], path)
                for wide, _, step in _printable(window) if "\0" in text else ():
                    if step == 2:
                        yield Layer(wide, [(0, len(wide), *at, False)], path)


def find_secrets(text: str) -> list[tuple[str, int, int, str]]:
    """All secrets of a text: (kind, start, end, path of decodings), in code points.

    Spans of layer 0 have the path ``''``. A span found again in a deeper layer
    at the same place is reported once, with its shortest path.
    """
    found: dict[tuple[str, int, int], tuple[str, ...]] = {}

    def note(kind: str, span: tuple[int, int], path: tuple[str, ...]) -> None:
        before = found.get((kind, *span))
        if before is None or (len(path), path) < (len(before), before):
            found[(kind, *span)] = path

    def below(layer: Layer) -> Iterator[Layer]:
        if layer.depth() >= LEVELS:
            made = (unwrap_nested(layer),)
        else:
            made = (unwrap_url(layer), unwrap_unicode(layer))
        yield from (x for x in made if x is not None)
        for x in unwrap_base64(layer):
            if isinstance(x, Layer):
                yield x
            else:
                note("packed", x, (*layer.path, "base64"))

    first = Layer(text, [(0, len(text), 0, len(text), True)], ())
    seen = {first.key()}
    for kind, a, b in scan(text):
        note(kind, (a, b), ())
    work = [below(first)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = layer.key()
        if key not in seen:
            seen.add(key)
            for kind, a, b in scan(layer.text):
                note(kind, layer.origin(a, b), layer.path)
            work.append(below(layer))
    return sorted(((k, s, e, "/".join(p)) for (k, s, e), p in found.items()),
                  key=lambda x: (x[1], _ORDER.get(x[0], len(KINDS)), x[2], x[0]))


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each text; one row per input row.

    Columns: the id; ``secrets``, an array of (kind, start, end, path) sorted
    by start and kind; ``n_assign``, ``n_access``, ``n_hex`` and
    ``base_sha256`` over the spans of the text itself; ``spans``, all of them
    as ``kind:start:end`` joined by commas.

    A null or empty text has no secrets. A null id is kept; repeated rows give
    repeated results, an empty table an empty one; other columns are not read,
    whatever their names. Texts are scanned whole, and so are streams, whatever
    they inflate to (window by window); a Zstandard stream that needs more than
    ``MAX_ZSTD_WINDOW`` to be read is itself reported, as kind ``packed``.
    """
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("secrets", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in cols["_text"]:
            spans = find_secrets(text or "")
            base = [x for x in spans if x[3] == "" and x[0] in _ORDER]
            out["secrets"].append([{"kind": k, "start": s, "end": e, "path": p} for k, s, e, p in spans])
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(x[0] == kind for x in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(spans))
        return out | {"_id": cols["_id"]}

    id_type = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                   f"_id {id_type}, secrets array<struct<kind:string,start:bigint,end:bigint,path:string>>, "
                   "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("_id", id_col)


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """The text with every secret replaced; overlapping spans become one mark."""
    out, last = [], 0
    merged: list[list[int]] = []
    for _, s, e, _ in sorted(find_secrets(text), key=lambda x: x[1]):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[last:s], mark]
        last = e
    return "".join([*out, text[last:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret of ``text_col`` replaced by ``mark``.

    All rows and columns stay; null, empty and clean texts are unchanged, and null
    ids and other columns, of any name and type, are not looked at. Repeated rows
    give repeated results, an empty table an empty one. Overlapping secrets become
    one mark. Texts are scanned whole."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None or not isinstance(x, str) else redact(x, mark))

    return docs.withColumn(text_col, clean(F.col(text_col)))

r"""Secret scans through encoded layers.

A text is scanned for three kinds of secrets. Then a worklist unwraps what is encoded in it: percent escapes, Unicode and
character escapes, base64, and compressed data inside base64. Each layer is scanned in turn and unwrapped further until
nothing new appears; a layer whose text was seen before at the same place is not taken up again, which ends cycles. Each
character of a layer knows which characters of the whole text it came from, so that what is found is reported as a span of
the document.

Escapes are unwrapped line by line, as no secret spans lines; base64 token by token, a line's by itself and lines of one
length with a shorter last one together. Bytes are read from all four places of a token where a group may begin, as a name
or a path may stand before it, and scanned with errors replaced, and without zero bytes (UTF-16). Compressed data may begin
anywhere in a token; all members that follow each other are read. They are unwrapped in windows of ``WINDOW`` characters that
overlap by ``OVERLAP``; a base64 token that goes on behind its window is read as a stream, from its beginning. What is left
out are single secrets longer than the overlap, and base64 that is itself escaped (percent, Unicode) and both longer than the
overlap and cut by a window's end. All of it maps to the span of its token. What a layer holds is gone through before the next
is made, so that memory is that of a few windows for each depth of nesting, whatever the data inflate to.

Base spans (layer 0) are leftmost and do not overlap within a kind. Defined results: a null or empty text has no spans. The
same span found in several layers counts once, for the outermost. Repeated rows and null ids are scanned each. A table
without rows gives no rows. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
WINDOW, OVERLAP = 1 << 20, 1 << 12

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: An escaped percent sign, escaped again and again, is unwrapped at once: nothing but percent signs and digits lies between.
PERCENT_CHAIN = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")
ESCAPE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|&(?:quot|apos|amp|lt|gt|colon|equals|period|lowbar|sol|plus|hyphen);)+")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|(&[^;]+;)")
#: Wide forms of ASCII, and characters without width.
WIDE = re.compile("[\uff01-\uff5e\u200b-\u200d\u2060\ufeff\u00ad]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Lines that may be a wrapped block; those of one length, and a shorter last one, are taken together.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{60,}+\r?\n)++(?:[A-Za-z0-9+/_-]++={0,2})?")
ONE_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
STANDARD = str.maketrans("-_", "+/")
#: Where compressed data begin in base64, at any place of a token: the first bytes fill these characters.
PACKED = re.compile(r"(?=(H4sI)|(Qlpo)|(/Td6WF)|(KLUv/[Q-Za-f])|(eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]))")
NULS, LONE = re.compile("\\0+"), re.compile("[\\udc80-\\udcff]")
PACKERS = ("gzip", "bz2", "xz", "zstd", "zlib")


def scan(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Layer:
    """A text whose i-th character came from the characters starts[i] to ends[i] of the document."""

    __slots__ = ("at", "before", "ends", "more", "starts", "stream", "text")

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends, self.stream = text, starts, ends, None


def _replaced(text: str, starts, ends, pattern: re.Pattern, unwrap) -> Layer | None:
    """Each match becomes what unwrap gives: a list of (characters, from, to) within it, or None to leave it."""
    out, last = [], 0
    s, e = _map(starts), _map(ends)
    for m in pattern.finditer(text):
        new = unwrap(m)
        if new is None:
            continue
        out.append(text[last : m.start()])
        s.take(starts, last, m.start())
        e.take(ends, last, m.start())
        for chars, a, b in new:
            out.append(chars)
            s.add(starts[m.start() + a], len(chars))
            e.add(ends[m.start() + b - 1], len(chars))
        last = m.end()
    if not out:
        return None
    out.append(text[last:])
    s.take(starts, last, len(text))
    e.take(ends, last, len(text))
    return Layer("".join(out), s, e)


def _percent(m: re.Match):
    raw, out, at = binascii.unhexlify(m[0].replace("%", "")), [], 0
    while at < len(raw):
        n = 1 if raw[at] < 0x80 else 2 if raw[at] >> 5 == 6 else 3 if raw[at] >> 4 == 14 else 4 if raw[at] >> 3 == 30 else 1
        try:
            char = raw[at : at + n].decode()
        except UnicodeDecodeError:
            n, char = 1, raw[at : at + 1].decode("latin-1")
        out.append((char, 3 * at, 3 * min(len(raw), at + n)))
        at += n
    return out


def _escape(m: re.Match):
    out, units = [], []
    for x in ONE_ESCAPE.finditer(m[0]):
        a, b = x.span()
        if x[3]:
            char = html.unescape(x[3])
        else:
            code = int(x[1] or x[2], 16)
            char = chr(code) if code < 0x110000 else "\ufffd"
        if units and "\ud800" <= units[-1][0] < "\udc00" and "\udc00" <= char < "\ue000":  # a surrogate pair is one character
            high, begin, _ = units.pop()
            out[-1] = (chr(0x10000 + ((ord(high) - 0xD800) << 10) + ord(char) - 0xDC00), begin, b)
            continue
        units.append((char, a, b))
        out.append((char, a, b))
    return [("\ufffd" if len(c) == 1 and "\ud800" <= c < "\ue000" else c, a, b) for c, a, b in out]


def _wide(m: re.Match):
    chars = unicodedata.normalize("NFKC", m[0]) if "\uff01" <= m[0] <= "\uff5e" else ""
    return [(chars, 0, 1)]


def _decompressor(kind: str):
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
    if kind in ("gzip", "zlib"):
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor(memlimit=1 << 27)


def inflated(chunks: Iterator[bytes], kind: str) -> Iterator[bytes]:
    """The contents of compressed data, piece by piece, of all members that follow each other."""
    try:
        d = _decompressor(kind)
        for chunk in chunks:
            # zstd gives all that its input holds: 256 bytes are at most 8 MiB.
            for rest in (chunk[i : i + 256] for i in range(0, len(chunk), 256)) if kind == "zstd" else (chunk,):
                while True:
                    if d.eof:
                        rest = rest.lstrip(b"\0")  # padding
                        if not rest:
                            break
                        d = _decompressor(kind)
                    piece = d.decompress(rest) if kind == "zstd" else d.decompress(rest, WINDOW)
                    if piece:
                        yield piece
                    rest = d.unused_data if d.eof else d.unconsumed_tail if kind in ("gzip", "zlib") else b""
                    if not rest and (d.eof or kind == "zstd" or len(piece) < WINDOW):
                        break
    except Exception as broken:  # noqa: BLE001  data that break off give what came before
        if not isinstance(broken, (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)) and type(broken).__name__ != "ZstdError":
            raise


def _bytes_of(clean: str) -> bytes:
    """Base64 without padding; a last character that makes no byte is left out."""
    clean = clean[: len(clean) - (len(clean) % 4 == 1)]
    return base64.b64decode(clean + "=" * (-len(clean) % 4))


def _chunks(texts: Iterator[str]) -> Iterator[bytes]:
    """The bytes of base64 that comes in parts."""
    held = ""
    for text in texts:
        held += text
        n = len(held) // 4 * 4
        for i in range(0, n, 1 << 16):
            yield base64.b64decode(held[i : min(n, i + (1 << 16))])
        held = held[n:]
    if len(held) > 1:
        yield _bytes_of(held)


def _texts(chunks: Iterator[bytes]) -> Iterator[str]:
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    for chunk in chunks:
        if text := decode(chunk):
            yield text
    if text := decode(b"", True):
        yield text


class Stream:
    """A text that can be read again from its beginning, in windows; ``parts`` gives an iterator over its parts."""

    def __init__(self, parts, start: int, end: int):
        self.parts, self.start, self.end = parts, start, end

    def layers(self) -> Iterator[Layer]:
        held, at, before = "", 0, ""
        for part in self.parts():
            held += part
            while len(held) > WINDOW + OVERLAP:
                yield self._layer(held[: WINDOW + OVERLAP], at, before, True)
                held, at, before = held[WINDOW:], at + WINDOW, held[WINDOW - 1]
        if held:
            yield self._layer(held, at, before, False)

    def _layer(self, text: str, at: int, before: str, more: bool) -> Layer:
        layer = Layer(text, _Same(self.start), _Same(self.end))
        layer.stream, layer.at, layer.before, layer.more = self, at, before, more
        return layer

    def token(self, at: int) -> Iterator[str]:
        """The characters of the base64 token that begins at a place."""
        place = 0
        for part in self.parts():
            if place + len(part) > at:
                own = part[max(0, at - place) :]
                run = TOKEN_PART.match(own)[0]
                yield run.translate(STANDARD)
                if len(run) < len(own):
                    return
            place += len(part)


TOKEN_PART = re.compile(r"[A-Za-z0-9+/_-]*")


def _cut(texts: Iterator[str], n: int) -> Iterator[str]:
    for text in texts:
        yield text[n:]
        n = max(0, n - len(text))


def _packed(clean: str) -> Iterator[tuple[int, str]]:
    """(place, kind) of what may be compressed data in base64."""
    for x in PACKED.finditer(clean):
        kind = PACKERS[x.lastindex - 1]
        if kind == "zlib":  # three characters that come by chance, too
            try:
                zlib.decompressobj().decompress(_bytes_of(clean[x.start() : x.start() + 256]), 1 << 12)
            except zlib.error:
                continue
        yield x.start(), kind


def _open_token(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """What is in a token that goes on behind its window: it's read as a stream, from each place where data may begin."""
    stream, at = layer.stream, layer.at + m.start()
    again = lambda n, kind: lambda: _texts(inflated(_chunks(_cut(stream.token(at), n)), kind) if kind else _chunks(_cut(stream.token(at), n)))
    for n in range(4):
        yield from Stream(again(n, None), stream.start, stream.end).layers()
    held, place = "", 0
    for text in stream.token(at):
        held += text
        for n, kind in _packed(held):
            if n + 8 <= len(held):
                yield from Stream(again(place + n, kind), stream.start, stream.end).layers()
        done = max(0, len(held) - 7)
        held, place = held[done:], place + done


def _tokens(text: str) -> Iterator[tuple[int, int, str, list | range]]:
    """(start, end, characters, their places) of each line's base64 tokens and of wrapped blocks."""
    for m in BASE64.finditer(text):
        clean = m[0].rstrip("=")
        yield m.start(), m.end(), clean.translate(STANDARD), range(m.start(), m.start() + len(clean))
    for m in WRAPPED.finditer(text):
        lines, i = [(x.start(), x.end()) for x in ONE_LINE.finditer(text, m.start(), m.end())], 0
        size = lambda j: lines[j][1] - lines[j][0]
        while i < len(lines):
            j = i + 1
            while j < len(lines) and size(j) == size(i):
                j += 1
            last = j + (j < len(lines) and size(j) < size(i))
            for stop in {j, last}:  # with a shorter line behind, and without, as it may be a word
                if stop - i > 1:
                    places = [k for a, b in lines[i:stop] for k in range(a, b) if text[k] != "="]
                    yield lines[i][0], lines[stop - 1][1], "".join(text[k] for k in places).translate(STANDARD), places
            i = j


def _matters(text: str) -> bool:
    """Whether something may be found in a text, or in what it unwraps to."""
    return ":" in text or "=" in text or "%" in text or "\\" in text or "&" in text or "\0" in text or "AKIA" in text or bool(HEX.search(text) or BASE64.search(text) or WIDE.search(text))


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    text, starts, ends = layer.text, layer.starts, layer.ends
    if "%" in text and PERCENT.search(text) or "\\" in text or "&" in text or not text.isascii() and WIDE.search(text):
        at = 0
        for line in text.split("\n"):
            s, e = _Part(starts, at), _Part(ends, at)
            at += len(line) + 1
            if "%" in line:
                short = _replaced(line, s, e, PERCENT_CHAIN, lambda m: [("%", 0, len(m[0]))] if len(m[0]) > 3 else None) or Layer(line, s, e)
                if new := _replaced(short.text, short.starts, short.ends, PERCENT, _percent):
                    yield new
            if ("\\" in line or "&" in line) and (new := _replaced(line, s, e, ESCAPE, _escape)):
                yield new
            if not line.isascii() and (new := _replaced(line, s, e, WIDE, _wide)):
                yield new
    if "\0" in text and (new := _replaced(text, starts, ends, NULS, lambda m: [])):  # UTF-16 and UTF-32
        yield new
    for start, end, clean, places in _tokens(text):
        if layer.stream and start == 0 and layer.before and TOKEN_PART.fullmatch(layer.before):
            continue  # began in the window before, which has followed it
        if layer.stream and layer.more and end == len(text) and isinstance(places, range):
            yield from _open_token(layer, BASE64.match(text, start))
            continue
        for n, kind in _packed(clean):
            parts = lambda n=n, kind=kind, clean=clean: _texts(inflated(_chunks(iter([clean[n:]])), kind))
            yield from Stream(parts, starts[places[n]], ends[end - 1]).layers()
        # A token may begin with a name or path: bytes are read from all four places where a group can begin.
        for n in range(4):
            plain = _bytes_of(clean[n:]).decode("utf-8", "surrogateescape")
            if not _matters(plain):
                continue
            s, e, byte = _map(starts), _map(ends), 0
            if isinstance(s, _Same):
                yield Layer(LONE.sub("\ufffd", plain), s, e)
                continue
            for c in plain:
                size = 1 if c < "\x80" or "\udc80" <= c < "\udd00" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                s.add(starts[places[n + byte * 8 // 6]], 1)
                e.add(ends[places[n + ((byte + size) * 8 - 1) // 6]], 1)
                byte += size
            yield Layer(LONE.sub("\ufffd", plain), s, e)


def find(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, layer) of every secret, each span once, for the least layer."""
    if not text:
        return []
    found = {x: 0 for x in scan(text)}
    if not ("%" in text or "\\" in text or "&" in text or BASE64.search(text) or not text.isascii() and WIDE.search(text)):
        return [(*x, 0) for x in found]
    # The layer at which a text was seen at a place; one that comes again further out is gone through again.
    seen: dict[bytes, int] = {}
    # A layer's contents are taken up before the next layer is made: what is held is one layer of each depth.
    work = [_unwrapped(Layer(text, _Own(0), _Own(1)))]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        if not new.text:
            continue
        depth = len(work)
        key = hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16, key=b"%d:%d" % (new.starts[0], new.ends[len(new.text) - 1])).digest()
        if seen.get(key, depth + 1) <= depth:
            continue
        seen[key] = depth
        for kind, a, b in scan(new.text):
            span = kind, new.starts[a], new.ends[b - 1]
            found[span] = min(found.get(span, depth), depth)
        work.append(_unwrapped(new))
    return [(*x, n) for x, n in found.items()]


class _Same:
    """One place for all characters."""

    def __init__(self, place: int):
        self.place = place

    def __getitem__(self, at: int) -> int:
        return self.place

    def take(self, places, first: int, last: int) -> None:
        pass

    def add(self, place: int, n: int) -> None:
        pass


class _Own:
    """The places of a document's own characters, without a list of them."""

    def __init__(self, shift: int):
        self.shift = shift

    def __getitem__(self, at: int) -> int:
        return at + self.shift


class _Part:
    """Places from one of them on."""

    def __init__(self, places, first: int):
        self.places, self.first = places, first

    def __getitem__(self, at: int) -> int:
        return self.places[self.first + at]


class _Listed:
    """Places one by one."""

    def __init__(self) -> None:
        self.places = array("i")

    def __getitem__(self, at: int) -> int:
        return self.places[at]

    def take(self, places, first: int, last: int) -> None:
        while isinstance(places, _Part):
            places, first, last = places.places, first + places.first, last + places.first
        self.places.extend(range(first + places.shift, last + places.shift) if isinstance(places, _Own) else places.places[first:last])

    def add(self, place: int, n: int) -> None:
        self.places.extend([place] * n)


def _map(places):
    """A new map of characters that come from these."""
    while isinstance(places, _Part):
        places = places.places
    return places if isinstance(places, _Same) else _Listed()


def _rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.int32())]))
    for batch in batches:
        spans = [
            [{"kind": k, "start": a, "end": b, "layer": n} for k, a, b, n in sorted(find(t.as_py()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))] for t in batch.column(1)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; a span has kind, start, end (code points, end exclusive) and layer (0: the text itself)."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_rows, "doc_id long, spans array<struct<kind:string,start:int,end:int,layer:int>>")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["layer"] == 0))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))

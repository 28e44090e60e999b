"""Splitting oversized texts at natural boundaries (problem 1).

The text becomes a tree: sections under headings, in them fences, tables, lists and paragraphs, in those
rows, items or sentences, then words, then characters. Sibling subtrees are merged from the bottom up while
they fit the limit, and only a node above the limit is descended into. Each piece but the first starts with
the end of the one before. The pieces' new parts, in order, are the text, octet for octet.

Defined results: a null text has no pieces; null path, ordinal or start are allowed (then the offset into the
body is found again, and null only if the text isn't in the body or there is no body); repeated rows count
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(rb"^#{1,6}[ \t]", re.M)
FENCE = re.compile(rb"^[ ]{0,3}(```+|~~~+)", re.M)
BLANK = re.compile(rb"\n[ \t\r]*\n[ \t\r\n]*")
LINE = re.compile(rb"[^\n]*\n|[^\n]+")
ITEM = re.compile(rb"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]")
SENTENCE = re.compile(rb"[.!?\xbb][\"')\]]*[ \t\r\n]+|[;:][ \t\r\n]+")
WORD = re.compile(rb"[ \t\r\n]+")
#: Kinds of nodes, from the coarsest; a node's parts are of the next kind that divides it.
SECTION, BLOCK, SUBBLOCK, SPAN, TOKEN, CHAR = range(6)


def _cuts(data: bytes, start: int, end: int, kind: int) -> list[int]:
    """Inner boundaries of data[start:end] at one level of the tree."""
    part = data[start:end]
    if kind in (SECTION, BLOCK):
        fenced = _fences(part)
        free = lambda at: not any(a < at < b for a, b in fenced)
        if kind == SECTION:
            heads = [(m.start(), len(m[0]) - 1) for m in HEADING.finditer(part) if free(m.start())]
            inner = [h for h in heads if h[0] > 0]
            top = min((level for _, level in inner), default=0)
            return [start + at for at, level in inner if level == top]
        cuts = [m.end() for m in BLANK.finditer(part) if free(m.start() + 1)] + [x for a, b in fenced for x in (a, b)]
        return [start + at for at in sorted(set(cuts)) if 0 < at < len(part)]
    if kind == SUBBLOCK:  # items with what is nested in them, or else lines (of tables and code too)
        lines = [m.start() for m in LINE.finditer(part)][1:]
        depth = [(at, len(m[1])) for at in [0, *lines] if (m := ITEM.match(part, at))]
        if len(depth) > 1:
            top = min(d for _, d in depth)
            items = [at for at, d in depth if d == top and at]
            if items:
                return [start + at for at in items]
        return [start + at for at in lines]
    if kind in (SPAN, TOKEN):
        return [start + m.end() for m in (SENTENCE if kind == SPAN else WORD).finditer(part) if 0 < m.end() < len(part)]
    return []


def _fences(part: bytes) -> list[tuple[int, int]]:
    """Fenced code, with the line ends; an open fence runs to the end."""
    out, open_, mark = [], -1, b""
    for m in FENCE.finditer(part):
        if open_ < 0:
            open_, mark = m.start(), m[1]
        elif m[1][:1] == mark[:1] and len(m[1]) >= len(mark):
            stop = part.find(b"\n", m.end())
            if not part[m.end() : stop if stop >= 0 else len(part)].strip():
                out.append((open_, stop + 1 if stop >= 0 else len(part)))
                open_ = -1
    if open_ >= 0:
        out.append((open_, len(part)))
    return out


def _char_start(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _units(data: bytes, start: int, end: int, room: int, kind: int = SECTION) -> list[tuple[int, int]]:
    """Consecutive groups of subtrees of at most ``room`` octets."""
    if end - start <= room:
        return [(start, end)]
    while kind < CHAR and not (cuts := _cuts(data, start, end, kind)):
        kind += 1
    if kind == CHAR:  # one word above the limit: as many whole characters as fit
        out = []
        while end - start > room:
            cut = start + room
            while data[cut] & 0xC0 == 0x80 and cut > start:
                cut -= 1
            out.append((start, cut if cut > start else start + room))
            start = out[-1][1]
        return [*out, (start, end)]
    edges = [start, *cuts, end]
    below = kind if kind == SECTION else kind + 1
    merged: list[tuple[int, int]] = []
    for a, b in zip(edges, edges[1:]):
        for unit in _units(data, a, b, room, below):
            if merged and unit[1] - merged[-1][0] <= room:
                merged[-1] = (merged[-1][0], unit[1])
            else:
                merged.append(unit)
    return merged


def split_text(data: bytes, limit_octets: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece in the octets of a text; only the parts after the overlap are new."""
    if len(data) <= limit_octets:
        return [(0, len(data))]
    room = max(limit_octets - overlap, 4)
    out: list[tuple[int, int]] = []
    for _, end in _units(data, 0, len(data), room):
        begin = _char_start(data, max(out[-1][0], out[-1][1] - overlap)) if out else 0
        out.append((begin, end))
    return out


#: White space that the project trims from blocks: the Unicode property White_Space.
SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
GAP = re.compile(r"\n\n+")


def body_blocks(body: str) -> list[tuple[int, bytes]]:
    """Trimmed blocks between blank lines, each with its octet offset in the body."""
    out, at, octets = [], 0, 0
    for m in [*GAP.finditer(body), None]:
        raw = body[at : m.start() if m else len(body)]
        left = raw.lstrip(SPACE)
        if left:
            out.append((octets + len(raw[: len(raw) - len(left)].encode()), left.rstrip(SPACE).encode()))
        if m:
            octets += len(raw.encode()) + len(m[0])
            at = m.end()
    return out


def body_chunks(body: str, budget: int) -> list[list[tuple[int, bytes]]]:
    """The project's chunks, each as its blocks; a heading or a full budget starts the next."""
    out: list[list[tuple[int, bytes]]] = []
    size = 0
    for block in body_blocks(body):
        more = len(block[1])
        if not out or block[1][:1] == b"#" or (size // 3 + 1) + (more // 3 + 1) > budget:
            out.append([block])
            size = more
        else:
            out[-1].append(block)
            size += 2 + more
    return out


def _locate(body: str | None, chunks: list[list[tuple[int, bytes]]], ordinal: int | None, start: int | None, text: bytes):
    """A function from an offset in the chunk to one in the body, or None."""
    if body is None:
        return None
    own = chunks[ordinal] if ordinal is not None and 0 <= ordinal < len(chunks) else None
    if own is None or b"\n\n".join(b for _, b in own) != text:
        same = [c for c in chunks if b"\n\n".join(b for _, b in c) == text]
        own = min(same, key=lambda c: abs(c[0][0] - (start or 0))) if same else None
    if own is not None:
        inner, places = 0, []
        for offset, block in own:
            places.append((inner, inner + len(block), offset))
            inner += len(block) + 2

        def place(at: int) -> int:
            for a, b, offset in places:
                if at < b:
                    return offset + max(0, at - a)
            return places[-1][2] + places[-1][1] - places[-1][0]

        return place
    data = body.encode()
    found, at = [], data.find(text)
    while at >= 0 and text:
        found.append(at)
        at = data.find(text, at + 1)
    if found:
        near = min(found, key=lambda x: abs(x - (start or 0)))
        return lambda at: near + at
    spots = [i for i, c in enumerate(data) if c not in b" \t\r\n"]  # the same but for white space
    flat, want = bytes(data[i] for i in spots), bytes(c for c in text if c not in b" \t\r\n")
    at = flat.find(want) if want else -1
    if at < 0:
        return None
    before = [0]
    for c in text:
        before.append(before[-1] + (c not in b" \t\r\n"))
    return lambda x: spots[min(at + before[x], len(spots) - 1)]


SCHEMA = "path string, ordinal int, piece int, pieces int, chunk_start int, body_start bigint, octets int, text string"


def _pieces(limit: int, overlap: int):
    limit_octets = limit * 3 - 1  # the largest size with octets div 3 + 1 <= limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            for row in range(batch.num_rows):
                path, body, rows = (batch.column(x)[row].as_py() for x in ("path", "body", "rows"))
                chunks = body_chunks(body, limit) if body is not None else []
                done, out = set(), []
                for x in sorted(rows, key=lambda x: (x["ordinal"] is None, x["ordinal"] or 0, x["text"], x["start"] or 0)):
                    if x["ordinal"] in done and x["ordinal"] is not None:
                        continue
                    done.add(x["ordinal"])
                    data = x["text"].encode()
                    place = _locate(body, chunks, x["ordinal"], x["start"], data)
                    cut = split_text(data, limit_octets, overlap)
                    out += [(path, x["ordinal"], k, len(cut), a, place(a) if place else None, b - a, data[a:b].decode()) for k, (a, b) in enumerate(cut)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def split_oversized(chunks: DataFrame, notes: DataFrame, limit: int = 450, overlap: int = 120) -> DataFrame:
    """The pieces of every chunk with ``octets div 3 + 1 > limit``: path, ordinal, piece (from 0), pieces,
    chunk_start (octets into the chunk), body_start (octets into the note's body), octets, text.

    The chunks of a note are handled 64 ordinals at a time, so that a huge note is neither one task's work nor
    repeated for each of its chunks; those without ordinal or path are spread by what they hold."""
    big = chunks.select("path", "ordinal", "start", "text").where((F.floor(F.octet_length("text") / 3) + 1) > limit)
    grouped = big.groupBy("path", F.coalesce(F.floor(F.col("ordinal") / 64), F.pmod(F.xxhash64("start", "text"), F.lit(1024))).alias("run"), F.when(F.col("path").isNull(), F.pmod(F.xxhash64("text"), F.lit(1024))).alias("part")).agg(F.collect_set(F.struct("ordinal", "start", "text")).alias("rows"))
    bodies = notes.select("path", "body").join(big.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.max("body").alias("body"))
    return grouped.join(bodies, "path", "left").select("path", "body", "rows").mapInArrow(_pieces(limit, overlap), SCHEMA)

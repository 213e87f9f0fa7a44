"""Splitting oversized markdown at natural boundaries, by lexical cohesion.

A text is a list of blocks (what blank lines separate; a code fence is one block). Between two blocks, and inside a block
too long for a piece between its lines, sentences and words, lie the places where it may be cut. Each place has a depth: how
far the similarity of the words on its two sides falls below the peaks around it (block comparison with a sliding window),
raised where a heading follows. Pieces are filled from the left; within the last part of each size window the deepest valley
is the cut. A block that fits into a piece is never cut inside. Each piece carries the text before it as overlap, cut back
to a natural start, and the path of headings it lies under.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from pagelattice.llm.leakage import words

#: Words looked at on each side of a gap, and the part of the window, from its end, in which a cut is looked for: a piece
#: that is cut off has at least half the limit, whatever valleys lie before.
SIDE, REACH = 40, 0.5
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})(.*)")
_HEAD = re.compile(r"[ \t]{0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
#: Places inside a long block from the most to the least natural.
_INSIDE = [re.compile(r"\n"), re.compile(r"(?<=[.!?…؟।])[\"”’»)\]]*\s+|(?<=[。！？｡])[”’」』）]*"), re.compile(r"(?<=[,;:，；：、])\s*"), re.compile(r"\s+")]


@dataclass
class Block:
    start: int
    end: int
    number: int
    heading: int = 0
    title: str = ""


@dataclass
class Piece:
    start: int
    end: int
    path: str
    first: int
    last: int
    cut: bool


def unify(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def blocks(text: str) -> list[Block]:
    """Blocks of a text with ``\\n`` line ends, from their first to their last visible character."""
    out: list[Block] = []
    at, start, fence = 0, None, None

    def close(end: int) -> None:
        nonlocal start
        if start is not None:
            body = text[start:end]
            b = Block(start + len(body) - len(body.lstrip()), start + len(body.rstrip()), len(out) + 1)
            first = text[b.start : b.end].split("\n", 1)[0]
            if h := _HEAD.match(first):
                b.heading, b.title = len(h[1]), h[2]
            out.append(b)
            start = None

    for line in text.split("\n"):
        end = at + len(line)
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
                close(end)
        elif not line.strip():
            close(at)
        elif (m := _FENCE.match(line)) and not ("`" in m[2] and m[1][0] == "`"):
            close(at)
            start, fence = at, m[1]
        elif start is None:
            start = at
        at = end + 1
    close(len(text))
    return out


def _bag(tokens: list[str]) -> Counter:
    return Counter(t for t in tokens if len(t) > 2 or ord(t[0]) > 0x2E7F)


def _cosine(a: Counter, b: Counter) -> float:
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def depths(parts: list[list[str]]) -> list[float]:
    """For each gap between two parts (lists of words) how deep its valley of similarity is.

    The words of a side are the SIDE words next to the gap, across parts. A peak is where the similarities, followed from
    the gap to one side, rise no further; one pass from each end finds them all.
    """
    flat = [w for p in parts for w in p]
    sims, at = [], 0
    for p in parts[:-1]:
        at += len(p)
        sims.append(_cosine(_bag(flat[max(0, at - SIDE) : at]), _bag(flat[at : at + SIDE])))
    peaks = []
    for order in (sims, sims[::-1]):
        top: list[float] = []
        for i, s in enumerate(order):
            top.append(top[-1] if i and order[i - 1] >= s else s)
        peaks.append(top)
    return [left + right - 2 * s for s, left, right in zip(sims, peaks[0], reversed(peaks[1]), strict=True)]


def _visible_end(text: str, start: int, end: int) -> int:
    """``end`` moved back over blanks, not beyond ``start``."""
    while end > start and text[end - 1].isspace():
        end -= 1
    return end


def inside(text: str, b: Block, size: int) -> list[tuple[int, int]]:
    """Cuts of a block longer than ``size`` into spans of at most ``size``: the deepest valley among the places of the best kind in each window."""
    out, at = [], b.start
    while b.end - at > size:
        for kind in _INSIDE:
            found = [m.end() for m in kind.finditer(text, at + int(size * (1 - REACH)), min(at + size + 1, b.end)) if at < m.end() < b.end and _visible_end(text, at, m.end()) <= at + size]
            if len(found) > 1:
                spans = [at, *found, min(b.end, at + 2 * size)]
                d = depths([words(text[x:y]) for x, y in zip(spans, spans[1:], strict=False)])
                found = [max(zip(found, d, strict=True), key=lambda p: (round(p[1], 6), p[0]))[0]]
            if found:
                nxt = found[0]
                break
        else:
            nxt = at + size
        stop = _visible_end(text, at, nxt)
        if stop <= at:
            stop = nxt = at + size
        out.append((at, stop))
        at = nxt
        while at < b.end and text[at].isspace():
            at += 1
    if at < b.end:
        out.append((at, b.end))
    return out


def split(text: str, size: int) -> list[Piece]:
    """Pieces of at most ``size`` code points each, over the text with unified line ends."""
    bs = blocks(text)
    if not bs:
        return []
    deep = depths([words(text[b.start : b.end]) for b in bs])
    trail: list[tuple[int, str]] = []
    paths = []
    for b in bs:
        if b.heading:
            trail = [t for t in trail if t[0] < b.heading] + [(b.heading, b.title)]
        paths.append(" > ".join(t for _, t in trail))
    out: list[Piece] = []
    i = 0
    while i < len(bs):
        if bs[i].end - bs[i].start > size:
            spans = inside(text, bs[i], size)
            out += [Piece(s, e, paths[i], bs[i].number, bs[i].number, True) for s, e in spans]
            i += 1
            continue
        j = i
        while j + 1 < len(bs) and bs[j + 1].end - bs[i].start <= size and bs[j + 1].end - bs[j + 1].start <= size:
            j += 1
        if j + 1 < len(bs) and bs[j + 1].end - bs[j + 1].start <= size:
            least = bs[i].start + size * (1 - REACH)
            options = [k for k in range(i, j + 1) if bs[k].end >= least] or [j]
            rank = lambda k: (bs[k + 1].heading > 0 and not bs[k].heading, not bs[k].heading, round(deep[k], 6), k)
            j = max(options, key=rank)
        back = j
        while back > i and bs[back].heading:
            back -= 1
        j = j if bs[back].heading or j + 1 == len(bs) else back
        out.append(Piece(bs[i].start, bs[j].end, paths[i], bs[i].number, bs[j].number, False))
        i = j + 1
    return out


def overlap(text: str, start: int, chars: int) -> str:
    """Up to ``chars`` code points that stand before ``start``, from a sentence's or at least a word's beginning on."""
    if chars <= 0:
        return ""
    before = text[max(0, start - chars) : start]
    if start > chars and text[start - chars - 1 : start - chars].strip() and before[:1].strip():
        for kind in (_INSIDE[0], _INSIDE[1], _INSIDE[3]):
            m = kind.search(before)
            if m and m.end() < len(before) and (kind is _INSIDE[3] or m.end() <= len(before) // 2):
                before = before[m.end() :]
                break
    return before.lstrip()


def split_sources(df: DataFrame, key: str = "source_id", text: str = "content", size: str = "max_chars", overlap_chars: str = "overlap_chars") -> DataFrame:
    """``key, piece_no, overlap_before, main, heading_path, first_block, last_block, cut_inside, start_pos, end_pos, block_chars``.

    Positions and lengths count code points, each line end as one. cut_inside: the piece is part of one block that had to be
    cut. Repeated rows of a key count once (the longest content, then the smallest limit, if they differ).

    Defined results: null and blank contents have no pieces; a null or non-positive limit means no limit; a null or negative
    overlap means none; an overlap never reaches before the text; a run without any break is cut at the limit.
    """
    from pyspark.sql import functions as F

    d = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.col(size).cast("int").alias("size"), F.col(overlap_chars).cast("int").alias("over"))
    one = F.max_by(F.struct("text", "size", "over"), F.struct(F.length("text"), -F.coalesce("size", F.lit(0)), "text", "over"))
    d = d.groupBy("key").agg(one.alias("r")).select("key", "r.text", "r.size", "r.over")

    def run(batches):
        for b in batches:
            rows = []
            for k, t, size_, over in zip(b.key, b.text, b["size"], b.over, strict=True):
                if not t:
                    continue
                u = unify(t)
                limit = int(size_) if pd.notna(size_) and size_ > 0 else max(len(u), 1)
                over_ = int(over) if pd.notna(over) and over > 0 else 0
                lengths = {x.number: x.end - x.start for x in blocks(u)}
                for n, p in enumerate(split(u, limit), 1):
                    rows.append((int(k), n, overlap(u, p.start, over_), u[p.start : p.end], p.path, p.first, p.last, p.cut, p.start, p.end, lengths[p.first]))
                if len(rows) > 4096:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["key", "piece_no", "overlap_before", "main", "heading_path", "first_block", "last_block", "cut_inside", "start_pos", "end_pos", "block_chars"]
    kinds = ["bigint", "bigint", "string", "string", "string", "bigint", "bigint", "boolean", "bigint", "bigint", "bigint"]
    return d.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True))).withColumnRenamed("key", key)

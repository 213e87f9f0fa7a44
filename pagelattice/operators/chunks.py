"""Chunking of markdown for embedding, and of very long sources for reading in turn."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOP = re.compile(r"\A---\n.*?^---[ \t]*(?:\n|\Z)", re.S | re.M)
_HEAD = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])")


@dataclass(frozen=True)
class Sizes:
    """Target and greatest length of a chunk, the least that stands alone, and the text repeated from the chunk before."""

    target: int = 1000
    most: int = 1500
    least: int = 200
    overlap: int = 200


@dataclass
class Span:
    start: int
    end: int
    path: str = ""
    whole: bool = False


def atoms(text: str, start: int = 0) -> list[Span]:
    """Code blocks, tables and paragraphs with the headings above them; a heading belongs to what follows it."""
    out: list[Span] = []
    trail: list[tuple[int, str]] = []
    begin = fence = kind = None
    path, at = "", start

    def close(end: int) -> None:
        nonlocal begin, kind
        if begin is not None and text[begin:end].strip():
            out.append(Span(begin, begin + len(text[begin:end].rstrip()), path, kind in ("code", "table")))
        begin = kind = None

    for line in text[start:].split("\n"):
        end = at + len(line)
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
                close(end)
        elif mark:
            close(at)
            begin, fence, kind = at, mark[1], "code"
        elif h := _HEAD.match(line):
            close(at)
            trail = [t for t in trail if t[0] < len(h[1])] + [(len(h[1]), f"{h[1]} {h[2]}")]
            path = " > ".join(t for _, t in trail)
            begin, kind = at, "head"
        elif not line.strip():
            if kind != "head":
                close(at)
        else:
            now = "table" if line.lstrip().startswith("|") else "text"
            if kind not in (None, "head", now):
                close(at)
            begin = at if begin is None else begin
            kind = now
        at = end + 1
    close(len(text))
    return out


def cut(text: str, a: Span, most: int) -> list[Span]:
    """A paragraph longer than ``most`` cut at lines, else sentences, else blanks, else anywhere; every character once."""
    out, at = [], a.start
    while a.end - at > most:
        window = text[at : at + most]
        found = [window.rfind("\n") + 1, *[m.end() for m in _SENTENCE.finditer(window)][-1:], window.rfind(" ") + 1, most]
        n = next(x for x in found if x > most // 4)
        out.append(Span(at, at + len(text[at : at + n].rstrip()), a.path))
        at += n
        while at < a.end and text[at].isspace():
            at += 1
    return [*out, Span(at, a.end, a.path)] if at < a.end else out


def chunk(text: str, sizes: Sizes = Sizes()) -> list[Span]:
    """Chunks in order. Code and tables stay whole even if too long (``whole``); a chunk never crosses a heading's section unless it is too small alone."""
    m = _TOP.match(text)
    parts: list[Span] = []
    for a in atoms(text, m.end() if m else 0):
        parts += [a] if a.whole or a.end - a.start <= sizes.most else cut(text, a, sizes.most)
    out: list[Span] = []
    for p in parts:
        last = out[-1] if out else None
        joined = p.end - last.start if last else 0
        small = last and (last.end - last.start < sizes.least or p.end - p.start < sizes.least)
        if last and joined <= sizes.most and (last.path == p.path and joined <= sizes.target or small):
            out[-1] = Span(last.start, p.end, last.path or p.path, False)
        else:
            out.append(Span(p.start, p.end, p.path, p.whole))
    return out


def before(text: str, start: int, n: int, floor: int = 0) -> str:
    """Up to ``n`` characters before ``start``, from a word's beginning on."""
    s = max(floor, start - n)
    part = text[s:start].rstrip()
    if s > floor and s and not text[s - 1].isspace() and (m := re.search(r"\s", part)):
        part = part[m.end() :]
    return part


def chunked(pages: DataFrame, key: str, text: str, sizes: Sizes = Sizes()) -> DataFrame:
    """``key, chunk_index, heading_path, char_start, char_end, oversized, chunk_text``: chunk_text starts with the overlap, the positions do not.

    Null and blank texts have no chunks; positions count code points of the text with ``\\r\\n`` as ``\\n``; frontmatter is left out.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.key, b.text, strict=True):
                t = (t or "").replace("\r\n", "\n")
                for i, c in enumerate(chunk(t, sizes)):
                    lead = before(t, c.start, sizes.overlap) if i else ""
                    body = t[c.start : c.end]
                    rows.append((k, i, c.path, c.start, c.end, c.end - c.start > sizes.most, f"{lead}\n{body}" if lead else body))
            yield pd.DataFrame(rows, columns=["key", "chunk_index", "heading_path", "char_start", "char_end", "oversized", "chunk_text"])

    d = pages.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return d.mapInPandas(run, f"key {kind}, chunk_index bigint, heading_path string, char_start bigint, char_end bigint, oversized boolean, chunk_text string").withColumnRenamed("key", key)


def long_source_sizes(budget: int = 204_800) -> Sizes:
    """Sizes for reading a long source in turn: about half the budget, within bounds."""
    target = int(min(max(0.55 * budget, 12_000), 60_000))
    return Sizes(target, target, 200, int(min(max(0.08 * target, 800), 3000)))


#: What a source's progress must agree in to be taken up again.
PARAMETERS = ["version", "sha256", "length", "budget", "target", "overlap", "total"]
PROGRESS = "key string, version int, sha256 string, length bigint, budget bigint, target bigint, overlap bigint, total bigint, completed bigint, digest string, analyses array<string>, problem string"
VERSION = 1


def read_long_sources(sources: DataFrame, done: DataFrame, ask: Callable[[str, str, str], tuple[str, str]], budget: int = 204_800, steps: int | None = None) -> DataFrame:
    """``PROGRESS``: every source of more than one chunk read in turn, each chunk with the digest of those before it.

    sources: ``key string, text``; done: earlier progress, of which a source's furthest row that agrees in all PARAMETERS is
    taken up, so that no chunk is asked for twice. ``ask`` is handed key, digest and chunk and gives the chunk's analysis and
    the new digest; when it fails, the source keeps what it had, with the failure as its ``problem``, and can be taken up
    again. ``steps``: chunks per source and call, for progress that is saved now and then; none means all.

    A source's chunks depend on each other and are one task's rows; sources are independent. Sources of one chunk or none,
    null keys and null texts have no row.
    """
    z = long_source_sizes(budget)
    last = done.where(F.col("completed") >= 0).groupBy("key", *PARAMETERS).agg(F.max(F.struct("completed", "digest", "analyses")).alias("p"))
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    now = sources.where(F.col("key").isNotNull() & F.col("text").isNotNull()).groupBy("key").agg(F.max("text").alias("text")).select("key", text.alias("text"), F.sha2("text", 256).alias("sha256"))

    def cut_up(batches):
        for b in batches:
            b["total"] = [len(chunk(t, z)) for t in b.text]
            yield b[b.total > 1]

    known = now.mapInPandas(cut_up, "key string, text string, sha256 string, total bigint").withColumn("length", F.length("text").cast("bigint"))
    own = {"version": VERSION, "budget": budget, "target": z.target, "overlap": z.overlap}
    known = known.select("*", *[F.lit(v).cast("int" if k == "version" else "bigint").alias(k) for k, v in own.items()])
    todo = known.join(last, ["key", *PARAMETERS], "left").select("key", "text", *PARAMETERS, "p.completed", "p.digest", "p.analyses")

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                through = 0 if pd.isna(r.completed) else int(r.completed)
                digest, said = (r.digest or "", list(r.analyses)) if through else ("", [])
                problem = None
                spans = chunk(r.text, z)
                for i in range(through, min(len(spans), through + steps) if steps else len(spans)):
                    lead = before(r.text, spans[i].start, z.overlap) if i else ""
                    body = r.text[spans[i].start : spans[i].end]
                    try:
                        analysis, digest = ask(r.key, digest, f"{lead}\n{body}" if lead else body)
                    except Exception as e:  # whatever a client raises is told of its source
                        problem = f"{type(e).__name__}: {e}"
                        break
                    said.append(analysis)
                rows.append((r.key, *(getattr(r, p) for p in PARAMETERS), len(said), digest, said, problem))
            yield pd.DataFrame(rows, columns=["key", *PARAMETERS, "completed", "digest", "analyses", "problem"])

    return todo.mapInPandas(run, PROGRESS)

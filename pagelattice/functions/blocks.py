"""Parsers of a model's block-structured answers, in Arrow-batched Python: one reader of framed sections, and what the kinds of section mean."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_SCHEMA = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "content", "problem")]))
_TEXTS = T.ArrayType(T.StringType())
REVIEW_SCHEMA = T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("type", "title", "description")), *(T.StructField(n, _TEXTS) for n in ("options", "pages", "searches"))]))
LINT_SCHEMA = T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("type", "severity", "title", "detail")), T.StructField("pages", _TEXTS)]))
#: Kinds of review; any other is a mere confirmation. What a review offers if it says nothing.
REVIEW_TYPES = ["contradiction", "duplicate", "missing-page", "suggestion"]
OPTIONS = ["Approve", "Skip"]
#: Device names that a file system refuses as file names.
DEVICES = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]


def _trim(c: Column) -> Column:
    """``F.trim`` of one argument: with two, ``F.transform`` would hand it the position as the characters to trim."""
    return F.trim(c)


def safe_generated_path(path: str) -> bool:
    """Below wiki/, without climbing, control characters or names that some file system refuses."""
    top, *parts = path.replace("\\", "/").split("/")
    odd = lambda x: x in ("", ".", "..") or x[-1] in " ." or x.partition(".")[0].lower() in DEVICES
    return top == "wiki" and bool(parts) and not re.search(r'[\x00-\x1f<>:"|?*]', path) and not any(map(odd, parts))


class Section(NamedTuple):
    head: str
    lines: list[str]
    closed: bool


def sections(text: str | None, name: str, fenced: bool = False) -> Iterator[Section]:
    """The sections between ``---NAME: head---`` and ``---END NAME---`` of an answer, in any case; one without an end goes to the end of the text.

    fenced: an end line inside a code fence is content. Otherwise the end may stand behind the last line's text.
    """
    begin = re.compile(rf"---\s*{name}:\s*(.*?)\s*---\s*", re.I)
    end = re.compile(rf"{'' if fenced else '(?P<rest>.*?)'}---\s*end\s+{name}\s*---\s*", re.I)
    head, lines, mark = None, [], ""
    for line in re.split(r"\r?\n", text or ""):
        if head is None:
            if m := begin.fullmatch(line):
                head, lines, mark = m[1], [], ""
            continue
        bare = line.lstrip(" ")
        ticks = bare[: len(bare) - len(bare.lstrip(bare[:1]))] if fenced and len(line) - len(bare) < 4 and bare[:1] in ("`", "~") else ""
        if len(ticks) >= 3 and (not mark or ticks[0] == mark[0] and len(ticks) >= len(mark)):
            mark = "" if mark else ticks
        elif not mark and (m := end.fullmatch(line)):
            if not fenced and m["rest"].strip():
                lines.append(m["rest"])
            yield Section(head, lines, True)
            head = None
            continue
        lines.append(line)
    if head is not None:
        yield Section(head, lines, False)


def told(lines: list[str], names: dict[str, str]) -> tuple[dict[str, list[str]], str]:
    """What lines ``NAME: a, b`` say, by name, and the text of the other lines. names: the mark that separates the values of each name."""
    said: dict[str, list[str]] = {}
    rest = []
    for line in lines:
        name, colon, value = line.partition(":")
        if colon and name in names:
            if name not in said:
                said[name] = [x.strip() for x in value.split(names[name]) if x.strip()]
        else:
            rest.append(line)
    return said, "\n".join(rest).strip()


def file_blocks(text: str | None) -> list[dict]:
    """All file blocks of an answer. A block with a ``problem`` (unclosed, no path, unsafe path) has no content."""
    out = []
    for s in sections(text, "file", fenced=True):
        problem = "unclosed" if not s.closed else "empty path" if not s.head else None if safe_generated_path(s.head) else "unsafe path"
        out.append({"path": s.head, "content": None if problem else "\n".join(s.lines), "problem": problem})
    return out


def review_blocks(text: str | None) -> list[dict]:
    """``---REVIEW: kind | title---`` sections with their lines OPTIONS, PAGES and SEARCH; those without an end or title are none."""
    out = []
    for s in sections(text, "review"):
        kind, bar, title = (x.strip() for x in s.head.partition("|"))
        if s.closed and bar and title:
            said, text_ = told(s.lines, {"OPTIONS": "|", "PAGES": ",", "SEARCH": "|"})
            out.append({"type": kind.lower() if kind.lower() in REVIEW_TYPES else "confirm", "title": title, "description": text_,
                        "options": said.get("OPTIONS") or OPTIONS, "pages": said.get("PAGES", []), "searches": said.get("SEARCH", [])})
    return out


def lint_blocks(text: str | None) -> list[dict]:
    """``---LINT: kind | severity | title---`` sections with their line PAGES."""
    out = []
    for s in sections(text, "lint"):
        kind, severity, title = ([x.strip() for x in s.head.split("|", 2)] + ["", ""])[:3]
        if s.closed and title:
            said, text_ = told(s.lines, {"PAGES": ","})
            out.append({"type": kind.lower(), "severity": "info" if severity.lower() == "info" else "warning", "title": title, "detail": text_, "pages": said.get("PAGES", [])})
    return out


@F.pandas_udf(FILE_SCHEMA)
def parse_file_blocks(s: pd.Series) -> pd.Series:
    return s.map(file_blocks)


@F.pandas_udf(REVIEW_SCHEMA)
def parse_review_blocks(s: pd.Series) -> pd.Series:
    return s.map(review_blocks)


@F.pandas_udf(LINT_SCHEMA)
def parse_lint_blocks(s: pd.Series) -> pd.Series:
    return s.map(lint_blocks)


def first_object(text: str | None) -> str:
    """The first brace-balanced object of a text, braces inside strings not counted; empty if there is none.

    A scan that ends with open braces has told the fate of every brace that it met outside of strings, so only braces that
    it took for parts of strings are looked at again.
    """
    text = text or ""
    start, dead = text.find("{"), set()
    while start >= 0:
        if start in dead:
            start = text.find("{", start + 1)
            continue
        open_: list[int] = []
        pairs: dict[int, int] = {}
        quoted = skip = False
        for i in range(start, len(text)):
            ch = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif ch == "{":
                open_.append(i)
            elif ch == "}":
                pairs[open_.pop()] = i
                if not open_:
                    return text[start : i + 1]
        dead.update(open_)
        start = text.find("{", start + 1)
        while start in dead:
            start = text.find("{", start + 1)
        if start in pairs:
            return text[start : pairs[start] + 1]
    return ""


@F.pandas_udf(T.StringType())
def first_json_object(s: pd.Series) -> pd.Series:
    return s.map(first_object)


def topic_and_queries(c: Column, fallback: Column, n: int = 3) -> Column:
    """Struct ``topic, queries`` of a research proposal; the fallback is both where the answer has neither."""
    topic = F.trim(F.regexp_extract(c, r"(?m)^\s*TOPIC:[ \t]*([^\r\n]+)", 1))
    qs = F.slice(F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^\s*QUERY:[ \t]*([^\r\n]+)"), 1), _trim), 1, n)
    return F.struct(F.when(topic != "", topic).otherwise(fallback).alias("topic"), F.when(F.size(qs) > 0, qs).otherwise(F.array(fallback)).alias("queries"))


#: Fields that a page's block begins with; lines in which its end must come.
PAGE_FIELDS = ["type", "title", "created", "updated", "tags", "related", "sources"]
LONGEST_BLOCK = 30
_LINKS = re.compile(r"([ \t]*[A-Za-z_][\w-]*[ \t]*:[ \t]*)(\[\[[^\]]+\]\](?:[ \t]*,[ \t]*\[\[[^\]]+\]\])+)[ \t]*\r?")


def _shown(lines: list[str]) -> list[int]:
    return [i for i, x in enumerate(lines) if x.strip()]


def _unwrapped(lines: list[str]) -> list[str]:
    """Without a code fence around the whole page."""
    at = _shown(lines)
    fenced = len(at) > 1 and lines[at[0]].strip().lower() in ("```", "```yaml", "```md", "```markdown") and lines[at[-1]].strip() == "```"
    return lines[at[0] + 1 : at[-1]] if fenced else lines


def _unnested(lines: list[str]) -> list[str]:
    """Without a stray key before the block."""
    stray = len(lines) > 1 and "".join(lines[0].lower().split()) == "frontmatter:" and lines[1].strip() == "---"
    return lines[1:] if stray else lines


def _opened(lines: list[str]) -> list[str]:
    """With the opening fence, where fields and a closing fence stand at the top without one."""
    at = _shown(lines)
    if not at or lines[at[0]].strip() == "---" or lines[at[0]].partition(":")[0].strip().lower() not in PAGE_FIELDS or ":" not in lines[at[0]]:
        return lines
    for line in lines[at[0] + 1 : at[0] + LONGEST_BLOCK]:
        if line.strip() == "---":
            return ["---", *lines[at[0] :]]
        if re.match(r"#{1,6}\s", line):
            break
    return lines


def _listed(lines: list[str]) -> list[str]:
    """With bare lists of links in the block as proper lists."""
    if not lines or lines[0].rstrip() != "---":
        return lines
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---"), 0)
    proper = lambda m: m[1] + "[" + ", ".join(f'"{x.strip()}"' for x in m[2].split(",")) + "]"
    return [proper(m) if 0 < i < end and (m := _LINKS.fullmatch(x)) else x for i, x in enumerate(lines)]


def repaired(text: str | None) -> str | None:
    """A generated page with its usual faults mended, by rules on its lines."""
    if text is None:
        return None
    lines = text.split("\n")
    for rule in (_unwrapped, _unnested, _opened, _listed):
        lines = rule(lines)
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def sanitize(s: pd.Series) -> pd.Series:
    return s.map(repaired)

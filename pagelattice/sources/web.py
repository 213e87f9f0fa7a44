"""Clipped web pages, results of outside searches, and the seams where outside services are plugged in."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelattice.functions.text import clip_slug

DROPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "iframe", "svg", "button"}
_BAD_CLASS = re.compile(r"(?:^|[\s_-])(?:sidebar|ads?|comments?|nav|menu|footer|cookie|share|promo)(?:$|[\s_-])", re.I)
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "col"}


class _Reader(HTMLParser):
    """Markdown of a page's readable part, in one pass over its tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title, self.in_title = "", False
        self.skip = self.pre = 0
        self.stack: list[tuple[str, bool]] = []
        self.lists: list[list] = []
        self.href: list[str] = []
        self.row: list[str] | None = None
        self.table: list[list[str]] = []
        self.hold: list[int] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _VOID:
            if self.skip:
                return
            small = any((a.get(k) or "").isdigit() and int(a[k]) < 10 for k in ("width", "height"))
            if tag == "br":
                self.out.append("\n")
            elif tag == "hr":
                self.out.append("\n\n---\n\n")
            elif tag == "img" and a.get("src") and not small:
                self.out.append(f"![{(a.get('alt') or '').strip()}]({a['src']})")
            return
        bad = tag in DROPPED or bool(_BAD_CLASS.search(f"{a.get('class') or ''} {a.get('id') or ''}")) and tag not in ("body", "html", "main", "article")
        self.stack.append((tag, bad))
        self.skip += bad
        if tag == "title":
            self.in_title = True
        if self.skip:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "main", "table", "figure"):
            self.out.append("\n\n")
            if tag == "table":
                self.table = []
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.hold.append(len(self.out))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, bad = self.stack.pop()
            shown = not self.skip
            self.skip -= bad
            if shown:
                self._close(t)
            if t == tag:
                break

    def _close(self, t):
        if t in ("strong", "b"):
            self.out.append("**")
        elif t in ("em", "i"):
            self.out.append("_")
        elif t == "pre":
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif t == "code" and not self.pre:
            self.out.append("`")
        elif t == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif t in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif t in ("td", "th") and self.hold and self.row is not None:
            at = self.hold.pop()
            self.row.append(" ".join("".join(self.out[at:]).split()))
            del self.out[at:]
        elif t == "tr" and self.row is not None:
            self.table.append(self.row)
            self.row = None
        elif t == "table":
            from pagelattice.sources.files import markdown_table

            self.out.append(markdown_table(self.table) + "\n\n")
            self.table = []
        elif t in ("p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def article(page: str | None, most: int = 50_000) -> dict:
    """``title, content``: the readable part of a page as markdown, its first ``most`` characters (a stated limit of the clip)."""
    r = _Reader()
    r.feed(page or "")
    r.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(r.out))
    text = re.sub(r"\n[ \t]+(?![-\d ])", "\n", text)
    return {"title": _html.unescape(" ".join(r.title.split())), "content": re.sub(r"\n{3,}", "\n\n", text).strip()[:most]}


ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())])


def articles(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, title, content`` of every page."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for b in batches:
            got = [article(x) for x in b.html]
            yield pd.DataFrame({"key": b.key, "title": [g["title"] for g in got], "content": [g["content"] for g in got]})

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, title string, content string").withColumnRenamed("key", key)


def clip_files(clips: DataFrame) -> DataFrame:
    """``path, content``: files for clipped pages; of equal names the later ones are numbered. clips: ``seq, title, url, content, day``."""
    slug = clip_slug(F.coalesce("title", F.lit("")), F.col("day"))
    w = Window.partitionBy("slug").orderBy("seq")
    c = clips.select("*", slug.alias("slug")).withColumn("n", F.row_number().over(w))
    name = F.concat(F.lit("raw/sources/"), F.col("slug"), F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".md"))
    quoted = F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    head = F.concat(F.lit('---\ntype: clip\ntitle: "'), quoted, F.lit('"\nurl: "'), F.coalesce("url", F.lit("")), F.lit('"\nclipped: '), F.col("day"), F.lit("\n---\n\n"))
    return c.select(name.alias("path"), F.concat(head, F.coalesce("content", F.lit(""))).alias("content"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def search_results(raw: DataFrame) -> DataFrame:
    """``title, url, snippet, source``: results of any of the known services in one form. Results without url and title are left out. raw: ``json``, one result each."""
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.get_json_object("json", f"$.{n}")), F.lit("")) for n in names])
    url = first("url", "link", "href")
    out = raw.select(first("title", "name").alias("title"), url.alias("url"), F.coalesce(first("snippet", "content", "description", "body"), F.lit("")).alias("snippet"), F.coalesce(first("source", "engine"), F.nullif(host(url), F.lit(""))).alias("source"))
    return out.where("url IS NOT NULL OR title IS NOT NULL")


class EmbeddingClient(Protocol):
    """Turns texts into vectors; raises ``TooLong`` for a text that the service refuses for its length."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class TooLong(Exception):
    """The text exceeds what the service takes."""


def embed_text(client: EmbeddingClient, text: str, retries: int = 3, floor: int = 64) -> list[float] | None:
    """The vector of a text, halved up to ``retries`` times while it is refused as too long; null if that doesn't help."""
    for _ in range(retries + 1):
        try:
            return client([text])[0]
        except TooLong:
            if len(text) // 2 < floor:
                return None
            text = text[: len(text) // 2]
    return None


def embedded(rows: DataFrame, key: str, text: str, make_client: Callable[[], EmbeddingClient]) -> DataFrame:
    """``key, vector`` of every row. The client is made once per task; null texts and refused ones have null vectors."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            yield pd.DataFrame({"key": b.key, "vector": [None if pd.isna(t) else embed_text(client, t) for t in b.text]})

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, vector array<double>").withColumnRenamed("key", key)


def hashed_client(size: int = 64) -> EmbeddingClient:
    """A client without a service: signed counts of hashed words, scaled to length 1. For tests and for wiring."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h & 0x10000 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def replayed(answers: dict[str, str], default: str | None = None) -> Callable[[list[str]], list[str]]:
    """A model that gives recorded answers: of the first key that a prompt holds."""
    return lambda prompts: [next((a for k, a in answers.items() if k in p), default) for p in prompts]

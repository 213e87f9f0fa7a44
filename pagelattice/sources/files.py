"""Reading trees of files: listings, markdown pages, text by extension, images; and the rules which files count."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import text as T

#: What is watched by default: extensions taken and refused, folders and patterns refused, size in MB and its bounds.
INCLUDE = ["md", "mdx", "txt", "pdf", "doc", "docx", "pptx", "xls", "xlsx", "odt", "odp", "ods", "rtf", "html", "htm", "csv"]
EXCLUDE = ["tmp", "temp", "bak", "swp", "part", "partial", "crdownload", "exe", "dll", "so", "dylib", "bin", "iso", "dmg"]
FOLDERS = [".git", ".svn", ".hg", ".obsidian", ".idea", ".vscode", "node_modules", ".cache", "__pycache__"]
PATTERNS = ["~$*", ".~lock.*#", "*.draft.*", "draft-*", "*.private.*"]
MEGABYTES, LEAST_MB, MOST_MB = 100, 1, 4096
#: Extensions of sources that can be ingested, and those that a scheduled import passes over.
INGESTABLE = ["md", "mdx", "txt", "pdf", "doc", "docx", "pptx", "xlsx", "odt", "odp", "ods", "xls", "csv", "json", "html", "htm", "rtf", "xml", "yaml", "yml"]
IMPORT_SKIPS = ["json", "yaml", "yml", "xml"]


def _values(given: Iterable[str] | None, default: list[str], extension: bool = False) -> tuple[str, ...]:
    """Entries without blanks, once each; an entry may hold several, separated by commas of either width or line ends."""
    bits = [x.strip() for v in (default if given is None else given) for x in re.split(r"[,，\n]", v)]
    return tuple(dict.fromkeys(x for x in (b.removeprefix(".").lower() if extension else b for b in bits) if x))


@dataclass(frozen=True)
class WatchRules:
    """Which files count. Every list may be given as its user wrote it; sizes are kept within LEAST_MB and MOST_MB."""

    include: tuple[str, ...]
    exclude: tuple[str, ...]
    folders: tuple[str, ...]
    patterns: tuple[str, ...]
    megabytes: float

    @classmethod
    def of(cls, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None, folders: Iterable[str] | None = None, patterns: Iterable[str] | None = None, megabytes: float | None = None) -> WatchRules:
        return cls(_values(include, INCLUDE, True), _values(exclude, EXCLUDE, True), _values(folders, FOLDERS), _values(patterns, PATTERNS), max(LEAST_MB, min(MOST_MB, MEGABYTES if megabytes is None else megabytes)))


def in_folder(path: Column, folders: Iterable[str]) -> Column:
    """Whether a path lies in one of the folders: a name stands for a folder anywhere, a name with slashes for a part of the path."""
    low, out = F.concat(F.lit("/"), F.lower(T.slashes(path)), F.lit("/")), F.lit(False)
    for f in folders:
        name = re.sub(r"/{2,}", "/", f.replace("\\", "/")).strip("/").lower()
        if name:
            out = out | low.contains(f"/{name}/")
    return out


def allowed(path: Column, rules: WatchRules | None = None) -> Column:
    """Whether an import's rules take a path: no refused folder, pattern, dot name or extension, and a taken extension, if any are named."""
    r = rules or WatchRules.of()
    p = T.slashes(path)
    name, ext = T.file_name(p), F.lower(F.regexp_extract(T.file_name(p), r"(?s)\.([^.]*)$", 1))
    ok = ~in_folder(p, r.folders) & ~T.matches_glob(p, list(r.patterns)) & (name != "") & ~name.startswith(".") & ~ext.isin(list(r.exclude))
    return ok & ext.isin(list(r.include)) if r.include else ok


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``path, name, ext, size, mtime`` of all files below ``root`` whose path has no dot name. Only metadata is read. Spark's readers pass over files of length zero."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", glob) if glob else r).load(root)
    rel = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(root.removeprefix("file:").strip("/")) + "/?", "")
    out = df.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return out.where(~F.col("path").rlike(r"(?:^|/)\.")).select("path", T.file_name(F.col("path")).alias("name"), T.extension(F.col("path")).alias("ext"), "size", "mtime")


def markdown_pages(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """``page_id, path, content`` of all markdown files; limit takes the first paths in order, where a cap is wanted. Two pages of one name are an error of the tree; ``page_id`` is then not unique."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root).select("value", F.col("_metadata.file_path").alias("p"))
    rel = F.regexp_replace(F.url_decode(F.replace("p", F.lit("+"), F.lit("%2B"))), "^(?:file:)?/*" + re.escape(root.removeprefix("file:").strip("/")) + "/?", "")
    out = df.select(rel.alias("path"), F.col("value").alias("content")).where(~F.col("path").rlike(r"(?:^|/)\."))
    out = out.select(F.regexp_replace(T.file_name(F.col("path")), r"(?i)\.md$", "").alias("page_id"), "path", "content")
    return out if limit is None else out.orderBy("path").limit(limit)


def watched(path: Column, size: Column | None = None, rules: WatchRules | None = None) -> Column:
    """Whether a project-relative path is watched: no application folder, media, excluded folder, pattern or extension; sources by extension, of the rest the pages and two settings files."""
    r = rules or WatchRules.of()
    p = T.slashes(path)
    low = F.lower(p)
    own = low.rlike(r"^(?:\.[^/]+|media)(?:/|$)|(?:^|/)media/|(?:^|/)(?:\.ds_store|thumbs\.db)$")
    ext = T.extension(p)
    source = low.startswith("raw/sources/") & ~ext.isin(list(r.exclude)) & (ext.isin(list(r.include)) if r.include else F.lit(True))
    page = low.isin("purpose.md", "schema.md") | (low.startswith("wiki/") & (ext == "md"))
    ok = ~own & ~in_folder(p, r.folders) & ~T.matches_glob(p, list(r.patterns)) & (source | page)
    return ok if size is None else ok & (size <= int(r.megabytes * (1 << 20)))


def ingestable(path: Column) -> Column:
    low = F.lower(T.slashes(path))
    return T.extension(path).isin(INGESTABLE) & ~low.rlike(r"(?:^|/)\.")


def importable(path: Column, size: Column) -> Column:
    """Whether a scheduled import takes a file: no dot name, wiki tree, settings file or oversize."""
    low = F.lower(T.slashes(path))
    return ~low.rlike(r"(?:^|/)(?:\.|wiki/)") & ~T.extension(path).isin(IMPORT_SKIPS) & (size <= MEGABYTES << 20)


def changed_imports(found: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, md5``: files that a scheduled import has not stored with this content. Both: ``path, md5``."""
    return found.select("path", "md5").join(stored.select("path", "md5"), ["path", "md5"], "left_anti")


def safe_path(path: Column, extensions: list[str] = ("md", "txt", "csv", "json", "html", "yaml", "yml")) -> Column:
    """Relative, without climbing, below one of the open roots, of a text extension."""
    p = T.slashes(F.trim(path))
    return ~p.rlike(r"^(?:/|[A-Za-z]:)") & ~p.rlike(r"(?:^|/)\.\.(?:/|$)") & ~p.contains("\u0000") & p.rlike(r"^(?:wiki|raw/sources)/|^(?:purpose|schema)\.md$") & T.extension(p).isin(list(extensions))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _tree(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"


def markdown_table(rows: list[list[str]]) -> str:
    """A table with the first row as its head; short rows are padded, empty rows at the end dropped."""
    while rows and not any(rows[-1]):
        rows = rows[:-1]
    if not rows:
        return ""
    w = max(map(len, rows))
    full = [r + [""] * (w - len(r)) for r in rows]
    return "\n".join([_row(full[0]), "|" + " --- |" * w, *map(_row, full[1:])])


def docx_markdown(data: bytes) -> str:
    """Headings, bold and italic runs, list items and tables of a document."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in _tree(z, "word/document.xml") if _local(e.tag) == "body")

    def par(p) -> str:
        style, listed, runs = "", False, []
        for e in p.iter():
            n = _local(e.tag)
            if n == "pStyle":
                style = next(iter(e.attrib.values()), "")
            elif n == "numPr":
                listed = True
            elif n == "r":
                t = "".join(x.text or "" if _local(x.tag) == "t" else "\n" if _local(x.tag) == "br" else "\t" if _local(x.tag) == "tab" else "" for x in e)
                props = {_local(x.tag) for q in e if _local(q.tag) == "rPr" for x in q if "0" not in x.attrib.values() and "false" not in x.attrib.values()}
                if t.strip():
                    t = f"**{t}**" if "b" in props else t
                    t = f"*{t}*" if "i" in props else t
                runs.append(t)
        t = "".join(runs).strip()
        m = re.match(r"(?i)heading\s*([1-6])", style)
        return f"{'#' * int(m[1])} {t}" if m and t else f"# {t}" if style.lower() == "title" and t else f"- {t}" if listed and t else t

    for e in body:
        if _local(e.tag) == "p":
            out.append(par(e))
        elif _local(e.tag) == "tbl":
            rows = [[" ".join(filter(None, (par(p) for p in c.iter() if _local(p.tag) == "p"))) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
            out.append(markdown_table(rows))
    return "\n\n".join(x for x in out if x)


def pptx_markdown(data: bytes) -> str:
    """Slides in numeric order: the first paragraph bold, the others as items."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted(((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))))
        for k, n in slides:
            ps = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip() for p in _tree(z, n).iter() if _local(p.tag) == "p"]
            ps = [p for p in ps if p]
            out.append("\n\n".join([f"## Slide {k}", *([f"**{ps[0]}**"] if ps else []), *(["\n".join(f"- {p}" for p in ps[1:])] if ps[1:] else [])]))
    return "\n\n".join(out)


def _number(v: str) -> str:
    try:
        f = float(v)
    except ValueError:
        return v
    return str(int(f)) if f == int(f) else f"{f:.2f}"


def xlsx_markdown(data: bytes) -> str:
    """Sheets as tables, with their names if there are several; whole numbers without a point, others with two places."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in _tree(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        book = [e for e in _tree(z, "xl/workbook.xml").iter() if _local(e.tag) == "sheet"]
        links = {e.attrib["Id"]: e.attrib["Target"] for e in _tree(z, "xl/_rels/workbook.xml.rels")}
        out = []
        for s in book:
            target = links[next(v for k, v in s.attrib.items() if _local(k) == "id" and "}" in k)]
            rows: list[list[str]] = []
            for r in (e for e in _tree(z, target.lstrip("/") if target.startswith("/") else "xl/" + target).iter() if _local(e.tag) == "row"):
                cells: dict[int, str] = {}
                for c in r:
                    col = 0
                    for ch in re.match(r"[A-Z]*", c.attrib.get("r", ""))[0]:
                        col = col * 26 + ord(ch) - 64
                    v = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    kind = c.attrib.get("t")
                    if kind == "s" and v:
                        v = shared[int(v)]
                    elif kind == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    elif kind == "b":
                        v = "TRUE" if v == "1" else "FALSE"
                    elif kind in (None, "n"):
                        v = _number(v)
                    cells[(col or len(cells) + 1) - 1] = v
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            t = markdown_table(rows)
            out.append(f"## {s.attrib['name']}\n\n{t}" if len(book) > 1 else t)
    return "\n\n".join(x for x in out if x)


#: Entities in the order of their decoding; the ampersand is last, so nothing is decoded twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode_entities(s: str) -> str:
    for a, b in ENTITIES:
        s = s.replace(a, b)
    return s


def odf_text(data: bytes) -> str:
    """Paragraphs and headings of an open document as lines with blanks between."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("content.xml").decode("utf-8", "replace")
    s = re.sub(r"</text:(?:p|h)>", "\n\n", re.sub(r"<text:(?:tab|s)[^>]*/>", " ", xml))
    s = decode_entities(re.sub(r"<[^>]+>", "", s))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in s.split("\n"))).strip()


def _repeat(e: ElementTree.Element, what: str) -> int:
    return int(next((v for k, v in e.attrib.items() if _local(k) == what), "1"))


def ods_markdown(data: bytes) -> str:
    """Sheets of an open spreadsheet as tables, as ``xlsx_markdown`` writes them. Repeats of empty rows and cells at the end, with which such files fill a sheet, are no content."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheets = [e for e in _tree(z, "content.xml").iter() if _local(e.tag) == "table"]
    out = []
    for s in sheets:
        rows: list[list[str]] = []
        empty = 0
        for r in (e for e in s.iter() if _local(e.tag) == "table-row"):
            cells: list[str] = []
            blank = 0
            for c in (e for e in r if _local(e.tag) in ("table-cell", "covered-table-cell")):
                a = {_local(k): v for k, v in c.attrib.items()}
                shown = "\n".join("".join(p.itertext()) for p in c if _local(p.tag) == "p")
                v = _number(a["value"]) if a.get("value-type") == "float" and "value" in a else shown
                n = _repeat(c, "number-columns-repeated")
                if v:
                    cells += [""] * blank + [v] * n
                blank = 0 if v else blank + n
            n = _repeat(r, "number-rows-repeated")
            if cells:
                rows += [[] for _ in range(empty)] + [cells] * n
            empty = 0 if cells else empty + n
        t = markdown_table(rows)
        name = next((v for k, v in s.attrib.items() if _local(k) == "name"), "")
        out.append(f"## {name}\n\n{t}" if len(sheets) > 1 else t)
    return "\n\n".join(x for x in out if x)


READERS = {"docx": docx_markdown, "pptx": pptx_markdown, "xlsx": xlsx_markdown, "odt": odf_text, "odp": odf_text, "ods": ods_markdown}


def read_text(ext: str, name: str, data: bytes) -> tuple[str | None, str | None]:
    """``(text, problem)`` of one file. Kinds without a reader (images, media, old formats, PDF) give a line that names the file."""
    if ext in READERS:
        try:
            return READERS[ext](data), None
        except Exception as e:
            return None, f"{type(e).__name__}: unreadable {ext}"
    if ext in "png jpg jpeg gif webp svg bmp tif tiff avif heic mp3 wav m4a ogg flac mp4 mov webm mkv doc xls ppt pdf rtf".split():
        return f"[{name}: {ext} file, {len(data)} bytes]", None if ext != "pdf" else "no PDF reader installed"
    try:
        return data.decode("utf-8-sig"), None
    except UnicodeDecodeError:
        return None, "not UTF-8"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, ext, md5, text, problem`` of every file below ``root``; each is read once, in the task that holds it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_text(e, p.rsplit("/", 1)[-1], bytes(c)) for e, p, c in zip(b.ext, b.path, b.content, strict=True)]
            yield pd.DataFrame({"path": b.path, "ext": b.ext, "md5": b.md5, "text": [g[0] for g in got], "problem": [g[1] for g in got]})

    src = df.select("path", T.extension(F.col("path")).alias("ext"), F.md5("content").alias("md5"), "content")
    return src.mapInPandas(run, "path string, ext string, md5 string, text string, problem string")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF or JPEG, from its header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8":
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            marker, n = data[i + 1], int.from_bytes(data[i + 2 : i + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[i + 7 : i + 9], "big"), int.from_bytes(data[i + 5 : i + 7], "big")
            i += 2 + n
    return None


def embedded_images(files: DataFrame, least: int = 100, most: int = 500) -> DataFrame:
    """``path, idx, name, width, height, sha256`` of the images inside office files, each content once per file, those of ``least`` pixels each way; at most ``most`` a file, which is the feature.

    files: ``path, content``.
    """
    import hashlib

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content, strict=True):
                seen: set[str] = set()
                try:
                    z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except zipfile.BadZipFile:
                    continue
                for n in sorted(x for x in z.namelist() if re.match(r"(?:word|ppt|xl)/media/|Pictures/", x)):
                    data = z.read(n)
                    size, sha = image_size(data), hashlib.sha256(data).hexdigest()
                    if size and min(size) >= least and sha not in seen and len(seen) < most:
                        rows.append((path, len(seen) + 1, n, *size, sha))
                        seen.add(sha)
            yield pd.DataFrame(rows, columns=["path", "idx", "name", "width", "height", "sha256"])

    return files.select("path", "content").mapInPandas(run, "path string, idx bigint, name string, width bigint, height bigint, sha256 string")


def image_section(images: DataFrame) -> DataFrame:
    """``path, section``: images of a document listed per page in order, those without a page last. images: ``path, page, idx, url, caption``."""
    line = F.concat(F.lit("!["), F.coalesce("caption", F.lit("")), F.lit("]("), F.col("url"), F.lit(")"))
    pages = images.groupBy("path", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    head = F.when(F.col("page").isNull(), "### Document").otherwise(F.concat(F.lit("### Page "), F.col("page").cast("string")))
    part = F.struct(F.coalesce("page", F.lit(1 << 30)).alias("p"), F.concat(head, F.lit("\n\n"), F.col("lines")).alias("t"))
    return pages.groupBy("path").agg(F.concat(F.lit("## Embedded images\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n")).alias("section"))

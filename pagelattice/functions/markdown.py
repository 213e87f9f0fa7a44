"""Column expressions over markdown pages: frontmatter, titles, links, images, rewriting of references."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelattice.functions.bind import let
from pagelattice.functions.keys import page_key

_NL = r"(?:\r\n|\n)"
#: A block at the very top, or one whose opening line is among the first six.
STRICT = rf"(?s)\A\x{{FEFF}}?---[ \t]*{_NL}(.*?){_NL}?---[ \t]*(?:{_NL}|\z)"
LOOSE = rf"(?s)\A\x{{FEFF}}?(?:[^\n]*\n){{0,5}}?---[ \t]*{_NL}(.*?){_NL}?---[ \t]*(?:{_NL}|\z)"
LINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"


def _trim(c: Column) -> Column:
    """``F.trim`` of one argument: with two, ``F.transform`` would hand it the position as the characters to trim."""
    return F.trim(c)


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def frontmatter_block(c: Column, strict: bool = False) -> Column:
    """The raw lines between the fences, or null if there is no block."""
    pattern = STRICT if strict else LOOSE
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def body(c: Column) -> Column:
    """The text behind the frontmatter; all of it if there is none."""
    return F.regexp_replace(c, LOOSE, "")


def strip_offset(c: Column) -> Column:
    """How many code points ``strip_top`` takes away."""
    return F.length(c) - F.length(strip_top(c))


def strip_top(c: Column) -> Column:
    """The text without a frontmatter at the very top."""
    return F.regexp_replace(c, STRICT, "")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^([\"'])(.*)\\1$", "$2")


def scalar_field(block: Column, field: str) -> Column:
    """A scalar of the block as text, without its quotation marks; null if it is missing, empty or a list."""
    v = F.regexp_extract(block, rf"(?m)^{re.escape(field)}:[ \t]*([^\r\n\[]*?)[ \t]*\r?$", 1)
    return _some(unquoted(v))


def array_field(block: Column, field: str) -> Column:
    """A list of the block, written in brackets or as lines with hyphens; empty if it is neither."""
    name = re.escape(field)
    lines = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*-[ \t]+[^\r\n]*(?:\r?\n|\z))+)", 1)
    inline = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\[([^\r\n]*)\][ \t]*\r?$", 1)
    from_lines = F.transform(F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*-[ \t]+([^\r\n]*)"), 1), unquoted)
    from_inline = F.transform(F.split(inline, ","), unquoted)
    got = F.when(lines != "", from_lines).otherwise(from_inline)
    return F.coalesce(F.filter(got, lambda x: x != ""), F.array().cast("array<string>"))


def fields_map(block: Column) -> Column:
    """All top-level ``name: value`` lines of the flat subset, as a map of text; a repeated name keeps its last value."""
    names = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*([^\r\n]*)"), 1)
    values = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*([^\r\n]*)"), 2), unquoted)
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = lambda ks: lambda p, i: ~F.array_contains(F.slice(ks, i + F.lit(2), F.greatest(F.size(ks) - i - 1, F.lit(0))), p["k"])
    return F.map_from_entries(let(pairs, lambda b: let(F.transform(b, lambda x: x["k"]), lambda ks: F.filter(b, last(ks)))))


def _in_block(c: Column, change: Callable[[Column], Column]) -> Column:
    """The page with the lines of the block at its very top changed, and nothing else; a page without one stays."""
    whole = rf"(?s)\A(\x{{FEFF}}?---[ \t]*{_NL})(.*?)({_NL}?---[ \t]*(?:{_NL}.*|\z))\z"
    cut = lambda p: F.struct(*[F.regexp_extract(p, whole, i).alias(n) for i, n in enumerate(("top", "block", "rest"), 1)])
    return let(c, lambda p: F.when(p.rlike(whole), let(cut(p), lambda x: F.concat(x.top, change(x.block), x.rest))).otherwise(p))


def _literal(line: Column) -> Column:
    """A text that stands for itself in a replacement."""
    return F.regexp_replace(line, r"([\\$])", r"\\$1")


def _replace_first(block: Column, pattern: str, line: Column) -> Column:
    return F.regexp_replace(block, F.lit(rf"\A((?s:.*?))(?m:{pattern})"), F.concat(F.lit("$1"), _literal(line)))


def _appended(block: Column, line: Column) -> Column:
    # an empty block's closing fence follows at once
    return F.when(block == "", F.concat(line, F.lit("\n"))).otherwise(F.concat(block, F.lit("\n"), line))


def write_array(c: Column, field: str, values: Column) -> Column:
    """The page with the list written in brackets: in the place of the block's first such field, else at the block's end; no block, no change."""
    name = re.escape(field)
    line = F.concat(F.lit(f"{field}: ["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "), F.lit("]"))
    inline, lines = rf"^{name}:[ \t]*\[[^\r\n]*\]", rf"^{name}:[ \t]*(?:\r?\n[ \t]*-[ \t]+[^\r\n]*)+"
    return _in_block(c, lambda b: F.when(b.rlike(f"(?m){inline}"), _replace_first(b, inline, line)).when(b.rlike(f"(?m){lines}"), _replace_first(b, lines, line)).otherwise(_appended(b, line)))


def set_scalar(c: Column, field: str, value: Column) -> Column:
    """The page with ``field: value``: in place of the block's first such line, unless that holds a list, else at the block's end."""
    line = F.concat(F.lit(f"{field}: "), value)
    old = rf"^{re.escape(field)}:[ \t]*(?!\[)[^\r\n]*"
    return _in_block(c, lambda b: F.when(b.rlike(f"(?m){old}"), _replace_first(b, old, line)).otherwise(_appended(b, line)))


def first_heading(c: Column) -> Column:
    return _some(F.trim(F.regexp_extract(body(c), r"(?m)^#[ \t]+([^\r\n]+)", 1)))


def file_stem(path: Column) -> Column:
    name = F.regexp_replace(path, r"(?s)^.*[/\\]", "")
    return F.regexp_replace(name, r"(?s)(.)\.[^.]*$", "$1")


def title(c: Column, path: Column, spaced: bool = True) -> Column:
    """Frontmatter title, else first heading, else the file's stem (hyphens as blanks if ``spaced``)."""
    stem = F.replace(file_stem(path), F.lit("-"), F.lit(" ")) if spaced else file_stem(path)
    return F.coalesce(scalar_field(frontmatter_block(c), "title"), first_heading(c), stem)


def page_type(c: Column, default: str = "other") -> Column:
    return F.coalesce(F.lower(scalar_field(frontmatter_block(c), "type")), F.lit(default))


#: The type that a folder under wiki/ stands for.
FOLDER_TYPES = {
    "entities": "entity", "concepts": "concept", "sources": "source", "queries": "query", "synthesis": "synthesis",
    "comparisons": "comparison", "thesis": "thesis", "methodology": "methodology", "findings": "finding",
}


def type_of_path(path: Column) -> Column:
    """Type by folder; a folder of another name is its own type; overview is its own; null outside wiki/."""
    folder = F.regexp_extract(path, r"(?:^|/)wiki/([^/]+)/", 1)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in FOLDER_TYPES.items() for x in kv]), folder)
    return F.when(path.rlike(r"(?:^|/)wiki/overview\.md$"), "overview").when(folder != "", F.coalesce(known, folder))


def wikilinks(c: Column) -> Column:
    """Trimmed targets of all wikilinks in order, repeated ones kept."""
    return F.transform(F.regexp_extract_all(c, F.lit(LINK), 1), _trim)


def wikilink_labels(c: Column) -> Column:
    """What each wikilink shows: its alias, else its target."""
    alias = F.regexp_extract_all(c, F.lit(LINK), 2)
    return F.zip_with(wikilinks(c), alias, lambda t, a: F.coalesce(_some(F.trim(a)), t))


def unwrap(c: Column) -> Column:
    """Struct ``slug, label`` of one possibly wrapped reference."""
    slug = F.trim(F.regexp_replace(F.regexp_extract(c, r"^\s*(?:\[\[)?([^\]|]*)", 1), r"\s+$", ""))
    label = F.trim(F.regexp_extract(c, r"\|([^\]]*)", 1))
    return F.struct(slug.alias("slug"), F.coalesce(_some(label), slug).alias("label"))


def links_as_markdown(c: Column) -> Column:
    """Wikilinks outside fenced and inline code as markdown links to an anchor; text is split at code, links are rewritten between."""
    code = r"(?s)(```.*?```|~~~.*?~~~|`[^`\n]*`)"
    plain = F.split(c, code)
    kept = F.regexp_extract_all(c, F.lit(code), 1)
    linked = F.transform(plain, _linked)
    return F.array_join(F.flatten(F.zip_with(linked, kept, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def _linked(part: Column) -> Column:
    aliased = F.regexp_replace(part, r"\[\[\s*([^\]|]+?)\s*\|\s*([^\]]+?)\s*\]\]", "[$2](#\u0001$1\u0001)")
    bare = F.regexp_replace(aliased, r"\[\[\s*([^\]|]+?)\s*\]\]", "[$1](#\u0001$1\u0001)")
    bits = F.split(bare, "\u0001")
    return F.array_join(F.transform(bits, lambda b, i: F.when(i % 2 == 1, F.replace(F.url_encode(b), F.lit("+"), F.lit("%20"))).otherwise(b)), "")


def ref_key(c: Column) -> Column:
    """Last path segment without ``.md``, lower case, no blanks, hyphens or underscores."""
    name = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?s)^.*[/\\]", ""), r"(?i)\.md$", "")
    return F.regexp_replace(F.lower(name), r"[\s_-]+", "")


def strip_links(c: Column, gone: Column) -> Column:
    """Wikilinks to pages whose ``ref_key`` is in the array ``gone`` replaced by what they show."""
    parts = F.split(c, r"(?=\[\[)|(?<=\]\])")
    whole = r"^\[\[([^\]|]+)(?:\|([^\]]+))?\]\]$"

    def one(p):
        target, alias = F.trim(F.regexp_extract(p, whole, 1)), F.trim(F.regexp_extract(p, whole, 2))
        return F.when(p.rlike(whole) & F.array_contains(gone, ref_key(target)), F.coalesce(_some(alias), target)).otherwise(p)

    return F.when(F.size(gone) == 0, c).otherwise(F.array_join(F.transform(parts, one), ""))


def clean_index(c: Column, gone: Column) -> Column:
    """The listing without list lines whose first wikilink leads to a page in ``gone``."""
    lines = F.split(c, "\n")
    hit = lambda s: s.rlike(r"^\s*[-*+]\s") & F.array_contains(gone, ref_key(F.regexp_extract(s, LINK, 1)))
    return F.array_join(F.filter(lines, lambda s: ~hit(s)), "\n")


def image_refs(c: Column) -> Column:
    """Images ``![alt](url)`` as structs ``url, alt``, each url once, the first alt kept."""
    p = r"!\[([^\]]*)\]\(([^)\s]+)\)"
    alt, url = F.regexp_extract_all(c, F.lit(p), 1), F.regexp_extract_all(c, F.lit(p), 2)
    both = F.arrays_zip(url.alias("url"), alt.alias("alt"))
    first = lambda urls: lambda x, i: F.array_position(urls, x["url"]) == i + 1
    return let(both, lambda b: let(F.transform(b, lambda x: x["url"]), lambda urls: F.filter(b, first(urls))))


IMAGE_EXT = "png jpg jpeg gif webp svg bmp tif tiff avif heic".split()


def local_image_refs(c: Column) -> Column:
    """Distinct targets of embedded and linked images that are neither remote nor inline data."""
    embedded = F.regexp_extract_all(c, F.lit(r"!\[\[([^\]|#]+)[^\]]*\]\]"), 1)
    linked = F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(<?([^)>]+?)>?(?:\s+\"[^\"]*\")?\)"), 1)
    local = lambda u: ~u.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)") & F.lower(F.regexp_extract(u, r"\.([A-Za-z0-9]+)$", 1)).isin(IMAGE_EXT)
    return F.array_distinct(F.filter(F.transform(F.concat(embedded, linked), _trim), local))


def image_context(c: Column, url: Column, width: int = 150) -> Column:
    """Struct ``before, after``: the text around the first image of that url."""
    at = F.instr(c, "![")
    opening = F.concat(F.lit("]("), url, F.lit(")"))
    end = F.instr(c, opening)
    before = F.substring_index(F.substring(c, F.lit(1), F.greatest(end - 1, F.lit(0))), "![", -1)
    start = F.when(at > 0, end - F.length(before) - 2)
    left = F.substring(c, F.greatest(start - width, F.lit(1)), F.least(F.greatest(start - 1, F.lit(0)), F.lit(width)))
    right = F.substring(c, end + F.length(opening), F.lit(width))
    return F.when(end > 0, F.struct(left.alias("before"), right.alias("after")))


def rewrite_alt(c: Column, captions: Column) -> Column:
    """Alt texts replaced by the map's caption for the url; line breaks become blanks and ``]`` becomes ``)``."""
    parts = F.split(c, r"(?=!\[)")
    p = r"(?s)^!\[[^\]]*\]\(([^)\s]+)\)"
    url = lambda s: F.regexp_extract(s, p, 1)
    cap = lambda s: F.replace(F.regexp_replace(F.try_element_at(captions, url(s)), r"\s*[\r\n]+\s*", " "), F.lit("]"), F.lit(")"))
    new = lambda s: F.concat(F.lit("!["), cap(s), F.lit("]("), url(s), F.lit(")"), F.regexp_replace(s, p, ""))
    return F.array_join(F.transform(parts, lambda s: F.coalesce(F.when(s.rlike(p), new(s)), s)), "")


def list_union(old: Column, new: Column) -> Column:
    """Both lists in order, each value once whatever its case, in the first spelling."""
    both = F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    both = F.filter(both, lambda v: v.isNotNull() & (F.trim(v) != ""))
    first = lambda low: lambda v, i: F.array_position(low, F.lower(v)) == i + 1
    return let(both, lambda b: let(F.transform(b, F.lower), lambda low: F.filter(b, first(low))))


def parsed_frontmatter(text: str | None) -> dict[str, str] | None:
    """The block as fields: lists and nested values as JSON, null as empty text, numbers and truth values as text; null if there is no readable block.

    Unlike ``fields_map``, which reads the flat subset in expressions, this takes all of YAML. A block that YAML refuses is
    read once more with bare lists of links in quotation marks.
    """
    import json

    import yaml

    m = re.search(LOOSE.replace(r"\x{FEFF}", "\ufeff").replace(r"\z", r"\Z"), text or "")
    if not m:
        return None

    class Plain(yaml.BaseLoader):
        """Scalars as they are written, but null as empty text."""

    Plain.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
    Plain.add_constructor("tag:yaml.org,2002:null", lambda loader, node: "")
    links = re.compile(r"(?m)^(\s*[A-Za-z_][\w-]*\s*:\s*)(\[\[[^\]\n]+\]\](?:\s*,\s*\[\[[^\]\n]+\]\])+)[ \t]*\r?$")
    quoted = lambda k: k[1] + "[" + ", ".join(f'"{x.strip()}"' for x in k[2].split(",")) + "]"
    for block in (m[1], links.sub(quoted, m[1])):
        try:
            got = yaml.load(block, Loader=Plain)
        except yaml.YAMLError:
            continue
        if not isinstance(got, dict):
            return None
        return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in got.items()}
    return None


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def frontmatter_yaml(s: pd.Series) -> pd.Series:
    """``parsed_frontmatter`` as a column of maps, in Arrow batches."""
    return s.map(parsed_frontmatter)


def canonical_page(c: Column) -> Column:
    return page_key(c)

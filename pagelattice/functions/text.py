"""Column expressions over plain text: query tokens, snippets, slugs, identities, paths, categories."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelattice.functions.bind import let

#: Words that no query is about.
STOP_WORDS = [
    "的", "是", "了", "什么", "在", "有", "和", "与", "对", "从", "the", "is", "a", "an", "what", "how", "are", "was", "were", "do", "does", "did", "be", "been",
    "being", "have", "has", "had", "it", "its", "in", "on", "at", "to", "for", "of", "with", "by", "this", "that", "these", "those",
]
#: Separators besides blanks and ASCII punctuation.
SEPARATORS = "，。！？、；：“”‘’（）·～…"
_CUT = rf"[\s!-/:-@\[-`{{-~{SEPARATORS}]+"
_CJK = r"[\x{3400}-\x{9FFF}]"


def _trim(c: Column) -> Column:
    """``F.trim`` of one argument: with two, ``F.transform`` would hand it the position as the characters to trim."""
    return F.trim(c)


def tokenize(query: str) -> list[str]:
    """Sorted distinct tokens of a query: no stop words or single characters; long CJK tokens also as bigrams and characters."""
    out: set[str] = set()
    for t in re.split(_CUT.replace("\\x{", "\\u"), query.lower()):
        if len(t) > 1 and t not in STOP_WORDS:
            out.add(t)
            if len(t) > 2 and re.search("[㐀-鿿]", t):
                out.update(t[i : i + 2] for i in range(len(t) - 1))
                out.update(c for c in t if c not in STOP_WORDS)
    return sorted(out)


def token_array(c: Column) -> Column:
    """``tokenize`` as an expression, for queries that are rows."""
    words = F.filter(F.split(F.lower(c), _CUT), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))
    wide = F.filter(words, lambda t: t.rlike(_CJK) & (F.length(t) > 2))
    at = lambda t: F.sequence(F.lit(1), F.length(t))
    grams = F.flatten(F.transform(wide, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))))
    chars = F.filter(F.flatten(F.transform(wide, lambda t: F.transform(at(t), lambda i: F.substring(t, i, F.lit(1))))), lambda x: ~x.isin(STOP_WORDS))
    return F.array_sort(F.array_distinct(F.concat(words, grams, chars)))


#: Separators of index tokens. Full stops, ASCII exclamation and question marks and quotation marks are none.
_INDEX_CUT = r"[\s,，。！？、；：“”‘’（）()\-_/\\·~～…]+"


def index_tokens(c: Column) -> Column:
    """Distinct tokens of a query in their order, for trimming an index and for captions: other separators than ``token_array``; a long CJK token's bigrams and characters follow it."""
    words = F.filter(F.split(F.lower(c), _INDEX_CUT), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))
    gram = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    char = lambda t: F.filter(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(1))), lambda x: ~x.isin(STOP_WORDS))
    wide = lambda t: F.when(t.rlike(_CJK) & (F.length(t) > 2), F.concat(gram(t), char(t), F.array(t))).otherwise(F.array(t))
    return F.array_distinct(F.flatten(F.transform(words, wide)))


def phrase(c: Column) -> Column:
    """The query in lower case without separators at its ends."""
    return F.lower(F.regexp_replace(c, rf"^{_CUT}|{_CUT}$", ""))


def token_score(text: Column, tokens: Column) -> Column:
    """How many of the tokens the text holds, as substrings."""
    low = F.lower(text)
    return F.size(F.filter(tokens, lambda t: low.contains(t)))


def occurrences(text: Column, needle: Column, cap: int = 10) -> Column:
    """Occurrences of a literal without overlap, up to ``cap``."""
    low = F.lower(text)
    n = (F.length(low) - F.length(F.replace(low, needle, F.lit("")))) / F.greatest(F.length(needle), F.lit(1))
    return F.when(needle == "", 0).otherwise(F.least(n.cast("int"), F.lit(cap)))


def snippet(text: Column, anchor: Column, width: int = 80) -> Column:
    """The text around the first match of the anchor on one line, with marks of omission; its beginning if there is none."""
    at = F.greatest(F.instr(F.lower(text), F.lower(anchor)), F.lit(1))
    start = F.greatest(at - width, F.lit(1))
    stop = F.least(at + F.length(anchor) + width, F.length(text) + 1)
    core = F.regexp_replace(F.substring(text, start, stop - start), r"\r?\n", " ")
    return F.concat(F.when(start > 1, "...").otherwise(""), core, F.when(stop <= F.length(text), "...").otherwise(""))


def chunk_snippet(chunk: Column, heading: Column, width: int = 160) -> Column:
    return F.concat(F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit(": "))).otherwise(""), F.substring(F.regexp_replace(chunk, r"\r?\n", " "), 1, width))


#: What a review's title may begin with, before a colon of either width.
REVIEW_PREFIXES = [r"missing[\s-]?page", r"duplicate[\s-]?page", r"possible[\s-]?duplicate", "缺失页面", "缺少页面", "重复页面", "疑似重复"]


def normalise_review_title(c: Column) -> Column:
    """Without the leading kind of the review, runs of blanks as one, in lower case."""
    kinds = "(?i)^(?:" + "|".join(REVIEW_PREFIXES) + r")[:：]\s*"
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, kinds, ""), r"\s+", " ")))


def query_slug(c: Column, default: str = "query", size: int = 50) -> Column:
    """Letters, digits and hyphens of a title, blanks as hyphens, at most ``size`` code points. Input is taken as NFKC."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}-]", ""), r"-{2,}", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, size), r"-+$", "")
    return F.coalesce(F.when(s != "", s), F.lit(default))


def clip_slug(c: Column, day: Column, size: int = 50) -> Column:
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s-]", "")), r"[\s-]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, size), r"-+$", "")
    return F.concat(F.coalesce(F.when(s != "", s), F.lit("clip")), F.lit("-"), day)


def slashes(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"/{2,}", "/")


def file_name(c: Column) -> Column:
    return F.regexp_replace(slashes(c), r"(?s)^.*/", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"(?s).\.([^.]*)$", 1))


def relative_path(c: Column, base: Column) -> Column:
    b = F.regexp_replace(slashes(base), r"/+$", "")
    return F.when(F.startswith(slashes(c), F.concat(b, F.lit("/"))), F.substring(slashes(c), F.length(b) + 2, F.length(c))).otherwise(slashes(c))


def folder_context(c: Column) -> Column:
    """The folders of a relative path joined as a trail."""
    parts = F.filter(F.split(slashes(c), "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " > ")


def source_identity(c: Column) -> Column:
    """The path below raw/sources/, wherever and in whatever case that stands; else the path itself."""
    return F.regexp_replace(slashes(F.trim(c)), r"(?i)^(?:.*/)?(?:raw/)?sources/", "")


#: Extensions of each category of file.
CATEGORIES = {
    "markdown": ["md", "mdx"],
    "text": ["txt", "rtf", "log"],
    "code": [
        "js", "jsx", "ts", "tsx", "py", "rs", "go", "java", "c", "cpp", "h", "hpp", "rb", "php", "swift", "kt", "scala", "sh", "bash", "zsh", "sql", "r", "lua", "css",
        "scss", "less", "html", "htm", "xml", "svg", "vue", "svelte", "toml", "ini", "cfg", "conf", "dockerfile", "makefile",
    ],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "tiff", "tif", "avif", "heic", "heif"],
    "video": ["mp4", "webm", "mov", "avi", "mkv", "flv", "wmv", "m4v"],
    "audio": ["mp3", "wav", "ogg", "flac", "aac", "m4a", "wma"],
    "pdf": ["pdf"],
    "document": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "pages", "numbers", "key", "epub"],
    "data": ["json", "jsonl", "csv", "tsv", "yaml", "yml", "ndjson"],
}


def file_category(c: Column) -> Column:
    """By what stands behind the last point; a name without one is its own extension."""
    ext, out = F.lower(F.substring_index(c, ".", -1)), F.lit("unknown")
    for name, exts in CATEGORIES.items():
        out = F.when(ext.isin(exts), name).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """An anchored, case-insensitive expression for a pattern of ``*`` and ``?``."""
    return "(?is)^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern) + "$"


def matches_glob(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p)) | file_name(path).rlike(glob_regex(p))
    return out


#: Greetings as whole texts, by language, with what may follow one.
GREETINGS = {
    "hi hello hey yo sup howdy hiya heya hullo": ["", " there", " y'all", " you", " folks", " everyone"],
    "good morning|good afternoon|good evening|good day|good night": [""],
    "what's up|whats up|wassup|whaddup|greetings": [""],
    "你好 您好 大家好 嗨 哈喽 哈啰 哈囉 哈罗 喂": ["", "啊", "呀", "吖", "呢", "么", "呗", "哦", "哈"],
    "早 早啊 早安 早上好 中午好 下午好 晚上好 晚安": ["", "啊", "呀", "吖", "呢", "么", "呗", "哦", "哈"],
    "在吗 在嗎 在不在 有人吗 有人嗎 有人在吗 有人在嗎": [""],
    "こんにちは こんばんは おはよう おはようございます やあ どうも はじめまして": [""],
    "안녕 안녕하세요 안녕하십니까": [""],
    "hola bonjour salut coucou hallo servus hej hejsan ciao saluton ola olá privet привет": [""],
}
#: Fixed value: a longer text is no greeting.
LONGEST_GREETING = 20


def is_greeting(c: Column) -> Column:
    """Whether a text is a greeting and nothing else, whatever marks end it."""
    whole = [w + tail for ws, tails in GREETINGS.items() for w in (ws.split("|") if "|" in ws else ws.split()) for tail in tails]
    s = F.lower(F.trim(F.regexp_replace(F.trim(c), r"[\s!！。.?？~,，、;；:：]+$", "")))
    return F.coalesce((F.length(s) <= LONGEST_GREETING) & s.isin(whole), F.lit(False))


def strip_reasoning(c: Column) -> Column:
    """Without finished and unfinished ``<think>`` parts."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""), r"(?is)<think(?:ing)?>.*$", ""))


def reasoning_chars(line: Column) -> Column:
    """Code points of reasoning in one line of a model's event stream."""
    data = F.regexp_extract(line, r"^data:\s*(\{.*\})\s*$", 1)
    paths = ["$.choices[0].delta.reasoning_content", "$.choices[0].delta.reasoning", "$.delta.thinking"]
    return F.coalesce(*[F.length(F.get_json_object(data, p)) for p in paths], F.lit(0))


def citations(c: Column) -> Column:
    """Numbers cited: those of the hidden comment, else bracketed ones, ascending and once each."""
    hidden = F.regexp_extract(c, r"<!--\s*cited:\s*([\d,\s]+)-->", 1)
    ids = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda x: x.cast("int"))))
    return F.when(hidden != "", ids(F.regexp_extract_all(hidden, F.lit(r"(\d+)"), 1))).otherwise(ids(F.regexp_extract_all(c, F.lit(r"\[(\d{1,4})\]"), 1)))


def cited_pages(c: Column, pages: Column) -> Column:
    """Structs ``title, path`` of the pages that an answer cites.

    pages: the pages that the question was answered from, in order, as structs ``title, path``; may be empty. Numbers of the
    hidden comment count first, then bracketed ones, and where no page has any of these numbers the answer's links: each name
    once, its path below wiki/ (below wiki/entities/ for a bare name).
    """
    at = lambda a: F.filter(F.transform(a, lambda n: F.when((n >= 1) & (n <= F.size(pages)), F.element_at(pages, n))), lambda p: p.isNotNull())
    numbers = lambda s, p: F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(p), 1), lambda x: x.try_cast("int")))
    hidden = at(numbers(F.regexp_extract(c, r"<!--\s*cited:\s*([\d,\s]+)-->", 1), r"(\d+)"))
    bracketed = at(numbers(c, r"\[(\d+)\]"))
    link = r"\[\[([^\]|]+?)(?:\|([^\]]+?))?\]\]"
    names = F.transform(F.regexp_extract_all(c, F.lit(link), 1), _trim)
    labels = F.transform(F.regexp_extract_all(c, F.lit(link), 2), _trim)
    path = lambda n: F.concat(F.when(n.contains("/"), F.lit("wiki/")).otherwise(F.lit("wiki/entities/")), n, F.lit(".md"))
    each = F.zip_with(names, labels, lambda n, label: F.struct(F.when(label != "", label).otherwise(n).alias("title"), path(n).alias("path")))
    linked = F.filter(each, lambda x, i: F.array_position(names, F.element_at(names, i + 1)) == i + 1)
    return F.when(F.size(hidden) > 0, hidden).when(F.size(bracketed) > 0, bracketed).otherwise(linked)


def entity_summary(c: Column, size: int = 200) -> Column:
    """Description of the frontmatter, else the first line that is no heading, table or list mark, cut with an ellipsis."""
    from pagelattice.functions.markdown import body, frontmatter_block, scalar_field

    line = F.element_at(F.filter(F.transform(F.split(body(c), r"\r?\n"), _trim), lambda s: (s != "") & ~s.rlike(r"^(?:#|\||```|~~~|---)")), 1)
    text = F.coalesce(scalar_field(frontmatter_block(c), "description"), line)
    return F.when(frontmatter_block(c).isNotNull(), F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text))


def fnv64(text: str) -> str:
    """FNV-1a of 64 bits over UTF-16 code units, as hex."""
    h = 0xCBF29CE484222325
    data = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] | data[i + 1] << 8)) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv32_base36(text: str) -> str:
    h = 0x811C9DC5
    for b in text.encode():
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    out = ""
    while True:
        h, r = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        if not h:
            return out


def summary_slug(identity: str, size: int = 120) -> str:
    """A file stem for a source's summary: the stem itself without folders, else length-prefixed parts and a hash."""
    parts = [p for p in identity.replace("\\", "/").split("/") if p]
    if not parts:
        return "source"
    stem = re.sub(r"(.)\.[^.]*$", r"\1", parts[-1])
    if len(parts) == 1:
        return stem
    enc = "-".join(f"{len(p)}{re.sub(r'[^0-9A-Za-z]+', '-', unicodedata.normalize('NFKC', p)).strip('-')}" for p in [*parts[:-1], stem])
    tail = "-" + fnv32_base36(identity)
    return enc[: size - len(tail)] + tail


#: LaTeX commands and what they stand for.
LATEX = {
    "rightarrow": "→", "Rightarrow": "⇒", "longrightarrow": "⟶", "leftarrow": "←", "Leftarrow": "⇐", "longleftarrow": "⟵", "leftrightarrow": "↔", "Leftrightarrow": "⇔",
    "uparrow": "↑", "Uparrow": "⇑", "downarrow": "↓", "Downarrow": "⇓", "mapsto": "↦", "hookrightarrow": "↪", "hookleftarrow": "↩",
    "nearrow": "↗", "nwarrow": "↖", "searrow": "↘", "swarrow": "↙",
    "times": "×", "div": "÷", "pm": "±", "mp": "∓", "cdot": "·", "ast": "∗", "star": "⋆", "circ": "∘", "bullet": "•", "oplus": "⊕", "otimes": "⊗",
    "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "sim": "∼", "simeq": "≃", "equiv": "≡", "cong": "≅",
    "propto": "∝", "ll": "≪", "gg": "≫", "prec": "≺", "succ": "≻", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇",
    "in": "∈", "notin": "∉", "ni": "∋", "cap": "∩", "cup": "∪", "vee": "∨", "wedge": "∧", "neg": "¬", "lnot": "¬",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "ϑ",
    "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "varpi": "ϖ", "rho": "ρ", "varrho": "ϱ",
    "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "ϕ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "infty": "∞", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃", "emptyset": "∅", "varnothing": "∅", "wp": "℘", "Re": "ℜ", "Im": "ℑ",
    "aleph": "ℵ", "hbar": "ℏ", "ell": "ℓ", "sharp": "♯", "flat": "♭", "natural": "♮", "clubsuit": "♣", "diamondsuit": "♢", "heartsuit": "♡", "spadesuit": "♠",
    "sum": "∑", "prod": "∏", "coprod": "∐", "int": "∫", "oint": "∮", "bigcup": "⋃", "bigcap": "⋂", "bigoplus": "⨁", "bigotimes": "⨂",
    "ldots": "…", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱",
    "quad": "  ", "qquad": "    ", "text": "", "mathrm": "", "mathbf": "", "mathit": "", "textbf": "", "textit": "", "textrm": "",
    "langle": "⟨", "rangle": "⟩", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉", "lvert": "|", "rvert": "|",
    "hat": "^", "tilde": "~", "bar": "‾", "vec": "→", "dot": "·", "ddot": "¨",
    "log": "log", "ln": "ln", "exp": "exp", "sin": "sin", "cos": "cos", "tan": "tan", "min": "min", "max": "max", "sup": "sup", "inf": "inf", "lim": "lim",
    "sqrt": "√", "frac": "/",
}


def replace_each(c: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """Each match of the pattern replaced by ``f`` of its first group."""
    kept = F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), f)
    return F.array_join(F.flatten(F.zip_with(F.split(c, pattern), kept, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def latex_to_unicode(c: Column) -> Column:
    """Commands between dollars replaced and the dollars dropped; display math gets lines of its own. Unknown commands and text outside of math stay."""
    table = F.create_map(*[F.lit(x) for kv in LATEX.items() for x in kv])
    known = lambda name: F.coalesce(F.try_element_at(table, name), F.concat(F.lit("\\"), name))
    alone = replace_each(c, r"\$\\([a-zA-Z]+)\$", known)
    shown = let(alone, lambda s: F.regexp_replace(s, r"\$\$([^$]+)\$\$", "\n$1\n"))
    return let(shown, lambda s: replace_each(s, r"\$([^$]+)\$", lambda inner: replace_each(inner, r"\\([a-zA-Z]+)", known)))

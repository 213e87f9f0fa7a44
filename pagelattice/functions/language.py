"""Language of a text from its scripts, marks and frequent words, as one expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelattice.functions.bind import let

#: Code point ranges of each script, under the language it stands for.
SCRIPTS = {
    "Chinese": "4E00-9FFF 3400-4DBF 20000-2A6DF F900-FAFF", "Japanese": "3040-309F 30A0-30FF 31F0-31FF FF65-FF9F", "Korean": "AC00-D7AF 1100-11FF 3130-318F",
    "Arabic": "0600-06FF 0750-077F 08A0-08FF FB50-FDFF FE70-FEFF", "Hebrew": "0590-05FF FB1D-FB4F", "Thai": "0E00-0E7F", "Hindi": "0900-097F", "Bengali": "0980-09FF",
    "Tamil": "0B80-0BFF", "Telugu": "0C00-0C7F", "Kannada": "0C80-0CFF", "Malayalam": "0D00-0D7F", "Gujarati": "0A80-0AFF", "Punjabi": "0A00-0A7F",
    "Burmese": "1000-109F", "Khmer": "1780-17FF", "Lao": "0E80-0EFF", "Georgian": "10A0-10FF 2D00-2D2F", "Armenian": "0530-058F", "Amharic": "1200-137F",
    "Tibetan": "0F00-0FFF", "Sinhala": "0D80-0DFF", "Russian": "0400-04FF 0500-052F", "Greek": "0370-03FF 1F00-1FFF",
}
#: Latin-script languages in the order in which they are tried: marks, words, and whether both are needed.
LATIN = [
    ("Vietnamese", "ảạắằẳẵặấầẩẫậđẻẽẹếềểễệỉĩịỏọốồổỗộơớờởỡợủũụưứừửữựỷỹỵ", "", "any"),
    ("Turkish", "ğış", "bir ve için ile bu da de değil ama", "both"),
    ("Polish", "ąćęłńóśźż", "", "any"),
    ("Czech", "ěšžřďťňů", "", "any"),
    ("Romanian", "ăâîșț", "și este sau care pentru", "both"),
    ("Hungarian", "őű", "", "any"),
    ("German", "", "und der die das ist", "any"),
    ("French", "", "le la les est une des", "any"),
    ("Portuguese", "ãõç", "o a os as de do da é em um uma não que", "both"),
    ("Spanish", "ñ¿¡", "el los las del por", "any"),
    ("Italian", "", "il della gli che è", "any"),
    ("Dutch", "", "het een van dat", "any"),
    ("Swedish", "åäö", "och att det en ett är för med", "both"),
    ("Norwegian", "åæø", "og er det en et for med på", "both"),
    ("Danish", "åæø", "og er det en et til med af", "both"),
    ("Finnish", "äö", "ja on ei se että tai kun niin", "both"),
    ("Indonesian", "", "yang dari untuk dengan adalah", "any"),
    ("Swahili", "", "na ya wa ni kwa katika hii hiyo", "any"),
]
#: Letters and words that tell Persian from Arabic, with their weights.
PERSIAN = [("پچژگ", 3), ("کی", 1)]
ARABIC = [("كيةىإأؤئ", 1)]
PERSIAN_WORDS = "این است که برای های را در به از می یک".split()
ARABIC_WORDS = "ال في من على هذا هذه إلى التي الذي كان".split()
#: Languages that one text can hardly be told apart in.
FAMILY = {"Chinese": "cjk", "Japanese": "cjk", "Korean": "cjk"}

_ASCII = "[A-Za-z0-9_]"


def script_class(name: str) -> str:
    return "[" + "".join(r"\x{%s}-\x{%s}" % tuple(r.split("-")) for r in SCRIPTS[name].split()) + "]"


def word_pattern(words: str, edge: bool = False) -> str:
    """Any of the words at ASCII word boundaries. edge: without look-around, for engines that lack it; fit for tests only."""

    def one(w: str) -> str:
        inner = lambda ch: ch.isascii() and (ch.isalnum() or ch == "_")
        if edge:
            return (r"(?:^|[^A-Za-z0-9_])" if inner(w[0]) else _ASCII) + w + (r"(?:$|[^A-Za-z0-9_])" if inner(w[-1]) else _ASCII)
        return (f"(?<!{_ASCII})" if inner(w[0]) else f"(?<={_ASCII})") + w + (f"(?!{_ASCII})" if inner(w[-1]) else f"(?={_ASCII})")

    return "(?:" + "|".join(one(w) for w in words.split()) + ")"


def script_counts(c: Column) -> dict[str, Column]:
    return {n: F.length(c) - F.length(F.regexp_replace(c, script_class(n), "")) for n in SCRIPTS}


def _arabic_or_persian(c: Column) -> Column:
    count = lambda marks: F.length(c) - F.length(F.regexp_replace(c, f"[{marks}]", ""))
    words = F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    holds = lambda ws: sum((F.when(words.contains(f" {w} "), 2).otherwise(0) for w in ws), F.lit(0))
    p = sum((count(m) * n for m, n in PERSIAN), F.lit(0)) + holds(PERSIAN_WORDS)
    a = sum((count(m) * n for m, n in ARABIC), F.lit(0)) + holds(ARABIC_WORDS)
    return F.when((p >= 3) & (p > a), "Persian").otherwise("Arabic")


def detect_language(c: Column) -> Column:
    """English name of the language; Japanese if kana and Han meet, else the most frequent script (ties: first in the table), else the first Latin rule that holds, else English. Null for null."""
    wide_only = F.regexp_replace(c, r"[\x00-\x{24F}]+", "")
    # what is used more than once is bound as a lambda's variable: as plain columns it would be evaluated again for each use
    latin = let(F.lower(c), lambda low: let(F.array_distinct(F.split(low, "[^A-Za-z0-9_]+")), lambda words: let(F.regexp_replace(low, r"[\x00-\x7F]+", ""), lambda accents: _latin(low, words, accents))))
    by_script = let(wide_only, lambda s: let(_most(s), lambda t: F.when(t["n"] < 2, latin).when(t["name"] == "Arabic", _arabic_or_persian(c)).otherwise(t["name"])))
    kana = c.rlike(script_class("Japanese")) & c.rlike(script_class("Chinese"))
    wide = F.when(kana, "Japanese").otherwise(by_script)
    return F.when(c.isNull(), None).when(c.rlike(r"[^\x00-\x{24F}]"), wide).otherwise(latin)


def _most(s: Column) -> Column:
    return F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("turn"), F.lit(name).alias("name")) for i, (name, n) in enumerate(script_counts(s).items())]))


def _latin(low: Column, words: Column, accents: Column) -> Column:
    """The first rule that holds. A word of ASCII letters alone is looked up among the text's words; marks, and other words before they are looked for, among its few characters beyond ASCII."""
    out = F.lit("English")
    for name, marks, ws, mode in reversed(LATIN):
        plain, other = [w for w in ws.split() if w.isascii()], [w for w in ws.split() if not w.isascii()]
        tests = ([F.arrays_overlap(words, F.array(*map(F.lit, plain)))] if plain else []) + ([accents.rlike("[" + "".join(sorted({ch for w in other for ch in w if not ch.isascii()})) + "]") & low.rlike(word_pattern(" ".join(other)))] if other else [])
        word = reduce(lambda x, y: x | y, tests) if tests else None
        mark = accents.rlike(f"[{marks}]") if marks else None
        hit = word if mark is None else mark if word is None else (mark & word) if mode == "both" else (mark | word)
        out = F.when(hit, name).otherwise(out)
    return out


def prose(c: Column) -> Column:
    """The text without frontmatter, code and math, its first 1500 code points; what the language guard looks at."""
    from pagelattice.functions.markdown import body

    s = F.regexp_replace(body(c), r"(?s)```.*?(?:```|\z)|~~~.*?(?:~~~|\z)", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"`[^`\n]*`", " "), r"(?s)\$\$.*?\$\$|\$[^$\n]+\$", " ")
    return F.substring(F.trim(s), 1, 1500)


def matches_language(c: Column, wanted: Column) -> Column:
    """True if the text is short or in the wanted language; the East Asian ones and all Latin ones count as one each."""
    latin = [r[0] for r in LATIN] + ["English"]
    family = lambda x: F.when(x.isin(list(FAMILY)), "cjk").when(x.isin(latin), "latin").otherwise(x)
    seen = F.transform(F.array(prose(c)), lambda t: (F.length(t) < 20) | F.transform(F.array(detect_language(t)), lambda s: family(s) == family(wanted))[0])
    return seen[0]

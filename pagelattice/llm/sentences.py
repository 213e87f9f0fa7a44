"""Sentence units of texts in any script, with document-centred disambiguation of full stops.

A text is read line by line: frontmatter, fenced code, table rows and rulers hold no units, headings and list items are one
unit each, and the lines between are paragraphs. Within a paragraph quotations and brackets are matched first, since a
mark inside them ends nothing; then each mark outside is judged. Marks of scripts that have them only for this purpose
always end a unit.

A full stop is judged by two questions, each asked of the document first, then of the corpus, then of fixed lists:

* Is the word before it an abbreviation? Unambiguous in the document are a word that it also writes inside a sentence without
  a stop (it is none), and one that it writes with a stop and a small letter or digit behind it again and again, never without
  a stop, while its other sentences begin with capitals (it is one). The corpus answers likewise by the counts of all documents.
  Only for words on which both are silent do the lists of abbreviations decide.
* Does the capital behind it begin a sentence or a proper name? A word that the document writes small inside sentences is
  a common one, so the capital begins a sentence; one that it writes with a capital inside sentences is a name.

The corpus evidence is counted in one pass over all documents with partial aggregation. A word becomes part of it by its share
of all counts (``SHARE``), so that no more than 1 / SHARE words of a kind can reach the driver, however large the corpus is.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.session import shared_checkpoint

#: Abbreviations that something must follow, so that they end no sentence.
OPEN = set(
    """dr mr mrs ms mx prof st mt ft sgt capt col gen lt maj rev hon pres gov sen rep messrs mme mmes mlle mm me mgr sr sra srta dra ud uds
    hr fr frl dipl ing dott sig fig figs eq sec ch vol vols pp pg nr nos art tab abb bd hrsg vgl approx ca env aprox vs cf viz i.e e.g ie eg
    d.h z.b u.a i.d.r bspw bzw sog evtl ggf inkl zzgl c.-à-d c.à.d p.ex p.ej ej pág págs núm tel abt str tr ed eds al-d डॉ श्री د أ م सु पं""".split()
)
#: Single small letters that stand before a number or another abbreviation, with what must follow.
LETTER_BEFORE = {"p": "digit", "n": "digit", "z": "letter", "d": "letter", "h": "letter", "u": "letter", "c": "letter"}
#: Abbreviations that may also stand at a sentence's end.
CLOSED = set("etc usw u.s.w ltd inc co corp bros jr al a.m p.m u.s u.k u.n e.u b.c a.d ph.d m.d d.c dept est s.a s.l usf ff jh a.c d.c".split())
#: A number and a stop before one of these is a day of the month.
MONTHS = set(
    """januar jänner februar märz april mai juni juli august september oktober november dezember
    januari februari maart mei augustus oktober ledna února března dubna května června července srpna září října listopadu prosince""".split()
)
ALWAYS = "。！？｡．؟۔।॥"
CLOSERS = "\"”“’»›」』》〉】）)]"
PAIRS = {"“": "”", "„": "“”", "‘": "’", "«": "»", "「": "」", "『": "』", "《": "》", "（": "）", "(": ")", "【": "】"}
SHUTS = {"”", "’", "»", "」", "』", "》", "）", ")", "】"}
#: Japanese particles and Chinese verbs of saying that carry a sentence on behind a quotation.
CARRIES = "とっがはをにのでもへや"

_SPECIAL = re.compile(r"[\"“”„‘’«»「」『』《》（）()【】]|[.!?…]+|[。！？｡．؟۔।॥]+")
_QUOTE = re.compile(r"[\"“„‘«「『《（(【]")
_TAIL = re.compile(r"(?:\[\^?[^\]\[\s]+\](?!\()|[¹²³⁰⁴-⁹]+|[*_]+(?=[\s\[]|$))+")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})(.*)", re.S)
_HEAD = re.compile(r"[ \t]*#{1,6}(?:\s|$)")
_BULLET = re.compile(r"\s*[-*+•]\s+\S")
_NUMBER = re.compile(r"\s*\d{1,9}[.)]\s+\S")
_RULER = re.compile(r"\s*(?:[-*_=]\s*){3,}$")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_CUTS = frozenset(" \t\r\n\u00a0\u3000\"“”„‘’«»「」『』()（）[]*_|,;:—")
_THAI = re.compile(r"[ก-๛]")
_LETTER = re.compile(r"[^\W\d_]")
_STOP = re.compile(r"\.\s+(?=([^\W_]))")
_SOLID = re.compile(r"\S+")
_LETTERS = re.compile(r"[^\W\d_]+")


#: A word inside a sentence and without a stop: behind a small letter (or one of a script without capitals) or a comma.
_SMALL = r"[^\W\d_A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚŠŽŁŚŻА-ЯЁ]"
_MID = re.compile(rf"(?:(?<={_SMALL} )|(?<=[,;] ))([^\W\d_]+)(?=[\s,;:])")

#: The least share of all stops, or of all words inside sentences, from which the corpus speaks of a word; and the least count.
SHARE, LEAST = 1e-5, 5


def word_before(text: str, i: int, floor: int = 0) -> str:
    """What stands before position ``i`` without a blank, quotation mark, bracket or comma."""
    k = i
    while k > floor and text[k - 1] not in _CUTS and not text[k - 1].isspace():
        k -= 1
    return text[k:i]


class Uses:
    """How a text uses words: with a stop that a small letter or digit follows (``low``), that any letter or digit follows (``stops``), and inside sentences without a stop (``mid``)."""

    def __init__(self, text: str):
        self.text, self.low, self.stops, self._mid = text, Counter(), Counter(), None
        for m in _STOP.finditer(text):
            w = word_before(text, m.start())
            if w and w[-1] != "." and not w[0].isdigit():
                self.stops[w] += 1
                if m[1].islower() or m[1].isdigit():
                    self.low[w] += 1
        self.n_low, self.n_stops = self.low.total(), self.stops.total()

    @property
    def mid(self) -> Counter:
        if self._mid is None:
            self._mid = Counter(_MID.findall(self.text))
        return self._mid

    def kind(self, w: str) -> str | None:
        """``abbr`` or ``plain`` where the text's own uses of the word leave no doubt."""
        low, n = self.low[w], self.stops[w]
        if (mid := self.mid[w]) and mid >= low:
            return "plain"
        if low >= 2 and 2 * low >= n and not mid and 5 * (self.n_low - low) <= self.n_stops - n:
            return "abbr"
        return None

    def common(self, w: str) -> bool | None:
        """Whether a capitalised word is written small inside sentences (True) or with its capital (False)."""
        small, big = self.mid[w.lower()], self.mid[w]
        return None if bool(small) == bool(big) else bool(small)


class Corpus:
    """The same of all documents, for frequent words: counts by word."""

    def __init__(self, low: dict[str, int] | None = None, stops: dict[str, int] | None = None, mid: dict[str, int] | None = None):
        self.low, self.stops, self.mid = low or {}, stops or {}, mid or {}

    def kind(self, w: str) -> str | None:
        low, n, mid = self.low.get(w, 0), self.stops.get(w, 0), self.mid.get(w, 0)
        if mid > n:
            return "plain"
        return "abbr" if low and 5 * low >= n and 2 * mid <= n else None

    def common(self, w: str) -> bool | None:
        small, big = self.mid.get(w.lower(), 0), self.mid.get(w, 0)
        return None if small == big else small > big


class Splitter:
    def __init__(self, corpus: Corpus | None = None):
        self.corpus, self.text, self._uses = corpus or Corpus(), "", None

    @property
    def uses(self) -> Uses:
        if self._uses is None:
            self._uses = Uses(self.text)
        return self._uses

    def ends(self, text: str) -> list[int]:
        """End positions (code points from the start) of all units of ``text``."""
        out: list[int] = []
        start = fence = None
        at = front = 0
        m = re.match(r"﻿?\s*?---[ \t]*(?:\r\n|\r|\n)", text)
        if m and (close := re.compile(r"^(?:---|\.\.\.)[ \t]*$", re.M).search(text.replace("\r", "\n"), m.end())):
            at = front = close.end()
        self.text, self._uses = text, None
        for line in _LINE.finditer(text, front):
            at, raw = line.start(), line[0]
            body = raw.strip()
            if fence:
                f = _FENCE.match(raw)
                if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not f[2].strip():
                    fence = None
                continue
            kind = body[:1]
            if not body:
                pass
            elif kind in "`~" and (f := _FENCE.match(raw)):
                fence = f[1]
            elif kind == "|" or kind in "-*_=" and _RULER.match(raw.rstrip()):
                pass
            elif kind == "#" and _HEAD.match(raw) or kind in "-*+•" and _BULLET.match(raw) or kind.isdigit() and start is None and _NUMBER.match(raw):
                if start is not None:
                    self.paragraph(start, at, out)
                    start = None
                if _LETTER.search(body) or any(c.isdigit() for c in body):
                    out.append(at + len(raw.rstrip()))
                continue
            else:
                if start is None:
                    start = at
                continue
            if start is not None:
                self.paragraph(start, at, out)
                start = None
        if start is not None:
            self.paragraph(start, len(text), out)
        return out

    def paragraph(self, s: int, e: int, out: list[int]) -> None:
        seg = self.text[s:e].rstrip()
        first = len(seg) - len(seg.lstrip())
        if first == len(seg):
            return
        if _THAI.search(seg) and 2 * len(_THAI.findall(seg)) > len(seg.replace(" ", "")) / 2:
            self.thai(seg, s, out)
            return
        begin, last = first, len(seg)
        shut = self.spans(seg) if _QUOTE.search(seg) else {}
        skip = 0
        for m in _SPECIAL.finditer(seg):
            i = m.start()
            if i < skip:
                continue
            ch = seg[i]
            if i in shut:
                close = shut[i]
                end = self.after_quote(seg, begin, i, close)
                skip = close + 1
            elif ch in ".!?…" or ch in ALWAYS:
                end = self.after_mark(seg, i, m.end(), shut)
            else:
                continue
            if end:
                if end >= last:
                    break
                out.append(s + end)
                skip = end
                begin = end + len(seg[end:]) - len(seg[end:].lstrip()) if end < last else last
        if begin < last:
            out.append(s + last)

    def thai(self, seg: str, s: int, out: list[int]) -> None:
        """Blanks and line breaks divide; what has no Thai letter goes with the unit before it."""
        had = False
        for m in _SOLID.finditer(seg):
            if _THAI.search(m[0]) or not had:
                out.append(s + m.end())
                had = True
            else:
                out[-1] = s + m.end()

    @staticmethod
    def spans(seg: str) -> dict[int, int]:
        """Outermost matched quotations and brackets, opening to closing position; what has no partner is left out."""
        stack: list[tuple[str, int]] = []
        pairs: list[tuple[int, int]] = []
        for m in re.finditer(r"[\"“”„‘’«»「」『』《》（）()【】]", seg):
            ch, i = m[0], m.start()
            if ch == '"':
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == '"':
                        pairs.append((stack[k][1], i))
                        del stack[k:]
                        break
                else:
                    stack.append(('"', i))
                continue
            if ch in SHUTS or ch == "“":
                for k in range(len(stack) - 1, -1, -1):
                    if ch in PAIRS.get(stack[k][0], ""):
                        pairs.append((stack[k][1], i))
                        del stack[k:]
                        break
                else:
                    if ch == "“":
                        stack.append((ch, i))
                continue
            if ch == "‘" and i and seg[i - 1].isalnum():
                continue
            stack.append((ch, i))
        out: dict[int, int] = {}
        reach = -1
        for a, b in sorted(pairs, key=lambda p: (p[0], -p[1])):
            if a > reach:
                out[a] = b
                reach = b
        return out

    def after_quote(self, seg: str, begin: int, i: int, close: int) -> int:
        """The unit's end behind the quotation or bracket from ``i`` to ``close``, or 0 if it goes on."""
        k = close - 1
        while k > i and (seg[k] in CLOSERS or seg[k].isspace()):
            k -= 1
        if seg[k] not in ".!?…" and seg[k] not in ALWAYS:
            return 0
        own = not any(c.isalnum() for c in seg[begin:i])
        if seg[i] in "(（" and not own:
            return 0
        end = self.tail(seg, close + 1)
        nxt, gap = _next(seg, end)
        if not nxt:
            return end
        c = seg[nxt]
        if c in ",;:，；：、—–-" or c.islower() or not gap and c in CARRIES:
            return 0
        if seg[k] == "." and not own and not gap:
            return 0
        return end

    def after_mark(self, seg: str, i: int, j: int, shut: dict[int, int]) -> int:
        """The unit's end behind the marks from ``i`` to ``j``, or 0 if they end nothing."""
        while j < len(seg) and seg[j] in CLOSERS and seg[j] not in '"“' and j not in shut:
            j += 1
        end = self.tail(seg, j)
        nxt, gap = _next(seg, end)
        if not nxt:
            return end
        c = seg[nxt]
        marks = seg[i:j]
        if marks[0] in ALWAYS:
            return end
        before = seg[i - 1] if i else " "
        if not gap and not (end > j and c.isupper()) and not (c in PAIRS and before.isalnum() and not c == "(") and not (marks[0] in "!?" and _wide(before) and _wide(c)):
            return 0
        small = c.islower()
        if marks[0] == "…" or marks.startswith(".."):
            return 0 if small or not gap or before.isspace() or not (c.isupper() or c in PAIRS or c in "¿¡\"") else end
        if marks[0] in "!?":
            return 0 if small and before.isspace() else end
        return end if self.stop(seg, i, nxt, c, small) else 0

    def stop(self, seg: str, i: int, nxt: int, c: str, small: bool) -> bool:
        """Whether the single full stop at ``i`` ends a sentence; ``c`` at ``nxt`` is what follows."""
        w = word_before(seg, i)
        if not w:
            return not small
        low = w.lower().lstrip("¿¡")
        digit = c.isdigit()
        if w.isdigit() and len(w) <= 2:
            n = _SOLID.match(seg, nxt)
            return not (small or n and n[0].strip(".,;:!?").lower() in MONTHS)
        if "." in w and low not in OPEN and low not in CLOSED and w.count(".") == len(w) // 2 and all(p.isalpha() and len(p) == 1 for p in w.split(".")):
            return not small and not digit
        kind = self.uses.kind(w) or self.corpus.kind(w)
        letter = len(w) == 1 and w.isupper() or w in ("M", "D", "Mme")
        if kind == "plain" and (low in OPEN or letter):
            # it may still stand before a name here
            return not small and not digit and bool(self.common(seg, nxt))
        if kind == "plain":
            return not (len(w) == 1 and low in LETTER_BEFORE) or not small and not digit
        if low in OPEN:
            return False
        if low in CLOSED:
            return not small and not digit
        if w == "No" or low in ("no", "núm", "nº"):
            return not digit
        if letter:
            return not (c.isalpha() or c in "[*_")
        if len(w) == 1 and low in LETTER_BEFORE and w.islower():
            want = LETTER_BEFORE[low]
            return not (digit or small) if want == "digit" else not (c.isalpha() and (small or low in "zu"))
        if kind == "abbr":
            return not small and not digit and self.common(seg, nxt) is not False
        return True

    def common(self, seg: str, at: int) -> bool | None:
        """Whether the capitalised word at ``at`` is a common one (True) or a name (False)."""
        m = _LETTERS.match(seg, at)
        if not m:
            return None
        known = self.uses.common(m[0])
        return self.corpus.common(m[0]) if known is None else known

    @staticmethod
    def tail(seg: str, end: int) -> int:
        m = _TAIL.match(seg, end)
        return m.end() if m else end


def _next(seg: str, at: int) -> tuple[int, bool]:
    """Position of the next visible character that is no emphasis mark (0 if none), and whether blanks lie before it."""
    k = at
    while k < len(seg) and seg[k].isspace():
        k += 1
    gap = k > at
    while k < len(seg) and seg[k] in "*_[":
        k += 1
    return (k, gap) if k < len(seg) else (0, gap)


def _wide(c: str) -> bool:
    return "　" <= c <= "鿿" or "＀" <= c <= "￯"


def corpus_evidence(docs: DataFrame, text: str) -> Corpus:
    """The uses of words in all documents. Of words inside sentences those of a share of SHARE are kept, of words with a stop those whose stop a small letter or digit follows in that share of all stops, LEAST times at least."""

    def count(batches):
        for b in batches:
            low, stops, mid = Counter(), Counter(), Counter()
            for t in b.column(0).to_pylist():
                if t:
                    u = Uses(t)
                    low.update(u.low)
                    stops.update(u.stops)
                    mid.update(u.mid)
            ws = list(stops.keys() | mid.keys())
            # the row without a word holds the totals
            cols = [[c[w] for w in ws] + [c.total()] for c in (low, stops, mid)]
            yield pa.RecordBatch.from_arrays([pa.array([*ws, None], pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["word", "low", "stops", "mid"])

    each = [F.sum(c).alias(c) for c in ("low", "stops", "mid")]
    seen = shared_checkpoint(docs.select(text).mapInArrow(count, "word string, low bigint, stops bigint, mid bigint").groupBy("word").agg(*each))
    total = seen.where("word IS NULL").first()
    if total is None:
        return Corpus()
    often = lambda c: F.col(c) >= max(LEAST, SHARE * total[c])
    as_stop = F.col("low") >= max(LEAST, SHARE * total.stops)
    rows = seen.where(F.col("word").isNotNull() & (as_stop | often("mid"))).toLocalIterator()
    out = Corpus()
    for r in rows:
        out.low[r.word], out.stops[r.word], out.mid[r.word] = r.low, r.stops, r.mid
    return out


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text", batch_units: int = 1 << 16) -> DataFrame:
    """``key, unit_no, start_pos, end_pos``: the sentence units of every text, positions in code points.

    start_pos is the end of the unit before it or, behind skipped markup and blanks, where its own first character stands.

    Defined results: null, empty and blank texts have no units, nor has a text of frontmatter, code and tables alone; a text
    without any mark is one unit per paragraph; rows with a null key are left out; a repeated row comes out again.
    """
    corpus = docs.sparkSession.sparkContext.broadcast(corpus_evidence(docs, text))

    def run(batches):
        splitter = Splitter(corpus.value)
        for b in batches:
            keys, n, nos, ends = [], [], [], []
            total = 0
            for k, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                e = splitter.ends(t)
                if e:
                    keys.append(k)
                    n.append(len(e))
                    nos.append(np.arange(1, len(e) + 1))
                    ends.extend(e)
                    total += len(e)
                if total >= batch_units:
                    yield _units(b, keys, n, nos, ends)
                    keys, n, nos, ends, total = [], [], [], [], 0
            if total:
                yield _units(b, keys, n, nos, ends)

    d = docs.where(docs[key].isNotNull()).select(docs[key].cast("bigint").alias("key"), docs[text].alias("text"))
    return d.mapInArrow(run, "key bigint, unit_no bigint, end_pos bigint").withColumnRenamed("key", key)


def _units(b, keys, n, nos, ends):
    at = pa.array(np.repeat(keys, n), pa.int64())
    return pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.concatenate(nos), pa.int64()), pa.array(ends, pa.int64())], ["key", "unit_no", "end_pos"])

"""Evaluation passages in a training corpus, by suffix arrays.

Both sides become sequences of words (runs of letters or digits; each Han or kana character is a word). The corpus is read
in shards, bounded runs of documents within an Arrow batch. A training suffix can only match when its first ``min_words``
words are those of some evaluation suffix, which the evaluation set's dictionary of word runs (pairs, fours, eights, ...)
tells exactly; the shard's suffix array holds these suffixes alone, fully ordered by prefix doubling. Every evaluation suffix
is then binary-searched among each matching document's suffixes. The two neighbours of its place have the longest verbatim
matches, whose lengths follow from the doubling's ranks in a logarithmic number of steps, so that passages which repeat a word or a
phrase many times cost no more than others of their length. A document lies in one shard, so nothing is shuffled.

The evaluation set is handed to the workers in blocks of at most ``block_chars`` code points, one broadcast each; the driver
holds one block at a time. A larger set means more passes over the corpus, not more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Han and kana, with the iteration and length marks written among them.
SINGLE = "々-〇ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ\U00020000-\U0003ffff"
#: Words of a shard; a longer text is a shard of its own.
SHARD = 1 << 19
WORD = re.compile(rf"[^\W_{SINGLE}]+|[{SINGLE}]")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Passages:
    """A block of evaluation items as one array of word numbers, with every suffix of ``n`` words or more and the dictionary of its runs of words."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.vocabulary = n, {}
        seqs = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)] for _, t in items]
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.flat = np.array([w for s in seqs for w in (*s, -1)], dtype=np.int64)
        self.sizes = np.array([len(s) + 1 for s in seqs], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(seqs)), self.sizes)
        self.steps: list[tuple[int, np.ndarray]] = []
        gram = self.grams(self.flat, learn=True)
        self.at = np.flatnonzero(gram >= 0)
        order = np.argsort(gram[self.at], kind="stable")
        self.at, self.gram = self.at[order], gram[self.at][order]

    def grams(self, a: np.ndarray, learn: bool = False) -> np.ndarray:
        """The number of the run of ``n`` words that begins at each position, -1 where the evaluation set has no such run.

        Runs are put together from runs of a power of two; each step is a sorted array of the pairs that occur.
        """
        step = iter(self.steps)

        def joined(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
            out = np.full(len(left), -1, dtype=np.int64)
            at = np.flatnonzero(left[: max(len(left) - by, 0)] >= 0)
            at = at[right[at + by] >= 0]
            if learn:
                base = int(right.max(initial=0)) + 1
                key = left[at] * base + right[at + by]
                self.steps.append((base, np.unique(key)))
                known = self.steps[-1][1]
            else:
                base, known = next(step)
                key = left[at] * base + right[at + by]
            if len(known) and len(at):
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[place] == key
                out[at[hit]] = place[hit]
            return out

        power, done, gram = a, 0, None
        for k in range(self.n.bit_length()):
            if self.n >> k & 1:
                gram = power if gram is None else joined(gram, power, done)
                done += 1 << k
            if self.n >> (k + 1):
                power = joined(power, power, 1 << k)
        return gram


class Ranks:
    """Ranks of all suffixes of a sequence by their first 1, 2, 4, ... words, by prefix doubling; negative words end a suffix."""

    def __init__(self, a: np.ndarray, longest: int):
        self.levels = [np.unique(np.maximum(a, -1), return_inverse=True)[1].astype(np.int64)]
        while 1 << (len(self.levels) - 1) < longest:
            r, by = self.levels[-1], 1 << (len(self.levels) - 1)
            behind = np.zeros(len(r), dtype=np.int64)
            behind[: max(len(r) - by, 0)] = r[by:] + 1
            self.levels.append(np.unique(r * (int(r.max(initial=0)) + 2) + behind, return_inverse=True)[1].astype(np.int64))
        ends = np.flatnonzero(a < 0)
        self.room = ends[np.searchsorted(ends, np.arange(len(a)))] - np.arange(len(a))

    @property
    def order(self) -> np.ndarray:
        return self.levels[-1]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``x`` and ``y`` have in common at their beginnings."""
        n = np.zeros(len(x), dtype=np.int64)
        last = len(self.room) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = np.minimum(x + n, last), np.minimum(y + n, last)
            n += (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
        return np.minimum(n, np.minimum(self.room[x], self.room[y]))


def matches(p: Passages, texts: list[str | None]):
    """Arrays ``document, item, words, word in the document, word in the item`` of some texts, the longest of each pair, shard by shard."""
    get, flat, starts, first = p.vocabulary.get, [], [], 0
    for k, t in enumerate(texts):
        starts.append(len(flat))
        if t:
            flat.extend(map(get, words(t), repeat(-1)))
        flat.append(-1)
        if len(flat) >= SHARD or k + 1 == len(texts):
            for doc, *rest in _shard(p, np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)):
                yield doc + first, *rest
            flat, starts, first = [], [], k + 1


def _shard(p: Passages, a: np.ndarray, starts: np.ndarray):
    gram = p.grams(a)
    pos = np.flatnonzero(gram >= 0)
    if not len(pos):
        return
    # what the suffixes can match lies under the runs that begin at them
    cover = np.zeros(len(a) + 1, dtype=np.int64)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + p.n, -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    gap = np.concatenate([np.diff(kept) > 1, [True]])
    place = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(gap)[:-1]])
    small = np.full(int(place[-1]) + 2, -1, dtype=np.int64)
    small[place] = a[kept]
    here = place[np.searchsorted(kept, pos)]
    # the evaluation items that occur, behind the shard's words
    grams = np.unique(gram[pos])
    hit = np.isin(p.gram, grams)
    items = np.unique(p.owner[p.at[hit]])
    sizes = p.sizes[items]
    begin = len(small) + np.cumsum(sizes) - sizes
    behind = p.flat[np.repeat(p.starts[items] - (begin - len(small)), sizes) + np.arange(int(sizes.sum()))]
    there = begin[np.searchsorted(items, p.owner[p.at[hit]])] + p.at[hit] - p.starts[p.owner[p.at[hit]]]
    ranks = Ranks(np.concatenate([small, behind]), int(sizes.max()))
    doc = np.searchsorted(starts, pos, "right") - 1
    wide = int(ranks.order.max()) + 1
    keys = doc * wide + ranks.order[here]
    array = np.argsort(keys, kind="stable")
    keys, here, at_doc = keys[array], here[array], doc[array]
    word = pos[array] - starts[at_doc]
    # every evaluation suffix that begins as some suffix of a document does is looked for in that document
    pairs = np.unique(gram[pos] * len(starts) + doc)
    g, d = pairs // len(starts), pairs % len(starts)
    lo = np.searchsorted(p.gram[hit], g, "left")
    count = np.searchsorted(p.gram[hit], g, "right") - lo
    total = np.cumsum(count)
    s = 0
    best: list[np.ndarray] = []
    while s < len(pairs):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + SHARD, "right")))
        n = count[s:e]
        which = np.repeat(lo[s:e] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        of, q = np.repeat(d[s:e], n), there[which]
        j = np.searchsorted(keys, of * wide + ranks.order[q])
        for side in (np.maximum(j - 1, 0), np.minimum(j, len(keys) - 1)):
            ok = at_doc[side] == of
            i = side[ok]
            best.append(_longest(of[ok], p.owner[p.at[hit]][which[ok]], ranks.common(q[ok], here[i]), word[i], (p.at[hit] - p.starts[p.owner[p.at[hit]]])[which[ok]]))
        s = e
    doc, item, n, x, y = _longest(*np.concatenate(best, axis=1))
    yield doc, p.ids[item], n, x, y


def _longest(doc, item, n, x, y) -> np.ndarray:
    """The rows of the most words of each (doc, item), ties by the lowest positions."""
    rows = np.stack([doc, item, n, x, y])
    rows = rows[:, np.lexsort((y, x, -n, item, doc))]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
    return rows[:, new]


def blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    held, chars = [], 0
    for k, t in items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).distinct().toLocalIterator():
        held.append((k, t))
        chars += len(t)
        if chars >= block_chars:
            yield held
            held, chars = [], 0
    yield held


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = 12, block_chars: int = 1 << 22) -> DataFrame:
    """``doc_id, item_id, n_words, doc_word, item_word``: the longest passage of each item in each document, if it has ``min_words``, and a place of it in both.

    Defined results: null, empty and wordless texts match nothing; an item shorter than ``min_words`` has no passage; rows
    with a null key are left out; repeated rows of one document give one row; no items or no documents give no rows.
    """
    d = docs.where(docs[doc_key].isNotNull()).select(docs[doc_key].cast("bigint").alias("doc_id"), docs[doc_text].alias("text"))

    names = ["doc_id", "item_id", "n_words", "doc_word", "item_word"]

    def over(block):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            p = Passages(held.value, min_words)
            for b in batches:
                keys = b.column(0)
                for doc, *rest in matches(p, b.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc, pa.int64())), *[pa.array(c, pa.int64()) for c in rest]], names=names)

        return d.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))

    found = reduce(DataFrame.unionByName, [over(b) for b in blocks(items, item_key, item_text, block_chars)])
    best = F.max_by(F.struct("n_words", "doc_word", "item_word"), F.struct("n_words", -F.col("doc_word"), -F.col("item_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def without_leaks(docs: DataFrame, found: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The documents that hold no passage."""
    return docs.join(found.select(F.col("doc_id").alias(doc_key)).distinct(), doc_key, "left_anti")

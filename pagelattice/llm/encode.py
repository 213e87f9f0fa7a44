"""Encoding of a corpus with a public tokenizer, and decoding back to the raw bytes.

The rank file is read once per Python worker from a local path (a parameter; it is never copied). Texts longer than
``PIECE`` code points are cut at boundaries where the pre-tokenizer's pattern can't match across: a visible character
followed by a blank or a line feed, since every alternative of the pattern that takes a blank takes it first. The pieces'
ids concatenate to the ids of the whole text. A stretch without such a boundary stays whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 15
#: Code points of text that are encoded before a batch is handed on; bounds the worker's memory.
BATCH_CHARS = 1 << 20
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
_loaded: dict[str, object] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoding(path: str, pattern: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` code points, cut only at safe boundaries."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key, ids``: the token ids of every row's text, without special tokens.

    Defined results: an empty text and a null text both give the empty list; rows with a null key and repeated rows are
    encoded like any other; special-token strings inside a text are ordinary text. One pass, no shuffle.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            at = 0
            while at < len(b):
                ids, chars, start = [], 0, at
                while at < len(b) and chars < BATCH_CHARS:
                    t = texts[at].as_py()
                    chars += len(t or "") + 1
                    ids.append(encode_text(enc, t))
                    at += 1
                yield pa.RecordBatch.from_arrays([keys.slice(start, at - start), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key, raw``: the bytes that the ids stand for. An empty or null list gives empty bytes; an unknown id is an error.

    Bytes, not text, since a list cut anywhere may end inside a character.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["key", "raw"])

    return encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids")).mapInArrow(run, f"key {kind}, raw binary").withColumnRenamed("key", key)

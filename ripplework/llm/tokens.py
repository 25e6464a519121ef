"""Encoding with a public byte-level BPE, read from a local rank file.

A text is encoded as it stands, special-token strings included. A NULL text and an empty one both have the empty list of ids.
Long texts are split before encoding where the vocabulary's pre-tokenizer splits in any case: between a character that isn't
white space and white space after it. A stretch without such a place is encoded whole, but for long runs of white space, which
its pattern could not backtrack over: the run, less its last character where a text follows, is one pre-token. Bytes that aren't UTF-8
are encoded as bytes. Decoding gives the bytes of the text, so it is exact for every id list.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabulary files on every machine.
TOKENIZERS = os.environ.get("RIPPLEWORK_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_TEXT = 65_536
LONG_BLANK = 4_096
#: Texts that a task holds as Python objects at once.
TEXTS_AT_ONCE = 256
_SAFE = re.compile(r"(?<=\S)(?=\s)")
_BLANK = re.compile(rf"\s{{{LONG_BLANK},}}")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def spaced(text: str) -> str:
    """The text for searches of white space: the separators U+001C to U+001F, which are white space to Python but not to the
    pre-tokenizer, are replaced by another character that isn't."""
    return _SEPARATORS.sub("\x00", text)


class Codec:
    """One vocabulary. Take it from ``codec``, which loads it once a Python worker."""

    def __init__(self, folder: str = TOKENIZERS, ranks: str = RANKS):
        import tiktoken

        with open(os.path.join(folder, ranks), "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self._bytes = {rank: token for token, rank in table.items()}
        self.lengths = np.zeros(max(self._bytes) + 1, np.int64)
        for rank, token in self._bytes.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str | None, long_text: int = LONG_TEXT) -> list[int]:
        if not text:
            return []
        if len(text) <= long_text:
            return self._encoding.encode_ordinary(text)
        ids, at, seen = [], 0, spaced(text)
        while at < len(text):
            cut = _SAFE.search(seen, at + long_text) if at + long_text < len(text) else None
            end = cut.start() if cut else len(text)
            for blank in _BLANK.finditer(seen, at, end):
                stop = blank.end() - (blank.end() < len(text))
                ids += self._encoding.encode_ordinary(text[at : blank.start()])
                ids += self._encoding._encode_single_piece(text[blank.start() : stop])
                at = stop
            ids += self._encoding.encode_ordinary(text[at:end])
            at = end
        return ids

    def encode_bytes(self, raw: bytes | None) -> list[int]:
        if not raw:
            return []
        try:
            return self.encode(raw.decode())
        except UnicodeDecodeError:
            return self._encoding._encode_bytes(raw)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


def codec(folder: str = TOKENIZERS, ranks: str = RANKS) -> Codec:
    """The vocabulary, kept for the next task of this worker. The package is sent to each task anew, so it can't keep anything itself."""
    kept = sys.__dict__.setdefault("_ripplework_codecs", {})
    if (folder, ranks) not in kept:
        kept[folder, ranks] = Codec(folder, ranks)
    return kept[folder, ranks]


def few(batches: Iterator[pa.RecordBatch], texts: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``texts`` rows."""
    for batch in batches:
        yield from (batch.slice(at, texts) for at in range(0, batch.num_rows, texts))


def with_ids(df: DataFrame, text: str, ids: str = "ids", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """``df`` with the ids of column ``text`` beside it, under ``ids``. Other columns pass unchanged; ``ids`` must be free."""
    if ids in df.columns:
        raise ValueError(f"there is a column {ids}")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(folder, ranks)
        for batch in few(batches):
            coded = [known.encode_bytes(raw) for raw in batch.column(at).cast(pa.binary()).to_pylist()]
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(x) for x in coded], out=offsets[1:])
            flat = np.fromiter((i for x in coded for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*batch.schema.names, ids])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{ids}` array<int>")


def with_token_count(df: DataFrame, text: str, name: str = "n_tokens", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """``df`` without ``text``, with the number of its tokens under ``name``. NULL and empty texts have 0."""
    at = df.columns.index(text)
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(folder, ranks)
        for batch in few(batches):
            n = [len(known.encode_bytes(raw)) for raw in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64())], [*kept, name])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != text)
    return df.mapInArrow(run, f"{fields}`{name}` long")


def with_text(df: DataFrame, ids: str, text: str = "raw", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """``df`` with the bytes that column ``ids`` decodes to, under ``text``. NULL and empty lists give empty bytes."""
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(folder, ranks)
        for batch in few(batches):
            raw = [known.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{text}` binary")


def round_trip(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with ``n_tokens`` and ``same``: whether its ids decode to its very bytes (of NULL, to none)."""
    coded = with_text(with_ids(df, text, "_ids"), "_ids", "_raw")
    same = F.col("_raw") == F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    return coded.select(*(c for c in df.columns if c != text), F.size("_ids").cast("long").alias("n_tokens"), same.alias("same"))

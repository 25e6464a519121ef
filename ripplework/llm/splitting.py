"""Cutting texts above a token limit into overlapping pieces at natural boundaries.

Recursive bisection: a stretch that is longer than the limit less the overlap is cut at the strongest boundary in the middle
half of its tokens, of equally strong ones at that nearest to the midpoint, and both halves go on alike. Boundaries are, from
the strongest: blank line, line end, sentence end, clause end, other white space. All lie between a character that isn't white
space and the white space after it, where the pre-tokenizer splits too, so a piece has the same tokens alone as in the text.
Where the middle half has none, the cut falls between two characters near the midpoint. Then each piece but the first gets up
to ``overlap`` tokens of the text before it, from a boundary on where there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripplework.llm.tokens import RANKS, TOKENIZERS, Codec, codec, few, spaced

LIMIT, OVERLAP = 1024, 64
_CLOSERS = "[\"'”’»)\\]}]*"
#: Boundaries from the strongest; each ends where the white space begins.
_BOUNDARIES = tuple(map(re.compile, (r"(?<=\S)(?=[^\S\n]*\n[^\S\n]*\n)", r"(?<=\S)(?=[^\S\n]*\n)", rf"[.!?…؟。]{_CLOSERS}(?=\s)", rf"[,;:،؛]{_CLOSERS}(?=\s)", r"(?<=\S)(?=\s)")))


def pieces(text: str, codec: Codec, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, core start, end, tokens) of each piece, in characters. The cores are the text, without gap or overlap."""
    ids = codec.encode(text)
    if len(ids) <= limit:
        return [(0, 0, len(text), len(ids))]
    seen = spaced(text)
    width = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (width > 0x7F).astype(np.int64) + (width > 0x7FF) + (width > 0xFFFF)
    # tokens before each character
    before = np.searchsorted(np.concatenate(([0], np.cumsum(codec.lengths[ids]))), np.concatenate(([0], np.cumsum(width))))

    def natural(at: int) -> bool:
        return at in (0, len(text)) or seen[at].isspace() and not seen[at - 1].isspace()

    def tokens(a: int, b: int) -> int:
        return int(before[b] - before[a]) if natural(a) and natural(b) else len(codec.encode(text[a:b]))

    def halve(a: int, b: int) -> int:
        mid, quarter = (before[a] + before[b]) / 2, (before[b] - before[a]) / 4
        lo, hi = (int(np.searchsorted(before, mid + d, side)) for d, side in ((-quarter, "left"), (quarter, "right")))
        for kind in _BOUNDARIES:
            if at := [m.end() for m in kind.finditer(seen, max(lo - 1, a), min(hi + 1, len(text))) if max(lo, a + 1) <= m.end() < min(hi, b)]:
                return min(at, key=lambda x: (abs(before[x] - mid), x))
        return min(max(int(np.searchsorted(before, mid)), a + 1), b - 1)

    size = limit - overlap
    cores, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a > 1 and (before[b] - before[a] > size or tokens(a, b) > size):
            m = halve(a, b)
            todo += [(m, b), (a, m)]
        else:
            cores.append((a, b))
    out = [(0, 0, cores[0][1], tokens(*cores[0]))]
    for a, b in cores[1:]:
        least = int(np.searchsorted(before, before[a] - overlap))
        near = _BOUNDARIES[-1].search(seen, least, a)
        start = near.end() if near else least
        # a cut inside a word can change its tokens
        while start < a and (more := max(tokens(start, a) - overlap, tokens(start, b) - limit)) > 0:
            start = min(a, start + more)
        out.append((start, a, b, tokens(start, b)))
    return out


def split_texts(df: DataFrame, id_col: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """One row a piece: the id, ``piece_no`` from 0, ``n_pieces``, ``start`` and ``core_start`` and ``stop`` (characters, 0-based),
    ``n_tokens`` and ``piece``. A text within the limit is one piece; the empty text is one piece of 0 tokens; NULL has none."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece_no", "n_pieces", "start", "core_start", "stop", "n_tokens", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(folder, ranks)
        for part in few(batches):
            rows = []
            for row, raw in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                if raw is not None:
                    whole = raw.decode(errors="replace")
                    cut = pieces(whole, known, limit, overlap)
                    rows += [(row, k, len(cut), s, c, e, n, whole[s:e]) for k, (s, c, e, n) in enumerate(cut)]
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names)

    schema = f"`{id_col}` {kind}, piece_no int, n_pieces int, start long, core_start long, stop long, n_tokens long, piece string"
    return df.select(id_col, text).mapInArrow(run, schema)

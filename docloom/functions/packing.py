"""Recursive splitting with overlap: paragraphs, then sentences, then words.

The buffer's state depends on all pieces before, so an Arrow function handles
whole batches of texts; pieces are taken by bisection over running lengths.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import RECURSIVE_CHUNK, RECURSIVE_OVERLAP
from docloom.functions.batches import small_batches

_SENTENCE_END = re.compile(r"(?<=[.?!]) ")


def pack(pieces: list[str], separator: str, finer=None, size: int = RECURSIVE_CHUNK, overlap: int = RECURSIVE_OVERLAP) -> list[str]:
    """Pieces joined up to ``size``; a full buffer's last ``overlap`` characters open the next one, with a line end after them.

    A piece that is too long is split by ``finer`` and its last part stays in
    the buffer; with no finer level it stays whole.
    """
    out: list[str] = []
    buffer, k, n, gap = "", 0, len(pieces), len(separator)
    ends = [0, *accumulate(len(p) + gap for p in pieces)]
    too_long = [i for i, p in enumerate(pieces) if len(p) > size] if finer else []
    long_at = 0
    while k < n:
        if not buffer and not pieces[k]:
            k += 1
            continue
        while long_at < len(too_long) and too_long[long_at] < k:
            long_at += 1
        stop = too_long[long_at] if long_at < len(too_long) else n
        if stop == k:
            if buffer:
                out.append(buffer)
                buffer = ""
            parts = finer(pieces[k])
            if parts:
                out += parts[:-1]
                buffer = parts[-1]
            k += 1
            continue
        if buffer:
            last = min(bisect_right(ends, size - len(buffer) + ends[k]) - 1, stop)
            if last > k:
                buffer += separator + separator.join(pieces[k:last])
                k = last
            else:
                out.append(buffer)
                buffer = buffer[-overlap:] + "\n" + pieces[k]
                k += 1
        else:
            last = max(k + 1, min(bisect_right(ends, size + gap + ends[k]) - 1, stop))
            buffer = separator.join(pieces[k:last])
            k = last
    if buffer:
        out.append(buffer)
    return out


def split_words(text: str) -> list[str]:
    return pack(text.split(" "), " ")


def split_sentences(text: str) -> list[str]:
    return pack(_SENTENCE_END.split(text), " ", split_words)


def split_paragraphs(text: str) -> list[str]:
    return pack(text.split("\n\n"), "\n\n", split_sentences)


def split_recursively(text: str | None) -> list[str]:
    text = (text or "").strip()
    if len(text) <= RECURSIVE_CHUNK:
        return [text] if text else []
    return split_paragraphs(text)


def _arrow(split):
    small_batches()

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([split(t) if t is not None else [] for t in column.to_pylist()], pa.list_(pa.string()))

    return run


def recursive_chunks(c: Column | str) -> Column:
    """Chunks of each text as an array; null and blank texts have none."""
    return _arrow(split_recursively)(c)


def sentence_chunks(c: Column | str) -> Column:
    return _arrow(split_sentences)(c)


def word_chunks(c: Column | str) -> Column:
    return _arrow(split_words)(c)

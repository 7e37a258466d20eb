"""Pieces of text between white space, a slice of rows at a time: distinct pieces and every piece's number among them.

Splitting and numbering run in Arrow; Python sees each distinct piece of a slice once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Arrow and Python split at these, Unicode's White_Space does not have them.
_ODD = "[\x1c-\x1f]"
_SLICE = 8 << 20


def cut_pieces(text: str | None) -> list[str]:
    """Pieces of one text between characters of Unicode's White_Space."""
    if not text:
        return []
    return [w for w in regex.split(r"\p{White_Space}+", text) if w] if regex.search(_ODD, text) else text.split()


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about _SLICE bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        held = int(size[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(size, held + _SLICE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def numbered(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, number of each piece in order, offset of each row's first piece and the end); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if pc.any(pc.match_substring_regex(column, _ODD)).as_py():
        lists = pa.array([cut_pieces(t) for t in column.to_pylist()], pa.large_list(pa.large_string()))
    else:
        lists = pc.utf8_split_whitespace(column)
    off = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), off - off[0]


def strings(column: pa.Array) -> list[str]:
    """A column without nulls as Python strings; much faster than to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


def roots(pieces: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct roots, each piece's root, each piece's mark: 0 none, 1 a full stop, 2 a comma).

    ASCII letters are lower-cased, and a mark behind letters alone is a word of its own in these
    vocabularies, so pieces share what their letters give. Pieces that may hold an added token stay.
    """
    kept = pc.match_substring(pieces, "<|")
    low = pc.if_else(kept, pieces, pc.ascii_lower(pieces))
    marked = pc.match_substring_regex(low, "^[a-z\u00df-\u00f6\u00f8-\u00ff]+[.,]$")
    mark = np.where(marked.to_numpy(zero_copy_only=False), np.where(pc.ends_with(low, ".").to_numpy(zero_copy_only=False), 1, 2), 0)
    coded = pc.if_else(marked, pc.utf8_rtrim(low, ".,"), low).dictionary_encode()
    return strings(coded.dictionary), coded.indices.to_numpy(), mark


def gathered(pool: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """pool holds the values of pieces 0, 1, ... one after another, size[i] of piece i; the values of the pieces in number, in order."""
    start = np.cumsum(size) - size
    n = size[number]
    upto = np.cumsum(n)
    return pool[np.repeat(start[number] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]

"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary is a public BPE file with word ends ("</w>"). A normalized word is spelled in the
file's byte letters plus one end mark. An Aho-Corasick automaton over all tokens gives the longest
token at each place; a token is taken if it is compatible with the token before it (merging the two
spellings as BPE does gives back just those two), else the next shorter token is tried, else the
last token is taken back. Positions that failed once are never tried again, so the work is linear
in the word, and the result is what merging in rank order gives.

Texts are cut at white space, which tokens never cross, and each distinct piece is encoded once
per worker while a bounded cache holds it.

Defined results: null counts as empty; empty or blank text gives no ids; added tokens spelled out in
a text become their ids, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.pieces import cut_pieces

END = "</w>"
_MARK = "\ue000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for i, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(256 + i)
    return out


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.letters = byte_letters()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole, pair = vocab[a + b], (vocab[a], vocab[b])
            self.rank[pair] = r
            self.parts.setdefault(whole, pair)
        self.order = {w: self.rank[pair] for w, pair in self.parts.items()}
        self.spelled = {k[: -len(END)] + _MARK if k.endswith(END) else k: v for k, v in vocab.items()}
        self.length = {v: len(k) for k, v in self.spelled.items()}
        self.shorter = {v: next((self.spelled[k[:i]] for i in range(len(k) - 1, 0, -1) if k[:i] in self.spelled), None) for k, v in self.spelled.items()}
        self.tree = ahocorasick.Automaton()
        for k, v in self.spelled.items():
            self.tree.add_word(k, v)
        self.tree.make_automaton()
        size = max([*vocab.values(), *self.added.values()]) + 1
        names = [b""] * size
        for k, v in [*vocab.items(), *self.added.items()]:
            names[v] = k.encode()
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in names]))).tolist()
        self.table = b"".join(names)
        self.names = [self.table[a:b] for a, b in zip(self.offsets[:-1], self.offsets[1:])]
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in self.added) + ")") if self.added else None
        self.compatible = lru_cache(maxsize=1 << 17)(self._compatible)
        self.cache = PieceCache(lambda pieces: [self.encode_piece(x) for x in pieces])

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens: no earlier merge joins a right edge of a with a left edge of b.

        The edges of both are rebuilt in the order their own merges happen: at each rank, the piece
        of a that touches the border and the piece of b that touches it, while they last.
        """
        left, right = [a], [b]
        while (p := self.parts.get(left[-1])) is not None:
            left.append(p[1])
        while (p := self.parts.get(right[-1])) is not None:
            right.append(p[0])
        # piece i of left is made at the rank of its merge and gone when the piece above it is made
        i, j = len(left) - 1, len(right) - 1
        while True:
            x, y = left[i], right[j]
            up_x = self.order[left[i - 1]] if i else None
            up_y = self.order[right[j - 1]] if j else None
            r = self.rank.get((x, y))
            if r is not None and (up_x is None or r < up_x) and (up_y is None or r <= up_y):
                # at equal rank the merge further left happens first, which is this border's unless a's own came before
                return False
            if up_x is None and up_y is None:
                return True
            if up_y is None or (up_x is not None and up_x <= up_y):
                i -= 1
            else:
                j -= 1

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in byte letters, without its end mark."""
        text = word + _MARK
        n, length, compatible, shorter = len(text), self.length, self.compatible, self.shorter
        out: list[int] = []
        shut, last, pos = set(), -1, 0
        while pos < n:
            # longest matches from here on, while each is compatible with the one before
            for end, token in self.tree.iter_long(text, pos):
                if end + 1 - length[token] != pos:  # nothing starts at pos
                    token = None
                    break
                if end + 1 in shut or not (last < 0 or compatible(last, token)):
                    break
                out.append(token)
                last, pos = token, end + 1
            else:
                token = None
            if pos == n:
                break
            while True:  # a shorter token here, or else the token before is taken back and made shorter
                while token is not None and (pos + length[token] in shut or not (last < 0 or compatible(last, token))):
                    token = shorter[token]
                if token is not None:
                    out.append(token)
                    last, pos = token, pos + length[token]
                    break
                if not out:
                    raise ValueError("word cannot be spelled with this vocabulary")
                shut.add(pos)
                token = out.pop()
                pos -= length[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out

    def decode_ids(self, ids) -> bytes:
        """The tokens' spellings joined by spaces, as the library does where the file names no decoder."""
        return b" ".join(map(self.names.__getitem__, ids))

    def encode_piece(self, piece: str) -> bytes:
        """Ids, as little-endian 32-bit, of a text without white space."""
        ids: list[int] = []
        for part in self.special.split(piece) if "<|" in piece and self.special else (piece,):
            if part in self.added:
                ids.append(self.added[part])
                continue
            if part.isascii():
                part = part.lower()
            else:  # the library lower-cases letter by letter, so a last sigma gets no form of its own
                part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()
            if part.isalpha():
                words = [part]
            elif part[:-1].isalpha() and part[-1] in ".,":
                words = [part[:-1], part[-1]]
            else:
                words = self.split.findall(part)
            for w in words:
                ids += self.encode_word(w if w.isascii() and w.isprintable() else "".join([self.letters[b] for b in w.encode()]))
        return array("I", ids).tobytes()

    def encode_text(self, text: str | None) -> bytes:
        """Ids, as little-endian 32-bit, of a whole text."""
        return b"".join(self.cache.of(cut_pieces(text)))


class PieceCache:
    """Bounded memory of what a function gives for pieces of text; what is used again outlives the rest.

    A piece of letters that ends in a full stop or comma is two words in these vocabularies, and
    ASCII letters are lower-cased, so such pieces share what their letters give.
    """

    def __init__(self, fresh: Callable[[list[str]], list[bytes]], held: int = 600_000):
        self.fresh, self.held = fresh, held
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends = dict(zip(".,", fresh([".", ","])))

    def of(self, pieces: list[str]) -> list[bytes]:
        got = list(map(self.new.get, pieces))
        if None in got:
            own, roots = {}, {}
            for w in {w for w, x in zip(pieces, got) if x is None}:
                if (x := self.old.get(w)) is not None:
                    own[w] = x
                    continue
                root, end = (w[:-1], w[-1]) if w and w[-1] in ".," and w[:-1].lower().isalpha() else (w, "")
                roots[w] = (root.lower() if root.isascii() and root.isalpha() else root, end)
            lack = {root for root, _ in roots.values()}
            known = {r: x for r in lack if (x := self.new.get(r) or own.get(r) or self.old.get(r)) is not None}
            lack = [r for r in lack if r not in known]
            known.update(zip(lack, self.fresh(lack)))
            own.update((w, known[r] + self.ends[e] if e else known[r]) for w, (r, e) in roots.items())
            got = [own[w] if x is None else x for w, x in zip(pieces, got)]
            if len(self.new) + len(own) + len(lack) > self.held:
                self.old, self.new = self.new, {}
            for held in (own, zip(lack, map(known.__getitem__, lack))):
                self.new.update((w, x) for w, x in (held.items() if isinstance(held, dict) else held) if len(w) <= 64)
        return got


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _encode(path: str, keep_ids: bool):
    def run(batches):
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                blobs, n, sha_i, sha_d = [], [], [], []
                for t in part.column(part.num_columns - 1).to_pylist():
                    ids = bpe.encode_text(t)
                    text = bpe.decode_ids(np.frombuffer(ids, "<u4").tolist())
                    blobs.append(ids)
                    n.append(len(ids) // 4)
                    sha_i.append(hashlib.sha256(ids).hexdigest())
                    sha_d.append(hashlib.sha256(text).hexdigest())
                cols = [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(sha_i), pa.array(sha_d)]
                if keep_ids:
                    off = np.zeros(len(n) + 1, np.int32)
                    np.cumsum(n, out=off[1:])
                    cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(blobs), "<i4"))))
                yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])

    return run


def encode(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """keys, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids array<int>; one row for each row."""
    src = docs.select(*keys, F.col(text_col).cast("string"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(_encode(path, keep_ids), f"{head}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)

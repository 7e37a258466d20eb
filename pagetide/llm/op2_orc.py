"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of id before they are tokenized (text is smaller than ids), sorted
within a range, tokenized with the tokenizers library and written as one ORC file a range, in
ascending id order. Files carry part (the range), row and start (ids of the part before the
document), so stripes can be read in parallel and offsets over the whole set need only the parts'
sums. doc_id has a Bloom filter and min/max row indexes, so a look-up reads few row groups.

Each distinct piece of text between white space goes through the library once while a bounded
cache holds it; tokens of this vocabulary never cross white space, so the joined ids are the whole
text's. A slice of rows is split and its pieces numbered in Arrow, and ids are gathered by number.

Defined results: null text counts as empty and has the end id alone; null ids come first, rows
with one id are ordered by their text's hash, each row is written.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.op8_bpe import END
from pagetide.llm.pieces import gathered, numbered, roots, slices
from pagetide.llm.shared import partitions

SCHEMA = "part int, row long, doc_id long, start long, n_tokens long, ids array<int>"


#: Letters that each stay one letter when lower-cased and composed: pieces of them alone are one word each.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_JOINED = 256


def _fresh(path: str):
    """A function from pieces to their ids as bytes. Pieces of letters alone go through the library many to a text, told apart by the tokens that end words."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    ends = np.zeros(tok.get_vocab_size(with_added_tokens=True), bool)
    ends[[i for w, i in tok.get_vocab(with_added_tokens=False).items() if w.endswith(END)]] = True
    encode = lambda texts: tok.encode_batch_fast(texts, add_special_tokens=False) if texts else []

    def run(pieces: list[str]) -> list[bytes]:
        plain = [w for w in pieces if _PLAIN.fullmatch(w)]
        out: dict[str, bytes] = {}
        runs = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        for some, e in zip(runs, encode([" ".join(x) for x in runs])):
            ids = np.array(e.ids, "<u4")
            stop = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
            if len(stop) == len(some) and stop[-1] == 4 * len(ids):
                blob = ids.tobytes()
                out.update(zip(some, map(blob.__getitem__, map(slice, [0, *stop[:-1]], stop))))
        rest = [w for w in pieces if w not in out]
        out.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, encode(rest)))
        return [out[w] for w in pieces]

    return run


class Roots:
    """Ids of pieces of text; what the library gave for a root is held in bounded memory, and what is used again outlives the rest."""

    def __init__(self, path: str, held: int = 500_000):
        self.fresh, self.held = _fresh(path), held
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = [b"", *self.fresh([".", ","])]

    def of(self, roots: list[str]) -> list[bytes]:
        got = list(map(self.new.get, roots))
        lack = [w for w, x in zip(roots, got) if x is None]
        if lack:
            found = dict(zip(lack, map(self.old.get, lack)))
            missing = [w for w, x in found.items() if x is None]
            found.update(zip(missing, self.fresh(missing)))
            got = [found[w] if x is None else x for w, x in zip(roots, got)]
            if len(self.new) + len(found) > self.held:
                self.old, self.new = self.new, {}
            self.new.update(found if max(map(len, lack)) <= 64 else ((w, x) for w, x in found.items() if len(w) <= 64))
        return got

    def pool(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        names, root, mark = roots(pieces)
        blobs = [*self.of(names), *self.marks]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        both = np.stack([root, len(names) + mark], 1)
        return gathered(np.frombuffer(b"".join(blobs), "<i4"), size, both.ravel()), size[both].sum(axis=1)


@lru_cache(maxsize=2)
def _cache(path: str) -> Roots:
    return Roots(path)


def _tokenize(path: str, end_id: int):
    def run(batches):
        cache, part, row, start = _cache(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for some in slices(batch, 1):
                pieces, number, off = numbered(some.column(1))
                pool, size = cache.pool(pieces)
                number = np.insert(number, off[1:], len(size))
                pool, size = np.append(pool, np.int32(end_id)), np.append(size, 1)
                ids = gathered(pool, size, number)
                k = some.num_rows
                row_end = np.cumsum(size[number])[off[1:] + np.arange(k)]
                off = np.concatenate(([0], row_end))
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(np.arange(row, row + k)), some.column(0), pa.array(start + off[:-1]), pa.array(np.diff(off)), lists], ["part", "row", "doc_id", "start", "n_tokens", "ids"])
                row, start = row + k, start + int(off[-1])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Writes docs' ids as ORC files under out, one for each range of ids."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("h", F.xxhash64("text"))  # parts one id that many rows share
    dealt = src.repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    rows = dealt.mapInArrow(_tokenize(tokenizer, end_id), SCHEMA)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(index_rows), "orc.stripe.size": str(stripe_bytes), "orc.compress": "ZSTD"}
    rows.write.options(**options).mode("errorifexists").orc(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows; filters on doc_id reach the stripes' indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(out)


def _crc(batches):
    for batch in batches:
        ids = batch.column(4)
        off = ids.offsets.to_numpy()
        data = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        crc = [zlib.crc32(data[a:b]) for a, b in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def token_table(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start over all files, n_tokens and ids_crc32, from the files."""
    rows = read_tokens(spark, out)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    got = rows.select("part", "doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return got.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")

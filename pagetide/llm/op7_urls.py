"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

The list holds canonical URLs: a host (lower case) and a path. An entry covers its host with all
subdomains, and all paths that start with its path. A page's URL is put in canonical form. Each suffix of its
host at a dot passes a filter of the listed hosts; with those that may be listed, each prefix of the path that is as long
as some listed path passes a filter of the listed keys. Hashes of suffixes and prefixes are differences of running sums, so this is linear
in the URL. What passes meets the list in an exact join, which removes the false positives. The longest entry wins;
unlisted pages get the default.

Each filter is made of 256-bit blocks, eight bits a key, and never exceeds `most_bytes`, so what is
sent to the workers is bounded whatever the list's size; a list too long for that only raises the
share of keys that reach the join. The list itself is never broadcast by force.

Defined results: a null URL or one without "://" has empty host and path and matches nothing;
repeated URLs are looked up once and every row gets the answer; an entry listed twice counts once,
block before allow; an entry with an empty host covers nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm import bytewords as bw

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PROBES = 8


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column, by string operations alone."""
    has = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.when(has, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and 256-bit mask (4 words) of each 64-bit hash."""
    h = h.astype(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    mask = np.zeros((len(h), 4), np.uint64)
    x = h | np.uint64(1)
    for _ in range(_PROBES):
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        at = (x >> np.uint64(56)).astype(np.int64)
        mask[np.arange(len(h)), at >> 6] |= np.uint64(1) << (at & 63).astype(np.uint64)
    return block, mask


class Running:
    """64-bit hashes of any stretch of some bytes."""

    def __init__(self, text: str):
        self.data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self.upto = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(bw._TABLE[self.data] * bw._powers(bw._ROOT, len(self.data)), out=self.upto[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return bw.mix((self.upto[b] - self.upto[a]) * bw._powers(bw._INVERSE, len(self.upto))[a] + (b - a).astype(np.uint64))


def _key(host: np.ndarray, path: np.ndarray) -> np.ndarray:
    return bw.mix(host * np.uint64(0xD6E8FEB86659FD93) + path)


def _whole(text: str) -> np.ndarray:
    r = Running(text)
    return r.of(np.zeros(1, np.int64), np.array([len(r.data)]))


def _key_masks(blocks: int, with_path: bool):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                hosts, paths = (batch.column(i).to_pylist() for i in (0, 1))
                h = np.concatenate([_whole(v) for v in hosts])
                h = _key(h, np.concatenate([_whole(v) for v in paths])) if with_path else h
                block, mask = bits(h, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(np.ascontiguousarray(mask[:, i]).view(np.int64)) for i in range(4))], ["block", "w0", "w1", "w2", "w3"])

    return run


def bloom(listed: DataFrame, with_path: bool, count: int, most_bytes: int = 8 << 20) -> np.ndarray:
    """Blocks x 4 words, from listed (host, path); about 16 bits a key, most_bytes at most."""
    blocks = max(1, min(most_bytes // 32, count // 16 + 1))
    got = listed.mapInArrow(_key_masks(blocks, with_path), "block long, w0 long, w1 long, w2 long, w3 long").groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4))).toArrow()
    table = np.zeros((blocks, 4), np.uint64)
    for i in range(4):
        table[got.column("block").to_numpy(), i] = got.column(f"w{i}").to_numpy().view(np.uint64)
    return table


def _in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, mask = bits(h, len(table))
    return ((table[block] & mask) == mask).all(axis=1)


def _possible(hosts: np.ndarray, keys: np.ndarray, lengths: np.ndarray):
    """(url, host, path) of every suffix and prefix that the filters let through. lengths: bytes of listed paths, ascending."""

    def run(batches):
        for batch in batches:
            urls, names, paths = (batch.column(i).to_pylist() for i in range(3))
            starts, found = [], []
            for name in names:
                r = Running(name)
                at = np.concatenate(([0], np.flatnonzero(r.data == 46) + 1))
                at = at[at < len(r.data)]
                starts.append(at)
                found.append(r.of(at, np.full(len(at), len(r.data))))
            ok = _in(hosts, np.concatenate(found)) if found else np.empty(0, bool)
            row = np.repeat(np.arange(len(names)), [len(x) for x in starts])
            out = [[], [], []]
            for i in np.unique(row[ok]):
                mine = row == i if len(names) == 1 else slice(*np.searchsorted(row, [i, i + 1]))
                at, h = starts[i][ok[mine]], found[i][ok[mine]]
                r = Running(paths[i])
                n = lengths[: np.searchsorted(lengths, len(r.data), "right")]
                p = r.of(np.zeros(len(n), np.int64), n)
                a, b = np.nonzero(_in(keys, _key(np.repeat(h, len(n)), np.tile(p, len(h)))).reshape(len(h), len(n))) if len(n) else ((), ())
                for x, y in zip(a, b):
                    host = names[i].encode("utf-8", "surrogatepass")[at[x] :].decode("utf-8", "replace")
                    out[0].append(urls[i])
                    out[1].append(host)
                    out[2].append(r.data[: n[y]].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["url", "host", "path"])

    return run


def url_verdicts(pages: DataFrame, listed: DataFrame, default: str = "allow", url_col: str = "url", most_bytes: int = 8 << 20) -> DataFrame:
    """pages with host, path, rule (host and path of the longest entry, or null) and verdict. listed: host, path, verdict."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).where("host <> '' and path is not null")
    spelled = listed.select("host", "path")
    count = spelled.count()
    lengths = [r[0] for r in spelled.select(F.octet_length("path")).distinct().collect()]  # at most as many as the longest listed path has bytes
    hosts, keys = (bloom(spelled, with_path, count, most_bytes) for with_path in (False, True))
    host, path = canonical(F.col("url"))
    urls = pages.select(F.col(url_col).alias("url")).where(F.instr("url", "://") > 0).distinct()
    parts = urls.select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    hits = parts.mapInArrow(_possible(hosts, keys, np.sort(np.array(lengths, np.int64))), "url string, host string, path string")
    found = hits.join(listed, ["host", "path"])
    best = found.groupBy("url").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(F.length(F.concat("host", "path")), F.length("path"))).alias("best"))
    # rows that can have no rule get keys of their own, so that they are not one hot key; a hot URL is left to the skew join
    alone = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    own = pages.select(*kept, F.col(url_col).alias("__url")).withColumn("__key", F.when(F.instr("__url", "://") > 0, F.col("__url")).otherwise(alone))
    own = own.join(best.withColumnRenamed("url", "__key"), "__key", "left")
    host, path = canonical(F.col("__url"))
    return own.select(*(F.col(c) for c in kept), host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

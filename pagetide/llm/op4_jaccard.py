"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

A document is the set of its distinct word shingles. Shingles are hashed to 64 bits and the hash
range is cut into m equal segments, m set by the size band of the smaller set. Two sets that reach
the threshold differ in at most H shingles, so if a set has weight over H on its segments (one for a
segment that is not empty, two for a designated segment of two shingles or more, which is also compared under every
one-shingle deletion), some weighted segment must agree within its weight. m and the number of
designated segments are chosen per band for the fewest index rows, with the chance that a random
set lacks the weight (too many empty segments; a Chernoff bound) below 1e-10; sets that do lack it are compared with
every document in blocks, so no link is ever lost. Bands of small sets are indexed whole instead: each set under
all deletions of as many shingles as a linked set may lack, which needs no chance at all.

Equal sets collapse to one representative (within a batch before anything is sent, so a set that a
third of all rows repeat gives one entry a batch). Signatures travel as packed arrays, 40 bits each
beside their fine partition; a clash only adds a candidate. Of the sets with one signature the
smallest id is the lead, tied to each of the others. All pairs that share a signature lie within
some lead's neighbourhood (the lead and all tied to it), so comparing inside neighbourhoods misses
nothing, and their sizes add up to the ties, which are linear in the signatures. Each set has a parity sketch of its hashes, whose
distance is a lower bound of the difference: a neighbourhood first meets as sizes and sketches, and only those that may link with another there send their texts, and a bitmap of their ids keeps the others' from being moved at all.
A small neighbourhood is compared in one task on the real shingle strings, with the same bounds before it
and a union-find that skips pairs already connected; a middling one in tasks of its own for each pair of blocks. Of a large one, the lead is compared with all first, in blocks; only those
that are not connected with it by then (by any neighbourhood) are compared with the others, block by block, so a large group of copies of one text costs its size.

Defined results: null or blank text has no shingles and links with nothing; text with fewer words
than a shingle has its whole word sequence as its one shingle; rows with a null id have a null
component and take no part; rows with the same id count as one document for links and each gives
a row.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm import bytewords as bw
from pagetide.llm.components import components
from pagetide.llm.shared import cut, grouped, holding, partitions, small_batches

_U = np.uint64


class Scheme:
    """Size bands and segment plans for one threshold num/den (Jaccard >= num/den)."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < largest:
            low.append(max(low[-1] + 1, (low[-1] - 1) * den // num + 1))
        self.low = np.array(low, dtype=np.int64)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def most_difference(self, a: int, b: int) -> int:
        """The largest |r ^ s| of sets with a and b members that reach the threshold."""
        least = -(-self.num * (a + b) // (self.num + self.den))
        return a + b - 2 * least

    def deletions(self, n: int) -> int:
        """The most members of a set of n that a linked set may lack."""
        return n - -(-self.num * n // self.den)

    @lru_cache(maxsize=4096)
    def plan(self, band: int) -> tuple[int, int, int, np.ndarray, int]:
        """(H, segments, designated, inner boundaries, tag) for pairs whose smaller set is in this band; no segments: indexed whole."""
        s = int(self.low[band + 1]) - 1
        h = max(self.most_difference(s, r) for r in range(max(s, s * self.den // self.num - 40), s * self.den // self.num + 1))
        small, best = int(self.low[band]), None
        largest = s * self.den // self.num
        tag = (band * 0x9E3779B97F4A7C15 + 0x1234567) & ((1 << 64) - 1)
        if not h or sum(math.comb(largest, i) for i in range(self.deletions(largest) + 1)) <= _MOST_WHOLE:
            return h, 0, 0, np.empty(0, _U), tag
        for m in [*range(max(2, (h + 2) // 2), h + 14 + h // 3), *(x for x in (32, 48, 64, 96, 128, 256) if x > h + 14 + h // 3)]:
            for d in {0, 1, 2, m} if m > 2 else {0, m}:
                rows = min(m, small) + d * small / m
                if (best is None or rows < best[0]) and lacks(small, m, d, h) <= math.log(1e-10):
                    best = (rows, m, d)
        _, m, d = best or (0, 4 * (h + 1), 0)
        return h, m, d, np.array([(i << 64) // m for i in range(1, m)], dtype=_U), tag


#: The most signatures of a set that is indexed whole under its deletions.
_MOST_WHOLE = 110


def lacks(n: int, m: int, d: int, h: int) -> float:
    """Log of a bound on the chance that n random hashes give m segments, d of them designated, a weight of h or less."""
    if m + d <= h:
        return 0.0
    rate = n / m  # as Poisson counts, which given their sum are the multinomial ones
    none, one = math.exp(-rate), rate * math.exp(-rate)
    best = 0.0
    for t in (0.25 * i for i in range(1, 121)):
        e = math.exp(-t)
        best = min(best, t * h + (m - d) * math.log(none + (1 - none) * e) + d * math.log(none + one * e + max(0.0, 1 - none - one) * e * e))
    return min(0.0, best + 1 + math.log(n) / 2)


@lru_cache(maxsize=8)
def scheme(num: int, den: int) -> Scheme:
    return Scheme(num, den)


def signatures(s: np.ndarray, sch: Scheme) -> tuple[np.ndarray, bool]:
    """All index keys of the sorted shingle hashes s; and whether its weight falls short somewhere."""
    out, short = [], False
    running = np.zeros(len(s) + 1, _U)
    mixed = bw.mix(s + _U(0x51ED270B153A4D2F))
    np.cumsum(mixed, out=running[1:])
    own = sch.band(len(s))
    for band in (own, own - 1):
        if band < 0:
            continue
        h, m, d, inner, tag = sch.plan(band)
        if not h:
            continue
        if not m:
            left = np.array([running[-1]], _U)
            out.append(bw.mix(left ^ bw.mix(np.array([tag], _U))))
            for gone in range(1, sch.deletions(len(s)) + 1):
                pick = np.array(list(itertools.combinations(range(len(s)), gone)))
                out.append(bw.mix((running[-1] - mixed[pick].sum(axis=1, dtype=_U)) ^ bw.mix(np.array([tag], _U))))
            continue
        cuts = np.concatenate(([0], np.searchsorted(s, inner), [len(s)]))
        full = cuts[1:] > cuts[:-1]
        short |= int(full.sum() + (np.diff(cuts[: d + 1]) > 1).sum()) < h + 1
        tags = bw.mix(np.arange(m, dtype=_U) + _U(tag))
        sums = running[cuts[1:]] - running[cuts[:-1]]
        out.append(bw.mix(sums[full] ^ tags[full]))
        if d:
            upto = cuts[d]
            seg = np.repeat(np.arange(d), np.diff(cuts[: d + 1]))
            lone = np.diff(cuts[: d + 1])[seg] > 1  # deleting the only shingle would leave nothing to agree on
            out.append(bw.mix((sums[seg] - mixed[:upto]) ^ tags[seg])[lone])
    return (np.unique(np.concatenate(out)) if out else np.empty(0, _U)), short


def shingle_rows(words: int):
    """A row function: sorted distinct shingle hashes of each row of a text column."""

    def of(column: pa.Array) -> Iterator[np.ndarray]:
        data, off = bw.raw(column)
        w, _, _, first = bw.words(data, off)
        k = words
        if len(w) >= k:
            h = np.zeros(len(w) - k + 1, _U)
            for i in range(k):
                h = bw.mix(h * _U(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i])
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(h[a : b - k + 1])
            elif b > a:
                x = np.full(1, b - a, _U)
                for i in range(a, b):
                    x = bw.mix(x * _U(0xA0761D6478BD642F) + w[i])
                yield x
            else:
                yield np.empty(0, _U)

    return of


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parities(s: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of the set's members falls on each. Two sets differ in as many members at least as their bits differ."""
    bits = np.bincount((bw.mix(s.astype(_U)) & _U(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(_U)


def _summaries(words: int):
    def run(batches):
        of = shingle_rows(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, d, sketch = [], [], []
                for s in of(part.column(1)):
                    n.append(len(s))
                    d.append(_digest(s))
                    sketch.append(parities(s).tobytes())
                d = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return run


_KEPT = 5  # bytes of a signature that travel beside its fine partition


def _pack(words: int, num: int, den: int, fine: int):
    """Rows (p, sig, node): all entries of one batch in one fine partition. p = -1 holds ids whose sets lack weight."""

    def run(batches):
        sch, of, pool = scheme(num, den), shingle_rows(words), pa.default_memory_pool()
        for batch in batches:
            pool.release_unused()
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                docs = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                least: dict[bytes, tuple[int, np.ndarray]] = {}
                for doc, s in zip(docs.tolist(), of(part.column(1))):
                    if len(s):
                        key = _digest(s)
                        if key not in least or doc < least[key][0]:
                            least[key] = (doc, s)
                ids, sigs, lacks = [], [], []
                for doc, s in sorted(least.values(), key=lambda x: x[0]):
                    keys, short = signatures(s, sch)
                    ids.append(doc)
                    sigs.append(keys)
                    if short:
                        lacks.append(doc)
                out = [(-1, b"", np.array(lacks, np.int64).tobytes())] if lacks else []
                if sum(map(len, sigs)):
                    node, sig = np.repeat(np.array(ids, np.int64), list(map(len, sigs))), np.concatenate(sigs)
                    p = ((sig >> _U(8 * _KEPT)) % _U(fine)).astype(np.int32)
                    order = np.argsort(p, kind="stable")  # ids stay in order within a partition: their steps compress to little
                    p, sig, node = p[order], sig[order], node[order]
                    edges = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1, [len(p)]))
                    short_sig = sig.view(np.uint8).reshape(-1, 8)[:, :_KEPT]
                    for a, b in zip(edges[:-1], edges[1:]):
                        steps = np.diff(node[a:b], prepend=0)
                        out.append((int(p[a]), short_sig[a:b].tobytes(), steps.view(np.uint8).reshape(-1, 8).T.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["p", "sig", "node"])

    return run


def _unpack(sig: bytes, node: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(sig) // _KEPT
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :_KEPT] = np.frombuffer(sig, np.uint8).reshape(n, _KEPT)
    steps = np.ascontiguousarray(np.frombuffer(node, np.uint8).reshape(8, n).T).view(np.int64).reshape(n)
    return wide.view(_U).reshape(n), np.cumsum(steps)


def _ties(sig: np.ndarray, node: np.ndarray) -> np.ndarray:
    """(lead, other) for each signature: its smallest node with each of the others."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    lead = node[head][np.cumsum(head) - 1]
    rest = lead != node
    return np.stack([lead[rest], node[rest]], 1)


def _reduce(batches):
    """Ties (a, b) of one fine partition at a time; a = b stands for an id whose set lacks weight."""
    for table in grouped(batches, "p"):
        if table.column("p")[0].as_py() < 0:
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("node").to_pylist()])
            pairs = np.stack([ids, ids], 1)
        else:
            got = [_unpack(s, n) for s, n in zip(table.column("sig").to_pylist(), table.column("node").to_pylist())]
            pairs = _ties(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]))
        pairs = np.unique(pairs, axis=0)
        for at in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16), 0]), pa.array(pairs[at : at + (1 << 16), 1])], ["a", "b"])


def exact_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted ids of each text's distinct shingles; words have ids by the strings themselves, and shingles by their words' ids."""
    known: dict[str, int] = {}
    short: dict[tuple[str, ...], int] = {}
    lower = {c: c + 32 for c in range(65, 91)}
    out: list[np.ndarray] = []
    flows, at = [np.empty(0, np.int64)], []
    for t in texts:
        w = (t or "").translate(lower)
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
        if len(w) >= words:
            at.append(len(out))
            flows.append(np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w)))
        out.append(np.array([short.setdefault(tuple(w), -1 - len(short))] if 0 < len(w) < words else [], np.int64))
    flow = np.concatenate(flows)
    grams = flow
    for i in range(1, words):  # ids of i words and the next one's, numbered anew
        grams = np.unique(grams[:-1] * len(known) + flow[i:], return_inverse=True)[1]
    first = 0
    for i, w in zip(at, flows[1:]):
        out[i] = np.unique(grams[first : first + len(w) - words + 1])
        first += len(w)
    return out


def near(n: np.ndarray, sketch: np.ndarray, node: np.ndarray, left: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Which sets may link with another one of these, by sizes n and sketches. left: if given, only with one of the other side."""
    order = np.argsort(n, kind="stable")
    sizes, sk, node, hit = n[order], sketch[order], node[order], np.zeros(len(n), bool)
    left = None if left is None else left[order]
    for x in range(len(n) - 1):
        top = int(np.searchsorted(sizes, sizes[x] * den // num, "right"))
        if top <= x + 1:
            continue
        both = sizes[x] + sizes[x + 1 : top]
        may = (np.bitwise_count(sk[x + 1 : top] ^ sk[x]).sum(axis=1) <= both - 2 * -(-num * both // (num + den))) & (node[x + 1 : top] != node[x])
        if left is not None:
            may &= left[x + 1 : top] != left[x]
        if may.any():
            hit[x] = True
            hit[x + 1 : top] |= may
    out = np.zeros(len(n), bool)
    out[order] = hit
    return out


def _near(num: int, den: int):
    """Of rows (key, comp, side, node, n, sketch) those that may link with another of their key and comp."""

    def run(batches):
        for table in grouped(batches, "key"):
            table = table.combine_chunks()
            comps, sides, nodes, n = (table.column(c).to_numpy() for c in ("comp", "side", "node", "n"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), _U).reshape(-1, 8)
            order, kept = np.argsort(comps, kind="stable"), []
            for part in np.split(order, np.flatnonzero(np.diff(comps[order])) + 1):
                left = None if (sides[part] == 2).all() else sides[part] == 0
                part = part[near(n[part], sketch[part], nodes[part], left, num, den)]
                kept.append(part[np.unique(nodes[part], return_index=True)[1]])  # an id with several texts sends them all, once
            for batch in table.select(["key", "comp", "side", "node"]).take(pa.array(np.concatenate(kept))).to_batches():
                yield batch

    return run


def links(sets: list[np.ndarray], label: np.ndarray, num: int, den: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links enough to connect what the threshold connects. left: if given, only pairs between True and False."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    root = {int(x): int(x) for x in np.unique(label)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    sketch = np.array([parities(s) for s in sets], _U).reshape(n, 8)
    found = []
    sizes, sk = size[order], sketch[order]
    for x in range(n):
        i = order[x]
        if not size[i]:
            continue
        top = int(np.searchsorted(sizes, size[i] * den // num, "right"))
        if top <= x + 1:
            continue
        both = size[i] + sizes[x + 1 : top]
        apart = np.bitwise_count(sk[x + 1 : top] ^ sk[x]).sum(axis=1)
        for y in np.flatnonzero(apart <= both - 2 * -(-num * both // (num + den))) + x + 1:
            j = order[y]
            if left is not None and left[i] == left[j]:
                continue
            a, b = find(int(label[i])), find(int(label[j]))
            if a == b:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * common >= num * (size[i] + size[j] - common):
                root[max(a, b)] = min(a, b)
                found.append((int(label[i]), int(label[j])))
    return found


def _verify(words: int, num: int, den: int):
    def run(batches):
        for table in grouped(batches, "key"):
            comps, sides = table.column("comp").to_numpy(), table.column("side").to_numpy()
            nodes, texts = table.column("node").to_numpy(), table.column("text").to_pylist()
            order = np.argsort(comps, kind="stable")
            found = []
            for part in np.split(order, np.flatnonzero(np.diff(comps[order])) + 1):
                side = sides[part]
                left = None if (side == 2).all() else side == 0
                found += links(exact_sets([texts[i] for i in part], words), nodes[part], num, den, left)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _scan(words: int, num: int, den: int, held: list[tuple[int, bytes]]):
    """Compares every row with a block of held sets (ids, shingle hashes)."""

    def run(batches):
        of = shingle_rows(words)
        known = [(i, np.frombuffer(b, _U)) for i, b in held]
        for batch in batches:
            found = []
            for doc, s in zip(batch.column(0).to_pylist(), of(batch.column(1))):
                for i, k in known:
                    common = len(np.intersect1d(s, k, assume_unique=True)) if len(s) and doc != i else 0
                    if common and den * common >= num * (len(s) + len(k) - common):
                        found.append((min(i, doc), max(i, doc)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _hashes(words: int):
    def run(batches):
        of = shingle_rows(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in of(batch.column(1))], pa.binary())], ["node", "hashes"])

    return run


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = 200_000, block_rows: int = 1024, most_direct: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest id reachable by links of Jaccard >= num/den."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # two passes over the text cost less than keeping or moving the signatures of the first
    rows = cut(texts.mapInArrow(_summaries(words), "doc_id long, n_shingles long, d1 long, d2 long, sketch binary"))
    full = rows.where("doc_id is not null and n_shingles > 0")
    classes = cut(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")))
    rep_of = cut(full.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "rep", "n"))
    # slices and tasks grow with the input
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    count, fine = max(partitions(spark), total // 30_000_000), max(8 * partitions(spark), total // 4_000_000)
    packed = texts.where("doc_id is not null").mapInArrow(_pack(words, num, den, fine), "p int, sig binary, node binary")
    raw = cut(packed.repartition(count, "p").sortWithinPartitions("p").mapInArrow(_reduce, "a long, b long"))
    # ties between documents become ties between representatives
    ties = raw.where("a <> b").join(rep_of.select(F.col("doc_id").alias("a"), F.col("rep").alias("lead"), F.col("n").alias("lead_n")), "a").join(rep_of.select(F.col("doc_id").alias("b"), F.col("rep").alias("node"), "n"), "b")
    both = F.array(F.struct("lead", F.col("lead").alias("node"), F.col("lead_n").alias("n")), F.struct("lead", "node", "n"))
    candidates = cut(ties.where("lead <> node").select(F.explode(both).alias("m")).select("m.*").distinct())
    blocks_of = lambda df: df.groupBy("lead").agg(F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("*") / block_rows)).cast("int").alias("blocks"))
    few = lambda df: F.broadcast(df) if df.count() <= 20_000 else df  # noqa: E731  counted; or else joined by shuffle
    large = cut(blocks_of(candidates).where("blocks > 1"))
    marked = candidates.join(few(large), "lead", "left")
    # small neighbourhoods: some of them to a key, and as many keys as keep that so
    keys = candidates.count() // 64 + 1
    small = marked.where("blocks is null").select("node", F.col("lead").alias("comp"), F.lit(2).alias("side"), F.pmod(F.xxhash64("lead"), F.lit(keys)).alias("key"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # middle ones, of most_direct blocks at most: a node goes to each pair of blocks that its own takes part in
    pairs = marked.where(F.col("blocks") <= most_direct).select("node", "lead", block("node", "blocks").alias("own"), each("blocks").alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    small = small.union(pairs.select("node", F.col("lead").alias("comp"), side.alias("side"), F.xxhash64("lead", F.least("own", "other"), F.greatest("own", "other")).alias("key")))
    # large ones: the lead (side 0) with every block of the others (side 1)
    big = marked.where(F.col("blocks") > most_direct)
    star = big.where("node <> lead").select("node", "lead", F.lit(1).alias("side"), block("node", "blocks").alias("b")).union(big.where("node = lead").select("node", "lead", F.lit(0), each("blocks")))
    star = star.select("node", F.col("lead").alias("comp"), "side", F.xxhash64("lead", "b").alias("key"))

    sketches = full.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch")

    def compared(dealt: DataFrame) -> DataFrame:
        met = dealt.join(sketches, "node").select("key", "comp", "side", "node", "n", "sketch").repartition(count, "key").sortWithinPartitions("key")
        dealt = cut(met.mapInArrow(_near(num, den), "key long, comp long, side int, node long"))
        own = holding(texts.select(F.col("doc_id").alias("node"), "text"), dealt.select("node").distinct(), "node")
        whole = dealt.join(own, "node").repartition(count, "key").sortWithinPartitions("key")
        return whole.mapInArrow(_verify(words, num, den), "a long, b long")

    found = cut(compared(small.union(star)))
    if large.where(F.col("blocks") > most_direct).head(1):
        # nodes of the lead's own component need no more among themselves: any link that is still to be found has an end outside it
        of = components(found).select(F.col("node").alias("m"), "label")
        named = big.where("node <> lead").join(of.withColumnRenamed("m", "node"), "node", "left").join(of.select(F.col("m").alias("lead"), F.col("label").alias("lead_label")), "lead", "left")
        others = big.where("node <> lead")
        apart = named.where(F.coalesce("label", "node") != F.coalesce("lead_label", "lead")).select("lead", "node", "n")
        rest = cut(apart)
        if rest.head(1):
            # those outside the lead's component (side 0) with every block of all (side 1)
            size = cut(blocks_of(rest).withColumnRenamed("blocks", "parts").join(few(large), "lead"))
            left = rest.join(few(size), "lead").select("node", "lead", F.lit(0).alias("side"), block("node", "parts").alias("x"), each("blocks").alias("y"))
            right = others.select("node", "lead").join(few(size), "lead").select("node", "lead", F.lit(1).alias("side"), each("parts").alias("x"), block("node", "blocks").alias("y"))
            found = found.union(compared(left.union(right).select("node", F.col("lead").alias("comp"), "side", F.xxhash64("lead", "x", "y").alias("key"))))
    lacking = None
    if raw.where("a = b").head(1):
        lacking = raw.where("a = b").join(rep_of.select(F.col("doc_id").alias("a"), "rep"), "a").select(F.col("rep").alias("doc_id")).distinct()
    held: list[tuple[int, bytes]] = []
    for row in texts.join(lacking, "doc_id").mapInArrow(_hashes(words), "node long, hashes binary").toLocalIterator() if lacking else ():
        held.append((row.node, bytes(row.hashes)))
        if len(held) == 64:
            found, held = found.union(texts.where("doc_id is not null").mapInArrow(_scan(words, num, den, held), "a long, b long")), []
    if held:
        found = found.union(texts.where("doc_id is not null").mapInArrow(_scan(words, num, den, held), "a long, b long"))
    # an id with several texts ties their classes together
    several = rows.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    tied = rows.join(several, "doc_id").join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = cut(found.union(tied)) if several.head(1) else cut(found)
    labels = components(found)
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id"))

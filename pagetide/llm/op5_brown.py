"""Language-model scoring by Brown class-based bigrams.

Chunks. Texts are tokenized once (numpy over bytes) into chunks of bounded size: the chunk's
distinct words as 64-bit hashes with a shape code and training counts, and its token stream as
indexes into them. Chunks are written to the shared folder and everything after works on them.

Counts. Distinct words of all chunks meet by hash, in packed arrays; the reducer sums the training
counts and answers every chunk with the counts of its own words. So counts cover every word of the
corpus and what moves grows with it, not with the driver.

Classes. Every training word has a class of its own choice. Words above a relative frequency (`min_rate`, so at most
1/min_rate of them whatever the corpus size) start in classes by frequency rank, and exchange clustering on the driver moves
each to the class that raises the class bigram likelihood most, sweep by sweep. All other words stand there by their shape (last byte);
they start in classes by shape and hash, and `passes` over the chunks then move each of them, however rare: its counts before and after each
class meet by hash, and it takes the class of the largest gain, the other words' classes held. Moves of a pass are made at
once; a pass that does not raise the likelihood is undone and is the last. Only the table of class bigrams and
numbers by class are collected. A word unseen in training goes where most words seen once with its shape are.

Score. P(w | previous) = mix * P(class | previous class) * P(w | class) + (1 - mix) * P_unigram(w),
transitions with add-one-half, emissions with add-one and one unseen word a class, the unigram with
add-one: each factor sums to one at most (a class no unseen word goes to still keeps room for one), so the score is a log probability. Perplexity is
10 ** (-score / n_tokens).

Defined results: null counts as empty, which is the end token alone; no training documents leaves
every token unseen; each row is scored. A token's identity is its 64-bit hash.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import bytewords as bw
from pagetide.llm.shared import grouped, partitions, remove, scratch, small_batches

_U = np.uint64
END = _U(0xFFFFFFFFFFFFFFFF)  # the hash of the end token
TAIL = 16
_CHUNK = 4 << 20
_ENTRIES = 1 << 19  # neighbour counts that a pass holds unpacked at once
_ROWS = "chunk long, docs long, hashes binary, shape binary, counts binary, tokens binary, n_tokens binary, train binary, train_tokens long, keys binary"


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _pieces(column: pa.Array):
    """Row ranges of about _CHUNK bytes of text, whole rows."""
    data, off = bw.raw(column)
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + _CHUNK, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def _chunks(batches):
    from pyspark import TaskContext

    serial = TaskContext.get().partitionId() << 40
    for batch in batches:
        pa.default_memory_pool().release_unused()
        ids = pa.array(batch.column(0))
        learn = np.array([bool(x) for x in batch.column(2).to_pylist()])
        for a, b, data, off in _pieces(batch.column(1)):
            w, start, end, first = bw.words(data, off)
            n = np.diff(first)
            flow = np.full(len(w) + b - a, END, _U)  # every row's words, then one end
            place = np.arange(len(w)) + np.repeat(np.arange(b - a), n)
            flow[place] = w
            last = np.full(len(flow), 255, np.uint8)
            last[place] = bw._LOWER[data[end - 1]] & (TAIL - 1)
            hashes, where, tokens = np.unique(flow, return_index=True, return_inverse=True)
            train = np.repeat(learn[a:b], n + 1)
            counts = np.bincount(tokens[train], minlength=len(hashes)).astype("<i8")
            sink = pa.BufferOutputStream()
            keys = pa.RecordBatch.from_arrays([ids.slice(a, b - a)], ["k"])
            with pa.ipc.new_stream(sink, keys.schema) as out:
                out.write_batch(keys)
            row = [serial, b - a, hashes.tobytes(), last[where].tobytes(), counts.tobytes(), tokens.astype("<i4").tobytes(), (n + 1).astype("<i8").tobytes(), learn[a:b].tobytes(), int(train.sum()), sink.getvalue().to_pybytes()]
            serial += 1
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [x.split()[0] for x in _ROWS.split(", ")])


def _ask(count: int):
    """A chunk's words, dealt by the high bits of their hashes (sorted, so each deal is a slice)."""

    def run(batches):
        edges = np.array([(i << 64) // count for i in range(1, count)], dtype=_U)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for chunk, h, s, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h, s, c = np.frombuffer(h, _U), np.frombuffer(s, np.uint8), np.frombuffer(c, "<i8")
                cut = np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))
                rows = [(p, chunk, h[a:b].tobytes(), s[a:b].tobytes(), c[a:b].astype("<i4").tobytes()) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["p", "chunk", "hashes", "shape", "counts"])

    return run


def _start(h: np.ndarray, shape: np.ndarray, spread: int) -> np.ndarray:
    """First class of a word that is not frequent: its shape, spread over as many classes by its hash."""
    return 1 + (shape & (TAIL - 1)).astype(np.int64) + TAIL * (h % _U(spread)).astype(np.int64)


def _answer(least: int, spread: int):
    """Counts for each chunk's words of this deal, and facts: frequent words, other words by first class."""

    def run(batches):
        for table in grouped(batches, "p"):
            blobs = [np.frombuffer(x, _U) for x in table.column("hashes").to_pylist()]
            h, back = np.unique(np.concatenate(blobs), return_inverse=True)
            total = np.zeros(len(h), np.int64)
            np.add.at(total, back, np.concatenate([np.frombuffer(x, "<i4") for x in table.column("counts").to_pylist()]))
            shape = np.zeros(len(h), np.uint8)
            shape[back] = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("shape").to_pylist()])
            cuts = np.cumsum([len(x) for x in blobs])[:-1]
            p = table.column("p")[0].as_py()
            for chunk, at in zip(table.column("chunk").to_pylist(), np.split(back, cuts)):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([p], pa.int32()), pa.array([total[at].tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], ["chunk", "p", "counts", "frequent", "distinct"])
            big = (total >= least) & (h != END)
            few = (total > 0) & ~big & (h != END)
            rare = np.bincount(_start(h[few], shape[few], spread) - 1, minlength=TAIL * spread).astype("<i8")
            often = np.stack([h[big].view(np.int64), total[big]], 1)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([p], pa.int32()), pa.array([b""], pa.binary()), pa.array([often.tobytes()], pa.binary()), pa.array([rare.tobytes()], pa.binary())], ["chunk", "p", "counts", "frequent", "distinct"])

    return run


def _small_ids(h: np.ndarray, shape: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Word to id: 0 the end, 1.. tail classes, then frequent words by their sorted hash."""
    out = 1 + (shape & (TAIL - 1)).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        out = np.where(frequent[at] == h, 1 + TAIL + at, out)
    out[h == END] = 0
    return out


def _bigrams(frequent: np.ndarray):
    size = 1 + TAIL + len(frequent)

    def run(batches):
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for h, s, tokens, n, learn in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids = _small_ids(np.frombuffer(h, _U), np.frombuffer(s, np.uint8), frequent)
                flow = ids[np.frombuffer(tokens, "<i4")]
                train = np.repeat(np.frombuffer(learn, bool), np.frombuffer(n, "<i8"))
                before = np.concatenate(([0], flow[:-1]))  # every row ends with 0, so the first word of a row follows the end
                pair, c = np.unique((before * size + flow)[train], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(c)], ["pair", "c"])

    return run


def _deal(h: np.ndarray, count: int) -> np.ndarray:
    """Edges of the count slices of sorted hashes."""
    edges = np.array([(i << 64) // count for i in range(1, count)], dtype=_U)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))


def _word_classes(rows: list[dict], h: np.ndarray, shape: np.ndarray, frequent: np.ndarray, of: np.ndarray, spread: int) -> np.ndarray:
    """Class of each word of a chunk: as the last pass answered, or the first."""
    told = sorted((r for r in rows if r["classes"] is not None), key=lambda r: r["part"])
    if told:
        return np.concatenate([np.frombuffer(r["classes"], "<i2") for r in told]).astype(np.int64)
    ids = _small_ids(h, shape, frequent)
    return np.where((ids > 0) & (ids <= TAIL), _start(h, shape, spread), of[ids])


_CONTEXT = ["p", "chunk", "hashes", "shape", "classes", "keys", "counts"]
_CONTEXTS = "p int, chunk long, hashes binary, shape binary, classes binary, keys binary, counts binary"


def _packed(word: np.ndarray, code: np.ndarray, c: np.ndarray, words: int, width: int) -> tuple[bytes, bytes]:
    """Entries sorted by word in about two bytes each: numbers of entries by word and codes, then counts, 255 for those behind."""
    keys = np.bincount(word, minlength=words).astype("<u2").tobytes() + code.astype("<u1" if width <= 256 else "<u2").tobytes()
    return keys, np.minimum(c, 255).astype("<u1").tobytes() + c[c >= 255].astype("<i8").tobytes()


def _unpacked(keys: bytes, counts: bytes, words: int, width: int, first: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the words first..stop-1, words numbered from first; nothing is made of the others but two sums."""
    stop = words if stop is None else stop
    kind, n = np.dtype("<u1" if width <= 256 else "<u2"), np.frombuffer(keys, "<u2", words)
    a = int(n[:first].sum(dtype=np.int64))
    size = int(n[first:stop].sum(dtype=np.int64))
    code = np.frombuffer(keys, kind, size, 2 * words + a * kind.itemsize).astype(np.int64)
    c = np.frombuffer(counts, "<u1", size, a).astype(np.int64)
    long, total = np.flatnonzero(c == 255), (len(keys) - 2 * words) // kind.itemsize
    if len(long):
        c[long] = np.frombuffer(counts, "<i8", len(long), total + 8 * int(np.count_nonzero(np.frombuffer(counts, "<u1", a) == 255)))
    return np.repeat(np.arange(stop - first), n[first:stop]), code, c


def _contexts(frequent: np.ndarray, of: np.ndarray, k: int, count: int, only_table: bool):
    """Class bigrams of a task's chunks (p = -1), and for each deal of a chunk the counts of its words' neighbours by class.

    A code is the class after the word, k for the word itself, or k + 1 + the class before it."""
    width = 2 * (k + 1)

    def run(batches):
        table = np.zeros(k * k, np.int64)
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        for rows in (t.to_pylist() for t in grouped(batches, "chunk")):
            base = next(r for r in rows if r["part"] < 0)
            h, shape, tokens = np.frombuffer(base["hashes"], _U), np.frombuffer(base["shape"], np.uint8), np.frombuffer(base["tokens"], "<i4")
            cls = _word_classes(rows, h, shape, frequent, of, (k - 1) // TAIL)
            train = np.repeat(np.frombuffer(base["train"], bool), np.frombuffer(base["n_tokens"], "<i8"))
            a, b = np.concatenate(([len(h) - 1], tokens[:-1]))[train].astype(np.int64), tokens[train].astype(np.int64)
            table += np.bincount(cls[a] * k + cls[b], minlength=k * k)
            if only_table:
                continue
            moves, same = _small_ids(h, shape, frequent), a == b
            moves = (moves > 0) & (moves <= TAIL)
            after = (a * width + np.where(same, k, cls[b]))[moves[a]]
            keys, c = np.unique(np.concatenate((after, (b * width + k + 1 + cls[a])[moves[b] & ~same])), return_counts=True)
            cut = _deal(h, count)
            at = np.searchsorted(keys, cut * width)
            out = [(p, base["chunk"], h[i:j].tobytes(), shape[i:j].tobytes(), cls[i:j].astype("<i2").tobytes(), *_packed(keys[x:y] // width - i, keys[x:y] % width, c[x:y], j - i, width)) for p, (i, j, x, y) in enumerate(zip(cut[:-1], cut[1:], at[:-1], at[1:])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], _CONTEXT)
        last = [-1, -1, b"", b"", b"", b"", table.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, kinds)], _CONTEXT)

    return run


def _cells(batches):
    """The class bigrams of all rows of a task as (pair, c)."""
    total = 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total = total + np.frombuffer(x, "<i8")
    if not np.isscalar(total):
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "c"])


def _f(x):
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(n: np.ndarray) -> float:
    """What of the log likelihood of the training tokens depends on the classes."""
    return float(_f(n).sum() - _f(n.sum(axis=1)).sum() - _f(n.sum(axis=0)).sum())


def assign(word: np.ndarray, code: np.ndarray, x: np.ndarray, cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New class and count of each word; none moves into an empty class, where all would go at once. Entry i says that word[i] (ascending) has x[i] neighbours of code[i]; n is the class bigrams, these words' with them."""
    k = len(n)
    cell = np.concatenate((n.T, np.diag(n)[None], n)).astype(float)  # by code, then by the word's class
    held, rows, cols = _f(cell), n.sum(axis=1).astype(float), n.sum(axis=0).astype(float)
    few = np.stack([_f(cell + i) - held for i in range(1, 17)])
    count = np.bincount(word[code <= k], x[code <= k], len(cls))
    closed = rows + cols == 0
    closed[0] = True  # the end's
    out, at = cls.copy(), np.flatnonzero(np.diff(word, prepend=-1))
    stop, i = np.append(at[1:], len(word)), 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(stop, at[i] + 16384, "right")))
        e = slice(at[i], stop[j - 1])
        w, r, c = word[at[i:j]], code[e], x[e]
        gain = few[np.minimum(c, 16) - 1, r]
        many = np.flatnonzero(c > 16)
        gain[many] = _f(cell[r[many]] + c[many, None]) - held[r[many]]
        own = cls[word[e]]
        gain[np.arange(len(r)), own] = held[r, own] - _f(np.maximum(cell[r, own] - c, 0))
        gain = np.add.reduceat(gain, at[i:j] - at[i], axis=0)
        m, own, line = count[w][:, None], cls[w], np.arange(len(w))
        side = sum(_f(v + m) - _f(v) for v in (rows, cols))
        side[line, own] = sum(_f(v[own]) - _f(np.maximum(v[own] - m[:, 0], 0)) for v in (rows, cols))
        gain -= side
        gain[:, closed] = -np.inf
        best = np.argmax(gain, axis=1)
        out[w] = np.where(gain[line, best] > gain[line, own] + 1e-9, best, own)
        i = j
    return out, count


def _assigned(n: np.ndarray):
    """New classes for each chunk's words of this deal, and facts: moved words by class, words seen once by shape and class."""
    k, names = len(n), ["chunk", "part", "classes", "members", "once"]
    width = 2 * (k + 1)
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]

    def run(batches):
        for table in grouped(batches, "p"):
            col = {c: table.column(c).to_pylist() for c in _CONTEXT}
            blobs = [np.frombuffer(x, _U) for x in col["hashes"]]
            h, back = np.unique(np.concatenate(blobs), return_inverse=True)
            cls, shape = np.zeros(len(h), np.int64), np.zeros(len(h), np.uint8)
            cls[back] = np.concatenate([np.frombuffer(x, "<i2") for x in col["classes"]])
            shape[back] = np.concatenate([np.frombuffer(x, np.uint8) for x in col["shape"]])
            first = np.cumsum([0, *(len(x) for x in blobs)])
            entries = sum(map(len, col["keys"])) // (1 if width <= 256 else 2)
            parts = min(len(h), entries // _ENTRIES + 1)
            edges = h[[len(h) * i // parts for i in range(1, parts)]]
            cuts = [np.concatenate(([0], np.searchsorted(x, edges), [len(x)])) for x in blobs]
            count = np.zeros(len(h), np.int64)
            # words stand alone here, so a slice of the deal's hashes at a time is the same and holds less
            for s, (a, b) in enumerate(itertools.pairwise([0, *(len(h) * i // parts for i in range(1, parts)), len(h)])):
                keys, x = [], []
                for k_, c_, blob, i, cut in zip(col["keys"], col["counts"], blobs, first, cuts):
                    w, code, c = _unpacked(k_, c_, len(blob), width, cut[s], cut[s + 1])
                    keys.append((back[w + i + cut[s]] - a) * width + code)
                    x.append(c)
                keys, where = np.unique(np.concatenate(keys), return_inverse=True)
                x = np.bincount(where, np.concatenate(x), len(keys)).astype(np.int64)
                del where
                cls[a:b], count[a:b] = assign(keys // width, keys % width, x, cls[a:b], n)
            for chunk, at in zip(col["chunk"], np.split(back, first[1:-1])):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([chunk, col["p"][0], cls[at].astype("<i2").tobytes(), b"", b""], kinds)], names)
            once = np.bincount((shape[count == 1] & (TAIL - 1)).astype(np.int64) * k + cls[count == 1], minlength=TAIL * k)
            facts = [-1, col["p"][0], None, np.bincount(cls[count > 0], minlength=k).astype("<i8").tobytes(), once.astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(facts, kinds)], names)

    return run


def exchange(pair: np.ndarray, count: np.ndarray, size: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of each of size ids: ids up to TAIL keep one each, the others are moved among `classes` more."""
    fixed = 1 + TAIL
    k = fixed + classes
    a, b = pair // size, pair % size
    freq = np.bincount(a, count, size) + np.bincount(b, count, size)
    of = np.arange(size)
    order = fixed + np.argsort(-freq[fixed:], kind="stable")
    of[order] = fixed + np.arange(len(order)) % classes
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    at_a, at_b = np.searchsorted(a[by_a], np.arange(size + 1)), np.searchsorted(b[by_b], np.arange(size + 1))
    n = np.zeros((k, k))
    np.add.at(n, (of[a], of[b]), count)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            ra, rb = by_a[at_a[w] : at_a[w + 1]], by_b[at_b[w] : at_b[w + 1]]
            own = count[ra[b[ra] == w]].sum()
            right = np.bincount(of[b[ra]], count[ra] * (b[ra] != w), k)  # classes after w
            left = np.bincount(of[a[rb]], count[rb] * (a[rb] != w), k)  # classes before w
            c = of[w]
            n[c] -= right
            n[:, c] -= left
            n[c, c] -= own
            rows, cols = n.sum(axis=1), n.sum(axis=0)
            free = np.arange(fixed, k)
            gain = (f(n[free] + right) - f(n[free])).sum(axis=1) + (f(n[:, free].T + left) - f(n[:, free].T)).sum(axis=1)
            corner, into = n[free, free], right[free] + left[free] + own
            gain += f(corner + into) - f(corner + right[free]) - f(corner + left[free]) + f(corner)
            gain -= f(rows[free] + right.sum() + own) - f(rows[free]) + f(cols[free] + left.sum() + own) - f(cols[free])
            best = int(free[np.argmax(gain)])
            if gain[best - fixed] <= gain[c - fixed] + 1e-9:
                best = c
            moved += best != c
            of[w] = best
            n[best] += right
            n[:, best] += left
            n[best, best] += own
        if not moved:
            break
    return of


class Model:
    """Everything of bounded size: totals, frequent words' hashes, first classes, classes of unseen words by shape, and tables over classes."""

    def __init__(self, total: int, distinct: int, frequent: np.ndarray, of: np.ndarray, unseen: np.ndarray, jump: np.ndarray, mass: np.ndarray, mix: float):
        self.total, self.distinct, self.frequent, self.of, self.unseen, self.jump, self.mass, self.mix = total, distinct, frequent, of, unseen, jump, mass, mix


def _score(model: Model):
    def run(batches):
        uni = model.total + model.distinct + 1
        for table in grouped(batches, "chunk"):
            rows = table.to_pylist()
            base = next(r for r in rows if r["part"] < 0)
            c = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted((r for r in rows if r["counts"] is not None), key=lambda r: r["part"])])
            h, shape = np.frombuffer(base["hashes"], _U), np.frombuffer(base["shape"], np.uint8)
            tokens, n = np.frombuffer(base["tokens"], "<i4"), np.frombuffer(base["n_tokens"], "<i8")
            cls = np.where((c > 0) | (h == END), _word_classes(rows, h, shape, model.frequent, model.of, (len(model.mass) - 1) // TAIL), model.unseen[shape & (TAIL - 1)])
            emit = (c + 1) / model.mass[cls]
            one = (c + 1) / uni
            to = cls[tokens]
            before = np.concatenate(([0], to[:-1]))
            p = np.log10(model.mix * model.jump[before, to] * emit[tokens] + (1 - model.mix) * one[tokens])
            at = np.concatenate(([0], np.cumsum(n)[:-1]))
            keys = pa.ipc.open_stream(base["keys"]).read_all().column(0).combine_chunks()
            cols = [keys, pa.array(n), pa.array(np.add.reduceat((c > 0)[tokens].astype(np.int64), at)), pa.array(np.add.reduceat(np.log10(one)[tokens], at)), pa.array(np.add.reduceat(p, at))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def _written(df: DataFrame, name: str, schema: str) -> tuple[DataFrame, str]:
    """df, written to the shared folder and read again; the shuffles of the write leave the disk when it ends."""
    spark, option = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch(spark, name), spark.conf.get(option, None)
    spark.conf.set(option, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)
    return spark.read.schema(schema).parquet(path), path


def brown_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", min_rate: float = 5e-4, classes: int = 48, sweeps: int = 4, mix: float = 0.8, passes: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row; learn marks the training rows."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), learn.alias("learn"))
    kind = src.schema["doc_id"].dataType.simpleString()
    chunks, _ = _written(src.mapInArrow(_chunks, _ROWS), "brown-chunks", _ROWS)
    total = int(chunks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("n")).first()["n"])
    count = max(partitions(spark), total // 2_000_000)
    least = max(1, math.ceil(min_rate * total))
    k = 1 + TAIL + classes
    spread = (k - 1) // TAIL
    asked = chunks.select("chunk", "hashes", "shape", "counts").mapInArrow(_ask(count), "p int, chunk long, hashes binary, shape binary, counts binary")
    kept = "chunk long, p int, counts binary, frequent binary, distinct binary"
    answers, _ = _written(asked.repartition(count, "p").sortWithinPartitions("p").mapInArrow(_answer(least, spread), kept), "brown-counts", kept)
    facts = answers.where("chunk < 0").select("frequent", "distinct").collect()
    often = np.concatenate([np.frombuffer(r.frequent, "<i8").reshape(-1, 2) for r in facts] or [np.empty((0, 2), np.int64)])
    frequent = np.sort(often[:, 0].view(_U))
    rare = sum((np.frombuffer(r.distinct, "<i8") for r in facts), np.zeros(TAIL * spread, np.int64))
    distinct = int(rare.sum()) + len(frequent) + (total > 0)
    size = 1 + TAIL + len(frequent)
    got = chunks.select("hashes", "shape", "tokens", "n_tokens", "train").mapInArrow(_bigrams(frequent), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pair, c = got.column("pair").to_numpy(), got.column("c").to_numpy().astype(np.float64)
    order = np.argsort(pair)
    pair, c = pair[order], c[order]
    of = exchange(pair, c, size, classes, sweeps) if len(pair) else np.concatenate((np.arange(1 + TAIL), np.full(len(frequent), 1 + TAIL)))
    kinds = {"hashes": "binary", "shape": "binary", "tokens": "binary", "n_tokens": "binary", "train": "binary", "keys": "binary", "counts": "binary", "classes": "binary"}

    def chosen(df: DataFrame, part: Column, *names: str) -> DataFrame:
        return df.select("chunk", part.cast("int").alias("part"), *(F.col(x) if x in names else F.lit(None).cast(t).alias(x) for x, t in kinds.items()))

    def by_chunk(*parts: DataFrame) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.repartition(count, "chunk").sortWithinPartitions("chunk")

    def table(df: DataFrame) -> np.ndarray:
        got = df.where("p < 0").select("counts").mapInArrow(_cells, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
        out = np.zeros(k * k, np.int64)
        out[got.column("pair").to_numpy()] = got.column("c").to_numpy()
        return out.reshape(k, k)

    base = chosen(chunks, F.lit(-1), "hashes", "shape", "tokens", "n_tokens", "train")
    once, told = np.zeros((TAIL, k), np.int64), None
    members = np.zeros(k, np.int64)
    members[1 : 1 + TAIL * spread] = rare
    best = None
    for step in range(passes + 1):
        # before the first pass no chunk needs an answer
        rows = base if told is None else by_chunk(base, chosen(told.where("chunk >= 0"), F.col("part"), "classes"))
        found = rows.mapInArrow(_contexts(frequent, of, k, count, step == passes), _CONTEXTS)
        found, path = _written(found, "brown-contexts", _CONTEXTS)
        n = table(found)
        better = best is None or likelihood(n) > likelihood(best[0])
        if better:
            best = (n, told, members, once)
        if better and step < passes:
            kept = "chunk long, part int, classes binary, members binary, once binary"
            told, _ = _written(found.where("p >= 0").repartition(count, "p").sortWithinPartitions("p").mapInArrow(_assigned(n), kept), "brown-classes", kept)
        remove(spark, path)
        if not better or step == passes:
            break
        facts = told.where("chunk < 0").select("members", "once").collect()
        members = sum((np.frombuffer(r.members, "<i8") for r in facts), np.zeros(k, np.int64))
        once = sum((np.frombuffer(r.once, "<i8") for r in facts), np.zeros(TAIL * k, np.int64)).reshape(TAIL, k)
    n, told, members, once = best
    members = members + np.bincount(of[1 + TAIL :], minlength=k)
    members[0] += total > 0
    unseen = np.where(once.any(axis=1), once.argmax(axis=1), 1 + np.arange(TAIL))
    jump = n + 0.5
    model = Model(total, distinct, frequent, of, unseen, jump / jump.sum(axis=1, keepdims=True), n.sum(axis=0) + members + 1, mix)
    parts = [chosen(chunks, F.lit(-1), "hashes", "shape", "tokens", "n_tokens", "keys"), chosen(answers.where("chunk >= 0"), F.col("p"), "counts")]
    if told is not None:
        parts.append(chosen(told.where("chunk >= 0"), F.col("part"), "classes"))
    rows = by_chunk(*parts).mapInArrow(_score(model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

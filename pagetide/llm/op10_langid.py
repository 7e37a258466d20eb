"""Language identification by hierarchical discrimination: family first, then one-versus-one linear SVMs.

Texts become histograms of hashed byte trigrams (letters A-Z lower-cased, runs of bytes that are
not part of a letter count as one blank), square-rooted and scaled to length one. A one-versus-one
set of linear support vector machines over families of languages picks the family; within it,
another set picks the language. Each machine is fitted by dual coordinate descent on a bounded
sample of labelled documents (`sample_per_lang`, chosen by a hash of the id, whole texts); every
document is predicted over its whole text, in batches of rows.

Defined results: `und` with score 0 where the text is null or has no letter; with no labelled
document every text is `und`; with one learned language every text with a letter gets it. The score is the
share of the decision: the smallest logistic margin the winner has in its duels, family duels included.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm import bytewords as bw
from pagetide.llm.shared import cut

BITS = 12
#: Language families by code; a code that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "nb": "germanic", "nn": "germanic", "is": "germanic", "af": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance", "oc": "romance",
    "ru": "slavic", "uk": "slavic", "be": "slavic", "bg": "slavic", "mk": "slavic", "sr": "slavic", "hr": "slavic", "bs": "slavic", "sl": "slavic", "cs": "slavic", "sk": "slavic", "pl": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "kk": "turkic", "uz": "turkic",
    "hi": "indic", "mr": "indic", "ne": "indic", "bn": "indic", "as": "indic", "gu": "indic", "pa": "indic", "ur": "indic",
    "fa": "iranian", "ar": "semitic", "he": "semitic", "zh": "chinese", "ja": "japonic", "ko": "koreanic", "id": "malayic", "ms": "malayic", "lt": "baltic", "lv": "baltic", "el": "hellenic",
}
_BYTE = bw._LOWER.copy()
_BYTE[[b for b in range(128) if not chr(b).isalpha()]] = 32


def features(column: pa.Array) -> np.ndarray:
    """One row of hashed trigram weights for each text."""
    data, off = bw.raw(column)
    out = np.zeros((len(off) - 1, 1 << BITS), np.float32)
    for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
        for lo in range(a, b, 1 << 20):  # whole text, a window at a time; windows overlap by a trigram's rest
            x = _BYTE[data[lo : min(b, lo + (1 << 20) + 2)]].astype(np.uint32)
            if lo == a:
                x = np.concatenate(([32], x)).astype(np.uint32)
            if len(x) < 3:
                continue
            h = (x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16)))[~((x[:-2] == 32) & (x[1:-1] == 32))]
            out[i] += np.bincount((h * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights, bias last, of a linear SVM with squared hinge loss, by dual coordinate descent. y: 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    side = {1.0: 0.5 * len(y) / max(1, (y > 0).sum()), -1.0: 0.5 * len(y) / max(1, (y < 0).sum())}
    slack = np.array([1 / (2 * cost * side[float(v)]) for v in y])
    norm, alpha, w, rng = (x * x).sum(axis=1) + slack, np.zeros(len(y)), np.zeros(x.shape[1]), np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w.astype(np.float32)


class Tree:
    """Families' machines, then each family's languages' machines."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        of = np.array(langs)
        family = np.array([FAMILIES.get(v, v) for v in langs])
        self.levels = {"": self.duels(x, family)}
        for f in sorted(set(family)):
            self.levels[f] = self.duels(x[family == f], of[family == f])

    @staticmethod
    def duels(x: np.ndarray, of: np.ndarray):
        names = sorted(set(of))
        pairs = list(itertools.combinations(range(len(names)), 2))
        ws = []
        for i, j in pairs:
            pick = (of == names[i]) | (of == names[j])
            ws.append(svm(x[pick], np.where(of[pick] == names[i], 1.0, -1.0)))
        return names, pairs, np.array(ws, np.float32).reshape(len(pairs), x.shape[1] + 1)

    def choose(self, level: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning name and its smallest logistic margin; ties in duels won go to the larger sum, then the first name."""
        names, pairs, ws = self.levels[level]
        if not pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        m = x @ ws[:, :-1].T + ws[:, -1]
        won, total, least = (np.zeros((len(x), len(names))) for _ in range(3))
        least += np.inf
        for k, (i, j) in enumerate(pairs):
            won[:, i] += m[:, k] >= 0
            won[:, j] += m[:, k] < 0
            total[:, i] += m[:, k]
            total[:, j] -= m[:, k]
            least[:, i] = np.minimum(least[:, i], m[:, k])
            least[:, j] = np.minimum(least[:, j], -m[:, k])
        best = np.argmax(won + 1e-3 * np.tanh(total), axis=1)
        return best, 1 / (1 + np.exp(-4 * np.clip(least[np.arange(len(x)), best], -50, 50)))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam, score = self.choose("", x)
        out = np.empty(len(x), object)
        for k, f in enumerate(self.levels[""][0]):
            rows = np.flatnonzero(fam == k)
            if len(rows):
                best, s = self.choose(f, x[rows])
                out[rows] = np.array(self.levels[f][0], object)[best]
                score[rows] = np.minimum(score[rows], s)
        return list(out), score


def _vectors(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in features(part.column(1)).astype(np.float16)], pa.binary())], ["lang", "v"])


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_per_lang: int = 300, sample_rows: int = 20_000) -> Tree | None:
    """A tree from whole documents of every language: those with the smallest hash of their id, at most sample_per_lang
    a language and sample_rows in all (an error if that leaves a language fewer than 8), which bounds what the driver fits on."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit("langid")))
    # sample by rate first, so the window below sees a bounded number of rows however large a language is
    langs = rows.groupBy(F.col(lang_col).alias("__l")).agg(F.count("*").alias("__n"))
    langs = cut(langs)
    distinct = langs.count()
    if not distinct:
        return None
    if distinct * 8 > sample_rows:
        raise ValueError(f"{distinct} languages need a sample_rows of at least {8 * distinct}")
    each = min(sample_per_lang, sample_rows // distinct)
    rate = F.least(F.lit(1.0), (1.5 * each + 20) / F.col("__n"))
    u = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2.0**32
    keys = rows.join(F.broadcast(langs), F.col(lang_col) == F.col("__l")).where(u <= rate).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), key.alias("k"))  # sample_rows / 8 rows at most
    pick = keys.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("k", "text"))).where(F.col("rn") <= each)
    got = pick.orderBy("lang", "k", "text").select("lang", "text").mapInArrow(_vectors, "lang string, v binary").collect()
    return Tree(np.array([np.frombuffer(r.v, np.float16) for r in got], np.float32), [r.lang for r in got])


def _predict(tree: Tree | None):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                has = np.array([bool(v) for v in part.column(part.num_columns - 1).to_pylist()])
                lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if tree and has.any():
                    at_rows = np.flatnonzero(has)
                    got, s = tree.predict(features(part.column(part.num_columns - 2).take(pa.array(at_rows))))
                    lang[at_rows], score[at_rows] = got, s
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names[:-2], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, tree: Tree | None, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, lang_pred and score for each row."""
    src = docs.select(*keys, F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("has"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-2])
    return src.mapInArrow(_predict(tree), f"{head}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""Quality rules with a robust multivariate outlier test, in DataFrame operations alone.

Fixed rules come first (too few words, too much repetition). The statistics of a text are then
transformed into a vector of log rates, each shrunk a little towards a common value: characters a word, symbols
a character, repeated lines a line, capitals a character. For every language and source a minimum-covariance-
determinant estimate is made. Each of several starts orders the rows by robust distances (medians and quartiles) over
all statistics or over some of them; concentration steps take the `share` of rows with the smallest Mahalanobis
distances and re-estimate centre and covariance from them. After two steps the start with the least determinant goes on
until its determinant settles. The covariance is scaled to be consistent for normal data, so clean rows' squared
distances follow chi-square with four degrees, and rows beyond its quantile at 1 - `alpha` are rejected. A language and source with fewer than
`least_rows` rows is pooled with the others of its language, and those with all the rest; a pool
that is still smaller rejects nothing.

Quantiles come from histograms of integer statistics and moments from integer sums, so results do
not depend on the order of rows, and each step shuffles a few numbers a task and group: a hot
source is pre-aggregated where it lies. Windows of five words are compared by hash within the row
first; only rows with an equal pair compare the words themselves.

Defined results: null or blank text has no words and fails the rules; null language or source are
groups like any other; each row is judged, repeated or not; columns with the statistics' names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.shared import cut, scratch

BLANKS = " \t\n\x0b\x0c\r"
BLANK = "[\\x20\\x09-\\x0D]+"
P = 4
UNIT = 1000
#: Added to every standard deviation (in units of 1/UNIT), so that a statistic that never varies has an inverse.
FLOOR = 2.0
#: The statistics each start orders rows by.
STARTS = ((0, 1, 2, 3), (0, 3), (1, 2))
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed")


def words(text: Column) -> Column:
    """Array of the words of a text."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK))


def _paired(sorted_: str, field: str) -> str:
    """SQL: members of a sorted array of structs whose field equals a neighbour's, as their positions i."""
    s, last = sorted_, f"size({sorted_}) - 1"
    return f"transform(filter(sequence(0, {last}), k -> (k > 0 and {s}[k].{field} = {s}[greatest(k - 1, 0)].{field}) or (k < {last} and {s}[k].{field} = {s}[least(k + 1, {last})].{field})), k -> {s}[k].i)"


def base_statistics(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper and base_failed."""
    keep = [c for c in docs.columns if c not in STATISTICS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = docs.withColumn("__w", words(text)).withColumn("__l", F.filter(F.split(text, "\n"), lambda v: v.rlike("[^\\x20\\x09-\\x0D]")))
    x = x.withColumn("n_words", F.size("__w").cast("long"))
    hashed = ", ".join(f"__w[i + {k}]" for k in range(window))
    x = x.withColumn("__h", F.expr(f"CASE WHEN n_words >= {window} THEN transform(sequence(0, cast(n_words as int) - {window}), i -> xxhash64({hashed})) END"))
    x = x.withColumn("__s", F.expr("CASE WHEN size(array_distinct(__h)) < size(__h) THEN array_sort(transform(__h, (h, i) -> struct(h, i))) END"))
    x = x.withColumn("__c", F.expr(f"CASE WHEN __s IS NOT NULL THEN {_paired('__s', 'h')} END"))
    x = x.withColumn("__t", F.expr(f"CASE WHEN __c IS NOT NULL THEN array_sort(transform(__c, i -> struct(array_join(slice(__w, i + 1, {window}), ' ') AS t, i AS i))) END"))
    x = x.withColumn("__p", F.expr(f"CASE WHEN __t IS NOT NULL THEN array_sort({_paired('__t', 't')}) END"))
    covered = F.expr(f"coalesce(aggregate(__p, named_struct('last', -{window}, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least({window}, i - a.last)), a -> a.n), 0L)")
    x = x.select(
        *keep, "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    return x.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics, as integers in units of 1/UNIT."""
    n, chars = F.col("n_words"), F.col("word_chars")
    f = [(chars + 100) / (n + 20), (F.col("n_symbols") + 1) / (chars + 200), (F.col("n_dup_lines") + 1) / (F.col("n_lines") + 4), (F.col("n_upper") + 3) / (chars + 60)]
    return [F.floor(UNIT * F.log(v) + 0.5).cast("long") for v in f]


def _grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """rows with g: language and source, or the pool they fall in."""
    n = rows.groupBy("lang", "source").count()
    by_lang = W.partitionBy("lang")
    n = n.withColumn("small", F.col("count") < least_rows).withColumn("pool", F.sum(F.when(F.col("small"), F.col("count"))).over(by_lang))
    g = F.when(~F.col("small"), F.to_json(F.array(F.lit("s"), F.col("lang"), F.col("source")))).when(F.col("pool") >= least_rows, F.to_json(F.array(F.lit("l"), F.col("lang")))).otherwise(F.lit("rest"))
    return n.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), g.alias("g"))


def _small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df (already computed), broadcast where its rows are counted and few."""
    return F.broadcast(df) if df.count() <= most else df


def _invert(cov: DataFrame) -> DataFrame:
    """c_i_j becomes the inverse of c_i_j, and log_det its log determinant, by Gauss-Jordan steps over the few rows there are."""
    cov = cov.withColumn("log_det", F.lit(0.0))
    for k in range(P):
        d = F.col(f"c_{k}_{k}")
        new = {}
        for i in range(P):
            for j in range(P):
                a, b, c = F.col(f"c_{i}_{j}"), F.col(f"c_{i}_{k}"), F.col(f"c_{k}_{j}")
                new[f"c_{i}_{j}"] = F.lit(1.0) / d if i == j == k else c / d if i == k else -b / d if j == k else a - b * c / d
        cov = cov.select("g", "s", "n", (F.col("log_det") + F.log(d)).alias("log_det"), *(f"m_{i}" for i in range(P)), *(v.alias(n) for n, v in new.items()))
    return cov


def _distance() -> Column:
    z = [F.col(f"x_{i}") - F.col(f"m_{i}") for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i + 1):
            total = total + F.col(f"c_{i}_{j}") * z[i] * z[j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _start(rows: DataFrame) -> DataFrame:
    """Per g and start s: medians m_i and, as c_i_j, the inverse of the robust variances of the start's statistics."""
    long = rows.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("j"), F.col(f"x_{i}").alias("q")) for i in range(P)))).alias("e")).select("g", "e.j", "e.q")
    bars = long.groupBy("g", "j", "q").count()
    w = W.partitionBy("g", "j").orderBy("q")
    bars = bars.withColumn("upto", F.sum("count").over(w)).withColumn("n", F.sum("count").over(W.partitionBy("g", "j")))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("n"), F.col("q")))
    start = bars.groupBy("g", "j").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"), F.max("n").alias("n"))
    pick = lambda i, v: F.max(F.when(F.col("j") == i, v)).cast("double")
    sd = (F.col("hi") - F.col("lo")) / 1.349
    now = start.groupBy("g").agg(F.max("n").alias("n"), *(pick(i, F.col("mid")).alias(f"m_{i}") for i in range(P)), *(pick(i, sd * sd + FLOOR**2).alias(f"v_{i}") for i in range(P)))
    of = lambda i: F.when(F.array_contains("use", i), 1.0 / F.col(f"v_{i}")).otherwise(0.0)
    now = now.select("*", F.posexplode(F.array(*(F.array(*map(F.lit, u)) for u in STARTS))).alias("s", "use"))
    return now.select("g", "s", "n", F.lit(None).cast("double").alias("log_det"), *(f"m_{i}" for i in range(P)), *((of(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(P) for j in range(P)))


def _step(rows: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """One concentration step of each g and s."""
    near = rows.join(_small(now), "g").withColumn("bin", F.floor(F.log2(1 + _distance()) * 64).cast("int")).select("g", "s", "bin", *(f"x_{i}" for i in range(P)))
    bins = near.groupBy("g", "s", "bin").count()
    by = W.partitionBy("g", "s")
    bins = bins.withColumn("upto", F.sum("count").over(by.orderBy("bin"))).withColumn("n", F.sum("count").over(by))
    edge = cut(bins.groupBy("g", "s").agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") >= share * F.col("n"), F.col("bin"))).alias("edge")))
    sums = [F.sum(f"x_{i}").alias(f"t_{i}") for i in range(P)] + [F.sum(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"t_{i}_{j}") for i in range(P) for j in range(i + 1)]
    got = near.join(_small(edge), ["g", "s"]).where("bin <= edge").groupBy("g", "s").agg(F.max("n").alias("n"), F.count("*").alias("h"), *sums)
    mean = lambda i: F.col(f"t_{i}") / F.col("h")
    # the kept share of a normal cloud looks smaller than it is; consistency(share) undoes that
    cov = lambda i, j: (F.col(f"t_{i}_{j}") / F.col("h") - mean(i) * mean(j)) * consistency(share) + (FLOOR**2 if i == j else 0)
    return cut(_invert(got.select("g", "s", "n", *(mean(i).alias(f"m_{i}") for i in range(P)), *(cov(max(i, j), min(i, j)).alias(f"c_{i}_{j}") for i in range(P) for j in range(P)))))


def estimate(rows: DataFrame, share: float, steps: int) -> DataFrame:
    """Per g: n, centre m_i, inverse covariance c_i_j and log_det of the rows kept by the start with the least determinant. rows: g, x_i.

    steps: the most steps after the first two; they end when no determinant changes by a thousandth."""
    now = _step(rows, _step(rows, cut(_start(rows)), share), share)
    least = F.min_by(F.struct(*now.columns[1:]), F.struct("log_det", "s")).alias("r")
    now = cut(now.groupBy("g").agg(least).select("g", "r.*"))
    for _ in range(steps):
        last, now = now, _step(rows, now, share)
        moved = now.join(_small(last.select("g", F.col("log_det").alias("before"))), "g").where("abs(log_det - before) > 1e-3")
        if not moved.head(1):
            break
    return now.drop("s")


def chi_square(p: float) -> float:
    """The quantile of chi-square with P degrees at p; P is even, so the tail is in closed form."""
    import math

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        tail = math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(P // 2))
        lo, hi = (mid, hi) if tail > 1 - p else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """share / P(chi2 with P + 2 degrees <= its quantile for P degrees at share); both degrees even, so in closed form."""
    import math

    x = chi_square(share) / 2
    return share / (1 - math.exp(-x) * sum(x**k / math.factorial(k) for k in range(P // 2 + 1)))


def judge(rows: DataFrame, share: float = 0.75, steps: int = 8, alpha: float = 1e-6, least_rows: int = 100) -> DataFrame:
    """rows (with base statistics, already computed, and lang and source) with distance (squared, Mahalanobis) and kept."""
    keep = rows.columns
    groups = cut(_grouped(rows, least_rows))
    keyed = rows.withColumns({f"x_{i}": v for i, v in enumerate(vector())})
    keyed = keyed.join(_small(groups), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")))
    fit = estimate(keyed.where("n_words > 0").select("g", *(f"x_{i}" for i in range(P))), share, steps)
    d = keyed.join(_small(fit), "g", "left").withColumn("distance", F.when(F.col("n") >= least_rows, _distance()))
    return d.select(*keep, "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi_square(1 - alpha))).alias("kept"))


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """doc_id with all statistics, distance and kept, for each row."""
    named = docs.select(F.col("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return judge(cut(base_statistics(named).drop("text")), **options)


def clean(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with docs' columns. Needs columns text, lang and source."""
    path = scratch(docs.sparkSession, "quality")
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "text", "lang", "source")
    base_statistics(packed).select("__row", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed").write.parquet(path)
    return judge(docs.sparkSession.read.parquet(path), **options).where("kept").select("__row.*")

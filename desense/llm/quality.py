"""Quality rules: text statistics, fixed base rules and robust multivariate outliers.

Native throughout. The statistics are array expressions within a row, so the texts are
never shuffled. Their transformed vectors are judged against a minimum-covariance-
determinant (MCD) estimate for each language and source: from each of three starts
(medians with quartile ranges, medians with the least deviations, plain means with plain
covariances), concentration steps keep the nearest ``COVERAGE`` of a group and re-estimate
mean and covariance from them; the start that ends with the least determinant counts.
Every language, and the table as a whole, has such an estimate too. The estimate of a
group of n rows is drawn towards its language's with a weight of ``PRIOR`` rows to n, and
that towards the whole table's, so small groups are judged too, and no size is a switch.
A vector is an outlier where its squared Mahalanobis distance is above ``CUTOFF``.

Each step is one aggregation: distances fall into a fixed number of bins, and counts,
sums and products are summed by (group, start, bin), with partial sums before the shuffle.
A hot source is thus a few thousand rows a task. Vectors are scaled integers, so sums are
exact and results do not depend on partitioning.

Defined cases: null, empty and blank texts have no words, fail the base rules and are
not kept. Null languages and sources are groups of their own. Groups without any spread
are judged by the floors of the deviations. Repeated rows stay repeated; equal vectors of
a group are judged alike; a very long text is one row like any other; an empty table gives
an empty result. Extra columns are ignored; columns to keep may have any names but those
of the results, which are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from desense.llm.common import refuse_clashes, words, written

WINDOW = 8
STEPS = 3
COVERAGE = 0.75
#: Makes the covariance of the nearest 75 % of a 4-variate normal consistent.
CONSISTENCY = 1.485
#: Rows that the parent's estimate counts as.
PRIOR = 50
#: Squared distance; a 4-variate normal is above it once in ten million. The statistics
#: have longer tails than a normal, so clean texts are above it more often.
CUTOFF = 38.2
SCALE, CLIP = 1000, 10_000
#: Least standard deviations of the scaled features, added to each variance.
FLOORS = (60, 100, 150, 150)
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Bins of equal width in the binary logarithm of 1 + squared distance.
BINS, BIN_SCALE = 4096, 64
#: Estimates of at most so many groups (about 10 MB) are broadcast, of more are shuffled.
BROADCAST_GROUPS = 50_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in ``w``.

    ``transform(array(e), x -> ...)[0]`` binds e once; a name used twice in a lambda
    would be evaluated for every element.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def twice(ordered: Column) -> Column:
        same = lambda e, other: F.coalesce(other["h"] == e["h"], F.lit(False))
        found = F.filter(ordered, lambda e, k: same(e, F.get(ordered, k - 1)) | same(e, F.get(ordered, k + 1)))
        return bind(F.array_sort(F.transform(found, lambda e: e["i"])), covered)

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), 0).otherwise(bind(pairs, twice))

    starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window)))
    return F.when(F.size(w) <= window, 0).otherwise(bind(hashes, count))


def bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the five counts and base_failed."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    rows = docs.select(*keep, "text", words(F.col("text")).alias("_w"))
    counted = rows.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.coalesce(symbols, F.lit(0)).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def features() -> list[Column]:
    """Transformed statistics as scaled integers of bounded size."""
    n = F.col("n_words").cast("double")
    raw = [
        F.log(1 + F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(10 * F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]
    return [F.least(F.floor(x * SCALE + 0.5), F.lit(CLIP)).cast("long").alias(c) for c, x in zip(X, raw, strict=True)]


M, C, L = [f"m{i}" for i in range(P)], [f"c{i}{j}" for i, j in PAIRS], [f"l{i}{j}" for i, j in PAIRS]


def _quartiles(rows: DataFrame) -> DataFrame:
    """(grp, n, m0.., d0..): medians, and deviations by the quartile range (1.349 of them)."""
    long = rows.select("grp", F.posexplode(F.array(*X)).alias("dim", "value"))
    counts = long.groupBy("grp", "dim", "value").count()
    whole = Window.partitionBy("grp", "dim")
    counts = counts.withColumn("below", F.sum("count").over(whole.orderBy("value"))).withColumn("all", F.sum("count").over(whole))
    quartile = lambda q: F.min(F.when(4 * F.col("below") >= q * F.col("all"), F.col("value")))
    per_dim = counts.groupBy("grp", "dim").agg(
        F.max("all").alias("n"), quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3")
    )
    pick = lambda i, c: F.max(F.when(F.col("dim") == i, F.col(c)))
    return per_dim.groupBy("grp").agg(
        F.max("n").alias("n"), *[pick(i, "q2").cast("double").alias(f"m{i}") for i in range(P)],
        *[((pick(i, "q3") - pick(i, "q1")) / 1.349).alias(f"d{i}") for i in range(P)],
    )


def _moments(sums: DataFrame, consistency: float) -> DataFrame:
    """(grp, start, n, m, c) from counts k, sums s and sums of products q."""
    sums = sums.select("*", *[(F.col(f"s{i}") / F.col("k")).alias(f"m{i}") for i in range(P)])
    cov = lambda i, j: (F.col(f"q{i}{j}") / F.col("k") - F.col(f"m{i}") * F.col(f"m{j}")) * consistency + (float(FLOORS[i] ** 2) if i == j else 0.0)
    return sums.select("grp", "start", "n", *M, *[cov(i, j).alias(c) for c, (i, j) in zip(C, PAIRS, strict=True)])


SUMS = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in PAIRS]


def _sums() -> list[Column]:
    return [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS]


def _starts(rows: DataFrame) -> DataFrame:
    """The three starts of each group, as (grp, start, n, m, c, l)."""
    middle = _quartiles(rows)
    floors = {f"c{i}{j}": F.lit(float(FLOORS[i] ** 2) if i == j else 0.0) for i, j in PAIRS}
    by_range = {f"c{i}{i}": F.col(f"d{i}") * F.col(f"d{i}") + float(FLOORS[i] ** 2) for i in range(P)}
    diagonal = lambda start, cov: middle.select("grp", F.lit(start).alias("start"), "n", *M, *[cov.get(c, F.lit(0.0)).alias(c) for c in C])
    whole = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"cast(sum({x}) as double)").alias(f"s{i}") for i, x in enumerate(X)], *[F.expr(f"cast(sum({X[i]} * {X[j]}) as double)").alias(f"q{i}{j}") for i, j in PAIRS])
    plain = _moments(whole.withColumns({"start": F.lit(2), "k": F.col("n").cast("double")}), 1.0)
    return _factored(diagonal(0, by_range).unionByName(diagonal(1, floors)).unionByName(plain))


def _factored(params: DataFrame) -> DataFrame:
    """With the Cholesky factor l of the covariance c."""
    for j in range(P):
        rest = F.col(f"c{j}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        params = params.withColumn(f"l{j}{j}", F.sqrt(rest))
        for i in range(j + 1, P):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    return params


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    out = rows.join(params, "grp")
    for i in range(P):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = F.col("z0") * F.col("z0")
    for i in range(1, P):
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return out.withColumn("d2", total)


def _concentrated(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step of every start."""
    near = F.least(F.floor(F.log2(1 + F.col("d2")) * BIN_SCALE), F.lit(BINS)).cast("int").alias("bin")
    far = _with_distance(rows, params.select("grp", "start", "n", *M, *L))
    bins = far.select("grp", "start", "n", near, *X).groupBy("grp", "start", "n", "bin").agg(F.count(F.lit(1)).alias("k"), *_sums())
    before = F.sum("k").over(Window.partitionBy("grp", "start").orderBy("bin")) - F.col("k")
    kept = bins.withColumn("before", before).where(F.col("before") < F.ceil(F.col("n") * COVERAGE))
    sums = kept.groupBy("grp", "start").agg(F.max("n").alias("n"), F.sum("k").cast("double").alias("k"), *[F.sum(c).cast("double").alias(c) for c in SUMS])
    return _factored(_moments(sums, CONSISTENCY))


def _few(groups: DataFrame) -> DataFrame:
    """A written table of one short row a group, broadcast if it has few rows."""
    groups = written(groups)
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def mcd_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Estimates for rows (grp, x0..x3): grp, n, mean m and covariance c, of the start with
    the least determinant, of equals the first."""
    params = _few(_starts(rows))
    for _ in range(steps):
        params = _few(_concentrated(rows, params))
    root = F.col("l00")  # of the determinant
    for i in range(1, P):
        root = root * F.col(f"l{i}{i}")
    best = F.min_by(F.struct("n", *M, *C), F.struct(root, "start")).alias("best")
    return params.groupBy("grp").agg(best).select("grp", "best.*")


def _drawn(own: DataFrame, parent: DataFrame) -> DataFrame:
    """Estimates drawn towards those of their parents, which have the key ``of``."""
    there = parent.select(F.col("grp").alias("of"), *[F.col(c).alias(f"p_{c}") for c in (*M, *C)])
    drawn = [((F.col("n") * F.col(c) + PRIOR * F.col(f"p_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in (*M, *C)]
    return own.join(there, "of").select("grp", "n", *drawn)


def judged(docs: DataFrame, keep: list[str], steps: int = STEPS) -> DataFrame:
    """_row (a struct of the ``keep`` columns), the counts, base_failed, kept and d2, the
    squared distance."""
    keys = {"_lang": "lang", "_source": "source"}
    named = docs.select(F.struct(*keep).alias("_row"), "text", *[F.col(c).alias(k) for k, c in keys.items()])
    stats = written(text_stats(named, ["_row", *keys]))
    out = ["_row", *STATS, "base_failed"]
    lang = F.struct(F.col("_lang").alias("l"))
    both = F.struct(F.col("_lang").alias("l"), F.struct(F.col("_source").alias("s")).alias("of"))
    grouped = stats.where("not base_failed").select(*out, *features(), F.concat(F.lit("2"), F.to_json(both)).alias("grp"), F.concat(F.lit("1"), F.to_json(lang)).alias("of"))
    vectors = written(grouped.select("grp", "of", *X))
    levels = vectors.select(F.explode(F.array("grp", "of", F.lit("0"))).alias("grp"), *X)
    found = written(mcd_estimates(levels, steps))
    whole = found.where("grp = '0'")
    languages = written(_drawn(found.where("grp like '1%'").withColumn("of", F.lit("0")), whole))
    sources = found.where("grp like '2%'").join(vectors.select("grp", "of").distinct(), "grp")
    params = _few(_factored(_drawn(sources, languages)).select("grp", *M, *L))
    rows = _with_distance(grouped, params)
    kept = rows.select(*out, (F.col("d2") <= CUTOFF).alias("kept"), "d2")
    failed = stats.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2"))
    return kept.unionByName(failed)


def quality_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), steps: int = STEPS) -> DataFrame:
    """``keep`` columns, the counts, base_failed, kept and d2."""
    refuse_clashes(keep, [*STATS, "base_failed", "kept", "d2"])
    return judged(docs, list(keep), steps).select("_row.*", *STATS, "base_failed", "kept", "d2")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    return judged(docs, docs.columns).where("kept").select("_row.*")

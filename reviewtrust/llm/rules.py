"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Every text becomes a vector of transformed statistics in fixed point (``FEATURES``). For each
language and source the centre and covariance come from the subset of ``SUPPORT`` of the rows
whose covariance determinant is least, found by concentration steps: measure every row's
Mahalanobis distance from the present estimate, keep the nearest share, estimate again. Two
deterministic starts (median with median deviations; mean with full covariance) run side by side,
and the smaller determinant wins. A row is rejected if its squared distance exceeds ``CUTOFF``.

Scale: one pass over the texts writes a narrow table; each step is two aggregates with
map-side combining, keyed by group, start and histogram bin. The share's threshold comes from a
histogram of distances with bounded bins, so no group is ever sorted or gathered, however
large. The estimates are one row a group; groups that hold a large part of all rows meet them by a broadcast of
bounded size, the others in a shuffle.
Groups with fewer than ``MIN_ROWS`` rows share one pooled estimate, null languages and
sources are groups of their own. Sums are of integers, so reruns agree exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.llm.common import WORD, join_hot, let, mark_hot, text_of, with_row_key, workspace
from reviewtrust.session import Workspace

FEATURES = ("z_length", "z_symbols", "z_lines", "z_repeats", "z_upper")
#: One step of the fixed-point grid.
GRID = 4096
#: Added to each standard deviation (in units of the statistic), so that statistics that hardly vary in a
#: group (most texts have no symbol and no repeated line) do not reject small deviations.
FLOORS = (0.10, 0.05, 0.20, 0.15, 0.10)
SUPPORT = 0.75
#: Makes the covariance of the nearest 75 % of a normal sample consistent: 0.75 / P(chi2_7 <= q75(chi2_5)).
CONSISTENCY = 1.41
#: 99.99 % quantile of chi-square with five degrees of freedom.
CUTOFF = 25.74
MIN_ROWS = 50
STEPS = 5
BINS_PER_DOUBLING = 64
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _covered(hashes: Column, width: int) -> Column:
    """Positions inside windows whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(rows: Column) -> Column:
        same = F.filter(
            rows,
            lambda r, i: F.coalesce(r["h"] == F.get(rows, i - 1)["h"], F.lit(False))
            | F.coalesce(r["h"] == F.get(rows, i + 1)["h"], F.lit(False)),
        )
        return F.aggregate(
            F.sort_array(F.transform(same, lambda r: r["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")
            ),
            lambda acc: acc["n"],
        )

    return let(placed, repeated)


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the array."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))
    )
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(
        let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, width)),
        )
    )


def statistics(docs: DataFrame) -> DataFrame:
    """Base counts and the vector of every row.

    Null and empty texts have zero counts and fail the base rule. Returns the row key, doc_id, lang,
    source, ``_group`` (both as one text), the counts, ``base_failed`` and the fixed-point features.
    """
    text = text_of(docs)
    measured = with_row_key(docs).select(
        "_key_a",
        "_key_b",
        "doc_id",
        docs["lang"].cast("string").alias("lang"),
        docs["source"].cast("string").alias("source"),
        let(
            F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            lambda w: F.struct(
                F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("rep")
            ),
        ).alias("w"),
        F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0))).alias("sym"),
        let(
            F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD))),
            lambda lines: F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("distinct")),
        ).alias("lines"),
        F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("upper"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.sqrt(part / whole)).otherwise(F.lit(0.0))

    n, chars = F.col("w.n"), F.col("w.chars")
    duplicates = F.col("lines.n") - F.col("lines.distinct")
    vector = (
        F.when(n > 0, F.log(chars / n)).otherwise(F.lit(0.0)),
        share(F.col("sym"), chars),
        share(duplicates, F.col("lines.n")),
        share(F.col("w.rep"), n),
        share(F.col("upper"), chars),
    )
    return measured.select(
        "_key_a",
        "_key_b",
        "doc_id",
        "lang",
        "source",
        F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}).alias("_group"),
        n.cast("bigint").alias("n_words"),
        chars.cast("bigint").alias("word_chars"),
        F.col("sym").cast("bigint").alias("n_symbols"),
        duplicates.cast("bigint").alias("n_dup_lines"),
        F.col("w.rep").cast("bigint").alias("n_repeat_words"),
        ((n < 20) | (100 * F.col("w.rep") > 30 * n)).alias("base_failed"),
        *(F.round(v * GRID).cast("bigint").alias(name) for v, name in zip(vector, FEATURES, strict=True)),
    )


def _squared_distance() -> Column:
    diff = [F.col(f) - F.col("m")[i] for i, f in enumerate(FEATURES)]
    terms = [F.col("p")[i * P + j] * diff[i] * diff[j] * (1.0 if i == j else 2.0) for i, j in PAIRS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _inverse(matrix: Column) -> Column:
    """A positive definite matrix (row by row) to (inverse, log determinant), sweeping out one pivot after another."""

    def sweep(acc: Column, k: Column) -> Column:
        m = acc["m"]

        def entry(x: Column, at: Column) -> Column:
            i, j, pivot = F.floor(at / P), at % P, F.get(m, k * (P + 1))
            row, column = F.get(m, (k * P + j).cast("int")), F.get(m, (i * P + k).cast("int"))
            return (
                F.when((i == k) & (j == k), 1.0 / pivot)
                .when(i == k, row / pivot)
                .when(j == k, -column / pivot)
                .otherwise(x - column * row / pivot)
            )

        return F.struct(F.transform(m, entry).alias("m"), (acc["log_det"] + F.log(F.get(m, k * (P + 1)))).alias("log_det"))

    start = F.struct(matrix.alias("m"), F.lit(0.0).alias("log_det"))
    return F.aggregate(F.array(*(F.lit(k) for k in range(P))), start, sweep)


def _precision(estimates: DataFrame) -> DataFrame:
    """Centres m and covariances c of the groups to centres, precisions p and log determinants."""
    floors = [(FLOORS[i] * GRID) ** 2 if i == j else 0.0 for i in range(P) for j in range(P)]
    raised = F.zip_with(F.col("c"), F.array(*(F.lit(f) for f in floors)), lambda c, f: c + f)
    return estimates.select("grp", "start", "m", _inverse(raised).alias("x")).select(
        "grp", "start", "m", F.col("x.m").alias("p"), F.col("x.log_det").alias("log_det")
    )


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    """Mean and covariance of rows(grp, start, features), covariances times ``scale``."""
    sums = rows.groupBy("grp", "start").agg(
        F.count("*").alias("n"),
        *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in PAIRS),
    )
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    c = [
        (F.col(f"q{max(i, j)}{min(i, j)}") / F.col("n") - mean[i] * mean[j]) * scale for i in range(P) for j in range(P)
    ]
    return sums.select("grp", "start", F.array(*mean).alias("m"), F.array(*c).alias("c"))


def _medians(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Start from medians and median absolute deviations. Exact, and bounded: the features have few distinct values."""
    half = F.lit(0.5)
    middle = rows.groupBy("grp").agg(F.array(*(F.percentile(f, half) for f in FEATURES)).alias("m"))
    middle = middle.join(hot, "grp")
    away = join_hot(rows, middle, ["grp"]).groupBy("grp", "m").agg(
        F.array(*(F.percentile(F.abs(F.col(f) - F.col("m")[i]), half) for i, f in enumerate(FEATURES))).alias("d")
    )
    c = [F.pow(1.4826 * F.col("d")[i], 2) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]
    return away.select("grp", F.lit(0).alias("start"), "m", F.array(*c).alias("c"))


def _nearest(rows: DataFrame, estimates: DataFrame, space: Workspace) -> DataFrame:
    """The nearest SUPPORT of each group's rows by bins of the distance; a bin is taken or left whole."""
    bin_of = F.floor(F.log2(1.0 + _squared_distance()) * BINS_PER_DOUBLING).alias("bin")
    bins = join_hot(rows, estimates, ["grp"]).groupBy("grp", "start", bin_of).agg(F.count("*").alias("n"))
    pairs = bins.groupBy("grp", "start").agg(
        F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins")
    )
    edge = pairs.select(
        "grp",
        "start",
        F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("bigint").alias("below"), F.lit(-1).cast("bigint").alias("edge")),
            lambda acc, b: F.struct(
                (acc["below"] + b["n"]).alias("below"),
                F.when(acc["below"] < F.ceil(F.col("all") * SUPPORT), b["bin"]).otherwise(acc["edge"]).alias("edge"),
            ),
            lambda acc: acc["edge"],
        ).alias("edge"),
    )
    edged = space.write(estimates.join(edge, ["grp", "start"]))
    near = join_hot(rows, edged, ["grp"]).select("grp", "start", "edge", *FEATURES, bin_of)
    return near.where("bin <= edge").select("grp", "start", *FEATURES)


def fit(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """One estimate for each (lang, source), also of the pooled ones: _group, start, m, p, log_det (nulls where no row of
    the group passed the base rule) and ``hot``."""
    space = workspace(stats.sparkSession, "quality-rules")
    sizes = space.write(stats.groupBy("_group").agg(F.count("*").alias("n")))
    pooled = F.when(F.col("n") < MIN_ROWS, F.lit("pooled")).otherwise(F.col("_group")).alias("grp")
    groups = space.write(mark_hot(sizes.select("_group", pooled, "n")))
    rows = space.write(join_hot(stats.where("not base_failed"), groups, ["_group"]).select("grp", *FEATURES))
    hot = space.write(mark_hot(rows.groupBy("grp").agg(F.count("*").alias("n"))))
    plain = _moments(rows.withColumn("start", F.lit(1)), 1.0)
    estimates = space.write(_precision(_medians(rows, hot).unionByName(plain)).join(hot, "grp"))
    for _ in range(steps):
        moments = _moments(_nearest(rows, estimates, space), CONSISTENCY)
        estimates = space.write(_precision(moments).join(hot, "grp"))
    best = estimates.groupBy("grp").agg(
        F.min_by(F.struct("start", "m", "p", "log_det"), F.struct("log_det", "start")).alias("e")
    )
    return space.write(groups.join(best, "grp", "left").select("_group", "hot", "e.*"))


def judge(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds ``distance`` (squared, 0 without an estimate) and ``kept``. A group has no estimate if the base rule rejects all
    its rows."""
    joined = join_hot(stats, estimates, ["_group"]).withColumn("distance", _squared_distance())
    return joined.select(
        *stats.columns,
        "distance",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Every row's counts, distance and verdict; repeated rows are judged alike, an empty table gives no rows."""
    stats = workspace(docs.sparkSession, "quality-stats").write(statistics(docs))
    return judge(stats, fit(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    rejected = quality_verdicts(docs).where("not kept").select("_key_a", "_key_b").distinct()
    keyed = with_row_key(docs)
    return keyed.join(rejected, ["_key_a", "_key_b"], "left_anti").select(*docs.columns)

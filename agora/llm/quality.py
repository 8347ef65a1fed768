"""Quality rules: plain limits, and robust multivariate outliers per language and source.

Every text gives a vector of five transformed statistics. For each language and source a
minimum-covariance-determinant estimate describes the bulk of these vectors. Concentration
steps keep the three quarters of the documents that lie nearest, by Mahalanobis distance, and
estimate mean and covariance anew from them. They run from three starts: the plain estimate of
all documents, the medians and quartiles of the group, and those of its language, so that junk
in one cluster doesn't draw every start to itself. Every start of every group runs until its
determinant falls no more; the smallest determinant counts. Documents too far from this
estimate are rejected.

Groups may be small, so an estimate counts the medians and quartiles of the group's language as
some documents more (a regularised estimate). Statistics such as the share of repeated lines are
zero in most documents: the part of a statistic's variance that the statistics before it don't
explain is at least a floor.

All of it is DataFrame expressions: the moments are sums over exact integers (a rerun gives
the same bits), the covariance is factored by column expressions (Cholesky), and the shares and
quartiles come from counts per narrow bucket. A step reads the vectors once: the moments are
summed per bucket of distances, and those up to the wanted share are added. Nothing is sorted,
and only rows per group travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from agora.llm.common import GAP, let, stored, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: The statistics, and the floor of each one's spread. The bulk of clean text spreads over 0.02
#: and more in word lengths and 0.01 in capitals; in the other statistics it is all zero, and
#: the floors say how far from zero is near.
FLOORS = {
    "word_length": 0.01,  # ln(code points per word)
    "symbols": 0.25,  # ln(1 + symbols per 100 words)
    "dup_lines": 0.03,  # share of lines equal to an earlier one
    "repeats": 0.03,  # share of words in repeated windows
    "capitals": 0.004,  # capitals per code point of words, square root
}
NAMES = tuple(FLOORS)
DIMENSIONS = len(NAMES)
#: Words (of five code points, a twentieth of these capitals) and lines that every text counts
#: as more, so that the statistics of short texts spread little more than those of long ones.
MORE_WORDS, MORE_CHARS, MORE_CAPITALS, MORE_LINES = 50, 250, 12.5, 10
#: Share of the documents that an estimate rests on, and the factor that makes the covariance
#: of this nearest part of a normal sample consistent: h / F7(q), F5(q) = h, with chi-square F.
HALF = 0.75
CONSISTENCY = 1.412
#: Squared distance beyond which a document is rejected: the chi-square quantile of five
#: dimensions at 1 - 1e-6.
CUTOFF = 35.9
#: A step counts if the logarithm of the determinant falls by this at least.
FALLS = 1e-3
#: Number of documents that the language counts as in a group's estimate.
PRIOR = 20.0
#: Integers per unit of a statistic in the sums, and per bucket for quartiles.
SCALE = 1_000
WIDTH = 2
#: Buckets of distances per unit of ln(1 + squared distance).
FINE = 64
_GROUPS = ("group", "wider")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in ``window``-word windows that occur at least twice in the array.

    Windows are compared by 64-bit hashes of their words.
    """

    def of_hashes(hashes: Column) -> Column:
        starts = F.transform(hashes, lambda value, place: F.struct(value.alias("h"), place.alias("p")))

        def of_sorted(ordered: Column) -> Column:
            last = F.size(ordered) - 1
            twice = F.filter(
                ordered,
                lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]))
                | ((i < last) & (F.get(ordered, i + 1)["h"] == x["h"])),
            )
            places = F.sort_array(F.transform(twice, lambda x: x["p"]))
            # A window adds the words up to the next repeated window's start.
            return let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))),
                    F.lit(0).cast("bigint"),
                    lambda total, x: total + x,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            let(F.sort_array(starts), of_sorted)
        )

    def of_words(w: Column) -> Column:
        each = F.transform(w, lambda word: F.xxhash64(word))
        windows = let(
            each,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
            ),
        )
        return F.when(F.size(w) > window, let(windows, of_hashes)).otherwise(F.lit(0).cast("bigint"))

    return of_words(words)


def counts_of(text: Column) -> Column:
    """Struct of the plain counts of a text; zeros for null."""
    full = F.coalesce(text, F.lit(""))
    glued = F.regexp_replace(full, GAP, "")
    lines = F.filter(F.split(full, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    by_lines = let(
        lines,
        lambda l: F.struct(
            F.size(l).cast("bigint").alias("n_lines"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    return F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        F.length(glued).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(full, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(full, r"[^\p{Lu}]+", "")).cast("bigint").alias("n_capitals"),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """Documents with their counts, ``base_failed`` and the vector in integers (x0 to x4)."""
    out = docs.withColumn("_q", counts_of(F.col("text")))
    q = F.col("_q")
    for name in ("n_words", "n_repeat_words"):
        out = out.withColumn(name, q["w"][name])
    for name in ("n_lines", "n_dup_lines"):
        out = out.withColumn(name, q["l"][name])
    for name in ("word_chars", "n_symbols", "n_capitals"):
        out = out.withColumn(name, q[name])
    words, chars = F.col("n_words") + MORE_WORDS, F.col("word_chars") + MORE_CHARS
    vector = (
        F.log(chars / words),
        F.log(F.lit(1.0) + F.lit(100.0) * F.col("n_symbols") / words),
        F.col("n_dup_lines") / (F.col("n_lines") + MORE_LINES),
        F.col("n_repeat_words") / words,
        F.sqrt((F.col("n_capitals") + F.lit(MORE_CAPITALS)) / chars),
    )
    out = out.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )
    for k, value in enumerate(vector):
        out = out.withColumn(f"x{k}", F.round(value * SCALE).cast("bigint"))
    return out.drop("_q")


def _marked(value: Column) -> Column:
    """A key text that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def with_groups(frame: DataFrame) -> DataFrame:
    """Keys of a row's group (language and source) and of its language."""
    lang, source = _marked(F.col("lang")), _marked(F.col("source"))
    return frame.withColumns({"group": F.concat(F.length(lang), F.lit(":"), lang, source), "wider": lang})


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


_MEANS = [f"m{i}" for i in range(DIMENSIONS)]
_FACTORS = [f"c{i}{j}" for i, j in _pairs()]
_SUMS = ["n", *[f"s{i}" for i in range(DIMENSIONS)], *[f"p{i}{j}" for i, j in _pairs()]]


def _moments() -> list[Column]:
    """Number, sums and sums of products of rows; exact in 64 bits for some 10**10 rows a group."""
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMENSIONS)]
    return sums + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _pairs()]


def estimates(sums: DataFrame, priors: DataFrame, consistency: float, prior: float = PRIOR) -> DataFrame:
    """Sums per group (and start) with mean ``m``, Cholesky factor ``c`` and ``size`` of the covariance.

    ``size`` is the logarithm of the determinant. The prior's rows (means ``o``, spreads ``r``)
    count as ``prior`` documents of its own mean and of its variances.
    """
    weight, own = f"{prior!r}D", [c for c in sums.columns if c not in _SUMS]
    # One projection a level, of texts: long chains of columns are slow to plan.
    out = sums.join(priors, "group")
    out = out.selectExpr(
        *own, "n", *[f"o{i}" for i in range(DIMENSIONS)], *[f"r{i}" for i in range(DIMENSIONS)],
        *[f"s{i} / n / {SCALE}D AS a{i}" for i in range(DIMENSIONS)],
        *[f"p{i}{j} / n / {SCALE * SCALE}D AS b{i}{j}" for i, j in _pairs()],
        f"n / (n + {weight}) AS share",
    )
    variances = []
    for i, j in _pairs():
        value = f"share * {consistency!r}D * (b{i}{j} - a{i} * a{j}) + share * (1D - share) * (a{i} - o{i}) * (a{j} - o{j})"
        variances.append(value + (f" + (1D - share) * r{i} * r{i}" if i == j else "") + f" AS v{i}{j}")
    means = [f"share * a{i} + (1D - share) * o{i} AS m{i}" for i in range(DIMENSIONS)]
    out = out.selectExpr(*own, *means, *variances)
    floors = list(FLOORS.values())
    for j in range(DIMENSIONS):  # column by column: c_ij needs the columns before and c_jj
        for rows in ([j], range(j + 1, DIMENSIONS)):
            factors = []
            for i in rows:
                rest = f"v{i}{j}" + "".join(f" - c{i}{k} * c{j}{k}" for k in range(j))
                value = f"sqrt(greatest({rest}, {floors[i] ** 2!r}D))" if i == j else f"({rest}) / c{j}{j}"
                factors.append(f"{value} AS c{i}{j}")
            if factors:
                out = out.selectExpr("*", *factors)
    size = " + ".join(f"2D * ln(c{i}{i})" for i in range(DIMENSIONS))
    return out.selectExpr(*own, *_MEANS, *_FACTORS, f"{size} AS size")


def with_distance(rows: DataFrame, parameters: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their squared Mahalanobis distance ``d2`` from their group's estimates."""
    out = rows.join(parameters, "group", how)
    for i in range(DIMENSIONS):  # forward substitution
        solved = "".join(f" - c{i}{k} * z{k}" for k in range(i))
        out = out.selectExpr("*", f"(x{i} / {SCALE}D - m{i}{solved}) / c{i}{i} AS z{i}")
    squares = " + ".join(f"z{i} * z{i}" for i in range(DIMENSIONS))
    own = [c for c in out.columns if c not in {*_MEANS, *_FACTORS} and not c.startswith("z")]
    return out.selectExpr(*[f"`{c}`" for c in own], f"{squares} AS d2")


def concentrated(used: DataFrame, parameters: DataFrame, share: float = HALF) -> DataFrame:
    """Per group and start, the sums of the rows in the distance buckets that hold the nearest ``share``."""
    near = with_distance(used, parameters.select("group", "start", *_MEANS, *_FACTORS))
    bucket = F.floor(F.log(F.lit(1.0) + F.col("d2")) * FINE).alias("bucket")
    sums = near.groupBy("group", "start", bucket).agg(*_moments())
    whole = Window.partitionBy("group", "start")
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(whole))
    wanted = sums.where(F.col("before") < F.col("all") * F.lit(share))
    return wanted.groupBy("group", "start").agg(*[F.sum(name).alias(name) for name in _SUMS])


def _quartiles(counts: DataFrame, level: str) -> DataFrame:
    """Per value of a level: median ``o`` and spread ``r`` of every statistic.

    The spread is the distance of the quartiles, in standard deviations of a normal sample,
    but at least the floor.
    """
    here = counts.groupBy(level, "dimension", "bucket").agg(F.sum("here").alias("here"))
    whole = Window.partitionBy(level, "dimension")
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = here.withColumn("upto", F.sum("here").over(running)).withColumn("all", F.sum("here").over(whole))
    shares = {"low": 0.25, "middle": 0.5, "high": 0.75}
    places = here.groupBy(level, "dimension").agg(
        *[F.min(F.when(F.col("upto") >= F.col("all") * F.lit(share), F.col("bucket"))).alias(name) for name, share in shares.items()]
    )
    unit = WIDTH / SCALE
    columns = []
    for i, floor in enumerate(FLOORS.values()):
        mine = F.col("dimension") == i
        spread = F.greatest((F.col("high") - F.col("low")) * F.lit(unit / 1.349), F.lit(floor))
        columns.append(F.max(F.when(mine, (F.col("middle") + F.lit(0.5)) * F.lit(unit))).alias(f"o{i}"))
        columns.append(F.max(F.when(mine, spread)).alias(f"r{i}"))
    return places.groupBy(level).agg(*columns)


def _plain(quartiles: DataFrame, start: int) -> DataFrame:
    """A start from medians and spreads, without covariances."""
    means = [F.col(f"o{i}").alias(f"m{i}") for i in range(DIMENSIONS)]
    factors = [(F.col(f"r{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _pairs()]
    return quartiles.select("group", F.lit(start).alias("start"), *means, *factors)


def fit(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Parameters per group from rows with ``group, wider, base_failed, x0`` to ``x4``.

    Groups in which every document fails the plain limits have none. The steps end by
    themselves: each one that counts lowers a determinant by a fixed factor, and the floors
    bound it.
    """
    used = vectors.where(~F.col("base_failed")).select(*_GROUPS, *_VECTOR)
    each = F.array(*[F.struct(F.lit(i).alias("dimension"), F.floor(F.col(f"x{i}") / WIDTH).alias("bucket")) for i in range(DIMENSIONS)])
    counts = used.select(*_GROUPS, F.explode(each).alias("x")).groupBy(*_GROUPS, "x.dimension", "x.bucket")
    counts = stored(spark, counts.agg(F.count(F.lit(1)).alias("here")), "quality-counts")
    of_language = counts.select(*_GROUPS).distinct().join(_quartiles(counts, "wider"), "wider").drop("wider")
    priors = stored(spark, of_language, "quality-priors")
    everything = used.groupBy("group").agg(*_moments()).withColumn("start", F.lit(0))
    starts = estimates(everything, priors, 1.0).drop("size")
    starts = starts.unionByName(_plain(_quartiles(counts, "group"), 1)).unionByName(_plain(priors, 2))
    # A start itself is no estimate of a nearest part, so its determinant doesn't count.
    state = starts.withColumns({"size": F.lit(float("inf")), "moving": F.lit(True)})
    state = stored(spark, state, "quality-state")
    rows = used.drop("wider")
    while not state.where("moving").isEmpty():
        step = estimates(concentrated(rows, state.where("moving")), priors, CONSISTENCY)
        # Where the determinant falls no more, the row before stays, and rests.
        both = state.withColumn("new", F.lit(0)).unionByName(step.withColumns({"moving": F.lit(True), "new": F.lit(1)}))
        now = F.max(F.when(F.col("new") == 1, F.col("size")))
        falls = F.coalesce(now < F.max(F.when(F.col("new") == 0, F.col("size"))) - F.lit(FALLS), F.lit(False))
        chosen = F.struct(*_MEANS, *_FACTORS, "size")
        kept = both.groupBy("group", "start").agg(
            falls.alias("moving"), F.max(F.when(F.col("new") == 0, chosen)).alias("old"), F.max(F.when(F.col("new") == 1, chosen)).alias("now")
        )
        state = kept.withColumn("p", F.when(F.col("moving"), F.col("now")).otherwise(F.col("old")))
        state = stored(spark, state.select("group", "start", "p.*", "moving"), "quality-state")
    best = F.min_by(F.struct(*_MEANS, *_FACTORS), F.struct("size", "start")).alias("best")
    return stored(spark, state.groupBy("group").agg(best).select("group", "best.*"), "quality-best")


_VECTOR = [f"x{i}" for i in range(DIMENSIONS)]
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(rows: DataFrame, parameters: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Rows with ``distance`` (squared) and ``kept``."""
    out = with_distance(rows, parameters, "left")
    far = F.coalesce(F.col("d2") > cutoff, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).withColumnRenamed("d2", "distance")


def quality_verdicts(spark: SparkSession, docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``distance``, ``kept``.

    A null text counts as empty: no words, so it fails the plain limits. ``distance``, to six
    digits, is null where no document of the group passes these. Null languages and sources are
    values of their own. Equal rows get equal verdicts. No rows give no rows; a text of any length
    is read as a whole; other input columns are ignored.
    """
    slim = docs.select("doc_id", "lang", "source", "text")
    rows = with_groups(with_statistics(slim)).select("doc_id", *_GROUPS, *_COUNTS, "base_failed", *_VECTOR)
    rows = stored(spark, rows, "quality-rows")
    out = judged(rows, fit(spark, rows), cutoff)
    return out.select("doc_id", *_COUNTS, "base_failed", "kept", F.round("distance", 6).alias("distance"))


def quality_filter(spark: SparkSession, docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that pass, with their own columns; cases as in :func:`quality_verdicts`.

    The vectors are written next to the documents, once, and not joined by id: ids may repeat.
    A filter on computed counts would be pushed below them and compute them several times.
    """
    own = docs.columns
    packed = docs.select(F.struct(*own).alias("_doc"), "text", "lang", "source")
    rows = with_groups(with_statistics(packed)).select("_doc", *_GROUPS, "base_failed", *_VECTOR)
    rows = stored(spark, rows, "quality-documents")
    return judged(rows, fit(spark, rows), cutoff).where("kept").select("_doc.*")

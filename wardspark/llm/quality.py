"""Quality rules by robust multivariate outliers (operator 4), in DataFrame functions only.

Each text gives a vector of transformed statistics.  For every (language, source) a regularised
minimum-covariance-determinant estimate is fitted: of the sets with ``SHARE`` of the rows, one whose
covariance (plus the ``FLOORS``) has the smallest determinant.  Three deterministic starts (scaled
deviations, and correlations of signs and of bent values) take concentration steps, each of which keeps the rows
nearest by the estimate and estimates again, until no determinant falls any more; the smallest one of a group counts.
A text is rejected if its Mahalanobis distance from its group's estimate is beyond ``CUTOFF``.

Nothing but sums and counts of bins by (language, source) is ever shuffled: "the nearest share" is a
threshold on the distance, read from a histogram with fine logarithmic bins.  Groups with fewer than ``least_rows``
rows use the estimate of their language, or else the one of all rows; those add up the bins and sums of
their groups, so no row is read twice and no task sees the rows of a level.  Estimates are shipped to the rows
where their number is bounded, and joined with salted keys beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARE = 0.75
#: Concentration steps at most, and the fall of a log determinant that is still worth one.
STEPS, LEAST_FALL = 10, 0.01
STARTS = ("deviations", "signs", "bent")
LEAST_ROWS = 200
#: Squared distance beyond which a text is rejected: far outside what 6 normal variables reach (one in 10**19), since statistics
#: of texts have heavier tails.  Set on the quality labels of a small table: of texts that pass the base rules it rejects all
#: with label 0 and 3 in 1,000 with label 1; at 40 it would be 30 in 1,000, at 200 it would keep 15 in 100 of the bad ones.
CUTOFF = 100.0
#: Median of the chi-squared distribution with 6 degrees of freedom; makes distances comparable.
CHI2_MEDIAN = 5.348120627

#: Least standard deviation of each statistic.  Most texts have no symbols or repeats at all, and without
#: a floor one of them would be infinitely far away.  Length is there for what depends on it, and judged mildly.
FLOORS = {"x_length": 1.0, "x_word_length": 0.05, "x_symbols": 0.35, "x_dup_lines": 0.35, "x_repeats": 0.35, "x_variety": 0.02}
NAMES = tuple(FLOORS)
P = len(NAMES)
#: Places of a lower triangle in the order they are stored.
PAIRS = tuple((i, j) for i in range(P) for j in range(i + 1))
ANY = "*"
BINS = 64
FINE = 256
#: Groups whose estimates are shipped whole (2 kB each at most); salts of the join beyond that.
MOST_SHIPPED, SALTS = 5_000, 32
KEY = ["level", "g_lang", "g_source"]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas look at it."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, by hashes of the windows.

    Most texts repeat none, which a sort of plain numbers shows; only the others are sorted with places.
    """
    zero = F.lit(0).cast("long")
    n = F.size(words)

    def windows(grams: Column) -> Column:
        ordered = F.sort_array(grams)
        any_twice = bound(ordered, lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: s[i] == s[i - 1]))
        return F.when((F.size(grams) > 1) & F.when(F.size(grams) > 1, any_twice), covered(grams)).otherwise(zero)

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            last = F.size(p) - 1
            hit = F.filter(
                F.sequence(F.lit(0), last),
                lambda j: ((j > 0) & (p[F.greatest(j - 1, F.lit(0))]["h"] == p[j]["h"]))
                | ((j < last) & (p[F.least(j + 1, last)]["h"] == p[j]["h"])),
            )
            return F.sort_array(F.transform(hit, lambda j: p[j]["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(0), F.size(at) - 1),
                zero,
                lambda sum_, j: sum_ + F.when(j == 0, 3).otherwise(F.least(F.lit(3), at[j] - at[F.greatest(j - 1, F.lit(0))])),
            )

        return bound(bound(placed, twice), total)

    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(n >= 3, bound(grams, windows)).otherwise(zero)


def statistics(text: Column) -> Column:
    """A struct of the base counts and the transformed statistics of a text (null: empty).

    With no words the statistics are those of an empty text: zero length, no symbols, no repeats.
    """
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return bound(words, of_words)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc`` (the row as it was), ``lang``, ``source``, base counts, ``base_failed`` and the vector."""
    # exploding an array of one keeps a later filter above, which would count everything a second time
    counted = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.explode(F.array(statistics(F.col("text")))).alias("s"),
    ).select("doc", "lang", "source", "s.*")
    n = F.greatest(F.col("n_words"), F.lit(1))
    # log shares, drawn towards a common value by a few virtual words, lines or characters: in a short text
    # one repeated sentence is no sign of bad quality
    share = lambda part, whole, some, of: F.log((part + some) / (whole + of))
    return counted.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "x_length": F.log1p(F.col("n_words")),
        "x_word_length": F.log1p(F.col("word_chars") / n),
        "x_symbols": share(F.col("n_symbols"), F.col("word_chars"), 10, 1000),
        "x_dup_lines": share(F.col("n_dup_lines"), F.col("n_lines"), 2, 20),
        "x_repeats": share(F.col("n_repeat_words"), F.col("n_words"), 10, 200),
        "x_variety": F.log1p(F.col("n_distinct_words")) / F.log1p(n),
    })


def cut_point(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """``keys, bin``: the first bin at which ``share`` of a key's ``n`` is reached.  One row per bin is windowed."""
    upto = Window.partitionBy(*keys).orderBy("bin")
    total = F.sum("n").over(Window.partitionBy(*keys))
    reached = counts.withColumns({"at": F.sum("n").over(upto), "all": total}).where(F.col("at") >= share * F.col("all"))
    return reached.groupBy(*keys).agg(F.min("bin").alias("bin"))


def log_bin(value: Column) -> Column:
    return F.floor(F.log2(value + 1e-9) * BINS)


def group_key() -> list[Column]:
    """The group of each level that a (language, source) belongs to."""
    level = F.col("level")
    return [level, F.when(level < 2, F.col("lang")).otherwise(ANY).alias("g_lang"), F.when(level < 1, F.col("source")).otherwise(ANY).alias("g_source")]


def few(groups: DataFrame) -> bool:
    """Whether what there is for each group may be shipped."""
    return groups.select("lang", "source").distinct().limit(MOST_SHIPPED + 1).count() <= MOST_SHIPPED


def matched(rows: DataFrame, table: DataFrame, shipped: bool) -> DataFrame:
    """Rows with the one row of ``table`` of their language and source."""
    keys = ["lang", "source"]
    if shipped:
        return rows.join(F.broadcast(table), keys)
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(copies, [*keys, "salt"]).drop("salt")


def differences() -> list[Column]:
    return [F.col(n) - F.col("e.m")[i] for i, n in enumerate(NAMES)]


def distance() -> Column:
    """Squared Mahalanobis distance by the estimate ``e``: centre ``m`` and the inverse ``w`` of the Cholesky factor."""
    d = differences()
    out = F.lit(0.0)
    for i in range(P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col("e.w")[PAIRS.index((i, j))] * d[j]
        out = out + y * y
    return out


def factored(table: DataFrame) -> DataFrame:
    """``w`` (inverse of the Cholesky factor) and ``logdet`` from covariances ``c00, c10, c11..``, to which the floors are added.

    Both triangles are filled in row by row, as loops over arrays: written out, the plan of each step would take seconds.
    """
    rows, columns = (F.array(*[F.lit(p[k]) for p in PAIRS]) for k in (0, 1))
    start = lambda i: (i * (i + 1) / 2).cast("int")
    none = F.array().cast("array<double>")

    def filled(entry) -> Column:
        def add(done: Column, at: Column) -> Column:
            return F.array_append(done, entry(done, at, F.get(rows, at), F.get(columns, at)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(PAIRS) - 1)), none, add)

    def total(first: Column, last: Column, term) -> Column:
        places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.lit(0.0), lambda sum_, k: sum_ + term(k))

    def factor(done: Column, at: Column, i: Column, j: Column) -> Column:
        rest = F.get(F.col("c"), at) - total(F.lit(0), j - 1, lambda k: F.get(done, start(i) + k) * F.get(done, start(j) + k))
        return F.when(i == j, F.sqrt(F.greatest(rest, F.lit(1e-12)))).otherwise(rest / F.get(done, start(j) + j))

    def inverse(done: Column, at: Column, i: Column, j: Column) -> Column:
        rest = total(j, i - 1, lambda k: F.get(F.col("l"), start(i) + k) * F.get(done, start(k) + j))
        return F.when(i == j, 1 / F.get(F.col("l"), at)).otherwise(-rest / F.get(F.col("l"), start(i) + i))

    covariances = F.array(*[F.col(f"c{i}{j}") + F.lit(FLOORS[NAMES[i]] ** 2 if i == j else 0.0) for i, j in PAIRS])
    made = table.withColumn("c", covariances).drop(*[f"c{i}{j}" for i, j in PAIRS])
    made = made.withColumn("l", filled(factor))
    logdet = F.lit(0.0)
    for at, (i, j) in enumerate(PAIRS):
        logdet = logdet + 2 * F.log(F.col("l")[at]) if i == j else logdet
    return made.withColumns({"w": filled(inverse), "logdet": logdet}).drop("c", "l")


def products(values: list[Column], name: str) -> list[Column]:
    return [F.sum(values[i] * values[j]).alias(f"{name}{i}{j}") for i, j in PAIRS]


def members_of(stats: DataFrame, least_rows: int) -> DataFrame:
    """``lang, source, level`` and the ``uses`` of each group: which levels' fits its rows take part in, and whose it is judged by."""
    groups = written(stats.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n")), "mcd-groups", small=True)
    by_lang = groups.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.min("n").alias("least"))
    fewest = by_lang.agg(F.min("of_lang")).first()[0] or 0  # one number
    every = groups.join(by_lang, "lang")
    levels = F.array_compact(F.array(
        F.when(F.col("n") >= least_rows, F.lit(0)), F.when(F.col("least") < least_rows, F.lit(1)), F.when(F.lit(fewest < least_rows), F.lit(2))))
    uses = F.when(F.col("n") >= least_rows, 0).when(F.col("of_lang") >= least_rows, 1).otherwise(2)
    return written(every.select("lang", "source", "n", uses.alias("uses"), F.explode(levels).alias("level")), "mcd-members", small=True)


def packed(members: DataFrame, estimates: DataFrame) -> DataFrame:
    """For each (language, source) the estimates its rows are measured by (at most three levels with three starts)."""
    values = [c for c in estimates.columns if c not in KEY]
    of = members.select("lang", "source", *group_key()).join(estimates, KEY)
    return of.groupBy("lang", "source").agg(F.collect_list(F.struct("level", *values)).alias("es"))


def measured(good: DataFrame, members: DataFrame, estimates: DataFrame, shipped: bool) -> DataFrame:
    """Each row as often as there are estimates ``e`` it is measured by."""
    return matched(good, packed(members, estimates), shipped).select("lang", "source", *NAMES, F.explode("es").alias("e"))


def rolled(sums: DataFrame, *more: str) -> DataFrame:
    """Sums by (language, source) added up to the groups of their level."""
    values = [c for c in sums.columns if c not in ("lang", "source", "level", *more)]
    return sums.select(*group_key(), *more, *values).groupBy(*KEY, *more).agg(*[F.sum(v).alias(v) for v in values])


def first_estimates(good: DataFrame, members: DataFrame, shipped: bool) -> DataFrame:
    """Medians with three covariances: scaled deviations, and correlations of the directions and of bent values."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(n) * FINE).alias("bin")) for i, n in enumerate(NAMES)])).alias("v")
    bins = written(good.select("lang", "source", each).groupBy("lang", "source", "v.i", "v.bin").agg(F.count("*").alias("n")), "mcd-bins", small=True)
    of_level = rolled(bins.join(members.select("lang", "source", "level"), ["lang", "source"]), "i", "bin")
    of_level = written(of_level, "mcd-level-bins", small=True)
    middle = cut_point(of_level, [*KEY, "i"], 0.5).withColumnRenamed("bin", "mid")
    apart = of_level.join(middle, [*KEY, "i"]).groupBy(*KEY, "i", F.abs(F.col("bin") - F.col("mid")).alias("bin")).agg(F.sum("n").alias("n"))
    both = middle.join(cut_point(apart, [*KEY, "i"], 0.5), [*KEY, "i"])
    centre = both.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("i", ((F.col("mid") + 0.5) / FINE).alias("m"), (1.4826 * (F.col("bin") + 0.5) / FINE).alias("s")))).alias("v"))
    floors = F.array(*[F.lit(f) for f in FLOORS.values()])
    wide = F.zip_with(F.transform("v", lambda v: v["s"]), floors, lambda s, f: F.sqrt(s * s + f * f))
    centre = written(centre.select(*KEY, F.transform("v", lambda v: v["m"]).alias("m"), wide.alias("s")), "mcd-centre", small=True)

    rows = measured(good, members, centre, shipped)
    z = [d / F.col("e.s")[i] for i, d in enumerate(differences())]
    length = F.lit(0.0)
    for v in z:
        length = length + v * v
    long = F.greatest(F.sqrt(length), F.lit(1e-12))
    sums = rows.groupBy("lang", "source", F.col("e.level").alias("level")).agg(*products([v / long for v in z], "u"), *products([F.tanh(v) for v in z], "t"))
    sums = written(rolled(sums).join(centre, KEY), "mcd-sums", small=True)

    def start(n: int, name: str | None) -> DataFrame:
        def correlation(i: int, j: int) -> Column:
            if name is None or i == j:
                return F.lit(1.0 if i == j else 0.0)
            return F.col(f"{name}{i}{j}") / F.greatest(F.sqrt(F.col(f"{name}{i}{i}") * F.col(f"{name}{j}{j}")), F.lit(1e-12))

        covariances = {f"c{i}{j}": correlation(i, j) * F.col("s")[i] * F.col("s")[j] for i, j in PAIRS}
        return sums.withColumns(covariances).select(*KEY, F.lit(n).alias("start"), "m", *covariances)

    starts = start(0, None).unionByName(start(1, "u")).unionByName(start(2, "t"))
    # the floors are in the deviations already; a little more of them does no harm to a start
    return factored(starts).withColumn("logdet", F.lit(float("inf")))


def concentrated(good: DataFrame, members: DataFrame, state: DataFrame, shipped: bool, step: int) -> DataFrame:
    """``state`` after one step, where that lowers the determinant; ``fall`` is by how much."""
    keys = [*KEY, "start"]
    counts = measured(good, members, state, shipped).groupBy("lang", "source", F.col("e.level").alias("level"), F.col("e.start").alias("start"), log_bin(distance()).alias("bin"))
    limits = cut_point(rolled(counts.agg(F.count("*").alias("n")), "start", "bin"), keys, SHARE).withColumnRenamed("bin", "limit")
    limited = written(state.join(limits, keys), f"mcd-limits-{step}", small=True)
    near = measured(good, members, limited, shipped).where(log_bin(distance()) <= F.col("e.limit"))
    d = differences()
    sums = near.groupBy("lang", "source", F.col("e.level").alias("level"), F.col("e.start").alias("start")).agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(d)], *products(d, "q"))
    both = rolled(sums, "start").join(state, keys)
    moved = F.array(*[F.col("m")[i] + F.col(f"s{i}") / F.col("n") for i in range(P)])
    covariances = {f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n") for i, j in PAIRS}
    old = F.struct(F.col("logdet"), F.col("m"), F.col("w")).alias("old")
    new = factored(both.select(*keys, old, moved.alias("m"), *[c.alias(n) for n, c in covariances.items()]))
    better = F.col("logdet") < F.col("old.logdet")
    chosen = F.when(better, F.struct("logdet", "m", "w")).otherwise(F.col("old"))
    return new.select(*keys, chosen.alias("now"), (F.col("old.logdet") - F.col("logdet")).alias("fall")).select(*keys, "now.*", "fall")


def fit(stats: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``lang, source, e`` (level, centre, factor and scale of the estimate the group is judged by) for every group of ``stats``.

    ``stats`` is a written table with the vector; rows that fail the base rules are left out of the fit.
    Where no row passes them there is no estimate.
    """
    good = stats.where(~F.col("base_failed")).select("lang", "source", *NAMES)
    members = members_of(stats, least_rows)
    shipped = few(members)
    state = written(first_estimates(good, members, shipped), "mcd-starts", small=True)
    for step in range(STEPS):
        after = written(concentrated(good, members, state, shipped, step), f"mcd-{step}", small=True)
        state = after.drop("fall")
        if step and (after.agg(F.max("fall")).first()[0] or 0.0) < LEAST_FALL:
            break
    best = state.groupBy(*KEY).agg(F.min(F.struct("logdet", "start", "m", "w")).alias("b")).select(*KEY, "b.logdet", "b.start", "b.m", "b.w")
    best = written(best, "mcd-best", small=True)
    counts = measured(good, members, best, shipped).groupBy("lang", "source", F.col("e.level").alias("level"), log_bin(distance()).alias("bin"))
    middle = cut_point(rolled(counts.agg(F.count("*").alias("n")), "bin"), KEY, 0.5)
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS), F.lit(1e-9)) / CHI2_MEDIAN
    scaled = written(best.join(middle, KEY).withColumn("scale", scale).drop("bin"), "mcd-scaled", small=True)
    used = members.select("lang", "source", F.col("uses").alias("level")).distinct().select("lang", "source", *group_key())
    return written(used.join(scaled, KEY, "left").select("lang", "source", F.when(F.col("m").isNotNull(), F.struct("level", "logdet", "start", "m", "w", "scale")).alias("e")), "mcd-fit", small=True)


def judge(stats: DataFrame, fitted: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Add ``distance`` (null without any estimate) and ``kept``."""
    out = matched(stats, fitted, few(fitted)).withColumn("distance", distance() / F.col("e.scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.withColumn("kept", kept).select(*stats.columns, "distance", "kept")


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``distance`` and ``kept`` for every row of ``docs``.

    Null texts are empty, null languages and sources form a group of their own, repeated rows count as
    often as they stand there, an empty table gives an empty result, other columns are not read.
    """
    stats = with_statistics(docs.select("doc_id", "text", "lang", "source"))
    stats = written(stats.select(F.col("doc.doc_id").alias("doc_id"), *[c for c in stats.columns if c != "doc"]), "quality")
    return judge(stats, fit(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; ``lang`` and ``source`` are needed besides ``text``.

    Null and empty texts have no words and go; null languages and sources form a group of their own; repeated rows stay
    or go together; an empty table stays empty.  The counts are made twice, for the fit and for the verdict: that costs less than a shuffle of all texts.
    """
    full = with_statistics(docs)
    stats = written(full.select("lang", "source", "base_failed", *NAMES), "quality")
    return judge(full, fit(stats)).where("kept").select("doc.*")

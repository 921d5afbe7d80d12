"""Quality rules: plain limits first, then robust multivariate outliers per language and source.

Four statistics of a document are turned into whole numbers (thousandths, so that every sum over documents is exact and
the same however rows are dealt). Per language and source a minimum-covariance-determinant estimate is found by
concentration: from each of eleven starts (medians and median deviations, also with one statistic stressed or nearly ignored;
plain means and covariances; medians and least spreads) the closest three quarters of the group give means and covariances,
distances to those give the next subset, and so on for a fixed number of steps; the start whose subset ends with the least
determinant is taken. That is a minimum among its neighbours, not always the least of all subsets. A document is rejected where its squared Mahalanobis distance passes the limit (by default the 0.9999 quantile of its law for normal data). Spreads
have a floor, since a statistic that is the same for most of a group would otherwise reject whatever differs from it.

Every document that passes the plain limits is judged, and every language and source has an estimate of its own, whatever its
size. Means and covariances of small groups are regularised: those of a group of n documents have the weight n / (n + PRIOR),
the rest comes from its language over all sources, which leans on all documents in the same way. So the estimate moves from
that of the language to the group's own as the group grows, without a step. The two levels above a group start from the first,
the plain and the least spreads only.

Groups are never gathered: quantiles come from counts per value, whose number is bounded (distances are binned to 1/256 of a
binary logarithm, so the subset may hold a few documents more than three quarters, never fewer), and everything else is sums.

Nulls: a null text has no words, and fails; null languages and sources form groups of their own. Equal rows get equal
verdicts, equal distances enter the subset together. Very long texts are one row like any other; their statistics take time
in proportion to length (times its logarithm). An empty table gives an empty table. The query reads only the columns that it
needs; `keep_good` returns whole rows, whatever their other columns are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_RUN, SPACES, Scratch, let, unpack, words, written

SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
Z = ["z1", "z2", "z3", "z4"]
#: Least spread of each statistic, in thousandths.
FLOORS = [60, 250, 120, 120]
#: The share of a group that is taken as its core, and what makes the core's variance that of a normal sample in four dimensions.
CORE, CONSISTENT = 0.75, 1.49
#: The number of documents whose weight the level above has in the estimate of a group.
PRIOR = 20.0
#: An estimate is for a level (language and source, language, all), its names there, and a start.
GROUP = ["level", "a", "b"]


def repeated_words(terms: Column) -> Column:
    """How many words lie in a window of five words that occurs twice or more in the text (windows are told apart by 64-bit hashes)."""
    hashes = F.transform(terms, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(WINDOW)])))

    def covered(win: Column) -> Column:
        """Windows sorted by hash; those beside an equal one, back in order of place; each covers up to the next one."""
        ordered = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.filter(
                F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        return let(F.array_sort(twice), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    return F.when(F.size(terms) < WINDOW + 1, F.lit(0)).otherwise(
        let(windows, lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(covered(win)))
    )


def statistics(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """The base statistics, base_failed, the whole-numbered vector and the group of every row, beside what carry names."""
    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(
        *[c.alias(n) for n, c in (carry or {}).items()],
        *[c.alias(n) for c, n in zip(_group(F.col(lang), F.col(source)), ("g_lang", "g_source"))],
        body.alias("body"),
        words(body).alias("terms"),
    )
    full = F.filter(F.split("body", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counted = read.select(
        *(carry or {}),
        "g_lang",
        "g_source",
        F.size("terms").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("body", SPACE_RUN, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("body", SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(full, lambda x: F.struct(F.size(x).alias("full"), F.size(F.array_distinct(x)).alias("own"))).alias("ln"),
        repeated_words(F.col("terms")).cast("long").alias("n_repeat_words"),
    )
    base = counted.select(
        *(carry or {}),
        "g_lang",
        "g_source",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("ln.full") - F.col("ln.own")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.col("ln.full").cast("long").alias("n_full_lines"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )
    # A few words of an average text are added, so that short texts don't stand out by chance.
    whole = lambda x: F.round(1000 * x).cast("long")
    return base.select(
        "*",
        whole(F.log((F.col("word_chars") + 100) / (F.col("n_words") + 20))).alias("z1"),
        whole(F.log(1 + 10 * F.col("n_symbols") / (F.col("n_words") + 20))).alias("z2"),
        whole(F.col("n_dup_lines") / (F.col("n_full_lines") + 5)).alias("z3"),
        whole(F.col("n_repeat_words") / (F.col("n_words") + 20)).alias("z4"),
    )


def _group(lang: Column, source: Column) -> list[Column]:
    """Language and source as names that tell null from any text."""
    return [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in (lang, source)]


def _model() -> tuple[list[Column], list[list[Column]]]:
    return [F.col(f"m_{z}") for z in Z], [[F.col(f"l_{i}{j}") for j in range(i + 1)] for i in range(4)]


def _distance(center: list[Column], root: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the lower triangular root of the covariance."""
    solved: list[Column] = []
    for i, z in enumerate(Z):
        rest = F.col(z) - center[i]
        for j in range(i):
            rest = rest - root[i][j] * solved[j]
        solved.append(rest / root[i][i])
    return sum((x * x for x in solved[1:]), solved[0] * solved[0])


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and exact sums of vectors and their products."""
    exact = lambda x: F.sum(x.cast("decimal(28,0)")).cast("double")
    return rows.groupBy(*by).agg(
        F.sum("n").alias("n"), *[exact(F.col(z) * F.col("n")).alias(f"s_{z}") for z in Z], *[exact(F.col(Z[i]) * F.col(Z[j]) * F.col("n")).alias(f"q_{i}{j}") for i in range(4) for j in range(i + 1)]
    )


def _root(moments: DataFrame, by: list[str], scale: float = CONSISTENT) -> DataFrame:
    """Means, the lower triangular root of the floored covariance, and the logarithm of its determinant."""
    n = F.col("n").cast("double")
    out = moments.select(*by, *[(F.col(f"s_{z}") / n).alias(f"m_{z}") for z in Z], *[((F.col(f"q_{i}{j}") / n - F.col(f"s_{Z[i]}") / n * (F.col(f"s_{Z[j]}") / n)) * scale + (FLOORS[i] ** 2 if i == j else 0)).alias(f"c_{i}{j}") for i in range(4) for j in range(i + 1)])
    return _triangle(out, by)


def _triangle(out: DataFrame, by: list[str]) -> DataFrame:
    """Means m_, the lower triangular root l_ of covariances c_, and the logarithm of their determinant."""
    for j in range(4):
        pivot = F.col(f"c_{j}{j}")
        for k in range(j):
            pivot = pivot - F.col(f"l_{j}{k}") * F.col(f"l_{j}{k}")
        out = out.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(pivot, F.lit(1.0))))
        for i in range(j + 1, 4):
            entry = F.col(f"c_{i}{j}")
            for k in range(j):
                entry = entry - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            out = out.withColumn(f"l_{i}{j}", entry / F.col(f"l_{j}{j}"))
    return out.select(*by, *[f"m_{z}" for z in Z], *[f"l_{i}{j}" for i in range(4) for j in range(i + 1)], sum((2 * F.log(f"l_{i}{i}") for i in range(1, 4)), 2 * F.log("l_00")).alias("log_det"))


def _quantiles(counts: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The least value of each group that `share` of its n don't pass, from counts per value."""
    own = Window.partitionBy(*by)
    upto = own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(own)})
    return placed.filter(F.col("upto") >= share * F.col("all")).groupBy(*by).agg(F.min(value).alias(value))


def _middles(cells: DataFrame, value) -> DataFrame:
    """The median of value(z) for every statistic, as columns d_z."""
    long = cells.select(*GROUP, "n", F.explode(F.array(*[F.struct(F.lit(z).alias("z"), value(z).cast("long").alias("x")) for z in Z])).alias("v")).select(*GROUP, "v.z", "v.x", "n")
    middle = _quantiles(long.groupBy(*GROUP, "z", "x").agg(F.sum("n").alias("n")), [*GROUP, "z"], "x", 0.5)
    return middle.groupBy(*GROUP).agg(*[F.max(F.when(F.col("z") == z, F.col("x"))).cast("double").alias(f"d_{z}") for z in Z])


def _starts(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """First guesses of center and root for every group: robust, plain, least spreads, and robust ones that stress or ignore one statistic."""
    medians = scratch.written(_middles(cells, F.col).select(*GROUP, *[F.col(f"d_{z}").alias(f"m_{z}") for z in Z]), "medians")
    away = _middles(cells.join(medians, GROUP), lambda z: F.abs(F.col(z) - F.col(f"m_{z}")))
    diagonal = lambda rows, start, spread: rows.select(*GROUP, F.lit(start).alias("start"), *[f"m_{z}" for z in Z], *[(spread(i) if i == j else F.lit(0.0)).alias(f"l_{i}{j}") for i in range(4) for j in range(i + 1)])
    plain = _root(_moments(cells, GROUP), GROUP, 1.0).drop("log_det").withColumn("start", F.lit(1))
    both = scratch.written(medians.join(away, GROUP), "spreads")
    robust = lambda start, stress: diagonal(both, start, lambda i: F.greatest(F.col(f"d_{Z[i]}") * 1.4826, F.lit(float(FLOORS[i]))) * stress.get(i, 1.0))
    guesses = [robust(0, {}), plain, diagonal(medians, 2, lambda i: F.lit(float(FLOORS[i])))]
    guesses += [robust(3 + 2 * i + k, {i: stress}).filter("level = 0") for i in range(4) for k, stress in enumerate((0.25, 4.0))]
    return reduce(DataFrame.unionByName, guesses)


def _step(cells: DataFrame, model: DataFrame, scratch: Scratch) -> DataFrame:
    """The estimates from the closest three quarters of every group, one for each start."""
    by = [*GROUP, "start"]
    # what is joined to the cells is written, so the planner knows that it is small and doesn't deal the cells by group
    ringed = cells.join(model, GROUP).select(*by, *Z, "n", F.floor(256 * F.log2(1 + _distance(*_model()))).cast("int").alias("ring"))
    cut = scratch.written(_quantiles(ringed.groupBy(*by, "ring").agg(F.sum("n").alias("n")), by, "ring", CORE).withColumnRenamed("ring", "cut"), "cut")
    return scratch.written(_root(_moments(ringed.join(cut, by).filter("ring <= cut"), by), by), "model")


def concentrated(cells: DataFrame, scratch: Scratch, tries: int, steps: int) -> DataFrame:
    """The estimate of every group (level, a, b) of cells (with vectors and their number n): `tries` steps from every start, then more from the best."""
    model = scratch.written(_starts(cells, scratch), "start")
    for _ in range(tries):
        model = _step(cells, model, scratch)
    first = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.round("log_det", 9), "start"))
    model = scratch.written(model.withColumn("nth", first).filter("nth = 1").drop("nth"), "best")
    for _ in range(steps):
        model = _step(cells, model, scratch)
    return model.drop("start")


def estimate(stats: DataFrame, tries: int = 2, steps: int = 3, prior: float = PRIOR) -> DataFrame:
    """Center and covariance root for every language and source, and `own`, the weight that its own core has in them.

    An estimate of n documents has the weight n / (n + prior), the rest comes from the level above it."""
    with Scratch(stats.sparkSession, "quality") as scratch:
        passing = scratch.written(stats.filter(~F.col("base_failed")).groupBy("g_lang", "g_source", *Z).agg(F.count("*").alias("n")), "vectors")
        names = [[F.lit(0), F.col("g_lang"), F.col("g_source")], [F.lit(1), F.col("g_lang"), F.lit("")], [F.lit(2), F.lit(""), F.lit("")]]
        named = lambda rows, *more: reduce(DataFrame.unionByName, [rows.select(*[c.alias(n) for c, n in zip(cs, GROUP)], *more) for cs in names])
        groups = scratch.written(stats.select("g_lang", "g_source").distinct(), "groups")
        cells = scratch.written(named(passing, *Z, "n").groupBy(*GROUP, *Z).agg(F.sum("n").alias("n")), "cells")
        sizes = scratch.written(cells.groupBy(*GROUP).agg(F.sum("n").alias("n")), "sizes")
        product = lambda i, j: sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(1, j + 1)), F.col(f"l_{i}0") * F.col(f"l_{j}0"))
        entries = {**{f"m_{z}": F.col(f"m_{z}") for z in Z}, **{f"c_{i}{j}": product(i, j) for i in range(4) for j in range(i + 1)}}
        found = concentrated(cells, scratch, tries, steps).join(sizes, GROUP).select(*GROUP, "n", *[c.alias(x) for x, c in entries.items()])
        above = named(groups, "g_lang", "g_source").join(scratch.written(found, "found"), GROUP)
        wide = above.groupBy("g_lang", "g_source").agg(*[F.max(F.when(F.col("level") == k, F.col(x))).alias(f"{x}_{k}") for k in range(3) for x in ("n", *entries)])
        weight = lambda k: F.coalesce(F.col(f"n_{k}") / (F.col(f"n_{k}") + prior), F.lit(0.0))
        for k in (1, 0):
            mixed = {x: weight(k) * F.col(f"{x}_{k}") + (1 - weight(k)) * F.col(f"{x}_{k + 1}") for x in entries}
            wide = wide.withColumns({f"{x}_{k}": F.when(weight(k) > 0, c).otherwise(F.col(f"{x}_{k + 1}")) for x, c in mixed.items()})
        by = ["g_lang", "g_source", "own"]
        return written(_triangle(wide.select(*by[:2], weight(0).alias("own"), *[F.col(f"{x}_0").alias(x) for x in entries]), by).drop("log_det"), "quality-model")


def judge(stats: DataFrame, limit: float = 23.51, prior: float = PRIOR) -> DataFrame:
    """stats with `distance`, the weight `own` of the group's own core, and `kept`. stats is read several times, so it should be a written table."""
    judged = stats.join(estimate(stats, prior=prior), ["g_lang", "g_source"], "left").withColumn("distance", _distance(*_model()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit))


def keep_good(docs: DataFrame, limit: float = 23.51) -> DataFrame:
    """The rows of docs that pass, with all their columns. Rejected rows are few, and are taken out by hashes of text and group."""
    packed = docs.select(F.struct("*").alias("row"))
    key = lambda seed, get: F.xxhash64(F.lit(seed), F.coalesce(get("text"), F.lit("")), *_group(get("lang"), get("source")))
    keyed = packed.withColumns({f"k{seed}": key(seed, lambda c: F.col("row")[c]) for seed in (1, 2)})
    stats = written(statistics(docs, carry={f"k{seed}": key(seed, F.col) for seed in (1, 2)}), "quality-stats")
    rejected = written(judge(stats, limit).filter(~F.col("kept")).select("k1", "k2").distinct(), "quality-rejected")
    kept = keyed.join(rejected, ["k1", "k2"], "left_anti")
    return kept.select(*unpack(kept))

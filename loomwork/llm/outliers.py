"""Quality rules and robust multivariate outliers, with DataFrame functions only.

Each text becomes a vector of transformed statistics. Per language and source the
minimum-covariance-determinant estimate is found by concentration steps: distances
from the present centre and covariance, the closest half of the rows, a new centre
and covariance from those, so that up to a third of a group may be foreign copies. Texts far from their group's final estimate by
Mahalanobis distance are rejected. All sums run over whole numbers, so they don't
depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.common import SPACE, written

BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
#: Whole-number steps in one unit of a transformed statistic.
GRID = 1024
#: The least standard deviation that counts for each transformed statistic: below it differences don't matter.
FLOORS = (1.0, 0.2, 0.1, 0.15, 0.07)
DIM = len(FLOORS)
#: The share of rows that an estimate rests on; a larger core would take in a group of copies with the rows it lacks, and such copies would hide themselves.
CORE = 0.5
STEPS = 4
#: The chance that a normal row lies beyond the cut.
TAIL = 0.01
#: Rows that a group needs for an estimate of its own; smaller ones are pooled by language, then all together.
LEAST_ROWS = 50
#: Groups up to which their estimates (some 200 bytes each) are broadcast.
BROADCAST_GROUPS = 1 << 16


def chi2_share(x: float, dim: int) -> float:
    """The chi-square distribution function, by its series."""
    if x <= 0:
        return 0.0
    term = math.exp(dim / 2 * math.log(x / 2) - x / 2 - math.lgamma(dim / 2 + 1))
    total, k = 0.0, dim / 2
    while term > 1e-18 * max(total, 1e-300):
        total += term
        k += 1
        term *= x / 2 / k
    return total


def chi2_cut(share: float, dim: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, dim) < share else (low, mid)
    return high


def base_statistics(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep``, ``n_words``, the four base counts and ``base_failed`` for each row, without a shuffle."""
    no = F.lit(False)
    out = docs.select(*keep, text.alias("__text"))
    out = out.withColumn("__words", F.filter(F.split("__text", SPACE + "+", -1), lambda w: w != ""))
    out = out.withColumn("__n", F.size("__words"))
    out = out.withColumn("__windows", F.when(F.col("__n") >= 5, F.transform(
        F.sequence(F.lit(0), F.col("__n") - 5), lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(5)]))))
    out = out.withColumn("__again", F.coalesce(F.size(F.array_distinct("__windows")) < F.size("__windows"), no))
    # only texts with a repeated window go on: windows in order, those equal to a neighbour, their places in order
    out = out.withColumn("__order", F.when(F.col("__again"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("__places", F.when(F.col("__again"), F.array_sort(F.transform(F.filter(
        "__order", lambda s, k: F.coalesce(s["h"] == F.get("__order", k + 1)["h"], no) | F.coalesce(s["h"] == F.get("__order", k - 1)["h"], no)), lambda s: s["i"]))))
    rest = F.size("__places") - 1
    steps = F.zip_with(F.slice("__places", F.lit(1), rest), F.slice("__places", F.lit(2), rest), lambda a, b: F.least(F.lit(5), b - a))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\v\f\r"))) > 0)
    plain = F.col("__text")
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    out = out.withColumn("__lines", lines).select(
        *[c for c in out.columns if not c.startswith("__")], F.col("__n").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(plain)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__again"), 5 + F.aggregate(steps, F.lit(0), lambda a, b: a + b)).otherwise(0).cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def transformed() -> list[Column]:
    """The statistics that are compared, nearly symmetric for clean texts: length, word length, symbols a word, repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p("n_words"), F.log1p(F.col("word_chars") / n), F.log1p(F.col("n_symbols") / n), F.log1p(5 * F.col("n_dup_lines") / n), F.log1p(F.col("n_repeat_words") / n)]


def _key(*cols: str) -> Column:
    """One text key of several columns; null has a place of its own."""
    return F.concat(*[F.concat(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")), F.lit("\u0001")) for c in cols])


def _with_few(rows: DataFrame, few: DataFrame, n: int, key: str, how: str = "left") -> DataFrame:
    """A join to a table of n rows, broadcast up to a bound."""
    return rows.join(F.broadcast(few) if n <= BROADCAST_GROUPS else few, key, how)


def group_names(sizes: DataFrame) -> DataFrame:
    """``pair, group``: each language and source is a group, or part of a pool where it has too few rows; null where the last pool has too few.

    sizes: lang, source, count.
    """
    pairs = sizes.select(_key("lang", "source").alias("pair"), _key("lang").alias("pool"), "count")
    small = F.col("count") < LEAST_ROWS
    pools = pairs.where(small).groupBy("pool").agg(F.sum("count").alias("pooled"))
    rest = pools.where(F.col("pooled") < LEAST_ROWS).agg(F.sum("pooled")).first()[0] or 0
    last = F.lit("all" if rest >= LEAST_ROWS else None).cast("string")
    return pairs.join(pools, "pool", "left").select("pair", F.when(~small, F.col("pair")).when(F.col("pooled") >= LEAST_ROWS, F.col("pool")).otherwise(last).alias("group"))


X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _first_estimate(rows: DataFrame) -> DataFrame:
    """Per group the median of each statistic and the quartile distance as its scale, from counts on the grid."""
    cells = rows.select("group", F.posexplode(F.array(*X)).alias("k", "x")).groupBy("group", "k", "x").count()
    w = Window.partitionBy("group", "k")
    cells = cells.withColumn("upto", F.sum("count").over(w.orderBy("x"))).withColumn("n", F.sum("count").over(w))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(share * F.col("n")), F.col("x")))
    marks = cells.groupBy("group", "k").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    var = ((F.col("high") - F.col("low")) / (1.349 * GRID)) ** 2
    return marks.groupBy("group").agg(*[F.max(F.when(F.col("k") == i, F.col("mid") / GRID)).alias(f"m{i}") for i in range(DIM)],
                                      *[(F.max(F.when(F.col("k") == i, var)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])


def _whitening(estimate: DataFrame) -> DataFrame:
    """The estimate with ``w``: the inverse of the covariance's Cholesky factor. The floors are added to the variances, so it always exists."""
    out = estimate
    for i in range(DIM):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(v) if i == j else v / F.col(f"l{j}{j}"))
    for j in range(DIM):
        out = out.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, DIM):
            v = F.lit(0.0)
            for k in range(j, i):
                v = v - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            out = out.withColumn(f"w{i}{j}", v / F.col(f"l{i}{i}"))
    return out.select("group", *[f"m{i}" for i in range(DIM)], *[f"w{i}{j}" for i, j in PAIRS])


def _distance() -> Column:
    """The squared Mahalanobis distance of a row joined to its group's whitening."""
    total = F.lit(0.0)
    for i in range(DIM):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}{j}") * (F.col(f"x{j}") / GRID - F.col(f"m{j}"))
        total = total + F.pow(y, F.lit(2.0))
    return total


def _concentrated(rows: DataFrame, now: DataFrame, groups: int, correct: float) -> DataFrame:
    """One concentration step: centre and covariance of the closest rows of each group.

    Distances are cut into fine classes (a sixty-fourth in the logarithm); classes are taken in order until they hold the core share of the rows.
    """
    placed = _with_few(rows, now, groups, "group").withColumn("class", F.floor(64 * F.log(_distance() + 1e-3)))
    cells = placed.groupBy("group", "class").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)],
                                                 *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS])
    w = Window.partitionBy("group")
    cells = cells.withColumn("before", F.sum("n").over(w.orderBy("class")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    core = cells.where(F.col("before") < F.ceil(CORE * F.col("all"))).groupBy("group").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(DIM)], *[f"q{i}{j}" for i, j in PAIRS]]])
    mean = [F.col(f"s{i}") / F.col("n") / GRID for i in range(DIM)]
    return core.select("group", *[mean[i].alias(f"m{i}") for i in range(DIM)],
                       *[((F.col(f"q{i}{j}") / F.col("n") / GRID ** 2 - mean[i] * mean[j]) * correct).alias(f"c{i}{j}") for i, j in PAIRS])


def estimates(rows: DataFrame, groups: int) -> DataFrame:
    """The whitening of each group after the concentration steps, scaled so that normal rows have chi-square distances."""
    correct = CORE / chi2_share(chi2_cut(CORE, DIM), DIM + 2)
    now = written(_whitening(_first_estimate(rows)), "estimate")
    for _ in range(STEPS):
        now = written(_whitening(_concentrated(rows, now, groups, correct)), "estimate")
    return now


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the base columns, ``base_failed``, ``distance`` (squared, null without an estimate) and ``kept`` for each row.

    Base rules fail a text of fewer than 10 words, or with over 20 % of its words in repeated windows of five; such texts are no part of an estimate.
    The others are kept within the cut of their group's estimate. Groups of under ``LEAST_ROWS`` rows are pooled; where the last pool is still smaller, the
    base rules alone decide. Null texts count as empty, null languages and sources as values of their own; ids, also null and repeated, are passed on.
    An empty table gives an empty result. Further columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = base_statistics(docs, text, [F.col(c).alias(a) for c, a in ((id_col, "id"), ("lang", "lang"), ("source", "source"))])
    # numbers only from here on, no text
    rows = written(rows.select("id", _key("lang", "source").alias("pair"), "lang", "source", "n_words", *BASE, "base_failed",
                               *[F.round(x * GRID).cast("long").alias(name) for name, x in zip(X, transformed())]), "statistics")
    sound = rows.where(~F.col("base_failed"))
    names = written(group_names(sound.groupBy("lang", "source").count()), "groups")
    n = names.count()
    members = _with_few(sound.select("pair", *X), names, n, "pair").where("group is not null").drop("pair")
    found = estimates(members, n)
    out = _with_few(_with_few(rows, names, n, "pair"), found, n, "group")
    distance = F.when(~F.col("base_failed"), _distance())
    return out.select(F.col("id").alias(id_col), "n_words", *BASE, "base_failed", distance.alias("distance"),
                      (~F.col("base_failed") & F.coalesce(distance <= chi2_cut(1 - TAIL, DIM), F.lit(True))).alias("kept"))

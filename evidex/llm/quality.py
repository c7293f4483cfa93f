"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

Everything is DataFrame functions. Each text gives a vector of transformed statistics. Per language and source, a
deterministic MCD estimates centre and scatter. The rows are standardised by medians and median absolute deviations, and
six starts give first scatters: clipped values, hyperbolic tangents, spatial signs, the half nearest to the medians, rows
without a far value, and the deviations alone. From each start, C-steps keep the 75 % of rows nearest by distance and
take their mean and covariance. After two steps the two starts with the smallest determinants go on until their
determinants stop falling; the smallest wins. The scatter takes the consistency factor of a normal sample. A document
whose squared Mahalanobis distance exceeds `cutoff` is rejected.

Quantiles are read from counts per bin, so they don't depend on how rows are partitioned. Estimates are sums and counts,
so a source with a third of all rows costs no more than many small ones; the table of estimates has a few rows per group
and is joined to the rows by group (broadcast while a count shows it to be small, by a shuffle otherwise). Groups of under
`least` rows pool by language, those left over pool together, and a pool of under `least` rows rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, staged

SPACE = "\t\n\x0b\f\r "
#: Least standard deviations: what no statistic's deviation goes below in any group, in the units of `vector`. Statistics
#: that are zero for most rows would else have none.
FLOORS = {"length": 0.5, "word_length": 0.12, "symbols": 0.5, "capitals": 0.5, "marks": 0.35, "variety": 0.08}
DIM = len(FLOORS)
#: A squared distance far beyond the 0.9999 quantile of chi-square with 6 degrees of freedom (27.9).
CUTOFF = 50.0
#: Least rows of a group, share of rows in a C-step, C-steps of all starts, starts that go on, least fall of a log determinant.
LEAST, SHARE, FIRST_STEPS, BEST, FALL = 50, 0.75, 2, 2, 1e-3
#: Bins a unit of a statistic, and a doubling of a squared distance.
VALUE_BINS, DISTANCE_BINS = 1024, 64


def with_base(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`docs` and the base statistics as further columns, whose free names are returned by statistic."""
    plain = ["words", "hashes", "windows", "sorted", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "capitals", "marks", "distinct"]
    c = {k: free_name(docs, f"_q_{k}") for k in plain}
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, h, s = (F.col(c[k]) for k in ("words", "hashes", "sorted"))
    out = docs.withColumn(c["words"], F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    out = out.withColumn(c["hashes"], F.transform(w, lambda x: F.xxhash64(x)))
    windows = F.transform(F.slice(h, 1, F.greatest(F.size(w) - 4, F.lit(0))), lambda _, i: F.xxhash64(*(F.get(h, i + k) for k in range(5))))
    out = out.withColumn(c["windows"], windows)
    many = F.size(F.array_distinct(c["windows"])) < F.size(c["windows"])
    out = out.withColumn(c["sorted"], F.when(many, F.sort_array(F.transform(c["windows"], lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]))
    out = out.withColumn(c["sorted"], F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(s, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)

    def count(pattern: str) -> Column:
        return (F.length(t) - F.length(F.regexp_replace(t, f"[{pattern}]+", ""))).cast("long")

    values = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": count("#*$%&|<>"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "capitals": count(r"\p{Lu}"),
        "marks": count(".,;:!?"),
        "distinct": F.size(F.array_distinct(h)).cast("long"),
    }
    out = out.select(*docs.columns, *(x.alias(c[k]) for k, x in values.items()))
    return out, {k: c[k] for k in values}


def base_failed(c: dict[str, str]) -> Column:
    """Under ten words, or over a fifth of the words in repeated 5-word windows."""
    return (F.col(c["n_words"]) < 10) | (F.col(c["n_repeat_words"]) * 100 > F.col(c["n_words"]) * 20)


def vector(c: dict[str, str]) -> list[Column]:
    """The transformed statistics, in the order of FLOORS; meaningful where base_failed is false."""
    n = F.greatest(F.col(c["n_words"]), F.lit(1)).cast("double")
    return [
        F.log1p(n),
        F.log1p(F.col(c["word_chars"]) / n),
        F.log1p(100 * F.col(c["n_symbols"]) / n),
        F.log1p(100 * F.col(c["capitals"]) / n),
        F.log1p(100 * F.col(c["marks"]) / n),
        F.log1p(F.col(c["distinct"])) / F.log1p(n),
    ]


def _groups(lang: str, source: str) -> tuple[Column, Column]:
    """A null language or source is a value of its own."""
    return tuple(F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("")) for x in (lang, source))


#: Estimates of up to so many groups (about 250 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000


def _sent(groups: DataFrame) -> DataFrame:
    """A table with a row per group, marked for broadcast if it is measured to be small."""
    return F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups


def consistency(share: float) -> float:
    """The factor by which the scatter of a normal sample's nearest `share` falls short: share / F(q, DIM + 2), where q is
    that quantile of chi-square with DIM degrees of freedom."""

    def below(x: float, k: int) -> float:  # for even k
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))

    if share >= 1:
        return 1.0
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle, DIM) < share else (low, middle)
    return share / below(low, DIM + 2)


XS, MS = [f"x{i}" for i in range(DIM)], [f"m{i}" for i in range(DIM)]
LOWER = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _distance(rows: DataFrame, model: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` (g, x0, x1, ...) with the squared Mahalanobis distance d2 by each of the group's models: centre m, factor l."""
    ys = []  # forward substitution; each y may use those before it in the same select
    for i in range(DIM):
        gone = "".join(f" - l{i}{j} * y{j}" for j in range(i))
        ys.append(f"(x{i} - m{i}{gone}) / l{i}{i} AS y{i}")
    d2 = " + ".join(f"y{i} * y{i}" for i in range(DIM))
    kept = [*rows.columns, *(c for c in model.columns if c not in {"g", *(f"l{i}{j}" for i, j in LOWER)})]
    return rows.join(model, "g", how).selectExpr(*(f"`{c}`" for c in kept), *ys, f"{d2} AS d2").select(*kept, "d2")


def _factor(moments: DataFrame, factor: float = 1.0) -> DataFrame:
    """Cholesky factor of each c{i}{j} times `factor`, no variance below its floor, and its log determinant ld; other columns stay."""
    ls = []
    for j, floor in enumerate(FLOORS.values()):
        left = f"greatest(c{j}{j} * {factor}D, {floor**2}D)" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        ls.append(f"sqrt(greatest({left}, {floor**2 / 16}D)) AS l{j}{j}")
        for i in range(j + 1, DIM):
            gone = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            ls.append(f"(c{i}{j} * {factor}D{gone}) / l{j}{j} AS l{i}{j}")
    ld = " + ".join(f"ln(l{i}{i})" for i in range(DIM))
    kept = [c for c in moments.columns if not (c[0] == "c" and c[1:].isdigit())]
    return moments.selectExpr(*moments.columns, *ls, f"2 * ({ld}) AS ld").select(*kept, *(f"l{i}{j}" for i, j in LOWER), "ld")


def _quantile(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, bin): the first bin of `rows` (keys, bin) at which a `share` of the keys' rows is reached. A window sees counts
    per bin only."""
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    sums = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return sums.filter(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _moments(rows: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    """(keys, n, a0.., c00..): means and covariances of `values`."""
    v = rows.select(*keys, *(x.alias(f"v{i}") for i, x in enumerate(values)))
    sums = [F.sum(f"v{i}").alias(f"s{i}") for i in range(DIM)] + [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}{j}") for i, j in LOWER]
    got = v.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(DIM)]
    return got.select(*keys, "n", *(mean[i].alias(f"a{i}") for i in range(DIM)), *((F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in LOWER))


def _distance_bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + F.lit(2.0**-20)) * DISTANCE_BINS)


def _starts(rows: DataFrame, sent) -> DataFrame:
    """(g, k, m.., l.., ld): the six starts of each group, k from 0."""
    floors = [*FLOORS.values()]
    one = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * VALUE_BINS).alias("bin")) for i, x in enumerate(XS))))
    middle = _quantile(rows.select("g", one.alias("v")).select("g", "v.i", "v.bin"), ["g", "i"], 0.5)
    value = (F.col("bin") + 0.5) / VALUE_BINS
    medians = staged(middle.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, value)).alias(m) for i, m in enumerate(MS))), "medians")
    off = rows.join(sent(medians), "g").select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.abs(F.col(x) - F.col(m)) * VALUE_BINS).alias("bin")) for i, (x, m) in enumerate(zip(XS, MS))))).alias("v"))
    spread = _quantile(off.select("g", "v.i", "v.bin"), ["g", "i"], 0.5)
    spread = spread.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.greatest(value * 1.4826, F.lit(floors[i])))).alias(f"u{i}") for i in range(DIM)))
    scales = staged(medians.join(spread, "g"), "scales")
    z = [((F.col(x) - F.col(m)) / F.col(f"u{i}")).alias(f"z{i}") for i, (x, m) in enumerate(zip(XS, MS))]
    scaled = rows.join(sent(scales), "g").select("g", *z)
    zs = [F.col(f"z{i}") for i in range(DIM)]
    norm = sum((x * x for x in zs[1:]), zs[0] * zs[0])
    half = staged(_quantile(scaled.select("g", _distance_bin(norm).alias("bin")), ["g"], 0.5).withColumnRenamed("bin", "half"), "halves")
    scaled = scaled.withColumn("norm", norm).join(sent(half), "g")

    def vectors(k: int, values: list[Column], where: Column = F.lit(True)) -> Column:
        return F.when(where, F.struct(F.lit(k).alias("k"), *(v.alias(f"y{i}") for i, v in enumerate(values))))

    nearest = _distance_bin(F.col("norm")) <= F.col("half")
    within = F.lit(True)
    for x in zs:
        within = within & (F.abs(x) <= 2.5)
    root = F.sqrt(F.greatest(F.col("norm"), F.lit(1e-12)))
    made = [vectors(0, [F.greatest(F.least(x, F.lit(2.0)), F.lit(-2.0)) for x in zs]), vectors(1, [F.tanh(x) for x in zs]), vectors(2, [x / root for x in zs]), vectors(3, zs, nearest), vectors(4, zs, within)]
    each = scaled.select("g", F.explode(F.filter(F.array(*made), lambda v: v.isNotNull())).alias("v")).select("g", "v.*")
    moments = _moments(each, ["g", "k"], [F.col(f"y{i}") for i in range(DIM)]).join(scales, "g")
    u = [F.col(f"u{i}") for i in range(DIM)]
    first = moments.select("g", "k", *MS, *((F.col(f"c{i}{j}") * u[i] * u[j]).alias(f"c{i}{j}") for i, j in LOWER))
    plain = scales.select("g", F.lit(5).alias("k"), *MS, *((u[i] * u[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in LOWER))
    return staged(_factor(first.union(plain)), "starts")


def _step(rows: DataFrame, model: DataFrame, share: float, sent) -> DataFrame:
    """A C-step of every model (g, k): the mean and scatter of the `share` of rows nearest by it."""
    far = _distance(rows, sent(model.drop("ld"))).withColumn("bin", _distance_bin(F.col("d2")))
    cut = staged(_quantile(far.select("g", "k", "bin"), ["g", "k"], share).withColumnRenamed("bin", "cut"), "cuts")
    near = far.join(sent(cut), ["g", "k"]).filter("bin <= cut")
    got = _moments(near, ["g", "k", *MS], [F.col(x) - F.col(m) for x, m in zip(XS, MS)])  # about the last centre, for precision
    return staged(_factor(got.select("g", "k", *((F.col(m) + F.col(f"a{i}")).alias(m) for i, m in enumerate(MS)), *(f"c{i}{j}" for i, j in LOWER), *(F.col(f"c{i}{j}").alias(f"raw{i}{j}") for i, j in LOWER))), "models")


def estimate(stats: DataFrame, least: int = LEAST, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """The groups that (lang, source) map to, and each group's centre and factor. `stats`: lang, source, x0, x1, ..."""
    each = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < least
    pools = each.filter(small).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    named = each.join(pools, "lang", "left").select("lang", "source", F.when(~small, F.concat_ws("\x1f", F.lit("s"), "lang", "source")).when(F.col("n_lang") >= least, F.concat_ws("\x1f", F.lit("l"), "lang")).otherwise(F.lit("a")).alias("g"), "n")
    named = staged(named, "groups")
    enough = named.groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("g")
    few = named.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS

    def sent(groups: DataFrame) -> DataFrame:
        return F.broadcast(groups) if few else groups

    named = named.drop("n")
    rows = staged(stats.join(sent(named), ["lang", "source"]).join(sent(enough), "g", "left_semi").select("g", *XS), "vectors")
    model = _starts(rows, sent)
    for _ in range(FIRST_STEPS):
        model = _step(rows, model, share, sent)
    best = Window.partitionBy("g").orderBy("ld", "k")
    going = staged(model.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= BEST).drop("nth"), "best")
    ended = []
    while not going.isEmpty():
        after = _step(rows, going, share, sent)
        both = after.join(going.select("g", "k", F.col("ld").alias("was")), ["g", "k"])
        kept = going.join(after.select("g", "k", F.col("ld").alias("now")), ["g", "k"]).filter("now >= ld").drop("now")
        lower = both.filter(F.col("ld") < F.col("was"))
        ended += [kept, lower.filter(F.col("ld") >= F.col("was") - FALL).drop("was")]
        going = staged(lower.filter(F.col("ld") < F.col("was") - FALL).drop("was"), "going")
    done = ended[0] if ended else going
    for more in ended[1:]:
        done = done.unionByName(more)
    done = staged(done.withColumn("nth", F.row_number().over(best)).filter("nth = 1"), "smallest")
    whole = done.select("g", *MS, *(F.col(f"raw{i}{j}").alias(f"c{i}{j}") for i, j in LOWER))
    return named, staged(_factor(whole, consistency(share)).select("g", *MS, *(f"l{i}{j}" for i, j in LOWER)), "model")


def _flat(based: DataFrame, c: dict[str, str], lang: str, source: str) -> list[Column]:
    a, b = _groups(lang, source)
    return [a.alias("lang"), b.alias("source"), *(F.when(~base_failed(c), x).alias(f"x{i}") for i, x in enumerate(vector(c)))]


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, **options) -> DataFrame:
    """Per row: id, the base statistics, base_failed, d2 (null where no group is large enough) and kept.

    Null texts have no words and fail; repeated rows count each; an empty table gives an empty result.
    """
    based, c = with_base(docs.select(id, text, lang, source), text)
    rows = staged(based.select(F.col(id).alias("id"), *(F.col(v).alias(k) for k, v in c.items()), base_failed(c).alias("base_failed"), *_flat(based, c, lang, source)), "stats")
    named, model = estimate(rows.filter("not base_failed").select("lang", "source", *XS), **options)
    out = _distance(rows.join(_sent(named), ["lang", "source"], "left"), _sent(model), "left")
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)
    return out.select(F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, **options) -> DataFrame:
    """The kept rows, columns as they are: each text is read once, and its statistics are written beside it.

    Null texts have no words and go; repeated rows count and are judged each; an empty table gives an empty result.
    """
    based, c = with_base(docs, text)
    whole = free_name(based, "_row")
    wide = staged(based.select(F.struct(*docs.columns).alias(whole), base_failed(c).alias("failed"), *_flat(based, c, lang, source)), "judged")
    named, model = estimate(wide.filter("not failed").select("lang", "source", *XS), **options)
    far = _distance(wide.filter("not failed").join(_sent(named), ["lang", "source"], "left"), _sent(model), "left")
    return far.filter(F.coalesce("d2", F.lit(0.0)) <= cutoff).select(f"{whole}.*")

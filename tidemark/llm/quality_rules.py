"""Quality rules: fixed limits, then robust multivariate outliers. DataFrame functions only.

For every language and source, the minimum-covariance-determinant estimate of centre and covariance of a vector
of transformed statistics: from several deterministic starts, concentration steps (the three quarters of the
documents with the least Mahalanobis distances give the next centre and covariance) run until the determinant no
longer falls, and the start with the least determinant counts. In the steps the covariance is regularised towards
the spread of all documents (the regularised estimate of Boudt et al., 2020), which keeps groups of any size
invertible. A group's estimate is then mixed with its language's, and that with the estimate of all documents, by
their numbers. Documents far from their group's estimate are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import discard, materialise

#: White space that parts words, and the symbols that are counted.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
WINDOW = 8
#: Transformed statistics: logarithms of sizes, and shares by the angle that stabilises their variance.
VECTOR = ("log_words", "log_word_length", "angle_symbols", "angle_dup_lines")
#: Variance that is added to each statistic, since smaller differences mean nothing: a tenth, in logarithms and angles.
FLOOR = 0.01
#: Share of a group's documents in the concentrated part, most steps, and the weight of the spread of all documents
#: in the steps, as a number of documents (the dimension and one).
SHARE, STEPS, PRIOR = 0.75, 40, 5.0
#: Weight of the wider estimate against a group's own, as a number of documents.
POOL = 40.0
#: Median of the chi-squared distribution with four degrees of freedom, and its point with a tail of 1e-5.
CHI_MEDIAN, LIMIT = 3.357, 28.473
#: Tables of up to so many estimates (about 200 bytes each) are broadcast; larger ones join by salted keys.
BROADCAST_SHAPES, SALTS = 20_000, 32
_N = range(len(VECTOR))
_LOWER = [(i, j) for i in _N for j in range(i + 1)]

def _shifted(col: str, by: int) -> Column:
    return F.slice(col, by + 1, F.greatest(F.size(col), F.lit(1)))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each whole text.

    All in the row, without a shuffle. n_repeat_words counts words in 8-word windows found twice or more in the
    text, the first included: hashes of all windows (by doubling: of 2, 4, then 8 words) are compared as a set,
    and only texts with a repeat sort them to find the places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        *keep,
        F.explode(F.array(F.struct(words.alias("w"), lines.alias("l")))).alias("s"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
    ).select(
        *keep,
        F.size("s.w").cast("long").alias("n_words"),
        F.aggregate("s.w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        "n_symbols",
        F.size("s.l").cast("long").alias("n_lines"),
        (F.size("s.l") - F.size(F.array_distinct("s.l"))).cast("long").alias("n_dup_lines"),
        F.transform("s.w", lambda w: F.xxhash64(w)).alias("h"),
    )
    plain = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    for by in (1, 2, 4):
        counted = counted.select(*plain, F.zip_with("h", _shifted("h", by), lambda a, b: F.xxhash64(a, b)).alias("h"))
    counted = counted.select(*plain, F.slice("h", 1, F.greatest(F.col("n_words") - WINDOW + 1, F.lit(0)).cast("int")).alias("h"))
    repeats = F.size("h") > F.size(F.array_distinct("h"))
    placed = counted.select(
        *plain, F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s")
    )
    paired = placed.select(*plain, "s", F.zip_with("s", _shifted("s", 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))).alias("same"))
    again = F.transform(
        "s", lambda x, k: F.when(F.get("same", k) | F.coalesce(F.get("same", k - 1), F.lit(False)), x["i"])
    )
    starts = paired.select(*plain, F.sort_array(F.filter(again, lambda x: x.isNotNull())).alias("p"))
    covered = F.zip_with("p", _shifted("p", 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return starts.select(*plain, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("n_repeat_words"))


def _factored(frame: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, the factor l_i_j of the covariance c_i_j, and the logarithm of its determinant."""
    for i, j in _LOWER:  # a column at a time, so that each is computed once
        rest = reduce(lambda x, k: x - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}"))
        frame = frame.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    logdet = reduce(lambda x, y: x + y, (2 * F.ln(f"l_{i}_{i}") for i in _N))
    return frame.select(*keep, *(f"l_{i}_{j}" for i, j in _LOWER), logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance from the centre m_i through the factor l_i_j, by forward substitution."""
    z: list[Column] = []
    for i, name in enumerate(VECTOR):
        rest = reduce(lambda x, j: x - F.col(f"l_{i}_{j}") * z[j], range(i), F.col(name) - F.col(f"m_{i}"))
        z.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda x, y: x + y, (x * x for x in z))


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` joined to a table with few rows a key: broadcast if ``few``, else by keys that salts split."""
    if few:
        return rows.join(F.broadcast(table), keys)
    salt = F.pmod(F.xxhash64(*VECTOR), F.lit(SALTS)).alias("salt")
    spread = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return rows.select("*", salt).join(spread, [*keys, "salt"]).drop("salt")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *(F.avg(c).alias(f"m_{i}") for i, c in enumerate(VECTOR)),
        *(F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c_{i}_{j}") for i, j in _LOWER),
    )


def _regular(frame: DataFrame, keep: list[str]) -> DataFrame:
    """The covariance c_i_j with the target t_i on its diagonal mixed in by ``rho``, and FLOOR added, factored."""
    for i, j in _LOWER:
        mixed = (1 - F.col("rho")) * F.col(f"c_{i}_{j}") + (F.col("rho") * F.col(f"t_{i}") + FLOOR if i == j else 0.0)
        frame = frame.withColumn(f"c_{i}_{j}", mixed)
    return _factored(frame, keep)


def robust_estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """(pool, n, m_i, c_i_j), the estimate of each ``pool`` of ``rows`` (pool and VECTOR), and the number of pools.

    Quantiles have a rank error of at most a ten thousandth, so they are exact in pools of up to 10,000 rows; a
    concentrated part holds every row up to its quantile, ties included.
    """
    cut = lambda c, at: F.percentile_approx(c, at, 10_000)
    centre, cov = [f"m_{i}" for i in _N], [f"c_{i}_{j}" for i, j in _LOWER]
    factor, target = [f"l_{i}_{j}" for i, j in _LOWER], [f"t_{i}" for i in _N]
    middle = materialise(rows.groupBy("pool").agg(F.count("*").alias("n"), *(cut(c, 0.5).alias(f"m_{i}") for i, c in enumerate(VECTOR))), "middle")
    pools = middle.count()
    few = 3 * pools <= BROADCAST_SHAPES
    away = _looked_up(rows, middle, ["pool"], few).groupBy("pool").agg(
        *(cut(F.abs(F.col(c) - F.col(f"m_{i}")), 0.5).alias(f"a_{i}") for i, c in enumerate(VECTOR))
    )
    spread = away.select("pool", *(F.pow(1.4826 * F.col(f"a_{i}"), 2).alias(f"s_{i}") for i in _N))
    whole = spread.where("pool = '0'").select(*(F.col(f"s_{i}").alias(f"t_{i}") for i in _N))  # one row
    base = middle.join(spread, "pool").join(F.broadcast(whole)).withColumn("rho", PRIOR / (F.col("n") * SHARE + PRIOR))
    fixed = materialise(base, "pools")
    diagonal = lambda name: [(F.col(f"{name}_{i}") if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _LOWER]
    about = ["pool", "rho", *target]
    starts = [
        fixed.select(*about, F.lit(0).alias("start"), *centre, *diagonal("s")),  # medians and absolute deviations
        fixed.select(*about, F.lit(1).alias("start"), *centre, *diagonal("t")),  # the same centre, all documents' spread
        fixed.select(*about).join(_moments(rows, ["pool"]), "pool").select(*about, F.lit(2).alias("start"), *centre, *cov),  # all rows
    ]
    state = ["pool", "start", "rho", *target, *centre, *cov]
    now = materialise(_regular(reduce(DataFrame.unionByName, starts).withColumn("before", F.lit(float("inf"))), [*state, "before"]), "state")
    settled = []
    for _ in range(STEPS):
        far = _looked_up(rows, now.select("pool", "start", *centre, *factor), ["pool"], few).select("pool", "start", *VECTOR, _distance().alias("d2"))
        bound = far.groupBy("pool", "start").agg(cut("d2", SHARE).alias("bound"))
        core = _looked_up(far, bound, ["pool", "start"], few).where("d2 <= bound")
        found = _moments(core, ["pool", "start"]).join(now.select("pool", "start", "rho", *target, F.col("logdet").alias("before")), ["pool", "start"])
        new = materialise(_regular(found, [*state, "before"]), "state")
        falls = F.col("logdet") < F.col("before") - 1e-6
        settled.append(new.where(~falls))
        now = new.where(falls)
        if now.isEmpty():
            break
    ended = reduce(DataFrame.unionByName, [*settled, now])
    best = ended.groupBy("pool").agg(F.min_by(F.struct(*centre, *cov), F.struct("logdet", "start")).alias("e"))
    return materialise(best.join(fixed.select("pool", "n"), "pool").select("pool", "n", "e.*"), "estimates"), pools


def _mixed(own: str, wide: str, n: str) -> list[Column]:
    """Centre and covariance between ``own``, by its ``n`` documents, and ``wide``, by POOL.

    How far the centres lie apart doesn't widen the covariance, so a few outliers in a small group can't hide each other.
    """
    w = F.col(n) / (F.col(n) + POOL)
    centre = [(w * F.col(f"{own}.m_{i}") + (1 - w) * F.col(f"{wide}.m_{i}")).alias(f"m_{i}") for i in _N]
    cov = [(w * F.col(f"{own}.c_{i}_{j}") + (1 - w) * F.col(f"{wide}.c_{i}_{j}")).alias(f"c_{i}_{j}") for i, j in _LOWER]
    return [*centre, *cov]


def _angle(part: str, whole: str, added: int) -> Column:
    """Angle of a share; ``added`` to the whole, so that one of few isn't a high share."""
    return F.asin(F.sqrt(F.col(part) / (F.greatest(part, whole) + added)))


def shapes(good: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(g, m_i, l_i_j) of each group, (g, scale), and whether the tables are small; ``good`` has l, g and VECTOR."""
    pools = F.array(F.lit("0"), F.concat(F.lit("1"), "l"), F.concat(F.lit("2"), "g"))
    every = materialise(good.select(F.explode(pools).alias("pool"), *VECTOR), "judged")
    found, number = robust_estimates(every)
    few = number <= BROADCAST_SHAPES
    discard(every)
    of = found.select("pool", "n", F.struct(*(f"m_{i}" for i in _N), *(f"c_{i}_{j}" for i, j in _LOWER)).alias("e"))
    named = lambda p, as_, *key: of.where(F.substring("pool", 1, 1) == p).select(
        *(F.substring("pool", 2, 1 << 30).alias(k) for k in key), F.col("n").alias(f"n_{as_}"), F.col("e").alias(as_)
    )
    groups = good.select("l", "g").distinct().join(named("1", "lang", "l"), "l").join(named("2", "own", "g"), "g")
    groups = groups.join(F.broadcast(named("0", "every")))  # one row
    by_lang = groups.select("g", "n_own", "own", F.struct(*_mixed("lang", "every", "n_lang")).alias("wide"))
    shape = materialise(_factored(by_lang.select("g", *_mixed("own", "wide", "n_own")), ["g", *(f"m_{i}" for i in _N)]), "shape").drop("logdet")
    d2 = _looked_up(good, shape, ["g"], few).select("g", _distance().alias("d2"))
    all_d2 = d2.agg(F.percentile_approx("d2", 0.5, 10_000).alias("wide"))
    by_group = d2.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("d2", 0.5, 10_000).alias("own"))
    median = (F.col("n") * F.col("own") + POOL * F.col("wide")) / (F.col("n") + POOL)
    scale = by_group.join(F.broadcast(all_d2)).select("g", F.greatest(median / CHI_MEDIAN, F.lit(1.0)).alias("scale"))
    return shape, scale, few


#: The statistics that are reported.
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, statistics, base_failed, distance, kept) for each row of ``docs``.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. The others are judged within
    their language and source (null is a value of its own), in groups of any size: the squared distance, divided
    by how far its median lies above the chi-squared one, must not pass LIMIT. Null texts have no words and fail.
    Ties and repeated rows are judged alike; an empty table gives an empty result. Other columns are ignored.
    """
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (lang_col, source_col)]
    named = docs.select(F.col(id_col).alias("id"), keys[0].alias("l"), F.concat_ws("\u0001", *keys).alias("g"), F.col(text_col).alias("text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    vector = (
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        _angle("n_symbols", "word_chars", 40),
        _angle("n_dup_lines", "n_lines", 4),
    )
    rows = materialise(
        statistics(named, ("id", "l", "g")).select("*", failed.alias("base_failed"), *(x.alias(c) for x, c in zip(vector, VECTOR, strict=True))), "statistics"
    )
    good = rows.where(~F.col("base_failed"))
    shape, scale, few = shapes(good)
    looked = shape.join(scale, "g")
    judged = _looked_up(good.select("id", "g", *_BASE, *VECTOR), looked, ["g"], few)
    distance = _distance() / F.col("scale")
    near = judged.select("id", *_BASE, F.lit(False).alias("base_failed"), distance.alias("distance"))
    rest = rows.where("base_failed").select("id", *_BASE, "base_failed", F.lit(None).cast("double").alias("distance"))
    return near.unionByName(rest).select(
        F.col("id").alias(id_col), *_BASE, "base_failed", "distance", F.coalesce(F.col("distance") <= LIMIT, F.lit(False)).alias("kept")
    )

"""Quality rules and robust multivariate outliers: minimum covariance determinant (MCD) by language and source.

Statistics of a text are transformed to a vector: log of the words, mean word length (with PRIOR_WORDS words of PRIOR_LENGTH
characters added, as the mean of a few words says little), and the square roots of the shares of symbols, of repeated lines
and of repeated words. For each language and source the MCD looks for the H share of rows whose scatter has the least
determinant. It starts three times: from mean and covariance, and from the medians and the lower quartiles with the scale of
the quartiles, which a third of junk cannot pull. From each start two concentration steps are made: distances to the
current centre and scatter, then centre and scatter of the H share of rows that are nearest. The start with the least
determinant goes on until its determinant falls no more. At last the estimate is reweighted, as usual: centre and scatter of
all rows within the WITHIN quantile.

Distances are dealt to fine logarithmic bins and the subset is the least number of whole bins that hold the share, so a step
needs only sums by group and bin, added up before the shuffle: a group of any size is a few hundred rows of sums. The
scatter gets a floor for each coordinate, so that coordinates without spread (no symbols at all) do not make it singular.
A row is kept if its squared Mahalanobis distance is at most the chi-square quantile that one normal row in a million
exceeds.

Groups with fewer than LEAST rows use their language's estimate, and languages with fewer that of all rows; with fewer than
LEAST rows in all, no row is an outlier. Rows that fail the base rules are not used in the estimates.

Everything is DataFrame expressions. Windows of 5 words are hashed; only where hashes repeat in a text they are packed with
their position (31 bits) into a long and sorted, neighbours with equal high bits are candidates, and candidates are compared
as text.

Defined cases: null text has no words (all 0, base_failed); null lang or source is a group of its own; repeated rows count
each; texts of any length are read whole; distances equal to the cut are kept; empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5
#: Share of a group's rows in the subset, steps from each start and at most, least rows of a group, bins for a factor of 2.
H, FIRST_STEPS, STEPS, LEAST, BINS = 0.5, 2, 20, 50, 8
#: Normal rows within the reweighted estimate.
WITHIN = 0.975
#: Coordinates, with the least standard deviation of each.
FLOORS = {"x_words": 1.0, "x_length": 0.35, "x_symbols": 0.05, "x_lines": 0.15, "x_repeats": 0.15}
PRIOR_WORDS, PRIOR_LENGTH = 30, 5.0
#: Share of normal rows beyond the cut.
BEYOND = 1e-6
#: Estimates of so many groups at most are broadcast (a few hundred bytes each).
BROADCAST_GROUPS = 100_000


def statistics(docs: DataFrame, *extra: str) -> DataFrame:
    """Word statistics of each row; extra columns are carried along."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(*extra, text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = own.select(*extra, "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    own = own.select(*extra, "w", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    keep = [*extra, "w", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    n = F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))
    own = own.select(*keep, F.transform(F.arrays_zip(*[F.slice("w", i + 1, n).alias(f"w{i}") for i in range(WINDOW)]), lambda x: F.xxhash64(x)).alias("v"))
    # position in the low 31 bits, hash in the others
    low = (1 << 31) - 1
    packed = F.sort_array(F.transform("v", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    own = own.select(*keep, F.when(F.size(F.array_distinct("v")) < F.size("v"), packed).otherwise(F.array().cast("array<long>")).alias("s"))
    high = lambda x: F.shiftright(x, 31)
    alike = F.filter("s", lambda x, i: (high(x) == high(F.get("s", i + 1))) | (high(x) == high(F.get("s", i - 1))))
    own = own.select(*keep, F.transform(alike, lambda x: x.bitwiseAND(F.lit(low)).cast("int")).alias("p"))
    own = own.select(*keep, F.array_sort(F.transform("p", lambda p: F.struct(F.array_join(F.slice("w", p + 1, WINDOW), " ").alias("x"), p.alias("p")))).alias("c"))
    same = F.filter("c", lambda x, i: F.coalesce((x["x"] == F.get("c", i + 1)["x"]) | (x["x"] == F.get("c", i - 1)["x"]), x["x"] == F.get("c", i + 1)["x"], x["x"] == F.get("c", i - 1)["x"], F.lit(False)))
    own = own.select(*keep, F.sort_array(F.transform(same, lambda x: x["p"])).alias("r"))
    covered = F.aggregate(F.transform("r", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("r", i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return own.select(*extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines")


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector():
    """The transformed coordinates of a row of statistics."""
    share = lambda a, b: F.sqrt(F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)))
    made = [F.log1p("n_words"), (F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [x.alias(n) for x, n in zip(made, FLOORS)]


def _names(d: int):
    return [f"m{i}" for i in range(d)], [(i, j) for i in range(d) for j in range(i + 1)]


def whitened(xs: list[str]):
    """From columns mi and cij (lower triangle of the scatter with floors) of an estimate, the columns lij of the inverse
    Cholesky factor that turn x - m to coordinates of unit scatter: a list of (name, expression) steps."""
    d, steps = len(xs), []
    for i in range(d):
        for j in range(i):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"g{i}{k}") * F.col(f"g{j}{k}")
            steps.append((f"g{i}{j}", rest / F.col(f"g{j}{j}")))
        rest = F.col(f"c{i}{i}")
        for k in range(i):
            rest = rest - F.col(f"g{i}{k}") * F.col(f"g{i}{k}")
        steps.append((f"g{i}{i}", F.sqrt(F.greatest(rest, F.lit(1e-12)))))
    return steps


def _distance(xs: list[str]):
    """Squared Mahalanobis distance by forward substitution with the struct column `est`."""
    z, total = [], F.lit(0.0)
    for i, x in enumerate(xs):
        rest = F.col(x) - F.col(f"est.m{i}")
        for k in range(i):
            rest = rest - F.col(f"est.g{i}{k}") * z[k]
        z.append(rest / F.col(f"est.g{i}{i}"))
        total = total + z[-1] * z[-1]
    return total


def _estimates(sums: DataFrame, xs: list[str], by: list[str], scale: float) -> DataFrame:
    """Centre, Cholesky factor and logarithm of the determinant by group from sums over the subset."""
    d = len(xs)
    own = sums.select(*by, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(d)], *[f"q{i}{j}" for i, j in _names(d)[1]], "n")
    floors = list(FLOORS.values())
    cov = lambda i, j: (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
    own = own.select(*by, *_names(d)[0], *[(cov(i, j) + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _names(d)[1]])
    return _factors(own, xs, by)


def _factors(own: DataFrame, xs: list[str], by: list[str]) -> DataFrame:
    """by, est (mi and gij) and logdet from mi and cij."""
    d = len(xs)
    for name, step in whitened(xs):
        own = own.withColumn(name, step)
    logdet = sum((F.log(f"g{i}{i}") * 2 for i in range(d)), F.lit(0.0))
    return own.select(*by, F.struct(*_names(d)[0], *[f"g{i}{j}" for i, j in _names(d)[1]]).alias("est"), logdet.alias("logdet"))


def _starts(members: DataFrame, xs: list[str], by: list[str]) -> DataFrame:
    """Three starts by group: 0 from mean and covariance, 1 and 2 from medians and lower quartiles."""
    d, floors = len(xs), list(FLOORS.values())
    mean = _estimates(members.groupBy(*by).agg(*_sums(xs)), xs, by, 1.0).withColumn("start", F.lit(0))
    quartiles = members.groupBy(*by).agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"p{i}") for i, x in enumerate(xs)])
    out = mean
    for start, at in ((1, 1), (2, 0)):
        diagonal = [F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(2)) + floors[i] ** 2 for i in range(d)]
        own = quartiles.select(*by, *[F.col(f"p{i}")[at].alias(f"m{i}") for i in range(d)], *[(diagonal[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _names(d)[1]])
        out = out.unionByName(_factors(own, xs, by).withColumn("start", F.lit(start)))
    return out


def _concentrated(members: DataFrame, est: DataFrame, xs: list[str], by: list[str]) -> DataFrame:
    """One concentration step: the estimate of the nearest H share of rows under each estimate."""
    many = members.join(est.select(*by, "est"), by[:2])
    bins = F.floor(F.log2(F.greatest(_distance(xs), F.lit(1e-6))) * BINS).alias("bin")
    parts = many.select(*by, *xs, bins).groupBy(*by, "bin").agg(*_sums(xs))
    upto = Window.partitionBy(*by).orderBy("bin")
    cut = parts.withColumns({"before": F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(*by))})
    names = [c for c in parts.columns if c not in (*by, "bin")]
    sums = cut.where(F.col("before") < H * F.col("all")).groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    return _estimates(sums, xs, by, consistency(len(xs), H))


def _sums(xs: list[str]):
    d = len(xs)
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)], *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"q{i}{j}") for i, j in _names(d)[1]]]


def mcd_distances(rows: DataFrame, xs: list[str], group: list[str]) -> DataFrame:
    """rows (with columns xs, group: [language, source], and boolean `used`) with the column d2."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(g)), F.lit("")) for g in group)
    own = rows.withColumns({"__l": lang, "__s": source})
    sizes = cluster.materialize(own.where("used").groupBy("__l", "__s").agg(F.count(F.lit(1)).alias("n")), "sizes")
    langs = sizes.groupBy(F.col("__l").alias("__ll")).agg(F.sum("n").alias("nl"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    level = sizes.join(langs, F.col("__l") == F.col("__ll")).select("__l", "__s", F.when(F.col("n") >= LEAST, 2).when(F.col("nl") >= LEAST, 1).otherwise(0).alias("level"))
    n_groups = sizes.count()
    small = (lambda d: F.broadcast(d)) if n_groups <= BROADCAST_GROUPS else (lambda d: d)
    # the group that a row's estimate comes from; rows in groups without a used row go by language or all
    known_langs = langs.where(F.col("nl") >= LEAST).select("__ll")
    own = own.join(small(level.withColumnsRenamed({"__l": "__l2", "__s": "__s2"})), (F.col("__l") == F.col("__l2")) & (F.col("__s") == F.col("__s2")), "left").join(small(known_langs), F.col("__l") == F.col("__ll"), "left")
    grain = F.coalesce("level", F.when(F.col("__ll").isNotNull(), 1).otherwise(0))
    own = own.select(*rows.columns, "__l", "__s", grain.alias("__grain"))
    own = cluster.materialize(own.select(*rows.columns, F.when(F.col("__grain") > 0, F.col("__l")).otherwise("*").alias("__gl"), F.when(F.col("__grain") > 1, F.col("__s")).otherwise("*").alias("__gs")), "vectors")
    if total < LEAST:
        return own.select(*rows.columns, F.lit(0.0).alias("d2"))
    by = ["__gl", "__gs"]

    # a used row counts for the estimate of its source in its language, of its language and of all, as far as one is needed
    need = cluster.materialize(own.select(*by).distinct(), "grains")
    grains = F.array(F.struct(F.col("__l").alias("l"), F.col("__s").alias("s")), F.struct(F.col("__l").alias("l"), F.lit("*").alias("s")), F.struct(F.lit("*").alias("l"), F.lit("*").alias("s")))
    known = sizes.select("__l", "__s", F.explode(grains).alias("g")).select("__l", "__s", F.col("g.l").alias("__gl"), F.col("g.s").alias("__gs")).join(small(need), by, "left_semi")
    known = known.groupBy(F.col("__l").alias("__l2"), F.col("__s").alias("__s2")).agg(F.collect_list(F.struct("__gl", "__gs")).alias("__g"))
    used = own.where("used").withColumns({"__l": lang, "__s": source}).join(small(known), (F.col("__l") == F.col("__l2")) & (F.col("__s") == F.col("__s2")))
    members = cluster.materialize(used.select(*xs, F.explode("__g").alias("g")).select(F.col("g.__gl").alias("__gl"), F.col("g.__gs").alias("__gs"), *xs), "members")
    est = cluster.materialize(_starts(members, xs, by), "starts")
    for _ in range(FIRST_STEPS):
        est = cluster.materialize(_concentrated(members, small(est), xs, [*by, "start"]), "estimates")
    best = Window.partitionBy(*by).orderBy("logdet", "start")
    est = est.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(*by, "est", "logdet", F.lit(False).alias("done"))
    est = cluster.materialize(est, "best")
    for _ in range(STEPS):
        new = _concentrated(members, small(est.where("not done")), xs, by).select(*by, F.col("est").alias("est2"), F.col("logdet").alias("logdet2"))
        falls = F.col("logdet2") < F.col("logdet") - 1e-6
        step = est.join(new, by, "left").select(*by, F.when(falls, F.col("est2")).otherwise(F.col("est")).alias("est"), F.when(falls, F.col("logdet2")).otherwise(F.col("logdet")).alias("logdet"), F.coalesce(~falls, F.lit(True)).alias("done"))
        step = cluster.materialize(step, "estimates")
        cluster.drop(est)
        est = step
        if not est.where("not done").limit(1).count():
            break
    near = members.join(small(est), by).where(_distance(xs) <= chi2_quantile(WITHIN, len(xs)))
    est = cluster.materialize(_estimates(near.groupBy(*by).agg(*_sums(xs)), xs, by, consistency(len(xs), WITHIN)), "reweighted")
    return own.join(small(est), by, "left").select(*rows.columns, F.coalesce(_distance(xs), F.lit(0.0)).alias("d2"))


def chi2_cdf(x: float, k: int) -> float:
    import math

    if k == 1:
        return math.erf(math.sqrt(x / 2))
    if k == 2:
        return 1 - math.exp(-x / 2)
    return chi2_cdf(x, k - 2) - (x / 2) ** (k / 2 - 1) * math.exp(-x / 2) / math.gamma(k / 2)


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


def consistency(d: int, share: float) -> float:
    """Factor that makes the scatter of the nearest share of normal rows that of all: share / P(chi2(d + 2) <= q_share(d))."""
    return share / chi2_cdf(chi2_quantile(share, d), d + 2)


#: Largest squared distance of a row that is kept.
CUTOFF = chi2_quantile(1 - BEYOND, len(FLOORS))


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and d2 of each row."""
    stats = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"), "doc_id", "lang", "source")
    rows = stats.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), *vector())
    rows = cluster.materialize(rows.withColumn("used", ~F.col("base_failed")), "statistics")
    found = mcd_distances(rows, list(FLOORS), ["lang", "source"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("d2") <= CUTOFF)).alias("kept"), F.round("d2", 4).alias("d2"))


def query(spark, sf_dir):
    return rate(cluster.table(spark, sf_dir, "documents"))

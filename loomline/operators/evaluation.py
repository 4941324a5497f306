"""Evaluation: accuracy by slice, consistency, perplexity, pass rates, pair accuracy, word F1, gates, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster

#: Series whose stopping places are broadcast at most.
BROADCAST_SERIES = 100_000


def accuracy(rows: DataFrame, right: Column, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """items and accuracy by each grouping set, in one pass."""
    own = rows.withColumn("_right", right.cast("double"))
    return own.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("_right"), 4).alias("accuracy"))


def consistency(samples: DataFrame, item: str, right: Column) -> DataFrame:
    """Sampled accuracy, and the mean over items of the share of the commoner outcome."""
    p = samples.groupBy(item).agg(F.avg(right.cast("double")).alias("p"))
    return p.agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("p"), 4).alias("accuracy"), F.round(F.avg(F.greatest("p", 1 - F.col("p"))), 4).alias("consistency"))


def perplexity(losses: DataFrame, by: list[str], loss: Column, tokens: Column, chars: Column) -> DataFrame:
    """exp of the summed loss by token, and the loss by character; null where there are none."""
    own = losses.groupBy(*by).agg(F.sum(loss).alias("l"), F.sum(tokens).alias("t"), F.sum(chars).alias("c"))
    return own.select(*by, F.round(F.exp(F.try_divide("l", "t")), 4).alias("perplexity"), F.round(F.try_divide("l", "c"), 6).alias("loss_per_char"))


def pass_rates(tries: DataFrame, problem: str, passed: Column, valid: Column) -> DataFrame:
    own = tries.groupBy(problem).agg(F.avg(passed.cast("double")).alias("p1"), F.bool_or(passed).alias("pk"), F.avg(valid.cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    return own.agg(F.round(F.avg("p1"), 4).alias("pass_1"), F.round(F.avg(F.col("pk").cast("double")), 4).alias("pass_k"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 4).alias("valid"))


def pair_accuracy(pairs: DataFrame, kind: str, right: Column) -> DataFrame:
    """'a/n' by kind."""
    own = pairs.groupBy(kind).agg(F.sum(F.coalesce(right, F.lit(False)).cast("int")).alias("a"), F.count(F.lit(1)).alias("n"))
    return own.select(kind, F.format_string("%d/%d", "a", "n").alias("right"))


def word_f1(answers: DataFrame, references: DataFrame, id: str) -> DataFrame:
    """F1 of word multisets; both have (id, w: array of words)."""
    count = lambda d, c: d.select(id, F.explode("w").alias("w")).groupBy(id, "w").agg(F.count(F.lit(1)).alias(c))
    shared = count(answers, "a").join(count(references, "b"), [id, "w"]).groupBy(id).agg(F.sum(F.least("a", "b")).alias("s"))
    sizes = answers.select(id, F.size("w").alias("na")).join(references.select(id, F.size("w").alias("nb")), id)
    return sizes.join(shared, id, "left").select(id, F.round(F.coalesce(F.try_divide(2 * F.coalesce("s", F.lit(0)), F.col("na") + F.col("nb")), F.lit(0.0)), 4).alias("f1"))


def smoothed(rows: DataFrame, by: list[str], order: str, value: str, keep: float = 0.98, chunk: int = 10_000) -> DataFrame:
    """Exponential moving average at the end of each group's series, begun by its first value. It is a sum of values weighted
    by powers of their distance from the end; distances are counted in chunks of the order (a whole number), plus the rows of
    the chunks after, so a long series is many tasks."""
    own = rows.select(*by, F.col(order).alias("_o"), F.col(value).alias("_v"), F.floor(F.col(order) / chunk).alias("_c"))
    counts = own.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(*by).orderBy(F.desc("_c"))
    after = counts.select(*by, "_c", F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_after"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    inside = F.row_number().over(Window.partitionBy(*by, "_c").orderBy(F.desc("_o"))) - 1
    placed = own.withColumn("_r", inside).join(after, [*by, "_c"]).withColumn("_r", F.col("_r") + F.col("_after"))
    weight = F.pow(F.lit(keep), F.col("_r")) * F.when(F.col("_r") == F.col("_all") - 1, 1.0).otherwise(1 - keep)
    return placed.groupBy(*by).agg(F.round(F.sum(weight * F.col("_v")), 6).alias("smoothed"))


def early_stop(rows: DataFrame, by: list[str], order: str, value: str, patience: int, tolerance: float = 1e-4, chunk: int = 10_000) -> DataFrame:
    """Best step and the step at which training stops: `patience` (1 or more) evaluations in a row without a gain of more than
    the tolerance. Rows of equal order go by value; rows without order come first, a missing value is no gain.

    A gain is always a value below all before it. Such records, few in a noisy series, are found in chunks of the order (a
    whole number) and the least values of the chunks before, so a long series is many tasks; only records are folded."""
    if patience < 1:
        raise ValueError("patience must be 1 or more")
    key = F.struct(F.lit(0).alias("_one"), *by)
    own = rows.select(*by, F.col(order).alias("_o"), F.col(value).alias("_v"), F.coalesce(F.floor(F.col(order) / chunk), F.lit(-(1 << 62))).alias("_c"))
    own = own.withColumn("_k", key)
    earlier = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = own.groupBy("_k", "_c").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_m"))
    chunks = chunks.select("_k", "_c", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.min("_m").over(earlier).alias("_least"))
    inside = Window.partitionBy("_k", "_c").orderBy("_o", "_v")
    placed = own.withColumns({"_r": F.row_number().over(inside), "_m": F.min("_v").over(inside.rowsBetween(Window.unboundedPreceding, -1))}).join(chunks, ["_k", "_c"])
    record = F.col("_v") < F.least(F.lit(float("inf")), "_m", "_least")
    placed = cluster.materialize(placed.select("_k", "_o", (F.col("_r") + F.col("_before")).alias("_at"), "_v", record.alias("_record")), "series")
    rises = F.when(F.col("_record"), F.struct(F.col("_at").alias("at"), F.col("_o").cast("long").alias("o"), F.col("_v").cast("double").alias("v")))
    groups = placed.groupBy("_k").agg(F.array_sort(F.collect_list(rises)).alias("s"), F.max("_at").alias("n"))
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(float("inf")).alias("best"), none.alias("o"), F.lit(0).cast("long").alias("at"), none.alias("stop"))

    def step(a, x):
        late = x["at"] - a["at"] > patience
        gain = F.struct(x["v"].alias("best"), x["o"].alias("o"), x["at"].alias("at"), none.alias("stop"))
        stop = F.struct(a["best"].alias("best"), a["o"].alias("o"), a["at"].alias("at"), (a["at"] + patience).alias("stop"))
        return F.when(a["stop"].isNotNull() | ~(x["v"] < a["best"] - tolerance), a).when(late, stop).otherwise(gain)

    done = groups.withColumn("d", F.aggregate("s", start, step))
    end = F.when(F.col("n") - F.col("d.at") >= patience, F.col("d.at") + patience)
    done = cluster.materialize(done.select("_k", F.col("d.o").alias("best_step"), F.struct("_k", F.coalesce("d.stop", end).alias("at")).alias("_stop")), "stops")
    rows_at = placed.select(F.struct("_k", F.col("_at").alias("at")).alias("_stop"), F.col("_o").cast("long").alias("stop_step"))
    stops = rows_at.join(cluster.small(done.where("_stop.at is not null").select("_stop"), BROADCAST_SERIES), "_stop")
    return done.join(stops, "_stop", "left").select(*[F.col(f"_k.{c}").alias(c) for c in by], "best_step", "stop_step")


def projected_targets(logits: DataFrame, by: list[str], k: int, temperature: float) -> DataFrame:
    """Mass of the k largest tokens after softmax with a temperature, added up by target token and normalised. Rows
    have by, token, target (null: no counterpart) and logit."""
    w = Window.partitionBy(*by)
    own = logits.withColumn("_m", F.max("logit").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("logit"), "token")))
    own = own.withColumn("_e", F.exp((F.col("logit") - F.col("_m")) / temperature)).where((F.col("_r") <= k) & F.col("target").isNotNull())
    mass = own.groupBy(*by, "target").agg(F.sum("_e").alias("e"))
    return mass.select(*by, "target", F.round(F.col("e") / F.sum("e").over(w), 6).alias("p"))


def improved(ledger: DataFrame) -> DataFrame:
    """Each version beside its parent: changes in items right, and whether it is promoted (more right, perplexity within
    three per cent, no loss on the probe)."""
    parent = ledger.select(F.col("version").alias("parent"), F.col("accuracy").alias("pa"), F.col("probe").alias("pp"), F.col("perplexity").alias("px"))
    own = ledger.join(parent, "parent", "left")
    gain, probe = F.bround((F.col("accuracy") - F.col("pa")) * F.col("items")).cast("long"), F.bround((F.col("probe") - F.col("pp")) * F.col("probe_items")).cast("long")
    ok = F.coalesce((gain > 0) & (probe >= 0) & (F.col("perplexity") <= 1.03 * F.col("px")), F.lit(True))
    return own.select("version", "parent", gain.alias("gain"), probe.alias("probe_gain"), ok.alias("promote"))


def next_version(versions: DataFrame, name: str) -> DataFrame:
    """Highest minor number and the next name by major number, of names like v1.2."""
    major, minor = F.regexp_extract(name, r"^v?(\d+)\.", 1).cast("int"), F.regexp_extract(name, r"\.(\d+)$", 1).cast("int")
    own = versions.groupBy(major.alias("major")).agg(F.max(minor).alias("minor"))
    return own.select("major", "minor", F.format_string("v%d.%d", "major", F.col("minor") + 1).alias("next"))


def python_compiles(c: Column) -> Column:
    """Whether a block of Python source parses; it is never run."""

    @F.pandas_udf("boolean")
    def check(texts):
        import ast

        def one(t):
            try:
                ast.parse(t)
                return True
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False

        return texts.map(one, na_action="ignore")

    return check(c)

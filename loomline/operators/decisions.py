"""State changes over append logs, routing, failover and small decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PHASES = ["understand", "plan", "implement", "test", "analyze", "fix", "review", "done"]


def review(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Apply decisions (key, action: approve | reject | edit, text): an edit rejects the old record and adds a new one with a
    link to it. Adds `state` and `edited_from`; undecided rows are pending."""
    own = rows.join(decisions.select(key, "action", F.col("text").alias("_new")), key, "left")
    state = F.when(F.col("action") == "approve", "approved").when(F.col("action").isin("reject", "edit"), "rejected").otherwise("pending")
    kept = own.select(*rows.columns, state.alias("state"), F.lit(None).cast("string").alias("edited_from"))
    edited = own.where("action = 'edit'").select(*[F.col("_new").alias("text") if c == "text" else F.concat(F.col(c).cast("string"), F.lit("+")).alias(c) if c == key else F.col(c) for c in rows.columns], F.lit("approved").alias("state"), F.col(key).cast("string").alias("edited_from"))
    return kept.withColumn(key, F.col(key).cast("string")).unionByName(edited)


def activate(ledger: DataFrame, version: str) -> DataFrame:
    """One version becomes active; the one that was is previous."""
    return ledger.withColumn("status", F.when(F.col("version") == version, "active").when(F.col("status") == "active", "previous").otherwise(F.col("status")))


def backfill(ledger: DataFrame, probe: str, fresh: Column, ruler: str, now: str) -> DataFrame:
    """Recompute a nested metric; the old one is kept as <probe>_v1 only if it was measured by another ruler."""
    old = F.when(F.col(f"{probe}.ruler") != now, F.col(probe))
    return ledger.withColumn(f"{probe}_v1", old).withColumn(probe, F.col(probe).withField("value", fresh).withField(ruler, F.lit(now)))


def route(candidates: DataFrame, question: Column, order: str, known: DataFrame) -> DataFrame:
    """Generated candidates by status; known questions are skipped, and of equal questions the first wins."""
    own = candidates.withColumn("_q", question).join(known.select(F.col("q").alias("_q")).distinct(), "_q", "left_anti")
    first = F.row_number().over(Window.partitionBy("_q").orderBy(order)) == 1
    return own.withColumn("_first", first).where("_first").drop("_q", "_first")


def failover(*answers: Column) -> Column:
    """The first answer that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(a), F.lit("")) for a in answers])


def task_outcomes(steps: DataFrame, by: str) -> DataFrame:
    """From steps (by, action, ok): verified if a test or command passed, failed if one failed and none passed, open if there
    was none."""
    check = F.col("action").isin("test", "command")
    own = steps.groupBy(by).agg(F.bool_or(check & F.col("ok")).alias("_ok"), F.bool_or(check).alias("_any"))
    return own.select(by, F.when(F.col("_ok"), "verified").when(F.col("_any"), "failed").otherwise("open").alias("outcome"))


def next_phase(phase: Column, ok: Column) -> Column:
    """analyze goes on to fix or, if all is well, to review; fix goes back to test; else the next of the list."""
    at = F.array_position(F.array(*map(F.lit, PHASES)), phase).cast("int")
    following = F.element_at(F.array(*map(F.lit, PHASES)), F.least(at + 1, F.lit(len(PHASES))))
    return F.when((phase == "analyze") & ok, "review").when(phase == "fix", "test").when(at > 0, following)


def arguments(call: Column) -> Column:
    """Map of the key="value" pairs of a call; of a key that is named more than once, the last value counts."""
    p = F.lit(r'(\w+)="([^"]*)"')
    keys, values = F.regexp_extract_all(call, p, F.lit(1)), F.regexp_extract_all(call, p, F.lit(2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["k"]))
    return F.map_from_entries(last)


def progress(log: DataFrame, by: str, order: str, step: Column, seconds: Column, total: int) -> DataFrame:
    """Steps per second since the row before, and the seconds left."""
    w = Window.partitionBy(by).orderBy(order)
    own = log.withColumns({"_s": step, "_t": seconds})
    rate = F.try_divide(F.col("_s") - F.lag("_s").over(w), F.col("_t") - F.lag("_t").over(w))
    return own.withColumn("rate", rate).withColumn("left", F.try_divide(total - F.col("_s"), F.col("rate"))).drop("_s", "_t")


def evict(cache: DataFrame, by: str, order: str, keep: int) -> DataFrame:
    return cache.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= keep).drop("_r")


def growth(old: Column, new: Column) -> Column:
    """Which old layer each of `new` layers starts from, evenly spaced."""
    return F.transform(F.sequence(F.lit(0), new - 1), lambda i: F.floor(i * old / new).cast("int"))


#: Words of a problem that are tags, and tags of file extensions.
TAG_WORDS = ["discount", "desconto", "sketch", "pytest", "async", "rag", "permission"]
TAG_FILES = {".py": "python", ".cs": "csharp"}
MOST_TAGS = 12


def tags(problem: Column, files: Column) -> Column:
    """Tags of an entry by words of its problem and by its files' extensions, each once, in this order."""
    low = F.lower(F.coalesce(problem, F.lit("")))
    words = F.filter(F.array(*map(F.lit, TAG_WORDS)), lambda w: low.contains(w))

    def kind(name):
        out = F.lit(None).cast("string")
        for end, tag in TAG_FILES.items():
            out = F.when(name.endswith(end), tag).otherwise(out)
        return out

    named = F.filter(F.transform(F.coalesce(files, F.array().cast("array<string>")), kind), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(F.concat(words, named)), 1, MOST_TAGS)


def usage(used: DataFrame, version: str, id: str, block: int) -> DataFrame:
    """Which ids a version was made of: arrays of the ids of each block of whole numbers, so that no row has them all."""
    own = used.groupBy(version, F.floor(F.col(id) / block).alias("block")).agg(F.array_sort(F.collect_list(id)).alias("ids"))
    return own.select(version, "block", "ids")


def soft_cross_entropy(rows: DataFrame, by: list[str], target: Column, logit: Column, temperature: float) -> DataFrame:
    """Mean over positions of -sum(target * log softmax(logit / T)) * T * T."""
    w = Window.partitionBy(*by)
    own = rows.withColumns({"_p": target, "_l": logit / temperature})
    own = own.withColumn("_m", F.max("_l").over(w)).withColumn("_z", F.log(F.sum(F.exp(F.col("_l") - F.col("_m"))).over(w)) + F.col("_m"))
    return own.groupBy(*by).agg((-F.sum(F.col("_p") * (F.col("_l") - F.col("_z"))) * temperature**2).alias("loss"))


def relative_due(c: Column, now: Column) -> Column:
    """'in N minutes | hours | days' or 'tomorrow at HH' counted from now; null otherwise."""
    n = F.regexp_extract(c, r"(?i)\bin (\d{1,4}) (minute|hour|day)s?\b", 1).try_cast("int")
    unit = F.lower(F.regexp_extract(c, r"(?i)\bin (\d{1,4}) (minute|hour|day)s?\b", 2))
    seconds = n * F.when(unit == "minute", 60).when(unit == "hour", 3600).otherwise(86400)
    at = F.regexp_extract(c, r"(?i)\btomorrow at (\d{1,2})\b", 1).try_cast("int")
    tomorrow = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", now)) + 86400 + at * 3600)
    return F.when(n.isNotNull(), F.timestamp_seconds(F.unix_seconds(now) + seconds)).when(at.between(0, 23), tomorrow)


def set_insert(items: Column, new: Column, norm) -> Column:
    """Append unless an item with the same normal form is there."""
    return F.when(F.exists(items, lambda x: norm(x) == norm(new)), items).otherwise(F.concat(items, F.array(new)))


def set_delete(items: Column, old: Column, norm) -> Column:
    return F.filter(items, lambda x: norm(x) != norm(old))


def model_line(parameters: Column) -> Column:
    return F.when(parameters < 10_000_000, "nano").when(parameters < 100_000_000, "small").when(parameters < 1_000_000_000, "base").otherwise("large")


def batch_plan(memory_gb: Column) -> Column:
    """Struct (batch, accumulate) by memory, for a constant effective batch of 64."""
    batch = F.when(memory_gb >= 40, 64).when(memory_gb >= 20, 32).when(memory_gb >= 10, 16).otherwise(8)
    return F.struct(batch.alias("batch"), (F.lit(64) / batch).cast("int").alias("accumulate"))

"""Quality gate of question and answer pairs: mandatory, conditional and style checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import scalars as sc
from loomline.functions import text as tx
from loomline.operators import evaluation, similarity

#: Fixed values of the gate.
MAX_QUESTION, MAX_ANSWER, APPROVED = 140, 220, 0.75
IDENTITIES = r"\b(qwen|alibaba|openai|chatgpt|gpt-?\d|anthropic|claude|llama|meta ai|assistente (de ia |virtual )?(criado|desenvolvido)|modelo de linguagem)\b"
CODE_LINE = r"^(def |for |if |while |class |import |from |with |try:|print\(|[a-zA-Z_]\w*\s*=[^=])"
CODE_MORE = r"^([ \t]|else|elif|except|finally)"


def code_block(c: Column) -> Column:
    """The first run of lines of Python in a text, if it has two lines or more, else null."""
    lines = F.split(c, "\n", -1)
    start = F.array_position(F.transform(lines, lambda x: x.rlike(CODE_LINE)), True).cast("int")
    rest = F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: x.rlike(CODE_LINE) | x.rlike(CODE_MORE)), False).cast("int")
    n = F.when(end > 0, end - 1).otherwise(F.size(rest))
    return F.when((start > 0) & (n >= 2), F.array_join(F.slice(rest, F.lit(1), n), "\n"))


def prose(c: Column) -> Column:
    """A text without its lines of code."""
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~x.rlike(CODE_LINE) & ~x.startswith(" ")), "\n")


def seems(c: Column, own: list[str], other: list[str]) -> Column:
    """Fewer than four words, or at least as many of `own` as of `other`."""
    ws = tx.tokens(c, tx.WORD)
    count = lambda listed: F.size(F.filter(ws, lambda w: w.isin(*listed)))
    return (F.size(ws) < 4) | (count(own) >= count(other))


def calculation_right(m: Column, answer: Column) -> Column:
    """Whether the answer has the result of a calculation (scalars.arithmetic of the question) among its whole numbers. Null if
    there is none, it divides by zero, or has no whole result."""
    a, b = m["a"], m["b"]
    whole = F.when(m["op"] == "/", F.when((b != 0) & (F.try_mod(a, b) == 0), F.try_divide(a, b).cast("long"))).when(m["op"] == "*", a * b).when(m["op"] == "+", a + b).when(m["op"] == "-", a - b)
    numbers = F.regexp_extract_all(F.replace(answer, F.lit("."), F.lit("")), F.lit(r"-?\d+"), F.lit(0))
    return F.when(whole.isNotNull(), F.array_contains(numbers, whole.cast("string")))


def gate(pairs: DataFrame, frozen: DataFrame, known: DataFrame, language: Column | None = None, fact: Column | None = None, check_facts: bool = True, max_question: int = MAX_QUESTION, max_answer: int = MAX_ANSWER) -> DataFrame:
    """pairs (id, question, answer, factual) with problems, verified, quality and status.

    Twelve checks are mandatory (eleven without check_facts, which is for pairs written by hand), among them that no frozen
    text (id, text) is like the question and that it is not among the known ones (n: normalised). Three count only where
    they apply: a calculation's result, a fact (`fact`: null where there is none to check) and code that parses. Quality
    is 0.7 of the share of these and 0.3 of the share of three style checks. A pair that fails a check is rejected; one
    that is factual and was not verified, or has too little quality, goes to review. Null texts count as empty.
    """
    q, a = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("question", "answer"))
    own = pairs.withColumns({"_q": q, "_a": a, "_id": F.col("id").cast("string")})
    fixed = frozen.select(F.col("id").cast("string").alias("id"), "text")
    leaks = similarity.contaminated(own.select(F.col("_id").alias("id"), F.col("_q").alias("text")), fixed, 0.85).select(F.col("id").alias("_id"), F.lit(True).alias("_leak"))
    seen = known.select(F.col("n").alias("_n")).distinct().withColumn("_seen", F.lit(True))
    own = own.withColumn("_n", tx.normalize(F.col("_q"))).join(seen, "_n", "left").join(leaks, "_id", "left")
    own = own.withColumn("_code", evaluation.python_compiles(code_block(F.col("_a"))))
    # one step after the other, so that the plan computes each once
    own = own.withColumns({"_na": tx.normalize(F.col("_a")), "_m": sc.arithmetic(F.col("_n")), "_fact": F.lit(None).cast("boolean") if fact is None or not check_facts else fact})
    own = own.withColumns({"_w": tx.words(F.col("_na")), "_sums": calculation_right(F.col("_m"), F.col("_a")) if check_facts else F.lit(None).cast("boolean")})
    q, a, n = F.col("_q"), F.col("_a"), F.col("_na")
    mandatory = [
        ("empty", (q != "") & (a != "")),
        ("long_question", F.length(q) <= max_question),
        ("long_answer", F.length(a) <= max_answer),
        ("short_answer", F.length(a) >= 2),
        ("script", ~F.concat(q, a).rlike(tx.CJK)),
        ("language", F.lit(True) if language is None else F.coalesce(language, F.lit(False))),
        *([("identity", ~n.rlike(IDENTITIES))] if check_facts else []),
        ("artefact", ~a.contains("<|") & ~a.contains("�")),
        ("echo", F.col("_n") != n),
        ("repetitive", ~tx.repetitive(F.col("_w"), 0.35)),
        ("contaminated", F.col("_leak").isNull()),
        ("duplicate", F.col("_seen").isNull()),
    ]
    conditional = [("calculation", F.col("_sums")), ("fact", F.col("_fact")), ("code", F.col("_code"))]
    own = own.withColumns({f"_c{i}": x for i, (_, x) in enumerate(mandatory)})
    checks = [(k, F.col(f"_c{i}")) for i, (k, _) in enumerate(mandatory)] + conditional
    style = [F.length(a) <= 160, a.rlike(r"^[\p{Lu}\d]"), a.rlike(r"[.!?)\"]$") | a.contains("\n")]
    passed = sum((F.coalesce(x, F.lit(False)).cast("int") for _, x in checks), F.lit(0))
    total = sum((x.isNotNull().cast("int") for _, x in conditional), F.lit(len(mandatory)))
    problems = F.array_compact(F.array(*[F.when(~x, name) for name, x in checks]))
    own = own.select(*pairs.columns, problems.alias("problems"), F.coalesce("_fact", "_sums").alias("verified"), F.round(0.7 * (passed / total) + 0.3 * (sum((x.cast("int") for x in style), F.lit(0)) / 3), 3).alias("quality"))
    unsure = (F.coalesce(F.col("factual"), F.lit(False)) & F.col("verified").isNull()) | (F.col("quality") < APPROVED)
    return own.withColumn("status", F.when(F.size("problems") > 0, "rejected").when(unsure, "review").otherwise("approved"))

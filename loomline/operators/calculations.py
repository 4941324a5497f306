"""Arithmetic in texts: expressions of any nesting, and calculations in words.

Words become an expression by column functions; expressions are evaluated a batch at a time. A batch is cut into tokens in one
pass. Every operator has a strength, its precedence plus that of the brackets around it; in each round all operators that are
stronger than both neighbours are applied at once, over all expressions of the batch, as array operations. So a batch takes
as many rounds as its deepest expression, whatever its number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline import cluster
from loomline.functions import scalars
from loomline.functions import text as tx

cluster.ship_by_value(__name__)

#: Precedence of operators; a sign binds less than the power on its right, and more than a product.
BINARY = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "**": 4}
SIGN, CALL, BRACKET = 3, 5, 8
OPERATORS = [*BINARY, "neg", "pos"]
FUNCTIONS = ["sqrt", "raiz", "sen", "cos", "tan", "log", "ln", "abs"]
#: Larger exponents are refused.
MOST_EXPONENT = 100
#: Longer expressions in words are refused.
MOST_CHARS = 120
OPERAND, TWO, ONE = 0, 1, 2

#: Words before a calculation, and words for operators.
ASKED = r"^(quanto (e|da|fica|vale)|calcula|calcule|conta|resultado de|qual (e )?o resultado de)\s*:?\s*"
PERCENT = r"^([\d.,]+)\s*(%|por ?cento) de ([\d.,]+)$"
ROOT = r"^(?:a )?raiz (?:quadrada )?de ([\d.,]+)$"
POWER = r"^([\d.,]+) (?:elevado|elevada) (?:a|ao|na) ([\d.,]+)$"
CALCULATES = r"\d\s*([-+*/x×÷^]|mais|menos|vezes|dividido)\s*\(?-?\d|raiz|sqrt|\bsen\b|\bcos\b"
WORDS = [(r"\bmais\b", "+"), (r"\bmenos\b", "-"), (r"\bvezes\b", "*"), (r"\bdividido por\b", "/"), (r"(?<=\d)\s*[x×]\s*(?=[\d(])", "*"), ("÷", "/"), (r"\^", "**"), (r"\braiz de\b", "raiz"),
         (r"(\d)\.(\d{3})(?!\d)", "$1$2"), (r"(\d),(\d)", "$1.$2"), (r"raiz\s*(\d+(?:\.\d+)?)", "raiz($1)"), ("=", "")]


def tokens(texts: list):
    """(expression, kind, code, number, strength) of all tokens of a batch as arrays, brackets left out, and the expressions
    that are none."""
    import re

    import numpy as np

    token = re.compile(r"(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?)|([a-z]\w*)|(\*\*|//|[-+*/%()])|(\S)")
    rows, wrong = [], np.zeros(len(texts), bool)
    for r, t in enumerate(texts):
        begin, depth, open_, call = len(rows), 0, True, False  # open_: an operand must follow; call: a bracket must
        for number, name, op, _ in token.findall(t) if t else ():
            if call and op != "(":
                break
            call = False
            if number or name == "pi":
                # a whole number has no zeros in front
                if not open_ or number.isdigit() and number[0] == "0" and number.strip("0"):
                    break
                rows.append((r, OPERAND, 0, float(number) if number else np.pi, 0))
                open_ = False
            elif name in FUNCTIONS and open_:
                rows.append((r, ONE, len(OPERATORS) + FUNCTIONS.index(name), 0.0, depth * BRACKET + CALL))
                call = True
            elif op == "(" and open_:
                depth += 1
            elif op == ")" and not open_ and depth:
                depth -= 1
            elif op in ("+", "-") and open_:
                rows.append((r, ONE, OPERATORS.index("neg" if op == "-" else "pos"), 0.0, depth * BRACKET + SIGN))
            elif op in BINARY and not open_:
                rows.append((r, TWO, OPERATORS.index(op), 0.0, depth * BRACKET + BINARY[op]))
                open_ = True
            else:
                break
        else:
            if not open_ and not depth and not call:
                continue
        wrong[r] = True
        del rows[begin:]
    cols = list(zip(*rows)) or [()] * 5
    return [np.array(c, k) for c, k in zip(cols, (np.int64, np.int8, np.int8, np.float64, np.int64))], wrong


def one_by_one(f):
    """f, a function of the C library, of each value; NaN where it has none. numpy's own powers, logarithms and angles differ in
    the last digits from processor to processor, which a tangent of large numbers makes another result."""
    import math

    import numpy as np

    def of(*values):
        try:
            return f(*values)
        except (ValueError, OverflowError):
            return math.nan

    return lambda *arrays: np.array([of(*values) for values in zip(*(x.tolist() for x in arrays))], np.float64)


def apply_two(code, a, b):
    import math

    import numpy as np

    out = np.full(len(a), np.nan)
    for op, f in (("+", np.add), ("-", np.subtract), ("*", np.multiply), ("/", np.divide), ("//", np.floor_divide), ("%", np.mod), ("**", one_by_one(math.pow))):
        at = code == OPERATORS.index(op)
        out[at] = f(a[at], b[at])
    out[((code == OPERATORS.index("/")) | (code == OPERATORS.index("//")) | (code == OPERATORS.index("%"))) & (b == 0)] = np.nan
    out[(code == OPERATORS.index("**")) & (np.abs(b) > MOST_EXPONENT)] = np.nan
    out[~(np.isfinite(out) & np.isfinite(a) & np.isfinite(b))] = np.nan  # also nan ** 0
    return out


def apply_one(code, a):
    import math

    import numpy as np

    degrees = lambda f: lambda x: one_by_one(f)(np.radians(x))
    out = np.full(len(a), np.nan)
    every = {"neg": np.negative, "pos": np.positive, "sqrt": np.sqrt, "raiz": np.sqrt, "sen": degrees(math.sin), "cos": degrees(math.cos), "tan": degrees(math.tan), "log": one_by_one(math.log10), "ln": one_by_one(math.log), "abs": np.abs}
    for i, name in enumerate([*OPERATORS, *FUNCTIONS]):
        if name in every:
            at = code == i
            out[at] = every[name](a[at])
    out[~np.isfinite(out)] = np.nan
    return out


def evaluate(texts: list):
    """Values of the expressions in doubles; NaN for what is none, or has no finite real value."""
    import numpy as np

    (row, kind, code, value, strength), wrong = tokens(texts)
    power = OPERATORS.index("**")
    with np.errstate(all="ignore"):
        while len(row):
            n = len(row)
            shift = lambda x, k, none: np.concatenate([x[k:], np.full(min(k, n), none)]) if k > 0 else np.concatenate([np.full(min(-k, n), none), x[:k]])  # noqa: B023, E731
            operand_next = (shift(kind, 1, -1) == OPERAND) & (shift(row, 1, -1) == row)
            after = np.where(shift(row, 2, -1) == row, shift(strength, 2, -1), -1)
            before = np.where(shift(row, -2, -1) == row, shift(strength, -2, -1), -1)
            right = code == power
            two = (kind == TWO) & operand_next & ((after < strength) | (after == strength) & ~right) & ((before < strength) | (before == strength) & right)
            one = (kind == ONE) & operand_next & (after < strength)
            at = np.flatnonzero(two)
            made, pre = apply_two(code[at], value[at - 1], value[at + 1]), np.flatnonzero(one)
            value[pre], kind[pre] = apply_one(code[pre], value[pre + 1]), OPERAND
            value[at - 1] = made
            stays = np.ones(n, bool)
            stays[at] = stays[at + 1] = stays[pre + 1] = False
            if stays.all():
                break
            row, kind, code, value, strength = (x[stays] for x in (row, kind, code, value, strength))
    out = np.full(len(texts), np.nan)
    out[row] = value
    out[wrong | (np.bincount(row, minlength=len(texts)) != 1) | ~np.isfinite(out)] = np.nan
    return out


def value_of(expression: Column) -> Column:
    """The value of an expression of numbers, + - * / // % **, brackets, pi and functions (angles in degrees), in doubles.
    Null for what is no expression, a division by zero, an exponent over 100, and where a step has no finite real value."""

    @F.arrow_udf("double")
    def run(batch):
        import numpy as np
        import pyarrow as pa

        out = evaluate(batch.to_pylist())
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return run(expression)


def expression_of(question: Column) -> Column:
    """The expression that a question in words asks for, or null if it asks for none."""
    t = F.regexp_replace(F.btrim(tx.normalize(question), F.lit(" ?!.")), ASKED, "")
    number = lambda p, i: scalars.parse_decimal_comma(F.regexp_extract(t, p, i)).cast("string")
    plain = lambda x: F.lower(x)  # exponents of ten in lower case
    expr = t
    for pattern, by in WORDS:
        expr = F.regexp_replace(expr, pattern, by)
    expr = F.trim(expr)
    spoken = F.when(t.rlike(r"\d") & t.rlike(CALCULATES) & expr.rlike(r"^[\d\s.+\-*/%()a-z]+$") & (F.length(expr) <= MOST_CHARS), expr)
    return (F.when(t.rlike(PERCENT), F.concat(plain(number(PERCENT, 1)), F.lit(" * "), plain(number(PERCENT, 3)), F.lit(" / 100")))
            .when(t.rlike(ROOT), F.concat(F.lit("raiz("), plain(number(ROOT, 1)), F.lit(")")))
            .when(t.rlike(POWER), F.concat(plain(number(POWER, 1)), F.lit(" ** "), plain(number(POWER, 2))))
            .otherwise(spoken))


def answered(df, question: str):
    """df with expression, value and error: 'division by zero' where an expression without a value divides by a zero."""
    own = df.withColumn("expression", expression_of(F.col(question)))
    own = own.withColumn("value", value_of(F.col("expression")))
    return own.withColumn("error", F.when(F.col("value").isNull() & F.col("expression").rlike(r"/\s*0(?!\.\d)"), "division by zero"))

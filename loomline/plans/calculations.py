"""Expressions and calculations in words, over the numbers of the tables."""

from pyspark.sql import functions as F

from loomline.functions import scalars as sc
from loomline.operators import calculations as ca
from loomline.plans.registry import query


@query("expression_values", "SELECT l_orderkey, l_linenumber, round((-pow(l_quantity + l_discount, 2) * l_extendedprice / (3 - l_tax) - fmod(floor(l_extendedprice / 7), l_linenumber) + sqrt(l_quantity) * abs(-l_discount) + pow(2, -l_linenumber)) * pi(), 3) AS value, NULL::DOUBLE AS refused FROM lineitem")
def expression_values(t):
    s = {c: F.lower(F.col(f"l_{c}").cast("string")) for c in ("quantity", "discount", "extendedprice", "tax", "linenumber")}
    expr = F.concat(F.lit("(-("), s["quantity"], F.lit(" + "), s["discount"], F.lit(")**2*"), s["extendedprice"], F.lit("/(3 - "), s["tax"], F.lit(") - "), s["extendedprice"], F.lit("//7 % "), s["linenumber"],
                    F.lit(" + sqrt("), s["quantity"], F.lit(")*abs(-"), s["discount"], F.lit(") + ((2))**-"), s["linenumber"], F.lit(") * pi"))
    refused = F.concat(s["quantity"], F.lit(" / ("), s["linenumber"], F.lit(" - "), s["linenumber"], F.lit(")"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(ca.value_of(expr), 3).alias("value"), ca.value_of(refused).alias("refused"))


@query("spoken_calculations", """WITH o AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS v, o_orderkey % 8 AS kind FROM orders)
SELECT k AS o_orderkey, round(CASE kind WHEN 0 THEN (k % 97) * v / 100 WHEN 1 THEN sqrt(k) WHEN 2 THEN pow(k % 50, k % 7) WHEN 3 THEN v + k * 3 WHEN 6 THEN (k + 2.5::DOUBLE) * 4 - v END, 4) AS value, CASE WHEN kind = 4 THEN 'division by zero' END AS error FROM o""")
def spoken_calculations(t):
    k, v = F.col("o_orderkey"), sc.format_decimal_comma(F.round("o_totalprice", 2))
    plain, shown = k.cast("string"), sc.format_decimal_comma(k)
    asked = [F.concat(F.lit("Quanto é "), (k % 97).cast("string"), F.lit("% de "), v, F.lit("?")), F.concat(F.lit("raiz quadrada de "), shown),
             F.concat((k % 50).cast("string"), F.lit(" elevado a "), (k % 7).cast("string")), F.concat(F.lit("quanto é "), v, F.lit(" mais "), plain, F.lit(" vezes 3")),
             F.concat(plain, F.lit(" / 0?")), F.lit("2 elevado a 101"), F.concat(F.lit("Calcule: ("), plain, F.lit(" + 2,5) * 4 - "), v), F.lit("me fala sobre o brasil")]
    question = F.element_at(F.array(*asked), (k % 8 + 1).cast("int"))
    own = ca.answered(t("orders").select("o_orderkey", question.alias("question")), "question")
    return own.select("o_orderkey", F.round("value", 4).alias("value"), "error")

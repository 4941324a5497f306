"""Scalar functions over the star schema and generated rows."""

from pyspark.sql import functions as F

from loomline.functions import scalars as sc
from loomline.plans.registry import query


@query("date_functions", "SELECT o_orderkey, ['monday','tuesday','wednesday','thursday','friday','saturday','sunday'][isodow(o_orderdate)::INT] AS weekday, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS days_until, strftime(o_orderdate::DATE + INTERVAL 14 DAY, '%Y-%m-%d') AS in_two_weeks, lower(strftime(o_orderdate, '%B')) AS month, strftime(o_orderdate::DATE + INTERVAL 1 YEAR, '%Y-%m-%d') AS next_year FROM orders")
def date_functions(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", sc.weekday_name(d).alias("weekday"), F.datediff(F.lit("2000-01-01").cast("date"), d).alias("days_until"), F.date_format(F.date_add(d, 14), "yyyy-MM-dd").alias("in_two_weeks"), sc.month_name(d).alias("month"), F.date_format(F.add_months(d, 12), "yyyy-MM-dd").alias("next_year"))


@query("date_parse", """WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_orderkey % 8 AS kind FROM orders),
n AS (SELECT *, try_cast('2026-' || strftime(d, '%m-%d') AS DATE) AS this, try_cast('2027-' || strftime(d, '%m-%d') AS DATE) AS then_ FROM o)
SELECT k AS o_orderkey, CASE kind WHEN 0 THEN strftime(CASE WHEN this < DATE '2026-09-27' THEN then_ ELSE this END, '%Y-%m-%d') WHEN 1 THEN '20' || strftime(d, '%y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%Y-%m-%d')
WHEN 4 THEN strftime(CASE WHEN this < DATE '2026-09-27' THEN then_ ELSE this END, '%Y-%m-%d') WHEN 6 THEN ['2026-12-25', '2027-01-01', '2026-12-31', '2026-10-12'][k % 4 + 1] END AS day FROM n""")
def date_parse(t):
    """Days written in several ways from the dates of orders; kinds 5 and 7 are none."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    holidays = F.element_at(F.array(*map(F.lit, ["no Natal", "Ano novo", "Réveillon", "dia das crianças"])), (k % 4 + 1).cast("int"))
    day, named = F.dayofmonth(d).cast("string"), F.lower(sc.month_name(d))
    shown = [F.date_format(d, "dd/MM"), F.date_format(d, "d/M/yy"), F.date_format(d, "dd/MM/yyyy"), F.concat_ws(" ", day, named, F.year(d).cast("string")), F.concat_ws(" of ", day, named), F.lit("soon"), holidays, F.lit("31/02/2026")]
    o = t("orders").select("o_orderkey", F.element_at(F.array(*shown), (k % 8 + 1).cast("int")).alias("text"))
    return o.select("o_orderkey", F.date_format(sc.parse_day(F.col("text"), F.lit("2026-09-27").cast("date")), "yyyy-MM-dd").alias("day"))


@query("tz_convert", "SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo', '%Y-%m-%d %H:%M') AS sp, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H:%M') AS tokyo, CASE WHEN hour(ts) >= 5 AND hour(ts) < 12 THEN 'morning' WHEN hour(ts) >= 12 AND hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part FROM events")
def tz_convert(t):
    local = lambda z: F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(z), F.col("ts")), "yyyy-MM-dd HH:mm")
    return t("events").select("event_id", local("America/Sao_Paulo").alias("sp"), local("Asia/Tokyo").alias("tokyo"), sc.greeting(F.hour("ts")).alias("part"))


@query("number_format_br", r"SELECT o_orderkey, regexp_replace(translate(printf('%,.4f', o_totalprice), ',.', '.,'), ',?0+$', '') AS shown, round(o_totalprice, 4) AS parsed FROM orders")
def number_format_br(t):
    shown = sc.format_decimal_comma(F.col("o_totalprice"))
    return t("orders").select("o_orderkey", shown.alias("shown"), F.round(sc.parse_decimal_comma(shown), 4).alias("parsed"))


@query("unit_convert", "SELECT l_orderkey, l_linenumber, round(l_quantity * 0.001::DOUBLE / 0.0254::DOUBLE, 6) AS inches, round(l_quantity * 0.45359237::DOUBLE / 1.0::DOUBLE, 6) AS kilos, round((l_quantity - 32) * 5 / 9, 6) AS celsius, NULL::DOUBLE AS nothing FROM lineitem")
def unit_convert(t):
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(sc.convert(q, "mm", "in"), 6).alias("inches"), F.round(sc.convert(q, "lb", "kg"), 6).alias("kilos"), F.round(sc.convert(q, "f", "c"), 6).alias("celsius"), sc.convert(q, "kg", "m").alias("nothing"))


@query("unit_names", "SELECT p_partkey, round(p_size * CASE p_partkey % 5 WHEN 0 THEN 1000.0::DOUBLE WHEN 1 THEN 3.785411784::DOUBLE WHEN 2 THEN 24.0::DOUBLE WHEN 3 THEN (1 / 3.6::DOUBLE) END, 6) AS converted FROM part")
def unit_names(t):
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 5 + 1).cast("int"))
    made = sc.convert_named(F.col("p_size"), pick("Toneladas", "galão", "dias", "km/h", "kg"), pick("kg", "litros", "horas", "m/s", "metros"))
    return t("part").select("p_partkey", F.round(made, 6).alias("converted"))


@query("intent_classify", r"WITH c AS (SELECT conv_id, turn, lower(text) AS x FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(x, '^\s*(hi|hello|hey|good (morning|evening))\b') THEN 'greeting' WHEN regexp_matches(x, '\b(thanks|thank you)\b') THEN 'thanks' WHEN regexp_matches(x, '\bwho are you\b') THEN 'identity' WHEN regexp_matches(x, '\b(help|how do i)\b') THEN 'help' WHEN regexp_matches(x, '\?\s*$') THEN 'question' WHEN length(trim(x)) < 15 THEN 'short' ELSE 'statement' END AS intent, CASE WHEN (contains(x,'find') OR contains(x,'search') OR contains(x,'source') OR contains(x,'compare')) AND (contains(x,'function') OR contains(x,'code') OR contains(x,'class') OR contains(x,'bug')) AND (contains(x,'test') OR contains(x,'check') OR contains(x,'verify')) THEN 'pipeline' WHEN (contains(x,'find') OR contains(x,'search') OR contains(x,'source') OR contains(x,'compare')) AND (contains(x,'function') OR contains(x,'code') OR contains(x,'class') OR contains(x,'bug')) THEN 'research_code' WHEN (contains(x,'find') OR contains(x,'search') OR contains(x,'source') OR contains(x,'compare')) THEN 'research' WHEN (contains(x,'test') OR contains(x,'check') OR contains(x,'verify')) THEN 'test' WHEN (contains(x,'function') OR contains(x,'code') OR contains(x,'class') OR contains(x,'bug')) THEN 'code' ELSE 'general' END AS route FROM c")
def intent_classify(t):
    return t("conversations").select("conv_id", "turn", sc.intent(F.col("text")).alias("intent"), sc.route(F.col("text")).alias("route"))


PHRASES = ["Até amanhã", "muito obrigado", "Você é muito legal", "Estou tão cansado", "Como você está", "quem te criou", "suas funções", "Olá", "vamos conversar", "eai", "nada"]
TALK = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in sc.SMALL_TALK.items())
SAID = "CASE conv_id % 11 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"


@query("small_talk", rf"WITH c AS (SELECT conv_id, turn, strip_accents(lower(trim({SAID} || CASE WHEN turn > 0 THEN ' ' || text ELSE '' END))) AS x FROM conversations), d AS (SELECT *, regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+') AS ws FROM c) SELECT conv_id, turn, CASE {TALK} WHEN len(ws) <= 2 AND list_has_any(ws, {sc.SHORT_GREETINGS}) THEN 'greeting' END AS intent FROM d")
def small_talk(t):
    said = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("conv_id") % 11 + 1).cast("int"))
    said = F.concat(said, F.when(F.col("turn") > 0, F.concat(F.lit(" "), "text")).otherwise(""))
    return t("conversations").select("conv_id", "turn", sc.small_talk(said).alias("intent"))


@query("lr_schedule", "SELECT event_id, round(CASE WHEN s < 100 THEN 0.001::DOUBLE * (s + 1) / 100 ELSE 0.001::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(3.141592653589793::DOUBLE * least(1.0::DOUBLE, (s - 100) / 900.0::DOUBLE)))) END, 9) AS cosine, round(CASE WHEN s < 100 THEN 0.001::DOUBLE * (s + 1) / 100 WHEN s < 800 THEN 0.001::DOUBLE ELSE 0.001::DOUBLE * greatest(0::DOUBLE, (1000 - s) / 200.0::DOUBLE) END, 9) AS stable, CASE WHEN s / 1000.0::DOUBLE < 1.0::DOUBLE / 3 THEN 0 WHEN s / 1000.0::DOUBLE < 2.0::DOUBLE / 3 THEN 1 ELSE 2 END AS third FROM (SELECT event_id, event_id % 1000 AS s FROM events)")
def lr_schedule(t):
    s = F.col("event_id") % 1000
    return t("events").select("event_id", F.round(sc.cosine_rate(s, 0.001, 100, 1000), 9).alias("cosine"), F.round(sc.stable_rate(s, 0.001, 100, 1000), 9).alias("stable"), sc.curriculum_step(s / 1000.0).alias("third"))


@query("exercise_gen", "WITH e AS (SELECT i::BIGINT AS id, (i * 7919 + 13) % 100 AS a, (i * 104729 + 7) % 50 + 1 AS b, i % 4 AS k FROM (SELECT p_partkey AS i FROM part)) SELECT id, a || ' ' || ['+', '-', '*', '/'][k + 1] || ' ' || b AS question, round(CASE k WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN a * b ELSE a::DOUBLE / b END::DOUBLE, 6) AS answer FROM e")
def exercise_gen(t):
    i = F.col("id")
    e = t("part").select(F.col("p_partkey").alias("id")).select("id", ((i * 7919 + 13) % 100).alias("a"), ((i * 104729 + 7) % 50 + 1).alias("b"), F.element_at(F.array(*map(F.lit, "+-*/")), (i % 4 + 1).cast("int")).alias("op"))
    return e.select("id", F.concat_ws(" ", F.col("a").cast("string"), "op", F.col("b").cast("string")).alias("question"), F.round(sc.result_of(F.col("op"), F.col("a"), F.col("b")), 6).alias("answer"))


EXERCISES = """WITH p AS (SELECT p_partkey AS id, p_partkey * 7919 + 13 AS ra, p_partkey * 104729 + 7 AS rb, p_partkey * 15485863 + 3 AS rc FROM part),
x AS (SELECT id, id % 12 AS k, ra % 998 + 2 AS a, rb % 998 + 2 AS b, ra, rb, rc FROM p)
SELECT id, k::BIGINT AS kind, round(CASE k WHEN 0 THEN a + b WHEN 1 THEN abs(a - b) WHEN 2 THEN (ra % 98 + 2) * (rb % 98 + 2) WHEN 3 THEN (ra % 10 + 1) * (rb % 10 + 1) WHEN 4 THEN rc % 99 + 1 WHEN 5 THEN (a % 20 * 5) * b / 100.0::DOUBLE WHEN 6 THEN round(a / 25.4::DOUBLE, 2)
  WHEN 7 THEN (a % 23 + 1) * 60 + b % 60 WHEN 8 THEN a * 1000 WHEN 9 THEN a % 50 + 1 WHEN 10 THEN a % 30 + 2 ELSE ((a % 89 + 2) * (b % 11 + 2) // 10 + 1) * 10 - (a % 89 + 2) * (b % 11 + 2) END::DOUBLE, 2) AS answer,
CASE k WHEN 4 THEN rb % 29 + 2 WHEN 9 THEN b % 11 + 2 END::BIGINT AS divisor FROM x"""


@query("exercises", EXERCISES)
def exercises(t):
    """Solved exercises of twelve kinds by part; the answer is read back from the text."""
    i = F.col("p_partkey")
    own = t("part").select(i.alias("id"), (i % 12).alias("kind"), sc.exercise(i % 12, i * 7919 + 13, i * 104729 + 7, i * 15485863 + 3).alias("e"))
    shown = sc.parse_decimal_comma(F.regexp_extract("e.text", r"(-?[\d.]+(?:,\d+)?)\D*$", 1))
    kept = F.when(F.round("e.answer", 2) == F.round(shown, 2), F.round("e.answer", 2))
    return own.select("id", "kind", kept.alias("answer"), "e.divisor")


RAW = ["1", " Yes ", "off", "maybe", "TRUE", "nao"]


@query("env_flags", "SELECT event_id, event_id % 6 IN (0, 1, 4) AS flag FROM events")
def env_flags(t):
    return t("events").select("event_id", sc.as_bool(F.element_at(F.array(*map(F.lit, RAW)), (F.col("event_id") % 6 + 1).cast("int"))).alias("flag"))


@query("ruler_gate", "SELECT o_orderkey, after <= before * (1 + 0.03::DOUBLE) AS ok, round(after / before - 1, 4) AS change FROM (SELECT o_orderkey, o_totalprice AS before, o_totalprice * (1 + (o_orderkey % 70) / 1000.0::DOUBLE) AS after FROM orders)")
def ruler_gate(t):
    after = F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 70) / 1000.0)
    return t("orders").select("o_orderkey", sc.gate(F.col("o_totalprice"), after).alias("g")).select("o_orderkey", "g.ok", F.round("g.change", 4).alias("change"))


@query("string_tasks", "SELECT p_partkey, reverse(p_name) AS backwards, array_to_string(list_sort(regexp_split_to_array(lower(p_name), '')), '') AS letters, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS vowels, array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), '') AS initials FROM part")
def string_tasks(t):
    n = F.col("p_name")
    return t("part").select("p_partkey", F.reverse(n).alias("backwards"), F.array_join(F.array_sort(F.filter(F.split(F.lower(n), ""), lambda c: c != "")), "").alias("letters"), F.regexp_count(n, F.lit("[aeiou]")).alias("vowels"), F.array_join(F.transform(F.split(n, " "), lambda w: F.substring(w, 1, 1)), "").alias("initials"))

"""Numbers, units, dates, schedules and decision tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import text as tx

#: Factors to the base unit of each dimension.
UNITS = {
    "mm": ("length", 0.001), "cm": ("length", 0.01), "m": ("length", 1.0), "km": ("length", 1000.0), "in": ("length", 0.0254), "ft": ("length", 0.3048), "mi": ("length", 1609.344),
    "g": ("mass", 0.001), "kg": ("mass", 1.0), "t": ("mass", 1000.0), "lb": ("mass", 0.45359237),
    "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0), "day": ("time", 86400.0), "week": ("time", 604800.0),
    "l": ("volume", 1.0), "ml": ("volume", 0.001), "gal": ("volume", 3.785411784), "m/s": ("speed", 1.0), "km/h": ("speed", 1 / 3.6), "mph": ("speed", 0.44704), "b": ("data", 1.0), "kb": ("data", 1024.0), "mb": ("data", 1048576.0),
}
#: Other names of units, without accents.
UNIT_NAMES = {
    "mm": ["milimetro", "milimetros"], "cm": ["centimetro", "centimetros"], "m": ["metro", "metros"], "km": ["quilometro", "quilometros"],
    "in": ["pol", "polegada", "polegadas"], "ft": ["pe", "pes"], "mi": ["milha", "milhas"], "g": ["grama", "gramas"], "kg": ["quilo", "quilos"],
    "t": ["tonelada", "toneladas"], "lb": ["libra", "libras"], "ml": ["mililitro", "mililitros"], "l": ["litro", "litros"], "gal": ["galao", "galoes"],
    "s": ["seg", "segundo", "segundos"], "min": ["minuto", "minutos"], "h": ["hora", "horas"], "day": ["dia", "dias"], "week": ["semana", "semanas"],
}
#: Named days as (month, day).
HOLIDAYS = {"natal": (12, 25), "ano novo": (1, 1), "reveillon": (12, 31), "dia das criancas": (10, 12)}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def parse_decimal_comma(c: Column) -> Column:
    """'1.234,5' is 1234.5; '2.380' is 2380; '3.5' is 3.5. Null if it is no number."""
    own = F.when(c.contains(","), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(c.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.replace(c, F.lit("."), F.lit(""))).otherwise(c)
    return own.try_cast("double")


def format_decimal_comma(c: Column) -> Column:
    """Four decimals at most, without trailing zeros; points between thousands, a comma before decimals."""
    full = F.translate(F.format_number(c, 4), ",.", ".,")
    return F.regexp_replace(full, r",?0+$", "")


def convert(value: Column, unit: str, to: str) -> Column:
    """Between units of one dimension; temperatures by their own formulas. Null across dimensions."""
    if {unit, to} <= {"c", "f", "k"}:
        celsius = {"c": value, "f": (value - 32) * 5 / 9, "k": value - 273.15}[unit]
        return {"c": celsius, "f": celsius * 9 / 5 + 32, "k": celsius + 273.15}[to]
    if UNITS[unit][0] != UNITS[to][0]:
        return F.lit(None).cast("double")
    return value * UNITS[unit][1] / UNITS[to][1]


def unit_of(name: Column) -> Column:
    """Code of a unit by its code or one of its names, whatever case and accents; null if unknown."""
    known = {n: u for u in UNITS for n in [u, *UNIT_NAMES.get(u, [])]}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.try_element_at(table, tx.normalize(name))


def convert_named(value: Column, unit: Column, to: Column) -> Column:
    """As convert, for columns of unit names; temperatures apart. Null for unknown units and across dimensions."""
    of = lambda i: F.create_map(*[F.lit(x) for u, v in UNITS.items() for x in (u, v[i])])
    a, b = unit_of(unit), unit_of(to)
    at = lambda i, u: F.try_element_at(of(i), u)
    return F.when(at(0, a) == at(0, b), value * at(1, a) / at(1, b))


def arithmetic(c: Column) -> Column:
    """Struct (op, a, b) of the first 'a op b' of a text; a <= b where the order does not matter. Null if there is none."""
    p = r"(?i)(\d{1,9})\s*(x|\*|vezes|mais|\+|menos|-|dividido por|/)\s*(\d{1,9})"
    a, op, b = F.regexp_extract(c, p, 1).try_cast("long"), F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 3).try_cast("long")
    op = F.lower(op)
    op = F.when(op.isin("x", "vezes"), "*").when(op == "mais", "+").when(op == "menos", "-").when(op == "dividido por", "/").otherwise(op)
    free = op.isin("+", "*")
    return F.when(a.isNotNull(), F.struct(op.alias("op"), F.when(free, F.least(a, b)).otherwise(a).alias("a"), F.when(free, F.greatest(a, b)).otherwise(b).alias("b")))


def result_of(op: Column, a: Column, b: Column) -> Column:
    return F.when(op == "+", (a + b).cast("double")).when(op == "-", (a - b).cast("double")).when(op == "*", (a * b).cast("double")).when((op == "/") & (b != 0), a / F.when(b != 0, b))


def weekday_name(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(c) + 1)


def month_name(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(c))


def parse_day(c: Column, today: Column) -> Column:
    """'dd/mm', 'dd/mm/yy', 'dd/mm/yyyy' or 'd month [yyyy]'; without a year the next such day. Null if invalid."""
    d, m, y = (F.regexp_extract(c, r"^(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?$", i) for i in (1, 2, 3))
    p = r"(?i)^(\d{1,2})(?: of)? (" + "|".join(MONTHS) + r")(?: (\d{4}))?$"
    named = F.regexp_extract(c, p, 2)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(named)).cast("int")
    day = F.coalesce(d.try_cast("int"), F.regexp_extract(c, p, 1).try_cast("int"))
    month = F.coalesce(m.try_cast("int"), F.when(named != "", number))
    year = F.coalesce(y.try_cast("int"), F.regexp_extract(c, p, 3).try_cast("int"))
    year = F.when(year < 100, year + 2000).otherwise(year)
    made = lambda yy: F.try_to_date(F.format_string("%04d-%02d-%02d", yy, month, day))
    this = made(F.year(today))
    named_days = F.lit(None).cast("date")
    for name, (mm, dd) in reversed(HOLIDAYS.items()):
        next_one = F.make_date(F.year(today), F.lit(mm), F.lit(dd))
        next_one = F.when(next_one >= today, next_one).otherwise(F.make_date(F.year(today) + 1, F.lit(mm), F.lit(dd)))
        named_days = F.when(tx.normalize(c).contains(name), next_one).otherwise(named_days)
    return F.when(day.isNull() | month.isNull(), named_days).when(year.isNotNull(), made(year)).when(this < today, made(F.year(today) + 1)).otherwise(this)


def greeting(hour: Column) -> Column:
    return F.when((hour >= 5) & (hour < 12), "morning").when((hour >= 12) & (hour < 18), "afternoon").otherwise("evening")


def cosine_rate(step: Column, peak: float, warmup: int, total: int, least: float = 0.1) -> Column:
    """Learning rate: linear warm-up, then a cosine down to a share of the peak."""
    t = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(peak * (least + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * t))))


def stable_rate(step: Column, peak: float, warmup: int, total: int, decay: float = 0.2) -> Column:
    """Learning rate: warm-up, stable, and a linear decay over the last share of the steps."""
    begin = int(total * (1 - decay))
    return F.when(step < warmup, peak * (step + 1) / warmup).when(step < begin, F.lit(peak)).otherwise(peak * F.greatest(F.lit(0.0), (total - step) / float(total - begin)))


def curriculum_step(share: Column) -> Column:
    """Third of the run."""
    return F.when(share < 1 / 3, 0).when(share < 2 / 3, 1).otherwise(2)


def gate(before: Column, after: Column, tolerance: float = 0.03) -> Column:
    """Struct (ok, change): a loss-like metric may rise by the tolerance."""
    return F.struct((after <= before * (1 + tolerance)).alias("ok"), F.bround(after / before - 1, 4).alias("change"))


def as_bool(c: Column, default: bool = False) -> Column:
    own = F.lower(F.trim(c))
    return F.when(own.isin("1", "true", "yes", "on", "sim"), True).when(own.isin("0", "false", "no", "off", "nao"), False).otherwise(F.lit(default))


def intent(c: Column) -> Column:
    """First fitting class of a message, most specific first."""
    own = F.lower(c)
    table = [("greeting", r"^\s*(hi|hello|hey|good (morning|evening))\b"), ("thanks", r"\b(thanks|thank you)\b"), ("identity", r"\bwho are you\b"), ("help", r"\b(help|how do i)\b"), ("question", r"\?\s*$")]
    out = F.when(F.lit(False), "")
    for name, p in table:
        out = out.when(own.rlike(p), name)
    return out.when(F.length(F.trim(own)) < 15, "short").otherwise("statement")


#: Classes of small talk in order, by a pattern over lower case without accents.
SMALL_TALK = {
    "farewell": r"\b(tchau|ate mais|ate logo|falou|fui|ate amanha|boa noite fui dormir|encerrar por hoje)\b",
    "gratitude": r"\b(obrigado|obrigada|valeu|muito obrigado|valeu demais|agradeco|agradecido|show de bola|top demais|voce me ajudou muito|mandou bem)\b",
    "compliment": r"\b(voce e (muito |demais )?(inteligente|boa|bom|legal|foda|fera|incrivel|rapida|eficiente)|adorei voce|gostei de voce)\b",
    "user_feeling": r"\b((estou|to) (muito |bem |tao |super )?(cansado|cansada|feliz|triste|animado|animada|estressado|estressada|com sono|exausto|exausta)|hoje o dia foi (puxado|dificil|longo)|muito trabalho)\b",
    "wellbeing": r"\b(como vai|como ce ta|tudo bem|tudo bom|como\s+(?:(?:voce|vc|ce)\s+)?(?:esta|ta|vai)|como vao as coisas|tudo joia|tudo certo|beleza)\b",
    "identity": r"\b(quem e (voce|vc)|qual (o )?seu nome|quem te (criou|fez|desenvolveu)|qual (e )?(o )?seu proposito|qual sua missao|sua historia)\b",
    "capabilities": r"\b(o que (voce|vc) (faz|sabe fazer|pode fazer)|quais (sao )?(as )?suas habilidades|como (voce|vc) pode me ajudar|suas funcoes|suas capacidades)\b",
    "greeting": r"\b(oi|ola|opa|e ai|salve|hey|hello|hi|fala ai|bom dia|boa tarde|boa noite)\b",
    "casual_chat": r"\b(vamos conversar|bater um papo|trocar uma ideia|me conta algo|o que (voce|vc) acha|conversa comigo|conta uma piada)\b",
}
SHORT_GREETINGS = ["oi", "ola", "opa", "eai", "salve", "hey", "hi"]


def small_talk(c: Column) -> Column:
    """First fitting class of SMALL_TALK, else greeting for one or two words with a short greeting, else null."""
    own = tx.strip_accents(F.lower(F.trim(c)))
    out = F.when(F.lit(False), "")
    for name, p in SMALL_TALK.items():
        out = out.when(own.rlike(p), name)
    ws = F.regexp_extract_all(own, F.lit(tx.WORD), F.lit(0))
    return out.when((F.size(ws) <= 2) & F.exists(ws, lambda w: w.isin(*SHORT_GREETINGS)), "greeting")


def route(c: Column) -> Column:
    """Task by keywords; pairs of kinds before single kinds."""
    own = F.lower(c)
    kinds = {"research": ["find", "search", "source", "compare"], "code": ["function", "code", "class", "bug"], "test": ["test", "check", "verify"]}
    has = {k: F.exists(F.array(*map(F.lit, ws)), lambda w: own.contains(w)) for k, ws in kinds.items()}
    return F.when(has["research"] & has["code"] & has["test"], "pipeline").when(has["research"] & has["code"], "research_code").when(has["research"], "research").when(has["test"], "test").when(has["code"], "code").otherwise("general")


def short_number(c: Column) -> Column:
    """Two decimals at most, without trailing zeros; points between thousands, a comma before decimals."""
    return F.regexp_replace(F.translate(F.format_number(c.cast("double"), 2), ",.", ".,"), r",?0+$", "")


def exercise(kind: Column, a: Column, b: Column, c: Column) -> Column:
    """Struct (text, answer, divisor): a solved exercise of one of twelve kinds, from three whole numbers not below 0. The text
    ends with its answer."""
    n, most = short_number, F.greatest
    x, y, two, three = a % 998 + 2, b % 998 + 2, (a % 98 + 2, b % 98 + 2), (a % 10 + 1, b % 10 + 1)
    by, times, rest = b % 29 + 2, c % 99 + 1, a % (b % 29 + 2)
    share, hours, minutes = x % 20 * 5, x % 23 + 1, y % 60
    root, factor, k, plus = x % 30 + 2, x % 50 + 1, y % 11 + 2, c % 100
    price, count = x % 89 + 2, y % 11 + 2
    paid = (F.floor(price * count / 10) + 1) * 10
    made = [
        (F.concat(n(x), F.lit(" + "), n(y), F.lit(" = "), n(x + y)), x + y, None),
        (F.concat(n(most(x, y)), F.lit(" - "), n(F.least(x, y)), F.lit(" = "), n(F.abs(x - y))), F.abs(x - y), None),
        (F.concat(n(two[0]), F.lit(" × "), n(two[1]), F.lit(" = "), n(two[0] * two[1])), two[0] * two[1], None),
        (F.concat(n(three[0]), F.lit(" × "), n(three[1]), F.lit(" = "), n(three[0] * three[1])), three[0] * three[1], None),
        (F.concat(n(by * times + rest), F.lit(" ÷ "), n(by), F.lit(", resto "), n(rest), F.lit(": "), n(times)), times, by),
        (F.concat(n(share), F.lit("% de "), n(y), F.lit(" = "), n(share * y / 100.0)), share * y / 100.0, None),
        (F.concat(n(x), F.lit(" mm em polegadas: "), n(F.round(x / 25.4, 2))), F.round(x / 25.4, 2), None),
        (F.concat(n(hours), F.lit(" h e "), n(minutes), F.lit(" min em minutos: "), n(hours * 60 + minutes)), hours * 60 + minutes, None),
        (F.concat(n(x), F.lit(" km em metros: "), n(x * 1000)), x * 1000, None),
        (F.concat(n(k), F.lit("x + "), n(plus), F.lit(" = "), n(k * factor + plus), F.lit(": x = "), n(factor)), factor, k),
        (F.concat(F.lit("raiz de "), n(root * root), F.lit(" = "), n(root)), root, None),
        (F.concat(n(count), F.lit(" itens de "), n(price), F.lit(", pago "), n(paid), F.lit(", troco "), n(paid - price * count)), paid - price * count, None),
    ]
    out = F.lit(None)
    for i, (text, answer, divisor) in reversed(list(enumerate(made))):
        one = F.struct(text.alias("text"), answer.cast("double").alias("answer"), (F.lit(None) if divisor is None else divisor).cast("long").alias("divisor"))
        out = F.when(kind == i, one).otherwise(out)
    return out

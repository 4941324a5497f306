"""URL filtering by empirical-Bayes host reputation.

Pages labelled good or bad are counted by host. A host's good rate has a beta prior centred on its registered domain's
rate, which is itself shrunk to its public suffix, and that to the rate over all pages; each level's prior strength is
fitted by moments of the beta-binomial law over the level's own members. A host is blocked if even the upper bound of its
posterior (mean plus Z standard deviations) is under LEAST, so a host with no or few labels is allowed.

Listed rules come first: the longest rule whose host and path fit decides.

Outcomes are the rows of `labels` whose doc_id is the page's id: good is quality 1 without toxic. The registered domain is
the suffix and one label more; suffixes are the last label or, if listed in SUFFIXES, the last two.

Defined cases: null urls and urls without :// have an empty host and path, which is a host like any other; a null label
counts as bad only if toxic is 1; repeated page rows are judged each, labels of a page count once a label row; hosts
without labels take the prior; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import cluster

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Public suffixes of two labels that are told apart, unless a caller names its own list.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za"]
LEAST, Z = 0.6, 1.645
#: Bounds of a level's prior strength.
WEAK, STRONG = 1.0, 1000.0


def parts(url):
    """Host and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    ascii_low = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(ascii_low, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host, path):
    """(rule, verdict) of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def levels(host, suffixes=SUFFIXES):
    """Public suffix and registered domain of a host."""
    last2 = F.substring_index(host, ".", -2)
    two = last2.isin(list(suffixes))
    suffix = F.when(two, last2).otherwise(F.substring_index(host, ".", -1))
    return suffix, F.when(two, F.substring_index(host, ".", -3)).otherwise(last2)


def strength(members: DataFrame) -> float:
    """The prior strength s of a level from members with n > 0, good and prior mean m. The variance of good / n is
    m (1 - m) (1 / n + (1 - 1 / n) / (s + 1)); solved by sums over the members, which come down to one number."""
    spread = F.sum("n") - F.count(F.lit(1))
    excess = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), F.lit(2)) - F.col("m") * (1 - F.col("m")))
    scale = F.sum((F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    spread, excess, scale = members.where("n > 0").agg(spread, excess, scale).first()
    if not spread or not scale or scale <= 0 or excess <= 0:
        return STRONG
    return min(max(scale / excess - 1, WEAK), STRONG)


def reputation(outcomes: DataFrame, two_label=SUFFIXES) -> DataFrame:
    """host, mean and sd of the posterior from outcomes: one row a host with n and good (0 where unlabelled)."""
    suffix, domain = levels(F.col("host"), two_label)
    hosts = outcomes.select("host", suffix.alias("suffix"), domain.alias("domain"), F.col("n").cast("double").alias("n"), F.col("good").cast("double").alias("good"))
    good, n = hosts.agg(F.sum("good"), F.sum("n")).first()
    sums = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    mean = lambda s: (s * F.col("m") + F.col("good")) / (s + F.col("n"))
    top = sums("suffix").withColumn("m", F.lit(((good or 0) + 1) / ((n or 0) + 2)))
    suffixes = top.select("suffix", mean(strength(top)).alias("m"))
    # a suffix may have most of the domains, and a domain most of the hosts, so they are looked up
    pairs = sums("suffix", "domain")
    uses, n_pairs = pairs.groupBy("suffix").agg(F.count(F.lit(1)).alias("uses")), pairs.count()
    middle = cluster.materialize(cluster.lookup(pairs, suffixes.join(uses, "suffix"), "suffix", "uses", n_pairs, F.col("domain")), "domains")
    domains = middle.select("domain", mean(strength(middle)).alias("m"))
    uses, n_hosts = hosts.groupBy("domain").agg(F.count(F.lit(1)).alias("uses")), hosts.count()
    full = cluster.lookup(hosts.select("host", "domain", "n", "good"), domains.join(uses, "domain"), "domain", "uses", n_hosts, F.col("host"))
    full = cluster.materialize(full, "means")
    s = strength(full)
    own = full.select("host", "n", mean(s).alias("mean"))
    return own.select("host", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (s + F.col("n") + 1)).alias("sd"))


def judge(pages: DataFrame, labels: DataFrame, two_label=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, mean and upper (posterior mean and bound of the host) of each page. two_label: the
    public suffixes of two labels, such as a list of hosting domains whose tenants must not share a reputation."""
    host, path = parts(F.col("url").cast("string"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when((F.col("quality") == 0) | (F.col("toxic") == 1), 0).alias("good")).where("good is not null")
    marked = own.select("page_id", "host").join(marks, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    counted = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    outcomes = counted.join(marked, "host", "left").select("host", "pages", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    outcomes = cluster.materialize(outcomes, "hosts")
    known = outcomes.select("host", "pages").join(reputation(outcomes, two_label), "host")
    total = outcomes.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    upper = F.least(F.lit(1.0), F.col("mean") + Z * F.col("sd"))
    known = known.select("host", "pages", "mean", upper.alias("upper"))
    found = cluster.lookup(own, known, "host", "pages", total, F.struct("page_id", "path"))
    rule = ruled(F.col("host"), F.col("path"))
    verdict = F.coalesce(rule["verdict"], F.when(F.col("upper") < LEAST, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", rule["rule"].alias("rule"), verdict.alias("verdict"), F.round("mean", 6).alias("mean"), F.round("upper", 6).alias("upper"))


def query(spark, sf_dir):
    return judge(cluster.table(spark, sf_dir, "pages"), cluster.table(spark, sf_dir, "labels"))


_CASES = "\n".join(
    f"    WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'"
    for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)))
_BLOCKS = ", ".join(f"'{h}{p}'" for v, h, p in RULES if v == "block")
_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)
_STRENGTH = """
  SELECT least(greatest(CASE WHEN sum(n) - count(*) <= 0 THEN 1000.0 ELSE
    coalesce(CASE WHEN rho IS NULL THEN NULL WHEN rho <= 0 THEN 1000.0 ELSE 1 / rho - 1 END, 1000.0) END, 1.0), 1000.0)::DOUBLE AS s
  FROM (SELECT *, sum(n * (good / n - m) ** 2 - m * (1 - m)) OVER () / nullif(sum((n - 1) * m * (1 - m)) OVER (), 0) AS rho
        FROM {0} WHERE n > 0) GROUP BY rho
"""
SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages
), own AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), marks AS (
  SELECT doc_id AS page_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 WHEN quality = 0 OR toxic = 1 THEN 0 END AS good FROM labels
), hosts AS (
  SELECT host, CASE WHEN two THEN l2 ELSE split_part(host, '.', -1) END AS suffix,
    CASE WHEN two AND len(p) > 2 THEN array_to_string(p[-3:], '.') ELSE l2 END AS domain, n, good
  FROM (SELECT host, string_split(host, '.') AS p, array_to_string(string_split(host, '.')[-2:], '.') AS l2,
          array_to_string(string_split(host, '.')[-2:], '.') IN ({_TWO}) AS two,
          count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good
        FROM own LEFT JOIN (SELECT * FROM marks WHERE good IS NOT NULL) USING (page_id) GROUP BY host)
), root AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM hosts
), l1 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m) AS m FROM hosts, root GROUP BY suffix
), s1 AS ({_STRENGTH.format("l1")}
), p1 AS (SELECT suffix, (s * m + good) / (s + n) AS m FROM l1, (SELECT coalesce(max(s), 1000.0) AS s FROM s1)
), l2 AS (SELECT domain, sum(n) AS n, sum(good) AS good, any_value(p1.m) AS m FROM hosts JOIN p1 USING (suffix) GROUP BY domain
), s2 AS ({_STRENGTH.format("l2")}
), p2 AS (SELECT domain, (s * m + good) / (s + n) AS m FROM l2, (SELECT coalesce(max(s), 1000.0) AS s FROM s2)
), l3 AS (SELECT host, n, good, p2.m AS m FROM hosts JOIN p2 USING (domain)
), s3 AS ({_STRENGTH.format("l3")}
), p3 AS (SELECT host, n, s, (s * m + good) / (s + n) AS mean FROM l3, (SELECT coalesce(max(s), 1000.0) AS s FROM s3)
), rep AS (SELECT host, mean, least(1.0, mean + {Z}::DOUBLE * sqrt(mean * (1 - mean) / (s + n + 1))) AS upper FROM p3
), judged AS (
  SELECT page_id, host, path, CASE
{_CASES}
    END AS rule, mean, upper FROM own JOIN rep USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({_BLOCKS}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN upper < {LEAST}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict,
  round(mean, 6) AS mean, round(upper, 6) AS upper
FROM judged
"""

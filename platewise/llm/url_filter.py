"""URL filter: rules, then empirical-Bayes host reputation.

Labelled pages give outcomes (bad or not). Rates are shrunk through beta-binomial priors from all pages to the public suffix,
the registered domain and the host; each level's prior strength follows from how far its rates spread beyond binomial noise
(method of moments). A page that no rule fits is blocked if the lower posterior bound of its host's bad rate is over a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import LOWER, UPPER, cut, join_groups, table

#: (host and path, verdict); a rule fits its host and all subdomains if the path starts with the rule's path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: A host is blocked if mean - Z sd of its posterior is over LIMIT.
LIMIT, Z = 0.5, 1.645

#: Public suffixes of two labels that are told from registered domains; hand in a longer list for real hosts.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[[0-9a-f:.]*\])$"

#: Bounds of the correlation of outcomes within a host, domain or suffix; the prior's strength is 1 / rho - 1.
LEAST_RHO, MOST_RHO = 0.001, 0.999


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    found = verdict = F.lit(None).cast("string")
    for rule, kind in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def bare_host(host: Column) -> Column:
    """The host's name without user and port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), r":\d*$", "")


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix: one of ``suffixes`` (of two labels) or the last label; an address is its own."""
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(ADDRESS), bare).when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Registered domain: the public suffix and one label more, if there is one."""
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(ADDRESS), bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def reputation(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Posterior (host, mean, sd) of the bad rate from ``hosts`` (host, n, bad, ...): labelled pages and bad ones among them.

    Levels are joined by ``join_groups``, so that neither the domains of a large suffix nor the hosts of a large domain meet
    in one task.
    """
    host = F.col("host")
    levels = cut(hosts.select("host", domain_of(host, suffixes).alias("domain"), suffix_of(host, suffixes).alias("suffix"), "n", "bad"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("suffix").alias("up"), F.count("*").alias("hosts")]
    per = {"host": levels, "domain": cut(levels.groupBy("domain").agg(*sums))}
    per["suffix"] = cut(per["domain"].groupBy(F.col("up").alias("suffix")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("domains")))

    def strength(of: DataFrame) -> float:
        got = of.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("b"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s")).first()
        if not got.k:
            return 1 / LEAST_RHO - 1
        p = got.b / got.n
        room = got.n - got.nn / got.n - (got.k - 1)
        spread = (got.s - got.b * got.b / got.n) / (p * (1 - p)) if 0 < p < 1 else 0.0
        rho = (spread - (got.k - 1)) / room if room > 0 else 0.0
        return 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1

    m = {k: float(strength(v)) for k, v in per.items()}
    whole = per["suffix"].agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = ((whole.bad or 0) + 0.5) / ((whole.n or 0) + 1.0)
    shrunk = lambda prior, strength: (F.col("bad") + strength * prior) / (F.col("n") + strength)
    suffix = cut(per["suffix"].select(F.col("suffix").alias("up"), "domains", shrunk(F.lit(base), m["suffix"]).alias("up_rate")))
    domain = cut(join_groups(per["domain"], suffix, "up", "domains").select("domain", "hosts", shrunk(F.col("up_rate"), m["domain"]).alias("rate")))
    rated = join_groups(levels, domain, "domain", "hosts").withColumn("mean", shrunk(F.col("rate"), m["host"]))
    return rated.select("host", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + m["host"] + 1)).alias("sd"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = LIMIT, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row per row of ``pages``: (id_col, host, path, rule, verdict, bad_rate, bound).

    ``labels`` (doc_id, quality, toxic) is read as outcomes of the pages with the same identifier: bad if toxic or not of
    quality; null marks say nothing, several labels of a page count as bad if one is. The host is what stands after the
    first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; a url that is null or has no ``://`` has empty
    host and path, and the empty host has a reputation of its own. For its reputation a host counts without user and port
    below its registered domain (see ``suffixes``). A bound that equals the limit is allowed. Null identifiers have no label.
    Repeated rows come back as often as they came in. Other columns are not read. An empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("ident"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("of"), bad.alias("bad")).where("bad IS NOT NULL").groupBy("of").agg(F.max("bad").alias("bad"))
    marked = rows.select("ident", "host").join(outcomes, F.col("ident") == F.col("of"), "left")
    hosts = cut(marked.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    rated = cut(hosts.select("host", "pages").join(reputation(hosts, suffixes), "host"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    bound = F.col("mean") - F.lit(z) * F.col("sd")
    own = F.when(bound > limit, "block").otherwise("allow")
    return join_groups(rows, rated, "host", "pages").select(
        F.col("ident").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("mean").alias("bad_rate"), bound.alias("bound")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(name: str) -> str:
    return f"""m_{name} AS (SELECT 1 / least(0.999::DOUBLE, greatest(0.001::DOUBLE, CASE WHEN n - nn / n - (k - 1) > 0 THEN (CASE WHEN b > 0 AND b < n THEN (s - b * b / n) / (b / n * (1 - b / n)) ELSE 0 END - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0 END)) - 1 AS m
  FROM (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS b, sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS s FROM {name}s WHERE n > 0))"""


OP9_SQL = f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', '') AS bare, regexp_extract(bare, '([^.]*\\.)?[^.]*$') AS two FROM p),
o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
hosts AS (SELECT host, CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN bare WHEN two IN {SUFFIXES} THEN regexp_extract(bare, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE two END AS domain,
  CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN bare WHEN two IN {SUFFIXES} THEN two ELSE regexp_extract(bare, '[^.]*$') END AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM q LEFT JOIN o ON q.page_id = o.doc_id GROUP BY host, bare, two),
domains AS (SELECT domain, max(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain),
suffixs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix),
{_strength_sql("host")}, {_strength_sql("domain")}, {_strength_sql("suffix")},
w AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS base FROM suffixs),
s AS (SELECT suffix, (bad + m * base) / (n + m) AS rate FROM suffixs, m_suffix, w),
d AS (SELECT domain, (domains.bad + m * s.rate) / (domains.n + m) AS rate FROM domains JOIN s ON domains.suffix = s.suffix, m_domain),
h AS (SELECT host, (hosts.bad + m * d.rate) / (hosts.n + m) AS mean, hosts.n + m AS strength FROM hosts JOIN d ON hosts.domain = d.domain, m_host),
v AS (SELECT host, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (strength + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS own FROM h),
r AS (SELECT page_id, p.host, path, own, CASE
  WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p JOIN v ON p.host = v.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE own END AS verdict FROM r
"""

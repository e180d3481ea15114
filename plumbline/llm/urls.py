"""URL filter: fixed rules first, then empirical-Bayes host reputation.  DataFrame functions only.

Each labelled page is a trial of its host.  Rates are shrunk level by level:
all pages give the prior of a suffix, the suffix's posterior mean the prior of
a registered domain, the domain's the prior of a host.  The weight of each
prior is the method-of-moments concentration of the rates one level below it,
and no more than the certainty of the parent's own posterior.
A page is blocked if the upper end of its host's posterior for good pages
(mean plus ``z`` standard deviations) stays under ``least``: unknown hosts get
the benefit of the doubt.

A host with a third of all pages is one row after partial aggregation; the
join back to the pages is left to the optimiser, which may split it.

Defined results: null or other text without ``://`` has an empty host and path
and is judged as the host ``""``; a host without dots is its own domain and
suffix; equal rows get equal results; columns beside those named are ignored,
whatever their names; without any labelled page the prior mean is 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule); a rule is a host, "/" and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Posterior bound below which a host is blocked, and its distance in standard deviations.
LEAST = 0.9
Z = 1.645


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting (verdict, rule) as a struct, or null.  Of equally long ones, the first by name."""
    chain = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        chain = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(chain)
    return chain


def _weight(rows: DataFrame) -> float:
    """Beta concentration by moments, from the trials n and good k of groups with the prior mean ``prior``.

    For a beta-binomial, E[(k - n m)^2] = n m (1 - m) (1 + (n - 1) r) with
    r = 1 / (concentration + 1).
    """
    n, k, m = F.col("n"), F.col("k"), F.col("prior")
    found = rows.agg(
        F.sum((k - n * m) * (k - n * m) - n * m * (1 - m)).alias("excess"),
        F.sum(n * (n - 1) * m * (1 - m)).alias("spread"),
    ).first()
    r = found.excess / found.spread if found.spread else 0.5
    return 1 / min(max(r, 0.001), 0.999) - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """One row per host from rows (host, good); ``good`` is 1, 0 or null for unlabelled pages."""
    hosts = cut_lineage(
        outcomes.groupBy("host")
        .agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("k"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
    )

    def total(*keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrunk(rows: DataFrame) -> DataFrame:
        """Posterior mean and deviation of each row under its parent's mean."""
        # a prior is no surer than its parent is of its own rate
        own, parent = F.lit(_weight(rows)), F.col("certainty")
        weight = own * parent / (own + parent)
        a = weight * F.col("prior") + F.col("k")
        b = weight * (1 - F.col("prior")) + F.col("n") - F.col("k")
        return rows.withColumn("mean", a / (a + b)).withColumn("sure", a + b).withColumn("deviation", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))

    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    # half a good and half a bad page keep the mean inside (0, 1)
    certainty = (whole.n or 0.0) + 1
    overall = ((whole.k or 0.0) + 0.5) / certainty

    def parents(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(name, F.col("mean").alias("prior"), F.col("sure").alias("certainty"))

    by_suffix = parents(shrunk(total("suffix").withColumn("prior", F.lit(overall)).withColumn("certainty", F.lit(certainty))), "suffix")
    by_domain = parents(shrunk(total("domain", "suffix").join(by_suffix, "suffix")), "domain")
    return shrunk(hosts.join(by_domain, "domain")).select("host", "n", "k", "mean", "deviation")


def page_outcome(html: Column) -> Column:
    """1 for a page that reads like prose, 0 for symbol noise or shouting, null below 50 visible characters.

    A heuristic label; any column of 1, 0 and null can take its place.
    """
    bare = F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    visible = F.length(F.regexp_replace(bare, r"\s", ""))
    noise = F.length(F.regexp_replace(bare, "[^#%&$*|!]", ""))
    upper = F.length(F.regexp_replace(bare, "[^A-Z]", ""))
    return F.when(html.isNull() | (visible < 50), None).when((noise > 0.05 * visible) | (upper > 0.4 * visible), 0).otherwise(1)


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = LEAST, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for each page: the longest fitting rule's, else by its host's reputation."""
    url = F.col(url_col).cast("string")
    placed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    placed = placed.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    known = placed.join(reputation(outcomes), "host", "left")
    bound = F.least(F.lit(1.0), F.col("mean") + z * F.col("deviation"))
    method = F.when(bound < least, "block").otherwise("allow")
    return known.select(
        "page_id",
        "host",
        "path",
        F.col("rule.rule").alias("rule"),
        F.coalesce(F.col("rule.verdict"), method).alias("verdict"),
    )


#: DuckDB SQL of ``judged`` with the outcomes of ``page_outcome`` and the default parameters.
JUDGED_SQL = r"""
WITH bare AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS bare
  FROM pages),
placed AS (
  SELECT page_id, bare,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM bare),
graded AS (
  SELECT *, CASE WHEN length(regexp_replace(bare, '\s', '', 'g')) < 50 THEN NULL
                 WHEN length(regexp_replace(bare, '[^#%&$*|!]', '', 'g')) > 0.05 * length(regexp_replace(bare, '\s', '', 'g'))
                   OR length(regexp_replace(bare, '[^A-Z]', '', 'g')) > 0.4 * length(regexp_replace(bare, '\s', '', 'g')) THEN 0
                 ELSE CASE WHEN bare IS NULL THEN NULL ELSE 1 END END AS good
  FROM placed),
hosts AS (
  SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS k,
         array_to_string((string_split(host, '.'))[-2:], '.') AS domain, (string_split(host, '.'))[-1] AS suffix
  FROM graded GROUP BY host),
overall AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS prior, coalesce(sum(n), 0) + 1 AS c FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(prior) AS prior, any_value(c) AS c FROM hosts, overall GROUP BY suffix),
sw AS (SELECT 1 / least(greatest(coalesce(sum((k - n * prior) * (k - n * prior) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.5), 0.001), 0.999) - 1 AS w FROM s0),
s1 AS (SELECT suffix, (w * c / (w + c) * prior + k) / (w * c / (w + c) + n) AS prior, w * c / (w + c) + n AS c FROM s0, sw),
d0 AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(k) AS k, any_value(prior) AS prior, any_value(c) AS c FROM hosts JOIN s1 USING (suffix) GROUP BY domain),
dw AS (SELECT 1 / least(greatest(coalesce(sum((k - n * prior) * (k - n * prior) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.5), 0.001), 0.999) - 1 AS w FROM d0),
d1 AS (SELECT domain, (w * c / (w + c) * prior + k) / (w * c / (w + c) + n) AS prior, w * c / (w + c) + n AS c FROM d0, dw),
h0 AS (SELECT host, n, k, prior, c FROM hosts JOIN d1 USING (domain)),
hw AS (SELECT 1 / least(greatest(coalesce(sum((k - n * prior) * (k - n * prior) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.5), 0.001), 0.999) - 1 AS w FROM h0),
h1 AS (SELECT host, w * c / (w + c) * prior + k AS a, w * c / (w + c) * (1 - prior) + n - k AS b FROM h0, hw),
h2 AS (SELECT host, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS deviation FROM h1),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM placed)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
            ELSE CASE WHEN least(1.0, mean + 1.645 * deviation) < 0.9 THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled JOIN h2 USING (host)
"""

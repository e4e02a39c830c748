"""URL filtering by rules and by empirical-Bayes host reputation, DataFrame functions only.

Labelled pages are Bernoulli outcomes (bad or not) of their host. Bad rates
are shrunk down a tree, everything -> public suffix -> registered domain ->
host: each node's posterior mean is the prior mean of its children, and the
prior's strength at each level comes from the children's own spread (method
of moments for the beta-binomial). A host is blocked when the lower bound of
its posterior bad rate exceeds ``threshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
THRESHOLD, Z = 0.5, 1.645
#: Public suffixes of more than one label, a parameter; a last label is always one. The hosts at hand need none.
SUFFIXES: tuple[str, ...] = ()
#: Prior strengths stay between these; the default holds where a level shows no variance.
WEAKEST, STRONGEST, DEFAULT = 1.0, 1000.0, 10.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path in one string) and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def strength(children: DataFrame, n: str, k: str) -> DataFrame:
    """One row: the prior strength that the spread of the children's rates implies."""
    known = children.where(F.col(n) > 0)
    total = known.agg(F.sum(n).alias("all_n"), F.sum(k).alias("all_k"), F.count("*").alias("m"))
    apart = F.pow(F.col(k) / F.col(n) - F.col("all_k") / F.col("all_n"), 2) * F.col(n)
    spread = known.crossJoin(F.broadcast(total)).agg(F.sum(apart).alias("ss"), F.max("all_n").alias("all_n"), F.max("all_k").alias("all_k"), F.max("m").alias("m"))  # total has one row
    q = F.col("all_k") / F.col("all_n") * (1 - F.col("all_k") / F.col("all_n"))
    tau = F.greatest((F.col("ss") - q * (F.col("m") - 1)) / F.col("all_n"), q / STRONGEST)
    return spread.select(F.coalesce(F.round(F.when(q > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), q / tau - 1))), 6), F.lit(DEFAULT)).alias("strength"))


def last_labels(host: Column, n) -> Column:
    """The last n labels of a host, all if it has fewer."""
    labels = F.split(host, r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The longest public suffix of several labels that the host ends with, else its last label."""
    out = last_labels(host, F.lit(1))
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        own = last_labels(host, F.lit(n))
        out = F.when(own.isin([s for s in suffixes if s.count(".") + 1 == n]), own).otherwise(out)
    return out


def reputations(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """host, n, k, rate and bound from rows (host, n, k), one or more per host; n labelled pages, k of them bad.

    Hosts without labelled pages get their domain's prior. A registered
    domain is a public suffix and one label before it.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    hosts = hosts.withColumn("domain", last_labels(F.col("host"), F.size(F.split("suffix", r"\.")) + 1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    top = suffixes.agg(F.sum("sn").alias("tn"), F.sum("sk").alias("tk")).select(((F.col("tk") + 0.5) / (F.col("tn") + 1)).alias("top"))
    shrunk = lambda k, n, prior: (F.col(k) + F.col("strength") * F.col(prior)) / (F.col(n) + F.col("strength"))
    one = lambda df, x: df.crossJoin(F.broadcast(x))  # noqa: E731  x has a single row
    s = one(one(suffixes, top), strength(suffixes, "sn", "sk")).select("suffix", shrunk("sk", "sn", "top").alias("s_rate"))
    d = one(domains.join(s, "suffix"), strength(domains, "dn", "dk")).select("domain", shrunk("dk", "dn", "s_rate").alias("d_rate"))
    a = F.col("k") + F.col("strength") * F.col("d_rate")
    b = F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("d_rate"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return one(hosts.join(d, "domain"), strength(hosts, "n", "k")).select("host", "n", "k", (a / (a + b)).alias("rate"), (a / (a + b) - Z * sd).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, url_col: str = "url", rules=RULES, threshold: float = THRESHOLD, suffixes=SUFFIXES) -> DataFrame:
    """Appends host, path, rule and verdict to every page.

    ``labels`` has doc_id, quality and toxic; a page's outcome is the label
    of the document that the last number of its path names, bad if quality
    is 0 or toxic is 1 (repeated labels of a document: bad if any is; null
    ids label nothing). Repeated pages count each and each return. Of rules
    that fit, the longest wins, of equally long ones the last by spelling. A
    bound equal to the threshold doesn't block. Null urls and urls without
    ``://`` have empty host and path; very long ones are read whole. An empty
    table of pages stays empty; without labels only rules block. Columns of
    the new names in ``pages`` are replaced, all others kept as they are.
    """
    added = ("host", "path", "rule", "verdict")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in added])
    at = {c: f"own_{k}" for k, c in enumerate(pages.columns)}
    url = F.col(at[url_col])
    own = pages.toDF(*at.values()).withColumns({"host": host_of(url), "path": path_of(url)})
    bad = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("number")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    # Pages first shrink to a row per host and number, so that a host of very many pages doesn't travel.
    seen = own.groupBy("host", F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1).alias("number")).agg(F.count("*").alias("pages"))
    numbered = seen.where("number <> ''").join(bad, "number").select("host", F.col("pages").alias("n"), (F.col("pages") * F.col("bad")).alias("k"))
    every = seen.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    blocked = reputations(numbered.unionByName(every), suffixes).where(F.col("bound") > threshold).select("host", F.lit("block").alias("said"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = own.join(blocked, "host", "left").select(*at.values(), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("said"), F.lit("allow")).alias("verdict"))
    return out.toDF(*at, *added)


def oracle() -> str:
    """The same in SQL, over the tables pages and labels."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    level = lambda t, n, k: f"""(SELECT coalesce(round(CASE WHEN q > 0 THEN greatest({WEAKEST}, least({STRONGEST}, q / greatest((ss - q * (m - 1)) / N, q / {STRONGEST}) - 1)) END, 6), {DEFAULT})
        FROM (SELECT sum(power({k} / {n} - tk / tn, 2) * {n}) AS ss, max(tn) AS N, max(tk / tn * (1 - tk / tn)) AS q, count(*) AS m
              FROM {t}, (SELECT sum({n})::DOUBLE AS tn, sum({k})::DOUBLE AS tk FROM {t}) WHERE {n} > 0))"""  # noqa: E731
    return f"""
    WITH p AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
               coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
    bad AS (SELECT doc_id::VARCHAR AS number, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    h AS (
        SELECT host, sum(CASE WHEN bad IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE AS n, sum(coalesce(bad, 0))::DOUBLE AS k
        FROM p LEFT JOIN bad ON regexp_extract(path, '([0-9]+)[^0-9]*$', 1) = number GROUP BY host),
    hosts AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') AS domain,
                     string_split(host, '.')[-1] AS suffix FROM h),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
    s AS (SELECT suffix, (k + st * (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM suffixes)) / (n + st) AS s_rate FROM suffixes, (SELECT {level("suffixes", "n", "k")} AS st)),
    d AS (SELECT domain, (k + st * s_rate) / (n + st) AS d_rate FROM domains JOIN s USING (suffix), (SELECT {level("domains", "n", "k")} AS st)),
    ab AS (SELECT host, k + st * d_rate AS a, n - k + st * (1 - d_rate) AS b FROM hosts JOIN d USING (domain), (SELECT {level("hosts", "n", "k")} AS st)),
    blocked AS (SELECT host FROM ab WHERE a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {THRESHOLD})
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict FROM p"""

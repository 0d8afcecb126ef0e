"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled pages give each host a number of outcomes and of good ones. The share of good pages is
shrunk through beta-binomial priors: a suffix towards all pages, a registered domain towards its
suffix, a host towards its domain. How strongly each level shrinks comes from the spread of its groups
(the intra-class correlation of the outcomes, estimated from all of them). A page is blocked when the
upper posterior bound of its host's share stays below ``needed``; an unknown host has its domain's
share, an empty host is allowed.

Rows: one output row per page, in any order. A null url, or one without ``://``, has an empty host and
path. Hosts keep ports and user parts as they stand. Labels with a null outcome do not count; a page
or label that is repeated counts each time. Without labels every host is allowed.
Without pages there are no rows. Columns other than id and url are not read, so any may clash. The bound is
a normal approximation of the beta posterior's upper end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); a rule fits the host and its subdomains, and paths that begin with its own.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Suffixes of two labels under which names are registered; others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "org.uk")
NEEDED = 0.5
Z = 1.645
WEAKEST, STRONGEST = 1e-4, 0.99  # bounds of the intra-class correlation


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    empty = F.lit("")
    return F.coalesce(F.translate(raw, upper, upper.lower()), empty), F.coalesce(path, empty)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    parts = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    two = F.array_join(F.slice(parts, -2, 2), ".").isin(*TWO_LABEL_SUFFIXES)
    n = F.when((F.size(parts) >= 2) & two, 2).otherwise(1)

    def last(k: Column) -> Column:
        k = F.least(k, F.size(parts))
        return F.array_join(F.slice(parts, -k, k), ".")

    return last(n + 1), last(n)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits. Rules are given by
    the caller and become one expression, longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def spread(groups: DataFrame) -> DataFrame:
    """One row ``(k, m)``: prior strength and overall share, from groups ``(n, s)``.

    The intra-class correlation is the analysis-of-variance estimate; k = 1 / correlation - 1.
    """
    p = F.col("s") / F.col("n")
    sums = groups.agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * p).alias("sp"),
    )
    m = F.try_divide("s", "n")
    between = F.try_divide(F.col("sp") - F.col("s") * m, F.col("g") - 1)
    inside = F.try_divide(F.col("s") - F.col("sp"), F.col("n") - F.col("g"))
    usual = F.try_divide(F.col("n") - F.try_divide("nn", "n"), F.col("g") - 1)
    rho = F.try_divide(between - inside, between + (usual - 1) * inside)
    known = (F.col("g") > 1) & (F.col("n") > F.col("g")) & rho.isNotNull() & ~F.isnan(rho)
    rho = F.when(known, F.least(F.greatest(rho, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(0.01)
    return sums.select((1 / rho - 1).alias("k"), m.alias("m"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """``(host, n, bound)`` for every host of rows ``(host, good)``; good is 1, 0 or null (unlabelled).

    Every level is one row per group; only one-row aggregates are broadcast.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("s"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    totals = [F.sum("n").alias("n"), F.sum("s").alias("s")]
    domains = hosts.groupBy("domain", "suffix").agg(*totals)
    suffixes = domains.groupBy("suffix").agg(*totals)

    def shrunk(level: DataFrame, parent: Column) -> Column:
        return (F.col("s") + F.col("k") * parent) / (F.col("n") + F.col("k"))

    def strength(level: DataFrame) -> DataFrame:
        return F.broadcast(spread(level.where("n > 0")))  # one row

    s = suffixes.crossJoin(strength(suffixes)).withColumn("share", shrunk(suffixes, F.col("m")))
    d = domains.crossJoin(strength(domains).select("k")).join(s.select("suffix", F.col("share").alias("up")), "suffix")
    d = d.withColumn("share", shrunk(domains, F.col("up")))
    h = hosts.crossJoin(strength(hosts).select("k")).join(d.select("domain", "suffix", F.col("share").alias("up")), ["domain", "suffix"])
    share = shrunk(hosts, F.col("up"))
    sd = F.sqrt(share * (1 - share) / (F.col("n") + F.col("k") + 1))
    return h.select("host", "n", (share + Z * sd).alias("bound"))


def judge(
    pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES, needed: float = NEEDED,
) -> DataFrame:
    """One row ``(id_col, host, path, rule, verdict, n_labels, bound)`` per page.

    ``labels`` are rows ``(id, good)``, the id being that of a page. Only ids and hosts are shuffled.
    """
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    outcome = labels.select(F.col("id").alias("_l"), F.col("good").cast("long").alias("good")).where("good is not null")
    # unlabelled hosts come in with null outcomes, one row each, to get their domain's share
    labelled = own.join(outcome, own["_id"] == outcome["_l"]).select("host", "good")
    every = own.select("host").distinct().select("host", F.lit(None).cast("long").alias("good"))
    known = reputation(labelled.union(every).where("host != ''"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.join(known, "host", "left")
    bad = F.coalesce(F.col("bound") < needed, F.lit(False))
    return own.select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_labels"), F.round("bound", 6).alias("bound"),
    )


def outcomes_of(labels: DataFrame) -> DataFrame:
    """A labelled page is good when its quality is 1 and it is not toxic."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(
        F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0
    )
    return labels.select(F.col("doc_id").alias("id"), good.alias("good"))


SQL = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
v as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
             coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') as path from u),
o as (select host, (quality = 1 and toxic = 0)::bigint as good from v join labels on page_id = doc_id
      where quality is not null and toxic is not null and host != ''),
h0 as (select host, count(good) as n, coalesce(sum(good), 0)::bigint as s
       from (select * from o union all select distinct host, null from v where host != '') group by host),
h1 as (select *, string_split(regexp_replace(host, ':\d*$', ''), '.') as parts from h0),
h2 as (select *, case when len(parts) >= 2 and array_to_string(parts[-2:], '.') in ('ac.uk', 'co.in', 'co.jp', 'co.nz',
         'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.mx', 'gov.uk', 'org.uk') then 2 else 1 end as c from h1),
h as (select host, n, s, array_to_string(parts[-(c + 1):], '.') as domain, array_to_string(parts[-c:], '.') as suffix from h2),
d as (select domain, suffix, sum(n)::bigint as n, sum(s)::bigint as s from h group by all),
x as (select suffix, sum(n)::bigint as n, sum(s)::bigint as s from d group by all),
g as (select 'h' as l, n, s from h where n > 0 union all select 'd', n, s from d where n > 0
      union all select 'x', n, s from x where n > 0),
a as (select l, count(*)::double as g, sum(n)::double as n, sum(s)::double as s, sum(n * n)::double as nn,
             sum(s * (s / n))::double as sp from g group by l),
b as (select *, s / n as m, (sp - s * (s / n)) / (g - 1) as btw, (s - sp) / (n - g) as ins, (n - nn / n) / (g - 1) as us from a),
r as (select l, m, case when g > 1 and n > g and (btw + (us - 1) * ins) != 0
                   then least(greatest((btw - ins) / (btw + (us - 1) * ins), 1e-4), 0.99) else 0.01 end as rho from b),
k as (select l, m, 1 / rho - 1 as k from r),
xs as (select x.suffix, (x.s + k.k * k.m) / (x.n + k.k) as up from x, k where k.l = 'x'),
ds as (select d.domain, d.suffix, (d.s + k.k * xs.up) / (d.n + k.k) as up from d join xs using (suffix), k where k.l = 'd'),
hs as (select h.host, h.n, k.k, (h.s + k.k * ds.up) / (h.n + k.k) as share from h join ds using (domain, suffix), k where k.l = 'h'),
f as (select v.*, hs.n, share + 1.645 * sqrt(share * (1 - share) / (n + k + 1)) as bound from v left join hs using (host)),
e as (select *, case
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
  when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
  when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end as rule from f)
select page_id, host, path, rule,
       case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block'
            when bound < 0.5 then 'block' else 'allow' end as verdict,
       coalesce(n, 0)::bigint as n_labels, round(bound, 6) as bound
from e
"""

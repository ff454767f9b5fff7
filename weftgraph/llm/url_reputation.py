"""URL verdicts: rules first, then the reputation of the host.

Reputation is empirical Bayes. Outcomes of labelled pages are counted by host, combined before the shuffle. A beta prior
for suffixes is centred on the rate of all pages, one for registered domains on the posterior mean of their suffix, one
for hosts on that of their domain. The strength of each level's prior comes from how much more its rates differ than
binomial noise would make them (the method of moments). A host is blocked when the lower bound of its posterior, the
mean less z standard deviations, exceeds a rate.

A host's domain and suffix are those of its name without user, port and a last dot; an address is its own domain and suffix.

Cases: a url that is null or has no `://` has an empty host and path and is judged by the reputation of the empty host.
Pages without a label count for no outcome but are judged. Outcomes of an id that occurs twice are bad if one is. With
no labelled pages the prior rate is one half and no host is blocked. Of rules of one length the first given wins. Pages
that repeat count and are judged each; a very long url is read whole; other columns are not read, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.stage import stage

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Names under a country's code under which anyone can register: they and the code are a suffix of two labels.
SECOND = "ac|co|com|edu|go|gob|gouv|gov|ltd|mil|ne|net|nom|or|org|plc|sch"
_TWO = rf"(^|\.)({SECOND})\.[a-z][a-z]$"
_ADDRESS = r"^([0-9.]+|\[.*)$"
Z, BLOCK_RATE = 1.645, 0.3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without user, port and the dot that may end a name."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _last(host: Column, more: int) -> Column:
    name = name_of(host)
    n = F.when(name.rlike(_TWO), 2).otherwise(1) + more
    return F.when(name.rlike(_ADDRESS), name).otherwise(F.array_join(F.slice(F.split(name, r"\."), -F.least(n, F.size(F.split(name, r"\."))), n), "."))


def suffix_of(host: Column) -> Column:
    return _last(host, 0)


def domain_of(host: Column) -> Column:
    return _last(host, 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of rules of one length the first given wins."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def pick(value):
        fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), value(v, h, p)) for v, h, p in ordered]
        return reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))

    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


@dataclass
class Reputation:
    """hosts: host, n, k (labelled pages, bad ones), mean, bound. strengths: of the priors, by level."""

    hosts: DataFrame
    labelled: int
    rate: float
    strengths: dict[str, float]


def _strength(level: DataFrame, rate: Column) -> float:
    """The sum of a prior's two counts, from n, k and the parent's rate; between 1 and 999."""
    m, n, k = rate, F.col("n"), F.col("k")
    v = m * (1 - m)
    s, noise, pairs = level.agg(F.sum((k - n * m) * (k - n * m)), F.sum(n * v), F.sum(n * (n - 1) * v)).first()
    rho = 0.05 if not pairs else round(min(0.5, max(0.001, (s - noise) / pairs)), 6)
    return 1 / rho - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> Reputation:
    """pages: host, item (the id that outcomes have, or null). outcomes: item, bad (0 or 1)."""
    bad = outcomes.filter("item is not null and bad is not null").groupBy("item").agg(F.max("bad").alias("bad"))
    seen = pages.groupBy("host", "item").agg(F.count(F.lit(1)).alias("pages"))
    hosts = seen.join(bad, "item", "left").groupBy("host").agg(
        F.sum(F.when(F.col("bad").isNull(), 0).otherwise(F.col("pages"))).alias("n"), F.sum(F.coalesce(F.col("pages") * F.col("bad"), F.lit(0))).alias("k")
    )
    hosts = stage(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"), "url-hosts")
    n, k = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    rate = (k + 1) / (n + 2)

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    a = _strength(suffixes, F.lit(rate))
    suffixes = suffixes.select("suffix", ((F.col("k") + a * rate) / (F.col("n") + a)).alias("suffix_rate"))
    domains = stage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix"), "url-domains")
    b = _strength(domains, F.col("suffix_rate"))
    domains = domains.select("domain", ((F.col("k") + b * F.col("suffix_rate")) / (F.col("n") + b)).alias("domain_rate"))
    hosts = stage(hosts.join(domains, "domain"), "url-judged")
    c = _strength(hosts, F.col("domain_rate"))
    alpha, total = F.col("k") + c * F.col("domain_rate"), F.col("n") + c
    mean = alpha / total
    bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
    hosts = stage(hosts.select("host", "n", "k", mean.alias("mean"), bound.alias("bound")), "url-bounds")
    return Reputation(hosts, n, rate, {"suffix": a, "domain": b, "host": c})


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, block_rate: float = BLOCK_RATE) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, and the mean and bound of its host.

    pages: page_id, url. The number after the first folder of the path is the id that outcomes (item, bad) have.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    item = F.expr("try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') as bigint)")
    reputation = host_reputation(parts.select("host", item.alias("item")), outcomes, z)
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("bound") > block_rate) & F.lit(reputation.labelled > 0), "block").otherwise("allow")
    judged = parts.join(reputation.hosts.select("host", "mean", "bound"), "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict"), F.round("mean", 6).alias("bad_mean"), F.round("bound", 6).alias("bad_bound"))


_name = r"regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '')"


def _ends(more: int) -> str:
    last = "array_to_string(list_slice(string_split(name, '.'), -{0}, -1), '.')".format
    return f"case when regexp_matches(name, '{_ADDRESS}') then name when regexp_matches(name, '{_TWO}') then {last(2 + more)} else {last(1 + more)} end"


_fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then " for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
_by_len = sorted(RULES, key=lambda r: -len(r[1] + r[2]))


def _rho(s: str, m: str) -> str:
    v = f"({m} * (1 - {m}))"
    return f"1 / coalesce(round(least(0.5, greatest(0.001, (sum((k - n * {m}) * (k - n * {m})) - sum(n * {v})) / nullif(sum(n * (n - 1) * {v}), 0))), 6), 0.05) - 1 as {s}"


SQL = f"""
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
items as (select host, try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) as bigint) as item from parts),
bad as (select doc_id as item, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
h0 as (select host, cast(count(bad) as double) as n, cast(coalesce(sum(bad), 0) as double) as k from items left join bad using (item) group by host),
h as (select host, {_ends(1)} as domain, {_ends(0)} as suffix, n, k from (select *, {_name} as name from h0)),
r as (select (sum(k) + 1) / (sum(n) + 2) as rate from h),
s as (select suffix, sum(n) as n, sum(k) as k from h group by suffix),
sk as (select any_value(rate) as rate, {_rho("a", "rate")} from s, r),
s1 as (select suffix, (k + a * rate) / (n + a) as m from s, sk),
d as (select domain, any_value(m) as m, sum(n) as n, sum(k) as k from h join s1 using (suffix) group by domain, suffix),
dk as (select {_rho("a", "m")} from d),
d1 as (select domain, (k + a * m) / (n + a) as m from d, dk),
h1 as (select host, n, k, m from h join d1 using (domain)),
hk as (select {_rho("a", "m")} from h1),
h2 as (select host, (k + a * m) / (n + a) as mean, n + a as total from h1, hk),
h3 as (select host, mean, mean - {Z} * sqrt(mean * (1 - mean) / (total + 1)) as bound from h2)
select page_id, host, path, case {" ".join(f + repr(h + p) for f, (_, h, p) in zip(_fits, _by_len))} end as rule,
  case {" ".join(f + repr(v) for f, (v, _, _) in zip(_fits, _by_len))} when bound > {BLOCK_RATE} then 'block' else 'allow' end as verdict,
  round(mean, 6) as bad_mean, round(bound, 6) as bad_bound
from parts join h3 using (host)
"""

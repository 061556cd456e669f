"""URL filter by empirical-Bayes reputation of hosts.

Labelled pages are outcomes of their host: bad or not. A host with few of them
says little, so its rate of bad pages is shrunk towards its registered domain,
the domain's towards its public suffix and the suffix's towards all pages. Each
level is a beta-binomial model: children of one parent have rates drawn from a
beta distribution around the parent's rate. How narrow it is, the level's
strength, is estimated from the data by the method of moments: children whose
rates differ no more than chance makes them get a strong prior.

A page is blocked when, by the posterior of its host, the rate of bad pages
lies above ``max_bad`` with a probability of ``confidence``: the lower bound of
that confidence is above it. Explicit rules go first.

All of it is DataFrame expressions. Counts combine in the map tasks, so a hot
host costs one row per task; the judged hosts come back to the pages by a
lookup that is broadcast while it is small and salted for hot hosts otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvec.operators.joins import lookup_join
from shelfvec.sources.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"

# Public suffixes of two labels that are told apart by default.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn", "co.za", "com.mx")

#: Intervals of each of the two integrals of a posterior.
STEPS = 200


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and all paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)


@dataclass(frozen=True)
class Reputation:
    """Limits of the model; ``strength`` is a level's prior where the data say nothing."""

    max_bad: float = 0.5
    confidence: float = 0.9
    strength: float = 20.0
    least_strength: float = 2.0
    most_strength: float = 10_000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for a null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without user and port.

    A host without a dot and an address of numbers are their own domain, with
    an empty suffix.
    """
    bare = F.regexp_replace(host, "^.*@|:[0-9]*$|[.]+$", "")
    labels = F.split(bare, "[.]")
    whole = (F.size(labels) < 2) | bare.rlike(r"^[0-9.]+$|^\[")
    last_two = F.array_join(F.slice(labels, -2, 2), ".")
    long_suffix = last_two.isin(*suffixes) if suffixes else F.lit(False)
    last_three = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(last_two)
    domain = F.when(whole, bare).when(long_suffix, last_three).otherwise(last_two)
    suffix = F.when(whole, F.lit("")).when(long_suffix, last_two).otherwise(F.element_at(labels, -1))
    return domain, suffix


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def with_parents(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children with the sums of their parent."""
    named = parents.select(
        *[F.col(c).alias(f"of_{c}") for c in keys],
        F.col("n").alias("parent_n"),
        F.col("k").alias("parent_k"),
        F.col("pairs").alias("parent_pairs"),
    )
    return children.join(named, [F.col(c) == F.col(f"of_{c}") for c in keys])


def level_strength(family: DataFrame, limits: Reputation) -> float:
    """Strength of the beta prior that children of one parent share, by moments.

    With n trials of a child, N and K of its parent, p = K / N, the square of
    k - n p has the expectation p (1 - p) (n (1 - n / N) + rho * w), where w is
    n (n - 1) (1 - 2 n / N) + (n / N)^2 * sum of n_j (n_j - 1). Summed over all
    children that gives rho, and the strength is 1 / rho - 1.
    """
    n, k, big, hits = F.col("n"), F.col("k"), F.col("parent_n"), F.col("parent_k")
    p, share = hits / big, n / big
    square = (k - n * p) ** 2 / (p * (1 - p))
    weight = n * (n - 1) * (1 - 2 * share) + share * share * F.col("parent_pairs")
    sums = (
        family.where((n > 0) & (hits > 0) & (hits < big) & (n < big))
        .agg(F.sum(square - n * (1 - share)).alias("over"), F.sum(weight).alias("weight"))
        .first()
    )
    if not sums["weight"] or sums["weight"] <= 0:
        return limits.strength
    rho = max(sums["over"] / sums["weight"], 1e-9)
    return min(max(1 / rho - 1, limits.least_strength), limits.most_strength)


def _sums(of: DataFrame, keys: list[str]) -> DataFrame:
    return of.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")
    )


def _integral(low: Column, high: Column, value) -> Column:
    """Simpson's rule over STEPS intervals."""
    step = (high - low) / STEPS
    factor = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + factor(i) * value(low + step * i)
    )
    return total * step / 3


def with_beta_tail(df: DataFrame, limit: float, name: str) -> DataFrame:
    """Add the probability that a beta variable with the columns ``a, b`` exceeds ``limit``.

    Over u = log(x / (1 - x)) the density is x^a (1 - x)^b, smooth and falling
    on both sides of log(a / b). It is integrated in three parts, parted at the
    limit and the mode, to where it has fallen by some 40 powers of e.
    """
    a, b, mode, peak = (F.col(c) for c in ("a", "b", "mode", "peak"))
    cut = F.lit(math.log(limit / (1 - limit)))
    low, high = F.least(mode, cut), F.greatest(mode, cut)

    def log_density(u: Column) -> Column:
        soft = F.log1p(F.exp(-F.abs(u)))
        return -(a * (F.greatest(-u, F.lit(0.0)) + soft) + b * (F.greatest(u, F.lit(0.0)) + soft))

    value = lambda u: F.exp(log_density(u) - peak)
    wide = F.sqrt(80 * (1 / a + 1 / b))
    # Each step is a projection of its own, so that no integral is computed twice.
    parts = (
        df.withColumn("mode", F.log(a / b))
        .withColumn("peak", log_density(mode))
        .withColumns(
            {
                "left": _integral(low - wide - 40 / a, low, value),
                "between": _integral(low, high, value),
                "right": _integral(high, high + wide + 40 / b, value),
            }
        )
    )
    above = F.col("right") + F.when(cut < mode, F.col("between")).otherwise(0.0)
    tail = above / (F.col("left") + F.col("between") + F.col("right"))
    return parts.withColumn(name, tail).select(*df.columns, name)


def host_reputation(counts: DataFrame, limits: Reputation = Reputation(), suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``host, n, k, bad_rate, risk`` from ``host, n, k``: pages with a label and the bad ones of them.

    ``bad_rate`` is the posterior mean, ``risk`` the posterior probability that
    the rate is above ``max_bad``. A host without labels has its domain's prior.
    ``counts`` has one row per host and must be stored, as it is read several times.
    """
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    domains = materialize(_sums(hosts, ["suffix", "domain"]), "domains")
    suffixes_ = materialize(_sums(domains, ["suffix"]), "suffixes")
    total = _sums(suffixes_, []).first()
    n, k = (total["n"] or 0), (total["k"] or 0)
    by_host = level_strength(with_parents(hosts, domains, ["suffix", "domain"]), limits)
    by_domain = level_strength(with_parents(domains, suffixes_, ["suffix"]), limits)
    of_all = {f"parent_{c}": F.lit(total[c] or 0) for c in ("n", "k", "pairs")}
    by_suffix = level_strength(suffixes_.withColumns(of_all), limits) if 0 < k < n else limits.strength

    def shrunk(strength: float, mean: Column) -> Column:
        return (strength * mean + F.col("k")) / (strength + F.col("n"))

    of_suffix = suffixes_.select(F.col("suffix").alias("s"), shrunk(by_suffix, F.lit((k + 1) / (n + 2))).alias("suffix_mean"))
    of_domain = domains.join(of_suffix, F.col("suffix") == F.col("s")).select(
        F.col("suffix").alias("s"), F.col("domain").alias("d"), shrunk(by_domain, F.col("suffix_mean")).alias("mean")
    )
    of_domain = materialize(of_domain, "domain-means")
    a = by_host * F.col("mean") + F.col("k")
    b = by_host * (1 - F.col("mean")) + F.col("n") - F.col("k")
    both = hosts.join(of_domain, (F.col("suffix") == F.col("s")) & (F.col("domain") == F.col("d")))
    posterior = both.select("host", "n", "k", (a / (a + b)).alias("bad_rate"), a.alias("a"), b.alias("b"))
    return with_beta_tail(posterior, limits.max_bad, "risk").drop("a", "b")


def judge_pages(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Rule] = RULES,
    limits: Reputation = Reputation(),
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """Pages with ``host, path, rule, verdict`` and the ``bad_rate`` and ``risk`` of their host.

    ``outcomes`` has ``id`` and the boolean ``bad``; a null in either is no
    outcome. The longest rule that fits decides, else the host's reputation.

    A null url, or one without ``://``, has an empty host and path; all such
    pages are one host, "". Repeated pages and repeated outcomes count row by
    row. A page without an id gets a verdict but has no outcome. Columns that
    have one of the new names are replaced, others pass through. An empty table
    gives an empty table; without outcomes every rate is near one half and
    nothing is blocked but by rules.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.struct(*pages.columns).alias("_in"), F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    known = outcomes.select(F.col("id").alias("_of"), F.col("bad").cast("int").alias("_bad")).where("_of IS NOT NULL AND _bad IS NOT NULL")
    # Outcomes meet pages by id alone; urls stay out of that shuffle.
    counts = (
        parsed.select("_id", "_host")
        .join(known, F.col("_id") == F.col("_of"), "left")
        .groupBy(F.col("_host").alias("host"))
        .agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("k"))
    )
    judged = host_reputation(materialize(counts, "host-counts"), limits, suffixes)
    judged = judged.select(F.col("host").alias("_host"), F.struct("bad_rate", "risk").alias("_seen"))
    name, verdict = matching_rule(F.col("_host"), F.col("_path"), rules)
    own = F.when(F.col("_seen.risk") >= limits.confidence, BLOCK).otherwise(ALLOW)
    new = {
        "host": F.col("_host"),
        "path": F.col("_path"),
        "rule": name,
        "verdict": F.coalesce(verdict, own),
        "bad_rate": F.col("_seen.bad_rate"),
        "risk": F.col("_seen.risk"),
    }
    kept = [F.col("_in")[c].alias(c) for c in pages.columns if c.lower() not in new]
    return lookup_join(parsed, judged, ["_host"]).select(*kept, *[c.alias(n) for n, c in new.items()])


def outcomes_of(labels: DataFrame) -> DataFrame:
    """``id, bad``: bad is low quality or toxic; null where neither is known."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return labels.select(F.col("doc_id").alias("id"), F.when(low | toxic, True).when(F.coalesce(low, toxic).isNotNull(), False).alias("bad"))


def url_verdicts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, risk`` of every page.

    A page's label is that of the document with its number. Nulls, repeats, ties
    and empty tables as in ``judge_pages``; rates are rounded to six digits.
    """
    judged = judge_pages(pages.select("page_id", "url"), outcomes_of(labels))
    return judged.select(
        "page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("risk", 4).alias("risk")
    )


def _strength_sql(children: str, parents: str, same: str, limits: Reputation) -> str:
    return f"""
    SELECT CASE WHEN coalesce(weight, 0) <= 0 THEN {limits.strength}
                ELSE least(greatest(1 / greatest(over / weight, 1e-9) - 1, {limits.least_strength}), {limits.most_strength}) END AS s
    FROM (SELECT sum(power(c.k - c.n * p.k / p.n, 2) / ((p.k / p.n) * (1 - p.k / p.n)) - c.n * (1 - c.n / p.n)) AS over,
                 sum(c.n * (c.n - 1) * (1 - 2 * c.n / p.n) + (c.n / p.n) * (c.n / p.n) * p.pairs) AS weight
          FROM {children} c JOIN {parents} p ON {same}
          WHERE c.n > 0 AND p.k > 0 AND p.k < p.n AND c.n < p.n)"""


def _simpson_sql(low: str, high: str) -> str:
    density = "exp(-(a * (greatest(-u, 0) + ln(1 + exp(-abs(u)))) + b * (greatest(u, 0) + ln(1 + exp(-abs(u))))) - peak)"
    point = f"({low}) + (({high}) - ({low})) * i / {STEPS}"
    factor = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"(SELECT sum(f * {density}) FROM (SELECT {factor} AS f, {point} AS u FROM range({STEPS} + 1) r(i)))"
        f" * (({high}) - ({low})) / {3 * STEPS}"
    )


def sql(limits: Reputation = Reputation(), rules: Sequence[Rule] = RULES, suffixes: Sequence[str] = SUFFIXES) -> str:
    """The same for ``pages`` and ``labels`` in DuckDB."""
    cases = [
        (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r)
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    ]
    names = " ".join(f"WHEN {fits} THEN '{r.name}'" for fits, r in cases)
    verdicts = " ".join(f"WHEN {fits} THEN '{r.verdict}'" for fits, r in cases)
    listed = ", ".join(f"'{s}'" for s in suffixes)
    cut = repr(math.log(limits.max_bad / (1 - limits.max_bad)))
    low, high = f"least(mode, {cut})", f"greatest(mode, {cut})"
    return f"""
WITH rests AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
outcomes AS (
    SELECT doc_id AS id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN coalesce(quality, toxic) IS NOT NULL THEN 0 END AS bad FROM labels),
counts AS (
    SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM parsed LEFT JOIN outcomes ON page_id = id GROUP BY host),
bares AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|[.]+$', '', 'g') AS bare FROM counts),
split AS (SELECT *, string_split(bare, '.') AS parts,
                 len(string_split(bare, '.')) < 2 OR regexp_matches(bare, '^[0-9.]+$|^\\[') AS whole FROM bares),
hosts AS (
    SELECT host, n, k,
           CASE WHEN whole THEN bare WHEN array_to_string(parts[-2:], '.') IN ({listed}) THEN array_to_string(parts[-3:], '.')
                ELSE array_to_string(parts[-2:], '.') END AS domain,
           CASE WHEN whole THEN '' WHEN array_to_string(parts[-2:], '.') IN ({listed}) THEN array_to_string(parts[-2:], '.')
                ELSE parts[-1] END AS suffix FROM split),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, sum(n * (n - 1)) AS pairs FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, sum(n * (n - 1)) AS pairs FROM domains GROUP BY ALL),
total AS (SELECT sum(n) AS n, sum(k) AS k, sum(n * (n - 1)) AS pairs FROM suffixes),
s1 AS ({_strength_sql("hosts", "domains", "c.suffix = p.suffix AND c.domain = p.domain", limits)}),
s2 AS ({_strength_sql("domains", "suffixes", "c.suffix = p.suffix", limits)}),
s3 AS ({_strength_sql("suffixes", "total", "true", limits)}),
suffix_means AS (SELECT x.suffix, (s3.s * (t.k + 1) / (t.n + 2) + x.k) / (s3.s + x.n) AS mean FROM suffixes x, total t, s3),
domain_means AS (
    SELECT d.suffix, d.domain, (s2.s * m.mean + d.k) / (s2.s + d.n) AS mean FROM domains d JOIN suffix_means m USING (suffix), s2),
posterior AS (
    SELECT host, s1.s * mean + k AS a, s1.s * (1 - mean) + n - k AS b FROM hosts JOIN domain_means USING (suffix, domain), s1),
modes AS (SELECT *, ln(a / b) AS mode, sqrt(80 * (1 / a + 1 / b)) AS wide FROM posterior),
peaks AS (
    SELECT *, -(a * (greatest(-mode, 0) + ln(1 + exp(-abs(mode)))) + b * (greatest(mode, 0) + ln(1 + exp(-abs(mode))))) AS peak FROM modes),
parts AS (
    SELECT host, a, b, mode, {_simpson_sql(f"{low} - wide - 40 / a", low)} AS below,
           {_simpson_sql(low, high)} AS middle, {_simpson_sql(high, f"{high} + wide + 40 / b")} AS above FROM peaks),
judged AS (
    SELECT host, a / (a + b) AS bad_rate,
           (above + CASE WHEN {cut} < mode THEN middle ELSE 0 END) / (below + middle + above) AS risk FROM parts)
SELECT page_id, host, path, CASE {names} END AS rule,
       coalesce(CASE {verdicts} END, CASE WHEN risk >= {limits.confidence} THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict,
       round(bad_rate, 6) AS bad_rate, round(risk, 4) AS risk
FROM parsed JOIN judged USING (host)
"""


SQL = sql()

"""Host reputation against integration and moments in numpy, and the rules by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfvec.llm import host_reputation as H


def plain_tail(a, b, limit):
    """Midpoints of fine cells, with the limit between two of them."""
    wide, step = (1000, 5e-4) if min(a, b) < 0.5 else (60, 5e-5)
    u = np.log(limit / (1 - limit)) + (np.arange(-wide / step, wide / step) + 0.5) * step
    log = -(a * np.logaddexp(0, -u) + b * np.logaddexp(0, u))
    weight = np.exp(log - log.max())
    return weight[len(u) // 2 :].sum() / weight.sum()


@pytest.mark.parametrize("limit", [0.5, 0.1, 0.9])
def test_beta_tail(spark, limit):
    shapes = [(1.0, 1.0), (2.0, 5.0), (0.3, 4.0), (30.0, 28.0), (5000.0, 5100.0), (0.05, 2.0), (2.0, 0.05), (1e5, 2e5)]
    df = H.with_beta_tail(spark.createDataFrame(shapes, "a double, b double"), limit, "tail")
    for row in df.collect():
        assert row.tail == pytest.approx(plain_tail(row.a, row.b, limit), abs=2e-4), row


URLS = [
    ("http://Example.COM/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/1", "a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://m.example.com/en", "m.example.com", "/en", "com/", "allow"),
    ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://x.net/de/", "x.net", "/de/", None, "allow"),
    ("http://x.com", "x.com", "", None, "allow"),
    ("http://x.com?a=/", "x.com", "", None, "allow"),
    ("http://x.com#a://b/", "x.com", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("mailto:x", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://É.Net/fr/é?", "É.net", "/fr/é", "net/fr/", "block"),
    ("http://x.com/" + "p" * 100_000, "x.com", "/" + "p" * 100_000, "com/", "allow"),
    ("http://10.0.0.1:80/a", "10.0.0.1:80", "/a", None, "allow"),
    ("://", "", "", None, "allow"),
]

PAGES = "page_id long, url string, host int, verdict string, _id int, n int, bad_rate string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, 7, "old", 1, 2, "x") for i, u in rows], PAGES)


def test_hosts_paths_and_rules(spark):
    nothing = spark.createDataFrame([], "id long, bad boolean")
    out = H.judge_pages(pages(spark, [(i, u[0]) for i, u in enumerate(URLS)]).repartition(3), nothing)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert "old" not in {r.verdict for r in out.collect()} and out.first().n == 2


def test_domains_and_suffixes(spark):
    cases = {
        "a.b.example.com": ("example.com", "com"), "b.co.uk": ("b.co.uk", "co.uk"), "a.b.co.uk:80": ("b.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", ""), "10.0.0.1:9": ("10.0.0.1", ""), "[::1]:80": ("[::1]", ""),
        "me@x.org.": ("x.org", "org"), "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    domain, suffix = H.domain_and_suffix(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == cases


def hosts_with_rates(seed=3):
    """Hosts of three suffixes; one domain is bad, and one host of a good domain."""
    draw = np.random.default_rng(seed)
    rows, labels = [], []
    rates = {}
    for suffix in ("org", "info", "dev"):
        for d in range(6):
            for h in range(8):
                rate = 0.95 if (suffix, d) == ("org", 2) else 0.9 if (suffix, d, h) == ("dev", 1, 1) else 0.05 + 0.02 * d
                rates[f"h{h}.d{d}.{suffix}"] = rate, int(draw.integers(0, 30))
    rates["h1.d1.dev"] = 0.9, 60
    rates["new.d2.org"] = 0.95, 0
    rates["few.d3.org"] = 1.0, 2
    page = 0
    for host, (rate, n) in rates.items():
        for i in range(n + 2):
            rows.append((page, f"http://{host}/{i}"))
            if i < n:
                labels.append((page, bool(draw.random() < rate)))
            page += 1
    return rows, labels


def plain_rates(rows, labels, limits=H.Reputation()):
    """The levels one after another in plain Python."""
    bad = dict(labels)
    count = {}
    for i, url in rows:
        host = url.split("/")[2]
        n, k = count.get(host, (0, 0))
        count[host] = (n + (i in bad), k + bad.get(i, 0))
    domain = {h: ".".join(h.split(".")[-2:]) for h in count}
    suffix = {d: d.split(".")[-1] for d in domain.values()}

    def up(children, parent):
        out = {}
        for c, (n, k) in children.items():
            x, y = out.get(parent[c], (0, 0))
            out[parent[c]] = x + n, y + k
        return out

    def strength(children, parents, parent):
        over = weight = 0.0
        for c, (n, k) in children.items():
            big, hits = parents[parent[c]]
            if not (n > 0 and 0 < hits < big and n < big):
                continue
            p, share = hits / big, n / big
            pairs = sum(m * (m - 1) for x, (m, _) in children.items() if parent[x] == parent[c])
            over += (k - n * p) ** 2 / (p * (1 - p)) - n * (1 - share)
            weight += n * (n - 1) * (1 - 2 * share) + share**2 * pairs
        return min(max(1 / max(over / weight, 1e-9) - 1, limits.least_strength), limits.most_strength)

    domains = up(count, domain)
    suffixes = up(domains, suffix)
    root = {s: "" for s in suffixes}
    whole = up(suffixes, root)
    s1, s2, s3 = strength(count, domains, domain), strength(domains, suffixes, suffix), strength(suffixes, whole, root)
    top = (whole[""][1] + 1) / (whole[""][0] + 2)
    of_suffix = {s: (s3 * top + k) / (s3 + n) for s, (n, k) in suffixes.items()}
    of_domain = {d: (s2 * of_suffix[suffix[d]] + k) / (s2 + n) for d, (n, k) in domains.items()}
    out = {}
    for h, (n, k) in count.items():
        a = s1 * of_domain[domain[h]] + k
        b = s1 * (1 - of_domain[domain[h]]) + n - k
        out[h] = a / (a + b), plain_tail(a, b, limits.max_bad)
    return out


def test_reputation_equals_the_levels_by_hand(spark):
    rows, labels = hosts_with_rates()
    known = spark.createDataFrame([*labels, (None, True), (rows[0][0], None), (10**9, True)], "id long, bad boolean")
    out = H.judge_pages(pages(spark, rows).repartition(4), known).collect()
    want = plain_rates(rows, labels)
    assert len(out) == len(rows)
    for r in out:
        rate, risk = want[r.host]
        assert r.bad_rate == pytest.approx(rate, abs=1e-9) and r.risk == pytest.approx(risk, abs=2e-4)
        assert r.verdict == ("block" if r.risk >= 0.9 else "allow") and r.rule is None
    blocked = {r.host for r in out if r.verdict == "block"}
    # A bad domain carries its new host; two bad pages alone do not block one of a good domain.
    assert {"new.d2.org", "h1.d1.dev"} <= blocked and "few.d3.org" not in blocked
    assert {h for h in blocked if not h.endswith("d2.org")} == {"h1.d1.dev"}


def test_one_hot_host_repeats_and_empty_tables(spark):
    rows = [(i % 50, "http://hot.org/a") for i in range(200)] + [(None, "http://x.hot.org/"), (1000, "http://hot.org/a")]
    known = spark.createDataFrame([(i, i % 2 == 0) for i in range(50)] * 2, "id long, bad boolean")
    out = H.judge_pages(pages(spark, rows), known).collect()
    assert len(out) == 202 and {r.verdict for r in out} == {"allow"}
    assert {round(r.bad_rate, 2) for r in out if r.host == "hot.org"} == {0.5}
    empty = pages(spark, [])
    assert H.judge_pages(empty, known).collect() == []


def test_no_python_in_the_plan(spark, plan_of):
    rows, labels = hosts_with_rates()
    plan = plan_of(H.judge_pages(pages(spark, rows), spark.createDataFrame(labels, "id long, bad boolean")))
    assert "Python" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

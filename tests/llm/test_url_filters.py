import random
import re

import pytest

from codecorpus.llm import url_filters as u
from codecorpus.plans.compare import duck, rows_of


def brute(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), len(h.split(".")), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)] if host else []
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, x, "old") for i, x in enumerate(urls)], "page_id bigint, url string, rule string")
    out = u.filter_urls(pages, spark.createDataFrame(rules, u.RULE_SCHEMA), sweeps=3)
    return [tuple(r) for r in out.orderBy("page_id").select("host", "path", "rule", "verdict").collect()]


def test_nested_rules_match_brute_force(spark):
    r = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "a.net", "xa.com"]
    paths = ["/", "/e", "/en", "/en/", "/en/a", "/en/a/b", "/fr/"]
    rules = [(h, p, r.choice(["allow", "block"])) for h in hosts for p in paths if r.random() < 0.6]
    urls = [f"http://{r.choice(['', 'www.', 'M.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', 'x', '?q=/en/', '#top', '/z'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http://a.com", "http://a.com?x", "x://A.COM/EN/", "http://.com/en/", "ftp://a.com:80/en/", "http://a.com/en/\n"] * 2
    assert judged(spark, urls, rules) == [brute(x, rules) for x in urls]


def test_without_rules_or_pages(spark):
    assert judged(spark, ["http://a.com/"], []) == [("a.com", "/", None, "allow")]
    assert judged(spark, [], [("com", "/", "block")]) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_its_oracle(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    got = u.query(spark, sf_dir)
    cur = duck(sf_dir).execute(u.ORACLE)
    columns = [d[0] for d in cur.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, cur.fetchall())


def test_no_python_in_the_plan(spark):
    plan = u.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))

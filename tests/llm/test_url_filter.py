import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import url_filter as uf

PAGES = "page_id long, url string, html string, Host string, h1 string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "x", "y") for i, u in rows], PAGES)


def brute(url, listed):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[1:] if fits else (None, None)
    return host, path, rule, verdict or ("block" if listed(host) else "allow")


URLS = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?q=1#f", "http://example.org/en/12", "http://xexample.org/es/", "x://org", "x://org/", "ftp://m.site.com/fr/", "http://com/de/1", "http://u@h.com:80/fr/#x", "a://b://c/d", "http://Ünï.net?x", "http://h.net#x/y", "http://spam.a.net/\n"]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = list(enumerate(URLS)) + [(None, "http://bets.example.net/en/1"), (3, "http://dup.net/")]
    rows += [(100 + i, f"http://{rng.choice(['casino', 'a', 'b'])}{'-' if i % 2 else '.'}h{i % 700}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['fr', 'de', 'en'])}/{i}") for i in range(3000)]

    def listed(host):
        return bool(set(re.split("[.-]", host)) & set(uf.LISTED_WORDS))

    want = sorted(((i, *brute(u, listed)) for i, u in rows), key=str)
    got = uf.op3(pages(spark, rows)).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == want
    assert all(r.is_listed == listed(r.host) for r in got)


@pytest.mark.parametrize("shard_keys", [10**9, 150])
def test_cascade_is_exact_for_all_keys(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(uf, "ERROR", 0.3)  # many wrong answers, so several levels
    rows = [(i, f"http://h{i}.net/") for i in range(2000)]
    listed = F.xxhash64("host") % 5 == 0
    got = uf.judge(pages(spark, rows), listed, (), shard_keys).withColumn("want", listed).collect()
    assert len(got) == 2000 and all(r.is_listed == r.want and r.verdict == ("block" if r.want else "allow") for r in got)


@pytest.mark.parametrize("shard_keys", [10**9, 90])
def test_a_table_of_hosts(spark, shard_keys):
    rows = [(i, f"http://H{i % 900}.net/") for i in range(2000)] + [(5000, "http://" + "long." * 20_000 + "org/x"), (5001, None)]
    names = [f"h{i}.NET" for i in range(0, 900, 3)] * 2 + [None, "", "elsewhere.org", "long." * 20_000 + "org"]
    table = spark.createDataFrame([(n, "x") for n in names], "Host string, listed string")
    got = uf.judge(pages(spark, rows), table, (), shard_keys).collect()
    want = {n.lower() for n in names if n is not None}
    assert len(got) == len(rows) and all(r.is_listed == (r.host in want) for r in got)
    assert sum(r.is_listed for r in got) > 600


def test_nothing_listed_and_empty(spark):
    assert {r.verdict for r in uf.judge(pages(spark, [(1, "http://a.b/")]), F.lit(None).cast("boolean"), ()).collect()} == {"allow"}
    assert uf.op3(pages(spark, [])).collect() == []
    assert not uf.is_listed([], np.zeros(3, np.int64), np.zeros(3, np.int64)).any()

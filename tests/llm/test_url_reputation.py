"""Host reputation against its SQL, shrinkage, rules and odd urls."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from packetloom.llm import url_queries
from packetloom.llm import url_reputation as ur
from tools.check_oracle import open_tables, rows_of


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = url_queries.op6_url_reputation(spark, folder)
    want = open_tables(folder).execute(url_queries.SQL)
    columns = [c[0] for c in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_parts_and_rules(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "x://b.net/fr/1", "b.net", "/fr/1", "net/fr/", "block"),
        (4, "x://b.com", "b.com", "", None, "allow"),
        (5, "x://b.com?u=http://c.net/fr/", "b.com", "", None, "allow"),
        (6, "no scheme.com/en/", "", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "", "", "", None, "allow"),
        (9, "a://x.com/l1\nl2#z", "x.com", "/l1\nl2", "com/", "allow"),
        (10, "http://notexample.org/en/", "notexample.org", "/en/", None, "allow"),
        (10, "http://notexample.org/en/", "notexample.org", "/en/", None, "allow"),
        (None, "http://10.1.2.3:80/", "10.1.2.3:80", "/", None, "allow"),
        (11, "http://a.com/" + "p" * 50_000, "a.com", "/" + "p" * 50_000, "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None, "old") for i, u, *_ in rows], "page_id long, url string, outcome int, host string")
    got = ur.judge(pages, url_queries.RULES)
    found = sorted((r.page_id or 0, r.url or "", r.host, r.path, r.rule or "", r.verdict) for r in got.collect())
    assert found == sorted((i or 0, u or "", h, p, r or "", v) for i, u, h, p, r, v in rows)
    assert all(r.bad_rate == 0.5 for r in got.collect())
    assert ur.judge(pages.limit(0), url_queries.RULES).count() == 0
    assert ur.judge(pages, spark.createDataFrame([], "host string, path string, action string")).where("rule is not null").isEmpty()


@pytest.mark.parametrize("host,verdict", [("bad.evil.org", "block"), ("new.evil.org", "block"), ("ok.fine.org", "allow"), ("good.mixed.co.uk", "allow")])
def test_shrinkage(spark, host, verdict):
    rows = [("bad.evil.org", 1)] * 40 + [("new.evil.org", 1)] + [("ok.fine.org", 0)] * 60 + [("one.fine.org", 1)]
    rows += [("good.mixed.co.uk", 0)] * 30 + [("mixed.co.uk", i % 2) for i in range(30)] + [(f"h{i}.org", i % 9 == 0) for i in range(60)]
    pages = spark.createDataFrame([(f"http://{h}/a", int(y)) for h, y in rows], "url string, outcome int")
    got = ur.judge(pages, [], limit=0.5)
    mine = got.where(F.col("host") == host).first()
    assert mine.verdict == verdict and 0 <= mine.bad_bound <= mine.bad_rate <= 1
    rate = dict(got.select("host", "bad_rate").distinct().collect())
    assert rate["bad.evil.org"] > rate["new.evil.org"] > rate["one.fine.org"] > rate["ok.fine.org"]


def test_domains(spark):
    hosts = ["a.b.example.com", "x.y.co.uk", "co.uk", "com", "", "1.2.3.4", "u@h.example.org:8080"]
    pages = spark.createDataFrame([(f"http://{h}/",) for h in hosts], "url string").withColumn("outcome", F.lit(None).cast("int"))
    got = {r.host: (r.domain, r.suffix) for r in ur.host_counts(pages).collect()}
    assert got["a.b.example.com"] == ("example.com", "com") and got["x.y.co.uk"] == ("y.co.uk", "co.uk")
    assert got["1.2.3.4"] == ("1.2.3.4", "1.2.3.4") and got["u@h.example.org:8080"] == ("example.org", "org")
    assert got["com"] == ("com", "com") and got[""] == ("", "")


def test_suffix_table_and_sql_of_long_suffixes(spark, tmp_path):
    hosts = spark.createDataFrame([("a.b.gov.br",), ("x.github.io",), ("p.q.r.sch.uk.example",)], "host string")
    got = {r.host: (r.domain, r.suffix) for r in ur.with_domain(hosts, spark.createDataFrame([("gov.br",), ("GitHub.io",), ("sch.uk.example",)], "suffix string")).collect()}
    assert got == {"a.b.gov.br": ("b.gov.br", "gov.br"), "x.github.io": ("x.github.io", "github.io"), "p.q.r.sch.uk.example": ("r.sch.uk.example", "sch.uk.example")}
    rows = [(i, f"http://{h}/en/{i}", "worthless" if (i * 7 + len(h)) % 5 < bad else "fine") for i, (h, bad) in enumerate([(f"{a}.{b}.{s}", k) for s in ("co.uk", "uk", "com.au", "org") for k, b in enumerate("pqr") for a in "abcde" for _ in range(6)])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = open_tables("/root/testdata/sf0.001")
    con.execute(f"create or replace view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = url_queries.op6_url_reputation(spark, str(tmp_path))
    want = con.execute(url_queries.SQL)
    columns = [c[0] for c in want.description]
    result = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert result == rows_of(columns, want.fetchall()) and {r[-1] for r in result} == {"allow", "block"}


def test_a_hot_host_is_dealt_over_many_keys(spark):
    pages = spark.createDataFrame([(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/", i % 2) for i in range(900)], "page_id long, url string, outcome int")
    known = ur.reputation(ur.host_counts(pages)).withColumnRenamed("host", "_h")
    parts, dealt = ur._dealt(pages.withColumn("_host", ur.url_host(F.col("url"))), known)
    shares = [r["count"] for r in parts.groupBy("_host", "_deal").count().collect()]
    assert max(shares) < 60 and sum(shares) == 900
    assert dealt.where("_h = 'hot.org'").count() == parts.where("_host = 'hot.org'").select("_deal").distinct().count()
    assert ur.judge(pages, []).count() == 900

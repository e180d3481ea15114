from pyspark.sql import functions as F

from plumbline.llm import urls as U

CASES = [
    ("http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://a.example.net/de/1", "a.example.net", "/de/1", "net/", "block"),
    ("https://example.com/de/x?a=/en/", "example.com", "/de/x", "example.com/de/", "block"),
    ("https://x.org/fr/#top", "x.org", "/fr/", "org/fr/", "allow"),
    ("https://x.org?/fr/", "x.org", "", None, None),
    ("http://x.net", "x.net", "", None, None),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None, None),
    ("http://x.net:80/a", "x.net:80", "/a", None, None),
    ("a://b/c://d/e", "b", "/c://d/e", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://É.ÀB.org/fr/ü", "É.Àb.org", "/fr/ü", "org/fr/", "allow"),
]
SCHEMA = "page_id long, url string, html string, host string, rule string, n int"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x", "y", 1) for k, (u, h) in enumerate(rows)], SCHEMA)


def outcomes(frame):
    return frame.select(U.host_of(F.col("url")).alias("host"), U.page_outcome(F.col("html")).alias("good"))


def test_rules(spark):
    frame = pages(spark, [(u, None) for u, *_ in CASES])
    rows = sorted(U.judged(frame, outcomes(frame)).collect())
    for r, (_, host, path, rule, verdict) in zip(rows, CASES, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")


def test_reputation_shrinks_and_blocks(spark):
    good, bad = "<p>" + "plain words here " * 9, "<p>" + "### $$$ &&& xyz " * 9
    rows = [("http://bad.spam.com/1", bad)] * 200 + [("http://ok.fine.com/1", good)] * 200
    rows += [("http://few.spam.com/", bad)] * 2 + [("http://few.fine.com/", good)] * 2 + [("http://new.else.com/", None)] * 3
    frame = pages(spark, rows)
    verdict = {r.host: r.verdict for r in U.judged(frame, outcomes(frame), rules=()).collect()}
    assert verdict["bad.spam.com"] == "block" and verdict["ok.fine.com"] == "allow" and verdict["new.else.com"] == "allow"
    held = {r.host: r for r in U.reputation(outcomes(frame)).collect()}
    assert held["bad.spam.com"]["mean"] < held["few.spam.com"]["mean"] < held["few.fine.com"]["mean"] < held["ok.fine.com"]["mean"]
    assert held["few.spam.com"].deviation > held["bad.spam.com"].deviation


def test_outcome(spark):
    frame = pages(spark, [("u", "<p>" + "SHOUTING " * 9), ("u", "<script>" + "#" * 90 + "</script><p>" + "quiet words " * 9), ("u", "<p>short"), ("u", None)])
    assert [r[0] for r in frame.select(U.page_outcome(F.col("html"))).collect()] == [0, 1, None, None]


def test_empty_table(spark):
    frame = pages(spark, [])
    assert U.judged(frame, outcomes(frame)).count() == 0

"""The operators that run in DataFrame functions alone: personal data and URL filters."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larkspur.llm import pii, urls
from larkspur.llm import queries as Q
from tests.llm import reference as R

DOCS = "doc_id long, text string"
COLS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def base(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)


def check(df, docs):
    want = sorted(R.op3(docs), key=str)
    got = sorted(df.collect(), key=lambda r: str(tuple(r[c] for c in COLS)))
    assert [tuple(r[c] for c in COLS) for r in got] == [w[:6] for w in want]
    for r, w in zip(got, want, strict=True):
        spans = r.spans.split(",") if r.spans else []
        assert set(w[6].split(",") if w[6] else []) == {s for s in spans if s.split(":")[0] in pii.KINDS}
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), [*pii.KINDS, *pii.ADDED].index(s.split(":")[0])))


def test_pii_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sum(sum(x[1:5]) for x in R.op3(docs))
    check(Q.op3_pii(spark, sf), docs)


def test_pii_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "a@b.c_x@d.e,é😀f@g-h.ij.kl @x.y a@b z@.c"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.001 1.2.3"),
        (5, "4111 1111-1111 1111 4111111111111112 79927398713 " + "0" * 19 + " " + "0" * 20), (6, "+1 (555) 010-9999 +12345678 +123456789 ++1 23456789 +1-(((5 +(1)234567890"),
        (7, "1" * 200_000), (8, "a" * 200_000 + "@"), (9, "1 " * 100_000), (10, "a.b@c." * 20_000), (None, "x@y.zz"), (None, "x@y.zz"), (11, "+1 " * 50_000), (12, "1." * 50_000),
    ]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS base", "2 AS n_email")
    check(pii.find(df), rows)
    assert pii.find(df.limit(0)).count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("a1@.+ -(5é\n", max_size=40), min_size=1, max_size=60))
def test_pii_any_text(spark, texts):
    rows = [*enumerate(texts)]
    check(pii.find(spark.createDataFrame(rows, DOCS)), rows)


def test_pii_method_adds_likely_spans(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(300):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        noise = "chapter" + "-section" * 3 + str(rng.randint(1, 9))
        text = f'see {noise} here token = "{secret}" and isbn 978{rng.randint(10**9, 10**10 - 1)} end'
        rows.append((i, text))
        truth[i] = (text.index(secret), text.index(secret) + 40, text.index(noise))
    good = bad = 0
    for r in pii.find(spark.createDataFrame(rows, DOCS)).collect():
        a, b, n = truth[r.doc_id]
        good += f"secret:{a}:{b}" in r.spans
        bad += f"secret:{n}:" in r.spans
    assert good >= 290 and bad <= 10


def test_em_finds_the_reliable_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(5000):
        y = rng.choice((1, -1))
        votes = tuple(y if rng.random() < a else -y for a in (0.9, 0.8, 0.65))
        counts[votes] = counts.get(votes, 0) + 1
    prior, rates, sure = pii.expectation_maximisation(counts)
    assert abs(prior - 0.5) < 0.05 and all(abs(r - a) < 0.05 for r, a in zip(rates, (0.9, 0.8, 0.65), strict=True))
    assert sure[1, 1, 1] > 0.95 and sure[-1, -1, -1] < 0.05


PAGES = "page_id long, url string, html string"


def verdicts(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=str)


def test_urls_match_brute_force(spark, sf):
    pages = [(r.page_id, r.url, []) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert verdicts(Q.op8_url_filters(spark, sf)) == sorted(R.op8(pages, urls.RULES), key=str)


def test_urls_links_and_odd_rows(spark):
    links = {
        1: ("http://bad.net/x", ["shop.com"]), 2: ("http://farm1.com/a", ["bad.net", "bad2.net"]), 3: ("http://farm2.com/a", ["farm1.com"]), 4: ("http://good.org/fr/1", ["friend.com"]),
        5: ("http://friend.com/", ["bad.net"]), 6: ("http://mixed.com/", ["bad.net", "clean.com"]), 7: ("http://clean.com/", []), 8: ("http://bad2.net/", ["bad.net"]),
    }
    rows = [(i, u, "".join(f'<a HREF = "http://{h.upper()}/p?q">x</a><img src=//{h}/i.png><a href="/local">y</a>' for h in hs)) for i, (u, hs) in links.items()]
    odd = [(20, None, None), (21, "no scheme", ""), (22, "://", "x"), (23, "HTTP://WWW.Example.NET/en/?a#b", None), (24, "http://notexample.net/en", ""), (25, "http://example.com/de/#x", ""), (26, "http://a.b.c.org/fr/x y\nz?", ""), (27, "http://net", ""), (28, "x://é.ÀB.net/İ", ""), (28, "x://é.ÀB.net/İ", ""), (None, "http://h.org/fr/", ""), (29, "http://" + "a." * 5000 + "net/", ""), (30, "http://b://c/net/", "")]
    df = spark.createDataFrame([*rows, *odd], PAGES).selectExpr("*", "1 AS host", "2 AS rule")
    pages = [*((i, u, hs) for i, (u, hs) in links.items()), *((i, u, []) for i, u, _ in odd)]
    want = sorted(R.op8(pages, urls.RULES), key=str)
    assert verdicts(urls.judge(df)) == want
    assert {x[0]: x[4] for x in want}[2] == "block" and {x[0]: x[4] for x in want}[7] == "allow"
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_many_small_flows_meet(spark):
    """A blocked host's distrust reaches 900 hosts in small parts, and as a whole the one that links to all of them."""
    links = {0: ("http://bad.net/x", []), 1: ("http://hub.com/", [f"h{i}.com" for i in range(900)])} | {2 + i: (f"http://h{i}.com/", ["bad.net"]) for i in range(900)}
    rows = [(i, u, "".join(f'<a href="http://{h}/">x</a>' for h in hs)) for i, (u, hs) in links.items()]
    got = verdicts(urls.judge(spark.createDataFrame(rows, PAGES)))
    assert got == sorted(R.op8([(i, u, hs) for i, (u, hs) in links.items()], urls.RULES), key=str)
    assert {x[1]: x[4] for x in got}["hub.com"] == "block" and {x[1]: x[4] for x in got}["h5.com"] == "allow"


def test_plans_are_native(spark, sf):
    for df in (pii.find(spark.read.parquet(f"{sf}/documents.parquet")), pii.candidates(spark.read.parquet(f"{sf}/documents.parquet")), urls.judge(spark.read.parquet(f"{sf}/pages.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

from pyspark.sql import functions as F
import random
from datetime import date, datetime, timedelta

from floorgraph.llm import url_lists

CAPTURES = "page_id long, url string, fetched_on date, host string, domain string"
ENTRIES = "list_name string, domain string, action string, at date"
DAY = date(2024, 1, 1)


def host(url):
    if not url or "://" not in url:
        return None
    h = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].split(":")[0].lower().rstrip(".")
    return h or None


def brute(captures, entries):
    state_of = {}
    for name, domain, action, at in sorted((e for e in set(entries) if e[1] and e[2] in ("add", "remove") and e[3]), key=lambda e: (e[3], e[2])):
        state_of.setdefault((name, domain.lower()), []).append((at, action))
    out = []
    for i, url, when in captures:
        h, hits = host(url), []
        if h and when:
            for (name, domain), log in state_of.items():
                state = [a for at, a in log if at <= when]
                if state and state[-1] == "add" and (h == domain or h.endswith("." + domain)):
                    hits.append((-len(domain), domain, name))
        best = min(hits, default=(0, None, None))
        out.append((i, h, when, bool(hits), len(hits), best[1], best[2]))
    return sorted(map(str, out))


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.org", "b.a.org", "x.b.a.org", "ba.org", "c.com", "B.A.org", "u:p@c.com:80", "c.com."]
    captures = [(i, rng.choice([f"http://{rng.choice(hosts)}/p{i}?q", None, "", "no url", "ftp://c.com"]), rng.choice([DAY + timedelta(rng.randrange(500)), None])) for i in range(300)]
    captures += captures[:5]
    entries = [(rng.choice("PQ"), rng.choice(["a.org", "b.a.org", "C.com", None, "org"]), rng.choice(["add", "remove", "add", None]), DAY + timedelta(rng.randrange(450))) for _ in range(60)]
    df = spark.createDataFrame([(i, u, d, "h", "d") for i, u, d in captures], CAPTURES)
    out = url_lists.match_captures(df, spark.createDataFrame(entries, ENTRIES))
    rows = sorted(str((r.page_id, r.host, r.fetched_on, r.blocked, r.n_active, r.domain, r.list_name)) for r in out.collect())
    want = brute(captures, entries)
    assert rows == want and any("True" in r for r in rows)


def test_empty_lists_and_tables(spark):
    some = spark.createDataFrame([(1, "http://a.org/", DAY, "h", "d")], CAPTURES)
    none = spark.createDataFrame([], ENTRIES)
    assert [r.blocked for r in url_lists.match_captures(some, none).collect()] == [False]
    assert url_lists.match_captures(some.limit(0), spark.createDataFrame([("P", "a.org", "add", DAY)], ENTRIES)).count() == 0


def test_border_days(spark):
    entries = spark.createDataFrame([("P", "a.org", "add", DAY), ("P", "a.org", "remove", DAY + timedelta(10)), ("P", "a.org", "add", DAY + timedelta(20))], ENTRIES)
    captures = spark.createDataFrame([(k, "http://a.org/", DAY + timedelta(k), "h", "d") for k in (-1, 0, 9, 10, 19, 20, 300)], CAPTURES)
    out = {r.page_id: r.blocked for r in url_lists.match_captures(captures, entries).collect()}
    assert out == {-1: False, 0: True, 9: True, 10: False, 19: False, 20: True, 300: True}


def test_times_within_a_day(spark):
    at = lambda h, day=0: datetime(2024, 5, 31, h) + timedelta(day)
    kinds = CAPTURES.replace("date", "timestamp"), ENTRIES.replace("date", "timestamp")
    entries = [("P", "a.org", "add", at(10)), ("P", "a.org", "remove", at(14)), ("P", "a.org", "add", at(23)), ("P", "a.org", "remove", at(1, 1)), ("P", "b.org", "add", at(5)), ("P", "b.org", "remove", at(5))]
    captures = [(k, f"http://{h}.org/" + "p" * 50_000, w, "h", "d") for k, (h, w) in enumerate((h, at(t, d)) for h in "ab" for t in (0, 5, 9, 10, 12, 14, 23) for d in (0, 1))]
    out = url_lists.match_captures(spark.createDataFrame(captures, kinds[0]), spark.createDataFrame(entries, kinds[1]))
    rows = sorted(str((r.page_id, r.host, r.fetched_on, r.blocked, r.n_active, r.domain, r.list_name)) for r in out.collect())
    want = brute([c[:3] for c in captures], entries)
    assert rows == want and sum("True" in r for r in rows) == 4


def test_hosts_in_brackets(spark):
    urls = {"http://[2001:DB8::1]:8080/x": "[2001:db8::1]", "http://u@[::1]?q": "[::1]", "http://[broken/x": "[broken", "http://A.b.:80": "a.b", "http://": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", url_lists.host_of(F.col("u")).alias("h")).collect()} == urls

import datetime as dt
import random

from tests.oracle import SF, agree
from weft.llm import queries
from weft.llm.url_filters import filter_urls

DAY = dt.datetime(2024, 1, 1)


def at(n):
    return DAY + dt.timedelta(days=n)


def plain(url, when, entries):
    if url is None or when is None or "://" not in url:
        return "none"
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, _, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
    if not host:
        return "none"
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    keys = {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(parts[:i]) for i in range(1, len(parts) + 1)}
    best = None
    for name in {(e[0], e[1]) for e in entries}:
        state = False
        for _, _, action, _ in sorted((e for e in entries if (e[0], e[1]) == name and e[3] is not None and e[3] <= when), key=lambda e: (e[3], e[2] != "add")):
            state = action == "add"
        if state and name[1] in keys:
            rank = (name[1].count("/"), name[1].split("/")[0].count("."), name[0] == "allow")
            best = max(best or (rank, name[0]), (rank, name[0]))
    return best[1] if best else "none"


def test_against_replayed_lists(spark):
    rng = random.Random(1)
    keys = ["a.com", "x.a.com", "com", "x.a.com/p", "x.a.com/p/q", "b.org"]
    entries = [(rng.choice(["block", "allow"]), rng.choice(keys), rng.choice(["add", "add", "remove"]), at(rng.randrange(400))) for _ in range(60)] + [("block", None, "add", at(1)), ("block", "b.org", "add", None)]
    urls = ["http://x.a.com/p/q?z=1", "https://u@X.A.com:80/p", "http://a.com", "http://b.org./x//y", "junk", "", None, "http:///p"]
    rows = [(i, rng.choice(urls), at(rng.randrange(-20, 500)) if rng.random() < 0.95 else None, "old") for i in range(300)]
    rows += [rows[0], (None, urls[0], at(5), "old")]
    got = filter_urls(spark.createDataFrame(rows, "id long, url string, fetched_at timestamp, verdict string"), spark.createDataFrame(entries, "list string, key string, action string, at timestamp")).collect()
    assert sorted((-1 if r["id"] is None else r["id"], r["verdict"]) for r in got) == sorted((-1 if i is None else i, plain(u, t, entries)) for i, u, t, _ in rows)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.com", DAY)], "id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([], "list string, key string, action string, at timestamp")
    assert [r["verdict"] for r in filter_urls(captures, entries).collect()] == ["none"]
    assert filter_urls(captures.limit(0), entries).count() == 0


def test_query_matches_sql(spark):
    agree(queries.op8_url_filters(spark, SF), queries.ORACLE["op8_url_filters"])


def test_names_long_urls_and_unknown_entries(spark):
    """A column named like an internal one, a URL of a megabyte of path parts, and lists and actions that aren't known."""
    entries = spark.createDataFrame([("block", "a.com/p", "add", at(1)), ("monitor", "b.org", "add", at(1)), ("block", "b.org", "ADD", at(1)), ("block", "c.net", "add", at(1)), ("block", "c.net", "ADD", at(3))], "list string, key string, action string, at timestamp")
    rows = [(1, "http://a.com/p" + "/x" * 500_000, at(5), "u"), (2, "http://b.org/", at(5), "v"), (3, "http://c.net/", at(5), "w"), (4, "http://" + "l." * 2000 + "c.net", at(5), "w")]
    got = filter_urls(spark.createDataFrame(rows, "id long, url string, fetched_at timestamp, best string"), entries).select("id", "verdict", "best").collect()
    assert sorted(map(tuple, got)) == [(1, "block", "u"), (2, "none", "v"), (3, "block", "w"), (4, "block", "w")]

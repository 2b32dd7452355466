import re

from pyspark.sql import functions as F

from quillmark.llm import url_cascade as U

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/1", "https://www.example.com/en/x?q=1#a", "http://a.www.example.com/en/", "http://x.net/es/1", "http://x.net?/es/",
    "http://net/fr/", "ftp://a.b.Spam-Farm.example.org#x", "http://notspam-farm.example.org/", "http://free-bets.example.net/de/", "http://free-bets.example.net/es/2", "http://com", "http://com/", "a://b://c/d", "http://ÄB.com/é?",
    "\nhttp://q.example.net/en/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [(len(h), len(p), kind, h + p) for kind, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fitting:
        _, _, verdict, rule = max(fitting)
        return host, path, rule, verdict
    listed = any(host == k or host.endswith("." + k) for k in U.LISTED_KEYS)
    return host, path, None, "block" if listed else "allow"


def test_against_brute_force_with_clashing_columns_and_repeats(spark):
    rows = [(i, u, "old") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages).collect()}
    assert found == {i: brute(u) for i, u, _ in rows}


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact_over_its_universe_and_needs_several_levels(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 20_000, 7).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.sql("select 'elsewhere'"))
    (cascade,) = U.build_cascades(universe, listed)
    assert len(cascade.levels) > 1
    wrong = universe.join(listed.withColumn("m", F.lit(True)), "key", "left").where(cascade.listed(F.col("key")) != F.coalesce("m", F.lit(False)))
    assert wrong.count() == 0
    # several bits a key of the listed, not of the universe
    assert sum(level.bits for level in cascade.levels) < 30 * 20_000 / 7


def test_cascade_of_nothing_and_bounds(spark):
    keys = spark.createDataFrame([("a",), (None,)], "key string")
    (none,) = U.build_cascades(keys, spark.createDataFrame([], "key string"))
    assert [r[0] for r in keys.select(none.listed(F.col("key"))).collect()] == [False, False]


def test_lists_over_the_size_of_a_filter_are_asked_in_parts(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"http://h{i}.org/") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("_listed", F.lit("mine"))
    listed = [*U.LISTED_KEYS, *(f"h{i}.org" for i in range(0, 40, 2))]
    universe = spark.createDataFrame([(f"h{i}.org",) for i in range(40)], "key string")
    assert len(U.build_cascades(universe, spark.createDataFrame([(k,) for k in listed], "key string"), max_filter_bytes=16)) > 1
    out = U.filter_urls(pages, listed=listed, max_filter_bytes=16)
    assert out.columns == ["page_id", "url", "_listed", "host", "path", "rule", "verdict"]
    for r in out.collect():
        want = brute(r.url) if r.page_id < 100 else (f"h{r.page_id - 100}.org", "/", None, "allow" if r.page_id % 2 else "block")
        assert (r.host, r.path, r.rule, r.verdict) == want and r._listed == "mine"

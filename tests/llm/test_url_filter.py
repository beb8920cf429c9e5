from helpers import duck, save, same

from churnframe.llm import url_filter as U

SF01 = "/root/testdata/sf0.01"

URLS = [
    None, "", "no scheme/en/1", "http://", "http:///de/", "http://a.com", "HTTP://A.Com/de/1?x", "x://example.org/es/1",
    "https://www.example.org/en/12#t", "https://wwwexample.org/en/12", "http://example.org/en/2", "http://m.shop.com/fr/9.html",
    "http://b.net/q?u=http://c.com/de/", "http://cheap-pills.b.net/x/", "https://www.cheap-pills.b.net:80/x.html?y",
    "http://spam-farm.net", "http://org/", "http://É.COM/de/é", "http://a.net/" + "p" * 100_000, "http://cheap-pills.b.net/x/",
]


def pages(spark):
    rows = [(i, u, "<p>", "h", "r", "n") for i, u in enumerate(URLS)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string, name string")


def test_query_matches_sql(spark):
    same(U.query(spark, SF01), duck(SF01, U.SQL))


def test_hard_urls_match_sql(spark, scratch):
    save(pages(spark), scratch, "pages")
    for name in ("documents", "benchmark", "labels"):
        save(spark.range(1), scratch, name)
    sql = U.SQL.replace("FROM pages", f"FROM read_parquet('{scratch}/pages.parquet/*.parquet')")
    same(U.query(spark, scratch), duck(SF01, sql))


def test_hosts_and_paths(spark):
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages(spark), pages(spark).limit(0)).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("", "/de/", None, "allow")
    assert got[6] == ("a.com", "/de/1", "com/de/", "block")
    assert got[7] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[8] == ("www.example.org", "/en/12", "example.org/en/1", "block")
    assert got[9] == ("wwwexample.org", "/en/12", "org/", "allow")
    assert got[12] == ("b.net", "/q", None, "allow")


def test_no_listed_url_is_missed_and_false_positives_are_removed(spark, monkeypatch):
    """Far more members than bits: nearly all probes pass the filter."""
    member = spark.range(4000).selectExpr("concat('http://h', id, '.net/p') AS url")
    probe = spark.range(8000).selectExpr("id AS page_id", "concat('https://www.h', id, '.net/p/?q') AS url")
    monkeypatch.setattr(U, "KEYS_PER_BLOCK", 250)
    got = U.filter_urls(probe, member).collect()
    assert sum(r.maybe for r in got) > 6000
    assert {r.row.page_id for r in got if r.verdict == "block"} == set(range(4000))
    monkeypatch.undo()
    for limit in (U.MAX_BLOCKS, 16):  # a filter that is broadcast, and one joined by block
        monkeypatch.setattr(U, "MAX_BLOCKS", limit)
        got = U.filter_urls(probe, member).collect()
        assert sum(r.maybe for r in got) < 4200
        assert {r.row.page_id for r in got if r.verdict == "block"} == set(range(4000))


def test_query_lists_single_pages_written_differently(spark):
    sf1 = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf1}/pages.parquet")
    listed = {r.url for r in U.reported(pages).collect()}
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    assert len(listed) > 40 and not listed & set(urls.values())
    got = U.filter_urls(pages, U.reported(pages), carry=["page_id"]).where("rule IS NULL").collect()
    hosts = [r for r in got if any(f"{h}." in r.host for h in U.REPORTED_HOSTS)]
    assert {r.verdict for r in hosts} == {"allow", "block"}  # not all of a host
    blocked = [r for r in got if r.verdict == "block"]
    assert len(blocked) > 20 and all(any(f"{h}." in r.host for h in U.REPORTED_HOSTS) for r in blocked)
    assert all(int("".join(c for c in r.path if c.isdigit())) % 2 == 0 for r in blocked)


def test_empty_table(spark):
    assert U.filter_urls(pages(spark).limit(0), pages(spark)).count() == 0

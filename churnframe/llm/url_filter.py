"""URL filter: host / path rules first, then a blocked Bloom filter over a
list of canonical URLs, whose possible hits go to an exact hash join.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased;
path: from there up to ``? #`` or the end; NULL or no ``://``: both empty.  A
rule (host, path) fits its host and all subdomains if the URL's path starts
with the rule's path; the longest fitting rule decides.

Canonical URL: scheme, port, query, fragment, a leading ``www. m. blog.``, a
trailing ``/`` and ``.html`` are dropped, A-Z of the host lower-cased.

Filter: one 64-bit word per block; a key picks its block and ``BITS_PER_KEY``
bits in it.  Blocks grow with the list, so its share of false positives does
not.  A filter of at most ``MAX_BLOCKS`` words is broadcast (8 MB); a larger
one is joined by block, which the hash spreads evenly.  The exact join removes
the non-members that the filter let through.

The query's list stands for one of reported pages: of the hosts in
``REPORTED_HOSTS`` the pages of even number, written in another way than the
page's own URL (scheme, ``www.``, a trailing ``/``, no query).  Other pages of
these hosts are not on it.

Defined results: NULL, empty and malformed URLs have empty host and path, no
rule and no canonical URL: allowed.  Repeated pages and list entries change
nothing; very long URLs are read whole; an empty list allows all URLs without
a rule; extra columns ride in ``row``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnframe.llm import common as C

#: Fixed values of the query's contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Host labels whose pages are on the query's list, if their number is even.
REPORTED_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

MAX_BLOCKS = 1 << 20  # words of a filter that is broadcast
KEYS_PER_BLOCK = 4
BITS_PER_KEY = 6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; NULL if there is none."""
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, url.substr(at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """NULL if there is no host."""
    bare = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^(www|m|blog)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(/|\.html)$", "")))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; NULL if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        own = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, own).otherwise(out)
    return out


def _mask(key: Column) -> Column:
    """``BITS_PER_KEY`` bits of a 64-bit word, six hash bits for each."""
    h = F.xxhash64(key, F.lit(1))
    place = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), place(i)) for i in range(BITS_PER_KEY)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(blocks))


def bloom(listed: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The filter as (block, word) rows, and its number of blocks."""
    n = listed.count()
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n:
        blocks *= 2
    key = F.col(column)
    words = listed.select(_block(key, blocks).alias("block"), _mask(key).alias("word"))
    return words.groupBy("block").agg(F.bit_or("word").alias("word")), blocks


def filter_urls(
    pages: DataFrame, listed: DataFrame, url_col: str = "url", carry: list[str] | None = None, rules=RULES
) -> DataFrame:
    """``row``, ``host``, ``path``, ``rule``, ``verdict`` and ``maybe`` (the
    Bloom filter let it through).  ``listed`` has a column ``url``."""
    C.ensure_checkpoint_dir(pages.sparkSession)
    names = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("name"))
    names = C.materialise(names.where("name IS NOT NULL").distinct())
    words, blocks = bloom(names, "name")

    parsed = pages.select(C.packed(pages, carry), F.col(C.quoted(url_col)).cast("string").alias("url"))
    parsed = parsed.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    parsed = parsed.withColumn("name", canonical(F.col("host"), F.col("path")))
    parsed = parsed.withColumn("block", _block(F.col("name"), blocks))
    probed = parsed.join(F.broadcast(words) if blocks <= MAX_BLOCKS else words, "block", "left")
    mask = _mask(F.col("name"))
    maybe = F.coalesce(F.col("word").bitwiseAND(mask) == mask, F.lit(False)) & F.col("name").isNotNull()
    probed = probed.withColumn("maybe", maybe)
    # only possible hits go to the exact join
    hits = probed.where("maybe").join(names.withColumnRenamed("name", "listed"), F.col("name") == F.col("listed"), "left")
    hits = hits.select("row", "host", "path", "found", "maybe", F.col("listed").isNotNull().alias("is_listed"))
    clear = probed.where(~F.col("maybe")).select("row", "host", "path", "found", "maybe", F.lit(False).alias("is_listed"))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow")))
    return hits.unionByName(clear).select("row", "host", "path", "found.rule", verdict.alias("verdict"), "maybe")


def reported(pages: DataFrame) -> DataFrame:
    """The query's list: ``url`` of each reported page, written differently."""
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    label = F.regexp_extract(host, r"(?:^|\.)(" + "|".join(REPORTED_HOSTS) + r")(?:\.|$)", 1)
    number = F.regexp_extract(path, r"(\d+)[^\d]*$", 1)
    other = F.concat(F.lit("HTTPS://www."), F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""), F.lit("/"))
    return pages.where((label != "") & number.rlike("[02468]$")).select(other.alias("url"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    found = filter_urls(pages, reported(pages), carry=["page_id"])
    return found.select("row.page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
named AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN
    regexp_replace(regexp_replace(host, ':\d*$', ''), '^(www|m|blog)\.', '') || regexp_replace(path, '(/|\.html)$', '')
  END AS name FROM p),
listed AS (
  SELECT DISTINCT name FROM named
  WHERE regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)(\.|$)')
    AND regexp_matches(regexp_extract(path, '(\d+)[^\d]*$', 1), '[02468]$'))
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN name IN (SELECT name FROM listed WHERE name IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN best USING (page_id)
"""

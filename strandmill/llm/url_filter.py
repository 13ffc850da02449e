"""URL filter: a blocked Bloom filter ahead of an exact hash join, in DataFrame functions only.

Rules (host and path prefix, block or allow) are judged first; they are few and part
of the plan. For the rest a list of canonical URLs decides. The list is hashed into
blocks of 256 bits (four longs, two bits in each), so that a lookup is one hash join
with the table of blocks. URLs that pass it are joined exactly with the list, which
removes the false positives; the others never reach that join. Both tables are
broadcast only after a count.

Canonical form: scheme dropped, host lower-cased and without a leading ``www.``, ``m.``
or ``blog.`` left as it is, path without a trailing slash, no query, no fragment.

Defined results: a null url or one without ``://`` has an empty host and path, fits
no rule and no listed URL and is allowed. Repeated rows are judged alike. An empty
list blocks nothing. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, sized, table

#: (host, path prefix, verdict); the longest fitting rule wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: First labels of hosts whose pages the query lists.
LISTED_LABELS = ("spam-farm", "adult-x", "cheap-pills", "ads-track", "casino-win", "free-bets")
BITS_PER_URL, BLOCK_BITS = 12, 256


def host_and_path(url):
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host, path):
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/$", ""))


def rule_of():
    """The longest fitting rule as text like net/, else null."""
    out = None
    for host, path, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, host + path) if out is None else out.when(fits, host + path)
    return out


def _masks(h):
    """Two bits in each of four longs, from one hash; 6 hash bits a bit."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, m0..m3) of listed(canonical)."""
    h = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)).alias("block"), *[m.alias(f"b{i}") for i, m in enumerate(_masks(F.xxhash64("canonical", F.lit(7))))])
    return h.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"m{i}") for i in range(4)])


def filter_urls(pages: DataFrame, listed: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, host, path, rule, listed (boolean) and verdict of every page(page_id, url); listed(canonical) are the blocked URLs."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule_of(), "canonical": F.when(F.col("host") != "", canonical(F.col("host"), F.col("path")))})
    listed = scratch.save(listed.where("canonical is not null").select("canonical").distinct(), "listed")
    n = listed.count()
    n_blocks = max(1, n * BITS_PER_URL // BLOCK_BITS + 1)
    blocks = sized(scratch.save(bloom(listed, n_blocks), "bloom"))
    asked = parsed.withColumns({"block": F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)), **{f"q{i}": m for i, m in enumerate(_masks(F.xxhash64("canonical", F.lit(7))))}})
    passed = F.lit(True)
    for i in range(4):
        passed = passed & (F.col(f"m{i}").bitwiseAND(F.col(f"q{i}")) == F.col(f"q{i}"))
    looked = asked.join(blocks, "block", "left").withColumn("possible", F.coalesce(passed, F.lit(False)) & F.col("canonical").isNotNull() & F.col("rule").isNull())
    columns = ["page_id", "host", "path", "rule", "canonical"]
    exact = sized(listed.withColumn("listed", F.lit(True)))
    hits = looked.where("possible").select(columns).join(exact, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = hits.unionByName(looked.where("not possible").select(columns).withColumn("listed", F.lit(False)))
    blocked = F.col("rule").isin([h + p for h, p, v in RULES if v == "block"])
    return out.select("page_id", "host", "path", "rule", "listed", F.when(F.when(F.col("rule").isNotNull(), blocked).otherwise(F.col("listed")), "block").otherwise("allow").alias("verdict"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: canonical URLs of pages of known bad hosts."""
    host, path = host_and_path(F.col("url"))
    of = pages.select(host.alias("host"), path.alias("path")).where(F.regexp_extract("host", r"^(?:(?:www|m|blog)\.)?([^.]+)", 1).isin(*LISTED_LABELS))
    return of.select(canonical(F.col("host"), F.col("path")).alias("canonical"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, listed_urls(pages), Scratch(spark, "url-filter"))


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
x AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') AS canonical,
  regexp_extract(host, '^(?:(?:www|m|blog)\.)?([^.]+)', 1) IN ('spam-farm', 'adult-x', 'cheap-pills', 'ads-track', 'casino-win', 'free-bets') AS bad FROM h),
l AS (SELECT DISTINCT canonical FROM x WHERE bad)
SELECT page_id, host, path, rule, rule IS NULL AND host <> '' AND canonical IN (SELECT canonical FROM l) AS listed,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN host <> '' AND canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM x
"""

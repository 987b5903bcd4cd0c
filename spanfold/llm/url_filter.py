"""Operator 4, URL filters: ordered host and path rules, then a blocked Bloom filter in front of an exact hash join.

A url that no rule fits is blocked if its canonical form is listed. The list's canonical urls set bits in a blocked
Bloom filter: one hash picks a block of 512 bits (eight longs), two more set PROBES bits in it. Blocks are rows, made by
one aggregation; their size follows from the number of listed urls. Up to MOST_BLOCK_BYTES they are broadcast and urls
are tested where they are, so that only possible hits are shuffled; beyond it distinct urls meet their block by a join
on its number. The exact join of distinct possible hits with the list removes false positives. Rows meet the verdict of
their url in a join, but for frequent urls: those that hold more than one row in MOST_FREQUENT of the rows asked are at
most MOST_FREQUENT many, and their verdicts are broadcast (up to MOST_BLOCK_BYTES of them), so no task gets their rows.

A canonical url has no scheme and fragment; host in lower case without `www.` and a default port; path without a
trailing slash, `index.html` or `.html`; query parameters without tracking ones (TRACKING), in order.

Defined cases: a null url, or one without `://`, has empty host and path, no rule, and is allowed (it has no canonical
form); null ids and repeated rows are kept; an empty list allows, an empty table gives an empty result; further columns
(`host`, `rule` and the like among them) are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_dir, stored

#: The fixed rules of the query: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
BITS_PER_URL, BLOCK_BITS, PROBES = 16, 512, 8
#: What may be broadcast, and how many urls may count as frequent ones.
MOST_BLOCK_BYTES, MOST_FREQUENT = 64 << 20, 10_000
BYTES_PER_BLOCK = 8 * (BLOCK_BITS // 64 + 1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first `://` to the next `/`, `?` or `#`, A-Z in lower case; empty where there is none."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", ""))
    return F.coalesce(F.translate(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", ""))
    return F.coalesce(F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def rule_verdict(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = None
    for verdict, rule_host, rule_path in longest:
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = (F.when if out is None else out.when)(fits(host, path, rule_host, rule_path), value)
    return out


def canonical(url: Column) -> Column:
    """The canonical form; null where the url has no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def with_probes(rows: DataFrame) -> DataFrame:
    """rows with `probes`: PROBES bit positions of the canonical url in its block, nine bits each, half of them from each of two hashes."""
    halves = [F.xxhash64(F.lit(name), F.col("canonical")) for name in ("bits", "more bits")]
    return rows.withColumn("probes", F.array(*[F.shiftright(h, 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for h in halves for i in range(PROBES // 2)]))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, words): the blocks that any listed url sets bits in, as arrays of longs; listed: (canonical)."""
    bits = with_probes(listed).select(block_of(F.col("canonical"), blocks).alias("block"), F.explode("probes").alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)))
    words = [F.coalesce(F.bit_or(F.when(F.shiftright("p", 6) == w, bit)), F.lit(0).cast("long")) for w in range(BLOCK_BITS // 64)]
    return bits.groupBy("block").agg(F.array(*words).alias("words"))


def passes() -> Column:
    """Whether all bits at a row's `probes` are set in the block beside it (`words`); false where there is none."""
    out = F.col("words").isNotNull() & F.col("canonical").isNotNull()
    for i in range(PROBES):
        p = F.get("probes", F.lit(i))
        word = F.get("words", F.shiftright(p, 6))
        out = out & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.coalesce(out, F.lit(False))


def with_possible(rows: DataFrame, listed: DataFrame, folder: str, most_bytes: int = MOST_BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(stored rows with `possible`, their distinct urls with `n` rows and `maybe`, whether they pass the filter); rows: canonical (null: not asked) and others."""
    blocks = max(1, -(-listed.count() * BITS_PER_URL // BLOCK_BITS))
    table, number = bloom(listed, blocks), block_of(F.col("canonical"), blocks)
    counted = F.count("*").alias("n")
    if blocks * BYTES_PER_BLOCK <= most_bytes:
        met = with_probes(rows).withColumn("block", number).join(F.broadcast(table), "block", "left")
        rows = stored(met.withColumn("possible", passes()).drop("block", "probes", "words"), folder, "rows")
        return rows, stored(rows.filter("possible").groupBy("canonical").agg(counted).withColumn("maybe", F.lit(True)), folder, "asked")
    rows = stored(rows.withColumn("possible", F.col("canonical").isNotNull()), folder, "rows")
    asked = with_probes(rows.filter("possible").groupBy("canonical").agg(counted)).withColumn("block", number)
    return rows, stored(asked.join(table, "block", "left").select("canonical", "n", passes().alias("maybe")), folder, "asked")


def with_listed(rows: DataFrame, listed: DataFrame, folder: str, most_bytes: int = MOST_BLOCK_BYTES, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """rows with `listed`: whether their canonical url (null: no) is in listed, distinct and stored, of one column `canonical`."""
    rows, asked = with_possible(rows, listed, folder, most_bytes)
    hits = stored(asked.filter("maybe").select("canonical").join(listed, "canonical", "left_semi"), folder, "hits").withColumn("listed", F.lit(True))
    total = rows.filter("possible").count()
    often = asked.filter(F.col("n") * most_frequent > total).join(hits, "canonical", "left").select("canonical", F.coalesce("listed", F.lit(False)).alias("often"))
    out, met = rows.filter("not possible").withColumn("listed", F.lit(False)), rows.filter("possible")
    if (often.agg(F.sum(F.octet_length("canonical") + 16)).first()[0] or 0) <= most_bytes:  # else urls of many kilobytes: Spark splits what is skewed
        met = met.join(F.broadcast(often), "canonical", "left")
        out = out.unionByName(met.filter("often is not null").withColumn("listed", F.col("often")).drop("often"))
        met = met.filter("often is null").drop("often")
    rest = met.join(hits, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return out.unionByName(rest).drop("possible")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages; listed: urls to block, one column `url`."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "urls")
    block_list = stored(listed.select(canonical(F.col("url").cast("string")).alias("canonical")).filter("canonical is not null").distinct(), folder, "listed")
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.withColumn("ruled", rule_verdict(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("canonical", F.when(F.col("ruled").isNull(), F.col("canonical")))  # what a rule settles is not asked
    out = with_listed(rows, block_list, folder)
    verdict = F.when(F.col("ruled").isNotNull(), F.col("ruled.verdict")).when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"))


def repeated_urls(pages: DataFrame) -> DataFrame:
    """The query's block list: canonical urls that more than one page carries (mirrors and syndicated copies)."""
    own = pages.select(canonical(F.col("url").cast("string")).alias("c")).filter("c is not null")
    return own.groupBy("c").count().filter("count > 1").select(F.concat(F.lit("http://"), "c").alias("url"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judge(pages, repeated_urls(pages))


_PARTS = r"""
with a as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
h as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') as path,
    coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '') as query from a),
c as (
  select *, case when regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') <> '' then
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '')
    || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical
  from (select *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) as kept from h)),
listed as (select canonical from c where canonical is not null group by canonical having count(*) > 1)
"""
ORACLE_SQL = _PARTS + r"""
select page_id, host, path,
  case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule,
  case rule when 'www.example.com/en/' then 'allow' when 'example.com/en/' then 'block' when 'net/es/' then 'block' when 'net/fr/' then 'block' when 'com/' then 'allow'
    else case when canonical in (select canonical from listed) then 'block' else 'allow' end end as verdict
from c
"""

"""URL rules and block lists through Bloom filter cascades.

A cascade gives exact membership for every key of a known universe. Level 1 holds the listed keys; level 2 the keys of the universe that
level 1 takes by mistake; level 3 the listed keys that level 2 takes by mistake, and so on until a level makes none. A key is
judged by the first level that does not hold it. The universe is all keys that the corpus's urls can ask for, so each answer
is exact, and a url is judged by probes alone, without a join.

Listed are the keys of the rules and hosts: given ones, such as junk_hosts() finds by what their pages hold, and domains of the corpus with an unwanted word in their name. Up to
``MOST_LISTED`` of them are collected as hashes of 8 bytes, after they were counted, and the levels shrink by half, so what is broadcast (16 MB of hashes while a cascade is built, then its
filters) has a bound that depends on the list and only through a logarithm on the universe. A longer list goes another way: an exact join. Equality of keys is that of 64-bit hashes.

Defined results: a null url, or one without ://, has empty host and path, fits no rule and is allowed; repeated urls get equal
results; urls of any length are judged whole; further columns play no part; an empty table gives none. Of rules that fit, the longest by characters wins; of equals the one with the longer host.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm import kernels as K
from veriledger.llm.storage import materialise
from veriledger.llm.workers import lean

MOST_LISTED = 2_000_000
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words between dots and hyphens of a domain's name that make it, and its subdomains, unwanted.
UNWANTED = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez")

#: A page with so many signs in a row is junk; so many percent of junk pages make a host unwanted.
JUNK, JUNK_SHARE = "[#*$%]{3}", 5


def key_hashes(keys: pa.Array) -> np.ndarray:
    data, offsets = K.strings(keys)
    return K.span_hash(K.prefix_hash(data), offsets[:-1], offsets[1:])


class Bloom:
    """Blocks of bits; all probes of a key follow from two halves of one hash, salted by level."""

    def __init__(self, hashes: np.ndarray, rate: float, salt: int):
        n = max(1, len(hashes))
        rate = min(0.5, max(rate, 1e-9))
        self.salt, self.k = np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64), max(1, round(-math.log2(rate)))
        self.m = np.uint64(max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2)))
        self.bits = np.zeros(int(self.m) // 8 + 1, np.uint8)
        for at in self._places(hashes):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _places(self, hashes: np.ndarray):
        a = K.mix(hashes + self.salt)
        b = K.mix(a) | np.uint64(1)
        for i in range(self.k):
            yield (a + np.uint64(i) * b) % self.m

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


class Cascade:
    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that the cascade was built over."""
        out = np.full(len(hashes), len(self.levels) % 2 == 1)
        open_ = np.arange(len(hashes))
        for i, level in enumerate(self.levels):
            passed = level.holds(hashes[open_])
            out[open_[~passed]] = i % 2 == 1
            open_ = open_[passed]
        return out


def hashes_of(keys: DataFrame) -> np.ndarray:
    """The different hashes of a table of one column of keys, collected: for tables whose rows were counted."""

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(key_hashes(batch.column(0)).view(np.int64))], ["hash"])

    return np.unique(np.asarray(keys.mapInArrow(lean(hashed), "hash long").toArrow()["hash"].combine_chunks()).view(np.uint64))


def build(listed: Iterable[str] | np.ndarray, universe: DataFrame, n_universe: int) -> Cascade:
    """listed: keys or their hashes; universe: one column of distinct keys. Keys listed that no url asks for do no harm."""
    inside = listed if isinstance(listed, np.ndarray) else np.unique(key_hashes(pa.array(list(listed), pa.string())))
    if len(inside) > MOST_LISTED:
        raise ValueError(f"a cascade takes at most {MOST_LISTED} listed keys, not {len(inside)}; judge() joins longer lists")
    first = Bloom(inside, math.sqrt(0.5) * len(inside) / max(1, n_universe), 0)
    sent = universe.sparkSession.sparkContext.broadcast((first, inside))

    def mistakes(batches):
        level, own = sent.value
        for batch in batches:
            hashes = key_hashes(batch.column(0))
            yield batch.filter(pa.array(level.holds(hashes) & ~np.isin(hashes, own)))

    # the first level takes about 0.7 times as many by mistake as there are listed keys
    outside = hashes_of(universe.toDF("key").mapInArrow(lean(mistakes), "key string"))
    levels, held, wrong = [first], inside, outside
    while len(wrong):
        level = Bloom(wrong, 0.5, len(levels))
        levels.append(level)
        held, wrong = wrong, held[level.holds(held)]
    return Cascade(levels)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def asked_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a url may be listed under: each domain, and each domain with a start of the path of a length that rules have."""
    own = suffixes(host)
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull())
    return F.array_distinct(F.concat(own, F.flatten(F.transform(own, lambda d: F.transform(starts, lambda p: F.concat(d, p))))))


def unwanted_domains(universe: DataFrame, words: Iterable[str]) -> DataFrame:
    """(key): the domains of the universe whose own name, the part before the first dot, has one of the words."""
    own = F.split(F.substring_index("key", ".", 1), "-", -1)
    words = F.array(*[F.lit(w) for w in sorted(set(words))]).cast("array<string>")
    return universe.where(~F.contains("key", F.lit("/")) & F.arrays_overlap(own, words)).select("key")


def junk_hosts(pages: DataFrame, *, share: int = JUNK_SHARE) -> DataFrame:
    """(key): hosts of which at least share percent of the pages hold junk. Counted by host with partial sums, so a host with most of the pages is no burden; a null html is no junk."""
    seen = pages.select(host_of(F.col("url")).alias("key"), F.coalesce(F.col("html").rlike(JUNK), F.lit(False)).alias("junk")).where("key <> ''")
    return seen.groupBy("key").agg(F.count("*").alias("n"), F.count_if("junk").alias("n_junk")).where(F.col("n_junk") * 100 >= F.col("n") * share).select("key")


def judged_by_join(urls: DataFrame, block: DataFrame, allow: DataFrame) -> DataFrame:
    """The way for lists beyond the bound: judge() for urls (page_id, host, path, keys) by a join with the listed keys. Repeated rows stay."""
    # a key that is both is blocked, as the cascades have it
    listed = block.select("key", F.lit("block").alias("verdict")).union(allow.select("key", F.lit("allow"))).groupBy("key").agg(F.max("verdict").alias("verdict"))
    # one row for each host and path, so repeated urls meet the list once
    asked = urls.select("host", "path", F.explode("keys").alias("key")).distinct()
    hits = asked.join(listed, "key").withColumn("ruled", F.instr("key", "/") > 0)
    best = hits.groupBy("host", "path").agg(F.max(F.when(F.col("ruled"), F.struct(F.length("key").alias("n"), F.instr("key", "/").alias("at"), "key", "verdict"))).alias("best"))
    done = urls.join(best.withColumn("hit", F.lit(True)), ["host", "path"], "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("hit"), "block").otherwise("allow"))
    return done.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, *, rules=RULES, listed_hosts: DataFrame | Iterable[str] = (), unwanted: Iterable[str] = UNWANTED) -> DataFrame:
    """page_id, host, path, rule, verdict. listed_hosts: hosts to block with their subdomains, as a table's column key or as strings."""
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules})
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("keys", asked_keys(F.col("host"), F.col("path"), lengths))
    universe = materialise(urls.select(F.explode("keys").alias("key")).distinct())
    table = lambda keys: spark.createDataFrame(pa.table([pa.array(sorted(set(keys)), pa.string())], names=["key"]))
    hosts = listed_hosts if isinstance(listed_hosts, DataFrame) else table(listed_hosts)
    block = table(h + p for h, p, v in rules if v == "block").union(hosts.select("key")).union(unwanted_domains(universe, unwanted)).distinct()
    allow = table(h + p for h, p, v in rules if v == "allow")
    # keys that no url asks for need no room
    block, allow = (materialise(listed.join(universe, "key", "left_semi")) for listed in (block, allow))
    if max(block.count(), allow.count()) > MOST_LISTED:
        return judged_by_join(urls, block, allow)
    n = universe.count()
    sent = spark.sparkContext.broadcast(tuple(build(hashes_of(listed), universe, n) for listed in (block, allow)))

    def run(batches):
        blocked, allowed = sent.value
        for batch in batches:
            keys = batch.column(3)
            flat, cuts = keys.flatten(), np.concatenate(([0], np.cumsum([len(k) for k in keys.to_pylist()])))
            hashes = key_hashes(flat)
            b, a = blocked.holds(hashes), allowed.holds(hashes)
            names = flat.to_pylist()
            rule, verdict = [], []
            for i in range(batch.num_rows):
                hit = [(len(names[j]), names[j].find("/"), names[j], "block" if b[j] else "allow") for j in range(cuts[i], cuts[i + 1]) if b[j] or a[j]]
                ruled = max((h for h in hit if "/" in h[2]), default=None)
                rule.append(ruled[2] if ruled else None)
                verdict.append(ruled[3] if ruled else "block" if hit else "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(lean(run), "page_id long, host string, path string, rule string, verdict string")


def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are listed by what their pages hold, which no url shows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, listed_hosts=junk_hosts(pages), unwanted=())


QUERIES = {"op9_bloom_cascade": op9_bloom_cascade}
SQL = {
    "op9_bloom_cascade": rf"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, p, v)),
j AS (SELECT host FROM s WHERE host <> '' GROUP BY host HAVING count(*) FILTER (WHERE regexp_matches(html, '{JUNK}')) * 100 >= count(*) * {JUNK_SHARE}),
l AS (SELECT h.host, bool_or(j.host IS NOT NULL) AS listed FROM (SELECT DISTINCT host FROM s) h LEFT JOIN j ON h.host = j.host OR ends_with(h.host, '.' || j.host) GROUP BY h.host),
b AS (SELECT s.*, (SELECT arg_max(struct_pack(rule := h || p, v := v), length(h || p) * 1000 + length(h)) FROM r WHERE (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)) AS best FROM s)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM b JOIN l USING (host)"""
}

"""URL filters by a Bloom filter cascade, in DataFrame functions only.

A rule list holds (host, path, verdict). A rule fits its host and every
subdomain when the url's path starts with the rule's path; the longest rule
that fits wins. Each url yields the few keys that could be rules: its host
suffixes (as many labels as the longest rule has) joined to its path prefixes
(only lengths that rules have). All those keys over the corpus are the key
universe. For each verdict a cascade is built over that universe: level 1
encodes the listed keys, level 2 the universe keys that level 1 wrongly
reports, level 3 the listed keys that level 2 reports, and so on until a level
reports nothing wrong. Within the universe, membership is then exact: the first
level that denies a key decides it. The url table is filtered by expressions
over literals, without a join. Lists whose first level would take more than a
bound of bits are dealt to shards by a hash of the key, each with cascades of
its own over its share of the universe, and the table passes the shards in turn.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule. Rows are kept as they are, repeated ones included, and other
columns are not touched. A key listed both ways is blocked. Of two fitting
rules of equal length the one with the longer host wins. An empty rule list
gives the default verdict everywhere.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, lower_ascii, scratch_path, stage

#: Bits of a cascade's first level (the others are smaller) that are placed in a plan as literals, about (1 MiB).
MAX_BITS = 8 << 20
WORD = 32


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


class BloomLevel:
    """One bit array: m bits in 32-bit words, k positions for each key."""

    def __init__(self, level: int, bits: int, hashes: int):
        self.level, self.bits, self.hashes = level, bits, hashes
        self.words: list[int] = []

    def positions(self, key: Column) -> list[Column]:
        # double hashing; both parts are below `bits`, so the sums cannot overflow
        first = F.pmod(F.xxhash64(F.lit(2 * self.level), key), F.lit(self.bits))
        second = F.pmod(F.xxhash64(F.lit(2 * self.level + 1), key), F.lit(self.bits))
        return [F.pmod(first + F.lit(i) * second + F.lit(i * i), F.lit(self.bits)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> "BloomLevel":
        """Sets the keys' bits; at most bits / 32 rows come to the driver."""
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % WORD).cast("int"))
        found = at.groupBy((F.col("at") / WORD).cast("bigint").alias("w")).agg(F.bit_or(bit).alias("b")).collect()
        self.words = [0] * (self.bits // WORD + 1)
        for row in found:
            self.words[row["w"]] = row["b"]
        return self

    def has(self, key: Column) -> Column:
        # the split of a literal is folded into one array literal
        packed = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        tests = [
            F.getbit(F.get(packed, (p / WORD).cast("int")), (p % WORD).cast("int")) == 1 for p in self.positions(key)
        ]
        return reduce(lambda a, b: a & b, tests)


def miss_rate(n_listed: int, n_other: int) -> float:
    """Of the first level: the false positives should be about as many as the listed keys."""
    return min(0.5, n_listed / (max(1, n_other) * math.sqrt(2)))


def level_bits(n: int, rate: float) -> int:
    return max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2)) if n else 0


class BloomCascade:
    """Exact membership in `listed` for every key of `universe`; both have one column, key, without repeats."""

    def __init__(self, levels: list[BloomLevel]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> "BloomCascade":
        levels: list[BloomLevel] = []
        n_inside = listed.count()
        rate = miss_rate(n_inside, universe.count()) if n_inside else 0.5
        inside, outside = listed, universe
        while n_inside:
            bits = level_bits(n_inside, rate)
            level = BloomLevel(len(levels), bits, max(1, round(bits / n_inside * math.log(2)))).fill(inside)
            levels.append(level)
            wrong = outside.where(level.has(F.col("key")))
            if len(levels) == 1:  # the universe still holds listed keys: take them out of what passed
                both = wrong.withColumn("listed", F.lit(0)).unionByName(listed.withColumn("listed", F.lit(1)))
                wrong = both.groupBy("key").agg(F.max("listed").alias("listed")).where("listed = 0").select("key")
            wrong = stage(wrong, "cascade")
            outside, inside, n_inside, rate = inside, wrong, wrong.count(), 0.5
        return cls(levels)

    def has(self, key: Column) -> Column:
        """True for listed keys. Levels alternate: an even level denies, an odd one confirms."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for at in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(self.levels[at].has(key), verdict).otherwise(F.lit(at % 2 == 1))
        return verdict


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Array of struct(size, host_size, key): every rule that could fit, without repeats."""
    found = []
    for n in range(1, labels + 1):
        suffix = F.substring_index(host, ".", -n)
        for size in lengths:
            key = F.concat(suffix, F.substring(path, 1, size) if size else F.lit(""))
            entry = F.struct(
                F.length(key).alias("size"), F.length(suffix).alias("host_size"), key.alias("key")
            )
            found.append(F.when((host != "") & (F.length(path) >= size), entry))
    return F.array_distinct(F.array_compact(F.array(*found)))


def judge_urls(
    urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", size_bound: int = MAX_BITS
) -> DataFrame:
    """urls with host, path, rule and verdict added (replacing columns so named).

    rules: host, path, verdict ('allow' or 'block'); rows with a null are ignored.
    """
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").select(
        lower_ascii(F.col("host")).alias("host"), "path", "verdict"
    )
    shape = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    urls = urls.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    if not shape["labels"]:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidate_keys(F.col("host"), F.col("path"), shape["labels"], sorted(shape["lengths"]))
    listed = {
        v: rules.where(F.col("verdict") == v).select(F.concat("host", "path").alias("key")).distinct()
        for v in ("allow", "block")
    }
    universe = stage(urls.select(F.explode(keys).alias("k")).select("k.key").distinct(), "url-universe")
    n_other, n_listed = universe.count(), [t.count() for t in listed.values()]
    bits = max(level_bits(n, miss_rate(n, n_other)) for n in n_listed if n)
    shards = max(1, -(-bits // size_bound))

    spark, best, before = urls.sparkSession, None, None
    for shard in range(shards):
        mine = F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(shards)) == shard
        cascades = {v: BloomCascade.build(t.where(mine), universe.where(mine)) for v, t in listed.items()}
        found = _fitting(keys, cascades, shard, shards)
        best = found if best is None else F.greatest("rule", found)  # rule holds the best of the shards before
        urls = urls.withColumn("rule", best)
        if shards > 1:
            path = scratch_path(spark, "url-rows")
            urls = stage(urls, "url-rows", path)
            if before:
                drop_path(spark, before)
            before = path
    verdict = F.coalesce(F.col("rule.verdict"), F.lit(default))
    return urls.withColumns({"rule": F.col("rule.key"), "verdict": verdict})


def _fitting(keys: Column, cascades: dict[str, BloomCascade], shard: int, shards: int) -> Column:
    """The longest of the keys that a shard lists, with its verdict, or null."""

    def judged(k):
        verdict = F.when(cascades["block"].has(k["key"]), "block").when(cascades["allow"].has(k["key"]), "allow")
        if shards > 1:
            verdict = F.when(F.pmod(F.xxhash64(F.lit(-1), k["key"]), F.lit(shards)) == shard, verdict)
        return F.struct(k["size"].alias("size"), k["host_size"].alias("host_size"), k["key"].alias("key"), verdict.alias("verdict"))

    return F.array_max(F.filter(F.transform(keys, judged), lambda k: k["verdict"].isNotNull()))

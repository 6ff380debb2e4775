"""URL rules and domain lists decided by Bloom filter cascades. DataFrame operations only.

A cascade tells exactly which keys of a known universe are listed. Level 1 is a Bloom filter of the
listed keys; level 2 holds the keys of the universe that level 1 takes for listed but are not; level 3
the listed keys that level 2 takes for those; and so on, until a level makes no mistakes. The universe
here is every key that any url of the corpus can match: each end of its host at a dot, alone and with
the first characters of its path for every length that listed keys have. Probing is arithmetic on a
constant array, so urls meet no join and no shuffle.

The size of a level is bounded by ``MAX_BITS`` whatever the list: a fuller filter makes more mistakes
and the cascade more levels, but it stays exact. If a level would be so full that it can't thin out its
keys, or levels run out, the keys left over are listed by an ordinary join instead (``exact``), and
the answer is the same.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there to ``?``,
``#`` or the end. Null urls and urls without ``://`` have both empty and match nothing. A rule fits its
host and all hosts that end in a dot and it, if the path starts with the rule's path; the longest
rule wins, of equally long ones the smallest. Repeated rows are judged each; without rules or listed
domains every url gets the default verdict.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride.session import materialize

BITS_PER_KEY = 10
HASHES = 4
MAX_BITS = 1 << 23        # a level of 1 MiB
MAX_LEVELS = 24
LEAST_BITS = 512
ALLOW, BLOCK = "allow", "block"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_ends(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(ends)


def keys_of(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every key a url can match: host ends, alone (a listed domain) and with path beginnings (a rule)."""
    ends = host_ends(host)
    none = F.array().cast("array<string>")

    def with_path(n: int) -> Column:
        rules = F.transform(ends, lambda e: F.concat(F.lit("r "), e, F.substring(path, 1, n)))
        return F.when(F.char_length(path) >= n, rules).otherwise(none)

    return F.array_distinct(F.concat(F.transform(ends, lambda e: F.concat(F.lit("d "), e)), *map(with_path, lengths)))


@dataclass
class Level:
    bits: int
    words: Column   # the filter, a constant array of 64-bit words
    turn: int

    def holds(self, key: Column) -> Column:
        tests = [
            F.call_function("shiftright", F.get(self.words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int"))
            .bitwiseAND(F.lit(1)) == 1
            for at in positions(key, self.bits, self.turn)
        ]
        met = tests[0]
        for t in tests[1:]:
            met = met & t
        return met


def positions(key: Column, bits: int, turn: int) -> list[Column]:
    """Bit positions of a key; each level hashes anew."""
    return [F.pmod(F.xxhash64(F.lit(turn * HASHES + i), key), F.lit(bits).cast("bigint")) for i in range(HASHES)]


def _level(keys: DataFrame, count: int, turn: int) -> Level:
    bits = min(MAX_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, count) * BITS_PER_KEY))))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, turn))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    # At most ``bits / 64`` rows, 131,072, reach the driver.
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(one).alias("v"))
    filled = [0] * (bits // 64)
    for row in words.collect():
        filled[row.w] = row.v
    return Level(bits, F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>"), turn)


@dataclass
class Cascade:
    levels: list[Level]
    rest: DataFrame | None = None  # keys the last level is wrong about, if levels ran out

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed: odd levels hold listed keys, even ones the others."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            passed = self.levels[i].holds(key)
            answer = F.when(passed, answer).otherwise(F.lit(i % 2 == 1))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade for distinct keys (``key``); keys outside the universe are left out first."""
    ours = materialize(universe.join(listed, "key", "left_semi"))
    others = materialize(universe.join(listed, "key", "left_anti"))
    levels: list[Level] = []
    inside, outside, before = ours, others, None
    while True:
        count = inside.count()
        if not count:
            return Cascade(levels)
        if len(levels) == MAX_LEVELS or before is not None and count >= before[len(levels) % 2]:
            return Cascade(levels, inside)
        level = _level(inside, count, len(levels))
        levels.append(level)
        before = (before or [math.inf, math.inf])
        before[(len(levels) - 1) % 2] = count
        wrong = materialize(outside.where(level.holds(F.col("key"))))
        inside, outside = wrong, inside


def apply_listed(pages: DataFrame, cascades: dict[str, Cascade]) -> DataFrame:
    """Add for each name the array of a row's ``keys`` that are listed."""
    for name, cascade in cascades.items():
        found = F.filter("keys", cascade.listed) if cascade.levels else F.array().cast("array<string>")
        pages = pages.withColumn(name, found)
    return pages


def rest_of(pages: DataFrame, name: str, cascade: Cascade, row: str) -> DataFrame:
    """Turn the answer about the keys that the levels leave undecided; an ordinary join."""
    if cascade.rest is None:
        return pages
    undecided = pages.select(row, F.explode("keys").alias("key")).join(cascade.rest, "key")
    turned = undecided.groupBy(row).agg(F.collect_set("key").alias("_turned"))
    joined = pages.join(turned, row, "left")
    odd = len(cascade.levels) % 2 == 1
    # The levels' answer for keys that pass all of them is wrong for just these keys.
    fixed = F.array_except(name, "_turned") if odd else F.array_union(name, "_turned")
    return joined.withColumn(name, F.when(F.col("_turned").isNull(), F.col(name)).otherwise(fixed)).drop("_turned")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], domains: DataFrame | None, page_id: str = "page_id",
          url: str = "url", default: str = ALLOW) -> DataFrame:
    """``page_id, host, path, rule, verdict, domain``.

    ``rules`` are (verdict, host, path); ``domains`` lists hosts (``domain``) that are blocked with their
    subdomains where no rule fits. ``domain`` is the longest listed one met.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    link = F.col(f"`{url}`").cast("string")
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"))
    keyed = base.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    # Keys are many times fewer than urls; a hot host is one row after the partial aggregation.
    universe = materialize(keyed.select(F.explode("keys").alias("key")).distinct())
    named = {verdict: _rule_table(spark, [h + p for v, h, p in rules if v == verdict]) for verdict in (ALLOW, BLOCK)}
    if domains is not None:
        clean = F.translate(F.col("domain"), UPPER, LOWER)
        named["domains"] = domains.where("domain is not null").select(F.concat(F.lit("d "), clean).alias("key")).distinct()
    cascades = {name: build_cascade(listed, universe) for name, listed in named.items()}
    found = apply_listed(keyed, cascades)
    if any(c.rest is not None for c in cascades.values()):
        found = materialize(found.withColumn("_row", F.monotonically_increasing_id()))
        for name, cascade in cascades.items():
            found = rest_of(found, name, cascade, "_row")
    return _verdicts(found, default, domains is not None)


def _rule_table(spark: SparkSession, keys: list[str]) -> DataFrame:
    """The rules given as arguments, as a table of keys."""
    listed = F.array(*[F.lit(f"r {k}") for k in sorted(set(keys))]).cast("array<string>")
    return spark.range(1).select(F.explode(listed).alias("key"))


def _longest(keys: Column) -> Column:
    """The longest key, of equally long ones the smallest; null if there is none."""
    ranked = F.transform(keys, lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("k")))
    return F.array_min(ranked)


def _verdicts(found: DataFrame, default: str, has_domains: bool) -> DataFrame:
    allow, block = _longest(F.col(ALLOW)), _longest(F.col(BLOCK))
    # A key may be listed under both verdicts; then it blocks.
    best = F.when(allow.isNull() | (block <= allow), block).otherwise(F.coalesce(allow, block))
    wins = F.when(best.isNull(), None).when(block.isNotNull() & (best == block), BLOCK).otherwise(ALLOW)
    domain = _longest(F.col("domains"))["k"] if has_domains else F.lit(None).cast("string")
    judged = found.select("page_id", "host", "path", F.substring(best["k"], 3, 1 << 20).alias("rule"), wins.alias("_wins"),
                          F.substring(domain, 3, 1 << 20).alias("domain"))
    verdict = F.coalesce(F.col("_wins"), F.when(F.col("domain").isNotNull(), BLOCK), F.lit(default))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "domain")

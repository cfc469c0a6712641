"""URL filters: path rules, then a Bloom filter cascade of listed hosts. DataFrame functions only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import durable, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path start, verdict), as dealt.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Hosts listed as unwanted; each stands for its subdomains too.
LISTED = [
    f"{name}.example.{top}"
    for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
]
#: 64-bit words of one literal: 4 MB. A level has as many literals as it needs; all of a cascade grows with the list alone.
PART_WORDS = 1 << 19


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: host or a subdomain of it, and a path that starts with the rule's. Else null."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for name, start, say in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, verdict = rule.when(fits, F.lit(name + start)), verdict.when(fits, F.lit(say))
    return rule, verdict


def suffixes(host: Column) -> Column:
    """The host and the domains above it, whole labels each."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


@dataclass
class Level:
    """One Bloom filter: its 64-bit words in parts of PART_WORDS, each the text of a JSON array that the planner folds into a literal."""

    bits: int
    hashes: int
    salt: int
    parts: list[str]

    def places(self, key: Column) -> Column:
        """Bit numbers of a key."""
        a, b = (F.pmod(F.xxhash64(F.lit(self.salt + k), key), F.lit(self.bits)) for k in (0, 1))
        return F.array(*(F.pmod(a + F.lit(j) * b + F.lit(j * j * j), F.lit(self.bits)) for j in range(self.hashes)))

    def holds(self, key: Column) -> Column:
        arrays = [F.from_json(F.lit(x), "array<bigint>") for x in self.parts]

        def bit(at: Column) -> Column:
            number = F.shiftright(at, 6)
            place = (F.pmod(number, F.lit(PART_WORDS)) + 1).cast("int")
            word = F.element_at(arrays[-1], place)
            for k in range(len(arrays) - 2, -1, -1):
                word = F.when(number < (k + 1) * PART_WORDS, F.element_at(arrays[k], place)).otherwise(word)
            return F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1

        return F.forall(self.places(key), bit)


def build_level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of n keys with about that rate of false positives. Its words, which grow with n alone, come to the driver."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    level = Level(bits, max(1, round(bits / n * math.log(2))), salt, [])
    size = (bits + 63) // 64
    at = keys.select(F.explode(level.places(F.col("key"))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    # A few thousand words of a level are one row of text, so that the driver reads rows of some size.
    said = F.concat_ws(" ", "word", "bits")
    rows = words.groupBy(F.shiftright("word", 12).alias("run")).agg(F.array_join(F.collect_list(said), " ").alias("said")).toLocalIterator()
    held = [0] * size
    for r in rows:
        numbers = list(map(int, r.said.split(" ")))
        for word, value in zip(numbers[::2], numbers[1::2], strict=True):
            held[word] = value
    level.parts = [json.dumps(held[k : k + PART_WORDS], separators=(",", ":")) for k in range(0, size, PART_WORDS)]
    return level


def cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> list[Level]:
    """Levels that tell exactly, for each key of universe or listed, whether it is listed (Larisch et al. 2017).

    Both have a column key. Level 1 encodes the listed keys; level 2 those of the other keys of the universe
    that level 1 takes wrongly; level 3 the listed keys that level 2 takes; and so on until none is taken. The
    first level's rate makes the second about as large as the first, so all of it grows with the list, not
    with the corpus. Null keys are left out; without listed keys there is no level.
    """
    inside = durable(listed.select(F.col("key").cast("string")).where("key is not null").distinct(), "listed")
    outside = durable(
        universe.select(F.col("key").cast("string")).where("key is not null").distinct().join(inside, "key", "left_anti"),
        "others",
    )
    n, other = inside.count(), outside.count()
    levels: list[Level] = []
    while n:
        if len(levels) >= max_levels:
            raise RuntimeError(f"cascade: more than {max_levels} levels")
        rate = min(0.5, max(1e-9, n * math.sqrt(0.5) / max(1, other))) if not levels else 0.5
        levels.append(build_level(inside, n, rate, 2 * len(levels) + 1))
        taken = durable(outside.where(levels[-1].holds(F.col("key"))), "taken")
        inside, outside, n = taken, inside, taken.count()
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: it is if the first level that does not take it is an even one."""
    said = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        said = F.when(levels[k].holds(key), said).otherwise(F.lit(k % 2 == 1))
    return said


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages; listed: a column key of hosts to block.

    The longest fitting rule says allow or block; else a page is blocked if its host or a domain above it is
    listed. The cascade's universe is every such domain of pages, so that answers are exact and no page
    is joined with the list. A null url, or one without ://, has an empty host and path and is allowed.
    """
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    universe = parts.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))
    levels = cascade(listed, universe)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    blocked = F.exists(suffixes(F.col("host")), lambda key: is_listed(key, levels)) if levels else F.lit(False)
    return parts.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame([(x,) for x in LISTED], "key string"))


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    case = lambda say: " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{say(h, p, v)}'" for h, p, v in rules
    )
    listed = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in LISTED)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(r,
    '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, CASE {case(lambda h, p, v: h + p)} END AS rule,
  CASE {case(lambda h, p, v: v)} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM p"""


OP7_SQL = _sql()

"""URL filters by a Bloom filter cascade (operator 3), in DataFrame and SQL functions only.

Listed keys (host and path of a rule) are encoded in level 1; the keys of the corpus's complete key universe that
level 1 lets through without being listed are encoded in level 2; the listed keys that level 2 lets through in level 3;
and so on until none is left. Every key of the universe then gets an exact answer from a few literals, without a join.

A page's keys are the prefixes of its url that have the shape of some rule (so many host labels, so many characters
of path), so the universe is complete for the rules. Level 1's error rate follows the ratio of listed keys to the
universe (sqrt(1/2) * listed / universe), which keeps every level proportional to the number of rules: the literals
that the plan carries are bounded by the rules given as a parameter, not by the corpus.

Defined results: a null url or one without :// has an empty host and path and fits no rule; a page that fits no rule
has rule null and the cascade's own verdict (not listed: allow); among rules that fit, the longest (characters of host
and path, then of host) wins; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut

#: The rules of the query: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
WORD_BITS = 64


@dataclass(frozen=True)
class Level:
    """A Bloom filter: words of 64 bits, hashes per key and a seed."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def bits(self, key: F.Column) -> F.Column:
        """Positions of key's bits, one for each seeded hash."""
        size = F.lit(len(self.words) * WORD_BITS).cast("long")
        return F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: F.pmod(F.xxhash64(key, F.lit(self.seed), i), size))

    def holds(self, key: F.Column) -> F.Column:
        words = F.array(*[F.lit(w).cast("long") for w in self.words])
        return F.forall(self.bits(key), lambda p: F.getbit(F.get(words, F.floor(p / WORD_BITS).cast("int")), (p % WORD_BITS).cast("int")) == 1)


def encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The Bloom filter of keys (key), about n of them, with an error rate of rate; only its words come to the driver."""
    rate = min(0.5, max(rate, 1e-9))
    words = max(1, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / WORD_BITS))
    empty = Level((0,) * words, max(1, round(math.log2(1 / rate))), seed)
    bits = keys.select(F.explode(empty.bits(F.col("key"))).alias("p"))
    one = F.expr(f"shiftleft(1L, CAST(p % {WORD_BITS} AS INT))")
    filled = [0] * words
    for word, value in bits.groupBy(F.floor(F.col("p") / WORD_BITS).cast("int").alias("word")).agg(F.bit_or(one)).collect():
        filled[word] = value
    return Level(tuple(filled), empty.hashes, seed)


def cascade(listed: list[str], universe: DataFrame) -> list[Level]:
    """Levels that answer exactly whether a key of universe (key, distinct) is listed."""
    spark = universe.sparkSession
    inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
    n_in, levels = len(set(listed)), []
    if not n_in:
        return levels
    outside, n_out = universe.where(~F.col("key").isin(*set(listed))), max(1, universe.count())
    rate = math.sqrt(0.5) * n_in / n_out
    encoded, n, other = inside, n_in, outside
    while n:
        levels.append(encode(encoded, n, rate, 2 * len(levels) + 11))
        passed = cut(other.where(levels[-1].holds(F.col("key"))))
        encoded, other, n = passed, encoded, passed.count()
        rate = 0.5
    return levels


def listed_by(levels: list[Level], key: F.Column) -> F.Column:
    """Whether key is listed: it is if the first level that doesn't hold it is an even one (counting from 1), or
    if all hold it and their number is odd."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        answer = F.when(~levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(answer)
    return F.coalesce(answer, F.lit(False))


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def key_of(host: F.Column, path: F.Column, labels: int, length: int) -> F.Column:
    """The key of the given shape, or null where the url has fewer labels or a shorter path."""
    short = F.substring_index(host, ".", -labels)
    fits = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= length) & (host != "")
    return F.when(fits, F.concat(short, F.substring(path, 1, length)))


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """pages' columns with host, path, rule and verdict (any of these that exist are replaced)."""
    shapes = sorted({(len(h.split(".")), len(p)) for _, h, p in rules})
    host, path = host_and_path(F.col("url"))
    urls = pages.select(host.alias("_h"), path.alias("_p"))
    keys = F.array(*[key_of(F.col("_h"), F.col("_p"), *s) for s in shapes])
    universe = cut(urls.select(F.explode(F.array_compact(keys)).alias("key")).distinct())
    found = cascade([h + p for _, h, p in rules], universe)
    blocked = cascade([h + p for v, h, p in rules if v == "block"], universe)
    key = {s: key_of(F.col("host"), F.col("path"), *s) for s in shapes}
    hit = F.array(*[F.when(listed_by(found, key[s]), F.struct(F.length(key[s]).alias("long"), F.length(F.substring_index(F.col("host"), ".", -s[0])).alias("host_long"), key[s].alias("rule"))) for s in shapes])
    best = F.array_max(F.array_compact(hit))["rule"]
    out = pages.withColumns({"host": host, "path": path}).withColumn("rule", best)
    return out.withColumn("verdict", F.when(F.col("rule").isNotNull() & listed_by(blocked, F.col("rule")), "block").otherwise("allow"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
fit AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""

"""URL rules by a Bloom filter cascade, in DataFrame functions alone.

A rule is a key (host, path prefix). A url's candidate keys are its host and every parent domain, each with the path
prefixes of the lengths that occur among the rules. The universe is the set of candidate keys of the corpus. Level 0 of
the cascade encodes the listed keys; level 1 the keys of the universe that level 0 takes wrongly; level 2 the listed keys
that level 1 takes wrongly, and so on until a level takes nothing wrongly. A key is listed if the first level that
refuses it is an odd one, so that membership over this universe is exact and a url is judged without a join.

Keys hold the length of the host, so that host and path cannot run into each other. A null url, or one without ``://``,
has an empty host and path and fits no rule. Of the rules that fit, the longest (host and path together) wins, the longer
host among equals; a listing of the same key twice counts once, and one with both verdicts as a block. Repeated urls are
judged alike; other columns pass through, but those named like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import dropped, stored

#: Bits per encoded key and hash functions of a level.
BITS, HASHES = 12, 4
#: Most bytes of bitmaps that are put into expressions. A longer list is joined instead, with the same result.
MOST_BYTES = 8 << 20


def url_host(url: str | Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.length(host).cast("string"), F.lit(":"), host, path)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of every (parent domain, path prefix of a listed length) pair, longest first.

    Structs of (size, host_size, host, path, key)."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring(path, 1, n).alias("p")) for n in sorted(set(lengths), reverse=True)]), lambda x: F.length(x.p) == x.n)
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda x: F.struct((F.length(h) + x.n).alias("size"), F.length(h).alias("host_size"), h.alias("host"), x.p.alias("path"), _key(h, x.p).alias("key")))))
    return F.sort_array(F.filter(pairs, lambda p: p.host_size > 0), asc=False)


def _positions(key: Column, level: int, bits: int) -> Column:
    """Bit places of a key: double hashing from one 64-bit hash seeded by the level."""
    h = F.xxhash64(F.lit(level), key)
    one, two = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(one + F.lit(i) * two, F.lit(bits)) for i in range(HASHES)])


def _level(keys: DataFrame, level: int, n: int) -> list[int]:
    """Bitmap of one level as 64-bit words; the driver gets n * BITS / 8 bytes, whatever the corpus."""
    bits = max(64, -(-n * BITS // 64) * 64)
    words = keys.select(F.explode(_positions(F.col("key"), level, bits)).alias("p")).groupBy((F.floor(F.col("p") / 64)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m"))
    bitmap = [0] * (bits // 64)
    for r in words.collect():
        bitmap[int(r["w"])] = int(r["m"])
    return bitmap


def _takes(key: Column, level: int, bitmap: list[int]) -> Column:
    words = F.array(*map(F.lit, bitmap)) if len(bitmap) < 64 else F.lit(bitmap).cast("array<bigint>")
    bits = 64 * len(bitmap)
    test = lambda p: F.get(words, F.floor(p / 64).cast("int"))
    return F.forall(_positions(key, level, bits), lambda p: F.call_function("shiftright", test(p), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)


def cascade(listed: DataFrame, universe: DataFrame) -> list[list[int]] | None:
    """Bitmaps of all levels, or nothing where they outgrow ``MOST_BYTES``.

    Both frames hold distinct ``key`` values; the universe may or may not hold the listed."""
    levels: list[list[int]] = []
    own, other = listed, universe.join(listed, "key", "left_anti")
    n = own.count()
    while n:
        k = len(levels)
        if sum(map(len, levels)) * 8 + n * BITS // 8 > MOST_BYTES:
            return None
        levels.append(_level(own, k, n))
        own, other = other.filter(_takes(F.col("key"), k, levels[-1])), own
        n = own.count()
    return levels


def contains(key: Column, levels: list[list[int]]) -> Column:
    """Whether the cascade lists a key of its universe."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(~_takes(key, k, levels[k]), F.lit(k % 2 == 1)).otherwise(out)
    return out


def judge(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds (host, path, rule, verdict). Rules are (verdict, host, path); urls that no rule fits get ``default``."""
    spark = df.sparkSession
    names = ("host", "path", "rule", "verdict")
    base = df.drop(*[c for c in df.columns if c.lower() in names and c != url])
    parsed = base.withColumns({"host": url_host(url), "path": url_path(url)})
    if not rules:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    lengths = sorted({len(p) for _, _, p in rules})
    keys = spark.createDataFrame([(v, h.lower(), p) for v, h, p in rules], "verdict string, host string, path string").select("verdict", _key(F.col("host"), F.col("path")).alias("key"))
    universe = stored(parsed.select("host", "path").distinct().select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("c")).select("c.key").distinct(), "urlkeys")
    listed = cascade(keys.select("key").distinct(), universe)
    dropped(universe)
    blocked = cascade(keys.filter("verdict = 'block'").select("key").distinct(), keys.select("key").distinct())  # only listed keys are asked for
    if listed is None or blocked is None:
        return _joined(parsed, keys, lengths, default)
    hit = "_hit"
    while hit in parsed.columns:
        hit = "_" + hit
    out = parsed.withColumn(hit, F.get(F.filter(candidate_keys(F.col("host"), F.col("path"), lengths), lambda c: contains(c.key, listed)), 0))
    return out.withColumns({
        "rule": F.concat(f"{hit}.host", f"{hit}.path"),
        "verdict": F.when(F.col(hit).isNull(), F.lit(default)).when(contains(F.col(f"{hit}.key"), blocked), "block").otherwise("allow"),
    }).drop(hit)


def _joined(parsed: DataFrame, keys: DataFrame, lengths: list[int], default: str) -> DataFrame:
    """The verdicts of distinct (host, path) pairs by a join of their candidate keys with the rules."""
    pairs = parsed.select("host", "path").distinct()
    asked = pairs.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("c"))
    rules = keys.groupBy(F.col("key").alias("_k")).agg(F.max("verdict").alias("_v"))  # block beats allow
    best = asked.join(rules, F.col("c.key") == F.col("_k")).groupBy("_h", "_p").agg(F.max(F.struct("c.size", "c.host_size", F.concat("c.host", "c.path").alias("rule"), "_v")).alias("best"))
    best = stored(best.select("_h", "_p", F.col("best.rule").alias("rule"), F.col("best._v").alias("_v")), "verdicts")
    out = parsed.select(F.struct(*parsed.columns).alias("_row")).join(best, F.expr("_row.host = _h AND _row.path = _p"), "left")
    return out.select("_row.*", "rule", F.coalesce("_v", F.lit(default)).alias("verdict"))

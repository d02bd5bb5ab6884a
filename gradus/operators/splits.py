"""Leakage-free splits: whole groups of sources go to one side.

A group's profile is how many rows it has of each kind. To the greedy split groups of one profile are alike: it plans over the
histogram of profiles, with the number of groups of each, and says how many of each go to the test side. Which ones these are is
decided where the groups lie, by the md5 order of seed, stage and group, ranked inside each profile. The split by signatures
plans over counts per prefix of that order. The driver sees histograms alone, whatever the number of groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators.sampling import bucket_ranked, order_key


def profiles(df: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, profile): rows of each kind, as an array of (kind, n) in the order of the kinds. Null groups and kinds count as such."""
    n = df.groupBy(group, F.col(kind).cast("string").alias("k")).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("profile"))  # a row per kind


def planned(df: DataFrame, group: str, kind: str, stage: str, plan) -> DataFrame:
    """(group, split) by ``plan``: from [(profile as a dict, number of groups)] to the number of test groups of each."""
    of = profiles(df, group, kind)
    histogram = [({x["k"]: x["n"] for x in r["profile"]}, r["count"]) for r in of.groupBy("profile").count().collect()]
    histogram.sort(key=lambda x: order_of(x[0]))
    taken = plan(histogram)
    text = F.to_json("profile", {"ignoreNullFields": "false"})
    spark = df.sparkSession
    quota = spark.createDataFrame([([(k, n) for k, n in sorted(p.items(), key=lambda x: (x[0] is not None, x[0]))], t) for (p, _), t in zip(histogram, taken) if t], "p array<struct<k:string,n:bigint>>, quota long")
    quota = quota.select(F.to_json("p", {"ignoreNullFields": "false"}).alias("_profile"), "quota")
    ranked = bucket_ranked(of.select(group, text.alias("_profile")), ["_profile"], stage, group)
    return ranked.join(F.broadcast(quota), "_profile", "left").select(group, F.when(F.col("rn") <= F.col("quota"), "test").otherwise("train").alias("split"))  # a row per profile


def order_of(profile: dict) -> tuple:
    """Profiles come by the number of their rows, then by their kinds and numbers."""
    return sum(profile.values()), sorted((k or "", n) for k, n in profile.items())


def totals(histogram: list[tuple[dict, int]]) -> dict:
    out: dict = {}
    for p, m in histogram:
        for k, n in p.items():
            out[k] = out.get(k, 0) + n * m
    return out


def greedy_plan(histogram: list[tuple[dict, int]], fraction: float) -> list[int]:
    """Until each kind has its share of rows: the kind that lacks most (ties: the first by name) takes a group with the fewest rows of
    all that have it (ties: most rows of that kind, then the profile's order). As long as that kind goes on lacking most,
    groups of a profile are taken together."""
    lacking = {k: round(n * fraction) for k, n in totals(histogram).items()}
    queues = {k: sorted((i for i, (p, _) in enumerate(histogram) if k in p), key=lambda i: (sum(histogram[i][0].values()), -histogram[i][0][k], i)) for k in lacking}  # noqa: B023
    taken, at = [0] * len(histogram), dict.fromkeys(lacking, 0)
    while any(v > 0 for v in lacking.values()):
        want = min((k for k, v in lacking.items() if v > 0), key=lambda k: (-lacking[k], k or ""))
        while at[want] < len(queues[want]) and taken[queues[want][at[want]]] == histogram[queues[want][at[want]]][1]:
            at[want] += 1  # what is used up stays so
        if at[want] == len(queues[want]):
            break
        i = queues[want][at[want]]
        own, n = histogram[i][0], histogram[i][0][want]
        more = min(histogram[i][1] - taken[i], -(-lacking[want] // n))
        for k, v in lacking.items():
            if k != want and n > own.get(k, 0):
                more = min(more, 1 + max(0, lacking[want] - v - 1) // (n - own.get(k, 0)))
        taken[i] += more
        for k, c in own.items():
            lacking[k] -= more * c
    return taken


def greedy_split(df: DataFrame, group: str, kind: str, fraction: float = 0.2, stage: str = "split") -> DataFrame:
    """(group, split): see :func:`greedy_plan`."""
    return planned(df, group, kind, stage, lambda h: greedy_plan(h, fraction))


#: Groups whose counts may come to the driver at a time.
FEW = 4096


def signature_split(df: DataFrame, group: str, kind: str, fraction: float = 0.2, least_train: int = 50, stage: str = "signature", few: int = FEW) -> DataFrame:
    """(group, split): of each signature, the set of kinds that a group has, the first groups in md5 order go to the test side, up to the
    share of its groups, and up to the first that would take a kind over its share of rows or leave fewer than ``least_train``.

    Signatures of most kinds come first, as they are bound by most limits. The end of each run of groups is found from counts per prefix
    of the md5, then per longer prefix inside the one that holds the end, until at most ``few`` groups are in question."""
    of = profiles(df, group, kind)
    wide = of.agg(F.max(F.size("profile"))).first()[0] or 0
    of = of.select(group, F.to_json("profile.k").alias("sig"), F.col("profile.n").alias("n"), F.col("profile.k").alias("k"), order_key(stage, F.col(group)).alias("h"))
    sums = F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(max(wide, 1))]).alias("n")

    def counts(rows: DataFrame, digits: int) -> list[tuple[str, int, list[int]]]:
        """(prefix, groups, rows of each kind) in the order of the prefixes."""
        got = rows.groupBy(F.substring("h", 1, digits).alias("h")).agg(F.count("*").alias("m"), sums).collect()
        return sorted((r["h"], r["m"], list(r["n"])) for r in got)

    total: dict = {}
    size = {}
    for r in of.groupBy("sig").agg(F.first("k").alias("k"), F.count("*").alias("m"), sums).collect():  # a row per signature
        size[r["sig"]] = (tuple(r["k"]), r["m"])
        for k, n in zip(r["k"], r["n"]):
            total[k] = total.get(k, 0) + n
    room = {k: min(round(n * fraction), max(0, n - least_train)) for k, n in total.items()}
    ends = []
    for sig, (kinds, m) in sorted(size.items(), key=lambda x: (-len(x[1][0]), [k or "" for k in x[1][0]])):
        quota, digits, rows, end = round(m * fraction), 3, of.filter(F.col("sig") == sig), ""
        while True:
            whole = digits >= 32 or m <= few
            hit = None
            for h, groups, n in counts(rows, 32 if whole else digits):
                if groups > quota or any(c > room[k] for k, c in zip(kinds, n)):
                    hit = (h, groups)
                    break
                quota -= groups
                for k, c in zip(kinds, n):
                    room[k] -= c
                end = h
            if hit is None or whole:
                break
            m, digits, rows = hit[1], digits + 3, rows.filter(F.col("h").startswith(hit[0]))  # the end lies inside this prefix
        ends.append((sig, end))
    listed = df.sparkSession.createDataFrame(ends, "sig string, end string")
    inside = (F.col("end") != "") & (F.substring("h", F.lit(1), F.length("end")) <= F.col("end"))
    return of.join(F.broadcast(listed), "sig").select(group, F.when(inside, "test").otherwise("train").alias("split"))  # a row per signature

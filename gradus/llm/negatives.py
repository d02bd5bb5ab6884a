"""Hard negatives by dual-tree search: for each anchor its nearest rows of the same label, then rows of other labels that
score within a band below them.

Vectors are turned into floor(scale * x), x as double; scores are integer inner products. Median splits of a bounded sample
deal rows to shards, and anchors, by splits of their own, to groups. Two trees meet in each task: one over anchors, one over a
shard's rows. The boxes of a pair of nodes give an interval that holds every inner product between them, and the pair goes, for the
whole group of anchors at once, if the interval's upper end is below what all of them already have or its lower end above
what any of them may take. Pairs of leaves are scored exactly.

Anchors first meet the shard that they lie in. With what they found there, a group's tree meets the boxes of all shards, and
only what survives is sent: each anchor to the shards that may still improve it. Positives are complete before the search for
negatives begins, whose bands they set. Rows of a shard travel once for each block of anchors that it meets; what boxes prune
depends on the data, results do not, and vectors spread evenly in many dimensions meet most shards.

Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part; vectors of different lengths never meet.
Ties go to the smaller id. Rows repeated under one id are candidates each, and none of them is a positive or negative of that id; of
several rows under an anchor's id the smallest vector is asked for, then the smallest label. An anchor without positives, or a
positive without negatives in its band, has no rows. Scores
that may reach 2**53 are an error, not a wrong result. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import Scratch, bounded_sample, dropped, stored
from gradus.llm.topk import BOXES, CELLS, SAMPLE, Cells, KdTree, _by_length, _matrix, usable

#: Rows of a shard, anchors of a group, rows and anchors of a leaf.
SHARD, GROUP, LEAF, ANCHORS = 4096, 1024, 128, 16
_NONE = -(2.0**62)


def interval(tree: KdTree, node: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of a point in the node's box with one in each of the boxes (low, high)."""
    a, b = tree.low[node], tree.high[node]
    ends = np.stack([a * low, a * high, b * low, b * high])
    return ends.min(axis=0).sum(axis=-1), ends.max(axis=0).sum(axis=-1)


class Search:
    """Best results of each anchor: ``wide`` searches of ``k`` results, each within [floor, top]; other than its own id, and of
    its own label (``same``) or of others."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, floor: np.ndarray, top: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.floor, self.top, self.k, self.same = ids, labels, floor, top, k, same
        n, wide = floor.shape
        self.score = np.full((n, wide, k), _NONE)
        self.who = np.full((n, wide, k), np.iinfo(np.int64).max)

    def needs(self, rows: np.ndarray) -> tuple[float, float]:
        """Scores below the first improve none of the rows, nor do those above the second."""
        return float(np.maximum(self.floor[rows], self.score[rows, :, -1]).min()), float(self.top[rows].max())

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Takes in the exact scores (anchors x candidates) of a pair of leaves."""
        fits = (ids[None, :] != self.ids[rows, None]) & ((labels[None, :] == self.labels[rows, None]) == self.same)
        for j in range(self.floor.shape[1]):
            least = np.maximum(self.floor[rows, j], self.score[rows, j, -1])
            good = fits & (scores >= least[:, None]) & (scores <= self.top[rows, j][:, None])
            hit = np.flatnonzero(good.any(axis=1))
            if not len(hit):
                continue
            cols = np.flatnonzero(good[hit].any(axis=0))
            new = np.where(good[np.ix_(hit, cols)], scores[np.ix_(hit, cols)], _NONE)
            every = np.concatenate([self.score[rows[hit], j], new], axis=1)
            who = np.concatenate([self.who[rows[hit], j], np.where(new > _NONE, ids[cols][None, :], np.iinfo(np.int64).max)], axis=1)
            order = np.lexsort((who, -every), axis=1)[:, : self.k]
            self.score[rows[hit], j] = np.take_along_axis(every, order, axis=1)
            self.who[rows[hit], j] = np.take_along_axis(who, order, axis=1)


def meet(anchors: KdTree, rows: KdTree, labels: np.ndarray, search: Search) -> int:
    """Walks pairs of nodes, those that may score highest first; the number of pairs of leaves that were scored."""
    scored, todo = 0, [(0, 0)]
    members = _members(anchors)
    while todo:
        a, c = todo.pop()
        low, high = interval(anchors, a, rows.low[c], rows.high[c])
        least, most = search.needs(members[a])
        if high < least or low > most:
            continue
        down_a, down_c = anchors.children[a], rows.children[c]
        if down_a is None and down_c is None:
            own, other = anchors.rows[a], rows.rows[c]
            search.offer(own, anchors.points[own] @ rows.points[other].T, rows.ids[other], labels[other])
            scored += 1
        elif down_c is None or down_a is not None and 2 * (anchors.high[a] - anchors.low[a]).max() > (rows.high[c] - rows.low[c]).max():  # groups near each other first
            todo += [(x, c) for x in down_a]
        else:
            pair = sorted(down_c, key=lambda x: interval(anchors, a, rows.low[x], rows.high[x])[1])
            todo += [(a, x) for x in pair]  # the better one is taken first
    return scored


def _members(tree: KdTree) -> list[np.ndarray]:
    """Rows below each node; children have larger numbers than their parents."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(tree.rows)
    for node in range(len(tree.rows) - 1, -1, -1):
        out[node] = tree.rows[node] if tree.children[node] is None else np.concatenate([out[x] for x in tree.children[node]])
    return out


def survivors(anchors: KdTree, low: np.ndarray, high: np.ndarray, needs) -> list[tuple[np.ndarray, np.ndarray]]:
    """(anchors, shards) that may still improve each other: node by node, all shards' boxes at once."""
    out, todo = [], [(0, np.arange(len(low)))]
    members = _members(anchors)
    while todo:
        node, left = todo.pop()
        lo, hi = interval(anchors, node, low[left], high[left])
        least, most = needs(members[node])
        left = left[(hi >= least) & (lo <= most)]
        if not len(left):
            continue
        if anchors.children[node] is None:
            out.append((members[node], left))
        else:
            todo += [(x, left) for x in anchors.children[node]]
    return out


def mined(df: DataFrame, anchors: Column, label: Column | str = "label", k: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vector: str = "embedding", key: str = "vec_id", scale: float = 256.0, shard: int = SHARD, group: int = GROUP, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), stored.

    For each row that ``anchors`` marks, its ``k`` best other rows of the same label; for each of these the best ``negatives`` rows of
    another label whose score is at least ``low`` and at most ``high`` hundredths of the positive's."""
    spark = df.sparkSession
    kind = df.schema[vector].dataType.simpleString()
    with Scratch(spark) as scratch:
        label = F.col(label) if isinstance(label, str) else label
        usual = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("q"), F.size(vector).alias("d"), label.cast("long").alias("l"))
        rows = usual.filter(usable(F.col("v")) & (F.col("d") > 0) & F.col("id").isNotNull() & F.col("l").isNotNull())
        n, asked_n = (int(x or 0) for x in rows.agg(F.count("*"), F.sum(F.col("q").cast("long"))).first())

        def trees(part: DataFrame, most: int) -> dict[int, Cells]:
            sample = bounded_sample(part, F.xxhash64("id", "v"), SAMPLE).select("d", "v").limit(2 * SAMPLE).toArrow()
            sizes = sample.column("d").to_numpy()
            return {d: Cells(x, max(1, min(cells, most) * len(at) // len(sizes))) for d, at, x in _by_length(sample.column("v"), sizes, scale)} if len(sizes) else {}

        shared = spark.sparkContext.broadcast((trees(rows, -(-n // shard)), trees(rows.filter("q"), -(-asked_n // group))))

        def deal(batches):
            at_row = TaskContext.get().partitionId() << 40
            for t in batches:
                places = np.zeros((2, t.num_rows), np.int32)
                for d, at, x in _by_length(t.column("v"), t.column("d").to_numpy(), scale):
                    for place, own in zip(places, shared.value):
                        if d in own:
                            place[at] = own[d].of(x)
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(places[0]), pa.array(places[1]), pa.array(np.arange(at_row, at_row + t.num_rows))], [*t.schema.names, "c", "g", "r"])
                at_row += t.num_rows

        dealt = stored(rows.mapInArrow(deal, f"id long, v {kind}, q boolean, d int, l long, c int, g int, r long"), "dealt")
        per = stored(dealt.groupBy("d", "c").agg(F.ceil(F.count("*") / shard).alias("m")), "cells")
        items = stored(dealt.join(per, ["d", "c"]).select("d", "c", F.pmod(F.xxhash64("r"), "m").cast("int").alias("s"), "id", "v", "l", "q", "g"), "items")
        dropped(dealt)
        asked = items.filter("q").groupBy("d", "id").agg(F.min(F.struct("v", "l", "c", "s", "g")).alias("x")).select("d", "id", "x.*")
        crowd = asked.groupBy("d", "g").agg(F.ceil(F.count("*") / group).alias("m"))
        asked = stored(asked.join(crowd, ["d", "g"]).select("d", "id", "v", "l", "c", "s", "g", F.pmod(F.xxhash64("id"), "m").cast("int").alias("b")), "asked")

        listed: dict[int, list] = {}
        sides = items.groupBy("d", "c", "s").applyInArrow(lambda t: _box(t, scale), "d int, c int, s int, lo array<double>, hi array<double>")
        whole = stored(sides, "boxes")
        one_by_one = whole.count() <= BOXES
        if not one_by_one:  # the cell's box for all its shards: as many as the sample has
            side = whole.select("d", "c", "s", F.posexplode("lo").alias("i", "x"), F.get("hi", F.col("i")).alias("y")).groupBy("d", "c", "i").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("s").alias("s"))
            whole = side.groupBy("d", "c").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("b"), F.max("s").alias("s")).select("d", "c", "s", F.col("b.x").alias("lo"), F.col("b.y").alias("hi"))
        for r in sorted(whole.collect(), key=lambda r: (r["d"], r["c"], r["s"])):
            listed.setdefault(r["d"], []).append((r["c"], r["s"], r["lo"], r["hi"]))
        fences = spark.sparkContext.broadcast({d: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v]), np.array([x[3] for x in v])) for d, v in listed.items()})

        asks = "array<struct<p:bigint,floor:bigint,top:bigint>>"
        found = "anchor long, p int, who long, score long"

        def within(same: bool, most: int):
            """Results of the anchors and rows of one group that came together."""

            def run(own: pa.Table, ask: pa.Table) -> pa.Table:
                out = ([], [], [], [])
                if own.num_rows and ask.num_rows:
                    points, wanted = _matrix(own.column("v"), scale), _matrix(ask.column("v"), scale)
                    if np.abs(points).max() * np.abs(wanted).max() * points.shape[1] >= 2.0**53:
                        raise ValueError("inner products of 2**53 and more are not exact")
                    floor, top = _bands(ask.column("asks").to_pylist())
                    search = Search(ask.column("id").to_numpy(), ask.column("l").to_numpy(), floor, top, most, same)
                    meet(KdTree(wanted, search.ids, ANCHORS), KdTree(points, own.column("id").to_numpy(), LEAF), own.column("l").to_numpy(), search)
                    i, j, r = np.nonzero(search.score > _NONE)
                    out = (search.ids[i], j, search.who[i, j, r], search.score[i, j, r].astype(np.int64))
                return pa.table([pa.array(x, t) for x, t in zip(out, [pa.int64(), pa.int32(), pa.int64(), pa.int64()])], ["anchor", "p", "who", "score"])

            return run

        def away(t: pa.Table) -> pa.Table:
            """The shards other than its own that each anchor of a group is sent to."""
            d = t.column("d")[0].as_py()
            c, s, lo, hi = fences.value[d]
            floor, top = _bands(t.column("asks").to_pylist())
            slack = 1e-9 * max(1.0, np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))  # never loses by rounding
            points = _matrix(t.column("v"), scale)
            reach = slack * np.abs(points).sum(axis=1).max(initial=0)
            tree = KdTree(points, t.column("id").to_numpy(), ANCHORS)
            who, shards = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in survivors(tree, lo, hi, lambda m: (float(floor[m].min()) - reach, float(top[m].max()) + reach)):
                who.append(np.repeat(i, len(j))), shards.append(np.tile(j, len(i)))
            who, shards = np.concatenate(who), np.concatenate(shards)
            sub = s[shards]
            if not one_by_one:
                many = sub + 1
                sub = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                who, shards = np.repeat(who, many), np.repeat(shards, many)
            other = (c[shards] != t.column("c").to_numpy()[who]) | (sub != t.column("s").to_numpy()[who])
            part = t.select(["d", "g", "b", "id", "v", "l", "asks"]).take(pa.array(who[other]))
            return part.append_column("c", pa.array(c[shards[other]].astype(np.int32))).append_column("s", pa.array(sub[other].astype(np.int32)))

        def searched(ready: DataFrame, same: bool, most: int, tighter) -> DataFrame:
            """(anchor, p, who, score): the ``most`` best of each (anchor, p) of ``ready``, stored."""
            home = ["d", "c", "s"]
            first = stored(items.groupBy(home).cogroup(ready.groupBy(home)).applyInArrow(within(same, most), found), "home")
            next_ready = stored(tighter(ready, first), "ready")
            sent = stored(next_ready.groupBy("d", "g", "b").applyInArrow(away, f"d int, g int, b int, id long, v {kind}, l long, asks {asks}, c int, s int"), "sent")
            keys = ["d", "c", "s", "g", "b"]
            met = items.drop("g").join(stored(sent.select(*keys).distinct(), "meetings"), home).select(*keys, "id", "v", "l")
            more = met.groupBy(keys).cogroup(sent.groupBy(keys)).applyInArrow(within(same, most), found)
            order = Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "who")
            best = first.unionByName(more).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= most)
            return stored(best, "best")

        def kth(ready: DataFrame, first: DataFrame, most: int) -> DataFrame:
            """``ready`` with floors raised to the score of the last of ``most`` results, where there are as many."""
            last = first.groupBy("anchor", "p").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == most)
            raised = last.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("p", "least"))).alias("m"))
            up = F.transform("asks", lambda x: F.struct(x.p.alias("p"), F.greatest(x.floor, F.coalesce(F.try_element_at("m", x.p.cast("int")), x.floor)).alias("floor"), x.top.alias("top")))
            return ready.join(raised.withColumnRenamed("anchor", "id"), "id", "left").withColumn("asks", F.when(F.col("m").isNull(), F.col("asks")).otherwise(up)).drop("m")

        open_ask = F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(-(1 << 62)).alias("floor"), F.lit(1 << 62).alias("top")))
        positives = searched(asked.withColumn("asks", open_ask), True, k, lambda r, f: kth(r, f, k)).select("anchor", F.col("who").alias("positive"), F.col("i").alias("j"), F.col("score").alias("positive_score"))
        # 100 * score >= low * positive_score and 100 * score <= high * positive_score, as whole numbers.
        band = F.struct((F.col("j") - 1).cast("long").alias("p"), _ceil(F.col("positive_score") * low).alias("floor"), _floor(F.col("positive_score") * high).alias("top"))
        bands = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(band)).alias("asks")).withColumnRenamed("anchor", "id")  # k at most
        hard = searched(stored(asked.join(bands, "id"), "banded"), False, negatives, lambda r, f: kth(r, f, negatives))
        out = positives.join(hard.select("anchor", (F.col("p") + 1).alias("j"), F.col("i").cast("int").alias("rank"), F.col("who").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "j"])
        return scratch.result(out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score"), "mined")


def _floor(x: Column) -> Column:
    """x / 100, rounded down, of a long."""
    return ((x - F.pmod(x, F.lit(100))) / 100).cast("long")


def _ceil(x: Column) -> Column:
    return -_floor(-x)


def _bands(asks: list[list[dict]]) -> tuple[np.ndarray, np.ndarray]:
    """Floors and tops (anchors x searches); searches that an anchor lacks can take nothing."""
    wide = max(map(len, asks), default=1)
    floor, top = np.full((len(asks), wide), 2.0**62), np.full((len(asks), wide), -(2.0**62))
    for i, own in enumerate(asks):
        for j, x in enumerate(own):
            floor[i, j], top[i, j] = x["floor"], x["top"]
    return floor, top


def _box(t: pa.Table, scale: float) -> pa.Table:
    x = _matrix(t.column("v"), scale)
    return pa.table([t.column(c)[:1] for c in ("d", "c", "s")] + [pa.array([f(axis=0).tolist()], pa.list_(pa.float64())) for f in (x.min, x.max)], ["d", "c", "s", "lo", "hi"])

"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are first turned into floor(scale * x), x as double. Median splits of a sample's widest sides, at most ``SAMPLE`` rows,
divide the space into at most ``CELLS`` cells; every row goes to its cell, and a cell to shards of about ``SHARD`` rows by row
number, so that copies spread. A shard's tree splits at medians of its widest side and keeps a tight box and the smallest id
for each node. A query walks the tree best first by the largest inner product that a box allows, and stops where no box can
beat its kth result. Queries meet their home shard first. The home pass also gives each shard's box; boxes are broadcast, by
shard up to ``BOXES`` shards and by cell beyond. The kth distance found at home drops every shard whose box cannot reach it
before anything is shuffled, and is propagated to the others, which then send only what beats it. What the sample and the
boxes prune depends on the data; results do not: vectors spread evenly in many dimensions still meet most shards.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; vectors of different
lengths never meet. Ties go to the smaller id. Repeated candidate rows are candidates each; of several vectors under one query id
the smallest is asked for. Rows with a query's own id are never its results and are set aside before a leaf's rows are cut to the
best. Scores beyond a long end at its limits. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import Scratch, bounded_sample, stored

#: Rows of a shard, queries of a block, rows of a leaf.
SHARD, BLOCK, LEAF = 4096, 2048, 128
#: Most rows that the cells are fitted to, most cells, most shards whose boxes are broadcast one by one.
SAMPLE, CELLS, BOXES = 20_000, 1024, 16_384
_RESULT = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ok, F.lit(False))


class KdTree:
    """Median-split tree over integral vectors with tight boxes; nodes are numbered from the root, 0."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        low, high, first = [], [], []
        todo = [(np.argsort(ids, kind="stable"), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.rows)
            if parent >= 0:
                self.children[parent] = (node, self.children[parent][1]) if side == 0 else (self.children[parent][0], node)
            box = points[rows]
            lo, hi = box.min(axis=0), box.max(axis=0)
            low.append(lo), high.append(hi), first.append(ids[rows].min())
            wide = hi - lo
            if len(rows) <= leaf or not len(wide) or wide.max() == 0:
                self.rows.append(rows), self.children.append(None)
                continue
            half = len(rows) // 2
            order = rows[np.argpartition(box[:, int(np.argmax(wide))], half)]
            self.rows.append(None), self.children.append((-1, -1))
            todo += [(order[:half], node, 0), (order[half:], node, 1)]
        self.low, self.high, self.first = np.array(low), np.array(high), np.array(first)
        self.points, self.ids = points, ids

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with a point of each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, kth: tuple[float, float] | None) -> list[tuple[float, int]]:
        """Up to k (score, -id) that beat ``kth``, a (score, -id) that k known rows reach, best first."""
        best: list[tuple[float, int]] = []
        heap = [(-bounds[0], int(self.first[0]), 0)]
        while heap:
            negative, first, node = heapq.heappop(heap)
            floor = best[0] if len(best) == k else None
            floor = max(floor, kth) if floor and kth else floor or kth
            if floor and (-negative, -first) < floor:
                if -negative < floor[0]:
                    break
                continue
            rows = self.rows[node]
            if rows is None:
                for c in self.children[node]:
                    heapq.heappush(heap, (-bounds[c], int(self.first[c]), c))
                continue
            scores = self.points[rows] @ query
            other = self.ids[rows] != own  # before any cut: the query's own id may be repeated
            near = np.flatnonzero(other & (scores >= floor[0]) if floor else other)
            if len(near) > 4 * k:  # enough to look at the k best and what ties with the last of them
                top = np.partition(scores[near], len(near) - k - 1)[len(near) - k - 1]
                near = near[scores[near] >= top]
                near = near[np.lexsort((self.ids[rows[near]], -scores[near]))][: k + 1]
            for s, i in zip(scores[near].tolist(), self.ids[rows[near]].tolist()):
                if kth and (s, -i) < kth:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return sorted(best, reverse=True)


class Cells:
    """Median splits of sampled vectors of one length; :meth:`of` gives the cell of any vector."""

    def __init__(self, points: np.ndarray, most: int):
        self.axis, self.cut, self.next, self.depth = [], [], [], 0
        todo, self.size = [(np.arange(len(points)), most, 0, -1, 0)], 0
        while todo:
            rows, want, depth, parent, side = todo.pop()
            node = len(self.axis)
            if parent >= 0:
                self.next[parent][side] = node
            wide = points[rows].max(axis=0) - points[rows].min(axis=0) if len(rows) and points.shape[1] else np.zeros(1)
            axis = int(np.argmax(wide))
            self.depth = max(self.depth, depth)
            if want < 2 or len(rows) < 2 or not wide[axis] > 0:
                self.axis.append(-1), self.cut.append(0.0), self.next.append([self.size, self.size])
                self.size += 1
                continue
            line = points[rows, axis]
            cut = float(np.median(line))
            if cut >= line.max():
                cut = float(line[line < line.max()].max())
            self.axis.append(axis), self.cut.append(cut), self.next.append([0, 0])
            right = line > cut
            todo += [(rows[~right], want // 2, depth + 1, node, 0), (rows[right], want - want // 2, depth + 1, node, 1)]

    def of(self, points: np.ndarray) -> np.ndarray:
        axis, cut, after = np.array(self.axis), np.array(self.cut), np.array(self.next)
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            inner = np.flatnonzero(axis[node] >= 0)
            at = node[inner]
            node[inner] = after[at, (points[inner, axis[at]] > cut[at]).astype(np.int64)]
        return after[node, 0]


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) of equally long vectors, as double."""
    flat = column.combine_chunks().flatten() if column.num_chunks != 1 else column.chunk(0).flatten()
    return np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles while every sum of products stays below 2**53, else Python integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        whole = np.vectorize(int, otypes=[object])
        return whole(a), whole(b)
    return a, b


def _by_length(vectors: pa.Array | pa.ChunkedArray, sizes: np.ndarray, scale: float):
    """(places, matrix) of the vectors of each length."""
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        part = vectors.take(pa.array(at))
        yield int(d), at, _matrix(part if isinstance(part, pa.ChunkedArray) else pa.chunked_array([part]), scale)


def top_k(df: DataFrame, queries: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: float = 256.0, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score), stored: the k best rows for each row of ``df`` that ``queries`` marks."""
    spark = df.sparkSession
    kind = df.schema[vector].dataType.simpleString()
    with Scratch(spark) as scratch:
        rows = df.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"), F.size(vector).alias("d"))
        n = rows.count()
        sample = bounded_sample(rows, F.xxhash64("id", "v"), SAMPLE).select("d", "v").limit(2 * SAMPLE).toArrow()
        sizes = sample.column("d").to_numpy()
        trees = {d: Cells(x, max(1, min(cells, -(-n // shard)) * len(at) // max(len(sizes), 1))) for d, at, x in _by_length(sample.column("v"), sizes, scale)} if len(sizes) else {}
        shared = spark.sparkContext.broadcast(trees)

        def deal(batches):
            at_row = TaskContext.get().partitionId() << 40
            for t in batches:
                cell = np.zeros(t.num_rows, np.int32)
                for d, at, x in _by_length(t.column("v"), t.column("d").to_numpy(), scale):
                    if d in shared.value:
                        cell[at] = shared.value[d].of(x)
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell), pa.array(np.arange(at_row, at_row + t.num_rows))], [*t.schema.names, "c", "r"])
                at_row += t.num_rows

        dealt = stored(rows.mapInArrow(deal, f"id long, v {kind}, q boolean, d int, c int, r long"), "dealt")
        per = stored(dealt.groupBy("d", "c").agg(F.ceil(F.count("*") / shard).alias("m")), "cells")
        items = stored(dealt.join(per, ["d", "c"]).select("d", "c", F.pmod(F.xxhash64("r"), "m").cast("int").alias("s"), "id", "v", "q"), "items")
        asked = stored(items.filter("q").groupBy("d", "id").agg(F.min(F.struct("v", "c", "s")).alias("m")).select("d", "m.c", "m.s", "id", "m.v"), "queries")
        blocks = max(1, -(-asked.count() // block))

        def found(t: pa.Table, ask: pa.Table) -> list[tuple[int, int, int]]:
            out: list[tuple[int, int, int]] = []
            if t.num_rows and ask.num_rows:
                points, wanted = _exact(_matrix(t.column("v"), scale), _matrix(ask.column("v"), scale))
                tree = KdTree(points, t.column("id").to_numpy(), leaf)
                bounds = tree.bounds(wanted)
                known = ask.column("kth").to_pylist() if "kth" in ask.column_names else [None] * ask.num_rows
                most = (1 << 63) - 1
                for i, (q, x) in enumerate(zip(ask.column("id").to_pylist(), known)):
                    kth = (x["score"], -x["vec_id"]) if x else None
                    out += [(q, -v, max(-most - 1, min(most, int(s)))) for s, v in tree.search(wanted[i], q, bounds[i], k, kth)]
            return out

        def at_home(own: pa.Table, ask: pa.Table) -> pa.Table:
            got = [(*r, None, None, None, None, None) for r in found(own, ask)]
            if own.num_rows:
                box = _matrix(own.column("v"), scale)
                got.append((None, None, None, own.column("d")[0].as_py(), own.column("c")[0].as_py(), own.column("s")[0].as_py(), box.min(axis=0).tolist(), box.max(axis=0).tolist()))
            cols = list(zip(*got)) or [()] * 8
            return pa.table([pa.array(c, kind) for c, kind in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.list_(pa.float64())] * 2)], ["query_id", "vec_id", "score", "d", "c", "s", "lo", "hi"])

        keys = ["d", "c", "s"]
        first = stored(items.groupBy(keys).cogroup(asked.groupBy(keys)).applyInArrow(at_home, _RESULT + ", d int, c int, s int, lo array<double>, hi array<double>"), "home")
        home = first.filter("query_id IS NOT NULL").select("query_id", "vec_id", "score")
        boxes = first.filter("query_id IS NULL").select(*keys, "lo", "hi")
        one_by_one = boxes.count() <= BOXES
        if not one_by_one:  # by cell: as many as the sample has
            side = boxes.select("d", "c", "s", F.posexplode("lo").alias("i", "x"), F.get("hi", F.col("i")).alias("y")).groupBy("d", "c", "i").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("s").alias("s"))
            side = side.groupBy("d", "c").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("b"), F.max("s").alias("s"))
            boxes = side.select("d", "c", "s", F.col("b.x").alias("lo"), F.col("b.y").alias("hi"))
        listed: dict[int, list] = {}
        for r in sorted(boxes.collect(), key=lambda r: (r["d"], r["c"], r["s"])):
            listed.setdefault(r["d"], []).append((r["c"], r["s"], r["lo"], r["hi"]))
        fences = spark.sparkContext.broadcast({d: (np.array([x[0] for x in v], np.int32), np.array([x[1] for x in v], np.int32), np.array([x[2] for x in v]), np.array([x[3] for x in v])) for d, v in listed.items()})
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = home.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select(F.col("query_id").alias("id"), F.struct("score", "vec_id").alias("kth"))

        def away(batches):
            for t in batches:
                i_all, c_all, s_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
                own_c, own_s = t.column("c").to_numpy(), t.column("s").to_numpy()
                scores = pc.struct_field(t.column("kth"), "score").cast(pa.float64(), safe=False).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
                for d, at, x in _by_length(t.column("v"), t.column("d").to_numpy(), scale):
                    if d not in fences.value:
                        continue
                    c, s, lo, hi = fences.value[d]
                    for a in range(0, len(at), 256):
                        q = x[a : a + 256]
                        bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                        size = np.abs(q).sum(axis=1)[:, None] * max(1.0, np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))
                        bound = np.maximum(bound + 1e-9 * size, -(2.0**63))
                        i, j = np.nonzero(bound >= scores[at[a : a + 256], None])  # never loses by rounding
                        if not one_by_one:
                            n = s[j].astype(np.int64) + 1
                            sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                            i, j = np.repeat(i, n), np.repeat(j, n)
                        else:
                            sub = s[j]
                        i = at[a + i]
                        other = (c[j] != own_c[i]) | (sub != own_s[i])
                        i_all.append(i[other]), c_all.append(c[j][other]), s_all.append(sub[other].astype(np.int32))
                take = np.concatenate(i_all)
                c, s = np.concatenate(c_all), np.concatenate(s_all)
                for a in range(0, len(take), 4096):
                    part = t.select(["d", "b", "id", "v", "kth"]).take(pa.array(take[a : a + 4096]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c[a : a + 4096]), pa.array(s[a : a + 4096])], ["d", "b", "id", "v", "kth", "c", "s"])

        ready = asked.withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).join(kth, "id", "left").select("d", "b", "id", "v", "kth", "c", "s")
        sent = stored(ready.mapInArrow(away, f"d int, b int, id long, v {kind}, kth struct<score:bigint,vec_id:bigint>, c int, s int"), "sent")
        met = stored(sent.select("d", "c", "s", "b").distinct(), "meetings")

        def elsewhere(own: pa.Table, ask: pa.Table) -> pa.Table:
            cols = list(zip(*found(own, ask))) or [(), (), ()]
            return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

        keys = ["d", "c", "s", "b"]
        others = items.join(met, ["d", "c", "s"]).select(*keys, "id", "v").groupBy(keys).cogroup(sent.groupBy(keys)).applyInArrow(elsewhere, _RESULT)
        best = home.unionByName(others).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return scratch.result(best.select("query_id", "rank", "vec_id", "score"), "best")

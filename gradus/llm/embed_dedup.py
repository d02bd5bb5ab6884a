"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random directions. In each sorted projection a window of fixed width around a query holds
the rows that collide with it; a pair that collides in enough projections is verified by its cosine in double precision.
For a pair right at the threshold the differences of its projections are normal with deviation sqrt(2 - 2 t), so
the window gives the chance of one collision, and the count is the largest that such a pair still reaches with ``recall``.

Equal vectors are one class with a multiplicity. The first projection, cut at quantiles, deals classes to blocks of equal
size; blocks meet where 2.5 windows reach from one to the other (5 deviations of a pair at the threshold), which most do. A group is one pair of blocks. Inside it each
projection is sorted once and windows are runs of ranks. It sends on, per vector, the number of links and one edge to the
smallest member of its local component, never the pairs, so that a large group of near copies stays linear in rows.
On data without structure the blocks still all meet: the work is quadratic with a small constant, as for any
one-dimensional projections; pairs verified are few.

Null vectors, zero vectors and those with null or non-finite components link with nothing. A vector without an id links with
nothing either: its component is null and it is kept. Vectors of different lengths never link. Rows alike in id and vector count
once; different vectors under one id are rows of their own, each with its own links, and tie nothing together by their id. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import Scratch, connected_components, stored
from gradus.llm.topk import usable

PROJECTIONS, WIDTH, RECALL, BLOCK, SEED = 32, 2.0, 0.9999, 4096, 20240
#: Rows of a tile of the count matrix.
TILE = 256


def directions(d: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((d, m))


def calibrated_count(m: int, width: float, recall: float) -> int:
    """Largest count that Binomial(m, P(|N(0, 1)| <= width)) reaches with chance ``recall``."""
    p = math.erf(width / math.sqrt(2))
    tail, k = 0.0, m + 1
    while k > 0 and tail < recall:
        k -= 1
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
    return k


def units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to unit length in double precision; components are scaled first against overflow."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i[k] with j[k]; a label is the smallest member of its component."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def block_links(x: np.ndarray, y: np.ndarray, same: bool, weight_x: np.ndarray, weight_y: np.ndarray, place_x: np.ndarray, place_y: np.ndarray, label: np.ndarray, threshold: float, m: int, window: float, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks: weighted numbers for the rows of x and of y, and the labels of all places after joining."""
    along = directions(x.shape[1], m, seed)
    px, py = x @ along, y @ along
    kind = np.uint16 if len(y) < 1 << 16 else np.uint32
    rank, begin, span = np.empty((m, len(y)), kind), np.empty((m, len(x)), kind), np.empty((m, len(x)), kind)
    for k in range(m):
        order = np.argsort(py[:, k])
        rank[k, order] = np.arange(len(y), dtype=kind)
        line = py[order, k]
        begin[k] = np.searchsorted(line, px[:, k] - window)
        span[k] = np.searchsorted(line, px[:, k] + window, side="right") - begin[k]
    of_x, of_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    for a in range(0, len(x), TILE):
        b = min(len(x), a + TILE)
        count = np.zeros((b - a, len(y)), np.uint8)
        for k in range(m):
            count += (rank[k][None, :] - begin[k, a:b, None]) < span[k, a:b, None]
        passed = count >= least
        if same:
            passed &= np.arange(len(y))[None, :] > np.arange(a, b)[:, None]
        rows, cols = np.flatnonzero(passed.any(axis=1)), np.flatnonzero(passed.any(axis=0))
        if not len(rows):
            continue
        if passed.sum() * 8 > len(rows) * len(cols):  # dense: one product; else the pairs alone
            i, j = np.nonzero(passed[np.ix_(rows, cols)] & (x[a + rows] @ y[cols].T >= threshold))
            i, j = rows[i], cols[j]
        else:
            i, j = np.nonzero(passed)
            good = np.einsum("ij,ij->i", x[a + i], y[j]) >= threshold
            i, j = i[good], j[good]
        np.add.at(of_x, a + i, weight_y[j])
        np.add.at(of_y, j, weight_x[a + i])
        label = merge(label, place_x[a + i], place_y[j])
    return of_x, of_y, label


def near_duplicates(df: DataFrame, threshold: float = 0.9, vector: str = "embedding", key: str = "vec_id", projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(key, n_links, component_id, kept) for every row, stored."""
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        away = math.sqrt(max(0.0, 2 - 2 * threshold))
        window, least = width * away, calibrated_count(projections, width, recall)
        rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).distinct()
        good = F.coalesce(F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0), F.lit(False))
        # An id may have several vectors, so that classes of equal vectors go by numbers of their own.
        classes = stored(rows.filter(good).groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("k", F.monotonically_increasing_id()), "classes")

        def project(batches):
            for t in batches:
                sizes = t.column("d").to_numpy()
                p = np.zeros(len(sizes))
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    p[at] = units(t.column("v").take(pa.array(at))) @ directions(int(d), projections, seed)[:, 0]
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(p)], [*t.schema.names, "p"])

        kind = df.schema[vector].dataType.simpleString()
        lined = stored(classes.select("k", "n", "v", F.size("v").alias("d")).mapInArrow(project, f"k long, n long, v {kind}, d int, p double"), "lined")
        blocks = max(1, -(-lined.count() // block))
        cuts = lined.agg(F.percentile_approx("p", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] if blocks > 1 else []
        cuts = sorted(set(cuts or []))
        # Block b holds [cuts[b - 1], cuts[b]); from each block the windows reach a run of later blocks.
        reach = 2.5 * window
        last = [int(np.searchsorted(cuts, hi + reach, side="right")) for hi in cuts] + [len(cuts)]
        first = [int(np.searchsorted(cuts, lo - reach, side="right")) for lo in cuts]
        first = [0] + first
        bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
        mine = lined.withColumn("m", F.size(F.filter(bounds, lambda c: c <= F.col("p"))))
        partners = F.sequence(F.get(F.lit(first).cast("array<int>"), F.col("m")), F.get(F.lit(last).cast("array<int>"), F.col("m")))
        dealt = mine.withColumn("o", F.explode(partners)).select("d", F.least("m", "o").alias("a"), F.greatest("m", "o").alias("b"), "m", "k", "n", "v")

        def group(t: pa.Table) -> pa.Table:
            m = t.column("m").to_numpy()
            same = t.column("a")[0].as_py() == t.column("b")[0].as_py()
            order = np.argsort(t.column("k").to_numpy(), kind="stable")
            ids, weight = t.column("k").to_numpy()[order], t.column("n").to_numpy()[order]
            x, side = units(t.column("v"))[order], m[order] == t.column("a")[0].as_py()
            here, there = np.flatnonzero(side), np.flatnonzero(side if same else ~side)
            label, total = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            if len(here) and len(there):
                one, two, label = block_links(x[here], x[there], same, weight[here], weight[there], here, there, label, threshold, projections, window, least, seed)
                np.add.at(total, here, one)
                np.add.at(total, there, two)
            linked = np.flatnonzero(total)
            return pa.table([pa.array(ids[linked]), pa.array(total[linked]), pa.array(ids[label[linked]])], ["k", "n", "root"])

        found = stored(dealt.groupBy("d", "a", "b").applyInArrow(group, "k long, n long, root long"), "links")
        components = stored(connected_components(found, "k", "root").select(F.col("id").alias("k"), F.col("component_id").alias("top")), "tops")
        links = found.groupBy("k").agg(F.sum("n").alias("links"))
        own = stored(classes.join(links, "k", "left").join(components, "k", "left").withColumn("top", F.coalesce("top", "k")), "tied")
        least = stored(own.groupBy("top").agg(F.min("rep").alias("c")), "least")
        # Stored, so that a hot vector's rows meet it in a join that Spark can split.
        own = stored(own.join(least, "top").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "c"), "own")
        linked = rows.filter(good).join(own, "v").select("id", "links", "c")
        alone = rows.filter(~good).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("c"))
        every = linked.unionByName(alone)
        return scratch.result(every.select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept")), "linked")

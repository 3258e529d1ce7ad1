"""Hard negatives of anchors by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own (k-means over a
sample of rows); a row's cell is its pair of nearest centres. With q = (q1, q2) an
anchor, no row of cell (i, j) scores more than

    u1[i] + u2[j],  u[i] = q . centre[i] + |q| * radius[i],

where the radius is the greatest distance of any row from that centre. A heap
over the two sorted lists of half bounds visits the cells by falling bound (the
multi-sequence algorithm), and the search stops where the next bound is below
every window's last wanted score: what is left then cannot belong to the result.

Cells are packed into shards of bounded size, large ones cut into several, and
anchors into chunks; an anchor travels only to the shards that hold cells it
visits. Both searches, for positives and then for the windows below them, go in
two waves: the first visits an anchor's best cells, whose results bound from
below what the second still has to visit.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reportlake.llm.components import staged

#: Centres of each half, rows that teach them (at most about), rounds of k-means.
CENTRES, SAMPLE, ROUNDS = 16, 20_000, 8
#: Rows of a shard, least and most (between them: the session's shuffle partitions share the rows).
SHARD_ROWS = 1 << 10, 1 << 16
#: Anchors that meet a shard in one task, at most about.
CHUNK = 1 << 12
#: Shards' worth of rows that the first wave visits, and rows scored at a time.
FIRST_WAVE, STEP = 4, 2048

_ROW = "rid bigint, id bigint, label int, x array<double>"


def k_means(x: np.ndarray, centres: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the rows of ``x`` (not empty), started from rows far apart."""
    far = np.full(len(x), np.inf)
    chosen = [0]
    for _ in range(min(centres, len(x)) - 1):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    c = x[chosen].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def half_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Greatest score of ``q`` with any row around each centre, rounding included."""
    norm = float(np.linalg.norm(q))
    slack = 1e-9 * norm * (np.linalg.norm(centres, axis=1) + radii) + 1e-6
    return centres @ q + norm * radii + slack


def visit(u1: np.ndarray, u2: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Every (i, j) with its bound u1[i] + u2[j], by falling bound."""
    a, b = np.argsort(-u1, kind="stable").tolist(), np.argsort(-u2, kind="stable").tolist()
    x, y = u1[a].tolist(), u2[b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        least, i, j = heapq.heappop(heap)
        yield a[i], b[j], -least
        # (i, j) opens its right neighbour, and the first column the next row: each cell once.
        if j + 1 < len(b):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integer-valued doubles, limited to 64 bits."""
    if not x.size:
        return np.zeros(len(x), dtype=np.int64)
    if np.abs(x).max() * np.abs(q).max() * len(q) < 2.0 ** 53:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * b for a, b in zip(r, whole)), low), high) for r in x], dtype=np.int64)


@dataclass
class Cells:
    """What the driver holds of the index: two codebooks, the radii, and where each
    of at most CENTRES squared cells lies (first shard, number of shards, rows)."""

    dims: int
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    first: np.ndarray
    pieces: np.ndarray
    rows: np.ndarray
    shard_rows: int

    def padded(self, lists: list[list[float]]) -> np.ndarray:
        return padded(lists, self.dims)

    def plan(self, q: np.ndarray, skip: int, least: float | None) -> tuple[list[tuple[int, float]], int]:
        """Cells to visit after the first ``skip``, by falling bound: down to the bound
        ``least``, or (None) until FIRST_WAVE shards' worth of rows; and how many were passed in all."""
        half = self.dims // 2
        u1 = half_bounds(q[:half], self.centres[0], self.radii[0])
        u2 = half_bounds(q[half:], self.centres[1], self.radii[1])
        out, seen, rows = [], 0, 0
        for i, j, bound in visit(u1, u2):
            cell = i * len(u2) + j
            if not self.rows[cell]:
                continue
            if bound < least if least is not None else rows >= FIRST_WAVE * self.shard_rows:
                break
            seen, rows = seen + 1, rows + int(self.rows[cell])
            if seen > skip:
                out.append((cell, bound))
        return out, seen


def padded(lists: list[list[float]], dims: int) -> np.ndarray:
    """Rows of ``dims`` values; shorter vectors end in zeros."""
    if all(len(v) == dims for v in lists):
        return np.array(lists, dtype=np.float64).reshape(len(lists), dims)
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def build_index(spark: SparkSession, rows: DataFrame, dims: int, n: int) -> tuple[Cells, DataFrame]:
    """The index and its rows (``shard``, ``cell``, rid, id, label, x)."""
    share = min(1.0, SAMPLE / max(n, 1))
    some = rows.where(F.pmod(F.xxhash64("rid", "id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("x")
    x = padded([r["x"] for r in some.collect()] or [[]], dims)
    half = dims // 2
    books = k_means(x[:, :half], CENTRES), k_means(x[:, half:], CENTRES)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = padded(batch.column("x").to_pylist(), dims)
            i, j = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
            far = [np.linalg.norm(part - book[at], axis=1) for part, book, at in
                   ((x[:, :half], books[0], i), (x[:, half:], books[1], j))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((i * len(books[1]) + j).astype(np.int32)), pa.array(far[0]), pa.array(far[1])],
                names=[*batch.schema.names, "cell", "r1", "r2"])

    placed = staged(spark, rows.mapInArrow(place, f"{_ROW}, anchor boolean, cell int, r1 double, r2 double"), "cells")
    shard_rows = min(max(-(-n // int(spark.conf.get("spark.sql.shuffle.partitions"))), SHARD_ROWS[0]), SHARD_ROWS[1])
    size = len(books[0]) * len(books[1])
    counts, radii = np.zeros(size, dtype=np.int64), (np.zeros(len(books[0])), np.zeros(len(books[1])))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect():
        i, j = divmod(r["cell"], len(books[1]))
        counts[r["cell"]] = r["n"]
        radii[0][i], radii[1][j] = max(radii[0][i], r["r1"]), max(radii[1][j], r["r2"])
    first, pieces = np.zeros(size, dtype=np.int64), np.ones(size, dtype=np.int64)
    shard = filled = 0
    for cell, c in enumerate(counts.tolist()):
        pieces[cell] = max(1, -(-c // shard_rows))
        if filled and filled + c > shard_rows:
            shard, filled = shard + 1, 0
        first[cell] = shard
        if pieces[cell] > 1:
            shard, filled = shard + int(pieces[cell]), 0
        else:
            filled += c
    at = F.col("cell") + 1
    home = (F.element_at(F.lit(first.tolist()), at)
            + F.pmod(F.xxhash64("rid"), F.element_at(F.lit(pieces.tolist()), at)))
    index = placed.select(home.cast("int").alias("shard"), "cell", "rid", "id", "label", "x", "anchor")
    return Cells(dims, books, radii, first, pieces, counts, shard_rows), index


def routed(anchors: DataFrame, cells: Cells) -> DataFrame:
    """A row for each anchor and shard it visits: the anchor's columns, ``shard``, the
    cells to visit there by falling bound, and how many cells were passed in all.
    ``anchors`` have ``skip`` (cells passed before) and ``least`` (null: first wave)."""
    names = [c for c in anchors.columns if c not in ("skip", "least")]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = cells.padded(batch.column("x").to_pylist())
            out: dict[str, list] = {"row": [], "shard": [], "passed": [], "cells": [], "bounds": []}
            for k, (skip, least) in enumerate(zip(batch.column("skip").to_pylist(), batch.column("least").to_pylist())):
                todo, passed = cells.plan(x[k], skip or 0, least)
                by_shard: dict[int, list[tuple[int, float]]] = {}
                for cell, bound in todo:
                    for piece in range(int(cells.pieces[cell])):
                        by_shard.setdefault(int(cells.first[cell]) + piece, []).append((cell, bound))
                for shard, visits in by_shard.items():
                    for name, v in (("row", k), ("shard", shard), ("passed", passed),
                                    ("cells", [c for c, _ in visits]), ("bounds", [b for _, b in visits])):
                        out[name].append(v)
            kept = batch.select(names).take(pa.array(out["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(out["shard"], pa.int32()), pa.array(out["passed"], pa.int32()),
                 pa.array(out["cells"], pa.list_(pa.int32())), pa.array(out["bounds"], pa.list_(pa.float64()))],
                names=[*names, "shard", "passed", "cells", "bounds"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema if f.name in names)
    return anchors.mapInArrow(route, f"{kept}, shard int, passed int, cells array<int>, bounds array<double>")


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by falling score, then id."""
    if len(s) > 4 * k:
        last = np.partition(s, len(s) - k)[len(s) - k]
        some = np.nonzero(s >= last)[0]
        return some[np.lexsort((ids[some], -s[some]))[:k]]
    return np.lexsort((ids, -s))[:k]


def search(index: DataFrame, visits: DataFrame, cells: Cells, n_anchors: int, wanted: int, same: bool) -> DataFrame:
    """Candidates (``a``, ``w``, ``id``, ``score``) of the anchors ``a`` on the shards they
    visit: the first ``wanted`` rows for each window ``w`` = (low, high), of the
    anchor's label (``same``; not itself) or of others. ``lows``, ``highs`` and ``tails``
    (the score of the last one known so far, below which none is wanted) are lists."""
    chunks = max(1, -(-n_anchors // CHUNK))
    left = index.select("shard", "cell", "rid", "id", "label", "x").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = visits.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int"))

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, list] = {"a": [], "w": [], "id": [], "score": []}
        if rows.num_rows and anchors.num_rows:
            cell = rows.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            x = cells.padded(rows.column("x").to_pylist())[order]
            cell, rid, ids, label = cell[order], *(rows.column(c).to_numpy()[order] for c in ("rid", "id", "label"))
            own = cells.padded(anchors.column("x").to_pylist())
            for k, a in enumerate(anchors.drop_columns(["x"]).to_pylist()):
                for w, i, s in _visit_shard(own[k], a, x, cell, rid, ids, label, wanted, same):
                    out["a"].append(a["rid"]), out["w"].append(w), out["id"].append(i), out["score"].append(s)
        return pa.table([pa.array(out["a"], pa.int64()), pa.array(out["w"], pa.int32()),
                         pa.array(out["id"], pa.int64()), pa.array(out["score"], pa.int64())],
                        names=["a", "w", "id", "score"])

    return left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(
        meet, "a bigint, w int, id bigint, score bigint")


def _visit_shard(q, a, x, cell, rid, ids, label, wanted, same) -> Iterator[tuple[int, int, int]]:
    """One anchor's cells of one shard in order of their bounds, until they are below every window's tail."""
    visits = np.array(a["cells"])
    begin, end = np.searchsorted(cell, visits), np.searchsorted(cell, visits, side="right")
    tails = list(a["tails"])
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in tails]
    k = 0
    while k < len(visits) and a["bounds"][k] >= min(tails):
        parts, n = [], 0
        while k < len(visits) and n < STEP:
            parts.append(np.arange(begin[k], end[k]))
            n, k = n + len(parts[-1]), k + 1
        at = np.concatenate(parts)
        at = at[(label[at] == a["label"]) & (rid[at] != a["rid"])] if same else at[label[at] != a["label"]]
        s = scores(x[at], q)
        for w, (low, high) in enumerate(zip(a["lows"], a["highs"])):
            fit = np.nonzero((s >= max(low, tails[w])) & (s <= high))[0]
            if not len(fit):
                continue
            s_all, i_all = np.concatenate([found[w][0], s[fit]]), np.concatenate([found[w][1], ids[at[fit]]])
            best = _best(s_all, i_all, wanted)
            found[w] = s_all[best], i_all[best]
            if len(best) == wanted:
                tails[w] = max(tails[w], int(s_all[best[-1]]))
    for w, (s, i) in enumerate(found):
        yield from ((w, int(b), int(a_)) for a_, b in zip(s.tolist(), i.tolist()))


def _waves(spark: SparkSession, index: DataFrame, anchors: DataFrame, cells: Cells, n_anchors: int, wanted: int,
           same: bool) -> DataFrame:
    """The first ``wanted`` rows (a, w, id, score, rank) of every window of every anchor."""
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)

    first = staged(spark, routed(anchors.withColumns({"skip": F.lit(0), "least": F.lit(None).cast("double")}), cells),
                   "routes")
    known = staged(spark, ranked(search(index, first, cells, n_anchors, wanted, same)), "candidates")
    last = (known.where(F.col("rank") == wanted).groupBy("a")
            .agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last")))  # one entry a window
    passed = first.groupBy("rid").agg(F.max("passed").alias("skip"))
    tails = F.transform("lows", lambda low, w: F.coalesce(F.try_element_at("last", w), low))
    again = (anchors.join(passed, "rid").join(last, anchors.rid == last.a, "left").drop("a")
             .withColumn("tails", tails).drop("last").withColumn("least", F.array_min("tails").cast("double")))
    rest = search(index, routed(again, cells), cells, n_anchors, wanted, same)
    return staged(spark, ranked(known.drop("rank").union(rest)), "found")


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   units: int = 256) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id``, ``positive_id``,
    ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Components become floor(``units`` * x); scores are their integer inner products
    (exact up to 64 bits, limited to them beyond). Rows that satisfy ``anchor`` are
    the anchors. Its positives are the first ``positives`` other rows of its label by
    falling score, its negatives the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` per cent of the positive's (both included; none
    for a negative score). Ties go to the smaller id.

    Rows with a null id or label, a null vector or a null or non-finite component
    take no part. A shorter vector counts as padded with zeros. Repeated rows are
    rows of their own, also as positives of each other. An anchor without a
    positive, and an empty table, give no rows; other columns are not read.
    """
    spark = rows.sparkSession
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * units) < float("inf"), F.lit(False)))
    clean = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("int").alias("label"), v.cast("array<double>").alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat = np.floor(x.flatten().to_numpy(zero_copy_only=False) * units)
            ends = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield batch.set_column(3, "x", pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    clean = staged(spark, clean.mapInArrow(whole, f"{_ROW}, anchor boolean"), "vectors")
    size = clean.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)),
                     F.count(F.when(F.col("anchor"), 1))).first()
    n, dims, n_anchors = size[0], max(int(size[1]), 2), int(size[2])
    cells, index = build_index(spark, clean, dims, n)

    least, most = -(1 << 63), (1 << 63) - 1
    every = F.array(F.lit(least))
    anchors = index.where("anchor").select("rid", "id", "label", "x", every.alias("lows"),
                                           F.array(F.lit(most)).alias("highs"), every.alias("tails"))
    near = _waves(spark, index, anchors, cells, n_anchors, positives, same=True)
    window = F.struct(F.col("rank"), F.col("id").alias("positive"), F.col("score"))
    mine = near.groupBy("a").agg(F.array_sort(F.collect_list(window)).alias("p"))  # ``positives`` at most
    # low * p <= 100 * s <= high * p, in whole numbers; a window below zero is empty.
    exact = F.col("p.score").cast("array<decimal(38,0)>")
    lows = F.transform(exact, lambda p: F.when(p < 0, most).otherwise(F.ceil(p * low / 100)).cast("bigint"))
    highs = F.transform(exact, lambda p: F.when(p < 0, least).otherwise(F.floor(p * high / 100)).cast("bigint"))
    targets = staged(spark, anchors.select("rid", "id", "label", "x").join(mine, F.col("rid") == F.col("a")).select(
        "rid", "id", "label", "x", lows.alias("lows"), highs.alias("highs"), lows.alias("tails"), "p"), "windows")
    found = _waves(spark, index, targets.drop("p"), cells, n_anchors, negatives, same=False)
    p = F.element_at("p", F.col("w") + 1)
    return (found.join(targets.select("rid", F.col("id").alias("anchor_id"), "p"), found.a == F.col("rid"))
            .select("anchor_id", p["positive"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias("negative_id"), p["score"].alias("positive_score"),
                    F.col("score").alias("negative_score")))

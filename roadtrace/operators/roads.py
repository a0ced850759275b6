"""Road graphs, nearby edges, anchoring, route distances, map matching and map-aided walks."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions import geo
from roadtrace.functions.geo import _c
from roadtrace.operators.groups import apart

CELL_M = 150.0


def _own(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own, so that both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def shuffled(df: DataFrame) -> DataFrame:
    """The same rows as a side of a join that meets the other in a shuffle: roads that few rows are exploded to (a lattice), or a table in well packed files, look small to Spark, which would collect them in the driver to broadcast them."""
    return df.hint("merge")


def bbox_filter(points: DataFrame, drive: DataFrame, pad_m: float = 300.0) -> DataFrame:
    """Points inside the drive's extent padded by ``pad_m`` metres (the extent is one row)."""
    dlat = F.degrees(F.lit(pad_m / geo.EARTH_RADIUS_M))
    box = drive.agg(F.min("lat").alias("_a"), F.max("lat").alias("_b"), F.min("lon").alias("_c"), F.max("lon").alias("_d"))
    dlon = dlat / F.greatest(F.cos(F.radians("_a")), F.lit(1e-6))
    inside = F.col("lat").between(F.col("_a") - dlat, F.col("_b") + dlat) & F.col("lon").between(F.col("_c") - dlon, F.col("_d") + dlon)
    return points.join(F.broadcast(box), inside).select(*points.columns)


def build_road_graph(ways: DataFrame, lat0: float, lon0: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, e, n) and undirected edges (edge, a, b, ae, an, be, bn, length) of ways (way, seq, node, lat, lon).

    A node keeps the place of its first appearance; edges of no length are dropped.
    """
    e, n = geo.to_enu("lat", "lon", lat0, lon0)
    first = ways.groupBy("node").agg(F.min_by(F.struct("lat", "lon"), F.struct("way", "seq")).alias("p")).select("node", "p.lat", "p.lon")
    nodes = first.select("node", e.alias("e"), n.alias("n"))
    pairs = ways.withColumn("b", F.lead("node").over(W.partitionBy("way").orderBy("seq"))).where("b is not null").select(F.col("node").alias("a"), "b")
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates()
    at = lambda x: nodes.select(F.col("node").alias(x), F.col("e").alias(f"{x}e"), F.col("n").alias(f"{x}n"))
    edges = pairs.join(at("a"), "a").join(at("b"), "b").withColumn("length", F.sqrt((F.col("ae") - F.col("be")) ** 2 + (F.col("an") - F.col("bn")) ** 2))
    return nodes, edges.where("length > 0").withColumn("edge", F.concat_ws("-", "a", "b"))


def _box(edges: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    """``edges`` once for each cell (cx, cy) of their bounding boxes, these ``pad`` metres wider on each side."""
    low = lambda c: F.floor((F.least(f"a{c}", f"b{c}") - pad) / cell)
    high = lambda c: F.floor((F.greatest(f"a{c}", f"b{c}") + pad) / cell)
    rows = edges.withColumns({"_y0": low("n"), "_y1": high("n"), "cx": F.explode(F.sequence(low("e"), high("e")))})
    return rows.withColumn("cy", F.explode(F.sequence("_y0", "_y1"))).drop("_y0", "_y1")


def grid_index(edges: DataFrame, cell: float = CELL_M) -> DataFrame:
    """edge, cx, cy: the cells of each edge's bounding box."""
    return _box(edges, cell).select("edge", "cx", "cy")


def own_edges(points: DataFrame, edges: DataFrame, keys: list[str], reach, cell: float = CELL_M, e: str = "e", n: str = "n") -> DataFrame:
    """Each key's own subgraph: all edges within ``reach`` (metres, or a column of them) of one of its points, and some more of the same cells.

    Points become the cells they lie in, these the cells of their reach, and edges
    go to theirs, so it is an equi-join.
    """
    at = points.select(*keys, F.floor(_c(e) / cell).alias("_x"), F.floor(_c(n) / cell).alias("_y"), (_c(reach) if isinstance(reach, str) else F.lit(float(reach))).alias("_r"))
    at = at.groupBy(*keys, "_x", "_y").agg(F.ceil(F.max("_r") / cell).alias("_r"))
    side = lambda c: F.sequence(F.col(c) - F.col("_r"), F.col(c) + F.col("_r"))
    cells = at.select(*keys, F.explode(side("_x")).alias("cx"), side("_y").alias("_y")).select(*keys, "cx", F.explode("_y").alias("cy")).distinct()
    return cells.join(shuffled(grid_index(edges, cell)), ["cx", "cy"]).select(*keys, "edge").distinct().join(shuffled(edges), "edge")


#: Columns of a region, and rows of the trajectories that share one.
REGION = ["_tx", "_ty", "_part"]
SHARED = 20_000


def regions(points: DataFrame, keys: list[str], size: float, rows: str | None = None, shared: int = SHARED) -> DataFrame:
    """keys and ``REGION``: keys whose points begin in the same square of ``size`` metres share a region, so that its subgraph travels and is laid out once for all.

    A square of more than ``shared`` points (or ``rows``, a column summed over them) is dealt by the keys' hash.
    """
    at = lambda c: F.coalesce(F.floor(F.min(c) / size), F.lit(0).cast("long"))
    homes = points.groupBy(*keys).agg(at("e").alias("_tx"), at("n").alias("_ty"), (F.sum(rows) if rows else F.count("*")).alias("_rows"))
    parts = homes.groupBy("_tx", "_ty").agg(F.ceil(F.sum("_rows") / shared).alias("_parts"))
    return homes.join(parts, ["_tx", "_ty"]).select(*keys, "_tx", "_ty", F.pmod(F.xxhash64(*keys), F.greatest("_parts", F.lit(1))).alias("_part"))


#: Pairs of a point and an edge of one cell that a task meets together; a cell with more is dealt.
WORK = 4_000_000
#: Cells that may be dealt; their list is broadcast.
DEALT_CELLS = 500_000


def _deal(points: DataFrame, roads: DataFrame, by: list[str], work: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (with cx, cy) with a ``part``: the points of a cell of more than ``work`` pairs are dealt by their hash, its edges go to every part.

    Where more than ``DEALT_CELLS`` cells could be that full, ``work`` grows, so the list of these cells has a bound.
    """
    count = lambda df, name: df.groupBy("cx", "cy").agg(F.count("*").alias(name))
    cells = count(points, "_p").join(shuffled(count(roads, "_e")), ["cx", "cy"]).withColumn("_work", F.col("_p").cast("double") * F.col("_e"))
    limit = cells.agg(F.greatest(F.lit(float(work)), F.sum("_work") / DEALT_CELLS).alias("_limit"))
    hot = cells.join(F.broadcast(limit), F.col("_work") > F.col("_limit"))
    hot = F.broadcast(hot.select("cx", "cy", F.least("_p", F.ceil(F.col("_work") / F.col("_limit"))).alias("_parts")))
    part = F.when(F.col("_parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*by), F.col("_parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    return points.join(hot, ["cx", "cy"], "left").withColumn("part", part).drop("_parts"), roads.join(hot, ["cx", "cy"], "left").withColumn("part", every).drop("_parts")


def _near(points: DataFrame, edges: DataFrame, keys: list[str], radii: list[float], k: int, e: str, n: str, work: int | None) -> DataFrame:
    """The at most ``k`` nearest edges of each point within the first of ``radii`` (from the least on) that has any, with rank and that radius.

    A point goes to its own cell and an edge to all that it may be near to, so it is an equi-join after which
    a point's edges are in one task: what is too far or one too many goes there, before they are ranked by their keys.
    """
    most = radii[-1]
    cell = max(CELL_M, most)
    p = points.select(*keys, _c(e).alias("pe"), _c(n).alias("pn")).withColumns({"cx": F.floor(_c("pe") / cell), "cy": F.floor(_c("pn") / cell)})
    roads, on = _box(edges.select("edge", "a", "b", "ae", "an", "be", "bn", "length"), cell, most), ["cx", "cy"]
    if work is not None:
        (p, roads), on = _deal(p, roads, [*keys, "pe", "pn"], work), [*on, "part"]
    p = apart(p, on)
    near = p.join(shuffled(roads), on).withColumns(geo.project_to_segment("pe", "pn", "ae", "an", "be", "bn")).where(F.col("distance") <= most)

    def ranked(near: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by)
        nearest, own = F.min("distance").over(w), F.lit(most)
        for r in radii[-2::-1]:
            own = F.when(nearest <= r, r).otherwise(own)
        ranked = near.withColumns({"rank": F.row_number().over(w.orderBy("distance", "edge")), "radius": own})
        return ranked.where((F.col("rank") <= k) & (F.col("distance") <= F.col("radius")))

    return ranked(ranked(near, [*on, *keys]).drop(*on, "rank", "radius"), keys)


def near_edges(points: DataFrame, edges: DataFrame, keys: list[str], radius: float, k: int = 8, e: str = "e", n: str = "n", work: int | None = WORK) -> DataFrame:
    """The at most ``k`` nearest edges within ``radius`` of each point, with foot point, distance and place along; rank from 1.

    A cell that holds a large part of all points (a depot) is dealt to tasks of some ``work``
    pairs each (None: no cell is, and no one is counted).
    """
    return _near(points, edges, keys, [float(radius)], k, e, n, work).drop("radius")


def near_edges_expanding(points: DataFrame, edges: DataFrame, keys: list[str], radius: float = 60.0, most: float = 200.0, k: int = 8, e: str = "e", n: str = "n", work: int | None = WORK) -> DataFrame:
    """``near_edges`` with the radius doubled for points without any edge, while it is below ``most``.

    One join at the last radius; the distance of a point's nearest edge says which radius is its own.
    """
    radii = [float(radius)]
    while radii[-1] < most:
        radii.append(2 * radii[-1])
    return _near(points, edges, keys, radii, k, e, n, work)


def anchor(points: DataFrame, edges: DataFrame, keys: list[str], heading: str, radius: float = 60.0, k: int = 8) -> DataFrame:
    """The directed edge that best fits place and heading: least angle + 0.02 per metre (ties: the nearer, then its given direction); no row without a road."""
    near = near_edges(points, edges, keys, radius, k).join(shuffled(points.select(*keys, heading)), keys)
    both = near.withColumn("flip", F.explode(F.array(F.lit(0), F.lit(1))))
    pick = lambda x, y: F.when(F.col("flip") == 0, F.col(x)).otherwise(F.col(y))
    both = both.withColumns({"frm": pick("a", "b"), "to": pick("b", "a"), "fe": pick("ae", "be"), "fn": pick("an", "bn"), "te": pick("be", "ae"), "tn": pick("bn", "an")})
    both = both.withColumn("bearing", geo.bearing(F.col("te") - F.col("fe"), F.col("tn") - F.col("fn")))
    both = both.withColumn("score", geo.ang_diff("bearing", heading) + 0.02 * F.col("distance"))
    best = both.groupBy(*keys).agg(F.min_by(F.struct("edge", "frm", "to", "bearing", "distance", "length", F.when(F.col("flip") == 0, F.col("along")).otherwise(F.col("length") - F.col("along")).alias("along"), "score"), F.struct("score", "rank", "flip")).alias("s"))
    return best.select(*keys, "s.*")


def shortest_paths(graph: dict, source, cap: float, targets: set | None = None) -> dict:
    """Distances of at most ``cap`` from ``source`` (graph: node -> list of (node, length)); with ``targets`` only to these, and no further than the last of them."""
    best, heap, missing = {source: 0.0}, [(0.0, source)], set(targets or ())
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        missing.discard(u)
        if targets is not None and not missing:
            break
        for v, w in graph.get(u, ()):
            if (x := d + w) <= cap and x < best.get(v, math.inf):
                best[v] = x
                heapq.heappush(heap, (x, v))
    return best if targets is None else {v: best[v] for v in targets if v in best}


class _Router:
    """Route distances on one subgraph; only the pairs of nodes that were asked for are remembered."""

    def __init__(self, edges: pd.DataFrame, cap: float):
        self.cap, self.graph, self.edge, self.known = cap, {}, {}, {}
        for edge, a, b, ae, an, be, bn, length in edges[["edge", "a", "b", "ae", "an", "be", "bn", "length"]].itertuples(index=False):
            self.graph.setdefault(a, []).append((b, length))
            self.graph.setdefault(b, []).append((a, length))
            self.edge[edge] = (a, b, (ae, an), (be, bn))

    def distances(self, u, targets: set) -> dict:
        """Distances from ``u`` to at least ``targets``, infinite beyond the cap."""
        known = self.known.setdefault(u, {})
        if new := targets - known.keys():
            found = shortest_paths(self.graph, u, self.cap, new)
            known |= {v: found.get(v, math.inf) for v in new}
        return known

    def prepare(self, pairs) -> None:
        """Find the distances between the ends of all ``pairs`` of edges, with one search from each node."""
        targets: dict = {}
        for i, j in pairs:
            for u in self.edge[i][:2]:
                targets.setdefault(u, set()).update(self.edge[j][:2])
        for u, wanted in targets.items():
            self.distances(u, wanted)

    def __call__(self, ei, pi, ej, pj) -> float:
        if ei == ej:
            return math.dist(pi, pj)
        best = self.cap
        a1, b1, xa1, xb1 = self.edge[ei]
        a2, b2, xa2, xb2 = self.edge[ej]
        for u, xu in ((a1, xa1), (b1, xb1)):
            for v, xv in ((a2, xa2), (b2, xb2)):
                best = min(best, math.dist(pi, xu) + self.distances(u, {v})[v] + math.dist(pj, xv))
        return best


def route_distances(pairs: DataFrame, edges: DataFrame, keys: list[str], cap: float = 2000.0) -> DataFrame:
    """Add distance to pairs (edge_i, ei, ni, edge_j, ej, nj) of a region (``keys``): straight on one edge, else the least of four ways through end nodes, at most ``cap``. ``edges`` has the region's subgraph."""

    def run(p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        route = _Router(g, cap)
        route.prepare({(i, j) for i, j in p[["edge_i", "edge_j"]].itertuples(index=False) if i != j})
        return p.assign(distance=[route(i, (a, b), j, (c, d)) for i, a, b, j, c, d in p[["edge_i", "ei", "ni", "edge_j", "ej", "nj"]].itertuples(index=False)])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in pairs.dtypes), "distance double"])
    return pairs.groupBy(*keys).cogroup(_own(edges).groupBy(*keys)).applyInPandas(run, schema)


def viterbi(steps: list[list[tuple]], observed: list[tuple[float, float]], route, sigma: float, beta: float) -> list[int]:
    """Index of the chosen candidate of each step (-1: it has none); candidates are (edge, (e, n), distance)."""
    have = [t for t, c in enumerate(steps) if c]
    out = [-1] * len(steps)
    if not have:
        return out
    emission = lambda c: -c[2] * c[2] / (2 * sigma * sigma)
    score, back = [emission(c) for c in steps[have[0]]], []
    for before, t in zip(have, have[1:], strict=False):
        move = math.dist(observed[t], observed[before])
        ways = [[score[i] - abs(move - route(a[0], a[1], b[0], b[1])) / beta for i, a in enumerate(steps[before])] for b in steps[t]]
        back.append([int(np.argmax(w)) for w in ways])
        score = [max(w) + emission(b) for w, b in zip(ways, steps[t], strict=True)]
    j = int(np.argmax(score))
    for n in range(len(have) - 1, -1, -1):
        out[have[n]] = j
        if n:
            j = back[n - 1][j]
    return out


#: Steps whose transitions are laid out together; bounds the scratch arrays of a block.
STEPS = 2048
#: Values of ``order`` that one task of ``hmm_match`` takes.
BLOCK = 50_000


class _Path:
    """The steps of trajectories that have candidates, as arrays [step, candidate] filled up with candidates of no likelihood.

    ``size``: candidates of each step; ``edges``, ``places`` and ``off``: theirs, one after the other.
    ``group`` numbers the trajectories, which follow one another (None: it is one).
    """

    def __init__(self, size: np.ndarray, edges: np.ndarray, places: np.ndarray, off: np.ndarray, observed: np.ndarray, route: _Router, sigma: float, beta: float, group: np.ndarray | None = None):
        self.have, self.steps, self.route, self.beta = np.flatnonzero(size), len(size), route, beta
        if not len(self.have):
            return
        self.group = np.zeros(len(size), np.int64) if group is None else group
        self.begins = np.diff(self.group[self.have], prepend=-1) != 0
        self.size = size[self.have]
        self.k = int(self.size.max())
        self.there = np.arange(self.k) < self.size[:, None]
        codes, names = pd.factorize(edges)
        self.names, ends = list(names), np.array([route.edge[e][2:] for e in names])
        shape = (len(self.have), self.k)
        self.edge, self.place, far = np.zeros(shape, np.int64), np.zeros((*shape, 2)), np.full(shape, np.inf)
        self.edge[self.there], self.place[self.there], far[self.there] = codes, places, off
        self.to_end = np.linalg.norm(self.place[:, :, None] - ends[self.edge], axis=3)
        self.emission = -far * far / (2 * sigma * sigma)
        self.move = np.linalg.norm(np.diff(observed[self.have], axis=0), axis=1)

    def costs(self):
        """(step, costs [from, to]) of each step but the first. Distances are looked up once for each two edges that follow one another."""
        for a in range(0, len(self.have) - 1, STEPS):
            b = min(a + STEPS, len(self.have) - 1)
            x, y = slice(a, b), slice(a + 1, b + 1)
            i, j = np.broadcast_arrays(self.edge[x][:, :, None], self.edge[y][:, None, :])
            other = self.there[x][:, :, None] & self.there[y][:, None, :] & (i != j) & ~self.begins[y][:, None, None]
            codes, at = np.unique(i[other] * len(self.names) + j[other], return_inverse=True)
            pairs = [(self.names[c // len(self.names)], self.names[c % len(self.names)]) for c in codes.tolist()]
            self.route.prepare(pairs)
            ends = [(self.route.edge[p][:2], self.route.edge[q][:2]) for p, q in pairs]
            apart = np.array([[[self.route.known[u][v] for v in q] for u in p] for p, q in ends]).reshape(-1, 2, 2)
            between = np.full((*other.shape, 2, 2), np.inf)
            between[other] = apart[at]
            ways = self.to_end[x][:, :, None, :, None] + between + self.to_end[y][:, None, :, None, :]
            way = np.minimum(ways.min(axis=(3, 4)), self.route.cap)
            way = np.where(i == j, np.linalg.norm(self.place[x][:, :, None] - self.place[y][:, None], axis=3), way)
            for t, cost in zip(range(a + 1, b + 1), np.abs(self.move[a:b, None, None] - way) / self.beta, strict=True):
                yield t, cost

    def scores(self, entered: bool) -> np.ndarray:
        """Best score [way in, last candidate]: the ways in are the candidates of the first step, or one if nothing was ``entered``."""
        score = self.emission[:1]
        if entered:
            score = np.where(np.eye(self.k, dtype=bool), 0.0, -np.inf)[: self.size[0]]
        for t, cost in self.costs():
            score = (score[:, :, None] - cost).max(axis=1) + self.emission[t]
        return score[:, : self.size[-1]]

    def chosen(self, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the chosen candidate of each step (-1: it has none); ``first`` and ``last`` of a group are chosen already unless they are -1."""
        out = np.full(self.steps, -1)
        if not len(self.have):
            return out
        begins = np.flatnonzero(self.begins)
        ends = np.append(begins[1:] - 1, len(self.have) - 1)
        own = self.group[self.have[begins]]
        start, final = self.emission[begins], np.full(len(begins), -1)
        if first is not None:
            start = np.where(first[own, None] >= 0, np.where(np.arange(self.k) == first[own, None], 0.0, -np.inf), start)
        if last is not None:
            final = last[own].copy()
        score, back, n, begun = start[0], np.zeros((len(self.have), self.k), np.int64), 0, self.begins.tolist()
        for t, cost in self.costs():
            if begun[t]:
                final[n] = final[n] if final[n] >= 0 else score.argmax()
                n += 1
                score = start[n]
                continue
            ways = score[:, None] - cost
            back[t] = ways.argmax(axis=0)
            score = ways.max(axis=0) + self.emission[t]
        final[n] = final[n] if final[n] >= 0 else score.argmax()
        # all groups go back together, from their last steps to their first
        at, j = ends, final
        while len(at):
            out[self.have[at]] = j
            on = ~self.begins[at]
            at, j = at[on] - 1, back[at[on], j[on]]
        return out


def match_path(steps: list[list[tuple]], observed: np.ndarray, route: _Router, sigma: float, beta: float) -> list[int]:
    """``viterbi`` with the transitions of many steps laid out as arrays."""
    flat = [c for s in steps for c in s]
    edges, places, off = np.array([c[0] for c in flat], object), np.array([c[1] for c in flat], float).reshape(-1, 2), np.array([c[2] for c in flat], float)
    return _Path(np.array([len(s) for s in steps], np.int64), edges, places, off, observed, route, sigma, beta).chosen().tolist()


def _ends_of_blocks(scores: list[np.ndarray]) -> list[int]:
    """The candidate at the end of each block on the best path, from the blocks' scores in order: matrices over (max, +)."""
    total, back = scores[0][0], []
    for way in scores[1:]:
        ways = total[:, None] + way
        back.append(ways.argmax(axis=0))
        total = ways.max(axis=0)
    ends = [int(np.argmax(total))]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    return ends[::-1]


def hmm_match(points: DataFrame, candidates: DataFrame, edges: DataFrame, keys: list[str], reach: float, sigma: float = 25.0, beta: float = 12.0, cap: float = 2000.0, order: str = "row_idx", block: int = BLOCK) -> DataFrame:
    """Most likely path of each trajectory over its candidates (``near_edges_expanding``).

    A trajectory of any length is cut into blocks of ``block`` values of ``order``, which
    numbers its rows. 1. A block, with the last step that had a candidate before it, gives the best score
    from each candidate there to each of its own last step. 2. These small matrices of a trajectory meet, in
    order, and say where the best path passes from block to block. 3. Blocks find their
    part of the path. Without a trajectory of several blocks (one look at keys and ``order``) 1 and 2 fall away.

    Routes may use all ``edges`` within ``reach`` metres of a block's points. Rows without a
    candidate keep their own place; so do all rows of a trajectory with a null key.
    """
    at, types = [*keys, "_block"], dict(points.dtypes)
    k = ", ".join(f"`{x}` {types[x]}" for x in keys)
    numbered = points.select(*keys, F.floor(F.col(order) / block).cast("long").alias("_block"), order, F.col("e").cast("double").alias("e"), F.col("n").cast("double").alias("n"))
    cand = candidates.groupBy(*keys, order).agg(F.array_sort(F.collect_list(F.struct("rank", "edge", F.col("foot_e").alias("e"), F.col("foot_n").alias("n"), "distance"))).alias("cand"))
    rows = numbered.join(cand, [*keys, order], "left")
    laid, near = rows.withColumn("_own", F.lit(True)), numbered.select(*at, "e", "n")
    cut = numbered.groupBy(*keys).agg((F.min("_block") < F.max("_block")).alias("cut")).where("cut").limit(1).count() > 0
    if cut:
        last = F.max_by(F.struct(order, "e", "n", "cand"), F.when(F.col("cand").isNotNull(), F.col(order)))
        lasts = rows.groupBy(*at).agg(last.alias("_last")).where("_last is not null")
        before = lasts.withColumn("_last", F.lag("_last").over(W.partitionBy(*keys).orderBy("_block"))).where("_last is not null").select(*at, "_last.*")
        laid, near = laid.unionByName(before.withColumn("_own", F.lit(False))), near.unionByName(before.select(*at, "e", "n"))
    homes = regions(near, at, 2 * reach).select(*[F.col(x).alias(f"_key_{x}") for x in at], *REGION)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(homes, [F.col(x).eqNullSafe(F.col(f"_key_{x}")) for x in at]).select(*df.columns, *REGION)

    graph = own_edges(placed(near), edges, REGION, reach, reach)

    flat = {"_size": F.when(F.col("cand").isNull(), 0).otherwise(F.size("cand")), "_edges": F.col("cand.edge"), "_e": F.col("cand.e"), "_n": F.col("cand.n"), "_off": F.col("cand.distance")}

    def path(p: pd.DataFrame, route: _Router, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Path]:
        """Number of candidates of each row, their edges and places one after the other, and the steps."""
        size = p["_size"].to_numpy(np.int64)
        joined = lambda c, t: np.concatenate([np.empty(0, t), *p[c].to_numpy()[size > 0]])
        edges, places = joined("_edges", object), np.column_stack([joined("_e", float), joined("_n", float)])
        return size, edges, places, _Path(size, edges, places, joined("_off", float), p[["e", "n"]].to_numpy(float), route, sigma, beta, group)

    def score(p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        """Blocks of a region share what is known of its routes."""
        route, found = _Router(g, cap), []
        for _, q in p.groupby(at, sort=False, dropna=False):
            q = q.sort_values(order)
            steps = path(q, route)[-1]
            if len(steps.have):
                found.append(q[at].head(1).assign(_score=[steps.scores(not q["_own"].all()).tolist()]))
        return pd.concat(found or [pd.DataFrame({c: np.array([], object) for c in [*at, "_score"]})], ignore_index=True)

    def decide(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_block")
        ends = _ends_of_blocks([np.stack(s) for s in f["_score"]])
        return f[at].assign(_first=[-1, *ends[:-1]], _last=ends)

    def run(p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        """All blocks of a region one after the other, in one layout."""
        group = p.groupby(at, sort=False, dropna=False).ngroup().to_numpy()
        chosen = np.full((2, group.max(initial=-1) + 1), -1)
        for c, known in zip(("_first", "_last"), chosen, strict=True):
            np.maximum.at(known, group, p[c].to_numpy(np.int64))
        row = np.lexsort((p[order].to_numpy(), group))
        row = row[p["_own"].notna().to_numpy()[row]]
        p, group = p.iloc[row], group[row]
        size, edges, places, steps = path(p, _Router(g, cap), group)
        best = steps.chosen(*chosen)
        matched = best >= 0
        at_best = (np.cumsum(size) - size + best)[matched]
        edge, place = np.full(len(p), None, object), p[["e", "n"]].to_numpy(float)
        edge[matched], place[matched] = edges[at_best], places[at_best]
        out = p[[*keys, order]].assign(edge=edge, match_e=place[:, 0], match_n=place[:, 1], matched=matched)
        return out[p["_own"].astype(bool)]

    # a number of partitions of their own, as a region is few bytes, but long work
    both = lambda left: apart(placed(left).withColumns(flat).drop("cand"), REGION).groupBy(*REGION).cogroup(apart(_own(graph), REGION).groupBy(*REGION))
    whole = laid.withColumns({"_first": F.lit(-1), "_last": F.lit(-1)})
    if cut:
        several = lasts.groupBy(*keys).count().where("count > 1").select(*keys)
        scores = both(laid.join(several, keys, "left_semi")).applyInPandas(score, f"{k}, _block long, _score array<array<double>>")
        ends = scores.groupBy(*keys).applyInPandas(decide, f"{k}, _block long, _first int, _last int")
        whole = whole.unionByName(_own(ends).withColumn(order, F.lit(0).cast(types[order])), allowMissingColumns=True)
    schema = ", ".join([*(f"`{x}` {types[x]}" for x in [*keys, order]), "edge string, match_e double, match_n double, matched boolean"])
    return both(whole).applyInPandas(run, schema)


def walk(place: dict, neighbours: dict, frm, to, along: float, yaw: np.ndarray, v: np.ndarray, dt: float, u_turn: bool) -> tuple[np.ndarray, int, float]:
    """Positions of a walk along the graph, junctions passed and final heading; at a node the road nearest in direction is taken and gives the heading."""
    bear = lambda a, b: math.atan2(place[b][0] - place[a][0], place[b][1] - place[a][1])
    apart = lambda x, y: abs(math.atan2(math.sin(x - y), math.cos(x - y)))
    length, heading, stuck, passed = math.dist(place[frm], place[to]), bear(frm, to), False, 0
    out = np.zeros((len(v), 2))
    for i in range(len(v)):
        left = max(0.0, v[i]) * dt
        if not stuck:
            heading += yaw[i] * dt
            for _ in range(50):
                if left <= 1e-6:
                    break
                if along + left <= length:
                    along, left = along + left, 0.0
                    break
                left -= length - along
                onward = [x for x in neighbours[to] if x != frm] or (list(neighbours[to]) if u_turn else [])
                if not onward:
                    along, stuck = length, True
                    break
                frm, to = to, min(onward, key=lambda x: (apart(bear(to, x), heading), str(x)))
                length, along, heading, passed = math.dist(place[frm], place[to]), 0.0, bear(frm, to), passed + 1
        share = along / max(length, 1e-9)
        out[i] = [place[frm][k] + (place[to][k] - place[frm][k]) * share for k in (0, 1)]
    return out, passed, heading


def map_aided_walk(samples: DataFrame, anchors: DataFrame, edges: DataFrame, keys: list[str], dt: float = 0.1, u_turn: bool = True, order: str = "step", by: list[str] | None = None) -> DataFrame:
    """Walk each episode (yaw_rate, speed) from its anchor along its subgraph (``edges`` with ``by``): map_e, map_n, junctions per row.

    ``by``: columns of ``anchors`` and ``edges`` that name the region (``regions``) whose subgraph its episodes share; None:
    ``keys``, a subgraph for each. ``u_turn``: turn back at a dead end, else stay there. Episodes without an anchor give no rows.
    """
    by = by or keys
    cols = [*keys, order, "map_e", "map_n", "junctions"]

    def run(s: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(s) or not len(g):
            return pd.DataFrame({c: np.array([], object) for c in cols})
        place, near = {}, {}
        for a, b, ae, an, be, bn in g[["a", "b", "ae", "an", "be", "bn"]].itertuples(index=False):
            place |= {a: (ae, an), b: (be, bn)}
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        # all episodes in one layout, each in its order
        episode = s.groupby(keys, sort=False).ngroup().to_numpy()
        row = np.lexsort((s[order].to_numpy(), episode))
        s, episode = s.iloc[row], episode[row]
        at = [*np.flatnonzero(np.diff(episode, prepend=-1)).tolist(), len(s)]
        frm, to, along, yaw, v = s["frm"].to_numpy(), s["to"].to_numpy(), s["along"].to_numpy(float), s["yaw_rate"].to_numpy(float), s["speed"].to_numpy(float)
        track, passed = np.empty((len(s), 2)), np.empty(len(s), np.int64)
        for a, b in zip(at, at[1:], strict=False):
            track[a:b], passed[a:b], _ = walk(place, near, frm[a], to[a], float(along[a]), yaw[a:b], v[a:b], dt, u_turn)
        return s[[*keys, order]].assign(map_e=track[:, 0], map_n=track[:, 1], junctions=passed)[cols]

    types = dict(samples.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in [*keys, order]), "map_e double, map_n double, junctions int"])
    more = [c for c in by if c not in keys]
    rows = samples.select(*keys, order, "yaw_rate", "speed").join(anchors.select(*keys, *more, "frm", "to", "along"), keys)
    return apart(rows, by).groupBy(*by).cogroup(apart(_own(edges), by).groupBy(*by)).applyInPandas(run, schema)

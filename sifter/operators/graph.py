"""Graph operators over vertex and edge tables: components, Louvain, greedy modularity, modularity, density."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.operators.joins import spread_join
from sifter.sources.shared import durable


def components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """(vertex, component) by least label propagation with shortcuts; edges: src, dst. Lone vertices name themselves.

    Each round takes the least label of the neighbours, then that label's own, and is written to the shared folder, so that a
    lost executor costs one round at most. The edges of a hub stay where they are.
    """
    held = lambda df: durable(df, "components")
    both = edges.select("src", "dst").union(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")),
    ).where("src <> dst").distinct()
    points = both.select(F.col("src").alias("vertex"))
    if vertices is not None:
        points = points.union(vertices.select("vertex"))
    both = held(both)
    degree = held(both.groupBy(F.col("dst").alias("vertex")).agg(F.count("*").alias("n")))
    label = held(points.distinct().withColumn("component", F.col("vertex")))
    for _ in range(max_rounds):
        known = held(label.join(degree, "vertex"))
        near = spread_join(both.withColumnRenamed("dst", "vertex"), known, "vertex", "n").groupBy("src").agg(F.min("component").alias("near"))
        step = label.join(near, label.vertex == near.src, "left").select(
            "vertex",
            F.col("component").alias("old"),
            F.least("component", F.coalesce("near", "component")).alias("component"),
        )
        up = step.select(F.col("vertex").alias("at"), F.col("component").alias("up"))
        step = held(
            step.join(up, step.component == up["at"], "left").select(
                "vertex",
                "old",
                F.least("component", F.coalesce("up", "component")).alias("component"),
            ),
        )
        label = step.select("vertex", "component")
        if not step.where("old <> component").limit(1).count():
            return label
    raise RuntimeError("components: not settled")


def _adjacency(edges: list[tuple]) -> dict:
    near: dict = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        near[a][b] += w
        if a != b:
            near[b][a] += w
    return near


def local_components(vertices: list, edges: list[tuple]) -> list[list]:
    up = {v: v for v in vertices}

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b, *_ in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    out = defaultdict(list)
    for v in vertices:
        out[root(v)].append(v)
    return normalised(out.values())


def normalised(groups) -> list[list]:
    """Members sorted, groups by their first member and size."""
    return sorted((sorted(g) for g in groups), key=lambda g: (g[0], len(g)))


def louvain(vertices: list, edges: list[tuple], resolution: float = 1.0, seed: int = 42) -> list[list]:
    """Communities by local moves and aggregation (Blondel et al. 2008), for graphs that fit a driver; deterministic for a seed."""
    members = {v: [v] for v in vertices}
    level = sorted(edges)
    rng = random.Random(seed)
    while True:
        near = _adjacency(level)
        nodes = sorted(members)
        total = sum(w for _, _, w in level)
        if total <= 0:
            return normalised(members.values())
        degree = {v: sum(near[v].values()) + near[v].get(v, 0.0) for v in nodes}
        home, load = {v: v for v in nodes}, dict(degree)
        order, moved_any = nodes[:], False
        rng.shuffle(order)
        moving = True
        while moving:
            moving = False
            for v in order:
                ties: dict = defaultdict(float)
                for u, w in near[v].items():
                    if u != v:
                        ties[home[u]] += w
                own = home[v]
                load[own] -= degree[v]
                gain = lambda c: ties.get(c, 0.0) - resolution * load[c] * degree[v] / (2 * total)  # noqa: B023, E731
                best = own
                for c in sorted(ties):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                load[best] += degree[v]
                if best != own:
                    home[v], moving, moved_any = best, True, True
        if not moved_any:
            return normalised(members.values())
        grouped: dict = defaultdict(list)
        for v in nodes:
            grouped[home[v]] += members[v]
        merged: dict = defaultdict(float)
        for a, b, w in level:
            x, y = sorted((home[a], home[b]))
            merged[x, y] += w
        members, level = dict(grouped), [(a, b, w) for (a, b), w in sorted(merged.items())]


def greedy_modularity(vertices: list, edges: list[tuple], resolution: float = 1.0) -> list[list]:
    """Communities by the best pairwise merge until none raises modularity (Clauset, Newman and Moore 2004)."""
    total = sum(w for *_, w in edges)
    groups = {v: [v] for v in vertices}
    if total <= 0:
        return normalised(groups.values())
    near = _adjacency(edges)
    share = {v: (sum(near[v].values()) + near[v].get(v, 0.0)) / (2 * total) for v in vertices}
    link = {v: {u: w / (2 * total) for u, w in near[v].items() if u != v} for v in vertices}
    while True:
        best = max(
            ((2 * (e - resolution * share[a] * share[b]), a, b) for a in groups for b, e in link[a].items() if a < b),
            key=lambda x: (x[0], ),
            default=None,
        )
        if best is None or best[0] <= 1e-12:
            return normalised(groups.values())
        top = best[0]
        _, a, b = min(
            (
                x
                for x in (
                    (2 * (e - resolution * share[p] * share[q]), p, q) for p in groups for q, e in link[p].items() if p < q
                ) if x[0] >= top - 1e-15
            ),
            key=lambda x: (x[1], x[2]),
        )
        groups[a] += groups.pop(b)
        share[a] += share.pop(b)
        for c, e in link.pop(b).items():
            link[c].pop(b)
            if c != a:
                link[a][c] = link[c][a] = link[a].get(c, 0.0) + e


def local_modularity(groups: list[list], edges: list[tuple], resolution: float = 1.0) -> float:
    """Newman's score of groups of a graph that fits a driver; 0 without edges or with one group."""
    total = sum(w for *_, w in edges)
    if total <= 0 or len(groups) < 2:
        return 0.0
    at = {v: k for k, g in enumerate(groups) for v in g}
    inside, degree = 0.0, [0.0] * len(groups)
    for a, b, w in edges:
        inside += w * (at[a] == at[b])
        degree[at[a]] += w
        degree[at[b]] += w
    return inside / total - resolution * sum(d * d for d in degree) / (4 * total * total)


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): Newman's score of membership (vertex, community) over edges (src, dst, weight).

    0 without edges or with one community.
    """
    a, b = (membership.select(F.col("vertex").alias(v), F.col("community").alias(c)) for v, c in (("src", "ca"), ("dst", "cb")))
    placed = edges.join(a, "src").join(b, "dst")
    total = F.sum("weight")
    inner = placed.groupBy().agg(
        F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(F.lit(0.0))).alias("inside"),
        total.alias("total"),
    )
    ends = placed.select(F.col("ca").alias("c"), "weight").union(
        placed.select(F.col("cb").alias("c"), "weight"),
    ).groupBy("c").agg(F.sum("weight").alias("d"))
    squared = ends.agg(F.sum(F.col("d") * F.col("d")).alias("squares"), F.count("*").alias("communities"))
    score = F.col("inside") / F.col("total") - F.lit(resolution) * F.col("squares") / (4 * F.col("total") * F.col("total"))
    return inner.join(squared).select(
        F.when((F.col("total") > 0) & (F.col("communities") > 1), score).otherwise(F.lit(0.0)).alias("modularity"),
    )


def density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertices, edges, density, average_degree) of a simple undirected graph."""
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    counts = vertices.agg(F.count("*").alias("n")).join(edges.agg(F.count("*").alias("m")))
    return counts.select(
        F.col("n").alias("vertices"),
        F.col("m").alias("edges"),
        F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"),
        F.when(n > 0, 2 * m / n).otherwise(F.lit(0.0)).alias("average_degree"),
    )


def degree_centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).groupBy("vertex").agg(F.count("*").alias("degree"))
    n = F.lit(max(1, vertices.count() - 1))
    return vertices.join(ends, "vertex", "left").select(
        "vertex",
        F.coalesce("degree", F.lit(0)).alias("degree"),
        (F.coalesce("degree", F.lit(0)) / n).alias("centrality"),
    )

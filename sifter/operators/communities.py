"""Communities of graphs of any size: rounds of local moves and merges over written tables of edges and vertices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.operators.graph import greedy_modularity, louvain
from sifter.operators.joins import spread_join
from sifter.sources.shared import durable

#: Rounds of moves on one level, and levels, at most. A level that raises modularity by no more than LEAST is the last.
ROUNDS, LEVELS, LEAST = 10, 30, 1e-6
#: Edges of a merged graph that the driver finishes; such a graph was made from as many communities as it takes.
FINISH = 50_000
#: Vertices, at most, whose communities, loads and degrees are held as arrays by the driver and by each Python worker (22 bytes a vertex).
HELD = 10_000_000


def _level(edges: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(both, vertices, total): edges in both directions but for loops; vertex, degree (a loop counts twice), n (edges but for loops)."""
    edges = durable(edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")), "edges")
    plain = edges.where("src <> dst")
    both = plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))  # the written edges, read twice
    loop = edges.where("src = dst").select(F.col("src").alias("vertex"), (2 * F.col("weight")).alias("w"), F.lit(0).alias("n"))
    ends = both.select(F.col("src").alias("vertex"), F.col("weight").alias("w"), F.lit(1).alias("n")).unionByName(loop)
    vertices = durable(ends.groupBy("vertex").agg(F.sum("w").alias("degree"), F.sum("n").alias("n")), "vertices")
    return both, vertices, edges.agg(F.sum("weight")).first()[0] or 0.0


def _may_move(vertex: Column, turn: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(vertex, F.lit(turn + seed)), F.lit(2)) == 0


def _moved(both: DataFrame, held: DataFrame, total: float, resolution: float, turn: int, seed: int) -> DataFrame:
    """held (vertex, degree, n, community) after the vertices whose turn it is took their best neighbouring community.

    Half of the vertices, by a hash of vertex and turn, may move at once, so that two neighbours seldom trade places; only their
    edges are shuffled, and a community's load comes with the vertices that it holds.
    """
    load = held.groupBy("community").agg(F.sum("degree").alias("load"))
    at = durable(held.join(load, "community"), "at")  # AQE splits a large community here and below
    near = spread_join(both.where(_may_move(F.col("src"), turn, seed)), at.select(F.col("vertex").alias("dst"), "community", "load", "n"), "dst", "n")
    ties = near.groupBy(F.col("src").alias("vertex"), "community").agg(F.sum("weight").alias("tie"), F.first("load").alias("load"))
    turns = at.where(_may_move(F.col("vertex"), turn, seed)).select("vertex", "degree", F.col("community").alias("own"), F.col("load").alias("own_load"))
    share = F.lit(resolution) * F.col("degree") / (2 * total)
    each = ties.join(turns, "vertex").withColumn("same", F.col("community") == F.col("own"))
    gain = F.col("tie") - share * (F.col("load") - F.when(F.col("same"), F.col("degree")).otherwise(0.0))
    best = each.withColumn("gain", gain).groupBy("vertex").agg(
        F.min(F.struct((-F.col("gain")).alias("less"), F.col("community"))).alias("best"),
        F.max(F.when(F.col("same"), F.col("gain"))).alias("kept"),
        F.first(-share * (F.col("own_load") - F.col("degree"))).alias("alone"),
    )
    better = best.where(-F.col("best.less") > F.coalesce("kept", "alone") + F.lit(1e-12)).select("vertex", F.col("best.community").alias("to"))
    return held.join(better, "vertex", "left").select("vertex", "degree", "n", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved"))


def _merged(edges: DataFrame, named: DataFrame) -> DataFrame:
    """Edges between communities; named: vertex, community, n."""
    src = spread_join(edges, named.select(F.col("vertex").alias("src"), F.col("community").alias("a"), "n"), "src", "n")
    dst = spread_join(src, named.select(F.col("vertex").alias("dst"), F.col("community").alias("b"), "n"), "dst", "n")
    return dst.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))


def _score(merged: DataFrame, total: float, resolution: float) -> float:
    """Modularity of the communities that these are the edges between."""
    inside = merged.where("src = dst").agg(F.sum("weight")).first()[0] or 0.0
    ends = merged.select(F.col("src").alias("c"), "weight").union(merged.select("dst", "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    squares = ends.agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
    return inside / total - resolution * squares / (4 * total * total)


def _followed(mapping: DataFrame, step: DataFrame) -> DataFrame:
    """mapping (vertex, community) with each community's own community by step (vertex, community, n)."""
    size = mapping.groupBy("community").agg(F.count("*").alias("size"))
    up = durable(step.select(F.col("vertex").alias("community"), F.col("community").alias("up")).join(size, "community"), "up")
    return durable(spread_join(mapping, up, "community", "size").select("vertex", F.col("up").alias("community")), "mapping")


def _by_least(mapping: DataFrame) -> DataFrame:
    """Communities named by their least vertex."""
    least = durable(mapping.groupBy("community").agg(F.min("vertex").alias("least"), F.count("*").alias("n")), "least")
    return spread_join(mapping, least, "community", "n").select("vertex", F.col("least").alias("community"))


def _finished(merged: DataFrame, mapping: DataFrame, local, resolution: float) -> DataFrame:
    """mapping after the driver found communities of a small merged graph."""
    rows = [(r.src, r.dst, r.weight) for r in merged.collect()]
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    told = [(v, g[0], 1) for g in local(nodes, rows, resolution) for v in g]
    kind = dict(mapping.dtypes)["community"]
    step = mapping.sparkSession.createDataFrame(told, f"vertex {kind}, community {kind}, n int")
    return _followed(mapping, step)


def communities(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    algorithm: str = "louvain",
    resolution: float = 1.0,
    seed: int = 42,
    finish: int = FINISH,
    held: int = 0,
) -> DataFrame:
    """(vertex, community), communities named by their least vertex. edges: src, dst, weight; vertices (vertex): lone ones name themselves.

    louvain: rounds in which half of the vertices move to the neighbouring community that gains most, then communities become
    vertices, until modularity no longer rises (after Blondel et al. 2008, in parallel). greedy_modularity: rounds in which
    communities that are each other's best merge are merged (after Clauset, Newman and Moore 2004, in parallel). A merged graph
    of up to `finish` edges is finished by the driver, one vertex at a time. The same for any partitioning. Edges with a null
    end, or of weight 0 or less, count for nothing; an empty table gives no rows. held: up to so many vertices, Louvain's rounds
    shuffle nothing, as their communities lie in arrays; the result is the same.
    """
    if algorithm not in ("louvain", "greedy_modularity"):
        raise ValueError(f"communities: unknown algorithm {algorithm}")
    real = durable(edges.select("src", "dst", "weight").where("src is not null and dst is not null and weight > 0"), "real")
    points = real.select(F.col("src").alias("vertex"), F.lit(1).alias("n")).union(real.select("dst", F.lit(1)))
    points = points if vertices is None else points.union(vertices.select("vertex", F.lit(0)).where("vertex is not null"))
    points = durable(points.groupBy("vertex").agg(F.sum("n").alias("n")), "points")
    if algorithm == "louvain" and held and real.count() > finish and points.count() <= held:
        return _held(real, points, resolution, seed, finish)
    mapping = points.select("vertex", F.col("vertex").alias("community"))
    level, score = real, None
    local = louvain if algorithm == "louvain" else greedy_modularity
    for _ in range(LEVELS):
        if level.isEmpty():
            break
        if level.count() <= finish:
            mapping = _with_lone(_finished(level, _touched(mapping, level), local, resolution), mapping)
            break
        both, nodes, total = _level(level)
        step = _louvain_step(both, nodes, total, resolution, seed) if algorithm == "louvain" else _greedy_step(both, nodes, total, resolution)
        if step is None:
            break
        merged = durable(_merged(level, step), "merged")
        now = _score(merged, total, resolution)
        if score is not None and now <= score + LEAST:
            break
        mapping = _with_lone(_followed(_touched(mapping, level), step), mapping)
        level, score = merged, now
    return _by_least(mapping)


def _touched(mapping: DataFrame, level: DataFrame) -> DataFrame:
    """Rows of mapping whose community is an end of an edge."""
    ends = level.select(F.col("src").alias("community")).union(level.select("dst")).distinct()
    return mapping.join(ends, "community", "left_semi").select("vertex", "community")


def _with_lone(mapping: DataFrame, before: DataFrame) -> DataFrame:
    """mapping, and the vertices of before that it lacks."""
    return durable(mapping.unionByName(before.join(mapping.select("vertex"), "vertex", "left_anti").select("vertex", "community")), "mapping")


def _louvain_step(both: DataFrame, nodes: DataFrame, total: float, resolution: float, seed: int) -> DataFrame | None:
    """(vertex, community, n) after rounds of moves; None if none moved."""
    held, quiet, any_moved = nodes.withColumn("community", F.col("vertex")), 0, False
    for turn in range(ROUNDS):
        after = durable(_moved(both, held, total, resolution, turn, seed), "held")
        moved = after.where("moved").count()
        held, any_moved = after.drop("moved"), any_moved or moved > 0
        quiet = quiet + 1 if not moved else 0
        if quiet == 2:
            break
    return held if any_moved else None


def _greedy_step(both: DataFrame, nodes: DataFrame, total: float, resolution: float) -> DataFrame | None:
    """(vertex, community, n): vertices that are each other's best merge, and gain by it, under the lesser of both; None without any."""
    share = nodes.select("vertex", (F.col("degree") / (2 * total)).alias("share"), "n")
    a = spread_join(both, share.withColumnsRenamed({"vertex": "src", "share": "a"}), "src", "n")
    b = spread_join(a, share.withColumnsRenamed({"vertex": "dst", "share": "b"}), "dst", "n")
    gain = F.col("weight") / (2 * total) - F.lit(resolution) * F.col("a") * F.col("b")
    # Of equal gains the one whose pair of ends is hashed lowest, so that mutual choices are found in any graph.
    tie = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"))
    best = b.withColumn("gain", gain).where("gain > 1e-15").groupBy("src").agg(F.min(F.struct((-F.col("gain")).alias("less"), tie.alias("tie"), "dst")).alias("best"))
    best = durable(best.select("src", F.col("best.dst").alias("dst")), "best")
    mutual = best.join(best.select(F.col("src").alias("dst"), F.col("dst").alias("back")), "dst").where("back = src and src < dst")
    joined = mutual.select(F.col("dst").alias("vertex"), F.col("src").alias("to"))
    step = durable(nodes.join(joined, "vertex", "left").select("vertex", F.coalesce("to", "vertex").alias("community"), "n"), "step")
    return None if step.where("vertex <> community").isEmpty() else step


def _numbered(points: DataFrame, seed: int) -> DataFrame:
    """points (vertex, n) with k, a vertex's place in their order from 0, and turns, a bit for each round in which it may move."""
    spread = points.repartitionByRange("vertex").sortWithinPartitions("vertex").withColumn("at", F.monotonically_increasing_id())
    at = durable(spread, "at")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes)))]).tolist()
    k = F.element_at(F.array(*map(F.lit, starts)), part.cast("int") + 1) + row
    turns = sum((_may_move(F.col("vertex"), t, seed).cast("int") * (1 << t) for t in range(ROUNDS)), F.lit(0))
    return durable(at.select("vertex", "n", k.cast("int").alias("k"), turns.alias("turns")), "numbers")


def _array(rows: DataFrame, size: int, kind: str) -> np.ndarray:
    """The second column at the places that the first one names, 0 elsewhere."""
    got, out = rows.toArrow(), np.zeros(size, kind)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _choices(home, load, degree, turns, turn: int, total: float, resolution: float):
    """For rows (src, near: dst and weight of each edge): (src, to) of the vertices that may move and gain by it, as in _moved()."""

    def choose(batches):
        at, loads, degrees, may = home.value, load.value, degree.value, turns.value
        for batch in batches:
            batch = batch.filter(pa.array(may[batch.column(0).to_numpy()] >> turn & 1 == 1))
            if not batch.num_rows:
                continue
            src, lists = batch.column(0).to_numpy(), batch.column(1)
            edges = lists.flatten()
            row = np.repeat(np.arange(len(src)), np.diff(lists.offsets.to_numpy()))
            key = row * len(at) + at[edges.field(0).to_numpy()]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            tie = np.add.reduceat(edges.field(1).to_numpy()[order], first)
            row, near = np.divmod(key[first], len(at))
            own, mine = at[src], degrees[src]
            share, same = resolution * mine / (2 * total), near == own[row]
            gain = tie - share[row] * (loads[near] - np.where(same, mine[row], 0.0))
            best = np.maximum.reduceat(gain, np.flatnonzero(np.diff(row, prepend=-1)))
            top = np.flatnonzero(gain == best[row])
            to = near[top[np.unique(row[top], return_index=True)[1]]]  # of equal gains the least community
            kept = -share * (loads[own] - mine)
            kept[row[same]] = gain[same]
            better = best > kept + 1e-12
            yield pa.RecordBatch.from_arrays([pa.array(src[better], pa.int32()), pa.array(to[better], pa.int32())], names=["src", "to"])

    return choose


def _between(home):
    """For edges (src, dst, weight): the same between communities."""

    def merge(batches):
        at = home.value
        for batch in batches:
            a, b = at[batch.column(0).to_numpy()], at[batch.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), batch.column(2)], names=["src", "dst", "weight"])

    return merge


def _held(real: DataFrame, points: DataFrame, resolution: float, seed: int, finish: int) -> DataFrame:
    """communities() by Louvain's rounds with vertices numbered: edges are shuffled once a level, by vertex, and a round is a narrow
    pass over them that gives the driver the moves."""
    spark = real.sparkSession
    send = spark.sparkContext.broadcast
    numbers = _numbered(points, seed)
    size = points.count()
    a = spread_join(real, numbers.select(F.col("vertex").alias("src"), F.col("k").alias("a"), "n"), "src", "n")
    b = spread_join(a, numbers.select(F.col("vertex").alias("dst"), F.col("k").alias("b"), "n"), "dst", "n")
    summed = F.sum(F.col("weight").cast("double")).alias("weight")
    level = durable(b.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(summed), "level")
    ends = level.select("src", "weight").union(level.select("dst", "weight"))  # a loop counts twice
    degree = _array(ends.groupBy("src").agg(F.sum("weight").alias("w")), size, "float64")
    turns, total = send(_array(numbers.select("k", "turns"), size, "int16")), float(degree.sum()) / 2
    found, score = np.arange(size, dtype="int32"), None
    for k in range(LEVELS):
        if k and level.count() <= finish:
            rows = [(r.src, r.dst, r.weight) for r in level.collect()]
            home = np.arange(size, dtype="int32")
            for group in louvain(sorted({x for a, b, _ in rows for x in (a, b)}), rows, resolution):
                home[group] = group[0]
            found = home[found]
            break
        plain = level.where("src <> dst")
        both = plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        near = durable(both.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("near")), "near")
        home, load, quiet, any_moved = np.arange(size, dtype="int32"), degree, 0, False
        degrees = send(degree)
        for turn in range(ROUNDS):
            sent = send(home), send(load)
            moves = near.mapInArrow(_choices(*sent, degrees, turns, turn, total, resolution), "src int, to int").toArrow()
            for x in sent:
                x.destroy()
            home = home.copy()
            home[moves.column(0).to_numpy()] = moves.column(1).to_numpy()
            load = np.bincount(home, degree, size)
            any_moved, quiet = any_moved or moves.num_rows > 0, 0 if moves.num_rows else quiet + 1
            if quiet == 2:
                break
        degrees.destroy()
        if not any_moved:
            break
        at = send(home)
        merged = durable(level.mapInArrow(_between(at), "src int, dst int, weight double").groupBy("src", "dst").agg(summed), "merged")
        at.destroy()
        inside = merged.where("src = dst").agg(F.sum("weight")).first()[0] or 0.0
        now = inside / total - resolution * float(load @ load) / (4 * total * total)
        if score is not None and now <= score + LEAST:
            break
        found, level, degree, score = home[found], merged, load, now
    turns.destroy()
    _, least, group = np.unique(found, return_index=True, return_inverse=True)
    up = send(least[group].astype("int32"))
    sizes = send(np.bincount(up.value, minlength=size))

    def named(batches):
        for batch in batches:
            k = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(up.value[k]), pa.array(sizes.value[k])], names=["vertex", "k", "up", "size"])

    kind = dict(numbers.dtypes)["vertex"]
    out = durable(numbers.select("vertex", "k").mapInArrow(named, f"vertex {kind}, k int, up int, size bigint"), "named")
    names = out.where("k = up").select("up", F.col("vertex").alias("community"), "size")
    return spread_join(out.select("vertex", "up"), names, "up", "size").select("vertex", "community")

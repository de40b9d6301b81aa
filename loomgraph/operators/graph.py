"""Graph algorithms over edge tables (src, dst[, weight]).

Iterations are joins and aggregations; the state of each round is a table in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Rounds


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def simple_undirected(edges: DataFrame) -> DataFrame:
    """Each undirected edge once (src < dst), no loops."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def bfs(edges: DataFrame, sources: list) -> DataFrame:
    """(id, depth) from the nearest source; nodes that are not reached have no depth."""
    spark = edges.sparkSession
    rounds = Rounds(spark, "bfs", keep=1000)
    edges = rounds.save(edges.select("src", "dst").distinct())
    kind = edges.schema["src"].dataType
    frontier = rounds.save(nodes_of(edges).where(F.col("id").isin([*sources])).select(F.col("id").cast(kind), F.lit(0).cast("long").alias("depth")))
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        new = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = rounds.save(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        seen = seen.union(frontier)
        if depth % 8 == 0:
            seen = rounds.save(seen)
    return nodes_of(edges).join(seen, "id", "left")


def sssp(edges: DataFrame, sources: list, rounds_most: int = 10_000) -> DataFrame:
    """(id, distance): cheapest way from any source by relaxing what improved."""
    rounds = Rounds(edges.sparkSession, "sssp", keep=4)
    edges = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    best = rounds.save(nodes_of(edges).withColumn("distance", F.when(F.col("id").isin([*sources]), 0.0)))
    changed = best.where("distance is not null")
    for _ in range(rounds_most):
        offer = changed.join(edges, changed["id"] == edges["src"]).groupBy("dst").agg(F.min(F.col("distance") + F.col("weight")).alias("offer"))
        now = best.join(offer, best["id"] == offer["dst"], "left").select("id", F.least("distance", "offer").alias("distance"), F.coalesce(F.col("offer") < F.col("distance"), F.col("offer").isNotNull()).alias("new"))
        now = rounds.save(now, temporary=True)
        best, changed = now.select("id", "distance"), now.where("new").select("id", "distance")
        if changed.isEmpty():
            return best
    raise RuntimeError(f"distances still change after {rounds_most} rounds")


def wcc(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the weakly connected component, by large-star and small-star rounds."""
    rounds = Rounds(edges.sparkSession, "wcc", keep=3)
    nodes = nodes_of(edges)
    e = rounds.save(simple_undirected(edges).select(F.col("dst").alias("u"), F.col("src").alias("v")))
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u != v").distinct()
        e = rounds.save(small, temporary=True)
        state = tuple(e.agg(F.count("*"), F.countDistinct("u"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).collect()[0])
        if state == before and state[0] == state[1]:
            break
        before = state
    return nodes.join(e.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def scc(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components by forward-backward colouring.

    The least colour that reaches a node forwards is spread; what reaches the
    colour's own node backwards within the colour is its component.
    """
    rounds = Rounds(edges.sparkSession, "scc", keep=1000)
    rest = rounds.save(edges.select("src", "dst").where("src != dst").distinct())
    left = rounds.save(nodes_of(edges))
    parts = None
    while not left.isEmpty():
        color = left.select("id", F.col("id").alias("c"))
        while True:
            offer = color.join(rest, color["id"] == rest["src"]).groupBy("dst").agg(F.min("c").alias("o"))
            now = rounds.save(color.join(offer, color["id"] == offer["dst"], "left").select("id", F.least("c", "o").alias("c"), (F.coalesce(F.col("o") < F.col("c"), F.lit(False))).alias("new")))
            color = now.select("id", "c")
            if now.where("new").isEmpty():
                break
        found = rounds.save(color.where("id = c"))
        frontier = found
        inner = rest.join(color.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(color.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        inner = rounds.save(inner)
        while not frontier.isEmpty():
            step = inner.join(frontier.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            frontier = rounds.save(step.join(found, ["id", "c"], "left_anti"))
            found = rounds.save(found.union(frontier))
        part = found.groupBy("c").agg(F.min("id").alias("component")).join(found, "c").select("id", "component")
        parts = part if parts is None else parts.union(part)
        left = rounds.save(left.join(found, "id", "left_anti"))
        rest = rounds.save(rest.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return parts


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank): fixed iterations; dangling mass is dealt to all nodes."""
    rounds = Rounds(edges.sparkSession, "pagerank", keep=3)
    edges = edges.select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    nodes = rounds.save(nodes_of(edges).join(degree, nodes_id() == degree["src"], "left").select("id", "d"))
    links = rounds.save(edges.join(degree, "src"))
    n = nodes.count()
    ranks = nodes.select("id", "d", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        dangling = ranks.where("d is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).collect()[0][0]
        given = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("d")).alias("r"))
        ranks = nodes.join(given, nodes["id"] == given["dst"], "left").select("id", "d", (F.lit((1 - damping) / n) + damping * (F.coalesce("r", F.lit(0.0)) + F.lit(dangling / n))).alias("rank"))
        ranks = rounds.save(ranks, temporary=False)
    return ranks.select("id", "rank")


def nodes_id():
    return F.col("id")


def _oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges from the end of lower degree to the other, so that no node has many out-edges."""
    e = simple_undirected(edges)
    degree = both_ways(e).groupBy("src").agg(F.count("*").alias("d"))
    a = degree.select(F.col("src"), F.col("d").alias("ds"))
    b = degree.select(F.col("src").alias("dst"), F.col("d").alias("dd"))
    e = e.join(a, "src").join(b, "dst")
    lower = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return e.select(F.when(lower, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(lower, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def triangle_list(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle, once."""
    e = _oriented(edges)
    wedge = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").where("b < c")
    closing = e.select(F.least("src", "dst").alias("b"), F.greatest("src", "dst").alias("c"))
    return wedge.join(closing, ["b", "c"]).select("a", "b", "c")


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): each triangle is credited to its three nodes."""
    t = triangle_list(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return nodes_of(edges).join(t, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, coefficient): 2t / (d (d - 1)), 0 under two neighbours."""
    degree = both_ways(simple_undirected(edges)).groupBy("src").agg(F.count("*").alias("d"))
    t = triangles(edges)
    return t.join(degree, t["id"] == degree["src"], "left").select("id", F.when(F.col("d") >= 2, 2.0 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("coefficient"))


def kcore(edges: DataFrame) -> DataFrame:
    """(id, core): core numbers on the undirected simple graph, by peeling."""
    rounds = Rounds(edges.sparkSession, "kcore", keep=1000)
    e = rounds.save(both_ways(simple_undirected(edges)))
    out, k = nodes_of(edges).select("id", F.lit(0).cast("long").alias("core")), 0
    while not e.isEmpty():
        k += 1
        while True:
            low = e.groupBy("src").count().where(F.col("count") < k).select("src")
            if low.isEmpty():
                break
            e = rounds.save(e.join(low, "src", "left_anti").join(low.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
        alive = e.select(F.col("src").alias("id")).distinct()
        out = rounds.save(out.join(alive.withColumn("_in", F.lit(True)), "id", "left").select("id", F.when(F.col("_in"), F.lit(k).cast("long")).otherwise(F.col("core")).alias("core")))
    return out


def label_propagation(edges: DataFrame, max_iterations: int = 10, weighted: bool = False, directed: bool = True) -> DataFrame:
    """(id, label): synchronous rounds; the heaviest neighbour label, the smallest on ties; isolated nodes keep theirs."""
    rounds = Rounds(edges.sparkSession, "labels", keep=3)
    nodes = nodes_of(edges)
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = edges.where("src != dst").groupBy("src", "dst").agg(F.max(w).alias("w"))
    if directed:
        e = e.select("src", "dst", "w").union(e.select("dst", "src", "w"))
    e = rounds.save(e)
    labels = rounds.save(nodes.select("id", F.col("id").alias("label")))
    for _ in range(max_iterations):
        votes = e.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.max_by(F.struct("label"), F.struct("w", -F.col("label"))).alias("b")).select("src", F.col("b.label").alias("new"))
        now = labels.join(best, labels["id"] == best["src"], "left").select("id", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("moved"))
        now = rounds.save(now)
        labels = now.select("id", "label")
        if now.where("moved").isEmpty():
            break
    return labels


def node_similarity(edges: DataFrame, metric: str = "jaccard", top: int = 10, least: float = 0.0) -> DataFrame:
    """(id, other, similarity): shared out-neighbours by Jaccard or overlap, the best ``top`` of each node."""
    e = edges.select("src", "dst").distinct()
    degree = e.groupBy("src").agg(F.count("*").alias("d"))
    a = e.select(F.col("src").alias("id"), "dst")
    b = e.select(F.col("src").alias("other"), "dst")
    shared = a.join(b, "dst").where("id < other").groupBy("id", "other").agg(F.count("*").alias("c"))
    shared = shared.join(degree.select(F.col("src").alias("id"), F.col("d").alias("di")), "id").join(degree.select(F.col("src").alias("other"), F.col("d").alias("do")), "other")
    s = F.col("c") / (F.col("di") + F.col("do") - F.col("c")) if metric == "jaccard" else F.col("c") / F.least("di", "do")
    pairs = shared.select("id", "other", s.alias("similarity")).where(F.col("similarity") > least)
    both = pairs.union(pairs.select("other", "id", "similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return both.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree)."""
    rows = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return rows.groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def fast_rp(edges: DataFrame, dimension: int = 32, seed: int = 42, weights: tuple[float, ...] = (0.0, 1.0, 1.0)) -> DataFrame:
    """(id, embedding): seeded sparse random projections averaged over neighbours, one weight a hop."""
    rounds = Rounds(edges.sparkSession, "fastrp", keep=1000)
    e = rounds.save(both_ways(simple_undirected(edges)))

    def cell(i: int):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("id")), F.lit(6))
        return F.when(u == 0, F.lit(3.0**0.5)).when(u == 1, F.lit(-(3.0**0.5))).otherwise(0.0)

    now = rounds.save(nodes_of(edges).select("id", F.array(*[cell(i) for i in range(dimension)]).alias("v")))
    total = now.select("id", F.transform("v", lambda x: x * weights[0]).alias("t"))
    for w in weights[1:]:
        sums = e.join(now, e["dst"] == now["id"]).groupBy("src").agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dimension)])
        now = rounds.save(sums.select(F.col("src").alias("id"), F.array(*[f"m{i}" for i in range(dimension)]).alias("v")))
        total = rounds.save(total.join(now, "id", "left").select("id", F.zip_with("t", F.coalesce("v", F.array_repeat(F.lit(0.0), dimension)), lambda a, b: a + w * b).alias("t")))
    return total.select("id", F.col("t").alias("embedding"))


def modularity_communities(edges: DataFrame, max_iterations: int = 20, max_levels: int = 5) -> DataFrame:
    """(id, community): greedy modularity moves in synchronous rounds with halved parity, levels contracted like Louvain's."""
    rounds = Rounds(edges.sparkSession, "louvain", keep=1000)
    e = simple_undirected(edges).select("src", "dst", F.lit(1.0).alias("w"))
    e = rounds.save(e.union(e.select("dst", "src", "w")))
    member = rounds.save(nodes_of(edges).select("id", F.col("id").alias("c")))
    m2 = e.agg(F.sum("w")).collect()[0][0] or 1.0
    for _ in range(max_levels):
        degree = rounds.save(e.groupBy("src").agg(F.sum("w").alias("k")))
        com = rounds.save(degree.select(F.col("src").alias("id"), F.col("src").alias("c")))
        moved_any = False
        for r in range(max_iterations):
            totals = com.join(degree.withColumnRenamed("src", "id"), "id").groupBy("c").agg(F.sum("k").alias("tot"))
            links = e.where("src != dst").join(com.select(F.col("id").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.sum("w").alias("l"))
            own = com.select(F.col("id").alias("src"), F.col("c").alias("own")).join(degree, "src")
            gain = links.join(own, "src").join(totals, "c").select("src", "c", "own", (F.col("l") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / m2).alias("g"))
            best = gain.groupBy("src").agg(F.max_by("c", F.struct("g", -F.col("c"))).alias("to"), F.max("g").alias("g"), F.max(F.when(F.col("c") == F.col("own"), F.col("g"))).alias("stay"), F.first("own").alias("own"))
            go = (F.col("g") > F.coalesce("stay", F.lit(0.0)) + 1e-12) & (F.pmod(F.xxhash64("src", F.lit(r)), F.lit(2)) == 0)
            now = com.join(best, com["id"] == best["src"], "left").select("id", F.when(go, F.col("to")).otherwise(F.col("c")).alias("c"), F.coalesce(go, F.lit(False)).alias("moved"))
            now = rounds.save(now)
            com = now.select("id", "c")
            moved = now.where("moved").count()
            moved_any |= moved > 0
            if not moved and r % 2:
                break
        if not moved_any:
            break
        member = rounds.save(member.join(com.select(F.col("id").alias("c"), F.col("c").alias("n")), "c").select("id", F.col("n").alias("c")))
        e = rounds.save(e.join(com.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(com.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").groupBy("a", "b").agg(F.sum("w").alias("w")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"))
    return member.select("id", F.col("c").alias("community"))


def betweenness(edges: DataFrame, sources: list | None = None, node_cap: int = 2000) -> DataFrame:
    """(id, score): Brandes' algorithm, exact up to ``node_cap`` nodes; beyond it that many sources are drawn by a hash of the id and the scores scaled.

    One breadth-first wave runs for all sources together: its rows are (source,
    node), and path counts and dependencies are grouped sums.
    """
    rounds = Rounds(edges.sparkSession, "between", keep=1000)
    e = rounds.save(edges.select("src", "dst").where("src != dst").distinct())
    nodes = rounds.save(nodes_of(edges))
    if sources is None:
        n = nodes.count()
        start = nodes if n <= node_cap else rounds.save(nodes.orderBy(F.xxhash64("id"), "id").limit(node_cap))
        scale = max(1.0, n / node_cap)
    else:
        start, scale = nodes.where(F.col("id").isin(sources)), 1.0
    waves = [rounds.save(start.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")))]
    seen = waves[0].select("s", "id")
    while True:
        step = waves[-1].join(e, waves[-1]["id"] == e["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        new = rounds.save(step.join(seen, ["s", "id"], "left_anti"))
        if new.isEmpty():
            break
        waves.append(new)
        seen = rounds.save(seen.union(new.select("s", "id")))
    delta = waves[-1].select("s", "id", "sigma", F.lit(0.0).alias("delta"))
    total = delta.select("s", "id", "delta")
    for wave in reversed(waves[:-1]):
        later = delta.select("s", F.col("id").alias("dst"), F.col("sigma").alias("sw"), F.col("delta").alias("dw"))
        given = wave.join(e, wave["id"] == e["src"]).join(later, ["s", "dst"]).groupBy("s", "id").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("dw"))).alias("delta"))
        delta = rounds.save(wave.join(given, ["s", "id"], "left").select("s", "id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        total = total.union(delta.select("s", "id", "delta"))
    score = total.where("s != id").groupBy("id").agg(F.sum("delta").alias("score"))
    return nodes.join(score, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * scale).alias("score"))

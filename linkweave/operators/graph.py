"""Graph operators on edge tables: components, induced subgraphs, neighbourhoods, structure, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.plans.durable import Scratch

#: A vertex changes its community for a gain in linked weight of more than this.
LEAST_GAIN = 1e-9

#: Edges of the largest component whose communities one task finds.
LOCAL_EDGES = 20_000


def _mark(df: DataFrame) -> tuple:
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)"))
    return tuple(df.agg(F.count(F.lit(1)), h(1), h(2)).first())


def components(edges: DataFrame, group: str = "g", max_rounds: int = 64) -> DataFrame:
    """(group, vertex, component): components of the edges (group, a, b) of each group, named by their smallest vertex.

    Alternating large-star and small-star steps, all groups in one loop; each
    step is a minimum per vertex and a join, and leaves a table no larger than
    the edges.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.where("a <> b").select(F.col(group).alias("g"), F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.write(e, "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("g", "u").agg(F.min("v").alias("m")).select("g", "u", F.least("u", "m").alias("m"))
        large = both.join(low, ["g", "u"]).where("v > u").select("g", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, "large")
        least = large.groupBy("g", "u").agg(F.min("v").alias("m"))
        linked = large.join(least, ["g", "u"]).where("v <> m").select("g", F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.write(linked.unionByName(least.select("g", "u", F.col("m").alias("v"))).distinct(), "small")
        now = _mark(after)
        scratch.drop(large)
        scratch.drop(e)
        e = after
        if now == mark:
            break
        mark = now
    roots = e.select("g", F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return e.select("g", F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots).withColumnRenamed("g", group)


def at_floors(edges: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, a, b): the edges of at least each weight floor."""
    return edges.select(F.explode(F.array(*map(F.lit, floors))).alias("floor"), F.col("card_a").alias("a"), F.col("card_b").alias("b"), "weight").where("weight >= floor").drop("weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(card_id, degree, strength)."""
    ends = edges.select(F.explode(F.array("card_a", "card_b")).alias("card_id"), "weight")
    return ends.groupBy("card_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def vertices(txn: DataFrame, card_world: DataFrame, edges: DataFrame) -> DataFrame:
    """(card_id, world_id, n_transactions, degree) of every card with a transaction, linked or not; an unknown world is -1."""
    counts = txn.where("card_id IS NOT NULL").groupBy("card_id").agg(F.count(F.lit(1)).alias("n_transactions"))
    full = counts.join(card_world, "card_id", "left").join(degrees(edges).select("card_id", "degree"), "card_id", "left")
    return full.select("card_id", F.coalesce("world_id", F.lit(-1)).alias("world_id"), "n_transactions", F.coalesce("degree", F.lit(0)).alias("degree"))


def induced(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate_id, edge columns) of edges with both ends in the candidate; members is (candidate_id, card_id)."""
    a = members.select("candidate_id", F.col("card_id").alias("card_a"))
    b = members.select("candidate_id", F.col("card_id").alias("card_b"))
    return edges.join(a, "card_a").join(b, ["candidate_id", "card_b"])


def halo(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate_id, card_id): cards outside a candidate that are linked to one inside."""
    both = edges.select("card_a", "card_b").unionByName(edges.select(F.col("card_b").alias("card_a"), F.col("card_a").alias("card_b")))
    near = members.join(both, members.card_id == both.card_a).select("candidate_id", F.col("card_b").alias("card_id")).distinct()
    return near.join(members, ["candidate_id", "card_id"], "left_anti")


def clustering(members: DataFrame, inner: DataFrame) -> DataFrame:
    """(candidate_id, coefficient): mean over all members of closed neighbour pairs / neighbour pairs, 0 below two neighbours or three members."""
    e = inner.select("candidate_id", "card_a", "card_b")
    both = e.select("candidate_id", F.explode(F.array(F.struct(F.col("card_a").alias("u"), F.col("card_b").alias("v")), F.struct(F.col("card_b").alias("u"), F.col("card_a").alias("v")))).alias("e")).select("candidate_id", "e.*")
    deg = both.groupBy("candidate_id", "u").agg(F.count(F.lit(1)).alias("d"))
    # a triangle a < b < c is found once, from its sorted edges
    ab, bc, ac = (e.select("candidate_id", F.col("card_a").alias(x), F.col("card_b").alias(y)) for x, y in (("a", "b"), ("b", "c"), ("a", "c")))
    tri = ab.join(bc, ["candidate_id", "b"]).join(ac, ["candidate_id", "a", "c"])
    closed = tri.select("candidate_id", F.explode(F.array("a", "b", "c")).alias("u")).groupBy("candidate_id", "u").agg(F.count(F.lit(1)).alias("t"))
    local = deg.join(closed, ["candidate_id", "u"], "left").select("candidate_id", F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("c"))
    sizes = members.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    total = local.groupBy("candidate_id").agg(F.sum("c").alias("c"))
    return sizes.join(total, "candidate_id", "left").select("candidate_id", F.when(F.col("n") >= 3, F.coalesce("c", F.lit(0.0)) / F.col("n")).otherwise(0.0).alias("coefficient"))


def hop_shape(members: DataFrame, inner: DataFrame, most: int = 50) -> DataFrame:
    """(candidate_id, n_components, diameter): components of the induced subgraph, isolated members counted; its hop diameter, -1 if it has more than `most` members, no edge or several components.

    A candidate's own subgraph is bounded; a task takes many candidates at once.
    Breadth-first search over adjacency bit masks.
    """

    def shape(pdf):
        import pandas as pd

        rows = []
        for candidate, part in pdf.groupby("candidate_id", sort=False):
            names = sorted(set(part["u"]))
            at = {c: i for i, c in enumerate(names)}
            near = [0] * len(names)
            linked = False
            for u, v in zip(part["u"].tolist(), part["v"].tolist()):
                if v is not None and v == v:
                    linked = True
                    near[at[u]] |= 1 << at[v]
                    near[at[v]] |= 1 << at[u]
            rows.append((candidate, *_hops(near, linked, most)))
        return pd.DataFrame(rows, columns=["candidate_id", "n_components", "diameter"])

    shares = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("candidate_id", F.col("card_id").alias("u"), F.lit(None).cast("string").alias("v")).unionByName(inner.select("candidate_id", F.col("card_a").alias("u"), F.col("card_b").alias("v")))
    return rows.groupBy(F.pmod(F.xxhash64("candidate_id"), F.lit(shares)).alias("share")).applyInPandas(shape, "candidate_id string, n_components bigint, diameter bigint")


def _hops(near: list[int], linked: bool, most: int) -> tuple[int, int]:
    """(components, diameter) of a graph given as bit masks of neighbours."""
    left, parts, longest = (1 << len(near)) - 1, 0, 0

    def reach(start):
        seen = front = 1 << start
        hops = 0
        while front:
            grown = 0
            while front:
                low = front & -front
                grown |= near[low.bit_length() - 1]
                front ^= low
            front = grown & ~seen
            seen |= front
            hops += bool(front)
        return seen, hops

    while left:
        seen, _ = reach((left & -left).bit_length() - 1)
        left &= ~seen
        parts += 1
    whole = linked and parts == 1 and len(near) <= most
    if whole:
        longest = max(reach(i)[1] for i in range(len(near)))
    return parts, longest if whole else -1


def structure(members: DataFrame, edges: DataFrame, n_vertices: int, n_edges: int) -> DataFrame:
    """Per candidate: size, density, average degree, clustering, components, expansion, cut ratio, modularity contribution (unweighted), diameter."""
    inner = Scratch(members.sparkSession).write(induced(members, edges).select("candidate_id", "card_a", "card_b"), "inner")
    sizes = members.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    inside = inner.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("m"))
    outer = members.join(degrees(edges), "card_id").groupBy("candidate_id").agg(F.sum("degree").alias("d"))
    base = sizes.join(inside, "candidate_id", "left").join(outer, "candidate_id", "left").fillna(0, ["m", "d"])
    n, m, d = F.col("n"), F.col("m"), F.col("d")
    big = float(max(n_edges, 1))
    plain = base.select(
        "candidate_id", n.alias("cand_size"),
        F.when(n > 1, m / (n * (n - 1) / 2)).otherwise(0.0).alias("cand_density"),
        (2 * m / n).alias("cand_avg_degree"),
        ((d - 2 * m) / n).alias("cand_expansion"),
        ((d - 2 * m) / (n * F.greatest(F.lit(n_vertices) - n, F.lit(1)))).alias("cand_cut_ratio"),
        (m / F.lit(big) - F.pow(d / F.lit(2 * big), F.lit(2)) if n_edges else F.lit(0.0)).alias("cand_modularity_contribution"),
    )
    shape = hop_shape(members, inner).select("candidate_id", F.col("n_components").alias("cand_num_components"), F.col("diameter").alias("cand_diameter"))
    return plain.join(clustering(members, inner).withColumnRenamed("coefficient", "cand_clustering_coeff"), "candidate_id").join(shape, "candidate_id")


def communities(edges: DataFrame, resolutions: list[float], parts: DataFrame | None = None, largest: int = LOCAL_EDGES) -> DataFrame:
    """(resolution, vertex, community): modularity communities of the weighted edges (a, b, weight) at each resolution.

    No community reaches over a component, so components of at most `largest`
    edges are each worked through by one task, vertex by vertex in order of name,
    level by level, until nothing gains; a component with more is spread over
    all tasks (spread_communities). Both weigh gains against the whole graph.
    parts is (vertex, component) where it is known already.
    """
    scratch = Scratch(edges.sparkSession)
    if parts is None:
        parts = components(edges.select(F.lit(0).alias("g"), "a", "b"))
    marked = scratch.write(edges.select("a", "b", "weight").join(parts.select(F.col("vertex").alias("a"), "component"), "a"), "marked")
    sizes = marked.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    total = sizes.agg(F.sum("w").alias("w"), F.max("n").alias("n"), F.sum("n").alias("all")).first()
    whole = 2.0 * (total["w"] or 0.5)
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"resolution double, vertex {kind}, community {kind}"
    small = marked.join(sizes.where(F.col("n") <= largest).select("component"), "component", "left_semi")
    # components side by side don't touch each other, so a task takes many at once
    shares = max(edges.sparkSession.sparkContext.defaultParallelism, 2 * (total["all"] or 0) // max(largest, 1) + 1)
    found = small.groupBy(F.pmod(F.xxhash64("component"), F.lit(shares)).alias("share")).applyInPandas(lambda pdf: _moved(pdf, resolutions, whole), schema)
    if (total["n"] or 0) > largest:
        rest = marked.join(sizes.where(F.col("n") > largest).select("component"), "component", "left_semi")
        found = found.unionByName(spread_communities(rest.select("a", "b", "weight"), resolutions, whole))
    return scratch.write(found, "communities")


def _moved(pdf, resolutions: list[float], whole: float):
    """Communities of whole components by sequential moving; a community is named by its smallest vertex, and of equal gains the first by name is taken."""
    import pandas as pd

    names = sorted(set(pdf["a"]) | set(pdf["b"]))
    place = {v: i for i, v in enumerate(names)}
    base: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in zip(pdf["a"].map(place).tolist(), pdf["b"].map(place).tolist(), pdf["weight"].tolist()):
        base[a][b] = base[a].get(b, 0.0) + w
        base[b][a] = base[b].get(a, 0.0) + w
    rows = []
    for r in resolutions:
        arcs, member, moved = base, list(range(len(names))), True
        while moved:
            moved, still = False, True
            degree = [sum(x.values()) for x in arcs]
            home, weight = list(range(len(arcs))), degree[:]
            while still:
                still = False
                for v, near in enumerate(arcs):
                    linked: dict[int, float] = {}
                    for u, w in near.items():
                        if u != v:
                            linked[home[u]] = linked.get(home[u], 0.0) + w
                    now = best = home[v]
                    weight[now] -= degree[v]
                    gain = linked.get(now, 0.0) - r * degree[v] * weight[now] / whole
                    for c in sorted(linked):
                        other = linked[c] - r * degree[v] * weight[c] / whole
                        if other > gain + LEAST_GAIN:
                            best, gain = c, other
                    weight[best] += degree[v]
                    if best != now:
                        home[v], moved, still = best, True, True
            order = {c: i for i, c in enumerate(sorted(set(home)))}
            member = [order[home[m]] for m in member]
            merged: list[dict[int, float]] = [{} for _ in order]
            for v, near in enumerate(arcs):
                into = merged[order[home[v]]]
                for u, w in near.items():
                    c = order[home[u]]
                    into[c] = into.get(c, 0.0) + w
            arcs = merged
        first: dict[int, str] = {}
        for v, m in zip(names, member):
            first.setdefault(m, v)
        rows += [(float(r), v, first[m]) for v, m in zip(names, member)]
    return pd.DataFrame(rows, columns=["resolution", "vertex", "community"])


def spread_communities(edges: DataFrame, resolutions: list[float], whole: float, max_levels: int = 64, max_rounds: int = 512) -> DataFrame:
    """communities() of edges of any number, `whole` being twice the weight of the whole graph.

    Local moving by joins, all resolutions in one loop: in a round every vertex
    looks at its neighbours' communities for the largest gain over its own.
    Those of one hash half move; moving half of the vertices at a time keeps
    neighbours from swapping. Once the number of vertices that would gain no
    longer falls by a fifth a round, only moves that share no community with a
    larger one are made: their gains add up, so modularity rises with each round
    and the loop ends. A level ends when no vertex would gain more than LEAST_GAIN; then
    communities become vertices of the next level, until a level moves nothing.
    At either bound this raises. Equal gains go to the smaller name, so results
    are repeatable. No task ever holds a component.
    """
    scratch = Scratch(edges.sparkSession)
    base = edges.select(F.explode(F.array(*map(F.lit, resolutions))).alias("r"), "a", "b", "weight")
    # both directions; a loop of an aggregated vertex counts twice its weight in its degree
    arcs = scratch.write(base.unionByName(base.select("r", F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "arcs")
    member = None
    for level in range(max_levels):
        # (r, v, c, k): each vertex's community and degree
        state = arcs.groupBy("r", F.col("a").alias("v")).agg(F.sum("weight").alias("k")).select("r", "v", F.col("v").alias("c"), "k")
        state = wish = scratch.write(state, "label")
        least, apart, moved = None, False, False
        for no in range(max_rounds):
            last, wish = wish, scratch.write(_wishes(arcs, state, whole), "wish")
            scratch.drop(last)
            n = wish.where("more IS NOT NULL").count()
            if not n:
                break
            apart = apart or (least is not None and n > 0.8 * least)
            least, moved = n, True
            if apart:
                go = _apart(wish.where("more IS NOT NULL")).select("r", "v", "to")
                state = wish.drop("to").join(go, ["r", "v"], "left").select("r", "v", F.coalesce("to", "c").alias("c"), "k")
            else:
                half = F.col("more").isNotNull() & (F.pmod(F.xxhash64(F.lit(level * max_rounds + no), "v"), F.lit(2)) == 0)
                state = wish.select("r", "v", F.when(half, F.col("to")).otherwise(F.col("c")).alias("c"), "k")
        else:
            raise RuntimeError(f"communities still move after {max_rounds} rounds")
        label = wish.select("r", "v", "c")
        if member is None:
            member = label.select("r", F.col("v").alias("vertex"), F.col("c").alias("community"))
        elif moved:
            up = label.select("r", F.col("v").alias("community"), F.col("c").alias("next"))
            member = scratch.write(member.join(up, ["r", "community"]).select("r", "vertex", F.col("next").alias("community")), "member")
        if not moved:
            return member.withColumnRenamed("r", "resolution")
        x = label.select("r", F.col("v").alias("a"), F.col("c").alias("ca"))
        y = label.select("r", F.col("v").alias("b"), F.col("c").alias("cb"))
        merged = scratch.write(arcs.join(x, ["r", "a"]).join(y, ["r", "b"]).groupBy("r", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")), "arcs")
        scratch.drop(arcs)
        arcs = merged
    raise RuntimeError(f"communities still merge after {max_levels} levels")


def _wishes(arcs: DataFrame, state: DataFrame, whole: float) -> DataFrame:
    """(r, v, c, k, to, more): each vertex of the state, and where it gains by leaving its community c, the community it would go to and by how much; else nulls."""
    total = state.groupBy("r", "c").agg(F.sum("k").alias("total"))
    full = state.join(total, ["r", "c"])
    near = arcs.where("a <> b").join(full.select("r", F.col("v").alias("b"), "c", "total"), ["r", "b"]).select("r", F.col("a").alias("v"), "c", "total", "weight")
    own = full.select("r", "v", "c", "total", F.lit(0.0).alias("weight"), F.col("c").alias("now"), "k")
    # one exchange by vertex serves the sums per community, the vertex's own values and its choice
    every = near.withColumn("now", F.lit(None).cast(state.schema["c"].dataType)).withColumn("k", F.lit(None).cast("double")).unionByName(own).repartition("r", "v")
    options = every.groupBy("r", "v", "c").agg(F.sum("weight").alias("to"), F.max("total").alias("total"), F.max("now").alias("now"), F.max("k").alias("k"))
    mine = Window.partitionBy("r", "v")
    options = options.withColumn("now", F.max("now").over(mine)).withColumn("k", F.max("k").over(mine))
    inside = F.when(F.col("c") == F.col("now"), F.col("total") - F.col("k")).otherwise(F.col("total"))
    gain = F.round(F.col("to") - F.col("r") * F.col("k") * inside / whole, 12)
    best = options.withColumn("gain", gain).groupBy("r", "v").agg(F.max("now").alias("now"), F.max("k").alias("k"), F.min(F.struct((-F.col("gain")).alias("loss"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("now"), F.col("gain"))).alias("own"))
    more = -F.col("best.loss") - F.col("own")
    leaves = (F.col("best.c") != F.col("now")) & (more > LEAST_GAIN)
    return best.select("r", "v", F.col("now").alias("c"), "k", F.when(leaves, F.col("best.c")).alias("to"), F.when(leaves, more).alias("more"))


def _apart(wish: DataFrame) -> DataFrame:
    """(r, v, to) of the moves that are the largest, of equal ones the first by name, in both communities they touch."""
    ends = wish.select("r", F.explode(F.array("c", "to")).alias("at"), F.struct((-F.col("more")).alias("less"), "v").alias("rank"))
    first = ends.groupBy("r", "at").agg(F.min("rank")["v"].alias("v"))
    return wish.join(first.groupBy("r", "v").agg(F.count(F.lit(1)).alias("n")), ["r", "v"]).where("n = 2").select("r", "v", "to")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(resolution, modularity) of labels (resolution, vertex, community) over edges (a, b, weight), at each row's own resolution."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    arcs = both.join(labels.select("resolution", F.col("vertex").alias("a"), F.col("community").alias("ca")), "a").join(labels.select("resolution", F.col("vertex").alias("b"), F.col("community").alias("cb")), ["resolution", "b"])
    per = arcs.groupBy("resolution", "ca").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inner"))
    w = F.lit(float(both.agg(F.sum("weight").alias("w")).first()["w"] or 1.0))
    return per.groupBy("resolution").agg(F.sum(F.col("inner") / w - F.col("resolution") * F.pow(F.col("k") / w, F.lit(2))).alias("modularity"))

"""Graph edges and kernels. Edges are rows (src, dst), undirected unless said otherwise."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written

#: Centrality and paths hold the whole graph in each task; they take at most this many edges, which is checked first.
MAX_EDGES = 2_000_000
#: Partitions of edges that are thinned together.
FAN_IN = 8


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))


def degree(edges: DataFrame) -> DataFrame:
    """Edge records at each vertex; parallel ones count, a loop counts twice."""
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct neighbours, sorted, without the vertex itself."""
    return both_ways(edges).where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): every vertex with the least vertex it reaches, by least-neighbour steps and pointer jumps.

    A jump follows the label's own label, so the number of rounds grows with the logarithm of the diameter.
    """
    links = cut_lineage(both_ways(edges).where("src <> dst").distinct())
    label = both_ways(edges).select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    for _ in range(rounds):
        near = links.join(label, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("_m"))
        step = label.join(near, F.col("id") == F.col("src"), "left").select("id", F.least("component", F.coalesce("_m", "component")).alias("_c"), F.col("component").alias("_old"))
        jump = step.select(F.col("id").alias("_c"), F.col("_c").alias("_j"))
        new = cut_lineage(step.join(jump, "_c", "left").select("id", F.least("_c", F.coalesce("_j", "_c")).alias("component"), "_old"))
        changed = new.where("component <> _old").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def _adjacency(pairs) -> dict:
    out: dict = defaultdict(set)
    for a, b in pairs:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return {k: sorted(v) for k, v in sorted(out.items())}


def _brandes(adjacency: dict, source, leaves: dict) -> tuple[dict, dict]:
    """(dependency of every vertex on the source's shortest paths, distances); a vertex counts for itself and its leaves."""
    distance, paths, before, order = {source: 0}, defaultdict(float, {source: 1.0}), defaultdict(list), []
    queue = deque([source])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in adjacency[v]:
            if w not in distance:
                distance[w] = distance[v] + 1
                queue.append(w)
            if distance[w] == distance[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    share: dict = defaultdict(float)
    for w in reversed(order):
        for v in before[w]:
            share[v] += paths[v] / paths[w] * (1 + leaves.get(w, 0) + share[w])
    share.pop(source, None)
    return share, distance


def centrality(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, betweenness, closeness), to 6 decimals.

    Betweenness is scaled by 2 / ((n - 1)(n - 2)). Closeness of a vertex whose component has s others is
    s / (n - 1) * s / (sum of distances), spread over 0 to 1 by its least and greatest; all 0 if they hardly differ.
    Leaves (of one neighbour, which has others) are counted at their neighbour: its paths are theirs, one step longer. The
    other vertices are dealt over the tasks as sources, each of which holds the edges between them, whose number is checked.
    """
    plain = cut_lineage(both_ways(edges).where("src < dst").distinct())
    ends_ = both_ways(plain)
    nodes = cut_lineage(both_ways(edges).select(F.col("src").alias("id")).distinct())
    one = ends_.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("at")).where("n = 1").select("id", "at")
    pair = one.select(F.col("id").alias("at"), F.col("at").alias("id"))  # two that have only each other are no leaves
    leaf = cut_lineage(one.join(pair, ["id", "at"], "left_anti"))
    gone = lambda c: leaf.select(F.col("id").alias(c))
    core = plain.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst")
    core = cut_lineage(core)
    if core.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges beside leaves; split the graph by component")
    at = cut_lineage(leaf.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("leaves")))
    inner = nodes.join(gone("id"), "id", "left_anti")
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(([tuple(r) for r in core.toLocalIterator()], {r[0]: r[1] for r in at.toLocalIterator()}))

    def run(frames):
        pairs, leaves = shared.value
        adjacency = _adjacency(pairs)
        total: dict = defaultdict(float)
        for frame in frames:
            rows = []
            for source in frame["id"]:
                share, distance = _brandes(adjacency, source, leaves) if source in adjacency else ({}, {source: 0})
                own = leaves.get(source, 0)
                for v, x in share.items():
                    total[v] += x * (1 + own)
                size = sum(1 + leaves.get(v, 0) for v in distance)
                far = sum(d * (1 + leaves.get(v, 0)) + leaves.get(v, 0) for v, d in distance.items())
                between = float(own * (2 * (size - 1 - own) + own - 1))  # paths from and to its own leaves
                rows.append((source, between, size - 1, far))
            yield pd.DataFrame(rows, columns=["id", "between", "others", "far"])
        yield pd.DataFrame([(v, x, 0, 0) for v, x in total.items()], columns=["id", "between", "others", "far"])

    kind = nodes.schema["id"].dataType.simpleString()
    parts = inner.repartition(max(8, spark.sparkContext.defaultParallelism), "id").mapInPandas(run, f"id {kind}, between double, others long, far long")
    sums = cut_lineage(parts.groupBy("id").agg(F.sum("between").alias("b"), F.sum("others").alias("s"), F.sum("far").alias("d")))
    of_leaves = leaf.join(sums.withColumnRenamed("id", "at"), "at").select("id", F.lit(0.0).alias("b"), "s", (F.col("d") + F.col("s") - 1).alias("d"))
    sums = sums.unionByName(of_leaves)
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0  # each pair was met from both ends
    raw = sums.withColumn("c", F.when(F.col("d") > 0, F.col("s") / max(n - 1, 1) * F.col("s") / F.col("d")).otherwise(0.0))
    ends = raw.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    close = F.when(F.col("hi") - F.col("lo") < 0.0001, F.lit(0.0)).otherwise((F.col("c") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)))
    return raw.join(F.broadcast(ends)).select("id", F.bround(F.col("b") * scale, 6).alias("betweenness"), F.bround(close, 6).alias("closeness"))


def _bridges(pairs: list) -> tuple[list, set]:
    """Bridges and cut vertices by one depth-first walk without recursion; parallel edges are never bridges."""
    count: dict = defaultdict(int)
    for a, b in pairs:
        if a != b:
            count[min(a, b), max(a, b)] += 1
    adjacency = _adjacency(count)
    seen, low, found, cuts = {}, {}, [], set()
    for root in adjacency:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, children = [(root, None, iter(adjacency[root]))], 0
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > seen[parent] and count[min(v, parent), max(v, parent)] == 1:
                        found.append((min(v, parent), max(v, parent)))
                    if parent != root and low[v] >= seen[parent]:
                        cuts.add(parent)
                continue
            if w not in seen:
                seen[w] = low[w] = len(seen)
                children += v == root
                stack.append((w, v, iter(adjacency[w])))
            elif w != parent:
                low[v] = min(low[v], seen[w])
        if children > 1:
            cuts.add(root)
    return found, cuts


def _forest(pairs: list, breadth_first: bool) -> tuple[list, list]:
    """(edges of a spanning forest, the others) of a multigraph."""
    if not breadth_first:
        root: dict = {}

        def top(v):
            while (up := root.setdefault(v, v)) != v:
                root[v] = v = root[up] if up in root else up
            return v

        kept, rest = [], []
        for a, b in pairs:
            x, y = top(a), top(b)
            (kept if x != y else rest).append((a, b))
            root[x] = y
        return kept, rest
    near: dict = defaultdict(list)
    for i, (a, b) in enumerate(pairs):
        near[a].append((b, i))
        near[b].append((a, i))
    seen, used = set(), bytearray(len(pairs))
    for start in near:
        if start in seen:
            continue
        seen.add(start)
        queue = deque([start])
        while queue:
            for w, i in near[queue.popleft()]:
                if w not in seen:
                    seen.add(w)
                    used[i] = 1
                    queue.append(w)
    return [p for i, p in enumerate(pairs) if used[i]], [p for i, p in enumerate(pairs) if not used[i]]


def _thinned(pairs: list, for_vertices: bool) -> list:
    """At most twice as many edges as vertices, with the same bridges, or the same cut vertices, whatever edges are added
    later (a sparse certificate): a forest and a forest of the rest. For cut vertices both are breadth-first and parallel
    edges are one; for bridges any forests do, and a parallel edge is an edge."""
    plain = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]}) if for_vertices else [p for p in pairs if p[0] != p[1]]
    pairs.clear()
    first, rest = _forest(plain, for_vertices)
    del plain
    return first + _forest(rest, for_vertices)[0]


def _certificate(edges: DataFrame, for_vertices: bool) -> DataFrame:
    """(src, dst) in one partition, thinned: partitions are thinned by themselves, then a few together, until one is left.

    So no task holds more than FAN_IN times two edges a vertex.
    """
    kind = edges.schema["src"].dataType.simpleString()

    def run(frames):
        pairs = [p for f in frames for p in zip(f["src"].tolist(), f["dst"].tolist(), strict=True)]
        yield pd.DataFrame(_thinned(pairs, for_vertices), columns=["src", "dst"])

    parts = edges.rdd.getNumPartitions()
    out = edges.select("src", "dst").mapInPandas(run, f"src {kind}, dst {kind}")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        out = out.coalesce(parts) if parts == 1 else out.repartition(parts)
        out = cut_lineage(out.mapInPandas(run, f"src {kind}, dst {kind}"))
    return out.coalesce(1)


def bridges(edges: DataFrame) -> DataFrame:
    """(src, dst), src < dst, of the edges whose loss parts a component; parallel edges and loops are none."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(frames):
        pairs = [p for f in frames for p in zip(f["src"].tolist(), f["dst"].tolist(), strict=True)]
        yield pd.DataFrame(_bridges(pairs)[0], columns=["src", "dst"])

    return _certificate(edges, False).mapInPandas(run, f"src {kind}, dst {kind}")


#: Leaves are taken off while they are more than this share of the vertices.
PEEL = 0.2


def articulation(edges: DataFrame) -> DataFrame:
    """(id) of the vertices whose loss parts a component.

    What has a leaf and another neighbour is one; without its leaves a graph has the same others. So leaves are taken off
    in rounds while there are many, and only the rest goes through the certificate.
    """
    kind = edges.schema["src"].dataType.simpleString()

    def run(frames):
        pairs = [p for f in frames for p in zip(f["src"].tolist(), f["dst"].tolist(), strict=True)]
        yield pd.DataFrame({"id": sorted(_bridges(pairs)[1])})

    left, found = edges.select("src", "dst").where("src <> dst"), None
    while True:
        near = written(both_ways(left).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("lo"), F.max("dst").alias("hi")), "ends")
        one = near.where("lo = hi").select("id", F.col("lo").alias("at"))
        if one.count() <= PEEL * near.count():
            break
        cut = near.where("lo <> hi").join(one.select(F.col("at").alias("id")).distinct(), "id", "left_semi").select("id")
        found = cut if found is None else found.unionByName(cut)
        for end in ("src", "dst"):
            left = left.join(one.select(F.col("id").alias(end)), end, "left_anti")
        left = written(left.select("src", "dst"), "inner")
    rest = _certificate(left, True).mapInPandas(run, f"id {kind}")
    return rest if found is None else found.unionByName(rest).distinct()


def _by_component(edges: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the edges of one component at a time: a component is a unit of work, which these kernels need whole.

    A component of more than MAX_EDGES edges is refused rather than taken into one task.
    """
    label = components(edges)
    rows = edges.join(label, F.col("src") == F.col("id")).select("component", "src", "dst")
    most = rows.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MAX_EDGES:
        raise ValueError(f"a component of {most} edges; at most {MAX_EDGES} fit a task")
    return rows.groupBy("component").applyInPandas(run, schema)


def _moved(weights: dict, sweeps: int) -> dict:
    """One level of local moves over weighted neighbours {v: {w: weight}}, loops at v itself, in a fixed order."""
    degree = {v: sum(near.values()) + near.get(v, 0.0) for v, near in weights.items()}  # a loop has two ends
    total = sum(degree.values()) or 1.0
    label = {v: v for v in weights}
    volume = dict(degree)
    for _ in range(sweeps):
        moved = False
        for v, near in weights.items():
            own, k = label[v], degree[v]
            volume[own] -= k
            links: dict = defaultdict(float)
            for w, x in near.items():
                if w != v:
                    links[label[w]] += x
            gain = lambda c: links[c] - k * volume[c] / total  # noqa: B023, E731
            best = min({*links, own}, key=lambda c: (-gain(c), c))  # noqa: B023
            best = own if gain(best) <= gain(own) + 1e-12 else best
            volume[best] += k
            moved |= best != own
            label[v] = best
        if not moved:
            break
    return label


def _louvain(pairs: list, sweeps: int = 50) -> dict:
    """Multilevel modularity: local moves, then communities become vertices, until nothing moves."""
    weights: dict = {v: dict.fromkeys(near, 1.0) for v, near in _adjacency(pairs).items()}
    member = {v: v for v in weights}
    while True:
        label = _moved(weights, sweeps)
        if all(v == c for v, c in label.items()):
            break
        member = {v: label[c] for v, c in member.items()}
        merged: dict = defaultdict(lambda: defaultdict(float))
        for v, near in weights.items():
            for w, x in near.items():
                merged[label[v]][label[w]] += x if v != w and label[v] != label[w] else x / 2 if v != w else x
        weights = {v: dict(sorted(near.items())) for v, near in sorted(merged.items())}
    return member


def _edge_betweenness(adjacency: dict) -> dict:
    """Per edge (a < b) how many shortest paths run over it, shared among equals."""
    out: dict = defaultdict(float)
    for source in adjacency:
        distance, paths, before, order = {source: 0}, defaultdict(float, {source: 1.0}), defaultdict(list), []
        queue = deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adjacency[v]:
                if w not in distance:
                    distance[w] = distance[v] + 1
                    queue.append(w)
                if distance[w] == distance[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share: dict = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                flow = paths[v] / paths[w] * (1 + share[w])
                share[v] += flow
                out[min(v, w), max(v, w)] += flow
    return out


def _parts(adjacency: dict) -> dict:
    """Each vertex with the least vertex it reaches."""
    name: dict = {}
    for start in sorted(adjacency):
        if start not in name:
            name[start] = start
            queue = deque([start])
            while queue:
                for w in adjacency[queue.popleft()]:
                    if w not in name:
                        name[w] = start
                        queue.append(w)
    return name


def _split_by_betweenness(pairs: list, n: int) -> dict:
    """Parts after the edges of most shortest paths went one by one (ties: the least edge), until there are ``n``."""
    adjacency = {v: set(near) for v, near in _adjacency(pairs).items()}
    name = _parts(adjacency)
    while len(set(name.values())) < n:
        flow = _edge_betweenness({v: sorted(near) for v, near in adjacency.items()})
        if not flow:
            break
        a, b = min(flow, key=lambda e: (-round(flow[e], 9), e))
        adjacency[a].discard(b)
        adjacency[b].discard(a)
        name = _parts(adjacency)
    return name


def _fiedler(pairs: list, dense: int = 1500, steps: int = 5000) -> dict:
    """Two sides by the sign of the Laplacian's second eigenvector, each named by its least member; zeros go with the first
    vertex. Larger graphs take the vector by power iteration."""
    adjacency = _adjacency(pairs)
    nodes = list(adjacency)
    n = len(nodes)
    if n < 2:
        return {v: v for v in nodes}
    place = {v: i for i, v in enumerate(nodes)}
    rows = np.repeat(np.arange(n), [len(adjacency[v]) for v in nodes])
    cols = np.array([place[w] for v in nodes for w in adjacency[v]])
    degree = np.bincount(rows, minlength=n).astype(float)
    if n <= dense:
        laplacian = np.diag(degree)
        laplacian[rows, cols] -= 1
        vector = np.linalg.eigh(laplacian)[1][:, 1]
    else:
        shift = 2 * degree.max()
        vector = np.random.default_rng(0).normal(size=n)
        for _ in range(steps):
            vector -= vector.mean()
            new = shift * vector - degree * vector + np.bincount(rows, vector[cols], n)
            new /= np.linalg.norm(new)
            done = np.abs(new - vector).max() < 1e-10
            vector = new
            if done:
                break
    vector = np.where(np.abs(vector) < 1e-9, 0.0, vector)
    side = vector * (1 if vector[np.flatnonzero(vector)[0]] > 0 else -1) >= 0
    least = {s: min(v for v, x in zip(nodes, side, strict=True) if x == s) for s in set(side.tolist())}
    return {v: least[bool(s)] for v, s in zip(nodes, side, strict=True)}


def communities(edges: DataFrame, method: str = "louvain", parts: int = 2) -> DataFrame:
    """(id, community) by ``louvain``, ``edge_betweenness`` (``parts`` a component) or ``fiedler`` (two a component).

    A community is named by its least member; the same on every run.
    """
    kind = edges.schema["src"].dataType.simpleString()
    split = {"louvain": _louvain, "edge_betweenness": lambda p: _split_by_betweenness(p, parts), "fiedler": _fiedler}[method]

    def run(pdf):
        label = split(list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True)))
        least: dict = {}
        for v in sorted(label):
            least.setdefault(label[v], v)
        return pd.DataFrame(sorted((v, least[c]) for v, c in label.items()), columns=["id", "community"])

    return _by_component(edges, run, f"id {kind}, community {kind}")


def hops(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, id, hops): least number of edges from each source, up to a depth if one is given."""
    links = cut_lineage(both_ways(edges).where("src <> dst").distinct())
    seen = front = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops"))
    d = 0
    while depth is None or d < depth:
        d += 1
        step = front.join(links, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id")).distinct()
        front = cut_lineage(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("hops", F.lit(d)))
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    return seen


def path_edges(edges: DataFrame, pairs: DataFrame, max_paths: int | None = None, max_edges: int = MAX_EDGES) -> DataFrame:
    """Distinct edges (src < dst) on a shortest path of each pair (source, target), with the least of the pairs whose path
    takes them (path_from, path_to) and that path's length. ``max_paths`` keeps the first pairs that have a path, by id.

    Of equal paths the one over the least vertices counts.
    """
    plain = both_ways(edges).where("src < dst").distinct()
    if plain.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges; use hops")
    shared = edges.sparkSession.sparkContext.broadcast([tuple(r) for r in plain.toLocalIterator()])
    kind = edges.schema["src"].dataType.simpleString()

    def run(frames):
        adjacency = _adjacency(shared.value)
        for frame in frames:
            rows = []
            for s, t in zip(frame["source"], frame["target"], strict=True):
                came, queue = {s: None}, deque([s])
                while queue and t not in came:
                    v = queue.popleft()
                    for w in adjacency.get(v, ()):
                        if w not in came:
                            came[w] = v
                            queue.append(w)
                path, v = [], t if t in came else None
                while v is not None and came[v] is not None:
                    path.append((min(v, came[v]), max(v, came[v])))
                    v = came[v]
                rows += [(a, b, s, t, len(path)) for a, b in path]
            yield pd.DataFrame(rows, columns=["src", "dst", "path_from", "path_to", "length"])

    own = pairs.select("source", "target").distinct()
    found = own.repartition(max(8, edges.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, f"src {kind}, dst {kind}, path_from {kind}, path_to {kind}, length int")
    if max_paths is not None:
        found = cut_lineage(found)
        first = found.select("path_from", "path_to").distinct().orderBy("path_from", "path_to").limit(max_paths)
        found = found.join(first, ["path_from", "path_to"], "left_semi")
    least = found.groupBy("src", "dst").agg(F.min(F.struct("path_from", "path_to", "length")).alias("p"))
    return least.select("src", "dst", "p.*")


def cliques(members: DataFrame, group: str, member: str, max_members: int) -> DataFrame:
    """Edges (group, src, dst): all pairs of a small group, a star on the least member of a larger one."""
    sized = members.select(group, member).distinct()
    size = sized.groupBy(group).agg(F.count("*").alias("_n"), F.min(member).alias("_hub"))
    rows = sized.join(size, group)
    star = rows.where((F.col("_n") > max_members) & (F.col(member) != F.col("_hub"))).select(group, F.col("_hub").alias("src"), F.col(member).alias("dst"))
    few = rows.where(F.col("_n") <= max_members)
    pairs = few.select(group, F.col(member).alias("src")).join(few.select(group, F.col(member).alias("dst")), group).where("src < dst")
    return pairs.unionByName(star)


def two_hop(portals: DataFrame, portal: str, space: str) -> DataFrame:
    """Edges portal to space, of portals that lead to at least two spaces."""
    size = portals.groupBy(portal).agg(F.count_distinct(space).alias("_n")).where("_n >= 2").select(portal)
    return portals.select(portal, space).distinct().join(size, portal, "left_semi")


def hubs(rooms: DataFrame) -> DataFrame:
    """(cluster, hub): adjacent to a corridor with two or more neighbours, else to any corridor, else named a hall, else
    the least name; ties by guid. rooms: cluster, guid, name, corridor_neighbours (of the best corridor, 0 if none)."""
    rule = F.when(F.col("corridor_neighbours") >= 2, 1).when(F.col("corridor_neighbours") >= 1, 2).when(F.lower("name").contains("hall"), 3).otherwise(4)
    return rooms.groupBy("cluster").agg(F.min(F.struct(rule.alias("r"), F.col("name"), F.col("guid"))).alias("m")).select("cluster", F.col("m.guid").alias("hub"), F.col("m.r").alias("rule"))


def clusters(points: DataFrame, key: str, reach: float) -> DataFrame:
    """(id, component): points chained by distances of at most ``reach``; met over a grid of that size.

    Points are tied to one another in the own cell and in half of the cells around it, so each pair is met once.
    """
    p = points.select(F.col(key).alias("id"), "x", "y", "z").withColumn("cx", F.floor(F.col("x") / reach)).withColumn("cy", F.floor(F.col("y") / reach)).withColumn("cz", F.floor(F.col("z") / reach))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]))
    q = p.select(*[F.col(c).alias(f"q_{c}") for c in p.columns])
    near = p.withColumn("o", around).select("id", "x", "y", "z", *[(F.col(c) + F.col(f"o.{o}")).alias(f"q_{c}") for c, o in (("cx", "i"), ("cy", "j"), ("cz", "k"))], ((F.col("o.i") == 0) & (F.col("o.j") == 0) & (F.col("o.k") == 0)).alias("own"))
    d = sum((F.col(c) - F.col(f"q_{c}")) * (F.col(c) - F.col(f"q_{c}")) for c in "xyz")
    pairs = near.join(q, ["q_cx", "q_cy", "q_cz"]).where((~F.col("own") | (F.col("id") < F.col("q_id"))) & (d <= reach * reach))
    found = components(pairs.select(F.col("id").alias("src"), F.col("q_id").alias("dst")))
    return points.select(F.col(key).alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

"""Hand-computed toy graphs for the graph operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipgraph.operators.graph.community import certificate, communities, modularity
from shipgraph.operators.graph.edges import degrees, induced_subgraph, undirected, vertices
from shipgraph.operators.graph.pagerank import hits, pagerank
from shipgraph.operators.graph.paths import (_packed, betweenness, closeness,
                                             path_centralities, shortest_paths)


def as_dict(df, col):
    return {r.facility: r[col] for r in df.collect()}


def test_vertices_of_a_square_with_a_tail(edges):
    e = edges([("p", "q", 3), ("q", "r", 8), ("r", "s", 2), ("s", "p", 6), ("s", "tail", 1)])
    assert sorted(r.facility for r in vertices(e).collect()) == ["p", "q", "r", "s", "tail"]


def test_self_loop_degrees(edges):
    d = as_dict(degrees(edges([("A", "A", 1), ("A", "B", 1)])), "total_degree")
    assert d == {"A": 3, "B": 1}


def test_path_betweenness(edges):
    e = edges([("A", "B", 1), ("B", "C", 1), ("C", "D", 1)])
    b = as_dict(betweenness(e), "betweenness")
    assert b["B"] == pytest.approx(2 / 6) and b["C"] == pytest.approx(2 / 6)
    assert b["A"] == 0 and b["D"] == 0


def test_equal_paths_split(edges):
    e = edges([("A", "B", 1), ("A", "C", 1), ("B", "D", 1), ("C", "D", 1)])
    b = as_dict(betweenness(e, normalized=False), "betweenness")
    assert b["B"] == pytest.approx(0.5) and b["C"] == pytest.approx(0.5)


def test_closeness_incoming(edges):
    e = edges([("A", "B", 1), ("B", "C", 1), ("C", "D", 1)])
    c = as_dict(closeness(e), "closeness")
    # D is reached from A, B, C at distances 3, 2, 1 → (3/6)·(3/3)
    assert c["D"] == pytest.approx(0.5) and c["A"] == 0.0


def test_shortest_paths_weighted(edges):
    e = edges([("A", "B", 1), ("B", "C", 1), ("A", "C", 5), ("C", "C", 1)])
    d = {(r.s, r.t): r.d for r in shortest_paths(e).collect()}
    assert d[("A", "C")] == 2.0 and d[("A", "A")] == 0.0


def test_pagerank_dangling_and_sum(edges):
    e = edges([("A", "B", 1), ("C", "B", 1)])
    pr = as_dict(pagerank(e), "pagerank")
    assert sum(pr.values()) == pytest.approx(1.0)
    assert pr["A"] == pytest.approx(pr["C"]) and pr["B"] > pr["A"]


def test_star_hits(edges):
    e = edges([(f"L{i}", "H", 1) for i in range(4)] + [("H", f"R{i}", 1) for i in range(4)])
    h = hits(e)
    hub = as_dict(h, "hub_score")
    auth = as_dict(h, "authority_score")
    assert sum(hub.values()) == pytest.approx(1.0) and sum(auth.values()) == pytest.approx(1.0)
    assert hub["L0"] == pytest.approx(hub["L3"])


def test_two_cliques_communities(edges):
    rows = []
    for grp in ("a", "b"):
        ns = [f"{grp}{i}" for i in range(4)]
        rows += [(x, y, 1) for x in ns for y in ns if x < y]
    rows.append(("a0", "b0", 1))
    e = edges(rows)
    c = communities(e)
    assign = {r.facility: r.community_id for r in c.collect()}
    assert len(set(assign.values())) == 2
    assert len({assign[f"a{i}"] for i in range(4)}) == 1
    q = modularity(e, c).first().modularity
    comps = c.withColumn("community_id", F.lit(0))
    assert q > modularity(e, comps).first().modularity


def test_undirected_and_subgraph(edges):
    e = edges([("A", "B", 2), ("B", "A", 3), ("B", "C", 1)])
    u = {(r.u, r.v): r.weight for r in undirected(e).collect()}
    assert u[("A", "B")] == 5.0
    keep = vertices(e).where("facility != 'C'")
    assert induced_subgraph(e, keep).count() == 2


def test_pagerank_is_a_fixed_point(edges):
    rows = [(f"n{i}", f"n{(i * i + 3) % 23}", 1 + i % 4) for i in range(23)]
    x = as_dict(pagerank(edges(rows), tol=1e-12), "pagerank")
    out = {}
    for a, _, w in rows:
        out[a] = out.get(a, 0) + w
    loose = sum(v for k, v in x.items() if k not in out)
    for n in x:
        into = sum(x[a] * w / out[a] for a, b, w in rows if b == n)
        assert x[n] == pytest.approx(0.85 * (into + loose / len(x)) + 0.15 / len(x), abs=1e-10)


def test_null_zero_and_negative_distances(spark, edges):
    e = spark.createDataFrame([("A", "B", 1.0), ("B", "C", None)],
                              "src string, dst string, weight double")
    assert {(r.s, r.t) for r in shortest_paths(e).collect()} == {
        ("A", "A"), ("B", "B"), ("C", "C"), ("A", "B")}
    with pytest.raises(ValueError):
        shortest_paths(edges([("A", "B", -1)]))
    with pytest.raises(ValueError):
        betweenness(edges([("A", "B", 0), ("B", "A", 0)]))


def test_blocks_of_sources_give_the_same(edges):
    rows = [(f"n{i}", f"n{j}", 1 + (i * j) % 3) for i in range(9) for j in range(9)
            if i != j and (i * 5 + j * 3) % 4 == 0]
    e = edges(rows)
    for f, c in ((betweenness, "betweenness"), (closeness, "closeness")):
        one, many = as_dict(f(e), c), as_dict(f(e, block=2), c)
        assert one == pytest.approx(many)


def test_communities_of_a_ring_of_cliques_are_settled(edges):
    """No single node gains modularity by moving to a neighbouring community."""
    rows = []
    for c in range(12):
        ns = [f"c{c}n{i}" for i in range(4)]
        rows += [(x, y, 1) for x in ns for y in ns if x < y]
        rows.append((f"c{c}n0", f"c{(c + 1) % 12}n1", 1))
    e = edges(rows)
    got = {r.facility: r.community_id for r in communities(e).collect()}

    def q(assign):
        m, inner, deg = len(rows), 0, {}
        for a, b, _ in rows:
            inner += assign[a] == assign[b]
            for x in (a, b):
                deg[assign[x]] = deg.get(assign[x], 0) + 1
        return inner / m - sum((d / (2 * m)) ** 2 for d in deg.values())

    best = q(got)
    assert best == pytest.approx(modularity(e, communities(e)).first().modularity)
    for x in got:
        for c in {got[b] for a, b, _ in rows if a == x} | {got[a] for a, b, _ in rows if b == x}:
            assert q({**got, x: c}) <= best + 1e-9


def test_certificate_of_settled_and_unsettled_communities(spark, edges):
    """The certificate's gain is the one that brute force finds, and found
    communities leave none."""
    import random
    rng = random.Random(5)
    rows = [(f"n{i:02}", f"n{j:02}", rng.randint(1, 4)) for i in range(30) for j in range(30)
            if rng.random() < (0.4 if i // 10 == j // 10 else 0.06)]
    rows.append(("n00", "n00", 3))
    e = edges(rows)
    m = sum(w for *_, w in rows)

    def q(of):
        inner, deg = 0, {}
        for a, b, w in rows:
            inner += w * (of[a] == of[b])
            for x in (a, b):
                deg[of[x]] = deg.get(of[x], 0) + w
        return inner / m - sum((d / (2 * m)) ** 2 for d in deg.values())

    names = sorted({x for a, b, _ in rows for x in (a, b)})
    mixed = {x: int(x[1:]) % 4 for x in names}
    given = spark.createDataFrame(list(mixed.items()), "facility string, community_id long")
    near = {(a, mixed[b]) for x, y, _ in rows for a, b in ((x, y), (y, x)) if mixed[a] != mixed[b]}
    c = certificate(e, given).first()
    assert c.largest_gain == pytest.approx(max(q({**mixed, x: to}) for x, to in near) - q(mixed))
    assert c.quality == pytest.approx(q(mixed))
    assert c.quality_alone == pytest.approx(q({x: x for x in names}))
    assert (c.n_nodes, c.n_assigned, c.n_communities, c.dense_ids) == (len(names), len(names), 4, True)
    found = certificate(e, communities(e)).first()
    assert found.largest_gain <= 1e-11 and found.dense_ids and found.sizes_fall
    assert found.quality > c.quality and found.n_assigned == len(names)
    part = certificate(e, given.where("facility > 'n05'").withColumn(
        "community_id", F.col("community_id") + 1)).first()
    assert part.n_assigned == len(names) - 6 and not part.dense_ids


def test_certificate_without_weight(spark):
    none = spark.createDataFrame([], "src string, dst string, weight double")
    given = spark.createDataFrame([], "facility string, community_id long")
    c = certificate(none, given).first()
    assert (c.n_nodes, c.n_communities, c.dense_ids, c.largest_gain) == (0, 0, True, 0.0)


def test_embedding_keeps_the_singular_values(edges, spark):
    import numpy as np
    from shipgraph.operators.graph.embedding import svd_embedding
    rows = [(f"n{i}", f"n{(i * 3 + 1) % 8}", 1.0 + i) for i in range(8)] + [("n0", "n5", 2.5)]
    a = np.zeros((8, 8))
    for s, d, w in rows:
        a[int(s[1]), int(d[1])] += w
    got = {r.facility: r.embedding for r in svd_embedding(edges(rows), 3).collect()}
    us = np.array([got[f"n{i}"] for i in range(8)])
    assert np.linalg.norm(us, axis=0) == pytest.approx(np.linalg.svd(a)[1][:3], rel=1e-5)
    null = spark.createDataFrame([("A", "B", None), ("B", "C", 2.0), ("C", "D", 1.0)],
                                 "src string, dst string, weight double")
    kept = {r.facility: r.embedding for r in svd_embedding(null, 2).collect()}
    assert np.linalg.norm([kept[x] for x in kept], axis=0) == pytest.approx([2.0, 1.0])


def brute_centralities(rows, nodes):
    """Distances by relaxation, then every shortest path counted by depth-first search."""
    d = {(s, t): 0.0 if s == t else np.inf for s in nodes for t in nodes}
    for s in nodes:
        for _ in nodes:
            for a, b, c in rows:
                d[s, b] = min(d[s, b], d[s, a] + c)
    close, between = {}, dict.fromkeys(nodes, 0.0)
    for t in nodes:
        far = [d[s, t] for s in nodes if s != t and d[s, t] < np.inf]
        close[t] = (len(far) / sum(far)) * (len(far) / (len(nodes) - 1)) if far else 0.0
    for s in nodes:
        through = {t: [] for t in nodes}

        def walk(path):
            through[path[-1]].append(path)
            for a, b, c in rows:
                if a == path[-1] and a != b and d[s, a] + c == d[s, b]:
                    walk([*path, b])

        walk([s])
        for t, paths in through.items():
            for path in paths if t != s else []:
                for x in path[1:-1]:
                    between[x] += 1 / len(paths)
    return close, between


def test_centralities_over_many_strips_and_groups(spark, edges):
    rows = [(f"n{i:02}", f"n{(i * 7 + 3 * k + 1) % 13:02}", float(1 + (i * k) % 3))
            for i in range(13) for k in range(3)]
    rows += rows[:4] + [("n05", "n05", 1.0), ("x", "y", 2.0)]  # repeated, a loop, an island
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    close, between = brute_centralities(rows, nodes)
    got = path_centralities(edges(rows), normalized=False, block=6, strip=4, group=3).collect()
    assert len(got) == len(nodes)
    for r in got:
        assert r.closeness == pytest.approx(close[r.facility])
        assert r.betweenness == pytest.approx(between[r.facility])


def test_packed_edges_are_one_row_for_each_pair_of_groups(spark):
    e = spark.createDataFrame([(v, w, float(v + w)) for v in range(8) for w in range(8) if v != w],
                              "v_idx long, w_idx long, c double")
    rows = _packed(e, "w_idx", "v_idx", 4).collect()
    assert sorted((r.k, r.o) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    for r in rows:
        near, far, c = (np.frombuffer(x, t) for x, t in ((r.near, np.int32), (r.far, np.int32),
                                                         (r.c, float)))
        assert (np.diff(near) >= 0).all()
        assert (c == near + far + 4 * (r.k + r.o)).all()

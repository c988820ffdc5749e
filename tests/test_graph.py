"""Components whose nodes have very many edges."""

from stratalens.operators import graph


def test_edges_of_hubs_meet_their_least_neighbour_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_EDGES", 5)
    monkeypatch.setattr(graph, "MOST_HUBS", 8)
    edges = [("a0", f"b{i:02}") for i in range(40)] + [("z9", f"b{i:02}") for i in range(30, 60)] + [("c1", "c2"), ("c2", "c3")] + [("d0", f"e{i}") for i in range(6)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert found == {n: {"a": "a0", "b": "a0", "z": "a0", "c": "c1"}.get(n[0], "d0") for e in edges for n in e}
    near, low = graph._least(spark.createDataFrame([("h", f"v{i}") for i in range(20)] + [("k", "v3"), ("k", "v1")], "u string, v string"), graph.storage.fresh_dir(spark, "least"))
    assert "broadcast" in near._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(tuple, near.select("u", "m").distinct().collect())) == [("h", "v0"), ("k", "v1")] and near.count() == 22

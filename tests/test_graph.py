import pytest
from conftest import rows

from tributary.operators import graph
from tributary.plans import catalogue, derived


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "x", 1.0, i) for i, (a, b) in enumerate(pairs)], "source string, target string, type string, confidence_score double, seq int")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "identity string")


def test_importance_on_a_chain(spark):
    e = edges(spark, [("a", "b"), ("b", "c")])
    base = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", 1.0)], "identity string, base double")
    assert rows(graph.distance_importance(ids(spark, "abc"), e, base)) == [("a", 100), ("b", 56), ("c", 10)]


def test_reach_takes_the_shortest_way_and_ends_in_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")])
    assert rows(graph.reach(e, ids(spark, "a"), None)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]
    assert rows(graph.trace(e, "d", upstream=True)) == [("a", 2), ("b", 2), ("c", 1)]


def test_impact_and_importance_have_no_depth(spark, monkeypatch):
    names = [f"n{i:02}" for i in range(14)]
    e, nodes = edges(spark, list(zip(names, names[1:]))), ids(spark, names)
    hit = graph.weighted_impact(e, nodes.selectExpr("identity", "100 as importance_score"), "n00")
    assert {r.node: r.distance for r in hit.collect()} == {n: i for i, n in enumerate(names) if i}
    monkeypatch.setattr(derived, "lineage_edges", lambda spark, sf: e)
    monkeypatch.setattr(derived, "data_nodes", lambda spark, sf: nodes.selectExpr("identity", "'x' as namespace"))
    monkeypatch.setattr(catalogue, "START", "n00")
    assert catalogue.blast_radius_set(spark, "").count() == 13
    assert catalogue.blast_radius_weighted(spark, "").count() == 13
    assert catalogue.blast_radius_total(spark, "").first().affected == 13
    # What is more than five hops away counts too.
    monkeypatch.setattr(derived, "data_nodes", lambda spark, sf: ids(spark, [names[0]] + names[6:]))
    whole = int(round(10 * (1 + sum(1.5**-k for k in range(6, 14))), 9))
    assert dict(rows(catalogue.importance_distance_weighted(spark, "")))["n00"] == whole == 12


def test_strong_components(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e"), ("d", "f")])
    assert rows(graph.strong_components(e)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    assert rows(graph.cycle_members(e)) == [("a",), ("b",), ("c",), ("d",), ("e",)]
    assert rows(graph.strong_components(edges(spark, [("a", "b"), ("b", "c")]))) == []


def test_validation(spark):
    with pytest.raises(ValueError, match="cycles"):
        graph.assert_acyclic(edges(spark, [("a", "b"), ("b", "a")]))
    graph.assert_acyclic(edges(spark, [("a", "b")]))


def test_integrity_of_a_cycle_without_nodes(spark):
    e = edges(spark, [("a", "b"), ("b", "a")])
    data = spark.createDataFrame([], "identity string, role string")
    found = rows(graph.integrity(data, ids(spark, []), e))
    assert found == [("cycle", "a", "high"), ("undefined_reference", "a", "medium"), ("undefined_reference", "b", "medium")]


def test_roles_of_isolated_nodes(spark):
    e = edges(spark, [("a", "b"), ("b", "c")])
    assert rows(graph.roles(ids(spark, "abcz"), e)) == [("a", "SOURCE"), ("b", "INTERMEDIATE"), ("c", "TERMINAL"), ("z", "SOURCE")]


def test_pagerank_sums_to_one_and_flows_downstream(spark):
    e = edges(spark, [("a", "c"), ("b", "c"), ("c", "d")])
    ranks = dict(rows(graph.pagerank(ids(spark, "abcd"), e)))
    assert sum(ranks.values()) == pytest.approx(1)
    assert ranks["d"] > ranks["c"] > ranks["a"]
    assert graph.pagerank(ids(spark, []), e.limit(0)).count() == 0


def test_critical_path_breaks_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "d")])
    assert [r[1] for r in sorted(rows(graph.critical_path(e)))] == ["a", "b", "c", "d"]


def test_last_edge_wins(spark):
    e = spark.createDataFrame([("a", "b", "old", 1), ("a", "b", "new", 2)], "source string, target string, type string, seq int")
    assert rows(graph.last_wins(e)) == [("a", "b", "new", 2)]


def test_import_resolution(spark):
    nodes = spark.createDataFrame([("src/lib/a.py", 1), ("b.py", 2), ("seeds/raw.csv", 3), ("models/s.yml", 4)], "identity string, seq int")
    asked = spark.createDataFrame([("b.py", "lib.a", "python_import", 0), ("b.py", "b", "python_import", 0), ("m.sql", "raw", "dbt_ref", 0), ("m.sql", "x.s", "dbt_ref", 0)], "importer string, name string, type string, seq int")
    assert rows(graph.resolve_imports(asked, nodes).drop("seq")) == [
        ("models/s.yml", "m.sql", "describes"),
        ("seeds/raw.csv", "m.sql", "dbt_source"),
        ("src/lib/a.py", "b.py", "python_import"),
    ]


def test_empty_graph(spark):
    e = edges(spark, [])
    assert rows(graph.degrees(e)) == []
    assert rows(graph.trace(e, "a")) == []
    assert rows(graph.depths(e)) == []
    assert rows(graph.critical_path(e)) == []

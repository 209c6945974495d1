import subprocess

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tributary.engine import Engine
from tributary.operators import aggregates, incremental, reports, semantic, sql_lineage
from tributary.sources import files
from tributary.streaming import live

FILES = {
    "dag.py": "from airflow import DAG\nstg_sales >> load_sales\n",
    "models/schema.yml": "version: 2\nsources:\n  - name: internal\n    tables:\n      - name: sales\n",
    "models/stg_sales.sql": "with s as (select * from {{ source('internal', 'sales') }}) select * from s",
    "load_sales.py": 'import helper\nimport pandas as pd\ndf = pd.read_csv("stg_sales.csv")\ndf.to_parquet("s3://out/loaded_sales.parquet")\n',
    "helper.py": '"""Helps."""\n\n\ndef used(a):\n    if a:\n        return 1\n',
    "unused.py": "x = 1\n",
    "node_modules/skip.py": "x = 1\n",
    "README.md": "# Readme\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git = ["git", "-C", str(root), "-c", "user.name=Rae", "-c", "user.email=r@example.org"]
    subprocess.run([*git, "init", "-q"], check=True)
    subprocess.run([*git, "add", "."], check=True)
    subprocess.run([*git, "commit", "-qm", "first"], check=True)
    subprocess.run([*git, "mv", "unused.py", "old name.py"], check=True)
    subprocess.run([*git, "commit", "-qm", "rename"], check=True)
    return str(root)


@pytest.fixture(scope="module")
def found(spark, repo):
    return Engine(spark).analyze(repo)


def test_scan_prunes(spark, repo):
    got = {r.identity for r in files.scan(spark, repo).collect()}
    assert got == (set(FILES) - {"node_modules/skip.py", "unused.py"}) | {"old name.py"}


def test_log_follows_renames(spark, repo):
    log = files.git_log(spark, repo)
    assert {(r.path, r.status) for r in log.collect()} >= {("old name.py", "R"), ("helper.py", "A")}
    assert log.where("author = 'Rae'").count() == log.count()


def test_module_graph(found):
    assert ("helper.py", "load_sales.py") in {(r.source, r.target) for r in found.module_edges.collect()}
    m = {r.identity: r for r in found.modules.collect()}
    assert m["old name.py"].is_dead_code_candidate and not m["helper.py"].is_dead_code_candidate
    assert m["README.md"].layer == "meta" and not m["README.md"].is_architectural_hub
    assert m["helper.py"].purpose == "Estimated purpose: Helps."
    assert all(1 <= r.importance_score <= 100 for r in m.values())


def test_lineage(found):
    e = {(r.source, r.target) for r in found.lineage_edges.collect()}
    assert ("load_sales.py", "loaded_sales") in e
    assert ("stg_sales", "load_sales.py") in e
    assert {r.identity: r.role for r in found.data_nodes.collect()}["loaded_sales"] == "TERMINAL"


def test_declared_sources_are_edges(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("declared")
    (root / "s.yml").write_text("sources:\n  - name: crm\n    tables:\n      - name: people\n")
    (root / "a.py").write_text("import pandas as pd\nx = pd.read_csv('in.csv')\n")
    got = Engine(spark).analyze(str(root))
    edge = {(r.source, r.target): r.type for r in got.lineage_edges.collect()}
    assert edge[("s.yml", "people")] == "DBT_SOURCE"
    assert {r.identity: r.role for r in got.data_nodes.collect()}["people"] == "SOURCE"
    assert "s.yml" in {r.identity for r in got.transformations.collect()}
    assert not {r.node for r in got.warnings.collect()} & {"people", "s.yml"}


def test_the_mini_project_keeps_its_declared_edge(found):
    e = {(r.source, r.target, r.type) for r in found.lineage_edges.collect()}
    assert ("models/schema.yml", "sales", "DBT_SOURCE") in e


def test_questions(spark, found):
    engine = Engine(spark)
    assert engine.query(found, "What breaks if I change helper.py?").count() >= 1
    assert engine.query(found, "what is downstream of stg_sales").count() >= 1
    assert engine.query(found, "explain helper.py").first().identity == "helper.py"
    assert engine.query(found, "where is help done").count() >= 1
    assert "Inventory" in found.overview()
    assert found.brief().count() > 0


def test_overview_is_whole_and_in_order(spark, found):
    text = reports.overview({"Many": spark.range(450).selectExpr("450 - id as n", "'a|b' as t").orderBy("n")})
    assert [x for x in text.splitlines() if "a\\|b" in x] == [f"| {n} | a\\|b |" for n in range(1, 451)]
    debt = [(r.path, r.kind) for r in found.sections()["Debt"].collect()]
    assert debt and debt == sorted(debt)


def test_written_tables_read_again(spark, found, tmp_path):
    found.write(str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "modules")).count() == found.modules.count()
    assert spark.read.json(str(tmp_path / "module_graph_json")).count() > 0


def test_the_overview_is_written(spark, found, tmp_path):
    found.write(str(tmp_path))
    assert "".join(p.read_text() for p in (tmp_path / "overview").glob("part-*")).rstrip("\n") == found.overview().rstrip("\n")


def test_hashes(spark):
    from tributary.operators.extract import PythonHashes, apply_udtf

    texts = [("a", "def f(x):\n    return x\n"), ("b", "# note\ndef f(x):\n    return x\n"), ("c", "def f(x):\n    return 2\n"), ("d", "def f(:")]
    h = {r.path: r for r in apply_udtf(spark.createDataFrame(texts, "path string, content string"), PythonHashes).collect()}
    assert h["a"].ast_hash == h["b"].ast_hash != h["c"].ast_hash
    assert h["a"].signature_hash == h["c"].signature_hash
    assert h["d"].ast_hash


def test_column_lineage(spark):
    got = sql_lineage.column_lineage(spark, "with c as (select id, v * 2 as w from t) select c.id, c.w + u.x as y from c join u on c.id = u.id", {"t": ["id", "v"], "u": ["id", "x"]})
    assert got == [("id", "t.id"), ("y", "t.v"), ("y", "u.x")]
    assert sql_lineage.column_lineage(spark, "SELECT FROM WHERE JOIN x", {}) == []


def test_regex_fallback(spark):
    e = sql_lineage.analyse(spark, [("q.txt", "SELECT FROM WHERE JOIN my_table")])["edges"]
    assert ("my_table", 0.3) in {(r.source, r.confidence_score) for r in e.collect()}


def test_incremental(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("gone", "3")], "path string, hash string")
    assert rows(incremental.changed(now, old)) == [("b",)]
    diff = spark.createDataFrame([("a",)], "path string")
    assert rows(incremental.changed(now, old, diff)) == [("a",), ("b",)]


def test_majority_ties_and_missing(spark):
    p = spark.createDataFrame([("d", "y"), ("d", "x"), ("e", None)], "dataset string, domain string")
    assert rows(aggregates.majority_domain(p)) == [("d", "x"), ("e", "Unknown")]


def test_few_modules_stay_unclustered(spark):
    few = spark.createDataFrame([(str(i), [1.0, float(i)], 0.9) for i in range(3)], "identity string, embedding array<double>, purpose_confidence double")
    assert {r.domain for r in semantic.cluster(few).collect()} == {"Unclustered"}
    more = spark.createDataFrame([(str(i), [1.0, float(i)], 0.9 if i else 0.4) for i in range(5)], "identity string, embedding array<double>, purpose_confidence double")
    assert {r.identity for r in semantic.cluster(more, 0.55).where("domain = 'Unclassified'").collect()} == {"0"}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"timestamp": "2024-01-01T00:00:00Z", "agent": "x", "event_type": "t", "duration_ms": 4}\n{"timestamp": "2024-01-01T00:20:00Z", "agent": "x", "event_type": "t", "duration_ms": 6}\n')
    q = live.trace_counts(live.trace_stream(spark, str(src))).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("events")).first()[0] == 2
    live.append_trace(live.trace_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert files.read_trace(spark, str(tmp_path / "out")).count() == 2


def test_stream_keeps_an_index(spark, tmp_path):
    table = str(tmp_path / "index")
    schema = "identity string, content string, content_hash string"
    src = tmp_path / "files"
    spark.createDataFrame([("a", "1"), ("b", "2")], "identity string, content string").coalesce(1).write.json(str(src))
    saved = []

    def write(df):
        where = f"{table}{len(saved)}"
        df.write.parquet(where)
        saved.append(where)

    read = lambda: spark.read.parquet(saved[-1]) if saved else spark.createDataFrame([], schema)
    stream = spark.readStream.schema("identity string, content string").json(str(src))
    live.incremental_index(stream, read, write, str(tmp_path / "c")).awaitTermination()
    assert read().count() == 2


def test_column_lineage_without_schemas(spark):
    models = [
        ("a.sql", "with src as (select * from raw.sales), more as (select * from src) select id, amount as total from more where day > 1"),
        ("b.sql", "select x.total, y.name, x.id + y.age as both from {{ ref('a') }} x join people y on x.id = y.id"),
        ("c.sql", "select name, count(*) as n from people group by name"),
        ("d.sql", "select p.name from (select name, id from people) p join {{ ref('a') }} a on p.id = a.id"),
    ]
    got = {tuple(r) for r in sql_lineage.analyse(spark, models)["columns"].collect()}
    assert got >= {("a.sql", "id", "raw.sales.id"), ("a.sql", "total", "raw.sales.amount"), ("b.sql", "total", "__dbt_ref_a__.total"), ("b.sql", "name", "people.name")}
    assert got >= {("b.sql", "both", "__dbt_ref_a__.id"), ("b.sql", "both", "people.age"), ("c.sql", "name", "people.name"), ("d.sql", "name", "people.name")}


def test_a_macro_in_place_of_columns_keeps_the_table(spark):
    e = sql_lineage.analyse(spark, [("m.sql", "select {{ cents('x') }} from {{ ref('stg') }}")])["edges"]
    assert ("stg", "m.sql", "DBT_REF") in {(r.source, r.target, r.type) for r in e.collect()}


def test_constants_of_other_files_are_shared(spark):
    from tributary.operators import extract

    texts = [("a.py", "base = 's3://x'\n"), ("b.py", "import pandas as pd\nfrom a import base\npd.read_csv(f'{base}/f.csv')\n"), ("c.py", "import pandas as pd\npd.read_csv(basement)\n")]
    made = spark.createDataFrame(texts, "path string, content string")
    constants = extract.apply_udtf(made, extract.PythonConstants).selectExpr("name", "value", "path as seq")
    assert [(r.source, r.target, r.confidence_score) for r in extract.python_edges(made, constants).collect()] == [("s3://x/f.csv", "b.py", 0.7)]


def test_drift_is_told_where_there_is_a_docstring(found):
    m = {r.identity: r.documentation_drift for r in found.modules.collect()}
    assert m["helper.py"] is not None and m["README.md"] is None


def test_the_catalogue_names_what_was_written(spark, found, tmp_path):
    found.write(str(tmp_path))
    rows_ = spark.read.json(str(tmp_path / "catalogue")).collect()
    assert {"modules", "lineage_edges", "overview", "lineage_chart"} <= {r.artifact for r in rows_}
    assert all(r.git_commit == found.sha and r.analysis_version and r.generated for r in rows_)
    import os

    assert all(os.path.exists(r.path) for r in rows_)
    chart = spark.read.text(str(tmp_path / "lineage_chart")).collect()
    assert chart[0].value == "flowchart LR" and any("-->" in r.value for r in chart)


def test_the_command_line(spark, repo, capsys, tmp_path):
    from tributary.__main__ import main

    assert main(["version"]) == 0
    assert main(["lineage", repo, "stg_sales"]) == 0
    assert main(["impact", repo, "helper.py"]) == 0
    assert main(["query", repo, "explain helper.py"]) == 0
    assert main(["analyze", repo, str(tmp_path / "out")]) == 0
    said = capsys.readouterr().out
    assert "load_sales.py" in said and "explain_module" in said and (tmp_path / "out" / "modules").exists()


def test_names_with_pattern_letters_are_read(spark, tmp_path):
    for name in ("a[1].py", "b{x}.sql", "c*.py"):
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "big").write_bytes(b"\xff" * 10)
    assert {r.identity for r in files.scan(spark, str(tmp_path)).collect()} == {"a[1].py", "b{x}.sql", "c*.py"}


def test_a_clone_that_cannot_pull_is_made_anew(repo, tmp_path):
    import pathlib
    import shutil

    to = pathlib.Path(files.clone(f"file://{repo}", str(tmp_path)))
    assert (to / "helper.py").exists()
    shutil.rmtree(to / ".git")
    (to / "helper.py").unlink()
    assert files.clone(f"file://{repo}", str(tmp_path)) == str(to) and (to / "helper.py").exists()
    assert files.clone(f"file://{repo}", str(tmp_path)) == str(to)


def test_stored_things_are_read(spark, tmp_path):
    nodes = spark.createDataFrame([("a",), ("b",)], "identity string")
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    assert [x.count() for x in files.read_graph(spark, str(tmp_path / "g"))] == [2, 1]
    (tmp_path / "list.json").write_text('{"nodes": [{"identity": "a"}], "edges": [{"source": "a", "target": "b"}]}')
    (tmp_path / "kinds.json").write_text('{"data_nodes": [{"identity": "a"}], "other_nodes": [{"identity": "b", "x": 1}], "edges": [{"source": "a", "target": "b"}]}')
    assert [x.count() for x in files.read_graph(spark, str(tmp_path / "list.json"))] == [1, 1]
    assert [x.count() for x in files.read_graph(spark, str(tmp_path / "kinds.json"))] == [2, 1]
    assert files.read_table(spark, str(tmp_path / "none"), "a long").count() == 0
    (tmp_path / "o.json").write_text('[{"module": "a", "domain": "d"}]')
    assert [(r.module, r.domain) for r in files.read_overrides(spark, str(tmp_path / "o.json")).collect()] == [("a", "d")]
    (tmp_path / "t.jsonl").write_text('{"agent": "x", "event_type": "t"}\nbroken\n')
    assert [r.agent for r in files.read_trace(spark, str(tmp_path / "t.jsonl")).collect()] == ["x"]
    (tmp_path / "artifacts").mkdir()
    (tmp_path / "artifacts" / "old_brief.md").write_text("x")
    assert files.artifact(str(tmp_path), {}, "brief", "brief.md").endswith("old_brief.md")
    assert files.artifact(str(tmp_path), {"brief": "o.json"}, "brief", "brief.md").endswith("o.json")
    assert files.evidence(spark.createDataFrame([("a", "abcdef")], "path string, content string"), 3).first().evidence == "abc"


def test_changes_since_a_commit(spark, repo):
    first = subprocess.run(["git", "-C", repo, "rev-list", "--max-parents=0", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    assert {r.path for r in files.changed_since(spark, repo, first).collect()} == {"old name.py"}


def test_changed_modules_are_found(spark, found):
    engine = Engine(spark)
    assert engine.changed(found, found).count() == 0


def test_providers_are_retried_and_follow_each_other(spark):
    from tributary.operators import providers

    class Busy(Exception):
        status_code = 429

    waits, calls = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return [t.upper() for t in texts]

    assert providers.call(flaky, ["a"], wait=waits.append) == ["A"] and waits == [1.0, 2.0]

    def broken(texts):
        calls.append(1)
        raise ValueError

    calls.clear()
    assert providers.cascade([broken, lambda t: ["x"] * len(t)])(["a", "b"]) == ["x", "x"] and len(calls) == 1
    made = spark.createDataFrame([("a", "p"), ("b", None)], "identity string, purpose string")

    def none(texts):
        raise ValueError

    assert {tuple(r.embedding) for r in providers.embed(made, [none], 2).collect()} == {(0.0, 0.0)}
    samples = spark.createDataFrame([("Cluster_0", k, f"p{k}", "x") for k in range(1, 13)], "domain string, place int, path string, purpose string")
    assert rows(providers.name_domains(samples)) == [("Cluster_0", "Cluster_0")]
    assert rows(providers.name_domains(samples, lambda texts: [str(len(t.splitlines())) for t in texts])) == [("Cluster_0", "10")]


def test_a_budget_bounds_what_is_described(spark):
    made = spark.createDataFrame([(f"m{i}", "word " * 4000, ["f"], []) for i in range(4)], "path string, docstring string, functions array<string>, imports array<string>")

    def describe(frame):
        return frame[["path"]].assign(purpose="said", confidence=0.9)

    got = {r.path: r.purpose for r in semantic.purposes(made, describe, budget=0.001).collect()}
    assert [got[f"m{i}"] == "said" for i in range(4)] == [True, True, False, False]


def test_the_brief_cites_its_evidence(found):
    text = found.brief_text()
    assert "helper.py" in text and "[helper.py:4]" in text and "[README.md:1]" in text


def test_small_functions(spark):
    from tributary.functions import names
    from tributary.operators import graph

    r = spark.sql("select 's3://x/Y.parquet' as a, timestamp'2024-01-02 03:04:05' as t, cast(null as timestamp) as n")
    got = r.select(names.resolve_canonical(F.col("a")).alias("plain"), names.resolve_canonical(F.col("a"), {"s3://x/Y.parquet": "mine"}).alias("own"), names.clock_label(F.col("t")).alias("t"), names.clock_label(F.col("n")).alias("n")).first()
    assert tuple(got) == ("y", "mine", "2024-01-02 03:04:05", "—")
    e = spark.createDataFrame([("a", "b", "x"), ("b", "a", "y"), ("a", "c", "x")], "source string, target string, type string")
    nodes = spark.createDataFrame([("a",), ("b",)], "identity string")
    assert rows(graph.induced(e, nodes, ["x"])) == [("a", "b", "x")]

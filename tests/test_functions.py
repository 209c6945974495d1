import pytest
from pyspark.sql import functions as F

from tributary.functions import names
from tributary.operators import extract


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "short"),
    [
        ("s3://bucket/warehouse/orders", "orders"),
        ("s3://bucket/a/", "a"),
        ("__dbt_source_raw_order_items__", "items"),
        ("__dbt_ref_stg_orders__", "stg_orders"),
        ("db.schema.T", "t"),
        ('"X.csv"', "x"),
    ],
)
def test_short_name(spark, raw, short):
    assert one(spark, names.short_name(F.lit(raw))) == short


@pytest.mark.parametrize(("raw", "parts"), [("a.b.c", ("a", "b", "c")), ("b.c", (None, "b", "c")), ("s3://x/y.csv", (None, None, "y")), ("t", (None, None, "t"))])
def test_components(spark, raw, parts):
    assert tuple(one(spark, names.components(F.lit(raw)))) == parts


def test_normalize(spark):
    assert one(spark, names.normalize(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, names.canonicalize(F.lit("S3://B/x.parquet"), F.lit("S3A"))) == "s3:b/x"
    assert one(spark, names.simplify_path(F.lit("/a/dt=2024-01-01/2024/01/02/x"))) == "/a/dt=*/*/*/*/x"


def test_layers(spark):
    got = {p: one(spark, names.layer(F.lit(p))) for p in ("README.md", "models/a.sql", "src/models/b.py", "seeds/c.csv", "x.yml", "src/main.py", "tests/t.py", "z.toml", "q.bin")}
    assert got == {"README.md": "meta", "models/a.sql": "product", "src/models/b.py": "model", "seeds/c.csv": "raw", "x.yml": "tooling", "src/main.py": "core", "tests/t.py": "test", "z.toml": "tooling", "q.bin": "unknown"}
    assert one(spark, names.informational(F.lit("seeds/c.csv"))) is False
    assert one(spark, names.informational(F.lit("seeds/README.md"))) is True


def test_cosine_edges(spark):
    vec = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert one(spark, names.cosine(vec(1, 0), vec(0, 1))) == 0
    assert one(spark, names.cosine(vec(0, 0), vec(0, 1))) == 0
    assert one(spark, names.cosine(vec(1), vec(0, 1))) == 0
    assert one(spark, names.cosine(vec(2, 2), vec(1, 1))) == pytest.approx(1)


def test_hash_ignores_case_and_space(spark):
    assert one(spark, names.sql_logic_hash(F.lit("SELECT  1"))) == one(spark, names.sql_logic_hash(F.lit("select 1")))
    assert one(spark, names.sql_logic_hash(F.lit(""))) == "unknown"


def test_clusters_and_urls(spark):
    assert [names.cluster_count(n) for n in (1, 3, 4, 9, 30)] == [1, 1, 2, 3, 8]
    assert one(spark, names.is_remote(F.lit("https://x/y"))) is True
    assert one(spark, names.fenced_json(F.lit('so:\n```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, names.short_label(F.lit("a/b/c.py"))) == "b/c.py"


def test_chained_tasks(spark):
    f = spark.createDataFrame([("d.py", "DAG\na >> b >> c")], "path string, content string")
    pairs = lambda df: sorted((r.source, r.target) for r in df.collect())
    assert pairs(extract.airflow_edges(f)) == [("a", "b"), ("b", "c")]
    assert pairs(extract.airflow_edges(f, chained=False)) == [("a", "b")]

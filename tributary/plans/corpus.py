"""A small made-up repository, and what SQL says about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL_FILES = [
    ("models/stg_sales.sql", "with src as (select * from {{ source('raw', 'sales') }}) select id, amount from src"),
    ("models/staging/stg_people.sql", "select id, name from {{ source('crm', 'person_list') }} where name is not null"),
    ("models/marts/totals.sql", "{% set x = 1 %}\nselect p.name, sum(s.amount) as total, case when sum(s.amount) > 10 then 'big' else 'small' end as size\nfrom {{ ref('stg_sales') }} s\nleft join {{ ref('stg_people') }} p on p.id = s.id\ngroup by p.name"),
    ("models/marts/ranked.sql", "select name, total, row_number() over (order by total desc) as place from {{ ref('totals') }} where total > {{ var('floor') }}"),
    ("jobs/load.sql", "insert into warehouse.facts select a.id from staging.a join staging.b on a.id = b.id"),
    ("jobs/macro.sql", "select {{ cents_to_dollars('amount') }} from {{ ref('stg_sales') }}"),
    ("jobs/broken.sql", "SELECT FROM WHERE JOIN lost_table"),
]
PYTHON_FILES = [
    ("dags/daily.py", "from airflow import DAG\n\nextract >> clean >> publish\nclean.set_downstream(audit)\n"),
    ("jobs/report.py", 'import pandas as pd\nimport numpy as np, os.path\nfrom lib.paths import BASE\n\nROOT = "s3://bucket"\n\n\nclass Job(Base, lib.Mixin):\n    """Runs."""\n\n    def run(self, day):\n        """Read and write.\n\n        More.\n        """\n        if day:\n            for x in day:\n                pass\n        elif self:\n            pass\n        df = pd.read_csv(f"{ROOT}/data.csv")\n        df.to_parquet("out.parquet")\n'),
    ("jobs/db.py", 'from sqlalchemy import create_engine\n\nengine = create_engine("postgresql://host/db")\nengine.execute("SELECT * FROM people JOIN sales ON 1 = 1")\n'),
    ("jobs/spark_job.py", 'df = spark.read.parquet("input.parquet")\ndf.write.mode("overwrite").save("output.parquet")\n'),
]
YAML_FILES = [("models/schema.yml", "version: 2\nsources:\n  - name: raw\n    tables:\n      - name: sales\n      - name: returns\nmodels:\n  - name: stg_sales\n"), ("conf/odd.yml", "a: [1, 2")]
SCHEMAS = {"__dbt_source_raw_sales__": ["id", "amount"], "__dbt_source_crm_person_list__": ["id", "name"], "staging.a": ["id", "v"], "staging.b": ["id", "w"]}


def sql_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SQL_FILES, "path string, content string")


def python_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PYTHON_FILES, "path string, content string")


def yaml_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(YAML_FILES, "path string, content string")


def models() -> list[tuple[str, str]]:
    return SQL_FILES


def _values(rows: list[tuple[str, str]]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "with f(path, c) as (values " + ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows) + ")"


_F = _values(SQL_FILES)
_MOCKED = r"""regexp_replace(regexp_replace(regexp_replace(c, '\{\{\s*ref\(''([^'']+)''\)\s*\}\}', '__dbt_ref_\1__', 'g'),
  '\{\{\s*source\(''([^'']+)'', ''([^'']+)''\)\s*\}\}', '__dbt_source_\1_\2__', 'g'), '(?s)\{\{.*?\}\}|\{%.*?%\}', ' ', 'g')"""
JINJA_SQL = (
    _F
    + r""" select path, unnest(regexp_extract_all(c, 'ref\(''([^'']+)''\)', 1)) as name, 'dbt_ref' as type from f
union all select path, replace(unnest(regexp_extract_all(c, 'source\(''([^'']+'', ''[^'']+)''\)', 1)), ''', ''', '.'), 'dbt_source' from f
union all select path, unnest(regexp_extract_all(c, 'var\(''([^'']+)''', 1)), 'dbt_var' from f
union all select path, m, 'dbt_macro' from (select path, unnest(regexp_extract_all(c, '\{\{ ([a-z_]+)\(', 1)) as m from f) where m not in ('ref', 'source', 'var', 'config', 'log')"""
)
MOCK_SQL = _F + f" select path, {_MOCKED} as sql from f"
_n = lambda p: f"len(regexp_extract_all(lower(c), '{p}'))"
COMPLEXITY_SQL = (
    _F
    + f""" select path, cast(greatest(1.0, {_n(r"\bjoin\b")} + 0.5 * ({_n(r"\bwith\b")} + {_n(r"\bas\s*\(")}) + 0.5 * {_n(r"\bwhen\b")} + {_n(r"\bgroup\s+by\b")} + 1.5 * {_n(r"\bover\b")}) as double) as complexity from f"""
)
_TABLES = r"select distinct t as source, path as target from (select path, unnest(regexp_extract_all({0}, '(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_.]*)', 1)) as t from f)"
# Each word is looked for by itself, so a table may follow a word that another match has taken.
_EACH = r"select distinct t as source, path as target from (select path, unnest(regexp_extract_all({0}, '(?i)\bFROM\s+([A-Za-z_][A-Za-z0-9_.]*)', 1)) as t from f union all select path, unnest(regexp_extract_all({0}, '(?i)\bJOIN\s+([A-Za-z_][A-Za-z0-9_.]*)', 1)) from f)"
REGEX_SQL = _F + " select source, target, cast(0.3 as double) as confidence_score from (" + _EACH.format("c") + ")"
READ_SQL = (
    _F
    + r" select target, case when source like '\_\_dbt\_source%' escape '\' then regexp_extract(regexp_replace(source, '__$', ''), '([^_]*)$', 1) when source like '\_\_dbt\_ref%' escape '\' then regexp_extract(source, '^__dbt_ref_(.*)__$', 1) else source end as name, case when source like '\_\_dbt\_source%' escape '\' then 'DBT_SOURCE' when source like '\_\_dbt\_ref%' escape '\' then 'DBT_REF' else 'SQL_READ' end as type from ("
    + _EACH.format(_MOCKED)
    + ")"
)
PRODUCT_SQL = _F + r" select path as source, 'table:' || regexp_extract(path, '([^/]+)\.sql$', 1) as target from f"
# Tasks on a line of arrows follow each other, and so do those of set_downstream.
AIRFLOW_SQL = (
    _values(PYTHON_FILES)
    + r""", lines as (select unnest(string_split(c, chr(10))) as line from f where c like '%airflow%'),
chains as (select string_split(line, '>>') as p from lines where line like '%>>%'),
places as (select p, unnest(range(1, len(p))) as i from chains)
select trim(p[i]) as source, trim(p[i + 1]) as target from places
union select regexp_extract(line, '(\w+)\.set_downstream', 1), regexp_extract(line, 'set_downstream\((\w+)\)', 1) from lines where line like '%set_downstream%'"""
)


def _rows(columns: str, *rows: tuple) -> str:
    """The rows that reading the files by hand gives, as SQL."""
    told = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::double" if isinstance(x, float) else str(x) if isinstance(x, int) else x[4:] if x.startswith("sql:") else "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) t({columns})"


_REPORT, _DB, _JOB, _DAG = "jobs/report.py", "jobs/db.py", "jobs/spark_job.py", "dags/daily.py"
FUNCTIONS_SQL = _rows("path, name, signature, docstring, complexity, is_nested, decorators, line", (_REPORT, "run", "run(self, day)", "Read and write.", 4, False, "", 11))
IMPORTS_SQL = _rows(
    "path, name, type, line",
    *[(path, name, "python_import", line) for path, name, line in ((_DAG, "airflow", 1), (_DB, "sqlalchemy", 1), (_REPORT, "pandas", 1), (_REPORT, "numpy", 2), (_REPORT, "os.path", 2), (_REPORT, "lib.paths", 3))],
)
CLASSES_SQL = _rows("path, name, bases, line", (_REPORT, "Job", "Base,lib.Mixin", 8))
CONSTANTS_SQL = _rows("path, name, value", (_REPORT, "ROOT", "s3://bucket"), (_DB, "engine", None), (_JOB, "df", None))
SUMMARIES_SQL = _rows(
    "path, language, first, last, docstring, functions, classes, imports, constants",
    (_DAG, "py", 1, 5, "sql:null::varchar", "", "", "airflow", ""),
    (_DB, "py", 1, 5, None, "", "", "sqlalchemy", "engine"),
    (_REPORT, "py", 1, 23, None, "run", "Job", "lib.paths,numpy,os.path,pandas", "ROOT"),
    (_JOB, "py", 1, 3, None, "", "", "", "df"),
)
_call = lambda text: "sql:substr(sha256('" + text.replace("'", "''") + "'), 1, 16)"
IO_SQL = _rows(
    "source, target, type, confidence_score, line_number, logic_hash, source_module",
    ("s3://bucket/data.csv", _REPORT, "PYTHON_READ", 0.7, 21, _call("pd.read_csv(f'{ROOT}/data.csv')"), _REPORT),
    (_REPORT, "out.parquet", "PYTHON_WRITE", 1.0, 22, _call("df.to_parquet('out.parquet')"), _REPORT),
    *[(f"postgresql:{t}", _DB, "PYTHON_READ", 0.4, 4, _call("engine.execute('SELECT * FROM people JOIN sales ON 1 = 1')"), _DB) for t in ("people", "sales")],
    ("input.parquet", _JOB, "PYTHON_READ", 1.0, 1, _call("spark.read.parquet('input.parquet')"), _JOB),
    (_JOB, "output.parquet", "PYTHON_WRITE", 1.0, 2, _call("df.write.mode('overwrite').save('output.parquet')"), _JOB),
)
YAML_SQL = _rows("source, target, type, confidence_score, source_module", *[("models/schema.yml", f"raw.{t}", "DBT_SOURCE", 1.0, "models/schema.yml") for t in ("sales", "returns")])
# Signatures: classes and functions with their arguments, in order; none is the hash of nothing.
SIGNATURES_SQL = _rows("path, signature_hash", (_REPORT, "sql:sha256('class:Job|func:run(self,day)')"), *[(x, "sql:sha256('')") for x in (_DB, _JOB, _DAG)])
_S, _P, _T = "models/stg_sales.sql", "models/staging/stg_people.sql", "models/marts/totals.sql"
COLUMNS_SQL = _rows(
    "path, target, source",
    *[(_S, c, f"__dbt_source_raw_sales__.{c}") for c in ("id", "amount")],
    *[(_P, c, f"__dbt_source_crm_person_list__.{c}") for c in ("id", "name")],
    (_T, "name", "__dbt_ref_stg_people__.name"),
    *[(_T, c, "__dbt_ref_stg_sales__.amount") for c in ("total", "size")],
    ("jobs/load.sql", "id", "staging.a.id"),
)
OPERATIONS_SQL = _rows(
    "path, type, join_type, function",
    ("jobs/load.sql", "JOIN", "INNER", None), (_T, "JOIN", "LEFT", None), (_T, "GROUP_BY", None, None), (_T, "AGGREGATION", None, "sum"), (_P, "FILTER", None, None),
)
EDGES_SQL = _rows(
    "source, target, type, confidence_score, origin_analyzer",
    ("__dbt_source_raw_sales__", "cte:stg_sales.src", "SQL_INTERNAL", 1.0, "sql"),
    ("cte:stg_sales.src", _S, "SQL_SCOPE_FLOW", 0.9, "sql"),
    ("sales", _S, "DBT_SOURCE", 1.0, "sql"),
    ("list", _P, "DBT_SOURCE", 1.0, "sql"),
    *[(t, _T, "DBT_REF", 1.0, "sql") for t in ("stg_sales", "stg_people")],
    ("__dbt_ref_totals__", "models/marts/ranked.sql", "SQL_READ", 0.3, "sql"),
    *[(t, "jobs/load.sql", "SQL_READ", 1.0, "sql") for t in ("staging.a", "staging.b")],
    ("stg_sales", "jobs/macro.sql", "DBT_REF", 1.0, "sql"),
    *[(t, "jobs/broken.sql", "SQL_READ", 0.3, "sql") for t in ("WHERE", "lost_table")],
    *[(path, "table:" + path.split("/")[-1][:-4], "SQL_PRODUCT", 1.0, "sql") for path, _ in SQL_FILES],
)

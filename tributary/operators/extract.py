"""Extraction from file contents: patterns as SQL expressions, syntax trees as table functions."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tributary.functions import names

REF = r"ref\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
SOURCE = r"source\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)"
VAR = r"var\s*\(\s*['\"]([^'\"]+)['\"]"
MACRO = r"\{\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\("
# Calls that are no macros.
BUILT_IN = ("ref", "source", "var", "config", "log")
FROM, JOIN, INTO = (rf"(?i)\b{w}\s+([A-Za-z_][A-Za-z0-9_.]*)" for w in ("FROM", "JOIN", "INTO"))


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def jinja_refs(files: DataFrame) -> DataFrame:
    """path, name, type of every ref, source, var and macro in templated text."""
    c = F.col("content")
    typed = lambda names_, kind: F.transform(names_, lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type")))
    sources = F.zip_with(all_of(c, SOURCE, 1), all_of(c, SOURCE, 2), lambda a, b: F.concat(a, F.lit("."), b))
    macros = F.filter(all_of(c, MACRO), lambda m: ~m.isin(*BUILT_IN))
    found = F.concat(typed(all_of(c, REF), "dbt_ref"), typed(sources, "dbt_source"), typed(all_of(c, VAR), "dbt_var"), typed(macros, "dbt_macro"))
    return files.select("path", F.explode(found).alias("f")).select("path", "f.name", "f.type")


def mock_jinja(sql: Column) -> Column:
    """Templated SQL to plain SQL: refs and sources to marked names, other blocks to a blank."""
    out = F.regexp_replace(sql, rf"\{{\{{\s*{REF}\s*\}}\}}", "__dbt_ref_$1__")
    out = F.regexp_replace(out, rf"\{{\{{\s*{SOURCE}\s*\}}\}}", "__dbt_source_$1_$2__")
    return F.regexp_replace(out, r"(?s)\{\{.*?\}\}|\{%.*?%\}", " ")


def sql_complexity(sql: Column) -> Column:
    low = F.lower(sql)
    n = lambda p: F.regexp_count(low, F.lit(p))
    score = n(r"\bjoin\b") * 1.0 + (n(r"\bwith\b") + n(r"\bas\s*\(")) * 0.5 + n(r"\bwhen\b") * 0.5 + n(r"\bgroup\s+by\b") * 1.0 + n(r"\bover\b") * 1.5
    return F.greatest(F.lit(1.0), score)


def regex_tables(files: DataFrame) -> DataFrame:
    """Tables named after FROM and JOIN, for SQL that doesn't parse; confidence 0.3."""
    found = F.array_distinct(F.concat(all_of(F.col("content"), FROM), all_of(F.col("content"), JOIN)))
    return files.select(F.explode(found).alias("source"), F.col("path").alias("target"), F.lit(0.3).alias("confidence_score"))


def read_type(table: Column) -> Column:
    return F.when(table.startswith("__dbt_ref_"), "DBT_REF").when(table.startswith("__dbt_source_"), "DBT_SOURCE").otherwise("SQL_READ")


def read_name(table: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(table, r"^__dbt_(ref|source)_", ""), "__$", "")
    return F.when(table.startswith("__dbt_source_"), F.regexp_extract(bare, r"([^_]*)$", 1)).when(table.startswith("__dbt_ref_"), bare).otherwise(table)


def writes(sql: Column, identity: Column) -> Column:
    """Whether SQL makes a table: by its words, or as a model file."""
    return sql.rlike(r"(?i)\b(CREATE|INSERT|UPDATE|MERGE|DELETE)\b") | identity.endswith(".sql")


def product_edges(files: DataFrame) -> DataFrame:
    base = F.regexp_replace(names.basename(F.col("path")), r"\.[^.]*$", "")
    rows = files.where(writes(F.col("content"), F.col("path")))
    return rows.select(F.col("path").alias("source"), F.concat(F.lit("table:"), base).alias("target"), F.lit("SQL_PRODUCT").alias("type"), F.lit(1.0).alias("confidence_score"))


def airflow_edges(files: DataFrame, chained: bool = True) -> DataFrame:
    """Task order from ``a >> b`` and ``a.set_downstream(b)`` in DAG files; confidence 0.8.

    ``chained`` also finds b -> c in a >> b >> c, which needs matches that overlap.
    """
    head = F.substring("content", 1, 2048)
    dags = files.where(F.col("path").endswith(".py") & (head.contains("DAG") | head.contains("airflow")) & head.contains(">>"))
    arrow = r"(\w+)\s*>>\s*(?=(\w+))" if chained else r"(\w+)\s*>>\s*(\w+)"
    down = r"(\w+)\.set_downstream\(\s*(\w+)\s*\)"
    pairs = lambda p: F.zip_with(all_of(F.col("content"), p, 1), all_of(F.col("content"), p, 2), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    found = F.array_distinct(F.concat(pairs(arrow), pairs(down)))
    return dags.select("path", F.explode(found).alias("e")).select("e.source", "e.target", F.lit("CONFIG_DEPENDENCY").alias("type"), F.lit(0.8).alias("confidence_score"), F.col("path").alias("source_module"))


# Table functions over syntax trees.  Each parses a file once for what it yields.


def _tree(content: str | None) -> ast.Module | None:
    try:
        return ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def _branches(node: ast.AST) -> int:
    kinds = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.match_case)
    return sum(isinstance(n, kinds) for n in ast.walk(node) if n is not node)


def _paragraph(doc: str | None) -> str | None:
    return doc.strip().split("\n\n")[0].strip() if doc and doc.strip() else None


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    return node.id if isinstance(node, ast.Name) else ""


@udtf(returnType="name string, signature string, docstring string, complexity int, is_nested boolean, decorators array<string>, line int")
class PythonFunctions:
    """Every function of a Python file."""

    def eval(self, content: str) -> Iterator[tuple]:
        tree = _tree(content)
        if tree is None:
            return
        inner = {id(c) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for c in ast.walk(n) if c is not n}
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield n.name, f"{n.name}({ast.unparse(n.args)})", _paragraph(ast.get_docstring(n)), 1 + _branches(n), id(n) in inner, [ast.unparse(d) for d in n.decorator_list], n.lineno


@udtf(returnType="docstring string")
class PythonDocstring:
    """A Python file's own docstring without blanks and quotes around it; no row without one."""

    def eval(self, content: str) -> Iterator[tuple]:
        tree = _tree(content)
        doc = ast.get_docstring(tree, clean=False) if tree else None
        if doc is not None:
            yield (doc.strip("\"' \n\t"),)


@udtf(returnType="name string, type string, line int")
class PythonImports:
    """Imported modules, those under another name included."""

    def eval(self, content: str) -> Iterator[tuple]:
        tree = _tree(content)
        for n in ast.walk(tree) if tree else ():
            if isinstance(n, ast.Import):
                for a in n.names:
                    yield a.name, "python_import", n.lineno
            elif isinstance(n, ast.ImportFrom):
                yield "." * n.level + (n.module or ""), "python_import", n.lineno


@udtf(returnType="name string, bases array<string>, line int")
class PythonClasses:
    def eval(self, content: str) -> Iterator[tuple]:
        tree = _tree(content)
        for n in ast.walk(tree) if tree else ():
            if isinstance(n, ast.ClassDef):
                yield n.name, [_dotted(b) for b in n.bases if _dotted(b)], n.lineno


@udtf(returnType="name string, value string")
class PythonConstants:
    """Module-level names and their string values (null for others)."""

    def eval(self, content: str) -> Iterator[tuple]:
        tree = _tree(content)
        for n in tree.body if tree else ():
            if isinstance(n, ast.Assign):
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        yield t.id, n.value.value if isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) else None


# Calls that read or write data.
PANDAS = {f"{way}_{kind}" for way in ("read", "to") for kind in ("csv", "excel", "parquet", "sql", "json")}
SPARK_STEPS = {"mode", "format", "option", "options", "partitionBy", "bucketBy", "sortBy", "schema"}
SQL_WORDS = re.compile(r"\b(SELECT|INSERT|UPDATE|DELETE|FROM|JOIN|INTO)\b", re.I)


def _resolved(node: ast.AST, known: dict[str, str]) -> tuple[str, float] | None:
    """A string argument's value and how sure it is: 1 literal, 0.7 by name, 0.3 with parts unknown."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value, 1.0
    if isinstance(node, ast.Name):
        return (known[node.id], 0.7) if node.id in known else None
    if isinstance(node, ast.JoinedStr):
        parts, sure = [], 0.7
        for v in node.values:
            if isinstance(v, ast.Constant):
                parts.append(str(v.value))
            elif isinstance(v, ast.FormattedValue) and isinstance(v.value, ast.Name) and v.value.id in known:
                parts.append(known[v.value.id])
            else:
                parts.append("{" + ast.unparse(v.value) + "}")
                sure = 0.3
        return "".join(parts), sure
    return None


@udtf(returnType="dataset string, is_write boolean, confidence double, line int, logic_hash string")
class PythonDataflow:
    """Datasets that a Python file reads and writes.

    ``shared`` holds constants of other files (name -> value); the file's own win.
    """

    def eval(self, content: str, shared: dict) -> Iterator[tuple]:
        tree = _tree(content)
        if tree is None:
            return
        known = dict(shared or {})
        for n in tree.body:
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
                known |= {t.id: n.value.value for t in n.targets if isinstance(t, ast.Name)}
        engines = {}
        for n in ast.walk(tree):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and _dotted(n.value.func).split(".")[-1] == "create_engine" and n.value.args:
                found = _resolved(n.value.args[0], known)
                if found and "://" in found[0]:
                    engines |= {t.id: re.split(r"[+:]", found[0])[0] for t in n.targets if isinstance(t, ast.Name)}
        for n in sorted((n for n in ast.walk(tree) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset)):
            func = _dotted(n.func)
            last = func.split(".")[-1]
            found = _resolved(n.args[0], known) if n.args else None
            if not found:
                continue
            text, sure = found
            digest = hashlib.sha256(" ".join(ast.unparse(n).split()).encode()).hexdigest()[:16]
            if last in PANDAS:
                yield text, last.startswith("to_"), sure, n.lineno, digest
            elif (".read." in f".{func}" or ".write." in f".{func}") and last not in SPARK_STEPS:
                yield text, ".read." not in f".{func}", sure, n.lineno, digest
            elif last == "execute" and SQL_WORDS.search(text):
                owner = func.split(".")[0] if "." in func else None
                dialect = engines.get(owner) or next(iter(engines.values()), None)
                for pattern, write in ((FROM, False), (JOIN, False), (INTO, True)):
                    for table in re.findall(pattern, text):
                        yield f"{dialect}:{table}" if dialect else table, write, sure * 0.4, n.lineno, digest


def python_edges(files: DataFrame, constants: DataFrame | None = None) -> DataFrame:
    """Typed read and write edges of Python files (path, content).

    constants: name, value, seq of all files; of several values the last counts.
    A file gets those whose names it holds as words.
    """
    spark = files.sparkSession
    spark.udtf.register("python_dataflow", PythonDataflow)
    shared = F.create_map().cast("map<string,string>")
    rows = files.where(F.col("path").endswith(".py"))
    if constants is not None:
        last = constants.where("value is not null").groupBy("name").agg(F.max_by("value", "seq").alias("value"))
        words = rows.select("path", F.explode(F.array_distinct(all_of(F.col("content"), r"\b([A-Za-z_]\w*)"))).alias("name"))
        held = words.join(last, "name").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("shared"))
        rows = rows.join(held, "path", "left").withColumn("shared", F.coalesce("shared", shared))
    else:
        rows = rows.withColumn("shared", shared)
    rows.createOrReplaceTempView("__python_files")
    flow = spark.sql("select path, d.* from __python_files, lateral python_dataflow(content, shared) d")
    return flow.select(
        F.when(F.col("is_write"), F.col("path")).otherwise(F.col("dataset")).alias("source"),
        F.when(F.col("is_write"), F.col("dataset")).otherwise(F.col("path")).alias("target"),
        F.when(F.col("is_write"), "PYTHON_WRITE").otherwise("PYTHON_READ").alias("type"),
        F.col("confidence").alias("confidence_score"),
        F.col("line").alias("line_number"),
        "logic_hash",
        F.col("path").alias("source_module"),
    )


@udtf(returnType="source string, dataset string, type string, confidence double")
class YamlSources:
    """Tables that a YAML file's ``sources`` declare."""

    def eval(self, path: str, content: str) -> Iterator[tuple]:
        import yaml

        try:
            parsed = yaml.safe_load(content or "")
        except yaml.YAMLError:
            return
        for source in (parsed or {}).get("sources") or [] if isinstance(parsed, dict) else []:
            for table in (source or {}).get("tables") or []:
                if isinstance(table, dict) and table.get("name"):
                    yield path, f"{source.get('name')}.{table['name']}", "DBT_SOURCE", 1.0


@udtf(returnType="ast_hash string, signature_hash string")
class PythonHashes:
    """Hash of the syntax tree (comments don't count) and of the signatures (bodies don't)."""

    def eval(self, content: str) -> Iterator[tuple]:
        tree = _tree(content)
        if tree is None:
            plain = hashlib.sha256((content or "").encode()).hexdigest()
            yield plain, plain
            return
        marks = [f"func:{n.name}({','.join(a.arg for a in n.args.args)})" for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]
        marks += [f"class:{n.name}" for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
        yield hashlib.sha256(ast.dump(tree).encode()).hexdigest(), hashlib.sha256("|".join(sorted(marks)).encode()).hexdigest()


def apply_udtf(files: DataFrame, function, *columns: str) -> DataFrame:
    """path and the table function's columns, for every file."""
    spark: SparkSession = files.sparkSession
    name = f"__{function.func.__name__.lower()}" if hasattr(function, "func") else "__udtf"
    spark.udtf.register(name, function)
    files.createOrReplaceTempView(f"{name}_files")
    return spark.sql(f"select path, d.* from {name}_files, lateral {name}({', '.join(columns or ('content',))}) d")


# Plug-ins of configuration parsers, each a predicate and what it yields.
def config_edges(files: DataFrame, plugins: list | None = None) -> DataFrame:
    """Edges of every parser whose predicate holds; plug-ins are functions of the files table."""
    out = None
    for plugin in plugins or [airflow_edges, yaml_edges]:
        edges = plugin(files).select("source", "target", "type", "confidence_score", "source_module")
        out = edges if out is None else out.unionByName(edges)
    return out


def yaml_edges(files: DataFrame) -> DataFrame:
    found = apply_udtf(files.where(F.col("path").rlike(r"\.ya?ml$")), YamlSources, "path", "content")
    return found.select("source", F.col("dataset").alias("target"), "type", F.col("confidence").alias("confidence_score"), F.col("path").alias("source_module"))

"""Column functions over dataset names, module paths and confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that name normalisation drops, by rule set.
EXTENSIONS = r"\.(csv|parquet|json|avro|delta|txt|orc|iceberg|hudi|sql)$"
SHORT_EXTENSIONS = r"\.(csv|parquet|sql|json|delta|avro|txt|db)$"
# Namespace synonyms.
NAMESPACES = {
    "postgresql": "postgres",
    "pg": "postgres",
    "snowflake": "sf",
    "s3a": "s3",
    "s3n": "s3",
    "google_cloud_storage": "gcs",
    "local_fs": "local",
    "filesystem": "local",
}
# Directories that tell a layer, in order of precedence.
LAYER_FOLDERS = (("agents", "agent"), ("models", "model"), ("utils", "utility"), ("graph", "graph"), ("analyzers", "analyzer"))
# Purposes by a file's name, in order of precedence.
PURPOSES = (
    (r"__init__\.py$", "Package initialization: Defines the module structure and exposes public interfaces for this directory."),
    (r"\.(toml|yml|yaml)$", "Configuration file: Defines project settings, dependencies, or environment-specific parameters."),
    (r"\.md$", "Documentation: Provides high-level project information, instructions, or architectural context."),
    (r"\.env", "Environment variables: Manages secrets and environment-specific configurations."),
    (r"\.(json|txt)$", "Data/Static resource: Stores structured data or plain text used by the system."),
)


def _unquoted(c: Column) -> Column:
    for q in ('"', "'", "`"):
        c = F.regexp_replace(c, f"^{q}+|{q}+$", "")
    return c


def _without_protocol(c: Column) -> Column:
    return F.regexp_replace(c, r"^.*://", "")


def normalize(raw: Column) -> Column:
    """Dataset name without protocol, quotes, known extension and last slashes; 'unknown' if empty."""
    name = F.regexp_replace(_unquoted(F.lower(_without_protocol(raw))), EXTENSIONS, "")
    return F.when(F.coalesce(raw, F.lit("")) == "", "unknown").otherwise(F.regexp_replace(name, "/+$", ""))


def namespace(ns: Column) -> Column:
    low = F.lower(ns)
    table = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, low), low)


def canonicalize(raw: Column, ns: Column) -> Column:
    return F.concat(namespace(ns), F.lit(":"), normalize(raw))


def simplify_path(path: Column) -> Column:
    """Partition values and date folders become asterisks."""
    return F.regexp_replace(F.regexp_replace(path, r"([a-zA-Z0-9_-]+=)[a-zA-Z0-9_-]+", "$1*"), r"/\d{4}/\d{2}/\d{2}/", "/*/*/*/")


def short_name(raw: Column) -> Column:
    """The last telling part of a dataset's name, across file stores and databases."""
    name = _unquoted(F.lower(raw))
    ref = F.regexp_replace(F.regexp_replace(name, "^__dbt_ref_", ""), "__$", "")
    src = F.regexp_replace(F.regexp_replace(name, "^__dbt_source_", ""), "__$", "")
    src = F.when(src.contains("."), src).otherwise(F.regexp_extract(src, r"([^_]*)$", 1))
    name = F.when(name.startswith("__dbt_ref_"), ref).when(name.startswith("__dbt_source_"), src).otherwise(name)
    name = _without_protocol(name)
    name = F.regexp_extract(name, r"([^/]*)/?$", 1)
    return F.regexp_extract(F.regexp_replace(name, SHORT_EXTENSIONS, ""), r"([^.]*)$", 1)


def components(raw: Column) -> Column:
    """struct(database, schema_, table)."""
    clean = _without_protocol(_unquoted(F.lower(raw)))
    base = F.regexp_extract(clean, r"([^/]*)$", 1)
    stem = F.when(base.rlike(r"^[^.].*\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    clean = F.when(clean.contains("/"), stem).otherwise(clean)
    parts = F.split(clean, r"\.")
    n = F.size(parts)
    return F.struct(
        F.when(n >= 3, F.try_element_at(parts, F.lit(-3))).alias("database"),
        F.when(n >= 3, F.try_element_at(parts, F.lit(-2))).when(n == 2, parts[0]).alias("schema_"),
        F.when(n >= 2, F.try_element_at(parts, F.lit(-1))).otherwise(clean).alias("table"),
    )


def sql_logic_hash(sql: Column) -> Column:
    plain = F.regexp_replace(sql, r"__dbt_(?:ref|source)_(\w+?)__", "$1")
    text = F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))
    return F.when(F.coalesce(sql, F.lit("")) == "", "unknown").otherwise(F.substring(F.sha2(text, 256), 1, 16))


def python_logic_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def is_module(identity: Column) -> Column:
    return identity.rlike(r"\.(py|sql|yml|yaml)$")


def is_dataset(identity: Column) -> Column:
    return ~identity.startswith("cte:") & (identity.contains(":") | ~is_module(identity))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def language(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)


def informational(identity: Column) -> Column:
    base = F.lower(basename(identity))
    plain = base.rlike(r"\.(md|txt|csv|json|yml|yaml)$") | base.isin("license", ".gitignore", ".gitkeep")
    data = identity.rlike("^(seeds|data)/")
    runs = ~base.isin(".gitkeep", "readme.md") & ~base.endswith(".md")
    return F.when(data & runs, F.lit(False)).otherwise(plain)


def layer(identity: Column) -> Column:
    """Architecture layer, by the first rule that holds."""
    base = F.lower(basename(identity))
    info = base.rlike(r"\.(md|txt|csv|json|yml|yaml)$") | base.isin("license", ".gitignore", ".gitkeep")
    out = F.when(identity.rlike("^(seeds|data)/"), "raw")
    out = out.when(info & base.rlike(r"\.(yml|yaml)$"), "tooling").when(info, "meta")
    out = out.when(identity.contains("staging/"), "staging").when(identity.rlike("models/marts/|^models/"), "product")
    for folder, name in LAYER_FOLDERS:
        out = out.when(identity.contains(f"/{folder}/"), name)
    out = out.when(identity.contains("tests/"), "test").when(identity.startswith("src/") | base.endswith(".py"), "core")
    return out.when(base.endswith(".toml"), "tooling").otherwise("unknown")


def system(raw: Column, ns: Column, mapped: Column | None = None, discovered: Column | None = None) -> Column:
    """What kind of store a dataset lives in."""
    found = F.lit(False) if discovered is None else discovered
    by_name = reduce(
        lambda w, p: w.when(raw.contains(p[0]), p[1]),
        [("gs://", "gcs"), ("snowflake://", "snowflake"), ("postgres://", "postgres"), ("bigquery.", "bigquery"), (".parquet", "parquet"), (".csv", "csv")],
        F.when(raw.contains("s3://"), "s3"),
    ).otherwise("unknown")
    first = ns if mapped is None else F.coalesce(mapped, ns)
    guess = F.when(first == "unknown", by_name).otherwise(first)
    guess = F.when(raw.endswith(".sql") | found, "dbt").otherwise(guess)
    guess = F.when(F.lower(raw).contains("raw_") & ~found, "warehouse").otherwise(guess)
    return F.when(ns != "unknown", ns).otherwise(guess)


def environment(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.contains("dev"), "development").when(low.contains("qa"), "qa").when(low.rlike("staging|stg"), "staging").otherwise("production")


def dataset_type(kind: Column) -> Column:
    return F.when(kind.isin("s3", "gcs"), "object_storage").when(kind.isin("csv", "parquet", "json", "delta"), "file_dataset").otherwise("database_table")


def is_dynamic(raw: Column, confidence: Column) -> Column:
    return raw.contains("{") | raw.contains("$") | (confidence < 0.5)


def dataset_confidence(n_columns: Column, inferred: Column, dynamic: Column) -> Column:
    known = F.when(n_columns > 0, 1.0).when(inferred, 0.7).otherwise(0.5)
    return F.when(dynamic, 0.4).otherwise(known)


def table_name(raw: Column) -> Column:
    base = basename(raw)
    stem = F.when(base.rlike(r"^[^.].*\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    return F.when(raw.contains("/"), stem).otherwise(raw)


def edge_confidence(confidence: Column, source_module: Column, source: Column, target: Column) -> Column:
    """Lower without a source module, and where an end is unknown; two decimals."""
    c = confidence * F.when(F.coalesce(source_module, F.lit("")) == "", 0.8).otherwise(1.0)
    return F.round(c * F.when(source.contains("unknown") | target.contains("unknown"), 0.7).otherwise(1.0), 2)


def decay(distance: Column) -> Column:
    return F.pow(F.lit(1.5), -distance)


def citation(source: Column, method: Column, confidence: Column, line: Column) -> Column:
    known = F.when(method.isin("static_analysis", "llm_inference"), method).otherwise("static_analysis")
    return F.struct(source.alias("source"), known.alias("method"), F.round(confidence, 2).alias("confidence"), line.alias("line"))


def citation_confidence(distance: Column) -> Column:
    return F.greatest(F.lit(0.3), F.lit(1.0) - F.lit(0.2) * distance)


def importance(rank: Column, least: Column, most: Column, raw_data: Column) -> Column:
    """PageRank on a scale from 1 to 100; raw data has at least 20."""
    scaled = F.when((rank > 0) & (most > least), F.least(F.lit(100), F.greatest(F.lit(1), F.lit(1) + F.floor((rank - least) / (most - least) * 99)))).otherwise(1)
    return F.when(raw_data, F.greatest(F.lit(20), scaled)).otherwise(scaled).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(fits, dot(a, b) / F.when(size > 0, size)).otherwise(0.0)


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlaps."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("long")


def keyword_score(terms: Column, weighted: list[tuple[Column, int]]) -> Column:
    """Sum over the terms of weight times occurrences in each lower-cased text."""
    per_term = lambda t: sum((occurrences(F.lower(F.coalesce(c, F.lit(""))), t) * w for c, w in weighted), F.lit(0))
    return F.aggregate(F.transform(terms, per_term), F.lit(0).cast("long"), lambda s, v: s + v)


def terms(question: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(question)), r"\s+"), lambda t: t != "")


def heuristic_purpose(path: Column, doc: Column, functions: Column, imports: Column) -> Column:
    """struct(purpose, confidence) without a language model."""
    named = F.when(F.size(functions) > 0, F.array_join(F.slice(functions, 1, 2), ", ")).otherwise("system coordination")
    listed = F.concat(
        F.lit("Inferred purpose: This module manages "), F.size(functions).cast("string"), F.lit(" functions and imports "),
        F.size(imports).cast("string"), F.lit(" dependencies. Key features likely include "), named, F.lit("."),
    )
    by_path = reduce(lambda w, p: w.when(F.lower(path).rlike(p[0]), p[1]), PURPOSES[1:], F.when(F.lower(path).rlike(PURPOSES[0][0]), PURPOSES[0][1])).otherwise("Unknown purpose (Fallback enabled)")
    has_doc, has_code = F.coalesce(doc, F.lit("")) != "", (F.size(functions) > 0) | (F.size(imports) > 0)
    text = F.when(has_doc, F.concat(F.lit("Estimated purpose: "), doc)).when(has_code, listed).otherwise(by_path)
    return F.struct(text.alias("purpose"), F.when(has_doc, 0.4).when(has_code, 0.2).otherwise(0.1).alias("confidence"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def token_cost(tokens: Column) -> Column:
    return tokens / 1e6 * 0.15


def cluster_count(n: int) -> int:
    """Domains for n modules: one below four, else a third of them, two to eight."""
    return 1 if n < 4 else min(8, max(2, n // 3), n)


def is_remote(url: Column) -> Column:
    return url.rlike(r"^(https?://|git@|ssh://|git://)")


def clone_name(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 8)


def resolve_canonical(raw: Column, mapping: dict[str, str] | None = None) -> Column:
    """The short name that a mapping of one's own gives, else the usual one."""
    own = F.lit(None).cast("string")
    for name, canonical in (mapping or {}).items():
        own = F.when(raw == name, canonical).otherwise(own)
    return F.coalesce(own, short_name(raw))


def clock_label(ts: Column) -> Column:
    """A time as a reader sees it; a dash where there is none."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("—"))


def short_label(path: Column) -> Column:
    """The last two parts of a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(path)


def fenced_json(reply: Column) -> Column:
    """What stands in the first fenced block of a reply, or the reply itself."""
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(reply), r"^\s+|\s+$", "")

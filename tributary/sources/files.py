"""Source repositories, version control history, and stored graphs as tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import names

# Folders that scans leave out.
PRUNED = (".git", ".venv", ".cartography", "artifacts", "__pycache__", "node_modules", "dist")
COMMITS = "sha string, author string, ts timestamp, path string, status string, added int, deleted int"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """identity, content, language, layer, is_informational, seq of every file below root.

    Files that are no UTF-8 are left out.
    """
    base = root.rstrip("/")
    read = spark.read.format("binaryFile")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + _quoted(base) + "/", "")
    pruned = "(^|/)(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/"
    # Names first, as what is left out may be large; then the content of the rest.
    there = read.option("recursiveFileLookup", True).load(base).select("path", path.alias("identity"))
    there = there.where(~F.col("identity").rlike(pruned) & (names.basename(F.col("identity")) != ".gitkeep"))
    kept = [_unglobbed(r["path"]) for r in there.select("path").toLocalIterator()]
    raw = read.load(kept) if kept else spark.createDataFrame([], "path string, content binary")
    files = raw.select(path.alias("identity"), F.expr("try_validate_utf8(cast(content as string))").alias("content")).where("content is not null")
    return files.select(
        "identity",
        F.col("identity").alias("path"),
        "content",
        names.language(F.col("identity")).alias("language"),
        names.layer(F.col("identity")).alias("layer"),
        names.informational(F.col("identity")).alias("is_informational"),
    )


def _unglobbed(path: str) -> str:
    """A path whose letters stand for themselves in a reader's pattern."""
    import re

    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def _quoted(text: str) -> str:
    import re

    return re.escape(re.sub(r"^[a-z]+:/*", "/", text))


def in_reading_order(files: DataFrame) -> DataFrame:
    """seq, a key to order files by: SQL first and of it staging-like, then the deeper, then by name.

    A key, not a number, so that no task has to see all files.
    """
    path = F.col("path")
    staging = F.lower(path).rlike("staging|stg|base|src|seed")
    key = F.struct((~path.endswith(".sql")).alias("other"), (~staging).alias("late"), (-F.size(F.split(path, "/"))).alias("depth"), path.alias("path"))
    return files.withColumn("seq", key)


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else ""


def head(root: str) -> str:
    return _git(root, "rev-parse", "HEAD").strip() or "unknown"


def git_log(spark: SparkSession, root: str, days: int = 30, merges: bool = False) -> DataFrame:
    """One row for each file of each commit.  Line counts are null for binary files.

    Two listings of one log are joined: line counts, and statuses with renames
    under their new path.
    """
    mark = "\x02%H\x01%an\x01%cI"
    args = ["log", f"--since={days}.days.ago", *([] if merges else ["--no-merges"]), "-w", "-M"]
    counts, status = (_git(root, *args, f"--format={mark}", "-z", kind) for kind in ("--numstat", "--name-status"))
    return spark.createDataFrame(parse_log(counts, status), "sha string, author string, stamp string, path string, status string, added int, deleted int").withColumn("ts", F.to_timestamp("stamp")).select("sha", "author", "ts", "path", "status", "added", "deleted")


def parse_log(counts: str, status: str) -> list[tuple]:
    """Rows of a numstat and a name-status listing, both null-separated."""
    kinds: dict[tuple, str] = {}
    for block in status.split("\x02")[1:]:
        lead, *fields = block.split("\0")
        sha = lead.split("\x01")[0]
        fields = [f.lstrip("\n") for f in fields if f.strip()]
        at = 0
        while at < len(fields):
            kind = fields[at][:1]
            at += 2 if kind in "RC" else 1
            if at < len(fields):
                kinds[sha, fields[at]] = kind
            at += 1
    out = []
    for block in counts.split("\x02")[1:]:
        lead, *fields = block.split("\0")
        sha, author, stamp = lead.strip().split("\x01")
        fields = [f.lstrip("\n") for f in fields if f.strip()]
        at = 0
        while at < len(fields):
            added, deleted, path = (fields[at].split("\t") + ["", ""])[:3]
            at += 1
            if not path and at + 1 < len(fields) + 1:
                path = fields[at + 1] if at + 1 < len(fields) else fields[at]
                at += 2
            number = lambda x: int(x) if x.isdigit() else None
            out.append((sha, author, stamp, path, kinds.get((sha, path), "M"), number(added), number(deleted)))
    return out


def changed_since(spark: SparkSession, root: str, sha: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _git(root, "diff", "--name-only", sha, "HEAD").splitlines()], "path string")


def clone(url: str, folder: str) -> str:
    """Clone, shallow, to a folder named by the URL's hash; pull if it is there, and clone anew if that fails."""
    import hashlib
    import shutil
    from pathlib import Path

    to = Path(folder) / hashlib.md5(url.encode()).hexdigest()[:8]
    if to.exists() and subprocess.run(["git", "-C", str(to), "pull", "--ff-only"], capture_output=True, check=False, timeout=180).returncode == 0:
        return str(to)
    shutil.rmtree(to, ignore_errors=True)
    subprocess.run(["git", "clone", "--depth", "1", url, str(to)], check=True, capture_output=True, timeout=180)
    return str(to)


def seeds(files: DataFrame) -> DataFrame:
    """Seed data sets: CSV files in a seeds folder, whose system is dbt."""
    hit = files.where(F.concat(F.lit("/"), "path").contains("/seeds/") & F.col("path").endswith(".csv"))
    return hit.select(names.table_name(F.col("path")).alias("dataset"), F.lit("dbt").alias("system"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a stored graph: Parquet tables, or JSON in either of two layouts."""
    try:
        return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    except Exception:  # noqa: BLE001  not stored as tables
        raw = spark.read.json(path, multiLine=True)
    edges = raw.select(F.explode("edges").alias("e")).select("e.*")
    top = raw.schema["nodes"].dataType if "nodes" in raw.columns else None
    if top is not None and hasattr(top, "elementType"):
        return raw.select(F.explode("nodes").alias("n")).select("n.*"), edges
    keys = [f"nodes.{k}" for k in (x.name for x in top)] if top is not None else [c for c in raw.columns if c.endswith("_nodes")]
    parts = [raw.select(F.explode(k).alias("n")).select("n.*") for k in keys]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p, allowMissingColumns=True)
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one of the schema if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("module string, purpose string, layer string, domain string").json(path, multiLine=True)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON-lines log; broken lines are left out."""
    schema = "schema_version string, timestamp timestamp, agent string, event_type string, target_file string, method string, confidence double, duration_ms long, metadata map<string,string>"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def artifact(root: str, catalog: dict[str, str], key: str, default: str) -> str:
    """Where an artifact lies: by the catalogue, else the newest of its name, else the default."""
    from pathlib import Path

    named = catalog.get(key)
    if named and Path(root, named).exists():
        return str(Path(root, named))
    stem, suffix = Path(default).stem, Path(default).suffix
    newest = sorted(Path(root, "artifacts").glob(f"*{stem}*{suffix}"), key=lambda p: p.stat().st_mtime)
    return str(newest[-1] if newest else Path(root, default))


def evidence(files: DataFrame, characters: int = 4000) -> DataFrame:
    """The beginning of each file, as evidence for what is said about it."""
    return files.select("path", F.substring("content", 1, characters).alias("evidence"))

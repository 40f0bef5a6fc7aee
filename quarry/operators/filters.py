"""Predicates and filters."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import wildcard as W
from quarry.functions.bounded import small
from quarry.session import stored

# Default extension list (34 entries) and the language presets.
DEFAULT_EXTENSIONS = [
    ".py", ".md", ".yaml", ".yml", ".json", ".js", ".ts",
    ".jsx", ".tsx", ".cpp", ".c", ".h", ".hpp", ".cs",
    ".java", ".go", ".rs", ".rb", ".php", ".swift", ".kt",
    ".css", ".scss", ".sass", ".html", ".xml", ".sql",
    ".txt", ".toml", ".ini", ".cfg", ".sh", ".bat", ".ps1",
]
EXTENSION_PRESETS = {
    "Python": [".py", ".md", ".yaml", ".yml", ".json", ".txt", ".toml", ".ini", ".cfg", ".sh"],
    "Web": [".js", ".ts", ".jsx", ".tsx", ".html", ".css", ".scss", ".sass", ".json", ".md"],
    "C/C++": [".c", ".cpp", ".h", ".hpp", ".md", ".txt", ".cmake"],
    "Java": [".java", ".xml", ".json", ".md", ".properties", ".yaml", ".yml"],
    "Go": [".go", ".mod", ".sum", ".md", ".yaml", ".yml", ".json"],
    "Rust": [".rs", ".toml", ".md", ".json"],
}
SEARCH_EXTENSIONS = [".py", ".js", ".ts", ".md", ".txt", ".json", ".yaml"]
MAX_READ_BYTES = 1024 * 1024
INDEX_MAX_CHARS = 50000
TOOL_TEXT_MIN_CHARS = 100
PATH_MATCH_SCORE = 0.5
VALID_ROLES = ("user", "assistant")
# Name of the per-project config file that marks a project folder.
PROJECT_CONFIG_FILE = ".project.yaml"


def ext_predicate(path_col, extensions) -> F.Column:
    """Case-sensitive ``endswith`` any of the extensions."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    exts = list(dict.fromkeys(extensions))
    if not exts:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.endswith(e) for e in exts])


def extension_filter(files: DataFrame, extensions=None, include_py: bool = False) -> DataFrame:
    exts = list(extensions if extensions is not None else DEFAULT_EXTENSIONS)
    if include_py:
        exts.append(".py")
    return files.where(ext_predicate("path", exts))


def presets_table(spark: SparkSession) -> DataFrame:
    """Fixed (preset, ext) dimension table (48 rows)."""
    rows = [(name, e) for name, exts in EXTENSION_PRESETS.items() for e in exts]
    return spark.createDataFrame(rows, "preset string, ext string")


def preset_matches(files: DataFrame, presets: DataFrame) -> DataFrame:
    """Files whose extension belongs to each preset. The preset table has a
    fixed size, so broadcasting it is safe and the files never shuffle."""
    f = files.select("project", "path", P.suffix("path").alias("ext"))
    return f.join(F.broadcast(presets), "ext").select("preset", "project", "path")


def ignore_filter(files: DataFrame, patterns, always=W.ALWAYS_IGNORED, path_col: str = "path") -> DataFrame:
    """Drop files matched by ignore rules (including pruned directories)."""
    rules = W.compile_rules(patterns, always)
    return files.where(~W.ignored(F.col(path_col), rules))


def compiled_rules(rules: DataFrame, projects: DataFrame, always=W.ALWAYS_IGNORED) -> DataFrame:
    """Rule lines (project, position, line) as (project, position, regex, negated); comments and blank
    lines go. ``always``: lines that each of ``projects`` has after its own."""

    def run(batches):
        for b in batches:
            rows = []
            for project, position, line in zip(*(b.column(i).to_pylist() for i in range(3))):
                rule = W.compile_rule(line or "")
                if rule is not None:
                    rows.append((project, position, rule.regex, not rule.ignore))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["project", "position", "regex", "negated"])

    own = rules.select("project", F.col("position").cast("long").alias("position"), "line")
    for k, line in enumerate(always):
        own = own.unionByName(projects.select("project").distinct().select("project", F.lit((1 << 40) + k).cast("long").alias("position"), F.lit(line).alias("line")))
    return own.mapInArrow(run, "project string, position long, regex string, negated boolean")


def project_ignore_filter(files: DataFrame, rules: DataFrame, always=W.ALWAYS_IGNORED, prune: bool = True) -> DataFrame:
    """P3/P4 with rules as data: every project has a rule list of its own (project, position, line).

    Paths and, with ``prune``, their distinct folders meet the rules of their project; the
    matching rule of greatest position decides. A file goes if it is ignored or lies below an
    ignored folder, whatever later rules say of it."""
    compiled = stored(compiled_rules(rules, files, always), "rules")
    nodes = files.select("project", F.col("path").alias("node"))
    if prune:
        nodes = nodes.unionByName(files.select("project", F.explode(W.dir_prefixes(F.col("path"))).alias("node")))
    met = nodes.distinct().join(small(compiled), "project").where(F.rlike("node", F.col("regex")))
    last = met.groupBy("project", "node").agg(F.max_by("negated", "position").alias("negated"))
    gone = stored(last.where(~F.col("negated")).select("project", "node"), "ignored")
    left = files.join(small(gone), (files["project"] == gone["project"]) & (files["path"] == gone["node"]), "left_anti")
    if not prune:
        return left
    below = left.select("project", "path", F.explode(W.dir_prefixes(F.col("path"))).alias("node"))
    below = below.join(small(gone.where(F.endswith("node", F.lit("/")))), ["project", "node"], "left_semi").select("project", "path").distinct()
    return left.join(small(below), ["project", "path"], "left_anti")


def exclude_filter(files: DataFrame, patterns, path_col: str = "path") -> DataFrame:
    """Exclude spec on the relative posix path (no always-ignored entries and no
    directory pruning: the spec is tested against the file path only)."""
    rules = W.compile_rules(patterns, ())
    return files.where(~W.matches(P.to_posix(F.col(path_col)), rules))


def scan_scope(files: DataFrame, scope: str = "", groups=("venv", "pycache", "git", "node"), custom=(),
               extensions=None, config_file: str = PROJECT_CONFIG_FILE) -> DataFrame:
    """P5: files under ``scope`` that survive the toggled default groups and custom
    rules (matched relative to the scope), carry an included extension and are
    not the config file."""
    lines = [p for g in groups for p in W.DEFAULT_GROUPS[g]] + [c.strip() for c in custom if c.strip()]
    rules = W.compile_rules(lines)
    prefix = scope.strip("/") + "/" if scope.strip("/") else ""
    rel = F.substring(F.col("path"), len(prefix) + 1, 1 << 30) if prefix else F.col("path")
    exts = extensions if extensions is not None else DEFAULT_EXTENSIONS
    out = files.where(F.col("path").startswith(prefix) if prefix else F.lit(True))
    out = out.where(~W.ignored(rel, rules) & ext_predicate("path", exts) & ~F.col("path").contains(config_file))
    return out.select("project", "path")


def name_search(files: DataFrame, query: str, extensions=None) -> DataFrame:
    """Case-insensitive substring of the base name, within the extension list."""
    exts = extensions if extensions is not None else SEARCH_EXTENSIONS
    return files.where(
        F.lower(P.basename("path")).contains(query.lower()) & ext_predicate("path", exts)
    ).select("project", "path")


def path_search(store: DataFrame, query: str, n: int | None = None) -> DataFrame:
    """Path substring fallback search, fixed score, non-empty content, the first n
    in store order (``ord``) of each project if n is given."""
    from pyspark.sql import Window

    hits = store.where(F.lower("path").contains(query.lower()) & (F.length("content") > 0))
    if n is None:
        return hits.select("project", "path", "content", F.lit(PATH_MATCH_SCORE).alias("score"))
    w = Window.partitionBy("project").orderBy("ord")
    return (
        hits.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= n)
        .select("project", "path", "content", F.lit(PATH_MATCH_SCORE).alias("score"))
    )


def size_guards(df: DataFrame, text_col: str = "content") -> DataFrame:
    """The three guards as boolean columns."""
    t = F.col(text_col)
    return df.withColumns(
        {
            "readable": F.octet_length(t) <= MAX_READ_BYTES,
            "indexable": (F.length(t) >= 1) & (F.length(t) <= INDEX_MAX_CHARS),
            "ingestable": F.length(t) >= TOOL_TEXT_MIN_CHARS,
        }
    )


def hidden_filter(files: DataFrame) -> DataFrame:
    """Drop files with any path component starting with '.'."""
    return files.where(~P.is_hidden("path"))


def unsafe_paths(df: DataFrame, path_col: str = "path") -> DataFrame:
    """P10: restore and patch guards with a reason column."""
    p = F.col(path_col)
    n = P.normalize_path(p)
    reason = (
        F.when(n.startswith(".."), "escapes_root")
        .when(n.startswith("/"), "absolute")
        .when(p.contains(".."), "dotdot")
        .when(p.startswith("\\"), "absolute")
    )
    return df.withColumns(
        {"restore_safe": ~P.restore_unsafe(p), "patch_safe": ~P.patch_unsafe(p), "reason": reason}
    )


def project_search_scope(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """Folders within ``max_depth`` that contain no skipped folder name."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return files.where(
        (F.size(dirs) < max_depth) & ~F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in P.SKIP_DIRS]))
    )


def role_check(messages: DataFrame) -> DataFrame:
    """Valid flag per message; invalid rows go to a quarantine output."""
    return messages.withColumn("valid", F.col("role").isin(*VALID_ROLES))

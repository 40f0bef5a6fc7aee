"""Model-response and tool-result parsing (R4-R11) and selection handling
(J13, J14, W8). Pure column expressions: regex, split/posexplode, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.bounded import small

# Tag grammar of responses and tool results.
REF_RX = r"\[\[REF:\s*(.*?)\]\]"
THINK_RX = r"(?s)(<think>.*?</think>)"
PATCH_RX = r"(?s)(<patch file=\".*?\">.*?</patch>)"
PATCH_PARTS_RX = r"(?s)^<patch file=\"(.*?)\">(.*?)</patch>$"
THINK_BODY_RX = r"(?s)^<think>(.*?)</think>$"
STRIP_RX = r"(?s)^\s*(.*?)\s*$"
SEP = "\u0001"
LINK_SCHEME = "ref://"
TOOL_SOURCE_SCHEME = "mcp://"
TOOL_TEXT_MIN_CHARS = 100


def _strip(c):
    return F.regexp_extract(c, STRIP_RX, 1)


def citations(responses: DataFrame, keys=("conv_id", "turn")) -> DataFrame:
    """Distinct cited paths per response."""
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(REF_RX), 1)))
    return responses.select(*keys, F.explode(refs).alias("source"))


def citation_links(responses: DataFrame, keys=("conv_id", "turn"), scheme: str = LINK_SCHEME) -> DataFrame:
    """``[[REF: p]]`` -> markdown link."""
    return responses.select(*keys, F.regexp_replace("text", REF_RX, f"[`$1`]({scheme}$1)").alias("text"))


def _split_on(col, rx):
    marked = F.regexp_replace(col, rx, f"{SEP}$1{SEP}")
    return F.split(marked, SEP)


def segments(responses: DataFrame, keys=("conv_id", "turn")) -> DataFrame:
    """Ordered parts (thought / patch / text); blank parts dropped; unclosed
    tags stay text. Two split passes, thoughts first."""
    clean = F.replace(F.col("text"), F.lit(SEP), F.lit(""))
    a = responses.select(*keys, F.posexplode(_split_on(clean, THINK_RX)).alias("p1", "part"))
    a = a.where(F.length(_strip(F.col("part"))) > 0)
    is_think = F.col("part").rlike(THINK_BODY_RX)
    think = a.where(is_think).select(
        *keys, "p1", F.lit(0).alias("p2"), F.lit("thought").alias("kind"),
        _strip(F.regexp_extract("part", THINK_BODY_RX, 1)).alias("body"), F.lit(None).cast("string").alias("file"),
    ).where(F.length("body") > 0)
    rest = a.where(~is_think).select(*keys, "p1", F.posexplode(_split_on(F.col("part"), PATCH_RX)).alias("p2", "sub"))
    rest = rest.where(F.length(_strip(F.col("sub"))) > 0)
    is_patch = F.col("sub").rlike(PATCH_PARTS_RX)
    other = rest.select(
        *keys, "p1", "p2",
        F.when(is_patch, "patch").otherwise("text").alias("kind"),
        F.when(is_patch, F.regexp_extract("sub", PATCH_PARTS_RX, 2)).otherwise(_strip(F.col("sub"))).alias("body"),
        F.when(is_patch, F.regexp_extract("sub", PATCH_PARTS_RX, 1)).alias("file"),
    )
    return think.unionByName(other).withColumns({"p1": F.col("p1").cast("long"), "p2": F.col("p2").cast("long")})


def patches(responses: DataFrame, keys=("conv_id", "turn")) -> DataFrame:
    """(file, code) of each patch block outside thoughts, with the strict guard."""
    seg = segments(responses, keys).where(F.col("kind") == "patch")
    return seg.select(*keys, "p1", "p2", "file", F.col("body").alias("code"), (~P.patch_unsafe("file")).alias("safe"))


def apply_patches(files: DataFrame, patch_rows: DataFrame, order=("conv_id", "turn", "p1", "p2")) -> DataFrame:
    """Last safe patch per path replaces the whole content; the previous
    content is kept as ``path.bak``. Patches pre-aggregate to one row per path
    before the join, so only one small row per patched file shuffles. Patch rows carry
    their conversation's project: a path is patched in that project only."""
    last = (
        patch_rows.where("safe")
        .groupBy("project", F.col("file").alias("path"))
        .agg(F.max_by("code", F.struct(*order)).alias("new_content"))
    )
    j = files.join(small(last), ["project", "path"], "left")
    updated = j.select(
        "project", "path", "ord", F.coalesce("new_content", "content").alias("content"),
        F.col("new_content").isNotNull().alias("patched"),
    )
    backups = j.where(F.col("new_content").isNotNull()).select(
        "project", F.concat("path", F.lit(".bak")).alias("path"), "ord", "content", F.lit(False).alias("patched")
    )
    return updated.unionByName(backups)


def parse_selection(selections: DataFrame, text_col: str = "text") -> DataFrame:
    """Strip a code fence, parse a JSON list of strings; else status 'invalid'."""
    body = _strip(F.col(text_col))
    body = F.regexp_replace(body, r"^```[^\n]*\n", "")
    body = F.regexp_replace(body, r"\n[ \t]*```$", "")
    body = _strip(body)
    kind = F.schema_of_variant(F.try_parse_json(body))  # of all elements together
    strings = F.from_json(body, "array<string>", {"mode": "PERMISSIVE"})
    parsed = F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(strings, lambda x: x.isNull()), strings)
    return selections.withColumns(
        {"paths": parsed, "status": F.when(parsed.isNull(), "invalid").otherwise("ok")}
    )


def flatten_text(content_col) -> F.Column:
    """String / list of strings or {text} blocks / {text} -> newline-joined."""
    c = F.col(content_col) if isinstance(content_col, str) else content_col
    t = _strip(c)
    as_list = F.from_json(t, "array<string>")
    blocks = F.transform(
        as_list, lambda b: F.when(b.startswith("{"), F.get_json_object(b, "$.text")).otherwise(b)
    )
    joined = F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n")
    obj = F.get_json_object(t, "$.text")
    return (
        F.when(t.startswith("[") & as_list.isNotNull(), joined)
        .when(t.startswith("{") & obj.isNotNull(), obj)
        .when(t.startswith("{"), F.lit(""))
        .otherwise(c)
    )


def tool_rows(results: DataFrame, min_chars: int = TOOL_TEXT_MIN_CHARS, keep=()) -> DataFrame:
    """server/tool split at the first '__', source id, text, and the size guard as a
    flag: results under ``min_chars`` characters are not to be ingested. ``keep``: columns
    handed on."""
    parts = F.split("name", "__", 2)
    text = flatten_text("content")
    out = results.where(F.col("name").contains("__")).select(
        F.element_at(parts, 1).alias("server"),
        F.element_at(parts, 2).alias("tool"),
        F.concat(F.lit(TOOL_SOURCE_SCHEME), "name").alias("source_id"),
        text.alias("text"),
        *keep,
    )
    n = F.length("text").cast("long")
    return out.withColumns({"n_chars": n, "ingestable": n >= min_chars})


def reconcile_selection(files: DataFrame, chosen: DataFrame, root_of_project) -> DataFrame:
    """Chosen paths (relative, or absolute under the project root) matched on
    the canonical relative path; only real files are kept (left semi join)."""
    root = F.concat(F.lit(root_of_project), F.col("project"), F.lit("/"))
    n = P.normalize_path("path")
    canon = F.when(n.startswith(root), F.expr("substring(n, length(root) + 1)")).otherwise(n)
    c = chosen.withColumns({"n": n, "root": root}).withColumn("path", canon).drop("n", "root")
    return c.join(files.select("project", "path"), ["project", "path"], "left_semi")


def excluded_files(files: DataFrame, selected: DataFrame) -> DataFrame:
    """All files minus the selected ones, per project."""
    return files.select("project", "path").join(selected.select("project", "path").distinct(), ["project", "path"], "left_anti")


def capped_list(files: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """First n paths per project and a truncated flag. The top-n window is a
    group limit (partial before the shuffle); counts come from a partial aggregate."""
    w = Window.partitionBy("project").orderBy(order)
    top = files.select("project", "path", order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    counts = files.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))
    return top.join(counts, "project").select(
        "project", "path", F.col("rank").cast("long").alias("rank"), "n_files", (F.col("n_files") > n).alias("truncated")
    )


def briefing_list(files: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """W8, briefing form: the first n and the last n paths per project, the total and a
    truncated flag. Two group limits, from either end."""
    ends = []
    for end, by in (("first", F.asc(order)), ("last", F.desc(order))):
        w = Window.partitionBy("project").orderBy(by)
        ends.append(files.select("project", "path", order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("end", F.lit(end)))
    counts = files.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))
    rows = ends[0].unionByName(ends[1]).join(small(counts), "project")
    # in a short list the two ends overlap: a path of both counts as one of the first
    rows = rows.where((F.col("end") == "first") | (F.col("n_files") - F.col("rank") >= n))
    return rows.select("project", "path", "end", F.col("rank").cast("long").alias("rank"), "n_files", (F.col("n_files") > 2 * n).alias("truncated"))

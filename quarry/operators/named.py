"""Query functions over a project by name (U2): what a tool server would register.

Each takes DataFrames and plain options and returns a DataFrame; errors are status rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import filters as fl
from quarry.operators import stats as st
from quarry.sources import render as rd

#: Fixed value: files above this many bytes are not handed out whole.
READ_LIMIT_BYTES = 1024 * 1024


def read_file(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, project, path, status, text) for requests(id, project, path): 'ok', 'not_found' or 'too_large'."""
    side = files.select("project", "path", "content", F.lit(True).alias("there"))
    j = requests.select("id", "project", "path").join(side, ["project", "path"], "left")
    status = F.when(F.col("there").isNull(), "not_found").when(F.octet_length("content") > READ_LIMIT_BYTES, "too_large").otherwise("ok")
    return j.select("id", "project", "path", status.alias("status"), F.when(status == "ok", F.col("content")).alias("text"))


def search_files(files: DataFrame, query: str, extensions=None) -> DataFrame:
    """Files whose base name holds the query."""
    return fl.name_search(files, query, extensions)


def list_files(files: DataFrame, directory: str = "") -> DataFrame:
    """Children of a folder: at most 50 folders and 100 files."""
    return st.list_dir(files, directory, max_dirs=50, max_files=100)


def get_project_summary(files: DataFrame) -> DataFrame:
    """Files and estimated lines per project, with the 20 commonest extensions (A1)."""
    top = st.extension_counts(files, 20).groupBy("project").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "n")))).alias("files_by_extension"))
    return st.project_summary(files).join(top, "project", "left")


def snapshot_codebase(files: DataFrame, projects: DataFrame, out_dir: str) -> DataFrame:
    """Writes the marked snapshot of each project; a status row per project."""
    return rd.batch_export(files, projects, out_dir).withColumn("path", F.concat(F.lit(f"{out_dir.rstrip('/')}/project="), "project"))


NAMED = {f.__name__: f for f in (snapshot_codebase, search_files, read_file, list_files, get_project_summary)}

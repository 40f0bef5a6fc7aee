"""Catalog entries: snapshot comparison and the content store."""

from quarry.operators import changes as ch
from quarry.plans.registry import register
from quarry.sources import tables as t


@register(
    "compare_snapshots",
    "J4",
    """
SELECT coalesce(a.project, b.project) AS project, coalesce(a.path, b.path) AS path,
       CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS status
FROM files_a a FULL OUTER JOIN files_b b ON a.project = b.project AND a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.content <> b.content
""",
)
def q_compare_snapshots(spark, sf):
    return ch.compare_snapshots(t.files_a(spark, sf), t.files_b(spark, sf))


@register(
    "change_summary",
    "A5",
    """
WITH c AS (
  SELECT coalesce(a.project, b.project) AS project,
         CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS status
  FROM files_a a FULL OUTER JOIN files_b b ON a.project = b.project AND a.path = b.path
  WHERE a.path IS NULL OR b.path IS NULL OR a.content <> b.content)
SELECT project,
       count(*) FILTER (WHERE status = 'added') AS added,
       count(*) FILTER (WHERE status = 'modified') AS modified,
       count(*) FILTER (WHERE status = 'removed') AS removed,
       format('+{} | ~{} | -{}', count(*) FILTER (WHERE status = 'added'), count(*) FILTER (WHERE status = 'modified'),
              count(*) FILTER (WHERE status = 'removed')) AS summary
FROM c GROUP BY project
""",
)
def q_change_summary(spark, sf):
    return ch.change_summary(ch.compare_snapshots(t.files_a(spark, sf), t.files_b(spark, sf)))


@register(
    "save_fingerprints",
    "J6",
    "SELECT project, path, coalesce(md5(content), '') AS md5 FROM files_b",
)
def q_save_fingerprints(spark, sf):
    return ch.fingerprints(t.files_b(spark, sf))


@register(
    "compare_fingerprints",
    "J5",
    """
SELECT coalesce(a.project, b.project) AS project, coalesce(a.path, b.path) AS path,
       CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS status
FROM (SELECT project, path, md5(content) AS h FROM files_a) a
FULL OUTER JOIN (SELECT project, path, md5(content) AS h FROM files_b) b ON a.project = b.project AND a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h
""",
)
def q_compare_fingerprints(spark, sf):
    return ch.compare_fingerprints(ch.fingerprints(t.files_a(spark, sf)), ch.fingerprints(t.files_b(spark, sf)))


@register(
    "set_changes",
    "O1",
    """
(SELECT project, path, 'added' AS set_name FROM (SELECT project, path FROM files_b EXCEPT SELECT project, path FROM files_a))
UNION ALL
(SELECT project, path, 'removed' AS set_name FROM (SELECT project, path FROM files_a EXCEPT SELECT project, path FROM files_b))
UNION ALL
(SELECT project, path, 'common' AS set_name FROM (SELECT project, path FROM files_b INTERSECT SELECT project, path FROM files_a))
""",
)
def q_set_changes(spark, sf):
    return ch.set_changes(t.files_a(spark, sf), t.files_b(spark, sf))


@register("file_diffs", "J7")
def q_file_diffs(spark, sf):
    return ch.file_diffs(t.files_a(spark, sf), t.files_b(spark, sf))


@register("diff_line_classes", "J8")
def q_diff_line_classes(spark, sf):
    return ch.diff_line_classes(ch.file_diffs(t.files_a(spark, sf), t.files_b(spark, sf)))

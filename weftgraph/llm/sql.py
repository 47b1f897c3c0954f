"""SQL of the queries that SQL can state on whole tables."""

SQL = {
    "p5_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT name_a AS a, name_b AS b FROM merge_log WHERE verdict = 'match' AND name_a IS NOT NULL AND name_b IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT name_a AS name FROM merge_log WHERE name_a IS NOT NULL UNION SELECT name_b FROM merge_log WHERE name_b IS NOT NULL),
w AS (SELECT name, name AS r FROM n UNION SELECT s.b, w.r FROM w JOIN s ON s.a = w.name)
SELECT name, min(r) AS group_name FROM w GROUP BY name""",
}

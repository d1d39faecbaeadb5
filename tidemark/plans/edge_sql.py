"""SQL of the edges that texts name, and of addresses in texts."""

_LINKED = r"""
WITH c AS (SELECT id, project_id, file_path, chunk_domain, regexp_replace(regexp_replace(file_path, '.*/', ''), '\.[^.]*$', '') module, regexp_extract(file_path, '([^/]*)$', 1) name,
  CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END dir, content FROM chunks),
k AS (SELECT id, project_id, dir, chunk_domain, CASE WHEN id % 3 <> 0 THEN content
  WHEN chunk_domain = 'code' THEN concat('from ', module, ' import x', chr(10), 'import { y } from ''./', module, '''', chr(10), content)
  ELSE concat(chr(10), '[self](', name, ')', chr(10), '[web](https://docs.example/x)', chr(10), content) END content FROM c)
"""
_PATH = """concat(CASE WHEN starts_with(n, '/') THEN '/' ELSE '' END, array_to_string(list_filter(string_split(
  CASE WHEN starts_with(n, '/') OR dir = '.' THEN n ELSE concat(dir, '/', n) END, '/'), lambda p: p <> '.' AND p <> ''), '/'))"""
_TO = "SELECT DISTINCT t.id source_id, c.id target_id, '{}' edge_type, 1.0::DOUBLE weight FROM t JOIN chunks c ON c.project_id = t.project_id AND c.file_path = t.path"

SQL = {
    "link_edges": _LINKED
    + r", h AS (SELECT id, project_id, dir, unnest(regexp_extract_all(content, '\[[^\]]+\]\(([^)]+)\)', 1)) n FROM k), t AS (SELECT DISTINCT id, project_id, "
    + _PATH + " path FROM h WHERE NOT regexp_matches(n, '^(https?://|#|mailto:)')) " + _TO.format("link"),
    "import_edges": _LINKED
    + r""", code AS (SELECT * FROM k WHERE chunk_domain = 'code'),
py AS (SELECT id, project_id, dir, unnest(list_transform(regexp_extract_all(content, '(?m)^(?:from\s+[\w.]+\s+import|import\s+[\w.]+)'), lambda m: concat(replace(regexp_extract(m, '^(?:from|import)\s+([\w.]+)', 1), '.', '/'), '.py'))) n FROM code),
js0 AS (SELECT id, project_id, dir, unnest(list_concat(regexp_extract_all(content, 'import\s+[^\n]*?\s+from\s+[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, 'require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1))) n FROM code),
js AS (SELECT id, project_id, """
    + _PATH + " path FROM js0 WHERE starts_with(n, '.')), t AS (SELECT id, project_id, " + _PATH
    + r" path FROM py UNION SELECT id, project_id, CASE WHEN regexp_matches(path, '[^/]\.[^./]+$') THEN path ELSE concat(path, e) END FROM js, (VALUES ('.ts'), ('.tsx'), ('.js'), ('.jsx')) v(e)) " + _TO.format("import"),
    "fetched_pages": r"""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(content, 'https?://[^\s)\]|"''<>]+')) url FROM chunks)
SELECT url, replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '.', '-') project_id, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') file_path FROM u""",
}

"""Common tables shared by oracle texts."""

from __future__ import annotations

def _comment(levels: int) -> str:
    pattern = r"/\*(?s:.*?)\*/"
    for _ in range(levels):
        pattern = rf"/\*(?:[^*/]|{pattern})*\*/"
    return pattern


def _lex(string: str, quoted: str) -> str:
    """The lexer in the oracle engine's regex dialect."""
    return (
        rf"--[^\n]*|{_comment(11)}|[eE]''(?:[^''\\]|\\.|'''')*''|{string}|{quoted}|`[^`]*`|\$[0-9]+|[\p{{L}}_][\p{{L}}\p{{N}}_$]*|"
        r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|<>|<=|>=|!=|\|\||::|->>|->|[^\s]"
    )


_USUAL = _lex("''(?:[^'']|'''')*''", '"[^"]*"')
_ESCAPING = _lex(r"''(?:[^''\\]|\\.|'''')*''", r'"(?:[^"\\]|\\.)*"')


def lexed(pieces: bool = False) -> str:
    """Tokens of ``sql``, read by its dialect; with ``pieces`` blanks too."""
    usual, escaping = (p[: -len(r"[^\s]")] + r"\s+|[^\s]" if pieces else p for p in (_USUAL, _ESCAPING))
    text = "ltrim(sql, chr(65279))"
    return f"CASE WHEN dialect = 'mysql' THEN regexp_extract_all({text}, '{escaping}') ELSE regexp_extract_all({text}, '{usual}') END"


KIND = r"""CASE WHEN starts_with({t}, '--') OR starts_with({t}, '/*') THEN 'comment'
  WHEN length({t}) > 1 AND starts_with({t}, '''') OR regexp_matches({t}, '^[eE]''') THEN 'string' WHEN length({t}) > 1 AND {t}[1] IN ('"', '`') THEN 'identifier'
  WHEN regexp_matches({t}, '^[\p{{L}}_]') THEN 'identifier' WHEN regexp_matches({t}, '^[0-9]') THEN 'number'
  WHEN regexp_matches({t}, '^\$[0-9]') THEN 'parameter' ELSE 'operator' END"""

#: Statements of v_scripts, by a running count of semicolons over the pieces of each script.
SPLIT = f""", pc AS (
  SELECT unit_id, repo, unnest(t) AS piece, generate_subscripts(t, 1) AS i
  FROM (SELECT unit_id, repo, {lexed(pieces=True)} AS t FROM v_scripts) x), sq AS (
  SELECT *, sum(CASE WHEN piece = ';' THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY i) AS seq FROM pc), sg AS (
  SELECT unit_id, seq, trim(string_agg(piece, '' ORDER BY i), ' ' || chr(10)) AS sql
  FROM sq WHERE piece <> ';' GROUP BY unit_id, seq), st AS (
  SELECT unit_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY seq) - 1 AS INT) AS stmt_idx, sql FROM sg WHERE sql <> '')
"""

#: All security findings, from plain patterns over the view templates.
FINDINGS = r""", ln AS (
  SELECT unit_id, repo, input_role, dialect, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no
  FROM v_units WHERE input_kind = 'python_source'), lf AS (
  SELECT *, regexp_matches(line, '(^|[^A-Za-z0-9_])(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|TRUNCATE|FROM|WHERE|JOIN)($|[^A-Za-z0-9_])', 'i') AS kw,
    regexp_matches(line, '(^|[^A-Za-z0-9_])f[''"]') AND contains(line, '{') AS fs,
    regexp_matches(line, '[''"][^''"]*[''"]\s*\+') OR regexp_matches(line, '\+\s*[''"][^''"]*[''"]') AS cc FROM ln), sq AS (
  SELECT * FROM v_units WHERE input_kind = 'sql'), fnd AS (
  SELECT unit_id, repo, input_role, 'SEC-001' AS rule_id, 0 AS stmt_idx, line_no AS line, 'medium' AS severity, '(f-string interpolation with SQL keywords)' AS note FROM lf WHERE kw AND fs
  UNION ALL SELECT unit_id, repo, input_role, 'SEC-002', 0, line_no, 'medium', '(string concatenation with SQL keywords)' FROM lf WHERE kw AND cc
  UNION ALL SELECT unit_id, repo, input_role, 'SEC-003', 0, 1, 'high', CASE WHEN contains(content, 'IF EXISTS') THEN 'IF EXISTS present' ELSE 'DROP TABLE' END FROM sq WHERE starts_with(content, 'DROP TABLE')
  UNION ALL SELECT unit_id, repo, input_role, 'SEC-004', 0, 1, 'high', 'TRUNCATE' FROM sq WHERE starts_with(content, 'TRUNCATE')
  UNION ALL SELECT unit_id, repo, input_role, 'SEC-005', 0, 1, 'high', 'DELETE without WHERE' FROM sq WHERE starts_with(content, 'DELETE') AND NOT contains(content, 'WHERE')
  UNION ALL SELECT unit_id, repo, input_role, 'SEC-006', 0, 1, 'high', 'UPDATE without WHERE' FROM sq WHERE starts_with(content, 'UPDATE') AND NOT contains(content, 'WHERE')
  UNION ALL SELECT unit_id, repo, input_role, 'SEC-007', 0, 1, 'medium', 'irreversible' FROM sq WHERE starts_with(content, 'DROP TABLE') AND input_role = 'migration'
  UNION ALL SELECT unit_id, repo, input_role, 'SEC-008', 0, 1, 'medium', unnest(regexp_extract_all(content, 'DROP COLUMN (\w+)', 1)) FROM sq WHERE starts_with(content, 'ALTER TABLE') AND input_role = 'migration'
  UNION ALL SELECT unit_id, repo, input_role, 'SEC-009', 0, 1, 'medium', 'EXECUTE' FROM sq WHERE starts_with(content, 'EXECUTE') AND dialect <> 'unknown')
"""


def by_template(rows: list[tuple], columns: str) -> str:
    """Expected rows per statement template (key modulo 32); ``{k}`` stands for the key."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {values}) AS g(t, {columns})"

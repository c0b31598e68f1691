"""Queries over documentation and requirement texts (survey groups G and H)."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.operators import design as de
from querygrove.operators import docs as op
from querygrove.prims import joined
from querygrove.sources.files import BUNDLED_DOCS, bundled_docs
from querygrove.sources.views import table, view
from querygrove.workloads.errors import sql_text
from querygrove.workloads.registry import query

_BUNDLED = " ".join(
    f"UNION ALL SELECT 'bundled:{n}', {sql_text((resources.files('querygrove') / 'docs' / n).read_text(encoding='utf-8'))}"
    for n in BUNDLED_DOCS)
CORPUS = f""", dc AS (
  SELECT 'user:' || path AS source, content FROM v_docs
  WHERE (starts_with(path, 'docs/') OR starts_with(path, '.querygrove/docs/')) AND ends_with(path, '.md') {_BUNDLED})
"""
FRONT = CORPUS + r""", fm AS (
  SELECT source, regexp_extract(content, '(?s)^---\s*\n(.*?)\n---\s*\n', 1) AS block,
    regexp_replace(content, '(?s)^---\s*\n.*?\n---\s*\n', '') AS body FROM dc), ln AS (
  SELECT source, body, lower(split_part(l, ':', 1)) AS key, trim(trim(substr(l, position(':' IN l) + 1)), '''"') AS value
  FROM (SELECT source, body, unnest(string_split(block, chr(10))) AS l FROM fm) x WHERE contains(l, ':'))
"""
SECTIONS = FRONT + r""", sp AS (
  SELECT source, body, string_split(regexp_replace(body, '(?m)^(#{1,6}\s+.)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM fm), se AS (
  SELECT source, trim(unnest(parts), ' ' || chr(10) || chr(13) || chr(9)) AS text, generate_subscripts(parts, 1) AS i FROM sp), sc AS (
  SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS INT) AS sec_no, text,
    regexp_extract(text, '^#{1,6}\s+([^\n]+)', 1) AS title FROM se WHERE text <> ''), kw AS (
  SELECT source, max(value) AS keywords FROM ln WHERE key = 'keywords' GROUP BY source), sk AS (
  SELECT sc.*, coalesce(kw.keywords, '') AS keywords FROM sc LEFT JOIN kw USING (source))
"""
INDEX = SECTIONS + r""", ix AS (
  SELECT DISTINCT source, sec_no, title, unnest(regexp_extract_all(lower(title), '[a-z_][a-z0-9_]*')) AS token, 3 AS weight FROM sk
  UNION ALL SELECT DISTINCT source, sec_no, title, unnest(regexp_extract_all(lower(keywords), '[a-z_][a-z0-9_]*')), 2 FROM sk
  UNION ALL SELECT DISTINCT source, sec_no, title, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')), 1 FROM sk)
"""
SCORES = INDEX + r""", qt AS (
  SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z_][a-z0-9_]*')) AS token FROM v_queries), s AS (
  SELECT query_id, source, sec_no, title, CAST(sum(weight) AS DOUBLE) AS score FROM qt JOIN ix USING (token) GROUP BY ALL)
"""


def corpus(spark, sf):
    return op.doc_corpus(view(spark, sf, "v_docs"), bundled_docs(spark))


def sections(spark, sf):
    return op.split_sections(op.frontmatter(corpus(spark, sf)))


@query("doc_corpus", "v_docs", CORPUS + "SELECT source, sha256(content) AS digest, length(content) AS chars FROM dc")
def doc_corpus(spark, sf):
    return corpus(spark, sf).select("source", F.sha2("content", 256).alias("digest"), F.length("content").alias("chars"))


@query("frontmatter", "v_docs", FRONT + "SELECT source, key, value, sha256(body) AS body FROM ln")
def frontmatter(spark, sf):
    return op.frontmatter(corpus(spark, sf)).select("source", "body", F.explode("meta").alias("m")).select(
        "source", "m.key", "m.value", F.sha2("body", 256).alias("body"))


@query("split_sections", "v_docs", SECTIONS + "SELECT source, sec_no, title, keywords, sha256(text) AS digest FROM sk")
def split_sections(spark, sf):
    return sections(spark, sf).select("source", "sec_no", "title", "keywords", F.sha2("text", 256).alias("digest"))


@query("section_tokens", "v_docs", INDEX + "SELECT source, sec_no, token, weight FROM ix")
def section_tokens(spark, sf):
    return op.section_tokens(sections(spark, sf)).select("source", "sec_no", "token", "weight")


@query("score_sections", "v_docs v_queries", SCORES + "SELECT query_id, source, sec_no, score FROM s")
def score_sections(spark, sf):
    return op.match_sections(sections(spark, sf), view(spark, sf, "v_queries")).select("query_id", "source", "sec_no", "score")


@query("top_sections", "v_docs v_queries", SCORES + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, title, sec_no) AS rank FROM s)
  SELECT query_id, rank, source, title, score FROM r WHERE rank <= 20""")
def top_sections(spark, sf):
    scores = op.match_sections(sections(spark, sf), view(spark, sf, "v_queries"), 20)
    return op.top_sections(scores, 20).select("query_id", "rank", "source", "title", "score")


@query("bounded_text", "v_docs", SECTIONS + """
  SELECT source, sec_no, sha256(substr(text, 1, 200)) AS digest, length(text) > 200 AS truncated FROM sk""")
def bounded_text(spark, sf):
    return op.bounded_text(sections(spark, sf), 200).select("source", "sec_no", F.sha2("text", 256).alias("digest"), "truncated")


@query("page_sections", "", r"""
  WITH sp AS (SELECT page_id, string_split(regexp_replace(html, '(<h[1-6][\s>])', chr(1) || '\1', 'gi'), chr(1)) AS parts FROM pages), se AS (
  SELECT page_id, trim(unnest(parts), ' ' || chr(10) || chr(13) || chr(9)) AS text, generate_subscripts(parts, 1) AS i FROM sp), sc AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS sec_no, text,
    regexp_extract(text, '(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS title FROM se WHERE text <> '')
  SELECT page_id, sec_no, trim(regexp_replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
    sha256(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM sc""")
def page_sections(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("content"))
    return op.page_sections(pages).select("page_id", "sec_no", "title", F.sha2("text", 256).alias("digest"))


# --- requirements -------------------------------------------------------------------------

_RQ = "v_requirements"
ENTITIES = r""", rq AS (SELECT *, doc_id % 7 AS t FROM v_requirements), en AS (
  SELECT doc_id, repo, 0 AS ordinal, regexp_extract(requirements, 'table called (\w+)', 1) AS raw_name, 'a' AS form FROM rq WHERE t < 4
  UNION ALL SELECT doc_id, repo, 1, 'OrderLine', 'b' FROM rq WHERE t < 4
  UNION ALL SELECT doc_id, repo, 0, 'customer', 'c' FROM rq WHERE t = 4
  UNION ALL SELECT doc_id, repo, 1, 'orders', 'd' FROM rq WHERE t = 4), ent AS (
  SELECT *, lower(regexp_replace(raw_name, '([a-z])([A-Z])', '\1_\2', 'g')) AS name FROM en), co(form, pos, col, ty) AS (VALUES
  ('a', 1, 'name', 'TEXT'), ('a', 2, 'email', 'TEXT'), ('a', 3, 'created_timestamp', 'TIMESTAMPTZ'), ('a', 4, 'unit_price', 'NUMERIC'),
  ('a', 5, 'and', 'TEXT'), ('a', 6, 'account', 'INTEGER'), ('b', 1, 'quantity', 'INTEGER'), ('b', 2, 'and', 'TEXT'), ('b', 3, 'birth_date', 'DATE'),
  ('d', 1, 'amount', 'NUMERIC'), ('d', 2, 'and', 'TEXT'), ('d', 3, 'unit_price', 'NUMERIC'), ('d', 4, 'item_count', 'INTEGER')), cl AS (
  SELECT doc_id, repo, name AS tbl, 0 AS pos, 'id' AS name, 'UUID' AS data_type, false AS nullable FROM ent
  UNION ALL SELECT doc_id, repo, ent.name, co.pos, co.col, co.ty, true FROM ent JOIN co USING (form)), dd AS (
  SELECT doc_id, repo, tbl AS name, 'CREATE TABLE ' || tbl || ' (' || chr(10) || string_agg('  ' || name || ' ' || data_type
    || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END, ',' || chr(10) ORDER BY pos) || ',' || chr(10) || '  PRIMARY KEY (id)' || chr(10) || ');' AS ddl
  FROM cl GROUP BY doc_id, repo, tbl)
"""


def requirements(spark, sf):
    return de.guarded(view(spark, sf, _RQ)).filter(F.col("kind").isNull()).select("doc_id", "repo", "requirements")


@query("extract_entities", _RQ, ENTITIES + "SELECT doc_id, CAST(ordinal AS INT) AS ordinal, raw_name, name FROM ent")
def extract_entities(spark, sf):
    return de.extract_entities(requirements(spark, sf)).select("doc_id", "ordinal", "raw_name", "name")


@query("snake_case", "", r"""
  SELECT p_partkey, lower(regexp_replace(regexp_replace(p_type || replace(p_brand, '#', 'No') || 'XMLCode', '(.)([A-Z][a-z]+)', '\1_\2', 'g'),
    '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS name FROM part""")
def snake_case(spark, sf):
    raw = F.concat("p_type", F.replace("p_brand", F.lit("#"), F.lit("No")), F.lit("XMLCode"))
    return table(spark, sf, "part").select("p_partkey", de.snake_case(raw).alias("name"))


@query("extract_columns_text", _RQ, ENTITIES + "SELECT doc_id, tbl, CAST(pos AS INT) AS pos, name, nullable FROM cl")
def extract_columns_text(spark, sf):
    return de.proposed_columns(de.proposed_tables(requirements(spark, sf))).select("doc_id", "tbl", "pos", "name", "nullable")


@query("type_hints", _RQ, ENTITIES + "SELECT doc_id, tbl, name, data_type FROM cl")
def type_hints(spark, sf):
    return de.proposed_columns(de.proposed_tables(requirements(spark, sf))).select("doc_id", "tbl", "name", "data_type")


@query("proposal_ddl", _RQ, ENTITIES + "SELECT doc_id, name, ddl FROM dd")
def proposal_ddl(spark, sf):
    return de.proposal_ddl(de.proposed_tables(requirements(spark, sf))).select("doc_id", "name", "ddl")


@query("withhold_unsafe_ddl", _RQ, ENTITIES + """
  SELECT doc_id, name, CASE WHEN doc_id % 5 = 0 THEN 'SEC-003' ELSE '' END AS rules, doc_id % 5 <> 0 AS safe FROM dd""")
def withhold_unsafe_ddl(spark, sf):
    # every fifth text gets a statement the rules must stop
    ddl = de.proposal_ddl(de.proposed_tables(requirements(spark, sf))).withColumn(
        "ddl", F.when(F.col("doc_id") % 5 == 0, F.concat("ddl", F.lit(" DROP TABLE "), "name", F.lit(";"))).otherwise(F.col("ddl")))
    safe, withheld = de.withhold_unsafe_ddl(ddl)
    return safe.select("doc_id", "name", F.lit("").alias("rules"), F.lit(True).alias("safe")).unionByName(
        withheld.select("doc_id", "name", joined("rule_ids").alias("rules"), F.lit(False).alias("safe")))


@query("proposal_conflicts", "v_requirements v_cat_columns", ENTITIES + """
  SELECT DISTINCT doc_id, e.repo, e.name FROM ent e JOIN v_cat_columns c ON c.repo = e.repo AND c.tbl = e.name""")
def proposal_conflicts(spark, sf):
    return de.proposal_conflicts(de.proposed_tables(requirements(spark, sf)), view(spark, sf, "v_cat_columns")).select(
        "doc_id", "repo", "name")


_STRATEGY = sql_text("|".join(refdata.MIGRATION_STRATEGY))


@query("design_report", "v_requirements v_cat_columns", ENTITIES + f""", n AS (
  SELECT doc_id, count(*) AS n, string_agg(name, '|' ORDER BY ordinal) FILTER (ordinal < 1) AS names FROM ent GROUP BY doc_id), dl AS (
  SELECT doc_id, string_agg(ddl, '|' ORDER BY ordinal) AS ddl FROM dd JOIN (SELECT doc_id, name, ordinal FROM ent WHERE ordinal < 1) x USING (doc_id, name) GROUP BY doc_id), ri AS (
  SELECT doc_id, string_agg('Proposed table ''' || name || ''' already exists in the repo schema (source: repo-ddl).', '|' ORDER BY name) AS risks
  FROM (SELECT DISTINCT doc_id, e.name FROM ent e JOIN v_cat_columns c ON c.repo = e.repo AND c.tbl = e.name) x GROUP BY doc_id)
  SELECT coalesce(dl.ddl, '') AS ddl, coalesce(risks, '') AS risks, '' AS withheld, rq.doc_id, CASE WHEN t = 5 THEN 'no_input' END AS kind, CASE WHEN t = 5 THEN NULL WHEN n.n > 0 THEN 'derived' ELSE 'inconclusive' END AS derivation_status,
    coalesce(names, '') AS tables, CASE WHEN n.n > 0 THEN {_STRATEGY} ELSE '' END AS migration_strategy,
    CASE WHEN t = 4 THEN 2 ELSE 0 END AS conflicts, coalesce(n.n, 0) > 1 AS tables_truncated, greatest(coalesce(n.n, 0) - 1, 0) AS tables_suppressed
  FROM rq LEFT JOIN n USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN ri USING (doc_id)""")
def design_report(spark, sf):
    report = de.design_report(view(spark, sf, _RQ), view(spark, sf, "v_cat_columns"), cap=1)
    broken = F.array_join(F.transform("withheld", lambda w: F.concat(w["name"], F.lit(":"), F.array_join(w["rule_ids"], ","))), "|")
    return report.withColumn("withheld", broken).withColumn("ddl", joined("ddl")).withColumn("risks", joined("risks")).withColumn(
        "tables", joined("tables")).withColumn("migration_strategy", joined("migration_strategy"))

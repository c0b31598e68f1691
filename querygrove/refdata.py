"""Rule data. Everything in this module is a fixed value: word lists, patterns, catalogue texts."""

from __future__ import annotations

# --- file scan: fixed values ---------------------------------------------------------------

SKIP_DIRS = (
    "env", ".git", "__pycache__", "node_modules", ".pytest_cache", ".ruff_cache", ".mypy_cache",
    ".venv", "venv", "dist", "build", ".tox", ".eggs", ".querygrove",
)

SCAN_KEYWORDS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "TRUNCATE", "JOIN", "Supabase",
)

HOST_KEYWORDS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "FROM", "WHERE", "JOIN",
)

ORM_MARKERS = (
    "sqlalchemy", "SQLAlchemy", "prisma", "Prisma", "activerecord", "ActiveRecord", "gorm", "GORM",
    "django.db", "models.Model", "sequelize", "Sequelize", "typeorm", "TypeORM", "sqlmodel", "SQLModel",
)

CONFIG_EXTS = (".toml", ".yaml", ".yml", ".env", ".ini", ".cfg", ".json")
DOC_EXTS = (".md", ".rst")
ORM_EXTS = (".py", ".ts", ".js", ".rb", ".go", ".rs")
BINARY_CHECK_BYTES = 1024

MIGRATION_NAMES = (r"^\d+_.*\.sql$", r"^V\d+__.*\.sql$", r".*\.migration\.sql$")
MIGRATION_ROOTS = ("migrations", "db/migrations", "sql/migrations")

#: Naming conventions in the order they are tried.
CONVENTIONS = (
    ("date", r"^(\d{8})_.*\.sql$"),
    ("timestamp", r"^(\d{10})_.*\.sql$"),
    ("flyway", r"^V(\d+)__.*\.sql$"),
    ("numeric", r"^(\d+)_.*\.sql$"),
)

# --- dialects: fixed values ----------------------------------------------------------------

KNOWN_DIALECTS = (
    "athena", "bigquery", "clickhouse", "databricks", "doris", "drill", "druid", "duckdb", "dune",
    "exasol", "fabric", "hive", "materialize", "mysql", "oracle", "postgres", "presto", "prql",
    "redshift", "risingwave", "singlestore", "snowflake", "solr", "spark", "spark2", "sqlite",
    "starrocks", "tableau", "teradata", "trino", "tsql",
)

#: (dialect, order of the dialect, pattern, description); searched without regard to case.
DIALECT_MARKERS = (
    ("postgres", 1, r"::", "double-colon cast operator"),
    ("postgres", 1, r"\bSERIAL\b", "SERIAL type"),
    ("postgres", 1, r"\bBIGSERIAL\b", "BIGSERIAL type"),
    ("postgres", 1, r"\bTIMESTAMPTZ\b", "TIMESTAMPTZ type"),
    ("postgres", 1, r"\bRETURNING\b", "RETURNING clause"),
    ("postgres", 1, r"\bILIKE\b", "ILIKE operator"),
    ("postgres", 1, r"\b~\b", "regex match operator"),
    ("postgres", 1, r"\bARRAY\[", "ARRAY constructor"),
    ("postgres", 1, r"\bjsonb\b", "jsonb type"),
    ("postgres", 1, r"\bgen_random_uuid\b", "gen_random_uuid function"),
    ("mysql", 2, r"\bAUTO_INCREMENT\b", "AUTO_INCREMENT"),
    ("mysql", 2, r"\bENGINE\s*=", "ENGINE clause"),
    ("mysql", 2, r"\bCHARSET\b", "CHARSET clause"),
    ("mysql", 2, r"`\w+`", "backtick identifiers"),
    ("mysql", 2, r"\bLIMIT\s+\d+\s*,\s*\d+", "comma-separated LIMIT"),
    ("mysql", 2, r"\bMEDIUMINT\b", "MEDIUMINT type"),
    ("mysql", 2, r"\bTINYINT\b", "TINYINT type"),
    ("sqlite", 3, r"\bAUTOINCREMENT\b", "AUTOINCREMENT"),
    ("sqlite", 3, r"\bINTEGER\s+PRIMARY\s+KEY\b", "INTEGER PRIMARY KEY (rowid alias)"),
    ("sqlite", 3, r"\bPRAGMA\b", "PRAGMA statement"),
    ("sqlite", 3, r"\bGLOB\b", "GLOB operator"),
    ("tsql", 4, r"\bTOP\s+\d+", "TOP clause"),
    ("tsql", 4, r"\b@@\w+", "global variable (@@var)"),
    ("tsql", 4, r"\bNVARCHAR\b", "NVARCHAR type"),
    ("tsql", 4, r"\bGETDATE\(\)", "GETDATE function"),
    ("tsql", 4, r"\bISNULL\b", "ISNULL function"),
    ("tsql", 4, r"\[\w+\]", "bracket identifiers"),
    ("oracle", 5, r"\bROWNUM\b", "ROWNUM"),
    ("oracle", 5, r"\bDUAL\b", "DUAL table"),
    ("oracle", 5, r"\bSYSDATE\b", "SYSDATE"),
    ("oracle", 5, r"\bNVARCHAR2\b", "NVARCHAR2 type"),
    ("oracle", 5, r"\bNUMBER\b", "NUMBER type"),
    ("bigquery", 6, r"\bSTRUCT\b", "STRUCT type"),
    ("bigquery", 6, r"\bARRAY\b", "ARRAY type"),
    ("bigquery", 6, r"\b_EXTRACT_DATE\b", "BigQuery pseudo-column"),
)

# --- lexical words: fixed values -----------------------------------------------------------

#: Leading keyword -> kind of statement.
STATEMENT_KINDS = (
    ("SELECT", "select"), ("VALUES", "values"), ("INSERT", "insert"), ("UPDATE", "update"), ("DELETE", "delete"),
    ("MERGE", "merge"), ("CREATE", "create"), ("ALTER", "alter"), ("DROP", "drop"), ("TRUNCATE", "truncate"),
    ("EXECUTE", "execute"), ("EXEC", "execute"), ("GRANT", "grant"), ("REVOKE", "grant"), ("COPY", "copy"),
    ("BEGIN", "txn"), ("START", "txn"), ("COMMIT", "txn"), ("ROLLBACK", "txn"), ("SAVEPOINT", "txn"), ("END", "txn"),
    ("EXPLAIN", "explain"), ("CALL", "command"), ("DO", "command"), ("VACUUM", "command"), ("ANALYZE", "command"),
    ("SET", "command"), ("SHOW", "command"), ("USE", "command"), ("PRAGMA", "command"), ("REFRESH", "command"),
    ("LOAD", "command"), ("LOCK", "command"), ("COMMENT", "command"), ("DESCRIBE", "command"),
)

CLAUSE_WORDS = (
    "SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT",
    "EXCEPT", "WINDOW", "SET", "VALUES", "RETURNING", "INTO", "FOR", "QUALIFY",
)
JOIN_WORDS = ("LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "OUTER", "JOIN")
LOCK_ACTIONS = ("UPDATE", "SHARE", "NO KEY UPDATE", "KEY SHARE")

#: Words that are never a column or a table name in the statements we look at.
RESERVED_WORDS = (
    "SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "BY", "LIMIT", "OFFSET", "FETCH", "FIRST", "ROWS", "ONLY",
    "UNION", "INTERSECT", "EXCEPT", "ALL", "DISTINCT", "AS", "ON", "USING", "JOIN", "LEFT", "RIGHT", "FULL", "INNER",
    "CROSS", "NATURAL", "OUTER", "LATERAL", "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ILIKE", "BETWEEN",
    "EXISTS", "ANY", "SOME", "CASE", "WHEN", "THEN", "ELSE", "END", "CAST", "TRUE", "FALSE", "ASC", "DESC", "NULLS",
    "LAST", "WITH", "RECURSIVE", "MATERIALIZED", "INSERT", "INTO", "VALUES", "UPDATE", "SET", "DELETE", "MERGE",
    "MATCHED", "CREATE", "ALTER", "DROP", "TRUNCATE", "TABLE", "INDEX", "VIEW", "TYPE", "TRIGGER", "FUNCTION",
    "PROCEDURE", "COLUMN", "CONSTRAINT", "PRIMARY", "FOREIGN", "KEY", "REFERENCES", "UNIQUE", "CHECK", "DEFAULT",
    "IF", "ADD", "RENAME", "TO", "CASCADE", "RESTRICT", "EXECUTE", "EXEC", "EXPLAIN", "ANALYZE", "VACUUM", "GRANT",
    "REVOKE", "COPY", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "CALL", "DO", "FOR", "SHARE", "NO", "WINDOW",
    "OVER", "PARTITION", "RANGE", "PRECEDING", "FOLLOWING", "UNBOUNDED", "CURRENT", "ROW", "INTERVAL", "RETURNING",
    "ESCAPE", "COLLATE", "TOP", "QUALIFY", "FILTER", "WITHIN",
)

COMPARISONS = ("=", "<>", "!=", "<", ">", "<=", ">=")
#: What may stand before, and after, an operand that is nothing but a column or a literal.
OPERAND_STARTS = ("WHERE", "AND", "OR", "NOT", "(", "WHEN", "ON", "HAVING")
OPERAND_ENDS = (
    "AND", "OR", ")", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT", "THEN",
    "ELSE", "FOR", "RETURNING", "WINDOW", "QUALIFY", ";",
)

#: Functions whose argument list uses FROM as a separator.
FROM_FUNCTIONS = ("EXTRACT", "TRIM", "SUBSTRING", "OVERLAY", "POSITION")

# --- lint: fixed values --------------------------------------------------------------------

TYPE_CLASSES = (
    ("integer", "integer"), ("int", "integer"), ("bigint", "integer"), ("smallint", "integer"), ("serial", "integer"),
    ("bigserial", "integer"), ("tinyint", "integer"), ("mediumint", "integer"), ("numeric", "numeric"),
    ("decimal", "numeric"), ("float", "numeric"), ("real", "numeric"), ("double", "numeric"), ("text", "text"),
    ("varchar", "text"), ("char", "text"), ("string", "text"), ("boolean", "boolean"), ("bool", "boolean"),
    ("date", "date"), ("timestamp", "date"), ("timestamptz", "date"), ("time", "date"), ("binary", "binary"),
    ("bytea", "binary"), ("blob", "binary"),
)

#: (rule id, title, severity, evidence, kind)
LINT_RULES = (
    ("OPT-001", "SELECT * present", "info", "static", "fact"),
    ("OPT-002", "Correlated subquery present", "info", "static", "fact"),
    ("OPT-003", "Type mismatch between column and literal", "low", "schema", "fact"),
    ("OPT-004", "No obviously usable index for predicate", "low", "schema", "inference"),
)

# --- security rules: fixed values ----------------------------------------------------------

#: (rule id, title, severity, category, input kind, roles, needs a known dialect, kind, fix)
SECURITY_RULES = (
    ("SEC-001", "f-string SQL construction", "medium", "injection", "python_source", "query,migration,script", False,
     "inference", None),
    ("SEC-002", "String concatenation SQL construction", "medium", "injection", "python_source", "query,migration,script",
     False, "inference", None),
    ("SEC-003", "DROP TABLE", "high", "dangerous_statement", "sql", "query,migration,script", False, "fact",
     "Review whether the table drop is intentional. Consider renaming or archiving instead."),
    ("SEC-004", "TRUNCATE TABLE", "high", "dangerous_statement", "sql", "query,migration,script", False, "fact", None),
    ("SEC-005", "DELETE without WHERE", "high", "dangerous_statement", "sql", "query,migration,script", False, "fact",
     "Add a WHERE clause to limit the scope of deletion."),
    ("SEC-006", "UPDATE without WHERE", "high", "dangerous_statement", "sql", "query,migration,script", False, "fact",
     "Add a WHERE clause to limit the scope of the update."),
    ("SEC-007", "DROP TABLE in migration", "medium", "migration_safety", "sql", "migration", False, "fact", None),
    ("SEC-008", "ALTER TABLE DROP COLUMN", "medium", "migration_safety", "sql", "migration", False, "fact", None),
    ("SEC-009", "EXECUTE/EXEC with dynamic SQL", "medium", "dynamic_sql", "sql", "query,migration,script", True,
     "inference", None),
)
SECURITY_RULESET_VERSION = "1"
SEVERITY_ORDER = ("critical", "high", "medium", "low", "info")

# --- plans: fixed values -------------------------------------------------------------------

PLAN_CONDITIONS = (
    ("Filter", "filter"), ("Index Cond", "index_cond"), ("Join Filter", "join_filter"), ("Hash Cond", "hash_cond"),
    ("Merge Cond", "merge_cond"), ("Recheck Cond", "recheck_cond"),
)
ALLOWED_SETTINGS = (
    "enable_seqscan", "enable_indexscan", "enable_indexonlyscan", "enable_bitmapscan", "enable_tidscan",
    "enable_nestloop", "enable_hashjoin", "enable_mergejoin", "enable_material", "enable_sort", "enable_hashagg",
    "enable_gathermerge", "enable_partition_pruning", "enable_parallel_append", "enable_parallel_hash",
    "enable_partitionwise_join", "enable_partitionwise_aggregate", "random_page_cost", "seq_page_cost",
    "cpu_tuple_cost", "cpu_index_tuple_cost", "cpu_operator_cost", "effective_cache_size", "work_mem",
    "hash_mem_multiplier", "maintenance_work_mem", "max_parallel_workers", "max_parallel_workers_per_gather",
    "default_statistics_target", "plan_cache_mode", "jit", "from_collapse_limit", "join_collapse_limit",
)
UNPARSED = "<redacted-unparsed-expression>"
CARDINALITY_NOTE = (
    "semantic-safety: root cardinality changed materially between original and rewritten plans - "
    "verify correctness, this is not a performance claim"
)

# --- requirements: fixed values ------------------------------------------------------------

#: Ordered; the first hint contained in a column name decides its type.
TYPE_HINTS = (
    ("uuid", "UUID"), ("email", "TEXT"), ("timestamp", "TIMESTAMPTZ"), ("date", "DATE"), ("boolean", "BOOLEAN"),
    ("json", "JSONB"), ("price", "NUMERIC"), ("amount", "NUMERIC"), ("count", "INTEGER"), ("quantity", "INTEGER"),
)
MIGRATION_STRATEGY = (
    "Apply CREATE TABLE statements in dependency order (referenced tables first).",
    "Add foreign keys after both tables exist.",
    "Prefer additive migrations; DDL is never executed here.",
)

# --- metrics: fixed values -----------------------------------------------------------------

REDACT_KEYS = (
    "url", "key", "token", "secret", "password", "credential", "api_key", "database_url", "connection_string",
)

SCHEMA_CAPABILITIES = (
    "column_enumeration", "column_type", "index_enumeration", "index_structure", "constraint_enumeration",
    "fk_structure", "table_existence",
)

# --- error catalogue: fixed values, in catalogue order -------------------------------------

#: (catalog id, pattern, scope, diagnosis, guidance, severity, specificity); patterns ignore case.
ERROR_CATALOG = (
    ("PG-42601", r"\b42601\b|syntax error at or near", "postgres",
     "Syntax error: the statement violates PostgreSQL grammar at the reported position.",
     "Check the token at the reported position for typos, missing commas, unbalanced parentheses, or a reserved word "
     "used as an identifier (quote it if intended).", "high", 2),
    ("PG-42703", r"\b42703\b|column .* does not exist", "postgres",
     "Undefined column: the referenced column is not in any table in scope.",
     "Verify the column name spelling and the table alias; check that the column exists in the schema (analyze_sql or "
     "the repo DDL).", "high", 2),
    ("PG-42P01", r"\b42P01\b|relation .* does not exist", "postgres",
     "Undefined table: the referenced relation is not in the search path.",
     "Check the table name and schema qualification; confirm the migration creating it has been applied (repo DDL "
     "cross-check).", "high", 2),
    ("PG-42883", r"\b42883\b|operator does not exist", "postgres",
     "No operator matches the operand types (implicit cast missing).",
     "Add an explicit cast for the compared values (e.g. col::text) or align the operand types; watch for quoted "
     "numeric literals compared to non-numeric columns.", "medium", 2),
    ("PG-42804", r"\b42804\b|datatype mismatch", "postgres",
     "Datatype mismatch between expected and provided values.",
     "Align the datatypes on both sides of the assignment/comparison; use explicit casts rather than relying on "
     "implicit conversion.", "medium", 2),
    ("PG-22P02", r"\b22P02\b|invalid input syntax for type", "postgres",
     "A literal or parameter value cannot be parsed as the target type.",
     "Validate/normalize the input value before it reaches the query; check locale formats for numbers and dates.",
     "medium", 2),
    ("PG-23505", r"\b23505\b|duplicate key value violates unique constraint", "postgres",
     "A unique or primary-key constraint was violated by the inserted/updated row.",
     "Check for an existing row with the same key (upsert with ON CONFLICT if the semantics allow), or generate keys "
     "sequentially/uuids instead of client-side guesses.", "high", 2),
    ("PG-23503", r"\b23503\b|violates foreign key constraint", "postgres",
     "Foreign-key constraint violation: referenced row does not exist.",
     "Insert or reference an existing parent row first; verify the FK column values against the parent table's keys.",
     "high", 2),
    ("PG-42P07", r"\b42P07\b|relation .* already exists", "postgres",
     "A relation with the same name already exists (duplicate DDL).",
     "Use CREATE TABLE IF NOT EXISTS, or check migration ordering / partial application before re-running DDL.",
     "medium", 2),
    ("PG-42501", r"\b42501\b|permission denied", "postgres",
     "The current role lacks the required privilege for the operation.",
     "Grant the needed privilege to the role (least-privilege scope), or run the operation with a role that holds it.",
     "high", 2),
    ("PG-40P01", r"\b40P01\b|deadlock detected", "postgres",
     "Deadlock: two transactions each hold locks the other needs.",
     "Acquire locks in a consistent order across transactions; keep transactions short; retry on 40P01 with backoff.",
     "high", 2),
    ("PG-57014", r"\b57014\b|statement timeout|canceling statement due to", "postgres",
     "The statement exceeded the configured timeout and was canceled.",
     "Optimize the query (see optimize_query findings), add supporting indexes, or raise the statement timeout if the "
     "workload legitimately needs longer.", "high", 2),
    ("PG-53300", r"\b53300\b|too many connections", "postgres",
     "Server connection limit reached.",
     "Use pooling (pgbouncer or pool in app), reduce pool sizes, or raise max_connections on the server.", "high", 2),
    ("PG-55006", r"\b55006\b|cannot drop .* because other objects depend on it", "postgres",
     "Dependent objects prevent the drop.",
     "Drop dependents first or use CASCADE deliberately; review the dependency list before cascading.", "medium", 2),
    ("GEN-TIMEOUT", r"\btimeout expired\b|timed out\b|connection timed out", "any",
     "An operation or connection timed out.",
     "Check network reachability and load; add explicit timeouts and bounded retries with backoff.", "medium", 1),
    ("GEN-CONNREFUSED", r"connection refused|could not connect", "any",
     "The database server refused or could not be reached.",
     "Verify host/port, that the server is running, and firewall/network policy; check the connection string env var "
     "name.", "high", 1),
)

#: Texts of the schema hypotheses (before and after the names, next step) and of the last diagnostic.
MISSING_TABLES = (
    "The query references table(s) not present in the repo schema: ", ". The migration creating them may be missing or unapplied.",
    "Check migration ordering and application state.",
)
MISSING_COLUMNS = (
    "The query references column(s) not present in the repo schema: ", ".", "Verify column names against the repo DDL (analyze_sql).",
)
LOCATE_TABLES = "Run find_context to locate migrations for the missing tables."

#: Dialects in which a backslash escapes the next character of a literal. Fixed values.
BACKSLASH_DIALECTS = ("mysql", "bigquery")

"""Views that bind operators to the test tables. The same SQL serves Spark, with tables in braces, and the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # A part imports the part that followed it in the first and in the last order that holds both.
    "edges": """
        SELECT DISTINCT src, dst FROM (
          SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY shipped, place, line, dst) AS first_place,
                 row_number() OVER (PARTITION BY src ORDER BY shipped DESC, place DESC, line DESC, dst DESC) AS last_place
          FROM (SELECT l_partkey AS src, l_shipdate AS shipped, l_orderkey AS place, l_linenumber AS line,
                  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS dst
                FROM {lineitem}) t
          WHERE dst IS NOT NULL AND src <> dst) u
        WHERE first_place = 1 OR last_place = 1""",
    "commits": """
        SELECT l_partkey AS path, l_orderkey AS commit_hash, o_orderdate AS ts,
               CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE o_custkey % 10 END AS author
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "coverage": "SELECT p_partkey AS path, CAST(p_size * 2 AS DOUBLE) AS pct FROM {part} WHERE p_partkey % 4 <> 0",
    "files": """
        SELECT doc_id, source AS dir, lang AS ext, n_chars AS size_bytes,
               concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.', lang) AS path FROM {documents}""",
    "issues": r"""
        SELECT doc_id, source, 'generic-secret' AS rule_id, 'error' AS severity, 'security' AS category
          FROM {documents} WHERE regexp_like(text, '(?i)token\s*=\s*"[^"]{{8,}}"')
        UNION ALL SELECT doc_id, source, 'long-number', 'warning', 'privacy'
          FROM {documents} WHERE regexp_like(text, '\b[0-9]{{16}}\b')
        UNION ALL SELECT doc_id, source, 'licence-line', 'info', 'licensing'
          FROM {documents} WHERE regexp_like(text, '(?i)licen[sc]e')
        UNION ALL SELECT doc_id, source, 'large-document', 'info', 'maintainability'
          FROM {documents} WHERE n_chars > 5000""",
    "snap": """
        SELECT 'base' AS snapshot, l_partkey AS path, l_suppkey AS fact, max(l_linenumber) AS version
          FROM {lineitem} WHERE l_shipdate < TIMESTAMP '2000-01-01 00:00:00' GROUP BY 2, 3
        UNION ALL SELECT 'head', l_partkey, l_suppkey, max(l_linenumber)
          FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY 2, 3""",
    "work": "SELECT p_size % 5 AS stream, p_partkey AS path FROM {part} UNION SELECT length(p_name) % 5, p_partkey FROM {part}",
    "claims": """
        SELECT c_custkey AS id, c_custkey % 4 AS agent,
               CASE c_custkey % 3 WHEN 0 THEN concat('r', CAST(n_regionkey AS STRING))
                    WHEN 1 THEN concat('r', CAST(n_regionkey AS STRING), '/n', CAST(n_nationkey AS STRING))
                    ELSE concat('r', CAST(n_regionkey AS STRING), '/n', CAST(n_nationkey AS STRING), '/c', CAST(c_custkey AS STRING)) END AS target
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "runs": "SELECT DISTINCT date_trunc('day', ts) AS run_ts, concat(event_type, ':', CAST(user_id AS STRING)) AS rule_id FROM {events}",
    "ledger": """
        SELECT event_id, concat(event_type, '-', CAST(user_id % 10 AS STRING)) AS command, ts AS completed_at,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code FROM {events}""",
    "cost": "SELECT event_id, ts, user_id, event_type AS tool, CAST(floor(value) AS BIGINT) AS tokens FROM {events}",
    "funcs": "SELECT p_partkey AS fn, p_name AS bare, p_brand AS file, p_size AS cc FROM {part}",
    "queries": "SELECT item_id, text FROM {benchmark} WHERE item_id % 50 = 0",
    "vecq": "SELECT vec_id, embedding FROM {embeddings} WHERE vec_id % 50 = 0",
    "feedback": """
        SELECT d.source AS repo, d.doc_id AS pr, l.quality = 1 AS useful, l.toxic = 1 AS noisy, d.n_chars % 30 AS minutes
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace(r"'(?i)token\s", r"r'(?i)token\s").replace(r"'\b[", r"r'\b[")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_views(body: str, *names: str) -> str:
    """SQL for the oracle: the named views as common table expressions before body."""
    plain = {t: t for t in TABLES}
    sql = {n: VIEWS[n].format(**plain).replace("regexp_like", "regexp_matches").replace(r"'\b[", r"'\b[") for n in names}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" for n, s in sql.items()) + body if body.lstrip().startswith(",") else (
        ("WITH " + ", ".join(f"{n} AS ({s})" for n, s in sql.items()) + " " if names else "") + body
    )

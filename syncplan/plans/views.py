"""Tables of this engine's shapes, derived from the given ones in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_listing": """
SELECT concat('w', CAST(l_orderkey % 10 AS STRING), '/',
              CASE WHEN l_orderkey % 3 = 0 THEN 'hot/' WHEN l_orderkey % 3 = 1 THEN 'hotel/' ELSE '' END,
              CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING),
              CASE WHEN l_linenumber = 1 THEN '.tmp' WHEN l_linenumber = 2 THEN '.xmp' ELSE '.jpg' END) AS path,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size,
       max(l_shipdate) AS mtime,
       md5(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
                  CAST(sum(CAST(l_quantity AS BIGINT)) AS STRING))) AS hash,
       l_orderkey AS k, l_linenumber AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_prev": """
SELECT path, CASE WHEN (k + n) % 11 = 0 THEN size + 1 ELSE size END AS size, mtime,
       CASE WHEN (k + n) % 7 = 0 THEN 'old' ELSE hash END AS hash
FROM v_listing WHERE (k + n) % 10 <> 0""",
    "v_cur": "SELECT path, size, mtime, hash FROM v_listing WHERE (k + n) % 13 <> 0",
    "v_sync_log": """
SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS channel_name, 'orders' AS source_connector,
       concat('c', CAST(o_custkey % 50 AS STRING), '/', CAST(o_custkey AS STRING), '.jpg') AS source_path,
       concat('v', CAST(o_orderkey % 4 AS STRING)) AS source_version,
       concat('rec', CAST(o_custkey AS STRING)) AS dest_id,
       CASE WHEN o_orderstatus = 'O' THEN 'create' ELSE 'update' END AS kind,
       concat('c', CAST(o_custkey % 50 AS STRING), '/', CAST(o_custkey AS STRING)) AS source_stem,
       concat('c', CAST(o_custkey % 50 AS STRING)) AS source_dir
FROM orders""",
    "v_events": """
SELECT event_id AS seq, ts AS observed, 'orders' AS connector,
       CASE event_type WHEN 'signup' THEN 'OnCreate' WHEN 'error' THEN 'OnDelete' ELSE 'OnUpdate' END AS kind,
       concat('c', CAST(user_id % 50 AS STRING), '/', CAST(user_id AS STRING),
              CASE WHEN event_type = 'view' THEN '.xmp' WHEN event_type = 'click' THEN '.caption.en.txt' ELSE '.jpg' END) AS path,
       CAST(floor(value * 100) AS BIGINT) AS size,
       CASE WHEN event_type = 'error' THEN '' ELSE concat('v', CAST(event_id % 4 AS STRING)) END AS hash
FROM events""",
    "v_work": """
SELECT event_id AS id, concat('ch', CAST(user_id % 3 AS STRING)) AS channel_name, ts AS next_run_at,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END AS status,
       CAST(event_id % 6 AS INT) AS attempts, CASE WHEN event_type = 'error' THEN props END AS last_error
FROM events""",
    "v_companions": """
SELECT concat(source, '/', CAST(doc_id - doc_id % 80 AS STRING), '.caption.', lang, '.v',
              CAST((doc_id % 80 - doc_id % 20) AS STRING), '.txt') AS path, text AS content, doc_id
FROM documents""",
    "v_assets": "SELECT DISTINCT concat(source, '/', CAST(doc_id - doc_id % 80 AS STRING), '.jpg') AS path FROM documents",
    "v_manifest": """
SELECT p_partkey AS line,
  concat(chr(123), CASE WHEN p_partkey % 3 <> 0 THEN concat('"id":"rec', CAST(p_partkey AS STRING), '",') ELSE '' END,
         CASE WHEN p_partkey % 3 <> 1 AND p_partkey % 50 <> 0 THEN concat('"file":"parts/', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 9 = 0 THEN ':a.jpg' ELSE '.jpg' END, '",') ELSE '' END,
         CASE WHEN p_partkey % 17 = 0 THEN '"title":"x",' ELSE '' END,
         CASE WHEN p_partkey % 19 = 0 THEN '"status":"bogus",' ELSE '"status":"Draft",' END,
         '"fields":[', chr(123), '"name":" ', p_brand, '","value":"', p_type, '"', chr(125), ',', chr(123), '"name":"Caption","value":"', p_name, '","language":"',
         CASE WHEN p_partkey % 23 = 0 THEN 'xx-XX' ELSE 'en-US' END, '"', chr(125), ']', chr(125)) AS raw
FROM part""",
    "v_ledger": """
SELECT substring(sha256(m.raw), 1, 16) AS hash, m.line AS seq,
       CASE WHEN m.line % 4 = 0 THEN 'created' WHEN m.line % 4 = 1 THEN 'uploaded' ELSE 'error' END AS action,
       CASE WHEN m.line % 4 = 0 THEN concat('new', CAST(m.line AS STRING)) END AS dest_id,
       CASE WHEN m.line % 4 = 1 THEN concat('tok', CAST(m.line AS STRING)) END AS token
FROM v_manifest m WHERE m.line % 5 < 3""",
    "v_classifications": "SELECT CAST(n_nationkey AS STRING) AS id, concat(r_name, '/', n_name) AS name_path FROM nation JOIN region ON n_regionkey = r_regionkey",
    "v_option_items": "SELECT DISTINCT concat('opt-', lower(p_type)) AS id, p_type AS name FROM part",
    "v_users": "SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, concat(lower(c_name), '@example.com') AS email FROM customer",
    "v_files": "SELECT concat('parts/', CAST(p_partkey AS STRING), '.jpg') AS path, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 8 <> 0",
}
TABLES = ("lineitem", "orders", "events", "documents", "part", "nation", "region", "customer")


def _uses(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame.  Timestamps are instants here."""
    text, given = VIEWS[name].replace("sha256(m.raw)", "sha2(m.raw, 256)"), {}
    for v in _uses(text):
        given[v] = view(spark, sf_dir, v)
    for t in TABLES:
        if re.search(rf"\b{t}\b(?=\s|$)", re.sub(r"'[^']*'", "", text)):
            given[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for k in given:
        text = re.sub(rf"(FROM|JOIN) {k}\b", rf"\1 {{{k}}}", text)
    given = {k: v for k, v in given.items() if f"{{{k}}}" in text}
    return spark.sql(text, **given)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    names: list[str] = []

    def add(text: str) -> None:
        for v in _uses(text):
            if v not in names:
                add(VIEWS[v])
                names.append(v)

    add(sql)
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in names)
    if not head:
        return sql
    return f"WITH {head}\n{sql}" if not re.match(r"\s*WITH\b", sql) else f"WITH {head},\n{re.sub(r'^\s*WITH', '', sql)}"

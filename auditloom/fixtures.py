"""Views that bind the driver's tables to the inputs of the jobs.

Every view is one SQL text that Spark and DuckDB both run; names in braces are driver tables or other views. The
columns are arithmetic on keys, so that each branch of a job has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.registry import read

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

VIEWS = {
    "fx_cases": """
        SELECT doc_id AS case_id, lang, source, n_chars, doc_id % 10 <> 0 AS brand_present, doc_id % 25 = 3 AS ambiguous, doc_id % 8 <> 0 AS alcohol_present,
          CASE n_chars % 4 WHEN 0 THEN 'OBSERVED' WHEN 1 THEN 'LOW_CONFIDENCE' WHEN 2 THEN 'AMBIGUOUS' ELSE 'NOT_OBSERVED' END AS state,
          (doc_id * 7 + n_chars) % 5 < 2 AS exact, (doc_id * 7 + n_chars * 3) % 5 < 3 AS normalized, (doc_id * 11 + n_chars) % 7 < 4 AS top3, (doc_id * 11 + n_chars) % 7 < 5 AS top5,
          doc_id % 9 <> 0 AS has_value, (doc_id * 13 + n_chars) % 6 < 4 AS detected, (doc_id * 17 + n_chars) % 4 < 2 AS parsed_ok,
          doc_id % 3 = 0 AS in_candidate, doc_id % 5 = 0 AS in_line, doc_id % 7 = 0 AS in_recovery_candidate, doc_id % 7 = 1 AS in_recovery_line, doc_id % 11 = 0 AS in_primary_candidate, doc_id % 11 = 1 AS in_primary_line,
          doc_id % 2 = 0 AS in_recovery_ocr, doc_id % 13 = 0 AS in_primary_ocr, doc_id % 4 = 0 AS in_ocr,
          doc_id % 17 = 0 AS parser_rejected, doc_id % 19 = 0 AS filter_rejected, doc_id % 6 = 0 AS recovery_evidence, doc_id % 23 = 0 AS primary_evidence, doc_id % 6 = 2 AS adjacent_evidence, doc_id % 6 = 3 AS same_line_evidence,
          doc_id % 3 <> 1 AS number_in_ocr, doc_id % 4 = 1 AS marker_in_ocr,
          CASE WHEN doc_id % 6 IN (0, 2) THEN 'vertical' WHEN doc_id % 6 = 1 THEN 'rotated-180' ELSE 'horizontal' END AS orientation, n_chars AS latency_ms
        FROM {documents}""",
    "fx_passes": """
        SELECT event_id, user_id AS case_id, event_id AS pass_order, event_type AS pass_kind, event_id % 2 = 0 AS new_tokens, event_id % 3 = 0 AS new_evidence, event_id % 5 = 0 AS accepted,
          event_id % 7 = 0 AS changed, event_id % 11 = 0 AS correct, event_id % 13 = 0 AS no_value, CAST(floor(value * 10) AS BIGINT) AS execution_ms
        FROM {events}""",
    "fx_candidates": """
        SELECT l_orderkey AS case_id, CASE WHEN l_linestatus = 'O' THEN 'brand' ELSE 'alcohol' END AS field, l_partkey AS candidate_id, l_linenumber AS priority, CAST(l_quantity AS INT) AS score,
          CAST(l_partkey % 97 AS STRING) AS value, l_suppkey % 3 <> 0 AS kept, l_suppkey % 7 = 0 AS selected, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_discount * 100 AS INT) END AS raw_confidence, l_returnflag AS reason
        FROM {lineitem}""",
    "fx_results": """
        SELECT l_orderkey AS case_id, CASE l_linestatus WHEN 'O' THEN 'brand' ELSE 'alcohol' END AS field, CASE l_returnflag WHEN 'A' THEN 'baseline' WHEN 'N' THEN 'region' ELSE 'rotated' END AS scenario,
          CASE l_linenumber % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 3.0 END AS scale, l_suppkey % 5 <> 0 AS truth_present, l_partkey % 3 = 0 AS correct, l_partkey % 4 AS tokens_present, 4 AS tokens,
          CAST(l_quantity AS INT) AS similarity, CAST(l_quantity * 10 AS BIGINT) AS latency_ms, CASE WHEN l_suppkey % 4 = 0 THEN 'false-certainty' WHEN l_partkey % 3 = 0 THEN 'correct' ELSE 'parser-failure' END AS failure_class, l_linenumber AS repetition
        FROM {lineitem}""",
    "fx_users": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS name, concat('u', CAST(c_custkey AS STRING), '@x') AS email FROM {customer}",
    "fx_submissions": """
        SELECT o_orderkey AS submission_id, o_custkey AS creator_id, CASE o_orderstatus WHEN 'O' THEN 'waiting_for_agent_review' WHEN 'P' THEN (CASE WHEN o_orderkey % 2 = 0 THEN 'in_agent_review' ELSE 'changes_requested' END) ELSE 'internally_accepted' END AS current_status,
          o_orderkey % 20 = 0 AS is_demo, o_orderdate AS created_at FROM {orders}""",
    "fx_revisions": """
        SELECT l_orderkey AS submission_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS revision_number, l_suppkey AS submitted_by, l_shipdate AS submitted_at FROM {lineitem}""",
    "fx_panels": "SELECT l_orderkey AS submission_id, CASE WHEN l_linestatus = 'O' THEN 'child' ELSE 'parent' END AS side, l_returnflag AS role, md5(CAST(l_partkey % 5 AS STRING)) AS checksum FROM {lineitem}",
    "fx_events": """
        SELECT event_id, user_id AS submission_id, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'release' WHEN 'purchase' THEN 'internally_accepted' WHEN 'error' THEN 'changes_requested' ELSE 'waiting_for_agent_review' END AS action,
          ts AS recorded_at, event_id % 500 AS idem_key, md5(props) AS request_hash FROM {events}""",
    "fx_history": "SELECT conv_id AS log_key, turn + 1 AS sequence, role AS decision, md5(text) AS entry_id FROM {conversations}",
    "fx_boxes": """
        SELECT vec_id, label AS case_id, CASE WHEN vec_id % 5 = 0 THEN 'target' ELSE 'proposal' END AS role, embedding[{first}] AS e0, embedding[{first} + 1] AS e1, embedding[{first} + 2] AS e2, embedding[{first} + 3] AS e3 FROM {embeddings}""",
    "fx_trials": """
        SELECT event_id AS sequence, CAST(floor(event_id / 3) AS BIGINT) AS block, event_id % 3 + 1 AS position, CASE (event_id + CAST(floor(event_id / 3) AS BIGINT)) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A_PRIME' ELSE 'B' END AS contract,
          CASE event_type WHEN 'error' THEN 'HARD_NON_COMPLETION' WHEN 'click' THEN 'LATE_VALID_COMPLETION' ELSE 'TIMELY_VALID_COMPLETION' END AS state, value AS latency_ms FROM {events}""",
    "fx_expected": "SELECT doc_id AS case_id, {sha}(text) AS digest, n_chars AS byte_length FROM {documents} WHERE doc_id % 11 <> 0",
    "fx_actual": "SELECT doc_id AS case_id, {sha}(CASE WHEN doc_id % 17 = 0 THEN concat('x', text) ELSE text END) AS digest, n_chars AS byte_length FROM {documents} WHERE doc_id % 13 <> 0",
    "fx_statements": """
        SELECT l_orderkey AS case_id, l_linenumber AS line, concat('ALC. ', CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN '% BY VOL.' ELSE ' % alc/vol' END) AS statement, CAST(CAST(l_quantity AS INT) + (l_linenumber % 3) AS STRING) AS declared
        FROM {lineitem}""",
    "fx_traces": """
        SELECT l_orderkey AS target_id, l_orderkey % 50 AS case_id, CASE l_linestatus WHEN 'O' THEN 'brand' ELSE 'alcohol' END AS field, l_linenumber % 6 <> 0 AS proposed, l_partkey % 5 <> 0 AS class_kept, l_suppkey % 4 <> 0 AS recovered, l_partkey % 7 <> 0 AS assembled,
          l_suppkey % 3 <> 0 AS projected, l_partkey % 11 <> 0 AS ranked, l_suppkey % 13 <> 0 AS trusted, l_returnflag AS source, CASE WHEN l_tax > 0.04 THEN 'heading' ELSE 'body' END AS class_a, CASE WHEN l_discount > 0.05 THEN 'heading' ELSE 'body' END AS class_b FROM {lineitem}""",
    "fx_entries": """
        SELECT o_orderkey AS case_id, o_custkey AS owner, md5(CAST(o_orderkey % 700 AS STRING)) AS digest, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS category, o_orderstatus AS status, o_orderdate AS started_at,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + INTERVAL 2 DAY END AS completed_at, o_orderdate + INTERVAL 1 DAY AS recorded_at, o_orderkey % 12 + o_custkey % 5 AS total_burden, o_orderkey % 8 AS part_a, o_custkey % 4 AS part_b, o_orderkey % 15 = 0 AS has_issue,
          CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey - 10 WHEN o_orderkey % 10 = 3 THEN o_orderkey WHEN o_orderkey % 50 = 1 THEN 99999999 END AS duplicate_of FROM {orders}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or driver table as a DataFrame."""
    if name in TABLES:
        return read(spark, sf_dir, name)
    sql = VIEWS[name].replace("{first}", "0").replace("{sha}(text)", "sha2(text, 256)").replace("{sha}(CASE WHEN doc_id % 17 = 0 THEN concat('x', text) ELSE text END)", "sha2(CASE WHEN doc_id % 17 = 0 THEN concat('x', text) ELSE text END, 256)")
    used = {t: read(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def duck(*names: str, sql: str, recursive: bool = False) -> str:
    """DuckDB SQL that may use views by name."""
    parts = [f"{n} AS ({VIEWS[n].replace('{first}', '1').replace('{sha}', 'sha256').replace('AS STRING)', 'AS VARCHAR)')})" for n in names]
    for t in TABLES:
        parts = [p.replace(f"{{{t}}}", t) for p in parts]
    head = "WITH RECURSIVE " if recursive else "WITH "
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return head + ",\n".join([*parts, sql[5:]])
    return head + ",\n".join(parts) + "\n" + sql

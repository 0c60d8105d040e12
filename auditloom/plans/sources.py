"""Queries of the source, digest and stream jobs, with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.fixtures import VIEWS, duck, view
from auditloom.operators import logs as lg
from auditloom.operators import review as rv
from auditloom.operators import sealing as sl
from auditloom.registry import Registry, read
from auditloom.sources import tables as tb
from auditloom.streaming import review as st

def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a file stream. All files that are there make one micro-batch, as their order says nothing about that of events."""
    schema = read(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return spark.sql(VIEWS["fx_events"], events=files)


SECRET = b"key of the tests"
#: The review state by recursion over each submission's events.
STATES = duck("fx_events", sql="""WITH o AS (SELECT event_id, submission_id, action, row_number() OVER (PARTITION BY submission_id ORDER BY recorded_at, event_id) AS k FROM fx_events),
  w AS (SELECT submission_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, 'waiting_for_agent_review' AS status, CAST(0 AS BIGINT) AS version, false AS held FROM o WHERE k = 1
    UNION ALL SELECT submission_id, k, event_id, outcome, CASE WHEN outcome <> 'accepted' THEN status WHEN action = 'claim' THEN 'in_agent_review' WHEN action = 'release' THEN 'waiting_for_agent_review' ELSE action END, version + (outcome = 'accepted')::INT, CASE WHEN outcome = 'accepted' THEN action = 'claim' ELSE held END
    FROM (SELECT w.submission_id, o.k, o.event_id, o.action, w.status, w.version, w.held, CASE WHEN w.status = 'internally_accepted' THEN 'closed' WHEN o.action = 'claim' AND held THEN 'already_claimed' WHEN o.action = 'claim' AND w.status <> 'waiting_for_agent_review' THEN 'not_waiting'
      WHEN o.action = 'waiting_for_agent_review' AND w.status <> 'changes_requested' THEN 'not_requested' WHEN o.action NOT IN ('claim', 'waiting_for_agent_review') AND NOT held THEN 'not_claimed' ELSE 'accepted' END AS outcome FROM w JOIN o ON o.submission_id = w.submission_id AND o.k = w.k + 1))
  SELECT event_id, submission_id, outcome, status, version FROM w WHERE k > 0""", recursive=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{tb.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents listed in manifests of 10,000 ids, written and read again: good records and issues."""
    docs = view(spark, sf_dir, "documents")
    digest = F.when(F.col("doc_id") % 50 == 3, "short").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    path = fresh_path(spark, "manifests")
    tb.write_manifests(docs.select(F.floor(F.col("doc_id") / 10_000).alias("file"), F.col("doc_id").cast("string").alias("id"), digest.alias("sha256"), F.col("n_chars").cast("long").alias("bytes")), path, "v1")
    good, bad = tb.read_manifest(spark, path, "v1")
    sizes = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("long").alias("bytes"))
    return good.select("id", F.lit(None).cast("string").alias("issue"), "bytes").unionByName(bad.select("id", "issue").join(sizes, "id"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose correctness changed, as CSV and read again."""
    docs, path = view(spark, sf_dir, "documents"), fresh_path(spark, "changed")
    base = docs.select(F.col("doc_id").alias("case_id"), F.lit("OBSERVED").alias("state"), (F.col("doc_id") % 3 != 0).alias("correct"))
    new = base.withColumn("correct", F.when(F.col("case_id") % 4 == 0, ~F.col("correct")).otherwise(F.col("correct")))
    tb.write_changed_csv(rv.before_after(base, new, "case_id"), path)
    return spark.read.schema("case_id long, state_before string, correct_before boolean, state_after string, correct_after boolean, verdict string").option("header", True).csv(path).select("case_id", "verdict")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language and by source as the parts of a report, written and read again."""
    docs, path = view(spark, sf_dir, "documents"), fresh_path(spark, "report")
    tb.write_report({f"by_{c}": docs.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")) for c in ("lang", "source")}, path, "run-1")
    parts = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("part"), "key", "n", "run_id") for name in ("by_lang", "by_source")]
    return parts[0].unionByName(parts[1])


def register(r: Registry) -> None:
    r.add("io1_load_table", "SELECT * FROM labels WHERE toxic = 1")(lambda s, d: tb.load_table(s, d, "labels").filter("toxic = 1"))
    r.add("io3_artifact_inventory")(lambda s, d: tb.artifact_inventory(s, f"{d}/*.parquet"))
    export = lambda s, d: sl.canonical_export(view(s, d, "events"), "event_id", "props")
    r.add("io5_canonical_export", "SELECT event_id, CAST(json(props) AS VARCHAR) AS canonical_json, sha256(CAST(json(props) AS VARCHAR)) AS sha256 FROM events")(export)
    r.add("v21_verify_digests", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'absent' ELSE 'mismatch' END AS issue FROM events WHERE event_id % 9 = 0 OR event_id % 7 = 0")(
        lambda s, d: sl.verify_digests(export(s, d), export(s, d).filter("event_id % 9 <> 0").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("claimed")), "event_id")
    )
    levels, below = [], "e"
    for i in range(sl.LEVELS):
        levels.append(f"l{i} AS (SELECT CAST(floor(pos / {sl.FAN}::DOUBLE) AS BIGINT) AS pos, sha256(string_agg(d, '' ORDER BY {below}.pos, d)) AS d, sum(n) AS n FROM {below} GROUP BY 1)")
        below = f"l{i}"
    r.add("a44_manifest_seal", f"WITH e AS (SELECT event_id AS pos, sha256(CAST(json(props) AS VARCHAR)) AS d, 1 AS n FROM events), {', '.join(levels)} SELECT sha256(string_agg(d, '' ORDER BY pos, d)) AS seal, CAST(sum(n) AS BIGINT) AS n FROM {below}")(lambda s, d: sl.seal(export(s, d), "event_id"))
    r.add("v21_verify_signatures", "SELECT event_id, 'mismatch' AS issue FROM events WHERE event_id % 7 = 0")(
        lambda s, d: sl.verify_digests(sl.signed(export(s, d), "event_id", "canonical_json", SECRET).withColumnRenamed("signature", "sha256"), sl.signed(export(s, d).withColumn("canonical_json", F.when(F.col("event_id") % 7 == 0, F.concat("canonical_json", F.lit(" "))).otherwise(F.col("canonical_json"))), "event_id", "canonical_json", SECRET).withColumnRenamed("signature", "claimed"), "event_id")
    )
    r.add("v2_forbidden_keys", "SELECT event_id, '$.token' AS path FROM events WHERE event_id % 5 = 1 UNION ALL SELECT event_id, unnest(['$.a.secret', '$.a.b.token', '$.a.c[1].d[0].e.secret']) FROM events WHERE event_id % 5 = 0")(
        lambda s, d: sl.forbidden_keys(view(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"a":{"secret":1,"b":{"token":2},"c":[3,{"d":[{"e":{"secret":4}}]}]},"p":'), "props", F.lit("}"))).when(F.col("event_id") % 5 == 1, F.lit('{"token":"x"}')).otherwise(F.col("props")).alias("json")), "event_id", "json", ["secret", "token"])
    )
    r.add("io2_read_manifest", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 50 = 3 THEN 'bad_digest' END AS issue, n_chars AS bytes FROM documents")(manifests)
    r.add("io4_changed_csv", "SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN 'IMPROVED' ELSE 'REGRESSED' END AS verdict FROM documents WHERE doc_id % 4 = 0")(changed)
    r.add("io6_report", "SELECT 'by_lang' AS part, lang AS key, count(*) AS n, 'run-1' AS run_id FROM documents GROUP BY lang UNION ALL SELECT 'by_source', source, count(*), 'run-1' FROM documents GROUP BY source")(report)
    r.add("st1_idempotent_ingest", duck("fx_events", sql="SELECT event_id, idem_key, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN request_hash = first(request_hash) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM fx_events WINDOW w AS (PARTITION BY idem_key ORDER BY recorded_at, event_id)"))(lambda s, d: st.drained(st.idempotent_ingest(event_stream(s, d))))
    r.add("st2_review_state", STATES)(lambda s, d: st.drained(st.review_state(event_stream(s, d))))
    r.add("st2_review_state_batch", STATES)(lambda s, d: lg.review_state(view(s, d, "fx_events")))

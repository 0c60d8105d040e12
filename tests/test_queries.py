"""Every query of the library against its SQL, and small cases by hand."""

from __future__ import annotations

import gzip
import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from auditloom.catalog import REGISTRY
from auditloom.functions import statements, text
from auditloom.functions.scores import alcohol_class, brand_class
from auditloom.operators import dealing, extraction, grids, logs, review, sealing, spatial
from auditloom.sources import tables
from auditloom.streaming import review as streams

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = SF / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 7)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return tuple(map(plain, v.values())) if isinstance(v, dict) else v


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_same_as_sql(spark, duck, name):
    df = REGISTRY.queries[name](spark, str(SF))
    columns = sorted(df.columns)
    assert len(columns) == len(set(columns))
    found = duck.sql(REGISTRY.sql[name])
    assert sorted(found.columns) == columns
    at = [list(found.columns).index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert Counter(tuple(plain(x) for x in r) for r in df.select(*columns).collect()) == want


def test_library_stands_without_the_optional_part():
    root = Path(__file__).resolve().parents[1] / "auditloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path


def case(spark, **change):
    flags = dict.fromkeys("brand_present ambiguous exact normalized top3 has_value in_candidate in_line in_recovery_candidate in_recovery_line in_primary_candidate in_primary_line in_recovery_ocr in_primary_ocr in_ocr alcohol_present detected parsed_ok parser_rejected filter_rejected recovery_evidence primary_evidence adjacent_evidence same_line_evidence number_in_ocr marker_in_ocr".split(), False)
    row = flags | {"brand_present": True, "alcohol_present": True, "has_value": True, "state": "OBSERVED"} | change
    r = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).select(brand_class().alias("b"), alcohol_class().alias("a")).first()
    return r["b"], r["a"]


def test_failure_classes(spark):
    assert case(spark, exact=True, detected=True, parsed_ok=True) == ("correct", "correct")
    assert case(spark) == ("false-certainty", "ocr-recognition-failure")
    assert case(spark, brand_present=False, alcohol_present=False, detected=True) == ("false-certainty", "false-certainty")
    assert case(spark, state="AMBIGUOUS", normalized=True, parser_rejected=True) == ("correct-uncertainty", "parser-failure")
    assert case(spark, state="NOT_OBSERVED", in_recovery_ocr=True, recovery_evidence=True) == ("region-coverage-failure", "region-coverage-failure")
    assert case(spark, state="NOT_OBSERVED", number_in_ocr=True, marker_in_ocr=True) == ("candidate-generation-failure", "candidate-generation-failure")
    assert case(spark, state="LOW_CONFIDENCE", ambiguous=True, detected=True) == ("correct-uncertainty", "parser-failure")


def test_statements(spark):
    cases = {"12.5% by vol": ("direct", 1250, 1250), "ALC. 12,50 %  VOL.": ("direct", 1250, 1250), "alcohol 13 by volume": ("direct", 1300, 1300), "12% alc/vol": ("direct", 1200, 1200), "alc 11% to 14% by vol.": ("range", 1100, 1400), "14-11% by vol": ("malformed", None, None), "80 proof": ("proof", None, None), "12.555% by vol": ("malformed", None, None), "101% by vol": ("malformed", None, None), "about 12% by vol": ("malformed", None, None), "12": ("malformed", None, None)}
    got = statements.stated(spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string"), "t").collect()
    assert {r["t"]: (r["kind"], r["low"], r["high"]) for r in got} == cases | {None: ("malformed", None, None)}


WINDOWS = {
    "12.5% by vol": ("direct", 1250, 1250, "explicit-percent-by-volume"), "ALC13% BY VOL.": ("direct", 1300, 1300, "explicit-percent-alc-vol"), "a1c. I3.5% by v0l": ("direct", 1350, 1350, "explicit-percent-alc-vol"),
    "ALC % 13,5 BY VOL": ("direct", 1350, 1350, "explicit-percent-alc-vol"), "13 . 5 % ALC . / VOL": ("rejected", None, None, "unsupported-pattern"), "13.5% alc./vol.": ("direct", 1350, 1350, "explicit-percent-alc-vol"),
    "alc 14% vol": ("direct", 1400, 1400, "explicit-percent-alc-vol"), "alcohol 14 by volume": ("direct", 1400, 1400, "explicit-percentless-alcohol-by-volume"), "ALC 135 VOL": ("direct", 1350, 1350, "explicit-percentless-alcohol-by-volume"),
    "13% abv": ("direct", 1300, 1300, "explicit-percent-by-volume"), "13% byvol": ("direct", 1300, 1300, "explicit-percent-by-volume"), "11% to 14% by vol": ("range", 1100, 1400, "explicit-percent-by-volume"), "alc 14-11% by vol": ("rejected", None, None, "unsupported-pattern"),
    "no digits by vol": ("rejected", None, None, "no-supported-number"), "80 proof": ("rejected", None, None, "proof-only"), "80 proof by vol": ("rejected", None, None, "proof-only"), "13%": ("rejected", None, None, "missing-volume-marker"),
    "13 by vol": ("rejected", None, None, "missing-explicit-alcohol-marker"), "13% vol": ("rejected", None, None, "bare-volume-marker-too-weak"), "about 13% by vol": ("rejected", None, None, "unsupported-pattern"),
}


def test_windows(spark):
    got = statements.matched(spark.createDataFrame([(k,) for k in WINDOWS] + [(None,)], "t string"), "t").collect()
    assert {r["t"]: (r["kind"], r["low"], r["high"], r["reason"]) for r in got} == WINDOWS | {None: ("rejected", None, None, "no-supported-number")}


def test_brands_and_texts(spark):
    rows = [("Acme, Inc.", "acme"), ("ACME  L.L.C.", "acme"), ("Co Cellars", "co cellars"), ("Inc.", "inc."), ("O’Neil Co.", "o'neil"), ("Plain", "plain")]
    got = spark.createDataFrame(rows, "b string, k string").select(text.brand_key(F.col("b")).alias("got"), "k").collect()
    assert all(r["got"] == r["k"] for r in got)
    r = spark.range(1).select(text.canonical(F.lit(" It’s, A-B!\u00a0C ")).alias("c"), text.quantities(F.lit("Bottle 0.75 L x, 33cl; 5 lit")).alias("m"), text.similarity(F.lit("kitten"), F.lit("sitting")).alias("s")).first()
    assert (r["c"], r["m"], r["s"]) == ("it's a-b c", [750.0, 330.0], 0.57)


def test_multiset_diff_keeps_counts(spark):
    rows = [(i % 3, random.choice(["parent", "child"]), random.choice("xy"), random.choice("abcde")) for i in range(300)]
    panels = spark.createDataFrame(rows, "submission_id long, side string, role string, checksum string")
    got = review.multiset_diff(panels).collect()
    for side, column in (("parent", "was"), ("child", "now")):
        n = Counter()
        for r in got:
            if r[column] is not None:
                n[r["submission_id"], r["role"], r[column]] += r["n"]
        assert n == Counter((s, role, c) for s, d, role, c in rows if d == side)
    kinds = {(r["submission_id"], r["role"]): set() for r in got}
    for r in got:
        kinds[r["submission_id"], r["role"]].add(r["change"])
    assert all(not {"added", "removed"} <= k for k in kinds.values())  # one side alone has leftovers


def test_union_area(spark):
    boxes = [(1, 0.0, 0.0, 0.5, 0.5), (1, 0.25, 0.25, 0.75, 0.75), (1, 0.0, 0.0, 0.1, 0.1), (2, 0.0, 0.0, 0.2, 0.2), (2, 0.5, 0.0, 0.6, 1.0)]
    got = {r["case_id"]: r["area"] for r in spatial.union_area(spark.createDataFrame(boxes, "case_id int, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert got == {1: pytest.approx(0.4375), 2: pytest.approx(0.14)}


def test_order_is_balanced(spark):
    got = logs.counterbalanced_order(spark.range(101).withColumnRenamed("id", "case_id"), "seed").collect()
    assert sorted(r["rank"] for r in got if r["block"] == 1) == list(range(1, 102))
    assert Counter((r["block"], r["mode"]) for r in got) == {(1, "A"): 51, (1, "B"): 50, (2, "A"): 50, (2, "B"): 51}
    assert len({(r["case_id"], r["mode"]) for r in got}) == 202


def test_paging(spark):
    df = spark.range(120)
    assert [r["id"] for r in review.page(df, [F.col("id")], 3, 50).collect()] == list(range(100, 120))
    assert len(review.page(df, [F.col("id")], 0, 500).collect()) == 50


def test_funnel_never_rises(spark):
    rows = [tuple(random.random() < 0.7 for _ in range(4)) for _ in range(200)]
    got = sorted((r["stage"], r["alive"]) for r in grids.survival_funnel(spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean"), list("abcd")).collect())
    assert [n for _, n in got] == sorted((n for _, n in got), reverse=True)




def stream_of(spark, tmp_path, df):
    """Rows in order of the first column, a third a micro-batch."""
    n = df.count()
    low = df.agg(F.min(df.columns[0])).first()[0]
    for i in range(3):
        at = F.floor((F.col(df.columns[0]) - low) * 3 / n)
        df.filter(F.least(at, F.lit(2)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in order of their times
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(i, i % 13, random.choice("ab"), i) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, idem_key long, request_hash string, recorded_at long")
    one = {(r["event_id"], r["outcome"]) for r in logs.idempotent_ingest(df).collect()}
    assert {(r["event_id"], r["outcome"]) for r in streams.drained(streams.idempotent_ingest(stream_of(spark, tmp_path, df))).collect()} == one


def test_review_stream(spark, tmp_path):
    rows = [(0, 1, "claim"), (1, 1, "claim"), (2, 1, "changes_requested"), (3, 1, "claim"), (4, 1, "waiting_for_agent_review"), (5, 1, "claim"), (6, 1, "release"), (7, 1, "internally_accepted"), (8, 1, "claim"), (9, 1, "internally_accepted"), (10, 1, "claim"), (11, 2, "release")]
    df = spark.createDataFrame([(*r, r[0]) for r in rows], "event_id long, submission_id long, action string, recorded_at long")
    got = {r["event_id"]: (r["outcome"], r["version"]) for r in streams.drained(streams.review_state(stream_of(spark, tmp_path, df))).collect()}
    assert [got[i] for i in range(12)] == [("accepted", 1), ("already_claimed", 1), ("accepted", 2), ("not_waiting", 2), ("accepted", 3), ("accepted", 4), ("accepted", 5), ("not_claimed", 5), ("accepted", 6), ("accepted", 7), ("closed", 7), ("not_claimed", 0)]


def test_head_stream(spark, tmp_path):
    rows = [(1, 1, "a", ""), (1, 2, "b", "a"), (1, 3, "c", "a"), (1, 4, "d", "b"), (2, 1, "x", "y")]
    df = spark.createDataFrame(rows, "log_key long, sequence long, entry_id string, names string")
    got = {r["entry_id"]: r["outcome"] for r in streams.drained(streams.append_head(stream_of(spark, tmp_path, df.select("sequence", "log_key", "entry_id", "names")))).collect()}
    assert got == {"a": "accepted", "b": "accepted", "c": "stale", "d": "accepted", "x": "stale"}


def test_manifest_and_report(spark, tmp_path):
    good = '{"version": "v1", "records": [{"id": "a", "sha256": "' + "0" * 64 + '", "bytes": 1}, {"id": null, "sha256": "' + "1" * 64 + '", "bytes": 2}, {"id": "c", "sha256": "x", "bytes": 3}]}'
    (tmp_path / "m").mkdir()
    for name, body in (("a.json", good), ("b.json", '{"version": "v2", "records": []}'), ("c.json", "{broken")):
        (tmp_path / "m" / name).write_text(body)
    records, issues = tables.read_manifest(spark, str(tmp_path / "m"), "v1")
    assert [r["id"] for r in records.collect()] == ["a"]
    assert Counter(r["issue"] for r in issues.collect()) == {"no_id": 1, "bad_digest": 1, "wrong_version": 1, "unreadable": 1}
    found = {r["name"]: r for r in tables.artifact_inventory(spark, str(tmp_path / "m")).collect()}
    assert found["a.json"]["bytes"] == len(good) and found["a.json"]["kind"] == "other"
    tables.write_report({"part": spark.range(3)}, str(tmp_path / "r"), "run1")
    tables.write_report({"part": spark.range(2)}, str(tmp_path / "r"), "run2")
    assert {(r["run_id"], r["count"]) for r in spark.read.parquet(str(tmp_path / "r/part")).groupBy("run_id").count().collect()} == {("run1", 3), ("run2", 2)}
    tables.write_changed_csv(spark.range(2), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    some = random.Random(3)
    body = some.randbytes(200_000)
    files = {"a b%20.bin": body, "mark.txt": b"\xef\xbb\xbf" + body[:30_000], "mark_end.txt": b"\xef\xbb\xbf\xef\xbb\xbf" + body[:90_000] + b"\n", "ends.pdf": b"%PDF" + body[:70_000] + b"\r\n\n", "ends_not.png": b"\x89PNG" + body[:70_000] + b"\n\r"}
    files |= {"lines.bin": b"\n" * 120_000, "line.bin": b"x" * 600_000, "first.bin": b"\n" + body[:60_000], "small.bin": body[:999], "masked.pdf": b"\xef\xbb\xbf%PDF" + body[:3_000], "packed.gz": gzip.compress(body[:500]), "z.parquet": b"PAR1" + body[:100_000] + b"PAR1"}
    (tmp_path / "d" / "e").mkdir(parents=True)
    for i, (name, data) in enumerate(files.items()):
        (tmp_path / "d" / ("e" if i % 2 else "") / name).write_bytes(data)
    monkeypatch.setattr(tables, "PIECE", 50_000)
    limits = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = tables.artifact_inventory(spark, str(tmp_path / "d")).collect()
    finally:
        for k in limits:
            spark.conf.unset(k)
    kinds = {"ends.pdf": "pdf", "ends_not.png": "png", "z.parquet": "parquet"}
    assert sorted(tuple(r) for r in got) == sorted((n, hashlib.sha256(x).hexdigest(), len(x), kinds.get(n, "other")) for n, x in files.items())


def test_seal_moves_with_any_row(spark):
    df = spark.range(500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    one = sealing.seal(df, "id").first()["seal"]
    assert sealing.seal(df.repartition(9), "id").first()["seal"] == one
    assert sealing.seal(df.withColumn("sha256", F.when(F.col("id") == 77, F.lit("x")).otherwise(F.col("sha256"))), "id").first()["seal"] != one


def test_lines_are_grouped_first_fit(spark):
    words = [(c, i, float(random.randrange(400)), float(random.randrange(200))) for c in range(3) for i in range(40)]
    df = spark.createDataFrame([(c, i, x, y, x + 10, y + 10) for c, i, x, y in words], "case_id int, word_ix int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["case_id"], r["word_ix"]): r["line"] for r in extraction.group_lines(df).collect()}
    for case in range(3):
        starts: list[float] = []
        for _, i, _, y in sorted((w for w in words if w[0] == case), key=lambda w: (w[3] + 5, w[2], w[1])):
            fits = [k for k, s in enumerate(starts) if abs(y + 5 - s) <= 20]
            if not fits:
                starts.append(y + 5)
            assert got[case, i] == (fits[0] if fits else len(starts) - 1)


def test_word_components(spark):
    boxes = [(c, 100 * c + i, x, y, x + 0.04, y + 0.03) for c in range(2) for i in range(40) for x, y in [(random.random() * 0.9, random.random() * 0.9)]]
    got = {r["id"]: r["component"] for r in spatial.word_components(spark.createDataFrame(boxes, "case_id int, id int, x0 double, y0 double, x1 double, y1 double"), 0.02, 0.0, 0.0).collect()}
    root = {b[1]: b[1] for b in boxes}
    changed = True
    while changed:
        changed = False
        for a in boxes:
            for b in boxes:
                if a[0] == b[0] and max(b[2] - a[4], a[2] - b[4]) <= 0.02 and max(b[3] - a[5], a[3] - b[5]) <= 0.02 and root[a[1]] > root[b[1]]:
                    root[a[1]], changed = root[b[1]], True
    assert got == root


def test_contamination_as_sql_says(spark):
    docs = [(0, "plain text  of the\n river and a mill that stands by it"), (1, "ab"), (2, None), (3, ""), (4, "x\x0by"), (5, "  ein Fluß\tan der Mühle "), (6, "w " * 200_000 + "the far end"), (6, "the far end"), (7, "x y")]
    items = [(0, "ain text of"), (1, "b"), (2, "far  en"), (3, " "), (4, None), (5, "x y"), (6, "ß an der M"), (7, "the river and a mill that stands by it"), (7, "the river and a mill that stands by it"), (8, "river and a mill that stands by it, and much further than the text goes on behind the place")]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = extraction.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(REGISTRY.sql["j16_contamination"]).fetchall())


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_rows_are_dealt_by_their_number(spark):
    rows = dealing.dealt(spark.range(5000).withColumn("k", F.col("id") % 700), "k", each=100)
    assert rows.rdd.getNumPartitions() == 50 and dealing.tasks(spark.range(3)) == 4
    assert rows.select("k", F.spark_partition_id().alias("p")).groupBy("k").agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0] == 1
    plan = REGISTRY.queries["x11_select_name"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1  # cases stay together from the table on


def test_multiset_diff_meets_once(spark):
    rows = [(s % 3, side, "r", c) for s, side, c in [(0, "parent", "a"), (0, "parent", "a"), (0, "child", "b"), (0, "parent", "c"), (0, "child", "c"), (1, "parent", "a"), (1, "parent", "b"), (1, "child", "c"), (1, "child", "d"), (2, "child", "z"), (2, "child", "z")]]
    got = review.multiset_diff(spark.createDataFrame(rows, "submission_id long, side string, role string, checksum string"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(0, "r", "unchanged", "c", "c", 1), (0, "r", "replaced", "a", "b", 1), (0, "r", "removed", "a", None, 1), (1, "r", "replaced", "a", "c", 1), (1, "r", "replaced", "b", "d", 1), (2, "r", "added", None, "z", 2)]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_result_rules_stay_where_they_were_dealt(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = REGISTRY.queries["v23_result_rules"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") >= 3

"""Nothing that a row says is lost, and no key holds more than its share."""

from __future__ import annotations

import json
import random
import time

from pyspark.sql import functions as F

from auditloom.llm import chat, mix, toxicity

MESSAGES = "conv string, seq int, role string, content string, call_id string, name string, arguments string, after array<string>"
SCHEMA = {"f": {"properties": {"x": {"type": "integer"}}}}


def test_calls_and_results_keep_all_their_fields(spark):
    rows = [
        ("c", 0, "assistant", "call text A", "k", "f", '{"x":1}', None), ("c", 1, "assistant", "call text B", "k", "f", '{"x":1}', ["j", "k"]),
        ("c", 2, "tool", "answer", "k", None, '{"y": [2, 1]}', None), ("c", 3, "other", "orphan", "q", None, "no json", ["k"]),
        (None, 4, "user", None, "k", "f", '{"x":1}', ["z"]), (None, 5, "tool", "lone", "k", None, None, None),
    ]
    got = chat.link(spark.createDataFrame(rows, MESSAGES), SCHEMA).collect()
    said = {(r["kind"], r["seq"]): json.loads(r["canonical"]) for r in got}
    assert len(got) == 5
    first, second = said["linked", 0], said["repeated_call", 1]
    assert (first["content"], second["content"], first["role"]) == ("call text A", "call text B", "assistant")
    assert first["result"] == {"after": None, "arguments": {"y": [2, 1]}, "content": "answer", "role": "tool"} and second["after"] == ["j", "k"]
    assert said["orphan_result", 3]["result"] == {"after": ["k"], "arguments": "no json", "content": "orphan", "role": "other"}
    assert said["message", 4] == {"after": ["z"], "arguments": {"x": 1}, "content": None, "id": "k", "name": "f", "role": "user"}
    assert said["message", 5]["content"] == "lone" and said["message", 5]["id"] == "k"
    for r in got:
        assert r["canonical"] == json.dumps(json.loads(r["canonical"]), separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def slow_positions(calls):
    """Longest chains by repeated relaxation; calls that never come to an end have none."""
    out = {}
    keys = {(c, i) for c, i, _ in calls}
    ups = {(c, i): {(c, a) for a in after if (c, a) in keys} for c, i, after in calls}
    while True:
        ready = {k: max((out[u] + 1 for u in up), default=0) for k, up in ups.items() if k not in out and all(u in out for u in up)}
        if not ready:
            return {k: out.get(k) for k in keys}
        out |= ready


def test_positions_equal_brute_force(spark):
    rng = random.Random(1)
    for share in (0.0, 0.1, 0.6):
        calls = [(f"c{i % 4}", str(i // 4), sorted({str(rng.randint(0, max(0, i // 4 - (rng.random() > 0.02)))) for _ in range(rng.choice([0, 1, 1, 1, 2]) if rng.random() < 0.7 else (3 if rng.random() < share else 1))})) for i in range(160)]
        got = chat.positions(spark.createDataFrame(calls, "conv string, call_id string, after array<string>")).collect()
        assert {(r["conv"], r["call_id"]): r["position"] for r in got} == slow_positions(calls)


def test_long_chains_take_few_rounds(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("'long' AS conv", "CAST(id AS STRING) AS call_id", "CASE WHEN id = 0 THEN array() WHEN id = 5000 THEN array('4999', '17') ELSE array(CAST(id - 1 AS STRING)) END AS after")
    start = time.time()
    got = chat.positions(chain)
    assert got.filter("position = CAST(call_id AS BIGINT)").count() == n
    assert time.time() - start < 120


def test_documents_of_one_key_are_dealt_apart(spark):
    docs = spark.createDataFrame([(7, f"word {i} " * (1 + i % 3), "s") for i in range(1500)] + [(None, f"x {i}", "t") for i in range(200)], "doc_id long, text string, source string")
    text = F.md5(F.coalesce("text", F.lit("")))
    assert docs.select(F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))).distinct().count() == 1700
    got = mix.mix(docs)
    sums = {r["source"]: r for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()}
    assert got.count() == 1700 and all(r["over"] <= 0 and abs(r["taken"] - r["target"]) <= 12 for r in sums.values())


def test_repeated_keys_dont_enlarge_the_training_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60)]
    bad = ["zzvile", "qqhate"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" " + " ".join(rng.choice(bad) for _ in range(3)) if i % 2 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = toxicity.fit(spark.createDataFrame(rows * 5, "doc_id long, text string").repartition(3), labels)
    assert once == again
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), once).collect()}
    assert sum(scored[i] == i % 2 for i in range(120)) >= 110

"""Jobs over texts against brute force, on awkward rows."""

from __future__ import annotations

import random
import re
import time
import unicodedata
from collections import Counter

import duckdb
import pytest

from auditloom.catalog import REGISTRY
from auditloom.operators import checks as ck
from auditloom.operators import texts as tx


def slow_signals(rows):
    fold = lambda t: re.sub(r"\s+", " ", t or "").strip().upper()
    out = set()
    for log, seq, run, text, _ in rows:
        own = {(k, fold(t)) for l2, s2, r2, _, ts in rows if (l2, s2, r2) == (log, seq, run) for k, t in ts}
        body = fold(text)
        first = {}
        for l2, s2, _, _, ts in rows:
            for k, t in ts if l2 == log else ():
                if fold(t):
                    first[k, fold(t)] = min(first.get((k, fold(t)), s2), s2)
        out |= {(log, seq, run, k, t, s) for (k, t), s in first.items() if body and s < seq and t in body and (k, t) not in own}
        out |= {(log, seq, run, "comparison", w, None) for w in tx.COMPARING if re.search(rf"\b{w}\b", body)}
    return out


def test_run_signals_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "be", "g", "Alpha beta", "before", "x  y", "", None, "delta-7", "comparisons"])
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.randint(0, 9), f"r{i % 37}", " ".join(word() or "" for _ in range(rng.randint(0, 6))) if i % 9 else None, [(rng.choice("kl"), word()) for _ in range(rng.randint(0, 3))]) for i in range(120)]
    rows = [r for r in rows if r[0] is not None] + [("b", 3, "r1", "same", [("k", "be")])] * 2
    got = tx.run_signals(spark.createDataFrame(rows, "log string, sequence int, run_id string, text string, tokens array<struct<kind:string,token:string>>"))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == slow_signals(rows)
    assert tx.run_signals(spark.createDataFrame([], got.sparkSession.createDataFrame(rows[:1], "log string, sequence int, run_id string, text string, tokens array<struct<kind:string,token:string>>").schema)).collect() == []


def test_run_signals_broadcast_no_exploded_side(spark):
    rows = [("a", 1, "r1", "😀lpha beta", [("k", "Alpha")]), ("a", 2, "r2", "x😀lpha  beta gone", [("k", "😀lpha b")]), ("a", 3, "r3", "one 😀LPHA beta", [])]
    got = tx.run_signals(spark.createDataFrame(rows, "log string, sequence int, run_id string, text string, tokens array<struct<kind:string,token:string>>"))
    assert {tuple(r) for r in got.collect()} == slow_signals(rows)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_run_signals_equal_sql_on_odd_texts(spark, tmp_path):
    texts = ["Straßenbahnhof geht weiter", "zum STRASSENBAHNHOF", "die straßenbahnhof, geht weiter", None, "nichts", "ﬁnanzierungen ᾀ ŉ", "über FINANZIERUNGEN und ﬁnanzierungen ᾀ ŉ Ü", "eins\x0bzwei drei vier", "so eins zwei drei vier", "so Eins\x0bzwei  drei\nvier", "", "ɤabcdefghijkl", "x ɤABCDEFGHIJKL"]
    rows = [(c, t, "user", x) for c in (1, 2, 5) for t, x in enumerate(texts)] + [(5, None, "user", "Straßenbahnhof compare"), (None, 3, "user", "before")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = Counter(c.execute(REGISTRY.sql["j16_run_signals"]).fetchall())
    got = REGISTRY.queries["j16_run_signals"](spark, str(tmp_path)).select("log", "sequence", "run_id", "kind", "token", "first_sequence")
    assert Counter(map(tuple, got.collect())) == want
    tokens = {t for _, _, _, _, t, _ in want}
    assert {"STRAẞENBAHNHOF", "RUN-1-3", "EINS\x0bZWEI DREI VIER", "ɤABCDEFGHIJKL"} <= tokens and "STRASSENBAHNHOF" not in tokens


def slow_common(a: str, b: str):
    for n in range(len(a), 0, -1):
        for i in range(len(a) - n + 1):
            if a[i : i + n] in b:
                return n, i
    return 0, 0


def test_automaton_equals_brute_force_and_is_linear():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé😀"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert tx.Automaton(a).common(b) == slow_common(a, b)
    took = []
    for n in (50_000, 200_000):
        a, b = "ab" * n, "ba" * (n // 2) + "c" + "a" * n
        start = time.process_time()
        assert tx.Automaton(a).common(b) == (n, 1)
        took.append(time.process_time() - start)
    assert took[1] < 16 * took[0] + 0.5


def test_common_parts(spark):
    rng = random.Random(3)
    lines = [(i % 20, j, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 25)))) for i in range(20) for j in range(6)] + [(1, 9, None), (1, 2, "abcabcabc"), (99, 0, "abcab")]
    truths = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for i in range(19)] + [(19, None), (50, "abcabc")]
    got = {r["case_id"]: tuple(r)[1:] for r in tx.common_parts(spark.createDataFrame(lines, "case_id int, line int, text string"), spark.createDataFrame(truths, "case_id int, truth string"), size=3).collect()}
    assert got.keys() == {k for k, _ in truths}
    for case, truth in truths:
        truth = truth or ""
        best = min(((-n, line, at) for c, line, text in lines if c == case and text for n, at in [slow_common(truth, text)] if n >= min(3, max(1, len(truth)))), default=None)
        want = (len(truth), None, "", 0) if best is None or not truth else (len(truth), best[1], truth[best[2] : best[2] - best[0]], -best[0])
        assert got[case] == want


def test_common_parts_of_short_and_long_truths_make_no_grams(spark):
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé😀") for _ in range(rng.randint(1, 14))) for _ in range(2))
        n, at = slow_common(a, b)
        assert tx.common_part(a, b, min(3, len(a))) == ((n, at) if n >= min(3, len(a)) else (0, 0))
    long = "".join(rng.choice("abc") for _ in range(tx.SHORT + 1))
    got = tx.common_parts(spark.createDataFrame([(1, 0, "x" + long[7:40])], "case_id int, line int, text string"), spark.createDataFrame([(1, long)], "case_id int, truth string"))
    assert got.first()["length"] == 33 and "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_compact_keys(spark):
    texts = ["Château Bonneau", "CHATEAU  BONNEAU", "chateau-bonneau", "İstanbul & Söhne", "ﬁne", "中文", "", None, "ÅÆØß 7"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.compact("text").alias("key")).collect()
    for r in rows:
        want = None if r["text"] is None else re.sub("[^a-z0-9]", "", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", r["text"])).lower())
        assert r["key"] == want
    same = tx.key_variants(spark.createDataFrame([(t,) for t in texts * 3], "text string"), tx.compact("text"), top=2)
    assert ("chateaubonneau", 9, 3, "CHATEAU  BONNEAU|Château Bonneau") in {tuple(r) for r in same.collect()}


def test_lines_of_one_side_tell_all_differences(spark):
    rng = random.Random(4)
    texts = [("a", f"a{i}", "\n".join(rng.choice(["x", " y ", "z", "", "w"]) for _ in range(4))) for i in range(4)] + [("b", f"b{i}", "\n".join(rng.choice("pqr") for _ in range(2))) for i in range(3)]
    prints = [(i, f"a{rng.randrange(4)}", None if i == 5 else f"b{rng.randrange(3)}") for i in range(40)]
    got = tx.class_lines(spark.createDataFrame(prints, "run_id int, a string, b string"), spark.createDataFrame(texts, "component string, digest string, text string"), ["a", "b"]).collect()
    have = {(r["component"], r["class_id"], r["line"]) for r in got}
    body = {(c, d): {x.strip(" ") for x in t.split("\n")} - {""} for c, d, t in texts}
    classes = {}
    for i, a, b in prints:
        classes.setdefault((a, b), i)
    for (a, b), i in classes.items():
        for (c, d), j in classes.items():
            for component, mine, other in (("a", a, c), ("b", b, d)):
                if mine and other:
                    assert all((component, i, line) in have for line in body[component, mine] - body[component, other])
    for r in got:
        holding = sum(1 for a, b in classes if (a if r["component"] == "a" else b) and r["line"] in body[r["component"], a if r["component"] == "a" else b])
        assert r["classes"] == holding and r["others"] > 0


def test_nearest_spans_equal_brute_force_and_shuffle_none(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aBc😀"[: rng.randint(2, 4)]) for _ in range(rng.randint(0, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 4))), [word() for _ in range(rng.randint(0, 9))]) for i in range(300)] + [(300, None, ["a"]), (301, "a", None), (302, "x" * 60 + "ba x", ["a" * 100 + "b", "ba", "x" * 70])]
    want = {}
    for i, truth, words in rows:
        k, words = len((truth or "").split(" ")), (words or [])[1:]
        spans = {" ".join(words[a : a + n]) for n in range(max(1, k - 1), k + 2) for a in range(len(words) - n + 1)}
        if truth is not None and spans:
            want[i] = min((ck.edit_distance(x.lower(), truth.lower()), x) for x in spans)
    got = ck.nearest_span(spark.createDataFrame(rows, "case_id int, truth string, words array<string>"), start=1)
    assert {r["case_id"]: (r["distance"], r["span"]) for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_tokens_and_pairs_of_characters_are_counted_without_a_shuffle(spark):
    rows = [(1, ["Ab", "c", "D", "e"], ["ab", "BC", "abcde", "x", None]), (2, None, ["a"]), (3, ["a"], []), (4, ["a", "a"], ["aa", "AA", "aaa"])]
    got = ck.token_coverage(spark.createDataFrame(rows, "case_id int, words array<string>, expected array<string>"))
    assert {tuple(r) for r in got.collect()} == {(1, 5, 1, 1, 3), (2, 1, 0, 0, 1), (4, 3, 0, 2, 1)}
    pairs = [(1, "aaaa", "aa b"), (2, " A ", "a"), (3, None, "x"), (4, "a", "b"), (5, "n\u00e9 n\u00e9", "N\u00c9")]
    alike = ck.bigram_similarity(spark.createDataFrame(pairs, "id int, a string, b string"))
    assert {tuple(r) for r in alike.collect()} == {(1, round(2 / 6, 6)), (2, 1.0), (3, 0.0), (4, 0.0), (5, round(2 / 5, 6))}
    for df in (got, alike):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    lines = spark.createDataFrame([(1, 0, "x")][:n], "case_id int, line int, text string")
    assert tx.common_parts(lines, spark.createDataFrame([], "case_id int, truth string")).collect() == []
    assert tx.key_variants(spark.createDataFrame([], "text string"), tx.compact("text")).collect() == []

"""Every stage of the pipeline on awkward rows, against brute force where a stage chooses rows, and on empty tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditloom.llm import spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    out: list[str] = []
    while sum(len(s.split()) for s in out) < n:
        out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 9))).capitalize() + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    base = prose(120)
    near = base.split()
    near[30] = "edit"
    good = [(i, prose(60), "en", f"s{i % 3}", 1) for i in range(100)]
    bad = [(1000 + i, " ".join(x for w in prose(40).split() for x in (w, rng.choice(["wickedo", "zumblek"])) if x), "en", "s1", 1) for i in range(40)]
    odd = [
        (200, base, "en", "s0", 1), (201, base, None, None, None), (202, " ".join(near), "en", "s2", 1), (203, base, "en", "s0", 1), (203, base, "en", "s0", 1), (204, None, "en", "s0", None), (205, "", "en", "s1", 0), (206, " \n ", "en", "s1", 3), (None, prose(70), "en", "s2", 1), (None, None, None, None, None),
        (207, prose(6000), "en", "s0", 9), (208, prose(30) + "\n" + base + "\n" + prose(30), "en", "s2", 1), (209, "é漢字🎉 " * 300, "zh", "s1", 1),
    ]
    return good, bad, odd


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    good, bad, odd = rows
    spark.createDataFrame([(r[0], int(r in bad)) for r in good + bad] + [(None, 1), (5, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    docs = spark.createDataFrame(good + bad + odd, SCHEMA).withColumns({"_row": F.lit("r"), "score": F.lit("x"), "size": F.lit(7), "ids": F.lit("i")})
    docs.write.parquet(f"{path}/documents.parquet")
    docs.limit(0).write.parquet(f"{path}/none.parquet")
    return path


def stage(name: str):
    return dict(corpus_pipeline.STAGES)[name]


def told(df) -> Counter:
    return Counter(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()))


def test_toxic_documents_go_and_all_others_stay(spark, rows, sf_dir):
    good, bad, odd = rows
    assert told(stage("toxicity")(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)) == Counter(good + odd)


def test_one_of_each_group_of_copies_stays(spark, rows, sf_dir):
    good, _, odd = rows
    docs = spark.createDataFrame(good + odd, SCHEMA)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (r[1] or "").split()) else frozenset() for r in good + odd]
    every = good + odd
    group = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a | b and len(a & b) >= 0.8 * len(a | b)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for g, r in zip(group, every):
        if g not in first or (r[0] is None, r[0] or 0) < (first[g][0] is None, first[g][0] or 0):
            first[g] = r
    assert told(stage("ngram_jaccard")(spark, docs, sf_dir)) == Counter(first.values())


def test_repeated_sentences_go(spark, rows, sf_dir):
    good, _, odd = rows
    every = [r for r in good + odd if r[0] is not None and r[0] != 203]
    got = {r["doc_id"]: r for r in stage("substring_dedup")(spark, spark.createDataFrame(every, SCHEMA), sf_dir).collect()}
    seen: dict[tuple, list] = {}
    cut = {r[0]: [tuple(r[1][a:b].split()) for a, b in spans.sentences(r[1])] if r[1] else [] for r in every}
    for k in sorted(cut):
        s = cut[k]
        for i in range(len(s)):
            n = 0
            for j in range(i, min(len(s), i + 40)):
                n += len(s[j])
                if (j - i >= 2 and n >= 15) or n >= 40:
                    seen.setdefault(tuple(s[i : j + 1]), []).append((k, i, j + 1))
    gone: dict[int, set] = {k: set() for k in cut}
    for places in seen.values():
        for k, i, j in places[1:]:
            gone[k] |= set(range(i, j))
    for r in every:
        if gone[r[0]] and len(gone[r[0]]) == len(cut[r[0]]):
            assert r[0] not in got
        else:
            left = [w for i, s in enumerate(cut[r[0]]) if i not in gone[r[0]] for w in s]
            assert (got[r[0]]["text"] or "").split() == left
            assert got[r[0]]["text"] == r[1] or gone[r[0]]
            assert got[r[0]]["n_chars"] == (len(got[r[0]]["text"]) if gone[r[0]] else r[4])


def test_mixing_repeats_whole_documents(spark, rows, sf_dir):
    good, _, odd = rows
    got = told(stage("mixing")(spark, spark.createDataFrame(good + odd, SCHEMA), sf_dir))
    have = Counter(good + odd)
    assert all(n <= 2 * have[r] for r, n in got.items()) and all(r in have for r in got)
    assert not any(r[1] is None or not r[1].split() for r in got)
    assert told(stage("mixing")(spark, spark.createDataFrame(good + odd, SCHEMA).repartition(5), sf_dir)) == got


def test_encoding_gives_every_text_back(spark, rows, sf_dir):
    good, _, odd = rows
    got = stage("sentencepiece")(spark, spark.createDataFrame(good + odd, SCHEMA), sf_dir).collect()
    assert len(got) == len(good + odd) and all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf_dir, name):
    assert stage(name)(spark, spark.read.parquet(f"{sf_dir}/none.parquet"), sf_dir).count() == 0

"""Every operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

from __future__ import annotations

import hashlib
import html
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditloom.llm import chat, components, jaccard, markup, media, mix, pieces, pivots, spans, suffixes, toxicity
from auditloom.llm.queries_chat import SCHEMAS
from auditloom.llm.queries_pieces import MODEL
from auditloom.llm.queries_suffixes import op3_suffix_dedup

random.seed(3)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    out, i = [], 0
    while i < n:
        k = min(n - i, random.randint(3, 9))
        out.append(" ".join(random.choice(WORDS) for _ in range(k)).capitalize() + ".")
        i += k
    return " ".join(out)


LONG = prose(9000)
BASE = prose(120)
#: Nulls in every column, empty and very long texts, repeated rows, ties, and columns that clash with what operators add or use inside.
ROWS = [
    (1, BASE, "en", "b", 1), (2, BASE, "en", "a", 2), (2, BASE, "en", "a", 2), (3, BASE.replace(WORDS[0], "zzz") + " tail.", None, None, None), (4, None, "en", "a", 0), (5, "", "de", "c", 0), (None, prose(80), "en", "a", 3),
    (None, None, None, None, None), (7, LONG, "en", "b", 4), (8, prose(10) + " " + LONG[3000:6000], "en", "b", 5), (9, "   \n\t ", "fr", "c", 0), (10, "a" * 3000, "fr", "c", 0), (11, "é漢字🎉 " * 200, "fr", "d", 0), (12, prose(3), "en", "d", 9),
]
EXTRA = "row long, key string, size string, bucket long, cls string, hits string, data string, _row string, ids string, score string, text2 string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"row": F.lit(1), "key": F.lit("k"), "size": F.lit("s"), "bucket": F.lit(2), "cls": F.lit("c"), "hits": F.lit("h"), "data": F.lit("d"), "_row": F.lit("r"), "_k": F.lit("k"), "ids": F.lit("i"), "score": F.lit("x"), "kept": F.lit("y")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary = pieces.load(MODEL)
    got = pieces.encode(docs, vocabulary).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert list(r["ids"]) == lib.encode(r["text"] or "")
        assert r["n_tokens"] == len(r["ids"]) and r["round_trip"]
    machine = pieces.Transducer(vocabulary)
    for t in [" ", "  ", " a", "a ", " " * 40 + "x", "<s></s><0x41>", "a▁b", "\x00\x7f", "aaaaaaab" * 9, *("".join(random.choice("ab  \nё中.,1'") for _ in range(30)) for _ in range(500))]:
        ids = machine.encode(t)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == lib.encode(t)
        assert machine.decode(ids) == t.replace("▁", " ")
    assert pieces.encode(empty, vocabulary).count() == 0


def water(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest, open_ = share * sum(sizes.values()) - sum(most * sizes[s] for s in full), sum(w[s] for s in sizes if s not in full)
        goal = {s: most * sizes[s] if s in full else rest * w[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in full and goal[s] > most * sizes[s] + 1e-9}
        if not over:
            return goal
        full |= over


def test_mix(spark, docs, empty):
    many = [(i, " ".join(["w"] * random.randint(0, 30)), random.choice(["hot", "hot", "x", "y", None])) for i in range(2500)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string")
    got = mix.mix(df).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    goal = water(sizes)
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, mix.mix(df.repartition(7)).collect()))
    odd = mix.mix(docs).collect()
    assert len(odd) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in odd)
    assert mix.mix(empty).count() == 0


def near(texts: list[str | None]) -> list[int]:
    sets = [frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for t in texts]
    out = []
    for i, a in enumerate(sets):
        out.append(sum(i != j and (a == b or (bool(a | b) and len(a & b) >= 0.8 * len(a | b))) for j, b in enumerate(sets)))
    return out


def test_jaccard(spark, docs, empty, monkeypatch):
    texts = [prose(60) for _ in range(40)]
    for i in range(120):  # groups of near copies, one of them large
        w = texts[0 if i % 2 else i % 9].split()
        w[random.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near(texts)
    for small, block in ((256, 512), (8, 16)):  # the second splits buckets, and the large group into blocks
        monkeypatch.setattr(jaccard, "SMALL", small)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = {r["doc_id"]: r for r in jaccard.join(df, recall=0.999999).collect()}
        assert [got[i]["n_links"] for i in range(len(texts))] == want
    monkeypatch.undo()
    odd = jaccard.join(docs).collect()
    assert len(odd) == len(ROWS)
    by = {r["doc_id"]: r for r in odd if r["doc_id"] is not None}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[1]["n_copies"] == 3
    assert by[4]["n_links"] == by[5]["n_links"] == 3  # texts without words are copies of each other
    assert jaccard.join(empty).count() == 0


def test_jaccard_recall(spark, monkeypatch):
    """At the shipped recall, near copies just above the bound are found, also where every bucket is split several times."""
    texts, pairs = [], 0
    for _ in range(700):
        w = prose(110).split()
        v = list(w)
        for at in (20, 80):
            v[at] = "edit"
        texts += [" ".join(w), " ".join(v)]
    common = prose(12)  # shared by all, so that first tokens meet in one bucket
    texts = [f"{common} {t}" for t in texts]
    for a, b in zip(texts[::2], texts[1::2]):
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a.split(), b.split()))
        similarity = len(x & y) / len(x | y)
        assert 0.8 <= similarity <= 0.87
        pairs += 1
    monkeypatch.setattr(jaccard, "SMALL", 4)
    got = {r["doc_id"]: r for r in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(got[2 * i]["class_id"] == got[2 * i + 1]["class_id"] for i in range(pairs))
    assert found >= 0.98 * pairs
    assert all(r["n_links"] <= 1 for r in got.values())


def test_components(spark):
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def bytes_left(texts: list[bytes], length: int) -> list[tuple]:
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [80, 400])
def test_suffixes(spark, docs, empty, length, monkeypatch):
    texts = [prose(150) for _ in range(30)] + ["ab" * 900, "xyz" + "ab" * 400, "q" * 1500]
    for _ in range(30):
        a, b = random.choice(texts), random.choice(texts)
        i, j = sorted(random.sample(range(len(a)), 2))
        texts.append(b[: random.randrange(len(b))] + a[i:j] + prose(8))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = bytes_left([t.encode() for t in texts], length)
    for group in (200, 2):  # the second splits groups down to single windows
        monkeypatch.setattr(suffixes, "GROUP", group)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(df, length).collect()}
        assert [got[i] for i in range(len(texts))] == want
    odd = suffixes.dedup(docs, length).collect()
    expected = bytes_left([(r[1] or "").encode() for r in ROWS], length)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in odd) == Counter((r[0], *e[:3]) for r, e in zip(ROWS, expected))
    assert all(r["kept_sha256"] == hashlib.sha256(bytes(r["kept"])).hexdigest() for r in odd)
    assert suffixes.dedup(empty, length).count() == 0


def test_query_of_suffixes_removes_planted_passages(spark, tmp_path):
    rng = random.Random(11)

    def said(n: int) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(n))

    long, short = said(110), said(51)  # the second is below 400 bytes, so it stays
    assert len(long) > 400 > len(short) + 2
    rows = [(i, said(rng.choice((20, 90, 400)))) for i in range(90)]  # of all sizes, so a text's size doesn't tell what repeats
    for i, passage in [(i, long) for i in range(0, 90, 6)] + [(i, short) for i in range(1, 90, 6)]:
        rows[i] = (i, f"{rows[i][1]} #{passage}# {said(rng.choice((5, 300)))}")
    spark.createDataFrame([*rows, (90, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op3_suffix_dedup(spark, str(tmp_path)).collect()}
    want = bytes_left([t.encode() for _, t in rows] + [b""], 400)
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(91)] == [(*w[:3], hashlib.sha256(w[3]).hexdigest()) for w in want]
    assert {i for i, r in got.items() if r["n_removed"]} == set(range(0, 90, 6)) and all(got[i]["n_removed"] >= len(long) for i in range(0, 90, 6))


def test_places_of_a_large_group_are_told_in_many_tasks(spark):
    places = spark.range(6000).select(F.col("id").alias("row"), F.lit(3).cast("long").alias("first"), F.when(F.col("id") < 5000, 7).otherwise(F.col("id") % 10 + 100).cast("long").alias("grp"))
    limits = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = suffixes.sized(places, 16).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert Counter((r["grp"], r["large"]) for r in got) == {(7, 1): 5000, **{(g, 0): 100 for g in range(100, 110)}}
    assert max(Counter(r["task"] for r in got).values()) < 2000


def test_loser_tree():
    keys = sorted(bytes(random.choice(b"ab") for _ in range(suffixes.KEY)) if i % 3 else b"a" * 40 + bytes(random.choice(b"abc") for _ in range(8)) for i in range(3000))
    runs = [[] for _ in range(7)]
    for k in keys:
        random.choice(runs).append(k)
    fact = (1, 2, 5, 3, b"d" * 16)
    found = list(suffixes.merged([suffixes.unpacked(suffixes.packed(r, [fact] * len(r))) for r in runs if r]))
    assert [k for _, k, _ in found] == keys and all(f == fact for *_, f in found)
    for (_, a, _), (c, b, _) in zip(found, found[1:]):
        assert c == next((i for i in range(suffixes.KEY) if a[i] != b[i]), suffixes.KEY)


def sentences_left(rows: list[tuple], several=3, words=15, long=40) -> list[int]:
    """Removed sentences of each row, straight from the definition."""
    cut = [[r[1][a:b].split() for a, b in spans.sentences(r[1])] if r[1] else [] for r in rows]
    seen: dict[tuple, list] = defaultdict(list)
    for d, s in enumerate(cut):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                n = sum(map(len, s[i:j]))
                if (j - i >= several and n >= words) or n >= long:
                    seen[tuple(map(tuple, s[i:j]))].append((rows[d][0] is None, rows[d][0] or 0, d, i, j))
                    break
    gone = [set() for _ in rows]
    for places in seen.values():
        first = min(places)
        for p in places:
            # rows equal in key and text are one document
            if p != first and not (rows[p[2]][:2] == rows[first[2]][:2] and p[3] == first[3]):
                gone[p[2]] |= set(range(p[3], p[4]))
    return list(map(len, gone))


def test_spans(spark, docs, empty):
    rows = [(i, prose(70)) for i in range(40)]
    for i in range(40, 70):
        a, b = random.choice(rows)[1].split(". "), prose(40)
        k = random.randrange(len(a))
        rows.append((i, b + "\n" + ". ".join(a[k : k + random.randint(1, 8)]) + ".\n" + prose(20)))
    got = {r["doc_id"]: r["n_removed"] for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == sentences_left(rows)
    odd = spans.dedup(docs).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in odd) == Counter(zip([r[0] for r in ROWS], sentences_left([r[:2] for r in ROWS])))
    assert all(r["text"] is None for r in odd if r["doc_id"] == 4)
    assert spans.dedup(empty).count() == 0


PAGES = {
    "<html><body><nav><a href=1>Menu</a></nav><header>Site</header><div id=content><h1>Title</h1><p>One, two &amp; three.</p><p>Four<br>five <b>six</b></p></div><div class='sidebar'>More</div><div class=comments><p>Nice, nice, nice!</p></div><footer>&copy;</footer></body></html>": "Title One, two & three. Four five six",
    "<article><p>Body text here, long enough.<aside>Ad</aside><ul><li>a<li>b</ul><form>Search</form></article><p>Cookie": "Body text here, long enough. a b",
    "": "", "no markup at all": "no markup at all", "<script>x<y</script><style>p{}</style>": "", "<p>a&nbsp;b\n c": "a b c",
}


def test_markup(spark, docs):
    for page, text in PAGES.items():
        assert markup.main_text(page) == text, page
    assert markup.main_text(None) == ""
    deep = "<div>" * 3000 + "<p>" + LONG + "</p>"
    assert markup.main_text(deep) == " ".join(LONG.split())
    pages = spark.createDataFrame([(1, "u", "<p>Hi, you.</p>"), (1, "u", "<p>Hi, you.</p>"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = markup.extract(pages).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("Hi, you.", 8)] * 2 + [("", 0)]
    assert markup.extract(pages.limit(0)).count() == 0


def test_media(spark, docs, empty):
    for data in (b"", b"x", bytes(range(256)) * 9, b"\xff" * 576):
        samples = media.padded(data)
        assert len(samples) % 576 == 0 and samples and media.from_png(media.to_png(samples)) == samples
    items = media.sequence('<p>a <img src="sha256:d1" alt="x"> b</p><figure><img src="d2"><figcaption>cap &lt;</figcaption></figure><p>c')
    assert [(x["position"], x["kind"], x["text"], x["ref"]) for x in items] == [(0, "text", "a", None), (1, "media", "x", "d1"), (2, "text", "b", None), (3, "media", "cap <", "d2"), (4, "text", "c", None)]
    known = media.read_back(media.store(docs, "text"))
    assert known.count() == len({r[1] or "" for r in ROWS})
    got = media.resolve(media.interleave(media.documents_as_pages(docs, "doc_id", "text")), known).collect()
    assert len(got) == len(ROWS)
    texts = Counter((r[0], len((r[1] or "").encode()), hashlib.sha256(media.padded((r[1] or "").encode())).hexdigest(), zlib.crc32(media.padded((r[1] or "").encode())[-32:])) for r in ROWS)
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == texts
    assert all(r["caption"] == html.escape(str(r["doc_id"])) for r in got)
    assert media.store(empty, "text").count() == 0


def test_pivots(spark):
    rows = [(i % 230, [random.gauss(0, 0.2) for _ in range(8)] if i % 7 else [0.5] * 8) for i in range(300)]
    rows += [(50, None), (100, [1.0, None] + [0.0] * 6), (150, [float("nan")] * 8), (200, [float("inf")] * 8), (None, [0.1] * 8), (400, []), (450, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivots.top_k(df).collect())
    import numpy as np

    cells = [(k, np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int)) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all()]
    want = Counter()
    for k in {k for k, _ in cells if k % 50 == 0}:
        found = sorted((-int(v @ w), c) for i, (q, v) in enumerate(cells) if q == k for j, (c, w) in enumerate(cells) if i != j and len(v) == len(w))
        want.update((k, n + 1, c, -s) for n, (s, c) in enumerate(found[:5]))
    assert got == want
    assert pivots.top_k(df.limit(0)).count() == 0


def test_toxicity(spark, docs, empty):
    bad = ["wickedo", "zumblek", "grobnit"]
    rows, labels = [], []
    for i in range(1200):
        w = prose(40).split()
        y = i % 6 == 0
        for _ in range(3 * y):
            w.insert(random.randrange(len(w)), random.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, known.filter("doc_id % 5 <> 0"))
    held = toxicity.score(df.filter("doc_id % 5 = 0"), model).join(known, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held if r["toxic"] is not None) >= 0.97 * len(held) - 1
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    none = toxicity.fit(empty, known.limit(0))
    assert toxicity.score(docs, none).filter("predicted = 1").count() == 0
    assert toxicity.score(empty, model).count() == 0


def test_chat(spark):
    rows = [
        ("c", 1, "user", None, "a", "reply", '{"turn": 2, "text": "long enough to be fine"}', None), ("c", 2, "assistant", "ok", "a", None, None, None), ("c", 3, "user", None, "b", "reply", '{"text": "short", "more": 1}', "a"),
        ("c", 3, "user", None, "b", "reply", '{"text": "short", "more": 1}', "a"), ("c", 4, "user", None, "d", "other", "[1]", "b"), ("c", 5, "assistant", "x", "gone", None, None, None), ("c", 6, "user", None, "e", "reply", "not json", "f"),
        ("c", 7, "user", None, "f", "reply", None, "e"), ("c", 0, "system", "say \"hi\"\n", None, None, None, None), (None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv string, seq long, role string, content string, call_id string, name string, arguments string, after string").withColumns({"n": F.lit(1), "kind": F.lit("k")})
    got = {r["call_id"] or r["seq"]: r for r in chat.link(df, SCHEMAS).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"a": "linked", "b": "no_result", "d": "no_result", "gone": "orphan_result", "e": "no_result", "f": "no_result", 0: "message", None: "message"}
    assert [got[k]["position"] for k in "abdef"] == [0, 1, 2, None, None]
    assert got["a"]["issues"] == [] and got["b"]["issues"] == ["additional", "missing:turn", "short:text"] and got["b"]["n_repeats"] == 2
    assert got["d"]["issues"] == ["arguments_not_object", "unknown_tool"] and got["e"]["issues"] == ["arguments_not_object", "cycle"]
    assert got["a"]["canonical"] == '{"after":[],"arguments":{"text":"long enough to be fine","turn":2},"content":null,"id":"a","issues":[],"name":"reply","position":0,"result":{"after":[],"arguments":null,"content":"ok","role":"assistant"},"role":"user"}'
    assert got[0]["canonical"] == '{"after":[],"arguments":null,"content":"say \\"hi\\"\\n","id":null,"name":null,"role":"system"}'
    assert chat.link(df.limit(0), SCHEMAS).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no tables here")
    out, rows = None, spark.read.parquet(f"{sf}/documents.parquet")
    counts = [rows.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf)
        if name != "sentencepiece":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        counts.append(rows.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5] > 0
    assert rows.filter("NOT round_trip").count() == 0

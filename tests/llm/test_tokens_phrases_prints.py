"""Alignment, phrases and fingerprints against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import align, fingerprints, phrases
from auditloom.llm.queries_align import FIRST, SECOND

HARD = ["the", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", " ", "　", "é", "中文", "😀", "<|endoftext|>", "<s>", "<0x41>", "▁", "123", "!!", "\r\n", "\x00", "x" * 30, "Straße", "́", "a"]


@pytest.fixture(scope="module")
def pair():
    return align.load(FIRST, SECOND)


@pytest.fixture(scope="module")
def slow():
    """Both encoders of the public libraries, by whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=SECOND)
    letter = align.byte_letters()

    def encode(text: str):
        one = a.encode(" " + text, add_special_tokens=False).ids
        two = b.encode(text)
        one = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in one]
        two = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in two]
        return one, two

    return encode


def slowly_aligned(texts, encode):
    """n_a, n_b, n_groups, n_links, groups_sha256, n_shared, and the links of each text."""
    out = []
    for t in texts:
        one, two = encode(t) if t else ([], [])
        want = (" " + (t or "")).encode()
        if not t or any(b"".join(x for _, x in side) != want for side in (one, two)):
            out.append(((0, 0, 0, 0, "", 0), Counter()))
            continue
        ranges = []
        for side in (one, two):
            at, places = 0, []
            for i, x in side:
                places.append((i, at, at + len(x)))
                at += len(x)
            ranges.append(places)
        cuts = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        groups = [[[i for i, s, _ in side if lo <= s < hi] for side in ranges] for lo, hi in zip([0, *cuts], cuts)]
        links = Counter((i, j) for i, s, e in ranges[0] for j, u, v in ranges[1] if s < v and u < e)
        written = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        out.append(((len(one), len(two), len(cuts), sum(links.values()), hashlib.sha256(written.encode()).hexdigest(), sum(len(x) * len(y) for x, y in groups)), links))
    return out


@pytest.mark.parametrize("pairs", [2_000_000, 40, 0])
def test_alignment_equals_brute_force(spark, pair, slow, pairs):
    rng = random.Random(3)
    texts = ["".join(rng.choice(HARD) for _ in range(rng.randint(0, 10))) for _ in range(120)] + [None, "", "same text", "same text", "same text"]
    docs = spark.createDataFrame([(i % 100, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, N_A string").repartition(5)
    got = align.align(docs, pair, pairs=pairs)
    assert [c for c in got.columns if c.lower() == "n_a"] == ["n_a"]
    found = slowly_aligned(texts, slow)
    count = Counter(k for _, links in found for k in links)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    want = Counter()
    for i, (facts, links) in enumerate(found):
        want[i % 100, *facts, sum(n for k, n in links.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in links.items())] += 1
    have = Counter(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_shared", "n_best", "count_sum").collect())
    assert have == want


def test_links_row_by_row(spark, pair, slow):
    texts = ["hello wörld", "", None, "a 中文 b\n\nc", "▁"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shared in (False, True):
        rows = align.links(docs, pair, shared_groups=shared).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).collect()
        found = {i: f for i, (f, _) in enumerate(slowly_aligned(texts, slow))}
        assert {r["doc_id"]: r["n"] for r in rows} == {i: f[5 if shared else 3] for i, f in found.items() if f[3]}
        assert {r["doc_id"]: r["b"] for r in rows} == {i: len((" " + texts[i]).encode()) for i, f in found.items() if f[3]}


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m, k = rng.integers(1, 9, 3)
        x, y = (rng.random((n, m)) < 0.4).astype(int), (rng.random((m, k)) < 0.4).astype(int)
        csr = lambda d: align.Csr(np.concatenate([[0], np.cumsum((d != 0).sum(1))]), np.nonzero(d)[1], d.shape[1])
        out = np.zeros((n, k), int)
        for i, j, v in align.product(csr(x), csr(y), block=3):
            out[i, j] += v
        assert (out == x @ y).all()
        back = align.transposed(csr(x))
        assert [sorted(back.columns[s:e]) for s, e in zip(back.starts, back.starts[1:])] == [list(np.nonzero(c)[0]) for c in x.T]


def test_long_units_and_empty_tables(spark, pair):
    text = "x" * 200_000 + " " + "中" * 30_000
    machine = align.Aligner(pair)
    got = machine.batch([text, "b", text])
    assert got["n_links"][0] == got["n_links"][2] > 0 and machine.known.keys() == {" b"}
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), pair).collect() == []


# phrases


def slowly_collocated(rows, least, depth, share, top):
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    out = {}
    frequent = {k: a for k, a in count.items() if a >= least}
    for (lang, w), a in frequent.items():
        if len(w) < 2 or any(la == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (la, v), b in frequent.items()):
            continue
        cuts = [(1000 * a * n[lang] // (count[lang, w[:c]] * count[lang, w[c:]]), c) for c in range(1, len(w))]
        score, c = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:c]], count[lang, w[c:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("size", [64, phrases.SYMBOLS])
@pytest.mark.parametrize("share", [100, 60])
def test_phrases_equal_brute_force(spark, size, share):
    rng = random.Random(5)
    words = ["a", "B", "the", "of", "Éa", "中", "x\x00y", " "]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["w1 w2 w3 w4 w5 w6 w7 " * 40, " " * 300 + "of the", "", None] + ["same words in a row"] * 30
    rows = [(t, rng.choice(["en", "en", "de", None, "und"])) for t in texts]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n int").repartition(3)
    for least, top in ((8, 2000), (3, 5)):
        got = phrases.collocations(docs, least=least, share=share, top=top, size=size)
        assert sorted(tuple(r) for r in got.collect()) == slowly_collocated(rows, least, 5, share, top)


def test_steps_find_all_phrases():
    rng = np.random.default_rng(2)
    s = np.concatenate([[0], rng.integers(2, 6, 300), [0], rng.integers(2, 6, 200), [0]]).astype(np.int32)
    fm = phrases.Fm(*phrases.index(s, 5))
    found = fm.single()
    for k, to_left in enumerate((True, False, True, False), start=2):
        found = fm.step(found, to_left)
        grams = Counter(tuple(s[i : i + k].tolist()) for i in range(len(s) - k + 1) if (s[i : i + k] != 0).all())
        assert dict(zip(map(tuple, found.words.tolist()), found.size.tolist())) == grams


def test_phrases_of_empty_tables_and_scores_beyond_64_bits(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    big = 10**13
    table = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7)], "lang string, k int, phrase string, f long")
    row = phrases.scored(table, spark.createDataFrame([("en", 9 * big)], "lang string, n long")).first()
    assert row["score"] == 1000 * (big - 7) * 9 * big // (big * (big + 1))


# fingerprints


def slow_print(text: str) -> list:
    """The selected runs of every entry, by plain Python."""
    data = text.encode()
    hashes = fingerprints.runs(data)
    n = len(hashes)
    low = max(1, (n - 1).bit_length())
    seen, ring = Counter(), []
    for i, h in enumerate(hashes.tolist()):
        number = seen[h >> low]
        seen[h >> low] += 1
        at = int(fingerprints.mixed(np.array([(h + number * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
        ring.append((at >> low, i))
    ring.sort()
    out = []
    for j in range(fingerprints.SIZE):
        point = j << 57
        first = next((x for x, (at, i) in enumerate(ring) if (at << low) | i >= point), n)
        places = sorted(ring[(first + d) % n][1] for d in range(fingerprints.TAKEN))
        entry = np.zeros(1, np.uint64)
        for p in places:
            entry = fingerprints.mixed(entry * np.uint64(31) + hashes[p])
        out.append(int(entry[0] >> np.uint64(48)))
    return out


def test_fingerprints_equal_brute_force():
    rng = random.Random(4)
    for n in (0, 1, 7, 8, 9, 50, 700):
        text = "".join(rng.choice("abé ") for _ in range(n))
        assert fingerprints.fingerprint(text).tolist() == slow_print(text)


def test_fingerprints_follow_order_and_edits():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    mark = fingerprints.fingerprint(text)
    near = lambda t: fingerprints.likeness(mark, fingerprints.fingerprint(t))
    moved = words[:]
    rng.shuffle(moved)
    one = words[:]
    one[100] = "other"
    other = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400))
    assert near(text) == 1.0 and near(" ".join(one)) > 0.9 and near(other) < 0.1
    # halves swapped: all runs but a few are the same, half of the pairs stand the other way round
    assert near(" ".join(words[200:] + words[:200])) < near(" ".join(one))
    assert 0.3 < near(fingerprints.edited(text, other)) < 0.7


def test_compared_rows(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc dé") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    ids = rng.sample(range(-500, 500), len(texts))
    docs = spark.createDataFrame([(i, t, "k", 0.5) for i, t in zip(ids, texts)], "doc_id long, text string, tag string, near_next double").repartition(6)
    got = {r["doc_id"]: r for r in fingerprints.compared(docs).collect()}
    assert len(got) == len(ids)
    order = sorted(zip(ids, texts), reverse=True)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = map(fingerprints.fingerprint, (t, changed, following))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["tag"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), "k")
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.written(a), fingerprints.written(b))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))


def test_compared_repeats_nulls_and_empty(spark):
    assert fingerprints.compared(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = fingerprints.compared(spark.createDataFrame([(None, "alone")], "doc_id long, text string")).collect()
    assert [(r["n_chars"], r["near_next"]) for r in one] == [(5, 1.0)]
    # a third of all rows alike, another third of one key
    rows = [(7, "the same text")] * 100 + [(9, f"text {i}") for i in range(100)] + [(None, f"other {i}") for i in range(50)] + [(i, "x") for i in range(100, 150)]
    got = fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 7) >= 99
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 7}) == 1

"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens until buckets are small."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, dealt, partitions
from auditloom.llm.components import components

#: Buckets above this size are split further.
SMALL = 256
#: Classes of a dense bucket that one task holds of each of two blocks.
BLOCK = 512
#: A bucket with more than this share of the bucket before it is dense: its sets are nearly as alike as links are, so that comparing them all is the work that is asked for.
DENSE = 0.6
#: Sampled tokens of a set; no path uses one twice.
TOKENS = 24
_ODD = [(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD1B54A32D192ED03 * (i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(1, 200)]
_XOR, _MUL = (np.array(x, np.uint64)[:, None] for x in (_ODD[100 : 100 + TOKENS], _ODD[:TOKENS]))
_WORDS: dict[str, int] = {}


def runs_for(similarity: float, recall: float, depth: int) -> int:
    """Runs after which a pair of the given similarity has met in some bucket with at least the given probability, if every bucket is split `depth` times.

    A bucket has 1 / similarity children for each set on average, and a child keeps the pair with the similarity's probability.
    """
    least, more = divmod(1 / similarity, 1)
    meets = 1.0
    for _ in range(max(1, depth)):
        lost = 1 - similarity * meets
        meets = 1 - lost**least * (1 - more + more * lost)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(meets, 1 - 1e-9))))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Hashes of the different runs of `size` words, sorted; of all words where there are fewer. Words are what stands between white space, as written."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    try:
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_WORDS) > 300_000:
            _WORDS.clear()
        for w in set(words).difference(_WORDS):
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[i : len(h) - size + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out += np.uint64(size)
    return np.unique(out)


def tokens(shingled: np.ndarray, n: int = TOKENS) -> bytes:
    """The set in n sampled tokens: its least shingle under each of n orders, as 4 bytes. Two sets share a token with the probability of their similarity."""
    if not len(shingled):
        return bytes(4 * n)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingled), 4096):
        x = (shingled[None, start : start + 4096] ^ _XOR[:n]) * _MUL[:n]
        out = np.minimum(out, (x ^ (x >> np.uint64(31))).min(1))
    return (out >> np.uint64(32)).astype("<u4").tobytes()


def described(docs: DataFrame, text: str, size: int) -> DataFrame:
    """row, key of docs and for each text cls (a digest of its set: equal sets are one class), size and sampled tokens."""
    names = ["row", "key", "cls", "size", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                cls, sizes, rows = [], [], []
                for t in batch.column(2).to_pylist():
                    s = shingles(t, size)
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    rows.append(tokens(s))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=names)

    schema = docs.select("row", "key").schema.add("cls", "binary").add("size", "long").add("tokens", "binary")
    return docs.select("row", "key", F.col(text).alias("text")).mapInArrow(run, schema)


def leaves(classes: DataFrame, runs: range, similarity: float, small: int | None = None) -> tuple[DataFrame, int]:
    """(cls, run, leaf, members) for each class, run and leaf bucket that it shares with another; and how often a bucket was split.

    Every run starts with all classes in one bucket. A bucket with more than `small` classes is split: by its path it chooses
    1 / similarity of the sampled tokens on average, none that the path has used, and for each of them every class goes to the
    child of its own token. Children of one class are dropped. A bucket is a leaf when it is small, when it is dense, or
    when its path has used all tokens.
    """
    small = SMALL if small is None else small
    least, more = divmod(1 / similarity, 1)
    branches = [F.struct(F.lit(b).alias("b"), F.pmod(F.xxhash64("path", F.lit(b)), F.lit(1 << 20)).alias("at")) for b in range(int(least) + (more > 0))]

    def split(at: DataFrame) -> DataFrame:
        """at: cls, run, path, used, before, tokens."""
        wanted = F.filter(F.array(*branches), lambda x: (x["b"] < int(least)) | (F.pmod(F.xxhash64("path", F.lit("more")), F.lit(1 << 20)) < F.lit(int(more * (1 << 20)))))
        free = at.withColumn("free", F.array_except(F.sequence(F.lit(0), F.lit(TOKENS - 1)), "used")).withColumn("x", F.explode(wanted))
        # different branches of a bucket choose different tokens
        first = F.pmod(F.col("run") + F.col("x.b") * (TOKENS // 2), F.lit(TOKENS))  # runs begin with tokens of their own
        pick = F.element_at("free", (F.pmod(F.pmod(F.xxhash64("path"), F.lit(1 << 20)) + F.col("x.b") * 7, F.size("free")) + 1).cast("int"))
        pick = F.when(F.size("used") == 0, first).otherwise(pick).cast("int")
        token = free.withColumn("pick", pick)
        return token.select("cls", "run", F.xxhash64("path", "pick", F.expr("substring(tokens, 4 * pick + 1, 4)")).alias("path"), F.array_append("used", F.col("pick")).alias("used"), "before")

    roots = F.explode(F.array(*[F.lit(r) for r in runs]))
    of = classes.filter("size > 0").select("cls", "tokens")
    at = of.withColumn("run", roots).select("cls", "tokens", "run", F.xxhash64("run").alias("path"), F.array().cast("array<int>").alias("used"), F.lit(1 << 62).cast("long").alias("before"))
    found, depth = None, 0
    while True:
        depth += 1
        now = split(at)
        # cut, so that a bucket with very many classes can be split over tasks by the join
        sizes = cut(now.groupBy(F.col("path").alias("_path")).count().filter("count > 1").withColumnRenamed("count", "members"))
        shared = cut(now.join(sizes, F.col("path") == F.col("_path")).drop("_path"))
        whole = (F.col("members") <= small) | (F.col("members") > DENSE * F.col("before")) | (F.size("used") >= TOKENS)
        done = shared.filter(whole).select("cls", "run", F.col("path").alias("leaf"), "members")
        found = done if found is None else found.unionByName(done)
        large = shared.filter(~whole)
        if large.isEmpty():
            return found, depth
        at = large.drop("before").withColumnRenamed("members", "before").join(of, "cls")


def counted(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have the similarity, as a symmetric matrix without its diagonal."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    out = np.zeros((n, n), bool)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                low, high = sorted((sizes[i], sizes[j]))
                if low >= similarity * high - 1e-9:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    out[i, j] = out[j, i] = both >= similarity * (low + high - both) - 1e-9
        return out
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), np.float32)
    width = 2048
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        both += part @ part.T
    out = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-4
    np.fill_diagonal(out, False)
    return out


def shared_least(similarity: float, missed: float = 0.001) -> int:
    """Sampled tokens that a pair of the similarity shares at least, but for a probability of `missed`."""
    left, least = 0.0, 0
    while (left := left + math.comb(TOKENS, least) * similarity**least * (1 - similarity) ** (TOKENS - least)) <= missed:
        least += 1
    return least


def candidates(found: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(cls, row, copies, own, at): the leaves of each class by run, and in which of them and in which part it has a candidate to be compared with.

    Candidates share enough sampled tokens, and the leaf is the first, by run and leaf, that they share. So only tokens are
    sent to every leaf, and whole sets only where they are needed. Leaves above BLOCK classes, which are dense, become
    blocks of classes, and a part for each two blocks; what a task holds is bounded by that.
    """
    least = shared_least(similarity)
    own = found.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("run", "leaf", "members"))).alias("own"))  # a few leaves a run
    known = cut(own.join(classes.select("cls", "row", "copies", "tokens"), "cls"))
    spread = known.select("cls", "tokens", F.transform("own", lambda x: x["leaf"]).alias("leaves"), F.explode("own").alias("x"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("x.members") / F.lit(BLOCK))).cast("long")
    block = spread.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    # block 0 holds its own pairs too, so a single block is one part
    parts = block.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("part", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    met = dealt(parts.select("cls", "tokens", "leaves", F.col("x.leaf").alias("leaf"), "part", "block"), partitions(found.sparkSession), "leaf", "part").sortWithinPartitions("leaf", "part", "cls")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def solve() -> None:
            n = len(held)
            if n < 2:
                return
            leaf = held[0][3]
            sketches = np.frombuffer(b"".join(x[1] for x in held), "<u4").reshape(n, TOKENS)
            shared = np.zeros((n, n), np.uint8)
            for c in sketches.T:
                shared += c[:, None] == c[None, :]
            near = shared >= least
            np.fill_diagonal(near, False)
            block = np.array([x[5] for x in held])
            if block.min() != block.max():
                near &= block[:, None] != block[None, :]
            if near.any():
                first_met(near, leaf, [x[2] for x in held])
                out.extend((held[i][0], leaf, held[i][4], held[i][5]) for i in np.flatnonzero(near.any(1)).tolist())

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][3:5] != x[3:5]:
                    solve()
                    held.clear()
                held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["cls", "leaf", "part", "block"])
            out.clear()
        solve()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["cls", "leaf", "part", "block"])

    where = met.mapInArrow(check, "cls binary, leaf long, part long, block long").groupBy("cls").agg(F.collect_list(F.struct("leaf", "part", "block")).alias("at"))
    return cut(known.select("cls", "row", "copies", F.transform("own", lambda x: x["leaf"]).alias("leaves")).join(where, "cls"))


def first_met(near: np.ndarray, leaf: int, leaves_of: list[list[int]]) -> None:
    """Takes from a matrix of pairs in a leaf those that share a leaf before it. leaves_of: the leaves of each row, in order."""
    earlier: dict[int, list[int]] = {}
    for i in np.flatnonzero(near.any(1)).tolist():
        for x in leaves_of[i]:
            if x == leaf:
                break
            earlier.setdefault(x, []).append(i)
    for rows in earlier.values():
        if len(rows) > 1:
            near[np.ix_(rows, rows)] = False


def links(docs: DataFrame, wanted: DataFrame, size: int, similarity: float) -> DataFrame:
    """(cls, n, weight, root): for each part of a leaf and class in it the number and copies of classes linked to it there, and the least class it hangs together with there.

    A pair counts in the first leaf that it shares alone, so sums over leaves count every pair once.
    """
    texts = docs.select("row", F.col("text").alias("_text")).join(wanted.hint("merge"), "row").select("_text", "cls", "copies", "leaves", "at")
    names = ["leaf", "part", "block", "cls", "copies", "leaves", "set"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                rows: list[tuple] = []
                for t, cls, copies, own, at in zip(*(whole.slice(start, 200).column(i).to_pylist() for i in range(5))):
                    s = shingles(t, size).tobytes()
                    if xxhash.xxh3_128_digest(s) != cls:
                        continue  # another text with the same row hash
                    own = np.array(own, "<i8").tobytes()  # in order of run and leaf
                    rows += [(x["leaf"], x["part"], x["block"], cls, copies, own, s) for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    schema = "leaf long, part long, block long, cls binary, copies long, leaves binary, set binary"
    met = dealt(texts.mapInArrow(deal, schema), partitions(docs.sparkSession), "leaf", "part").sortWithinPartitions("leaf", "part", "cls")

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def solve() -> list[tuple]:
            rows = [x for i, x in enumerate(held) if not i or x["cls"] != held[i - 1]["cls"]]
            if len(rows) < 2:
                return []
            near = counted([np.frombuffer(x["set"], np.uint64) for x in rows], similarity)
            block = np.array([x["block"] for x in rows])
            if block.min() != block.max():
                near &= block[:, None] != block[None, :]
            first_met(near, rows[0]["leaf"], [np.frombuffer(x["leaves"], "<i8").tolist() for x in rows])
            copies, root = np.array([x["copies"] for x in rows]), np.arange(len(rows))
            if not near.any():
                return []
            while True:
                least = np.minimum(root, np.where(near, root[None, :], len(rows)).min(1))
                if (least == root).all():
                    break
                root = least
            return [(x["cls"], int(near[i].sum()), int(copies[near[i]].sum()), rows[root[i]]["cls"]) for i, x in enumerate(rows) if near[i].any()]

        out: list[tuple] = []
        for batch in batches:
            for x in batch.to_pylist():
                if held and (held[0]["leaf"], held[0]["part"]) != (x["leaf"], x["part"]):
                    out += solve()
                    held.clear()
                held.append(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["cls", "n", "weight", "root"])
                out = []
        out = solve() if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["cls", "n", "weight", "root"])

    return met.mapInArrow(brute, "cls binary, n long, weight long, root binary")


def join(docs: DataFrame, size: int = 5, similarity: float = 0.8, recall: float = 0.995, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its key, class_id (the least key of its group), copy_id (the least key with an equal set), n_copies (rows with an equal set, this one included), n_links (other rows whose set is at least as similar as `similarity`), is_first (true for one row a group, and for rows that repeat it in key and text), and row, a hash of key and text.

    Sets are those of the runs of `size` words. Rows whose sets are equal are one class, compared once and never paired
    with each other; a group is a connected component of links. Links are found with probability `recall` (and 0.999 for the check of sampled tokens) at least if
    their similarity is just the bound, nearly always if it is higher; no pair below the bound is a link. Null and empty
    texts and texts without words have the empty set: they are copies of each other and link to nothing else. Repeated
    rows count as copies. Null keys come last in choosing a least key.
    """
    base = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    known = cut(described(base, "text", size))
    classes = cut(known.groupBy("cls", "size").agg(F.any_value("tokens").alias("tokens"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("least"), F.count("*").alias("copies")).withColumn("row", F.col("least.row")))
    runs, depth, found = 0, 1, None
    while runs < (needed := runs_for(similarity, recall, depth)):
        more, deep = leaves(classes, range(runs, needed), similarity)
        found, runs, depth = more if found is None else found.unionByName(more), needed, max(depth, deep)
    near = cut(links(base, candidates(cut(found), classes, similarity), size, similarity))
    roots = components(near.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    sums = near.groupBy("cls").agg(F.sum("weight").alias("weight"))
    per = classes.select("cls", "least", "copies").join(sums, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    per = cut(per.select("cls", "least", "copies", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("root", "cls").alias("root")))
    groups = cut(per.groupBy("root").agg(F.min("least").alias("first")))
    # cut, so that a class with very many copies can be split over tasks by the join
    answer = cut(per.join(groups, "root").select(F.col("cls").alias("_cls"), F.col("first.key").alias("class_id"), F.col("first.row").alias("first_row"), F.col("least.key").alias("copy_id"), F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.col("weight")).alias("n_links")))
    return known.select("row", "key", "cls").join(answer, F.col("cls") == F.col("_cls")).select("row", F.col("key").alias(key), "class_id", "copy_id", "n_copies", "n_links", ((F.col("row") == F.col("first_row")) & F.col("key").eqNullSafe(F.col("class_id"))).alias("is_first"))

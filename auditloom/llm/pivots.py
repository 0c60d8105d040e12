"""Exact top-k search by pivot-table elimination."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import cut, partitions

#: Vectors of a candidate block and of a query block.
BLOCK, QUERIES = 2048, 512
#: Pivots of a dimension, at most.
PIVOTS = 32
#: Pivots of all dimensions are sent to every task up to this size; beyond it they are joined by exchanges.
SENT_BYTES = 32 << 20
#: Meetings of a candidate block and a query block in one cell of the grid.
MEETINGS = 512
#: Query groups whose thresholds a task keeps from block to block.
KEPT = 2000
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def coded(rows: list[list[float]]) -> bytes:
    """Vectors of one dimension as bytes: 32-bit numbers where those hold them exactly, else 64-bit ones."""
    wide = np.array(rows, "<f8").reshape(len(rows), -1)
    with np.errstate(over="ignore"):
        small = wide.astype("<f4")
    return small.tobytes() if (small.astype("<f8") == wide).all() else wide.tobytes()


def decoded(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def blocks(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Packs vectors in blocks of one dimension: (block, dim, n, ids, data).

    Vectors that are null or hold a null or a component that isn't finite take no part, nor do rows without a key. A
    block's number is made of the task's and its own, so it holds for one materialised table.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vector).isNotNull() & finite & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("x"), F.spark_partition_id().cast("long").alias("task"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made, task = 0, 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            part, held[dim] = held[dim][:BLOCK], held[dim][BLOCK:]
            made += 1
            ids = np.array([p[0] for p in part], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([task * 1_000_000_000 + made], pa.int64()), pa.array([dim], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([ids], pa.binary()), pa.array([coded([p[1] for p in part])], pa.binary())], names=["block", "dim", "n", "ids", "data"])

        for batch in batches:
            for k, v, task in zip(*(batch.column(i).to_pylist() for i in range(3))):  # noqa: B007
                held.setdefault(len(v), []).append((k, v))
                if len(held[len(v)]) >= BLOCK:
                    yield out(len(v))
        for dim in list(held):
            if held[dim]:
                yield out(dim)

    return rows.mapInArrow(pack, "block long, dim long, n long, ids binary, data binary")


def pivots_of(packed: DataFrame) -> DataFrame:
    """(dim, pivots) for each dimension: vectors of the least hashes, PIVOTS at most."""
    sizes = packed.groupBy("dim").agg(F.sum("n").alias("_size")).withColumnRenamed("dim", "_dim")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, n, ids, data, size in zip(*(batch.column(i).to_pylist() for i in range(5))):
                h = (np.frombuffer(ids, "<u8") * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xA0761D6478BD642F)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)
                pick = np.flatnonzero(h < (1 << 63) * min(1.0, 4 * PIVOTS / size))
                pick = pick[np.argsort(h[pick], kind="stable")][: 4 * PIVOTS]
                rows = decoded(data, n, dim)[pick]
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(pick), pa.int64()), pa.array(h[pick].astype(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["dim", "h", "row"])

    drawn = packed.join(sizes.hint("merge"), F.col("dim") == F.col("_dim")).select("dim", "n", "ids", "data", "_size").mapInArrow(draw, "dim long, h long, row binary")
    once = drawn.groupBy("dim", "h").agg(F.min("row").alias("row"))
    ranked = once.withColumn("_k", F.row_number().over(Window.partitionBy("dim").orderBy("h", "row"))).filter(F.col("_k") <= PIVOTS)
    return ranked.groupBy(F.col("dim").alias("_dim")).agg(F.array_sort(F.collect_list("row")).alias("pivots"))


def cells(x: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
    """floor(scale * x) and the greatest of their absolute values; infinite where that is beyond a double."""
    with np.errstate(over="ignore"):
        c = np.floor(scale * x)
    return c, float(np.abs(c).max(initial=0.0))


def within(bits: int, dim: int, a: float, b: float) -> bool:
    """Whether a sum of `dim` products of numbers up to a and b stays below two to the power of bits."""
    return a == 0 or b == 0 or (math.isfinite(a) and math.isfinite(b) and math.log2(a) + math.log2(b) + math.log2(max(1, dim)) < bits)


def exact(a: np.ndarray, b: np.ndarray, scale: float) -> int:
    """The inner product of two vectors' cells, whatever their size."""
    whole = lambda v: math.floor(scale * v) if math.isfinite(scale * v) else math.floor(scale) * int(v)
    return sum(whole(v) * whole(w) for v, w in zip(a.tolist(), b.tolist()))


def distances(c: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The row of each vector in the pivot table."""
    squares = (c * c).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * c @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def best_in_block(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, scale: float, to_q: np.ndarray, to_x: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query row of q its k best rows of x by inner product, as (score, id), those below its floor left out.

    to_q, to_x: their rows of the pivot table. The differences of distances to the same pivots bound each distance from
    below; the largest over all pivots bounds the inner product (|q|^2 + |x|^2 - d^2) / 2 from above. Candidates are
    evaluated in the order of this bound, until the k-th best score so far, or the floor, is above the next bound.
    own: index in x of the query itself, or -1. Where products could be beyond what doubles hold exactly, all candidates are
    evaluated with whole numbers.
    """
    cx, high_x = cells(x, scale)
    cq, high_q = cells(q, scale)
    high = max(high_x, high_q)
    if not within(52, x.shape[1], high_x, high_q) or not within(100, x.shape[1], high, high):
        for i in range(len(q)):
            scored = sorted((-max(LEAST, min(MOST, exact(q[i], x[j], scale))), int(ids[j])) for j in range(len(x)) if j != own[i])[:k]
            yield i, [(-s, v) for s, v in scored]
        return
    norm_x, norm_q = (cx * cx).sum(1), (cq * cq).sum(1)
    for i in range(len(q)):
        low = np.abs(to_x - to_q[i]).max(1, initial=0.0)
        bound = (norm_q[i] + norm_x - low * low) / 2 + 1e-6 * (1 + norm_q[i] + norm_x)
        if own[i] >= 0:
            bound[own[i]] = -np.inf
        open_ = np.flatnonzero(bound >= floor[i])
        size = 64
        while True:
            if size < len(open_):
                order = open_[np.argpartition(-bound[open_], size)]
                rows, rest = order[:size], order[size:]
            else:
                rows, rest = open_, open_[:0]
            rows = rows[np.isfinite(bound[rows])]
            scores = cx[rows] @ cq[i]
            if not len(rest) or (len(rows) >= k and np.partition(scores, len(rows) - k)[len(rows) - k] > bound[rest].max()):
                break
            size *= 4
        pick = np.lexsort((ids[rows], -scores))[:k]
        yield i, [(int(s), v) for s, v in zip(scores[pick].tolist(), ids[rows[pick]].tolist()) if s >= floor[i]]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with every other row.

    Components x count as floor(scale * x). Query rows are those whose key is divisible by `every`. Ties go to the smaller
    vec_id; fewer rows than k give fewer results. Rows that repeat a key are rows of their own: each is a candidate for
    the others, and of query rows with one key, the results are merged under their key with rank over all (equal rows
    give equal scores). Vectors meet only vectors of their own dimension; empty ones meet each other with score 0.
    Scores beyond the range of a long are its ends. Vectors that are null or hold a null or a component that isn't
    finite, and rows without a key, take no part.

    Every vector's distances to the pivots of its dimension are computed once and stay with its block. A query starts
    with the k-th best score of its own block, and tasks carry it from block to block. Query blocks meet candidate
    blocks through an equi-join on the cells of a grid that grows with both: blocks are sent to the cells of their row
    or column, rows themselves are never paired by Spark.
    """
    spark = vectors.sparkSession
    packed = cut(blocks(vectors, key, vector))
    chosen = cut(pivots_of(packed))
    size = chosen.agg(F.sum(F.size("pivots") * (F.col("_dim") * 8 + 16))).first()[0] or 0
    near = F.broadcast(chosen) if size <= SENT_BYTES else chosen.hint("merge")

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, n, ids, data, pivots in zip(*(batch.column(i).to_pylist() for i in range(6))):
                x, a = decoded(data, n, dim), np.frombuffer(ids, "<i8")
                c, high = cells(x, scale)
                p, high_p = cells(np.frombuffer(b"".join(pivots), "<f8").reshape(len(pivots), dim), scale)
                fit = within(100, dim, max(high, high_p), max(high, high_p))
                table = distances(c, p) if fit else np.zeros((n, len(p)))
                mine = np.flatnonzero(a % every == 0)
                floor = np.full(len(mine), -np.inf)
                for i, found in best_in_block(x[mine], x, mine, a, k, scale, table[mine], table, floor.copy()):
                    if len(found) == k and LEAST < found[-1][0] < MOST:
                        floor[i] = found[-1][0]
                queries = {"place": mine.tolist(), "key": a[mine].tolist(), "data": [r.tobytes() for r in x[mine]], "table": [r.tobytes() for r in table[mine]], "floor": floor.tolist()}
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([dim]), pa.array([n]), pa.array([ids], pa.binary()), pa.array([data], pa.binary()), pa.array([table.tobytes()], pa.binary()), pa.array([[dict(zip(queries, r)) for r in zip(*queries.values())]], asks)], names=["block", "dim", "n", "ids", "data", "table", "queries"])

    asks = pa.list_(pa.struct([("place", pa.int64()), ("key", pa.int64()), ("data", pa.binary()), ("table", pa.binary()), ("floor", pa.float64())]))
    whole = packed.join(near, F.col("dim") == F.col("_dim")).select("block", "dim", "n", "ids", "data", "pivots")
    known = cut(whole.mapInArrow(tabled, "block long, dim long, n long, ids binary, data binary, table binary, queries array<struct<place:long,key:long,data:binary,table:binary,floor:double>>"))
    queries = known.select("block", "dim", F.explode("queries").alias("q"))
    counts = known.groupBy("dim").agg(F.sum(F.size("queries")).alias("_n")).select(F.col("dim").alias("_dim"), F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(QUERIES))).cast("long").alias("groups"))  # one row a dimension
    facts = known.agg(F.count("*").alias("blocks"), F.sum(F.size("queries")).alias("queries")).first()
    n_blocks, n_groups = max(1, facts["blocks"]), max(1, -(-(facts["queries"] or 0) // QUERIES))
    grouped = queries.join(counts.hint("merge"), F.col("dim") == F.col("_dim")).withColumn("group", F.pmod(F.xxhash64("block", "q.place"), F.col("groups")))
    asked = grouped.groupBy("dim", "group").agg(F.collect_list(F.struct("block", "q")).alias("queries"))
    # A grid of cells, `across` parts of the candidates by `down` parts of the queries. Candidates are sent `down` times and
    # queries `across` times; as queries are one in `every`, the volume is least where across / down is `every`.
    n = max(partitions(spark), -(-n_blocks * n_groups // MEETINGS))
    across = min(n, max(1, n_blocks), math.ceil(math.sqrt(n * every)))
    down = max(1, min(n_groups, -(-n // across)))
    sent = known.withColumn("i", F.pmod(F.xxhash64("block"), F.lit(across))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    grid = asked.withColumn("j", F.pmod(F.col("group"), F.lit(down)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    pairs = sent.select("i", "j", "block", "dim", "n", "ids", "data", "table").join(grid.hint("merge"), ["dim", "i", "j"]).select("block", "dim", "n", "ids", "data", "table", "group", "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple[int, int], dict[tuple[int, int], list[float]]] = {}
        for batch in batches:
            for block, dim, m, ids, data, table, group, asked in zip(*(batch.column(i).to_pylist() for i in range(8))):
                a, x = np.frombuffer(ids, "<i8"), decoded(data, m, dim)
                q = np.frombuffer(b"".join(y["q"]["data"] for y in asked), "<f8").reshape(len(asked), dim)
                to_x, to_q = np.frombuffer(table, "<f8").reshape(m, -1), np.frombuffer(b"".join(y["q"]["table"] for y in asked), "<f8").reshape(len(asked), -1)
                own = np.array([y["q"]["place"] if y["block"] == block else -1 for y in asked])
                if (dim, group) not in floors:
                    if len(floors) >= KEPT:
                        floors.pop(next(iter(floors)))
                    floors[dim, group] = {}
                best = floors[dim, group]  # the k best scores of each query in this task's blocks so far
                floor = np.array([max(y["q"]["floor"], best[who][-1] if len(best.get(who := (y["block"], y["q"]["place"]), ())) == k else -math.inf) for y in asked])
                out: list[tuple[int, int, int]] = []
                for i, found in best_in_block(q, x, own, a, k, scale, to_q, to_x, floor):
                    who = asked[i]["block"], asked[i]["q"]["place"]
                    out += [(asked[i]["q"]["key"], v, s) for s, v in found]
                    if found:
                        best[who] = sorted([*best.get(who, ()), *(s for s, _ in found if LEAST < s < MOST)], reverse=True)[:k]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(meet, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

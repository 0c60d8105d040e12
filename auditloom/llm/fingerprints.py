"""Document fingerprints by order MinHash.

Every run of K bytes of a text has a hash and the number of its occurrence; both together are hashed to a place on a ring.
Of each of SIZE equally spaced points of the ring the TAKEN occurrences that follow it are selected, put back in the order
in which they stand in the text, and the hashes of their runs are hashed as a tuple. An entry of two fingerprints is equal
if the same runs were selected and stand in the same order, which edits and moved passages both make rarer. In long
texts the selected are the least of their part of the ring; in short ones a point goes on into the next parts, so
every text has a full fingerprint.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import dealt, fresh, partitions, stored

#: Bytes of a run, entries of a fingerprint, occurrences selected for an entry, hexadecimal digits of an entry.
K, SIZE, TAKEN, DIGITS = 8, 128, 2, 4
#: Bytes of a text that are looked at together when runs are hashed.
CHUNK = 1 << 22
#: Rows whose keys the driver gets to choose the borders of parts, and parts for each partition.
SAMPLE, PARTS = 20_000, 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random (constants of a published generator, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(data: bytes) -> np.ndarray:
    """Hashes of all runs of K bytes, in text order; a shorter text is one run, filled up with zeros."""
    raw = np.frombuffer(data if len(data) >= K else data + bytes(K - len(data)), np.uint8)
    n = len(raw) - K + 1
    out = np.empty(n, np.uint64)
    for start in range(0, n, CHUNK):
        end = min(n, start + CHUNK)
        # eight bytes are one number, whatever place they start at
        view = np.lib.stride_tricks.sliding_window_view(raw[start : end + K - 1], K)
        out[start:end] = np.ascontiguousarray(view).view("<u8").ravel()
    return mixed(out + np.uint64(len(data) if len(data) < K else K))


def numbered(hashes: np.ndarray, low: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Each place with how often its hash stands before it, in order of hash and place.

    Hashes count as equal by their leading 64 - low bits; the others give way to the place, so that numbers alone are sorted.
    """
    key = ((hashes >> low) << low) | np.arange(len(hashes), dtype=np.uint64)
    key.sort()
    place = key & ((np.uint64(1) << low) - np.uint64(1))
    key >>= low
    at = np.arange(len(key))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
    return place, (at - first).astype(np.uint64)


def fingerprint(text: str) -> np.ndarray:
    """SIZE entries of 4 * DIGITS bits."""
    hashes = runs(text.encode("utf-8", "surrogatepass"))
    n = len(hashes)
    low = np.uint64(max(1, (n - 1).bit_length()))
    place, number = numbered(hashes, low)
    ring = mixed(hashes[place] + number * np.uint64(0x9E3779B97F4A7C15))
    key = ((ring >> low) << low) | place
    key.sort()
    points = np.arange(SIZE, dtype=np.uint64) << np.uint64(64 - (SIZE - 1).bit_length())
    chosen = (np.searchsorted(key, points)[:, None] + np.arange(TAKEN)) % n
    place = np.sort(key[chosen] & ((np.uint64(1) << low) - np.uint64(1)), axis=1)
    out = np.zeros(SIZE, np.uint64)
    for i in range(TAKEN):
        out = mixed(out * np.uint64(31) + hashes[place[:, i]])
    return out >> np.uint64(64 - 4 * DIGITS)


def written(entries: np.ndarray) -> str:
    return entries.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: the share of runs that two texts have in common, as the share of equal entries tells it.

    An entry is equal where all that were selected are common, so a share of equal entries q stands for q ** (1 / TAKEN) of the
    union; common runs are then counted for each text.
    """
    union = float((a == b).mean()) ** (1 / TAKEN)
    return 2 * union / (1 + union)


def edited(text: str, other: str) -> str:
    """A text whose last half (rounded down) gives way to as much, or all, of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


FOUND = T.StructType().add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the columns of docs but the text, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row of a row is that of the next smaller key; behind the last comes the first. Rows of one key stand in the order of
    a hash of their texts, null keys behind all others. A null text counts as empty; empty texts have the
    fingerprint of nothing. A single row is its own next. Equal texts have equal fingerprints wherever they stand. New columns
    replace columns of the same names.

    Keys in order are cut into parts by a sample; each part also gets the first row of the part behind it, so parts are
    independent. A row's place in the table breaks all ties, so rows of one key go to many parts. The table is read more than once
    and must have its rows in the same places each time: what isn't a plain scan of files is written to the shared folder first.
    """
    new = [f.name for f in FOUND]
    kept = [c for c in docs.columns if c.lower() not in new and c != text]
    if text not in docs.columns or text.lower() in new:
        raise ValueError(f"no column {text}, or its name is that of a result")
    docs = docs.select(*kept, text)
    docs = docs if _scan(docs) else stored(docs)
    none, down, tie, at, part, extra, a, b, c, d, p = fresh([*docs.columns, *new], "_none", "_down", "_tie", "_at", "_part", "_extra", "_a", "_b", "_c", "_d", "_p")
    order = [none, down, tie, at]
    # descending keys, nulls last
    keyed = docs.withColumns({none: F.col(key).isNull().cast("int"), down: F.bitwise_not(F.coalesce(F.col(key).cast("long"), F.lit(0))), tie: F.xxhash64(F.coalesce(text, F.lit(""))), at: F.monotonically_increasing_id()})
    n_parts = PARTS * partitions(docs.sparkSession)
    n_rows = docs.count()
    sized = keyed.select(*order, F.coalesce(F.length(text), F.lit(0)))
    sample = sized if n_rows <= SAMPLE else sized.filter(F.pmod(F.xxhash64(*order), F.lit(n_rows)) < SAMPLE)
    drawn = sorted(tuple(r) for r in sample.collect())  # about SAMPLE rows
    borders = _borders(drawn, n_parts)
    placed = keyed.withColumn(part, _part_of(keyed, order, borders))
    firsts = sorted((tuple(r[0]), r[1]) for r in placed.groupBy(part).agg(F.min(F.struct(*order)).alias("f")).select("f", part).collect())  # one row a part
    # the first row of a part goes behind the part before it, that of the first part behind the last
    before = {f: firsts[i - 1][1] for i, (f, _) in enumerate(firsts)}
    heads = docs.sparkSession.createDataFrame([(*f, p) for f, p in before.items()], f"{a} int, {b} long, {c} long, {d} long, {p} int")
    same = (F.col(none) == F.col(a)) & (F.col(down) == F.col(b)) & (F.col(tie) == F.col(c)) & (F.col(at) == F.col(d))
    again = placed.join(F.broadcast(heads), same).withColumn(part, F.col(p)).drop(a, b, c, d, p)
    rows = placed.withColumn(extra, F.lit(0)).unionByName(again.withColumn(extra, F.lit(1)))
    dealt_out = dealt(rows.select(*kept, text, part, extra, *order), partitions(docs.sparkSession), part).sortWithinPartitions(part, extra, *order)
    places = len(kept), len(kept) + 1, len(kept) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before: its batch and place, part, text and fingerprint
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                taken: list[tuple[pa.RecordBatch, int]] = []
                out: list[tuple] = []
                for i, (t, p, more) in enumerate(zip(*(batch.column(c).to_pylist() for c in places))):
                    t = t or ""
                    print_ = fingerprint(t)
                    if held is not None and held[2] == p:
                        source, j, _, own, mark = held
                        changed = edited(own, t)
                        other = fingerprint(changed)
                        taken.append((source, j))
                        out.append((len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(mark), written(other), likeness(mark, other), likeness(mark, print_)))
                    held = None if more else (batch, i, p, t, print_)
                if out:
                    own_columns = [pa.concat_arrays([b.column(c).slice(j, 1) for b, j in taken]) for c in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*own_columns, *[pa.array(x, y) for x, y in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]], names=[*kept, *new])

    schema = T.StructType([*docs.select(*kept).schema.fields, *FOUND.fields])
    return dealt_out.select(*kept, text, part, extra).mapInArrow(run, schema)


def _borders(drawn: list[tuple], n: int) -> list[tuple]:
    """Keys that cut rows (key..., characters) in order into n parts of about as many characters, each row counting for some more."""
    room = 1 + sum(r[-1] + 200 for r in drawn) // n
    held, borders = 0, []
    for r in drawn:
        if held >= room:
            borders.append(r[:-1])
            held = 0
        held += r[-1] + 200
    return borders


def _scan(df: DataFrame) -> bool:
    """Whether a table is read from files without anything in between that moves rows."""
    nodes = re.findall(r"^[\s:+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.MULTILINE)
    return set(nodes) <= {"Project", "Filter", "Relation"}


def _part_of(keyed: DataFrame, order: list[str], borders: list[tuple]):
    """The number of borders at or before a row."""
    shared = keyed.sparkSession.sparkContext.broadcast(borders)  # one row a part

    @F.pandas_udf("int")
    def part(a, b, c, d):
        import pandas as pd

        return pd.Series([bisect_right(shared.value, x) for x in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())], dtype="int32")

    return part(*[F.col(c) for c in order])

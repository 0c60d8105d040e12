"""Suffix-array dedup: repeated byte strings found by a distributed merge sort of suffixes.

Suffixes are sampled so that nothing is missed: of the positions in a window of LENGTH bytes, the one whose gram hashes
least is its anchor, so equal windows have equal anchors, KEY bytes or more before their ends. A territory is a run of
window starts with one anchor. Suffixes at anchors are sorted, to KEY bytes:

1. Every task sorts its own suffixes into runs, front-coded: each suffix as its common prefix with the one before and
   the rest. Runs are cut at splitters and exchanged by range.
2. Each range is merged by a loser tree that knows, for every run, the common prefix with the suffix put out last: it
   compares from there on, and not at all where these prefixes differ.
3. Suffixes with a whole KEY in common meet. Territories whose whole bytes are equal are repeated throughout. Others of
   one key are exchanged with their bytes, and their windows compared exactly.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, dealt, partitions, stored

KEY, GRAM = 48, 16
#: Suffixes in a run.
RUN = 150_000
#: Different territories of one key in one run that are sent on as suffixes; where there are more, all go to step 3 at once.
SENT = 8
#: Different territories of one key that one group compares; larger groups are split by longer strings.
GROUP = 200
_SHIFT = np.uint64(32)
_POSITION = np.uint64((1 << 32) - 1)  # a binary value has fewer bytes
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xA0761D6478BD642F)


def rolled(data: np.ndarray, size: int, odd: int = 0xE7037ED1A0B428DB) -> np.ndarray:
    """A hash of every run of `size` bytes: sums of powers, put together from runs of powers of two."""
    mask = (1 << 64) - 1
    power, n, h = odd & mask, 1, _BYTES[data]
    out, held, at = None, 0, data
    rest = size
    while True:
        if rest & 1:
            if out is None:
                out, held = h, n
            else:
                m = len(h) - held
                out, held = h[:m] * np.uint64(pow(odd, held, 1 << 64)) + out[n : n + m] if m > 0 else h[:0], held + n
        rest >>= 1
        if not rest:
            break
        h = h[:-n] * np.uint64(power) + h[n:] if len(h) > n else h[:0]
        power, n = power * power & mask, 2 * n
    out = out[: max(0, len(at) - size + 1)]
    out = out ^ (out >> _SHIFT)
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> _SHIFT)


def territories(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of every territory; of equal hashes the leftmost is the anchor."""
    windows = len(data) - length + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 3
    wide = length - KEY + 1
    key = (rolled(data, GRAM) & ~_POSITION) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    key = key[: windows + wide - 1]
    full = np.full(-(-len(key) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    full[: len(key)] = key
    full = full.reshape(-1, wide)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & _POSITION).astype(np.int64)
    turn = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.concatenate([[0], turn])
    return anchor[first], first, np.concatenate([turn, [windows]]) - 1


#: A suffix's facts beside its key: row, first, last, anchor, digest of the territory with the anchor's place in it.
Fact = tuple[int, int, int, int, bytes]


def packed(keys: list[bytes], facts: list[Fact]) -> bytes:
    """A front-coded run: sorted keys as (common prefix with the key before, rest), and their facts."""
    n = len(keys)
    table = np.frombuffer(b"".join(keys), np.uint8).reshape(n, KEY)
    common = np.zeros(n, np.uint8)
    if n > 1:
        differ = table[1:] != table[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), KEY)
    rest = table[np.arange(KEY)[None, :] >= common[:, None]].tobytes()
    numbers = np.array([f[0] for f in facts], "<i8").tobytes() + np.array([f[1] for f in facts], "<i4").tobytes() + np.array([f[2] - f[1] for f in facts], "<u2").tobytes() + np.array([f[3] - f[1] for f in facts], "<u2").tobytes()
    return struct.pack("<I", n) + common.tobytes() + numbers + b"".join(f[4] for f in facts) + rest


def unpacked(run: bytes) -> Iterator[tuple[int, bytes, Fact]]:
    """(common prefix with the key before, key, fact) of each suffix of a run."""
    (n,) = struct.unpack_from("<I", run)
    at = 4
    common = run[at : at + n]
    at += n
    rows = np.frombuffer(run, "<i8", n, at).tolist()
    first = np.frombuffer(run, "<i4", n, at + 8 * n).tolist()
    last = np.frombuffer(run, "<u2", n, at + 12 * n).tolist()
    anchor = np.frombuffer(run, "<u2", n, at + 14 * n).tolist()
    digests, rest = at + 16 * n, at + 32 * n
    key = b""
    for i in range(n):
        c = common[i]
        key = key[:c] + run[rest : rest + KEY - c]
        rest += KEY - c
        yield c, key, (rows[i], first[i], first[i] + last[i], first[i] + anchor[i], run[digests + 16 * i : digests + 16 * i + 16])


def merged(runs: list[Iterator[tuple[int, bytes, Fact]]]) -> Iterator[tuple[int, bytes, Fact]]:
    """Merges sorted runs by a loser tree; the first number of each result is its common prefix with the result before.

    Every waiting suffix carries its common prefix with the one put out last. Of two, the one with the longer prefix is
    less, and the other's prefix with it is the shorter one: nothing is compared. Only for equal prefixes are bytes
    looked at, from there on, and what they have in common is the loser's new prefix.
    """
    size = 1
    while size < len(runs):
        size *= 2
    end = (-1, b"", None)  # behind all others
    heads: list[tuple] = [next(r, end) for r in runs] + [end] * (size - len(runs))
    common = [0 if h[2] is not None else -1 for h in heads]
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(less, other)"""
        ca, cb = common[a], common[b]
        if ca != cb:
            return (a, b) if ca > cb else (b, a)
        if ca < 0:
            return a, b
        x, y = heads[a][1][ca:], heads[b][1][ca:]
        if x == y:
            common[b] = KEY
            return a, b
        if y < x:
            a, b = b, a
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        common[b] = ca + (8 * len(x) - differ.bit_length()) // 8
        return a, b

    def build(node: int) -> int:
        if node >= size:
            return node - size
        less, losers[node] = play(build(2 * node), build(2 * node + 1))
        return less

    best = build(1) if size > 1 else 0
    while common[best] >= 0:
        _, key, fact = heads[best]
        yield common[best], key, fact
        heads[best] = following = next(runs[best], end)
        common[best] = following[0]
        node = (best + size) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def joined(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals (row, first, last) with those that touch or overlap made one."""
    out: list[tuple[int, int, int]] = []
    for row, a, b in sorted(set(rows)):
        if out and out[-1][0] == row and a <= out[-1][2] + 1:
            out[-1] = (row, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((row, a, b))
    return out


_RUNS = "part long, run binary, row long, first long, last long, anchor long, grp long"
_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = ["part", "run", "row", "first", "last", "anchor", "grp"]


def _found(repeated: list[tuple[int, int, int]], open_: list[tuple[int, Fact]], runs: list[tuple[int, bytes]] = ()) -> pa.RecordBatch:
    """Rows of three kinds: runs; repeated windows (grp null); territories to compare (grp: hash of their key)."""
    rows = [(p, r, None, None, None, None, None) for p, r in runs]
    rows += [(None, None, *x, None, None) for x in joined(repeated)]
    rows += [(None, None, f[0], f[1], f[2], f[3], g) for g, f in open_]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, _KINDS)], names=_NAMES)


def _group(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def sampled_suffixes(data: bytes, row: int, length: int) -> Iterator[tuple[bytes, Fact]]:
    """Every anchor's suffix, to KEY bytes, with its facts."""
    for a, s, e in zip(*(x.tolist() for x in territories(np.frombuffer(data, np.uint8), length))):
        whole = xxhash.xxh3_128(data[s : e + length])
        whole.update((a - s).to_bytes(2, "big"))
        yield data[a : a + KEY], (row, s, e, a, whole.digest())


def splitters(slim: DataFrame, parts: int, length: int, sample: int = 500, most: int = 20_000) -> list[bytes]:
    """Keys that cut the sorted suffixes in about equal parts: about `most` suffixes of about `sample` documents, both chosen by hash. They bear on balance alone."""
    n = slim.count()
    # whether a document can be in the sample is told by its hash alone, before any text is moved
    near = slim.filter(F.pmod("row", F.lit(max(1, n // sample))) == 0).limit(2 * sample)
    size = near.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    stride = max(1, size // (length // 3) // most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for t in batch.column(0).to_pylist() for k, _ in sampled_suffixes(t or b"", 0, length) if xxhash.xxh3_64_intdigest(k) % stride == 0]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    keys = sorted({r["key"] for r in near.select("data").mapInArrow(run, "key binary").limit(2 * most).collect()})
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if len(keys) >= parts else keys


def step_one(slim: DataFrame, cuts: list[bytes], length: int) -> DataFrame:
    """Sorted, front-coded runs by range, and what a task can tell from its own suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, Fact]] = []

        def flush() -> pa.RecordBatch:
            held.sort()
            repeated, open_, keys, facts = [], [], [], []
            i = 0
            while i < len(held):
                j = i + 1
                key = held[i][0]
                while j < len(held) and held[j][0] == key:
                    j += 1
                if j - i == 1:
                    keys.append(key)
                    facts.append(held[i][1])
                else:
                    whole: dict[bytes, list[Fact]] = {}
                    for _, f in held[i:j]:
                        whole.setdefault(f[4], []).append(f)
                    for same in whole.values():
                        if len(same) > 1:
                            repeated += [f[:3] for f in same]
                    ones = [same[0] for same in whole.values()]
                    if len(ones) > 1:
                        open_ += [(_group(key), f) for f in ones]
                    for f in ones if len(ones) <= SENT else ones[:1]:
                        keys.append(key)
                        facts.append(f)
                i = j
            held.clear()
            ends = [0, *(bisect_left(keys, c) for c in cuts), len(keys)]
            return _found(repeated, open_, [(p, packed(keys[a:b], facts[a:b])) for p, (a, b) in enumerate(zip(ends, ends[1:])) if b > a])

        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data and len(data) >= length:
                    held.extend(sampled_suffixes(data, row, length))
                if len(held) >= RUN:
                    yield flush()
        if held:
            yield flush()

    return slim.mapInArrow(run, _RUNS)


def step_two(runs: DataFrame) -> DataFrame:
    """Merges the runs of each range; territories of equal bytes are repeated, others of one key are left to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and held:
                    yield from solve(held)
                    held = []
                part = p
                held.append(r)
        if held:
            yield from solve(held)

    def solve(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        repeated, open_, group, last = [], [], [], b""

        def close() -> None:
            if len(group) > 1:
                whole: dict[bytes, list[Fact]] = {}
                for f in group:
                    whole.setdefault(f[4], []).append(f)
                for same in whole.values():
                    if len(same) > 1:
                        repeated.extend(f[:3] for f in same)
                if len(whole) > 1:
                    open_.extend((_group(last), same[0]) for same in whole.values())

        for common, key, fact in merged([unpacked(r) for r in held]):
            if common < KEY:
                close()
                group.clear()
                last = key
                if len(repeated) + len(open_) > 100_000:
                    yield _found(repeated, open_)
                    repeated.clear()
                    open_.clear()
            group.append(fact)
        close()
        yield _found(repeated, open_)

    return runs.mapInArrow(run, _RUNS)


def squeezed(slim: DataFrame) -> DataFrame:
    """Texts compressed, for an exchange that has to move them whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                small = [c.compress(t or b"") for t in batch.column(batch.schema.get_field_index("data")).to_pylist()]
                columns = [pa.array(small, pa.binary()) if f.name == "data" else batch.column(i) for i, f in enumerate(batch.schema)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return slim.mapInArrow(run, slim.schema)


def sized(places: DataFrame, n: int, grp: str = "grp", keys: tuple[str, ...] = ("row", "first")) -> DataFrame:
    """Rows of `grp`, told apart by `keys`, with `large`: whether their group has more than GROUP of them.

    A group's rows meet its name in shares, not in one task. Names of large groups alone are put into all shares, so
    they are no more rows than are given. Sides that grow with the data are merged.
    """
    shares = min(n, GROUP)
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("_share")
    large = places.groupBy(F.col(grp).alias("_of")).count().filter(F.col("count") > GROUP).select("_of", share)
    own = F.pmod(F.xxhash64(*keys), F.lit(shares).cast("long"))
    return places.join(large.hint("merge"), (F.col(grp) == F.col("_of")) & (own == F.col("_share")), "left").withColumn("large", F.col("_of").isNotNull().cast("long")).drop("_of", "_share")


def step_three(small: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(row, first, last) of repeated windows in territories that share a key with others but not all their bytes.

    Territories of one group are brought together with their bytes and compared window by window, by 64-bit hashes of
    whole windows. A group of more than
    GROUP is never brought together: its territories are cut in two by the anchor's place in the window, and each half
    gets a new group by what all its windows have in common, which is a longer string. So groups fall apart until they
    are small, or a half is a single window, where being in one group is being equal.
    """
    n = partitions(small.sparkSession)
    places = cut(open_.distinct())
    # which groups are large is told from places alone, before any bytes are moved
    flagged = sized(places, n)
    at = flagged.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("grp", "first", "last", "anchor", "large")).alias("at"))
    texts = small.join(at.hint("merge"), F.col("row") == F.col("_row")).select("row", "data", "at")
    kinds = [pa.int64()] * 8 + [pa.binary()]
    names = ["grp", "row", "first", "last", "anchor", "low", "high", "large", "data"]
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", data binary"

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                rows = []
                for row, data, at in zip(*(whole.slice(start, 200).column(i).to_pylist() for i in range(3))):
                    data = d.decompress(data)
                    rows += [(x["grp"], row, x["first"], x["last"], x["anchor"], 0, length - KEY, x["large"], data[x["first"] : x["last"] + length]) for x in at]
                yield table(rows)

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                rows = []
                for _, row, first, last, anchor, low, high, _, data in zip(*(whole.slice(start, 1000).column(i).to_pylist() for i in range(9))):
                    mid = (low + high) // 2
                    for lo, hi in ((low, mid), (mid + 1, high)):
                        a, b = max(first, anchor - hi), min(last, anchor - lo)  # starts with the anchor lo to hi bytes behind them
                        if a <= b:
                            core = data[anchor - lo - first : anchor - hi + length - first]
                            group = xxhash.xxh3_64_intdigest(core, seed=lo * length + hi) - (1 << 63)
                            rows.append((group, row, a, b, anchor, lo, hi, 0, data[a - first : b - first + length]))
                yield table(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int, int]] = []

        def solve() -> None:
            if len(held) < 2:
                return
            hashes = [rolled(np.frombuffer(x[4], np.uint8), length) for x in held]
            every = np.concatenate(hashes)
            owner, first = np.repeat(np.arange(len(held)), list(map(len, hashes))), np.concatenate([np.arange(len(h)) for h in hashes])
            _, group, times = np.unique(every, return_inverse=True, return_counts=True)
            hit = np.flatnonzero(times[group] > 1)
            if not len(hit):
                return
            o, f = owner[hit], first[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (o[1:] != o[:-1]) | (f[1:] != f[:-1] + 1)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(hit)) - 1
            out.extend((held[i][1], held[i][2] + x, held[i][2] + y) for i, x, y in zip(o[a].tolist(), f[a].tolist(), f[b].tolist()))

        def table_out() -> pa.RecordBatch:
            rows = joined(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], names=["row", "first", "last"])

        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and held[0][0] != x[0]:
                    solve()
                    held.clear()
                held.append(x)
            if len(out) > 50_000:
                yield table_out()
        solve()
        yield table_out()

    left, found = stored(texts.mapInArrow(deal, schema)), []
    while True:
        # later rounds have little: not a task for each partition
        few = dealt(left.filter("large = 0"), None if found else n, "grp").sortWithinPartitions("grp", "row", "first")
        found.append(few.select("grp", "row", "first", "last", "data").mapInArrow(meet, "row long, first long, last long"))
        many = left.filter("large = 1")
        if many.isEmpty():
            break
        found.append(many.filter("low = high").select("row", "first", "last"))
        halves = stored(many.filter("low < high").mapInArrow(halve, schema)).withColumn("digest", F.sha2("data", 256)).drop("large")
        # halves of equal bytes repeat each other throughout; one of each goes on
        kinds_of = halves.groupBy(F.col("grp").alias("_grp"), F.col("digest").alias("_digest")).agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("one"))
        facts = cut(sized(kinds_of, n, "_grp", ("_digest",)))
        told = stored(halves.join(facts.hint("merge"), (F.col("grp") == F.col("_grp")) & (F.col("digest") == F.col("_digest"))))
        found.append(told.filter("n > 1").select("row", "first", "last"))
        left = told.filter("row = one.row AND first = one.first").select(*names)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def dedup(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes every byte that a string of `length` bytes covers which also starts anywhere else; adds n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) and kept_sha256 to each row.

    Texts are UTF-8 bytes, null is empty. Strings stay inside a text; occurrences may overlap and may be in one text;
    all are judged on the input, so no copy stays. n_spans counts maximal removed runs. Texts shorter than `length`
    stay whole. Rows equal in key and text are texts of their own, each of which repeats the other. New columns replace
    columns of the same names.
    """
    if not KEY + GRAM <= length < 1 << 15:
        raise ValueError("length is out of range")
    spark = docs.sparkSession
    new = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    kept = [c for c in docs.columns if c.lower() not in new]
    row = F.xxhash64(key, text).alias("row")
    slim = docs.select(row, F.col(text).cast("binary").alias("data"))
    parts = 4 * partitions(spark)
    cuts = splitters(slim, parts, length)
    one = cut(step_one(slim, cuts, length))
    runs = dealt(one.filter("part IS NOT NULL"), partitions(spark), "part").sortWithinPartitions("part")
    two = cut(step_two(runs))
    told = one.filter("part IS NULL").unionByName(two)
    open_ = told.filter("grp IS NOT NULL").select("row", "first", "last", "anchor", "grp")
    whole = told.filter("part IS NULL AND grp IS NULL").select("row", "first", "last")
    rest = step_three(squeezed(slim), open_, length)
    hits = whole.unionByName(rest).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("hits"))
    own = squeezed(docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(kept) if c != text], row, F.col(text).isNull().alias("no_text"), F.col(text).cast("binary").alias("data")))
    both = own.join(hits.withColumnRenamed("row", "_row").hint("merge"), F.col("row") == F.col("_row"), "left").drop("_row", "row")
    others = [c for c in both.columns if c not in ("hits", "data", "no_text")]
    names = {f"_{i}": c for i, c in enumerate(kept)}

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                facts = []
                for data, found in zip(batch.column(len(others)).to_pylist(), batch.column(len(others) + 1).to_pylist()):
                    data = d.decompress(data)
                    spans: list[list[int]] = []
                    for x in sorted((x["first"], x["last"]) for x in found or ()):
                        if spans and x[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], x[1] + length)
                        else:
                            spans.append([x[0], x[1] + length])
                    left, at = [], 0
                    for a, b in spans:
                        left.append(data[at:a])
                        at = b
                    left = b"".join([*left, data[at:]])
                    facts.append((len(data), len(data) - len(left), len(spans), left, hashlib.sha256(left).hexdigest()))
                columns = [pa.array(c, k) for c, k in zip(zip(*facts), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), *columns], names=[*others, *new])

    ordered = both.select(*others, "data", "hits")
    schema = ordered.select(*others).schema
    for name, kind in zip(new, ("long", "long", "long", "binary", "string")):
        schema = schema.add(name, kind)
    done = ordered.mapInArrow(cut_out, schema)
    return done.select(*[F.col(c).alias(names[c]) for c in others], *new)

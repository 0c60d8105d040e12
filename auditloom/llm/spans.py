"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import fresh, partitions

#: A sentence ends after . ! or ? (or their CJK forms) before white space, after a CJK form, or with a line.
_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\s*[\r\n]+\s*")
#: Spans that a task gathers before it looks for repeats among them.
HELD = 1_000_000


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence of a text."""
    found, at = [], 0
    for m in _END.finditer(text):
        if m.start() > at:
            found.append((at, m.start()))
        at = m.end()
    if at < len(text):
        found.append((at, len(text)))
    return [(a, b) for a, b in found if not text[a:b].isspace()]


def spans(text: str, several: int, words: int, long: int, ends: bool = False) -> Iterator[tuple[bytes, int, int]]:
    """(digest, first sentence, last sentence) of every span: from each sentence the shortest run of at least `several` sentences with at least `words` words, or of at least `long` words. White space inside a sentence counts as one space.

    ends: also the shortest such run up to each sentence, where it isn't the shortest from its first sentence on. Whether
    a run is one or the other hangs on the run alone, so equal runs are spans everywhere, and both kinds together cover
    every run that is long enough up to its last sentence.
    """
    parts = [text[a:b].split() for a, b in sentences(text)]
    counts = [len(p) for p in parts]
    parts = [" ".join(p) for p in parts]
    j, held, n = 0, 0, len(parts)
    for i in range(n):
        if j < i:
            j, held = i, 0
        while j < n and not ((j - i >= several and held >= words) or held >= long):
            held += counts[j]
            j += 1
        if not ((j - i >= several and held >= words) or held >= long):
            break
        # taking away a sentence may leave the run longer than it need be; the run of the next start is found anew
        yield xxhash.xxh3_128_digest("\x1f".join(parts[i:j])), i, j - 1
        held -= counts[i]
        while j > i + 1 and ((j - 1 - (i + 1) >= several and held - counts[j - 1] >= words) or held - counts[j - 1] >= long):
            j -= 1
            held -= counts[j]
    if not ends:
        return
    upto = [0, *accumulate(counts)]
    enough = lambda a, b: (b - a >= several and upto[b] - upto[a] >= words) or upto[b] - upto[a] >= long
    i = 0
    for j in range(1, n + 1):
        while i + 1 < j and enough(i + 1, j):
            i += 1
        if enough(i, j - 1):
            yield xxhash.xxh3_128_digest("\x1f".join(parts[i:j])), i, j - 1


def repeated(docs: DataFrame, key: str, text: str, several: int, words: int, long: int, ends: bool = False) -> DataFrame:
    """(_row, first, last) of every span that isn't the first of its kind in order of key (null last), row hash, sentence.

    Every task sorts its own spans by digest and lets only its first of a kind through to the exchange by digest: what
    a task knows to be no first goes along under a key of its own. So a passage that a third of all rows hold is sent
    once a task. Behind the exchange each digest's first is found in one pass over sorted rows.
    """
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))
    schema = slim.drop("text").schema.add("low", "long").add("high", "long").add("first", "long").add("last", "long").add("known", "boolean")

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = None

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(held)), key=lambda i: (held[i][0], held[i][1] is None, held[i][1] if held[i][1] is not None else 0, held[i][2], held[i][3]))
            known = [False] * len(held)
            for a, b in zip(order, order[1:]):
                # the same row twice is the same occurrence
                known[b] = held[a][0] == held[b][0] and (known[a] or held[a][1:4] != held[b][1:4])
            digests = np.frombuffer(b"".join(h[0] for h in held), "<i8").reshape(-1, 2)
            rows = np.array([h[2] for h in held], np.int64)
            mask = np.array(known, bool)
            low = np.where(mask, rows, digests[:, 0]) if len(held) else np.zeros(0, np.int64)
            high = np.where(mask, 0, digests[:, 1]) if len(held) else np.zeros(0, np.int64)
            out = pa.RecordBatch.from_arrays([pa.array([h[1] for h in held], kind), pa.array(rows), pa.array(low), pa.array(high), pa.array([h[3] for h in held], pa.int64()), pa.array([h[4] for h in held], pa.int64()), pa.array(known, pa.bool_())], names=schema.names)
            held.clear()
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, row, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if t:
                    held.extend((d, k, row, a, b) for d, a, b in spans(t, several, words, long, ends))
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # digest and place of the group's first
        for batch in batches:
            low, high, known = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3, 6))
            rows, first = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 4))
            if not len(low):
                continue
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            new[0] = last is None or (last[0], last[1]) != (low[0], high[0])
            start = np.maximum.accumulate(np.where(new, np.arange(len(low)), -1))
            head_row = np.where(start >= 0, rows[start], last[2] if last else 0)
            head_first = np.where(start >= 0, first[start], last[3] if last else 0)
            out = known | (rows != head_row) | (first != head_first)
            last = (low[-1], high[-1], head_row[-1], head_first[-1])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(4), batch.column(5)], names=["_row", "first", "last"]).filter(pa.array(out))

    n = partitions(docs.sparkSession)
    dealt = slim.mapInArrow(cutter, schema).repartition(n, "low", "high")
    ordered = dealt.sortWithinPartitions("known", "low", "high", F.col("key").isNull(), "key", "row", "first")
    return ordered.mapInArrow(meeting, "_row long, first long, last long")


def dedup(docs: DataFrame, several: int = 3, words: int = 15, long: int = 40, key: str = "doc_id", text: str = "text", ends: bool = False) -> DataFrame:
    """Removes sentences that any non-first repeated span covers; adds n_sentences, n_removed and n_chars_removed.

    A span is the shortest run from a sentence on that has at least `several` sentences and `words` words, or `long`
    words; with `ends` also the shortest such run up to a sentence, so that all sentences of every repeated run that is
    long enough count, whatever stands before and behind it. The first span of a kind, by key (null last) and place in the text, stays; all sentences of the others go,
    each with the white space behind it. What is left is otherwise unchanged. Spans never go over the border of a text.

    Null texts stay null, with no sentences; texts too short for a span stay whole. Rows equal in key and text are one
    document: they keep the same sentences. Columns named like the new ones are replaced, others are kept.
    """
    new = ["n_sentences", "n_removed", "n_chars_removed"]
    kept = [c for c in docs.columns if c.lower() not in new]
    at = kept.index(text)
    mine, theirs, found = fresh([*kept, *new], "_mine", "_theirs", "_found")
    hits = repeated(docs, key, text, several, words, long, ends).groupBy(F.col("_row").alias(theirs)).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias(found))
    both = docs.select(*kept, F.xxhash64(key, text).alias(mine)).join(hits, F.col(mine) == F.col(theirs), "left")
    both = both.select(*kept, F.col(f"{found}.first").alias(mine), F.col(f"{found}.last").alias(theirs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                texts, n, gone, chars = [], [], [], []
                for t, a, b in zip(*(batch.column(i).to_pylist() for i in (at, len(kept), len(kept) + 1))):
                    cuts = sentences(t) if t else []
                    out: set[int] = set()
                    for x, y in zip(a or (), b or ()):
                        out.update(range(x, y + 1))
                    if out:
                        keep, starts = [], [c[0] for c in cuts] + [len(t)]
                        keep.append(t[: starts[0]])
                        keep.extend(t[starts[i] : starts[i + 1]] for i in range(len(cuts)) if i not in out)
                        left = "".join(keep)
                        left = left.rstrip() if left.strip() else ""
                    else:
                        left = t
                    texts.append(left)
                    n.append(len(cuts))
                    gone.append(len(out))
                    chars.append(len(t or "") - len(left or ""))
                columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n, gone, chars))], names=[*kept, *new])

    schema = docs.select(*kept).schema
    for c in new:
        schema = schema.add(c, "long")
    return both.mapInArrow(run, schema)



"""Toxicity by compression distance to two zstandard dictionaries.

A window is a word (letters in lower case, between marks; longer runs of letters are cut). Its letters are written as
four bytes each, so that even a short word is long enough for the compressor's matches to show in its length. One
dictionary is filled with the words that stand out in toxic texts, one with the common words of ordinary texts; a
window's distance is the length under the ordinary dictionary less the length under the toxic one. A text's score is a
logistic function of how many of its windows reach a calibrated threshold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, fresh

_WORD = re.compile(r"[^\W\d_]+")
#: Letters of a window at most.
LETTERS = 32
_PAD = bytes(range(200, 212))  # after the window: the compressor finds no match in the last bytes
THRESHOLDS = tuple(range(1, 9))
#: Words whose distance a worker keeps, in each of two generations.
KEPT = 200_000


def windows(text: str | None) -> list[str]:
    """The windows of a whole text."""
    found = _WORD.findall((text or "").lower())
    if max(map(len, found), default=0) > LETTERS:
        found = [w[i : i + LETTERS] for w in found for i in range(0, len(w), LETTERS)]
    return found


def coded(word: str) -> bytes:
    """A window as bytes: four for each letter, so that no two letters share a long run."""
    return b"".join(((ord(c) * 0x9E3779B1) & 0xFFFFFFFF).to_bytes(4, "big") for c in f"<{word}>")


@dataclass(frozen=True)
class Model:
    """toxic, ordinary: contents of the dictionaries; threshold of a distance; weights of (1, any, log(1 + count))."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: tuple[float, float, float]

    def score(self, count: int) -> float:
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * (count > 0) + c * math.log1p(count)))))


class Distances:
    """Distances of windows under a model's dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.empty = len(toxic) < 8 or len(ordinary) < 8
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        if not self.empty:
            self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(13, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=trained)

    def of(self, words: list[str]) -> list[int]:
        if self.empty:
            return [-1] * len(words)
        try:
            return list(map(self.new.__getitem__, words))
        except KeyError:
            pass
        out = []
        for w in words:
            d = self.new.get(w)
            if d is None:
                d = self.old.get(w)
                if d is None:
                    window = coded(w) + _PAD
                    d = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
                if len(self.new) >= KEPT:
                    self.old, self.new = self.new, {}
                self.new[w] = d
            out.append(d)
        return out


def _counted(docs: DataFrame, text: str, toxic: bytes, ordinary: bytes, thresholds: tuple[int, ...], names: list[str]) -> DataFrame:
    """Replaces text by counts: the windows of each text that reach each threshold."""
    kept, at = [c for c in docs.columns if c != text], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(toxic, ordinary)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                counts = []
                for t in batch.column(at).to_pylist():
                    found = known.of(windows(t))
                    counts.append([sum(d >= x for d in found) for x in thresholds] if found and max(found) >= thresholds[0] else [0] * len(thresholds))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(docs_columns)) if i != at), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(thresholds)))], names=[*kept, *names])

    docs_columns = docs.columns
    schema = docs.select(*kept).schema
    for x in names:
        schema = schema.add(x, "long")
    return docs.mapInArrow(run, schema)


_KNOWN: dict[tuple[bytes, bytes], Distances] = {}


def _known(toxic: bytes, ordinary: bytes) -> Distances:
    """The distances of a worker that is used again stay."""
    if (toxic, ordinary) not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[toxic, ordinary] = Distances(toxic, ordinary)
    return _KNOWN[toxic, ordinary]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 4000) -> Model:
    """Learns a model from labelled rows: at most `sample` of each label, those of the least hash, so the driver holds a bounded number of words and counts.

    Three fifths of them, by another hash, fill the dictionaries: the toxic one with the words whose document frequencies
    differ more between the labels, by the log likelihood ratio, than chance explains, the ordinary one with all others
    that two or more ordinary texts hold. The rest sets threshold and weights, with rows weighted so that the labels keep
    their share. Of contradicting labels of one key, toxic counts; of several texts of one key, that of the least hash. Rows whose label is neither 0 nor 1 and rows without a
    key are left out. Without labels of both kinds the score is the share of 1.

    The contents are raw-content dictionaries in the order of use. Dictionaries made by the compressor's own trainer tell
    the labels apart worse (figures in the README), as it keeps what is frequent, not what differs.
    """
    good = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    share = {r["label"]: r["count"] for r in good.groupBy("label").count().collect()}  # two rows
    if len(share) < 2:
        rate = min(max(share.get(1, 0) / max(1, sum(share.values())), 1e-6), 1 - 1e-6)
        return Model(b"", b"", 1, (math.log(rate / (1 - rate)), 0.0, 0.0))
    drawn = None
    for value in (0, 1):
        part = good.filter(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(sample)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("_key") == F.col("key"))  # 2 * sample keys
    # one row a key, however many rows have it
    rows = rows.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("_least")).select("key", "label", "_least.text")
    rows = cut(rows.select("label", (F.pmod(F.xxhash64("key", F.lit("half")), F.lit(5)) < 3).alias("first"), "text"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = sorted(set(windows(t)))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([y] * len(words), pa.int64())], names=["word", "label"])

    half = rows.filter("first")
    n = {r["label"]: r["count"] for r in half.groupBy("label").count().collect()}
    seen_in = half.mapInArrow(seen, "word string, label long").groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
    part = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)  # of the texts, those that are toxic
    both = F.col("toxic") + F.col("other")
    gain = F.col("toxic") * F.log((F.col("toxic") + 1e-9) / (both * part)) + F.col("other") * F.log((F.col("other") + 1e-9) / (both * (1 - part)))
    seen_in = cut(seen_in.withColumn("gain", F.when(F.col("toxic") > both * part, gain).otherwise(0.0)))
    least = math.log(max(1, seen_in.count())) - 2  # by chance, about seven words gain as much
    toxic = [r["word"] for r in seen_in.filter(F.col("gain") >= least).orderBy(F.col("gain").desc(), "word").collect()]
    ordinary = [r["word"] for r in seen_in.filter((F.col("other") >= 2) & (F.col("gain") < least / 2)).orderBy(F.col("other").desc(), "word").collect()]
    contents = [b"".join(map(coded, reversed(x))) for x in (toxic, ordinary)]  # the likeliest words last, where matches are cheap
    other = _counted(rows.filter("NOT first").select("label", "text"), "text", *contents, THRESHOLDS, [f"_n{x}" for x in THRESHOLDS]).collect()  # at most 2 * sample rows of counts
    y = np.array([r["label"] for r in other], float)
    if not len(y) or y.min() == y.max():
        rate = share[1] / (share[0] + share[1])
        return Model(*contents, THRESHOLDS[2], (math.log(rate / (1 - rate)) - 1, 4.0, 1.0))
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    weight /= weight.mean()
    best = None
    for x in THRESHOLDS:
        count = np.array([r[f"_n{x}"] for r in other], float)
        w, loss = _logistic(np.column_stack([np.ones(len(y)), count > 0, np.log1p(count)]), y, weight)
        if best is None or loss < best[0] - 1e-9:
            best = loss, x, w
    return Model(*contents, best[1], tuple(map(float, best[2])))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression by Newton steps, and its mean loss."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (double, 0 to 1, higher: likelier toxic), predicted (int, 1 from 0.5) and n_windows_hit to each row.

    The whole text counts, and nothing else. Null and empty texts have no window that reaches the threshold. Rows are
    independent: repeated rows get equal scores, nothing is shuffled. New columns replace columns of the same names.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted", "n_windows_hit")]
    scored, hits = fresh([*kept, "score", "predicted", "n_windows_hit"], "_scored", f"_n{model.threshold}")
    counted = _counted(docs.select(*kept, F.col(text).alias(scored)), scored, model.toxic, model.ordinary, (model.threshold,), [hits])
    a, b, c = (F.lit(w) for w in model.weights)
    line = a + b * (F.col(hits) > 0).cast("double") + c * F.log1p(F.col(hits).cast("double"))
    value = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))
    return counted.select(*kept, value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), F.col(hits).alias("n_windows_hit"))

"""Phrase collocation mining with an FM-index over word ids for each shard of the text.

A shard is a bounded run of words of one language, each piece of text between two borders. Its index has the words before
(and, for the text read backwards, behind) all suffixes in sorted order. A phrase is a pair of intervals of equal size, one in
each order; a step to the left narrows the first interval by the words that stand before it and moves the second along, a
step to the right the other way round. So all phrases up to a depth are found with their counts and their words on either
side, without looking at the text. Suffixes are sorted by as many words as phrases can have, which is all that steps need.

Counts of a phrase are summed across shards. Longer phrases are looked for only where all pairs of neighbours in them are
frequent in the whole table: a bit filter of bounded size, without false negatives, says so.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import partitions, stored

#: Symbols of a shard at most, words and borders: three of their numbers fit in 63 bits. Shards of a file, which one task reads together.
SYMBOLS, SHARDS = 1 << 18, 8
#: Rows of a batch that goes back to Spark.
ROWS = 1 << 16
#: The bit filter of pairs has so many bits for each of them, up to 2 ** FILTER.
BITS, FILTER = 32, 28
#: What ends a piece, and what parts words.
_BORDER, _SPACE = b".,;:!?\n\x0b\x0c\r", b"\t "
_LETTERS = bytes(10 if b in _BORDER else 32 if b in _SPACE else b + 32 if 65 <= b <= 90 else b for b in range(256))
SHARD = "lang string, sign int, n_words long, words binary, before binary, behind binary"


class _Numbers(dict):
    """Numbers words in the order in which they come; 0 is a border, 1 is the nothing between two spaces."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Open:
    """A shard that words are added to."""

    def __init__(self) -> None:
        self.number, self.symbols = _Numbers(), array("i", [0])

    def add(self, words: list[bytes]) -> None:
        self.symbols.extend(map(self.number.__getitem__, words))
        self.symbols.append(0)


def ordered(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least, then by place. Ranks double: those of 2 d symbols come from two of d."""
    n, bits = len(symbols), SYMBOLS.bit_length() - 1
    rank, known = symbols.astype(np.int64), 1
    place = np.arange(n, dtype=np.int64)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - known] = rank[known:] if known < n else 0
        key = (((rank << bits) | behind) << bits) | place
        key.sort()
        order = key & (SYMBOLS - 1)
        known *= 2
        if known >= depth:
            return order
        key >>= bits
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))


def index(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols before all suffixes in sorted order, and those behind all prefixes, sorted as read backwards."""
    back = symbols[::-1]
    return symbols[ordered(symbols, depth) - 1], back[ordered(back, depth) - 1]


@dataclass
class Phrases:
    """Phrases of one length: a row of words each, where their intervals start in the two orders, and their size, which is their count."""

    words: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray


class Fm:
    """The index of a shard, with where each symbol is among those before (and behind)."""

    def __init__(self, before: np.ndarray, behind: np.ndarray) -> None:
        self.sides = before, behind
        self._shift = SYMBOLS.bit_length()
        self._found = []
        for s in self.sides:
            key = (s.astype(np.int64) << self._shift) | np.arange(len(s))
            key.sort()
            self._found.append(key)

    def single(self) -> Phrases:
        """All words."""
        count = np.bincount(self.sides[0])
        starts = np.cumsum(count) - count
        words = 2 + np.flatnonzero(count[2:])
        return Phrases(words[:, None].astype(np.int32), starts[words], starts[words], count[words])

    def step(self, phrases: Phrases, to_left: bool, keep=None) -> Phrases:
        """All phrases that are one word longer to the left (or right); keep(words that are added, words that they are added to) may refuse some."""
        side = 0 if to_left else 1
        here, other = (phrases.left, phrases.right) if to_left else (phrases.right, phrases.left)
        ends = np.cumsum(phrases.size)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(here - (ends - phrases.size), phrases.size)
        key = (np.repeat(np.arange(len(here), dtype=np.int64), phrases.size) << self._shift) | self.sides[side][rows]
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        parent, word = key[new] >> self._shift, key[new] & ((1 << self._shift) - 1)
        # in the other order, extensions of a phrase lie in its interval one behind the other, by their word
        moved = other[parent] + new - (ends - phrases.size)[parent]
        good = word >= 2
        edge = phrases.words[:, 0 if to_left else -1]
        if keep is not None:
            good &= keep(word, edge[parent])
        parent, word, count, moved = parent[good], word[good], count[good], moved[good]
        at = np.searchsorted(self._found[side], (word << self._shift) | here[parent])
        column = word[:, None].astype(np.int32)
        old = phrases.words[parent]
        if to_left:
            return Phrases(np.hstack([column, old]), at, moved, count)
        return Phrases(np.hstack([old, column]), moved, at, count)


def shards(docs: DataFrame, depth: int, text: str = "text", lang: str = "lang", size: int = SYMBOLS) -> DataFrame:
    """Indexes of runs of words of one language, of `size` symbols at most: lang, sign, n_words, words, before, behind.

    A task holds eight times as many symbols in open shards.
    A piece longer than a shard is cut, with as many words of overlap as a phrase may reach over the cut; what lies wholly
    in the overlap is in two shards and, with sign -1, in a third.
    """
    step = size // 4

    def closed(key: tuple[str, int], x: _Open) -> pa.RecordBatch:
        s = np.frombuffer(x.symbols, np.int32)
        s = s[s != 1]
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        before, behind = index(s, depth)
        words = b"\n".join(list(x.number)[2:])
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([int((s != 0).sum())], pa.int64()), *[pa.array([v], pa.binary()) for v in (words, before.astype("<i4").tobytes(), behind.astype("<i4").tobytes())]], names=["lang", "sign", "n_words", "words", "before", "behind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[str, int], _Open] = {}
        held = 0

        def add(key: tuple[str, int], words: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            x = open_.setdefault(key, _Open())
            if len(x.symbols) + len(words) + 1 > size:
                yield closed(key, x)
                held -= len(x.symbols)
                x = open_[key] = _Open()
            n = len(x.symbols)
            x.add(words)
            held += len(x.symbols) - n
            if held > 8 * size:
                largest = max(open_, key=lambda k: len(open_[k].symbols))
                yield closed(largest, open_[largest])
                held -= len(open_.pop(largest).symbols)

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                for t, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = (t or "").encode("utf-8", "surrogatepass").translate(_LETTERS).replace(b"\n", b" \n ").split(b" ")
                    if len(words) > step:
                        words = [w for w in words if w]
                    while len(words) > step:
                        end = next((i for i in range(step, step // 2, -1) if words[i] == b"\n"), None)
                        if end is None:  # no border: cut there, with overlap
                            end, over = step, words[step : step + depth - 1]
                            yield from add((name, -1), over)
                            yield from add((name, 1), words[:end] + over)
                        else:
                            yield from add((name, 1), words[:end])
                        words = words[end:]
                    yield from add((name, 1), words)
        for key, x in open_.items():
            yield closed(key, x)

    return docs.select(text, F.coalesce(F.col(lang), F.lit("und")).alias("lang")).mapInArrow(run, SHARD)


def _rows(lang: str, sign: int, words: pa.Array, found: Phrases) -> Iterator[pa.RecordBatch]:
    """Phrases as text, with their counts."""
    for start in range(0, len(found.size), ROWS):
        part = found.words[start : start + ROWS]
        columns = [words.take(pa.array(part[:, i])) for i in range(part.shape[1])]
        phrase = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", words.type))
        n = found.size[start : start + ROWS] * sign
        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), pa.array(np.full(len(n), part.shape[1], np.int32)), phrase.cast(pa.string()), pa.array(n)], names=["lang", "k", "phrase", "n"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, Fm]]:
    for batch in batches:
        for i in range(batch.num_rows):
            name, sign, _, words, before, behind = (c[i].as_py() for c in batch.columns)
            yield name, sign, pa.array([b"", b"", *words.split(b"\n")], pa.binary()), Fm(np.frombuffer(before, "<i4"), np.frombuffer(behind, "<i4"))


def short(found: DataFrame) -> DataFrame:
    """Counts of words and pairs of each shard: lang, k, phrase, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, sign, words, fm in _opened(batches):
            single = fm.single()
            yield from _rows(name, sign, words, single)
            yield from _rows(name, sign, words, fm.step(single, True))

    return found.mapInArrow(run, "lang string, k int, phrase string, n long")


def pair_place(first, second, bits: int):
    """The place of a pair in a filter of 2 ** bits, by 64-bit hashes of its words; as a column, or for arrays of unsigned numbers."""
    if isinstance(first, Column):
        turned = F.shiftleft(second, 1).bitwiseOR(F.shiftrightunsigned(second, 63))
        return F.shiftrightunsigned(first.bitwiseXOR(turned), 64 - bits)
    turned = (second << np.uint64(1)) | (second >> np.uint64(63))
    return (first ^ turned) >> np.uint64(64 - bits)


def filter_of(pairs: DataFrame) -> tuple[int, np.ndarray]:
    """A bit filter of pairs (lang, phrase): how many bits, and the bits by bytes; 2 ** FILTER bits at most, whatever the number of pairs."""
    bits = min(FILTER, max(15, (BITS * pairs.count()).bit_length()))
    word = lambda i: F.xxhash64(F.concat_ws("\t", "lang", F.substring_index("phrase", " ", i)))
    place = pairs.select((pair_place(word(1), word(-1), bits) + 1).alias("p"))
    blocks = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for b, m in blocks.collect():  # 2 ** bits / 32768 rows of 4 kB at most
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)[: len(out)]
    return bits, out


def long(found: DataFrame, pairs: tuple[int, np.ndarray], depth: int) -> DataFrame:
    """Counts of phrases of 3 to `depth` words of each shard, all of whose pairs of neighbours are in the filter: lang, k, phrase, n.

    Steps go to the right and to the left by turns, so each phrase is reached once.
    """
    shared = found.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits, known = shared.value
        for name, sign, words, fm in _opened(batches):
            head = name.encode() + b"\t"
            hashed = np.array([xxhash.xxh64_intdigest(head + w, 42) for w in words.to_pylist()], np.uint64)

            def frequent(first: np.ndarray, second: np.ndarray) -> np.ndarray:
                place = pair_place(hashed[first], hashed[second], bits)
                return (known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

            before, behind = (lambda new, old: frequent(new, old)), (lambda new, old: frequent(old, new))
            phrases = fm.step(fm.single(), True, before)
            for k in range(3, depth + 1):
                to_left = k % 2 == 0
                phrases = fm.step(phrases, to_left, before if to_left else behind)
                yield from _rows(name, sign, words, phrases)

    return found.mapInArrow(run, "lang string, k int, phrase string, n long")


def summed(counts: DataFrame, least: int) -> DataFrame:
    """Counts over all shards, of phrases that come to `least`."""
    return counts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def frequent(docs: DataFrame, least: int, depth: int, text: str = "text", lang: str = "lang", size: int = SYMBOLS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to `depth` words with f >= least (lang, k, phrase, f), and the words of each language (lang, n)."""
    found = stored(shards(docs, depth, text, lang, size), SHARDS)
    few = stored(summed(short(found), least))
    more = summed(long(found, filter_of(few.filter("k = 2")), depth), least)
    words = found.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("sign")).alias("n"))
    return stored(few.unionByName(more)), words


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases of 2 words or more with the lowest-scoring cut: lang, k, phrase, a, l, r, n, score.

    Both parts of a phrase are as frequent as it is or more, so they are among the phrases. Products are exact decimals of 38 digits.
    """
    first, rest = (phrases.select(F.col("lang").alias(f"_lang{x}"), F.col("phrase").alias(f"_phrase{x}"), F.col("f").alias(x)) for x in ("l", "r"))
    cuts = phrases.filter("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cuts.withColumn("_first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("_rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    met = parts.join(first, (F.col("lang") == F.col("_langl")) & (F.col("_first") == F.col("_phrasel"))).join(rest, (F.col("lang") == F.col("_langr")) & (F.col("_rest") == F.col("_phraser")))
    met = met.join(words.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"))
    exact = lambda c: f"cast({c} AS decimal(18, 0))"
    score = F.expr(f"(cast(1000 AS decimal(4, 0)) * {exact('a')} * cast(n AS decimal(15, 0))) div ({exact('l')} * {exact('r')})")
    lowest = met.groupBy("lang", "k", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), F.col("cut"), F.col("l"), F.col("r"))).alias("_low"))
    return lowest.select("lang", "k", "phrase", "a", "_low.l", "_low.r", "n", "_low.score")


def inside(phrases: DataFrame) -> DataFrame:
    """What lies inside longer phrases: lang, phrase, longest (the highest count of a phrase that holds it)."""
    words = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    starts = lambda size: F.sequence(F.lit(1), F.col("k") - size + 1)
    parts = F.flatten(F.transform(sizes, lambda size: F.transform(starts(size), lambda at: F.array_join(F.slice(words, at, size), " "))))
    return phrases.filter("k >= 3").select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, least: int = 100, depth: int = 5, share: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", size: int = SYMBOLS) -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Letters A-Z count as a-z. Pieces end at `[.,;:!?]` and line ends, words at spaces and tabs; null texts have none, a null
    language is `und`. a is how often a phrase of 2 to `depth` words is in pieces, overlaps included, at least `least`. A
    phrase that lies inside a longer one with at least `share` % of its count is left out. Cut in two parts with counts l and
    r, a phrase scores floor(1000 * a * n / (l * r)), n being all words of the language; its lowest-scoring cut counts, the
    first of equals. Ties: higher a, then smaller phrase by code point. An empty table gives no rows. Repeated rows count as
    often as they are there, and other columns of docs play no part.
    """
    phrases, words = frequent(docs, least, depth, text, lang, size)
    whole = inside(phrases).withColumnsRenamed({"lang": "_lang", "phrase": "_phrase"})
    best = scored(phrases, words).join(whole, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").filter(F.coalesce(F.col("longest") * 100 < F.col("a") * share, F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language first, so that no task gets a whole language
    n = partitions(docs.sparkSession)
    part = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(n)))
    few = part.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_at") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The token-byte incidence matrix of a text has a row for each token and a column for each byte. With A and B for the two
tokenizers, the entries of A * B' are the overlap links: its rows come by Gustavson's rule, each as the sum of those rows
of B' that the row of A names, and a value is the number of bytes that both tokens cover. Where tokens of A and of B both
end, the bytes are cut into groups; the product of the two token-group incidence matrices holds the links between
tokens of one group. Matrices are in compressed rows, made by hand.

A text falls apart into units where white space follows other text. Neither tokenizer lets a token go over such a place,
so both end a token there, and what a unit gives is the same in every text that has it. A task computes the products of a
unit once and keeps them in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import fresh, stored

#: Units that a task keeps; longer ones than this many characters are not kept.
KEPT, KEPT_CHARS = 500_000, 64
#: Entries of a product that are in memory at once, as far as rows go.
BLOCK = 1 << 20
#: Pairs of ids that are sent to every task: those of the highest counts. Others are joined.
PAIRS = 2_000_000
#: Texts, and characters of texts, that are looked at together.
TEXTS, CHARS = 200, 2_000_000
#: Fixed value: the pattern by which byte-level vocabularies of this kind split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "▁"


@dataclass
class Csr:
    """A matrix of zeros and counts by rows: row i has entries at columns[starts[i]:starts[i + 1]]; values None means 1 everywhere."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None

    @property
    def height(self) -> int:
        return len(self.starts) - 1


def incidence(sizes: np.ndarray, width: int) -> Csr:
    """Rows that cover the columns 0 to width - 1 one after the other, each as many as its size."""
    return Csr(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.arange(width, dtype=np.int64), width)


def transposed(m: Csr) -> Csr:
    """The matrix by columns: entries are dealt to their columns in row order."""
    rows = np.repeat(np.arange(m.height, dtype=np.int64), np.diff(m.starts))
    order = np.argsort(m.columns, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    return Csr(starts, rows[order], m.height, None if m.values is None else m.values[order])


def ragged(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the given rows, one row after the other, and how many each row has."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - (ends - sizes), sizes), sizes


def product(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (row, column, value) of a * b by Gustavson's rule, in row order, in blocks of whole rows.

    Row i is the sum of the rows k of b over the entries (i, k) of a: they are laid side by side and equal columns added up.
    A block ends once its rows have `block` entries to add; one row is never split.
    """
    steps = np.concatenate([[0], np.cumsum(b.starts[a.columns + 1] - b.starts[a.columns])])[a.starts]
    first = 0
    while first < a.height:
        last = max(first + 1, int(np.searchsorted(steps, steps[first] + block, "right")) - 1)
        inner = a.columns[a.starts[first] : a.starts[last]]
        rows = np.repeat(np.arange(first, last, dtype=np.int64), np.diff(a.starts[first : last + 1]))
        at, sizes = ragged(b.starts, inner)
        keys = np.repeat(rows, sizes) * b.width + b.columns[at]
        if a.values is None and b.values is None:
            keys.sort()
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            value = np.diff(np.append(new, len(keys)))
        else:
            weight = np.repeat(1 if a.values is None else a.values[a.starts[first] : a.starts[last]], sizes) * (1 if b.values is None else b.values[at])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            value = np.add.reduceat(weight[order], new) if len(new) else weight
        yield keys[new] // b.width, keys[new] % b.width, value
        first = last


@dataclass
class Pair:
    """Two vocabularies: ranks of byte strings of the first, the file's bytes of the second."""

    ranks: dict[bytes, int]
    model: bytes
    n_b: int

    @property
    def bits(self) -> int:
        """Bits of an id pair, a * n_b + b."""
        return ((max(self.ranks.values()) + 1) * self.n_b).bit_length()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(first: str, second: str) -> Pair:
    """Reads a byte-level merge vocabulary (JSON) and a piece model with byte fallback.

    Raises ValueError where one of them is of another kind: ids of the first must follow the order of merges, and no piece of
    the second may hold white space behind another character.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(first, encoding="utf-8") as f:
        spec = json.load(f)
    letter = byte_letters()
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(map(letter.__getitem__, p)): i for p, i in spec["model"]["vocab"].items() if p not in special}
    merged = [ranks[bytes(map(letter.__getitem__, "".join(m.split(" ") if isinstance(m, str) else m)))] for m in spec["model"]["merges"]]
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or len(ranks) != 256 + len(merged) or any(y <= x for x, y in zip(merged, merged[1:])):
        raise ValueError("the first vocabulary isn't one of byte-level merges in the order of ids")
    model = pb.ModelProto()
    with open(second, "rb") as f:
        model.ParseFromString(f.read())
    normal = model.normalizer_spec
    if not normal.add_dummy_prefix or normal.remove_extra_whitespaces or normal.precompiled_charsmap or not model.trainer_spec.byte_fallback:
        raise ValueError("the second vocabulary normalises text or has no byte fallback")
    if any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in model.pieces):
        raise ValueError("a piece goes over the start of a unit")
    normal.add_dummy_prefix = False  # texts come with their space
    return Pair(ranks, model.SerializeToString(), len(model.pieces))


class Lists:
    """Lists of numbers of different lengths in one growing array."""

    def __init__(self, kind: type = np.int64) -> None:
        self.data, self.starts, self.n, self.rows = np.empty(1 << 16, kind), np.zeros(1 << 16, np.int64), 0, 0

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        while self.rows + len(sizes) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.data[self.n : self.n + len(data)] = data
        self.starts[self.rows + 1 : self.rows + len(sizes) + 1] = self.n + np.cumsum(sizes)
        self.n, self.rows = self.n + len(data), self.rows + len(sizes)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, sizes = ragged(self.starts, rows)
        return self.data[at], sizes


class Tokens:
    """Both tokenizations of strings: ids and sizes in bytes."""

    def __init__(self, pair: Pair) -> None:
        import sentencepiece
        import tiktoken

        self.n_b = pair.n_b
        self.first = tiktoken.Encoding("first", pat_str=SPLIT, mergeable_ranks=pair.ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pair.model)
        out = [b""] * (max(pair.ranks.values()) + 1)
        for b, i in pair.ranks.items():
            out[i] = b
        other = [bytes([int(p[1:-1], 16)]) if self.second.is_byte(i) else p.replace(MARK, " ").encode() for i in range(self.n_b) for p in [self.second.id_to_piece(i)]]
        self.bytes = pa.array(out, pa.binary()), pa.array(other, pa.binary())
        self.sizes = tuple(np.array([len(x) for x in b], np.int64) for b in (out, other))

    def __call__(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.first.encode_ordinary(t) for t in texts], self.second.encode(texts, num_threads=1)

    def joined(self, which: int, ids: np.ndarray) -> memoryview:
        """The bytes of ids one after the other."""
        taken = self.bytes[which].take(pa.array(ids))
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int32)[[taken.offset, taken.offset + len(taken)]]
        return memoryview(data).cast("B")[ends[0] : ends[1]] if data is not None else memoryview(b"")


@dataclass
class Block:
    """Both tokenizations of some strings laid one behind the other, with the groups that their tokens are in."""

    ids: tuple[np.ndarray, np.ndarray]
    #: How many tokens each string has.
    counts: tuple[np.ndarray, np.ndarray]
    sizes: tuple[np.ndarray, np.ndarray]
    #: The group of each token, and how many groups there are.
    groups: tuple[np.ndarray, np.ndarray]
    n_groups: int

    def links(self, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Overlap links (token of A, token of B, common bytes): A * B'."""
        width = int(self.sizes[0].sum())
        return product(incidence(self.sizes[0], width), transposed(incidence(self.sizes[1], width)), block)

    def shared(self, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links of tokens in one group (token of A, token of B, 1)."""
        a, b = (incidence(np.bincount(g, minlength=self.n_groups), len(g)) for g in self.groups)
        return product(transposed(a), b, block)


def tokenized(tokens: Tokens, texts: list[str]) -> tuple[Block, np.ndarray]:
    """The block of some strings, and of each whether both tokenizations give its bytes back. Those that aren't given back have no tokens in the block."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    found, counts, fits = [], [], np.ones(len(texts), bool)
    for which, lists in enumerate(tokens(texts)):
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for x in lists for i in x), np.int64, int(n.sum()))
        size = np.concatenate([[0], np.cumsum(tokens.sizes[which][ids])])
        ends = np.concatenate([[0], np.cumsum(n)])
        bytes_of = tokens.joined(which, ids)
        if bytes_of != b"".join(data):
            for i, d in enumerate(data):
                fits[i] &= bytes_of[size[ends[i]] : size[ends[i + 1]]] == d
        found.append(ids)
        counts.append(n)
    if not fits.all():
        found = [ids[np.repeat(fits, n)] for ids, n in zip(found, counts)]
        counts = [n * fits for n in counts]
    sizes = [tokens.sizes[k][ids] for k, ids in enumerate(found)]
    ends = [np.cumsum(s) for s in sizes]
    cut = np.zeros(int(ends[0][-1]) + 1 if len(ends[0]) else 1, np.uint8)
    for e in ends:
        cut[e] += 1
    before = np.cumsum(cut == 2)  # groups that end at a byte or before it
    groups = [before[e - s] for e, s in zip(ends, sizes)]
    return Block((found[0], found[1]), (counts[0], counts[1]), (sizes[0], sizes[1]), (groups[0], groups[1]), int(before[-1])), fits


def in_order(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of each group, those of A before those of B: id, tokenizer (0 or 1), and whether it is the last of its kind in its group."""
    n = [np.bincount(g, minlength=block.n_groups) for g in block.groups]
    earlier = [np.cumsum(x) - x for x in n]
    ids, kind, last = (np.empty(len(block.ids[0]) + len(block.ids[1]), t) for t in (np.int64, np.int8, bool))
    for k in (0, 1):
        g = block.groups[k]
        at = np.arange(len(g)) + (earlier[1][g] if k == 0 else earlier[0][g] + n[0][g])
        ids[at], kind[at], last[at] = block.ids[k], k, np.append(g[1:] != g[:-1], True)[: len(g)]
    return ids, kind, last


class Aligner:
    """Alignments of texts by units; keeps those of units in a bounded table."""

    _units = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    #: White space other than spaces and line ends: the first tokenizer joins it with neighbours, so such texts are units as a whole.
    _odd = re.compile(r"[^\S \n]")

    def __init__(self, pair: Pair) -> None:
        self.tokens, self.bits, self.n_b = Tokens(pair), pair.bits, pair.n_b
        n = max(len(self.tokens.sizes[0]), self.n_b)
        # "12," and so on: what an id looks like inside its group and at the end of a part
        self.text = pa.array([f"{i}{c}".encode() for c in ",|;" for i in range(n)], pa.binary())
        self.ids = n
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.facts = Lists()  # of each unit: fits, tokens of A, tokens of B, groups, links, links of shared groups
        self.pairs, self.times, self.letters = Lists(), Lists(np.int32), Lists(np.uint8)

    def learn(self, units: list[str]) -> None:
        """Computes what units give; they get the next numbers in turn."""
        for start, end in _parts([len(u) for u in units], 1 << 30, BLOCK):
            self._learn(units[start:end])

    def _learn(self, units: list[str]) -> None:
        block, fits = tokenized(self.tokens, units)
        n_a, n_b = block.counts
        unit = np.repeat(np.arange(len(units)), n_a)
        n_groups = np.zeros(len(units), np.int64)
        first = np.concatenate([[True], block.groups[0][1:] != block.groups[0][:-1]]) if len(unit) else np.zeros(0, bool)
        np.add.at(n_groups, unit[first], 1)
        of_group = [np.bincount(g, minlength=block.n_groups) for g in block.groups]
        n_shared, n_links = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        np.add.at(n_shared, unit[first], of_group[0] * of_group[1])
        keys: list[np.ndarray] = []
        for i, j, _ in block.links():
            at = unit[i]
            n_links += np.bincount(at, minlength=len(units))
            keys.append(np.stack([at, block.ids[0][i] * self.n_b + block.ids[1][j]]))
        at, key = np.concatenate(keys, 1) if keys else np.zeros((2, 0), np.int64)
        order = np.lexsort((key, at))
        at, key = at[order], key[order]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (key[1:] != key[:-1])])) if len(at) else np.zeros(0, np.int64)
        per_unit = np.bincount(at[new], minlength=len(units))
        self.pairs.add(key[new], per_unit)
        self.times.add(np.diff(np.append(new, len(at))), per_unit)
        ids, kind, last = in_order(block)
        text = self.text.take(pa.array(ids + np.where(last, 1 + kind, 0).astype(np.int64) * self.ids))
        _, offsets, data = text.buffers()
        ends = np.frombuffer(offsets, np.int32)[: len(text) + 1].astype(np.int64)
        tokens = np.concatenate([[0], np.cumsum(n_a + n_b)])
        self.letters.add(np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None and len(text) else np.zeros(0, np.uint8), np.diff(ends[tokens]))
        self.facts.add(np.stack([fits, n_a, n_b, n_groups, n_links, n_shared], 1).ravel(), np.full(len(units), 6))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the units of texts, how many each text has, and how many units are kept; those beyond are forgotten by `forget`."""
        if len(self.known) >= KEPT:
            self.clear()
        units = [([" " + t] if self._odd.search(t) else self._units.findall(" " + t)) if t else [] for t in texts]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        flat = [u for x in units for u in x]
        missing = list(dict.fromkeys(u for u in flat if u not in self.known))
        short, long = [u for u in missing if len(u) <= KEPT_CHARS], [u for u in missing if len(u) > KEPT_CHARS]
        n = len(self.known)
        self.learn(short)
        self.known.update(zip(short, range(n, n + len(short))))
        kept = len(self.known)
        self.learn(long)
        own = dict(zip(long, range(kept, kept + len(long))))
        get = self.known.__getitem__
        found = np.fromiter((get(u) for u in flat), np.int64, len(flat)) if not own else np.fromiter((own[u] if u in own else get(u) for u in flat), np.int64, len(flat))
        return found, sizes, kept

    def forget(self, kept: int) -> None:
        for x in (self.facts, self.pairs, self.times, self.letters):
            x.rows, x.n = kept, int(x.starts[kept])

    def batch(self, texts: list[str]) -> dict[str, list]:
        """The columns of `align` for some texts, with the id pairs of each."""
        found, sizes, kept = self.numbers(texts)
        text = np.repeat(np.arange(len(texts)), sizes)
        facts = self.facts.data[: self.facts.n].reshape(-1, 6)[found]
        fits = np.ones(len(texts), bool)
        fits[text[facts[:, 0] == 0]] = False
        alive = fits[text]
        found, text, facts = found[alive], text[alive], facts[alive]
        sums = [np.bincount(text, facts[:, k], len(texts)).astype(np.int64) for k in range(1, 6)]
        letters, n_letters = self.letters.of(found)
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, n_letters, len(texts)).astype(np.int64))])
        data = memoryview(letters)
        digests = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends.tolist(), ends[1:].tolist())]
        # a unit once for each text, with how often it is there; then the pairs of all units of a text, added up
        both, often = np.unique((text << 40) | found, return_counts=True)
        unit, text = both & ((1 << 40) - 1), both >> 40
        key, n = self.pairs.of(unit)
        times = self.times.of(unit)[0].astype(np.int64) * np.repeat(often, n)
        key, times = added((np.repeat(text, n) << self.bits) | key, times)
        of_text = np.searchsorted(key, np.arange(len(texts) + 1) << self.bits)
        key &= (1 << self.bits) - 1
        pairs = [(key[x:y].tobytes(), times[x:y].astype(np.int32).tobytes()) for x, y in zip(of_text.tolist(), of_text[1:].tolist())]
        self.forget(kept)
        return {"n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "n_shared": sums[4], "sha": digests, "pairs": pairs}


def added(key: np.ndarray, amount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its amounts."""
    if not len(key):
        return key, amount
    room = 63 - int(key.max()).bit_length()
    if len(key) < 1 << max(0, room):  # sorting numbers that carry their place is several times as fast as sorting places
        packed = (key << room) | np.arange(len(key))
        packed.sort()
        order = packed & ((1 << room) - 1)
    else:
        order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(amount[order], new)


def _parts(sizes: list[int], n: int, room: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most n items whose sizes come to at most room, or of one item."""
    start, held = 0, 0
    for i, s in enumerate(sizes):
        if i > start and (held + s > room or i - start >= n):
            yield start, i
            start, held = i, 0
        held += s
    if start < len(sizes):
        yield start, len(sizes)


def _packed(keys: bytes, width: int) -> bytes:
    """Increasing numbers as differences, all lowest bytes first, then the next; long runs of zeros that compress well."""
    x = np.diff(np.frombuffer(keys, np.int64), prepend=0).astype(f"<u{width}")
    return x.view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel(), dtype=np.int64)


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(shared) -> Aligner:
    """The aligner of a broadcast pair of vocabularies; a worker that is used again keeps its units."""
    key = hash((len(shared.value.ranks), shared.value.model))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(shared.value)
    return _ALIGNERS[key]


def align(docs: DataFrame, pair: Pair, text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """Adds to each row n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256 (string) and n_shared (long).

    Texts are encoded with a space before them, strings of special tokens as plain text. n_links: token pairs whose bytes
    overlap; n_shared: token pairs of one group. An id pair's count is in how many rows of the whole table it is linked;
    count_sum adds it up over a row's links, and n_best is how many of them have the highest count of their first id.
    groups_sha256 is that of the groups as `a1,a2|b1;a3|b2,b3`.

    Texts null, empty, or which one of the vocabularies doesn't give back (those with U+2581) have no tokens: zeros and ''.
    Repeated rows count as often as they are there. New columns replace columns of the same names.
    The counts of the `pairs` most frequent id pairs are sent to every task; links of others are joined with theirs.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pair)  # two vocabulary files, however large the input
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
    kept = [c for c in docs.columns if c.lower() not in new and c != text]
    if text not in docs.columns or text.lower() in new:
        raise ValueError(f"no column {text}, or its name is that of a result")
    row, keys, times = fresh([*docs.columns, *new], "_row", "_keys", "_times")
    width = 4 if pair.bits <= 32 else 8
    facts = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _aligner(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept) + 1).to_pylist()]
            for start, end in _parts([len(t) for t in texts], TEXTS, CHARS):
                got = machine.batch(texts[start:end])
                columns = [*batch.slice(start, end - start).columns[:-1], *[pa.array(got[c], pa.int64()) for c in facts], pa.array(got["sha"], pa.string())]
                columns += [pa.array([_packed(k, width) for k, _ in got["pairs"]], pa.binary()), pa.array([t for _, t in got["pairs"]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, row, *facts, "groups_sha256", keys, times])

    base = docs.select(*kept, F.monotonically_increasing_id().alias(row), text)
    schema = base.drop(text).schema
    for c in facts:
        schema = schema.add(c, "long")
    # what was found in a text is written once; row numbers are fixed from here on
    found = stored(base.mapInArrow(run, schema.add("groups_sha256", "string").add(keys, "binary").add(times, "binary")))

    counted = stored(_counts(found.select(keys), width).groupBy("key").agg(F.sum("n").alias("n")))
    best = Window.partitionBy(F.floor(F.col("key") / F.lit(pair.n_b)))  # as many rows as the second vocabulary has, at most
    counted = counted.withColumn("best", F.col("n") == F.max("n").over(best))
    n_pairs = counted.count()
    head = counted if n_pairs <= pairs else counted.filter(F.col("n") >= _least(counted, pairs))
    table = head.select("key", "n", "best").toArrow()  # `pairs` rows at most
    order = np.argsort(table["key"].to_numpy())
    sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy(zero_copy_only=False)[order] for c in ("key", "n", "best")))

    def look(with_rest: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n, best = sent.value
            for batch in batches:
                out: list[tuple] = []
                rest: list[tuple] = []
                for at, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    k, t = _unpacked(k, width), np.frombuffer(t, np.int32).astype(np.int64)
                    place = np.searchsorted(known, k)
                    hit = place < len(known)
                    hit[hit] = known[place[hit]] == k[hit]
                    place, own = place[hit], t[hit]
                    out.append((at, int(own[best[place]].sum()), int((own * n[place]).sum())))
                    if with_rest:
                        rest += [(at, int(x), int(y)) for x, y in zip(k[~hit], t[~hit])]
                kind = ("row", "key", "times") if with_rest else ("row", "n_best", "count_sum")
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*(rest if with_rest else out)) if (rest if with_rest else out) else [[]] * 3)], names=list(kind))

        return run

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = next(look(False)(iter([batch.select([row, keys, times])])))
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names) if name not in (keys, times)), *done.columns[1:]], names=[*(x for x in batch.schema.names if x not in (keys, times)), "n_best", "count_sum"])

    done = found.mapInArrow(both, found.drop(keys, times).schema.add("n_best", "long").add("count_sum", "long"))
    if n_pairs > pairs:
        links = found.select(row, keys, times).mapInArrow(look(True), "row long, key long, times long")
        tail = counted.filter(F.col("n") < _least(counted, pairs))
        sums = links.join(tail, "key").groupBy(F.col("row").alias("_r")).agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("_b"), F.sum(F.col("times") * F.col("n")).alias("_s"))
        done = done.join(sums, F.col(row) == F.col("_r"), "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_s", F.lit(0))})
    return done.select(*kept, *new)


def _counts(keys: DataFrame, width: int) -> DataFrame:
    """How often each number is in the packed lists of one column: added up within a task before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known, n, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            return added(np.concatenate([known, key]), np.concatenate([n, count]))

        for batch in batches:
            for k in batch.column(0).to_pylist():
                held.append(_unpacked(k, width))
                size += len(held[-1])
                if size > BLOCK:
                    known, n = merged()
                    held, size = [], 0
                    if len(known) > 4 * BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["key", "n"])
                        known, n = known[:0], n[:0]
        if held:
            known, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["key", "n"])

    return keys.mapInArrow(run, "key long, n long")


def _least(counted: DataFrame, pairs: int) -> int:
    """The least count so that at most `pairs` id pairs have it or more: by the powers of 2 ** (1 / 8) that counts lie between."""
    level = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for x in sorted(counted.groupBy(level.alias("level")).agg(F.min("n").alias("n"), F.count("*").alias("m")).collect(), reverse=True):  # 8 rows a doubling
        held += x["m"]
        if held > pairs:
            break
        least = x["n"]
    return least if least is not None else 1 << 62


LINK = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a_at", "b_at", "a_id", "b_id", "n_bytes")])


def links(docs: DataFrame, pair: Pair, text: str = "text", shared_groups: bool = False) -> DataFrame:
    """The links of each row's text, one row each: the columns of docs but the text, then a_at, b_at (places of the tokens from 0 on), a_id, b_id and n_bytes.

    Overlap links, with the number of common bytes; with shared_groups, those of tokens in one group, with n_bytes 0 where
    they don't overlap. Texts without tokens have none. A row of a product is in memory at once, never all links of a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    new = [f.name for f in LINK]
    kept = [c for c in docs.columns if c.lower() not in new and c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _aligner(shared).tokens
        for batch in batches:
            for at, t in enumerate(batch.column(len(kept)).to_pylist()):
                if not t:
                    continue
                block, _ = tokenized(tokens, [" " + t])
                starts = [np.cumsum(s) - s for s in block.sizes]
                for i, j, n in block.shared() if shared_groups else block.links():
                    if shared_groups:
                        n = np.maximum(0, np.minimum(starts[0][i] + block.sizes[0][i], starts[1][j] + block.sizes[1][j]) - np.maximum(starts[0][i], starts[1][j]))
                    own = [c.take(pa.array(np.full(len(i), at))) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, pa.int32()) for x in (i, j, block.ids[0][i], block.ids[1][j], n)]], names=[*kept, *new])

    return docs.select(*kept, text).mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *LINK.fields]))

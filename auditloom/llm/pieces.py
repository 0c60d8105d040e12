"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is the composition of three machines, compiled once on the driver from the vocabulary file:

* the normaliser: a space becomes the marker U+2581, and one marker is put before a text that isn't empty;
* the pieces: an arc of weight ARC for every piece, and byte fallback arcs for every character that is no piece, of weight
  BYTE for each byte;
* the pair machine: its state is the piece read last, and an arc from piece a to piece b weighs 0 if merging the
  characters of a + b gives back a and b, and infinity otherwise.

A path of finite weight from start to end of a text is its merge segmentation, so the shortest path in the tropical
semiring (weights are added along a path, the least sum wins) is the encoding that the vocabulary's merge order defines.
No piece continues over the start of a run of markers, so the lattice of a text falls apart into words there, and
shortest paths of words are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Words (in each of two generations) and pairs that a task keeps.
KEPT = 250_000
#: Longer words are not kept.
KEPT_CHARS = 48
#: Weights of the arcs of a piece and of a fallback byte.
ARC, BYTE = 1.0, 8.0


@dataclass
class Vocabulary:
    """Pieces by rank. pieces: text to (id, score); bytes: ids of the 256 byte pieces; out: what each id decodes to."""

    pieces: dict[str, tuple[int, float]]
    bytes: list[int]
    out: list[bytes]
    #: The marker before a text.
    prefix: bool = True


def load(path: str) -> Vocabulary:
    """Reads the vocabulary of a model file; raises ValueError if it has no byte fallback, isn't built by merges or normalises text."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only merge vocabularies with the identity normaliser are supported")
    pieces, low, out = {}, [-1] * 256, []
    for i, p in enumerate(model.pieces):
        if p.type == 1 or p.type == 4:
            pieces[p.piece] = (i, p.score)
            out.append(p.piece.replace(MARK, " ").encode())
        elif p.type == 6:
            low[int(p.piece[1:-1], 16)] = i
            out.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            out.append(b" \xe2\x81\x87 " if p.type == 2 else b"")
    if min(low) < 0:
        raise ValueError("the vocabulary lacks byte pieces")
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece goes over the start of a word")
    return Vocabulary(pieces, low, out, model.normalizer_spec.add_dummy_prefix)


@dataclass
class Transducer:
    """Composes the compiled machines with each input."""

    vocabulary: Vocabulary
    _longest: int = 0
    _reach: dict = field(default_factory=dict)  # sizes of pieces by their first three characters, longest first
    _old: dict = field(default_factory=dict)
    _pairs: dict = field(default_factory=dict)
    _made: dict = field(default_factory=dict)
    _words: dict = field(default_factory=dict)
    _split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __post_init__(self) -> None:
        self._longest = max(map(len, self.vocabulary.pieces))
        sizes: dict[str, set[int]] = {}
        for p in self.vocabulary.pieces:
            if len(p) > 2:
                sizes.setdefault(p[:3], {2, 1}).add(len(p))
        self._reach = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}

    def merged(self, text: str) -> list[str]:
        """The segmentation of a text by merging: best score first, leftmost among equals. Waiting merges are in a heap."""
        pieces = self.vocabulary.pieces
        parts: list[str | None] = list(text)
        before, behind = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        waiting: list[tuple[float, int, str]] = []

        def wait(i: int) -> None:
            j = behind[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts) and (p := pieces.get(both := parts[i] + parts[j])) is not None:
                heappush(waiting, (-p[1], i, both))

        for i in range(len(parts) - 1):
            wait(i)
        while waiting:
            _, i, both = heappop(waiting)
            j = behind[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
                continue  # a part has been merged meanwhile
            parts[i], parts[j] = both, None
            behind[i] = behind[j]
            if behind[j] < len(parts):
                before[behind[j]] = i
            wait(before[i])
            wait(i)
        return [p for p in parts if p is not None]

    def made(self, piece: str) -> tuple[float, str, str] | None:
        """The rank at which merging makes a piece, and the two parts it joins last; None if merging never makes it."""
        found = self._made.get(piece, 0)
        if found == 0:
            found = None
            if len(piece) == 1:
                found = (-1, "", "")
            elif piece in self.vocabulary.pieces and self.merged(piece) == [piece]:
                parts, last = list(piece), ("", "")
                while len(parts) > 1:
                    scores = [self.vocabulary.pieces.get(x + y, (0, -math.inf))[1] for x, y in zip(parts, parts[1:])]
                    i = scores.index(max(scores))
                    last = (parts[i], parts[i + 1])
                    parts[i : i + 2] = [last[0] + last[1]]
                found = (-self.vocabulary.pieces[piece][1], *last)
            self._made[piece] = found
        return found

    def linked(self, a: str, b: str) -> bool:
        """Whether the pair machine's arc from a to b has finite weight.

        Undoes the merges of both pieces, latest first, and looks for a merge over the border that would have come before.
        """
        found = self._pairs.get((a, b))
        if found is not None:
            return found
        key, limit, pieces = (a, b), math.inf, self.vocabulary.pieces
        made_a, made_b = self.made(a), self.made(b)
        found = made_a is not None and made_b is not None
        while found:
            over = pieces.get(a + b)
            if over is not None and -over[1] < limit:
                found = False
            elif made_a[0] > made_b[0]:
                limit, a = made_a[0], made_a[2]
                made_a = self.made(a)
            elif made_b[0] < 0:
                break
            else:
                limit, b = made_b[0] + 1, made_b[1]
                made_b = self.made(b)
        if len(self._pairs) >= KEPT:
            self._pairs.clear()
        self._pairs[key] = found
        return found

    def path(self, word: str) -> bytes:
        """Ids (little-endian 32-bit) on the shortest path through a word's lattice.

        States are places in the word with the piece that ends there. Only states of
        finite weight go on; as every prefix has one merge segmentation, each place has one such state, and the first arc of
        finite weight into it is on the shortest path. So the lattice is unfolded as it is searched: from the place that was
        reached last, longest arcs first, and no place twice. A run of markers alone has pieces of equal rank, where pairs
        don't decide: it goes through the merges themselves.
        """
        if len(word) > 1 and word[:2] == MARK * 2:
            n = len(word) - len(word.lstrip(MARK))
            if n > 1:
                return self._spaced(word, n)
        pieces, pairs, reach, n = self.vocabulary.pieces, self._pairs, self._reach, len(word)
        last: list[str | None] = [None] * (n + 1)  # of each place the piece on the shortest path to it, with the path's weight
        weights = [0.0] * (n + 1)
        last[0] = ""
        trail, arcs = [0], [iter(reach.get(word[:3], (2, 1)))]
        while trail and last[n] is None:
            at = trail[-1]
            before, so_far = last[at], weights[at]
            for size in arcs[-1]:
                end = at + size
                if end > n or last[end] is not None:
                    continue
                piece = word[at:end]
                known = piece in pieces
                if known or size == 1:
                    if before:
                        link = pairs.get((before, piece))
                        if not (self.linked(before, piece) if link is None else link):
                            continue
                    last[end], weights[end] = piece, so_far + (ARC if known else BYTE * len(piece.encode("utf-8", "surrogatepass")))
                    trail.append(end)
                    arcs.append(iter(reach.get(word[end : end + 3], (2, 1))))
                    break
            else:
                trail.pop()
                arcs.pop()
        if last[n] is None:  # no finite path: merge as the vocabulary says
            return self._ids(self.merged(word))
        parts, at = [], n
        while at:
            parts.append(last[at])
            at -= len(last[at])
        return self._ids(parts[::-1])

    def _spaced(self, word: str, n: int) -> bytes:
        """A run of n markers before a word: the last marker belongs to the word if the word's own path takes it."""
        if n > 4 * self._longest:  # whole longest runs are cut off first, as the leftmost merges do
            whole = (n - 2 * self._longest) // self._longest
            return self._ids([MARK * self._longest] * whole if MARK * self._longest in self.vocabulary.pieces else list(MARK * whole * self._longest)) + self._spaced(word[whole * self._longest :], n - whole * self._longest)
        rest = word[n - 1 :]
        if len(rest) == 1:
            return self._ids(self.merged(word))
        path = self._ids_of(self.path(rest))
        if path[0] == MARK:  # the word doesn't take it
            return self._ids([*self.merged(MARK * n), *path[1:]])
        return self._ids([*self.merged(MARK * (n - 1)), *path])

    def _ids_of(self, ids: bytes) -> list[str]:
        out, text = self.vocabulary.out, []
        pending = b""
        for i in array("i", ids):
            pending += out[i]
            try:
                text.append(pending.decode().replace(" ", MARK))
                pending = b""
            except UnicodeDecodeError:
                pass
        return text

    def _ids(self, parts: list[str]) -> bytes:
        pieces, low, ids = self.vocabulary.pieces, self.vocabulary.bytes, array("i")
        for p in parts:
            if p in pieces:
                ids.append(pieces[p][0])
            else:
                ids.extend(low[b] for b in p.encode("utf-8", "surrogatepass"))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; none for an empty text."""
        if not text:
            return b""
        words = self._split.findall((MARK if self.vocabulary.prefix else "") + text.replace(" ", MARK))
        try:
            return b"".join(map(self._words.__getitem__, words))
        except KeyError:
            pass
        out, kept = [], self._words
        for w in words:
            ids = kept.get(w)
            if ids is None:
                ids = self._old.get(w) or self.path(w)  # words in use move on to the new table
                if len(w) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        self._old = kept
                        kept = self._words = {}
                    kept[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes one after the other, without the marker before the text; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.vocabulary.out.__getitem__, array("i", ids))).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.prefix and text[:1] == " " else text


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds n_tokens (long), ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text back) and ids (array of int) to each row.

    A null or empty text has no ids, n_tokens 0, and round_trip true. A text that holds U+2581 itself decodes to spaces
    there, so its round_trip is false. Repeated rows and ties are encoded alike, row by row; nothing is shuffled. The
    new columns replace columns of the same names. with_ids=False leaves out ids.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # one vocabulary file, however large the input
    new = ["n_tokens", "ids_sha256", "round_trip", *["ids"] * with_ids]
    kept = [c for c in docs.columns if c.lower() not in new]
    at = kept.index(text) if text in kept else None
    if at is None:
        raise ValueError(f"no column {text}, or its name is that of a result")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                n, sha, back, ids = [], [], [], []
                for t in batch.column(at).to_pylist():
                    t = t or ""
                    found = machine.encode(t)
                    n.append(len(found) // 4)
                    sha.append(hashlib.sha256(found).hexdigest())
                    back.append(machine.decode(found) == t)
                    if with_ids:
                        ids.append(found)
                columns = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.bool_())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *new])

    schema = docs.select(*kept).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("round_trip", "boolean"), *[("ids", T.ArrayType(T.IntegerType()))] * with_ids):
        schema = schema.add(name, kind)
    return docs.select(*kept).mapInArrow(run, schema)


_MACHINES: dict[int, Transducer] = {}


def _machine(shared) -> Transducer:
    """The transducer of a broadcast vocabulary; a worker that is used again keeps its tables."""
    vocabulary = shared.value
    key = hash((len(vocabulary.pieces), tuple(vocabulary.pieces.items())))
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Transducer(vocabulary)
    return _MACHINES[key]

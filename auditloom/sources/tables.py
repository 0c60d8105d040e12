"""Reading and writing: tables with fixed schemas, versioned manifests, file inventories, reports."""

from __future__ import annotations

import _hashlib
import ctypes
import struct
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the event log and of a manifest; nothing is inferred.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "labels": "doc_id long, quality int, toxic int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}
MANIFEST = T.StructType().add("version", "string").add("records", T.ArrayType(T.StructType().add("id", "string").add("sha256", "string").add("bytes", "long")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset and all runs in this process (tests), a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by its fixed schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def read_manifest(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Records of the JSON manifests at a path, and what is wrong: files that don't parse, other versions, records without an id or digest."""
    schema = T.StructType([*MANIFEST.fields, T.StructField("_broken", T.StringType())])
    files = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("file", F.input_file_name())
    records = files.filter(F.col("_broken").isNull() & (F.col("version") == version)).select("file", F.explode("records").alias("r")).select("file", "r.*")
    bad = F.when(F.col("id").isNull(), "no_id").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_digest")
    whole = F.when(F.col("_broken").isNotNull(), "unreadable").when(~F.col("version").eqNullSafe(F.lit(version)), "wrong_version")
    issues = files.select("file", F.lit(None).cast("string").alias("id"), whole.alias("issue")).unionByName(records.select("file", "id", bad.alias("issue"))).filter("issue IS NOT NULL")
    return records.filter(bad.isNull()), issues


#: Bytes of a file that is hashed as one row, of what a task is given of a larger one, and of a row of that.
WHOLE, PIECE, CHUNK = 64 << 20, 256 << 20, 256 << 10
#: Ends of names of files that Spark's reader of lines would decompress.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".lzo", ".lzo_deflate", ".snappy", ".zst", ".zstd", ".passthrough")
BOM = b"\xef\xbb\xbf"
_CHUNKS = "path string, size long, start long, seq long, n long, head binary, data binary"


class Digest:
    """SHA-256 whose state can be kept as bytes and taken up again; hashlib's can't be, so this calls the library behind it."""

    def __init__(self, state: bytes = b"") -> None:
        self.library = ctypes.CDLL(getattr(_hashlib, "__file__", None))
        for f, kinds in (("SHA256_Init", [ctypes.c_void_p]), ("SHA256_Update", [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]), ("SHA256_Final", [ctypes.c_char_p, ctypes.c_void_p])):
            getattr(self.library, f).argtypes = kinds
        self.n, self.context = 0, ctypes.create_string_buffer(128)
        if state:
            (self.n,) = struct.unpack_from("<q", state)
            self.context.raw = state[8:]
        else:
            self.library.SHA256_Init(self.context)

    def update(self, data: bytes) -> Digest:
        self.library.SHA256_Update(self.context, data, len(data))
        self.n += len(data)
        return self

    def state(self) -> bytes:
        return struct.pack("<q", self.n) + self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.library.SHA256_Final(out, self.context)
        return out.raw.hex()


def _packed() -> Column:
    """Whether a file's name says that it is compressed."""
    return reduce(lambda a, b: a | b, (F.col("_metadata.file_path").endswith(x) for x in PACKED))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split's lines as rows of CHUNK bytes, numbered. A line end goes before every line but a file's first, as whether one follows the last isn't known here."""
    names = ["path", "size", "start", "seq", "n", "head", "data"]
    split, seq, held, rows = None, 0, bytearray(), []

    def put(least: int) -> None:
        nonlocal seq, held
        at = 0
        while len(held) - at >= least:
            data = bytes(held[at : at + CHUNK])
            rows.append((*split, seq, len(data), data[:8], data))
            at, seq = at + len(data), seq + 1
        held = held[at:]

    def taken() -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)
        rows.clear()
        return batch

    for batch in batches:
        path, size, start, value = batch.columns
        same = pc.and_(pc.equal(path[1:], path[:-1]), pc.equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
        turn = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist(), batch.num_rows]
        for a, b in zip(turn, turn[1:]):
            if a == b:
                continue
            of = (path[a].as_py(), size[a].as_py(), start[a].as_py())
            if of != split:
                put(1)
                split, seq, ahead = of, 0, b"" if of[2] == 0 else b"\n"
            for i in range(a, b, 1000):
                some = value.slice(i, min(1000, b - i))
                held += ahead
                held += pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), b"\n")[0].as_buffer()
                ahead = b"\n"
                put(CHUNK)
                if len(rows) >= 64:
                    yield taken()
    put(1)
    yield taken()


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of each file's digest (start -1, comes first) after the bytes behind it."""
    of, digest, rows = None, None, []
    for batch in batches:
        for i in range(batch.num_rows):
            path, size, start, _, data = (c[i].as_py() for c in batch.columns)
            if start < 0:
                if digest:
                    rows.append((*of, -1, 0, digest.state()))
                of, digest = (path, size), Digest(data)
            else:
                digest.update(data)
    if digest:
        rows.append((*of, -1, 0, digest.state()))
    kinds = [pa.string(), *[pa.int64()] * 3, pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["path", "size", "start", "seq", "data"])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole files: one byte less than the file has is the line end behind its last line."""
    for batch in batches:
        out = []
        for path, size, state in zip(*(c.to_pylist() for c in batch.columns)):
            digest = Digest(state)
            if digest.n == size - 1:
                digest.update(b"\n")
            if digest.n != size:
                raise ValueError(f"{path}: {digest.n} bytes were read of {size}")
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["file", "sha256"])


def large_digests(spark: SparkSession, path: str, whole: int, files: int, longest: int) -> DataFrame:
    """(file, sha256, head) of the files above `whole` bytes at a path; head is a file's first 8 bytes. files: their number, longest: the largest one's bytes.

    SHA-256 goes over the bytes in order, so a file's pieces are hashed one after the other: each round gives a task one
    piece of a file and the state of its digest, and keeps the new state. The files are read in splits, as lines of bytes,
    and kept in the shared folder by piece.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = lines.filter((meta("file_size") > whole) & ~_packed()).select(meta("file_path").alias("path"), meta("file_size").alias("size"), meta("file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    kept = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    lines.mapInArrow(_chunks, _CHUNKS).withColumn("piece", F.floor(F.col("start") / PIECE)).write.option("compression", "none").partitionBy("piece").parquet(kept)
    pieces = spark.read.schema(f"{_CHUNKS}, piece long").parquet(kept)
    # the reader of lines leaves out a byte order mark, and the line end behind the last line is not in the pieces
    facts = pieces.groupBy("path", "size").agg(F.sum("n").alias("n"), F.min_by("head", F.struct("start", "seq")).alias("head")).withColumn("marked", F.col("size") - F.col("n") >= 3).checkpoint()
    state = F.when(F.col("marked"), F.lit(Digest().update(BOM).state())).otherwise(F.lit(Digest().state()))
    columns = ["path", "size", "start", "seq", "data"]
    states = facts.select("path", "size", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("seq"), state.alias("data"))
    tasks = min(4 * files, max(files, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for piece in range(longest // PIECE + 1):
        dealt = states.unionByName(pieces.filter(F.col("piece") == piece).select(*columns)).repartition(tasks, "path").sortWithinPartitions("path", "start", "seq")
        states = dealt.mapInArrow(_continued, "path string, size long, start long, seq long, data binary").checkpoint()
    digests = states.select("path", "size", "data").mapInArrow(_ended, "file string, sha256 string")
    return digests.join(facts.select(F.col("path").alias("file"), F.when(F.col("marked"), F.concat(F.lit(BOM), "head")).otherwise(F.col("head")).alias("head")), "file")


def artifact_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, digest, size and kind (by the first bytes) of every file at a path; Spark's readers give none for an empty file.

    Files of up to WHOLE bytes are hashed as one row each, larger ones of any size in pieces. Files whose names say that they
    are compressed are always one row each, so they are to be below 2 GB.
    """

    def kind(head: Column) -> Column:
        head = F.hex(F.substring(head, 1, 8))
        return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("50415231"), "parquet").when(head.startswith("25504446"), "pdf").otherwise("other").alias("kind")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name, size = F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes")
    most = min(WHOLE, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    packed = _packed()
    small = lambda rows: rows.select(name, F.sha2("content", 256).alias("sha256"), size, kind(F.col("content")))
    # filters on size and path are applied to the list of files, so the bytes of others aren't read
    large = files.filter((F.col("length") > most) & ~packed)
    n, longest = large.agg(F.count("*"), F.max("length")).first()
    if not n:
        return small(files)
    digests = large_digests(spark, path, most, n, longest)
    told = large.select(F.col("_metadata.file_path").alias("file"), name, size).join(digests, "file").select("name", "sha256", "bytes", kind(F.col("head")))
    out = small(files.filter(F.col("length") <= most)).unionByName(told)
    packed_large = files.filter((F.col("length") > most) & packed)
    return out if packed_large.select("path").isEmpty() else out.unionByName(small(packed_large))


def write_manifests(records: DataFrame, path: str, version: str) -> None:
    """Manifests as JSON files, one for each value of the column `file`. records: file, id, sha256, bytes; a file's records make one JSON object, so they are to be bounded."""
    whole = records.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("id", "sha256", "bytes"))).alias("records")).withColumn("version", F.lit(version))
    whole.repartition(F.col("file")).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def write_changed_csv(changed: DataFrame, path: str) -> None:
    """Changed cases as CSV files with a header."""
    changed.write.mode("overwrite").option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """One table for each part of a report, a partition for each run."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")

"""Canonical JSON, digests and seals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.sources.tables import shared_dir


def canonical_json(text: Column) -> Column:
    """JSON with keys sorted at every depth and no white space; null if the text is none."""
    return F.to_json(F.try_parse_json(text))


def canonical_export(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Canonical JSON and its digest for each row."""
    return rows.select(key, canonical_json(F.col(payload)).alias("canonical_json")).withColumn("sha256", F.sha2("canonical_json", 256))


def verify_digests(exported: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """Rows whose claimed digest (key, claimed) is not that of their content, or that lack one."""
    j = exported.join(claimed, key, "left")
    return j.filter(~F.col("sha256").eqNullSafe(F.col("claimed"))).select(key, F.when(F.col("claimed").isNull(), "absent").otherwise("mismatch").alias("issue"))


#: Neighbours under one node of a seal's tree, and its levels; keys up to FAN ** LEVELS make one root.
FAN, LEVELS = 1024, 4


def seal(digests: DataFrame, key: str) -> DataFrame:
    """One digest over all rows in order of an integer key: the root of a tree whose nodes cover FAN neighbouring keys or nodes each, so that no task holds more than that, but for rows that repeat a key."""
    level = digests.select(F.col(key).cast("long").alias("at"), F.col("sha256").alias("d"), F.lit(1).cast("long").alias("n"))
    for _ in range(LEVELS):
        level = level.groupBy(F.floor(F.col("at") / F.lit(FAN)).alias("at")).agg(_chained("at", "d").alias("d"), F.sum("n").alias("n"))
    return level.agg(_chained("at", "d").alias("seal"), F.sum("n").alias("n"))


def _chained(key: str, digest: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, digest))), lambda x: x[digest]), ""), 256)


def signed(rows: DataFrame, key: str, payload: str, secret: bytes) -> DataFrame:
    """(key, signature): the keyed SHA-256 signature of each row's payload; null for a null payload."""
    block = secret if len(secret) <= 64 else hashlib.sha256(secret).digest()
    inner, outer = (bytes(b ^ x for b in block.ljust(64, b"\0")) for x in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.col(payload).cast("binary")), 256)
    return rows.select(key, F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256).alias("signature"))


def forbidden_keys(rows: DataFrame, key: str, payload: str, banned: list[str]) -> DataFrame:
    """Banned keys of JSON objects at any depth, in arrays too, with their paths. Nested values are texts between rounds, one for each depth that there is."""
    shared_dir(rows.sparkSession)
    level = rows.select(key, F.lit("$").alias("path"), F.col(payload).alias("json"))
    found = None
    while True:
        inside = level.select(key, "path", F.explode(F.map_entries(F.from_json("json", "map<string,string>"))).alias("e")).select(key, F.concat("path", F.lit("."), "e.key").alias("path"), F.col("e.key").alias("k"), F.col("e.value").alias("json"))
        listed = level.filter(F.ltrim("json").startswith("[")).select(key, "path", F.posexplode(F.from_json("json", "array<string>")).alias("i", "json")).select(key, F.concat("path", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("path"), F.lit(None).cast("string").alias("k"), "json")
        kids = inside.unionByName(listed).checkpoint()
        hits = kids.filter(F.col("k").isin(banned)).select(key, "path")
        found = hits if found is None else found.unionByName(hits)
        level = kids.filter(F.ltrim("json").rlike(r"^[\[{]")).select(key, "path", "json")
        if level.isEmpty():
            return found

"""Shards through fixed virtual slots, with DataFrame functions only.

Every record hashes into one of ``slots`` virtual slots by its text, so equal texts share a slot. Bytes are summed per slot, and
a stored slot-to-shard map says where each slot lies. The map is a versioned table (``MAP``): version 1 deals slots out in turn;
``rebalance`` reads version n, edits it until no move of one slot from the fullest shard to the emptiest one makes them more
alike, and stores version n + 1. An edit moves few slots, the others' records stay where they are. Old versions stay readable.

A text whose copies outweigh a shard's fair share (there can be at most as many such texts as shards) cannot stay together; its
copies hash by doc_id over all slots instead. Where rows of one such text and one doc_id (or none) still do, they are dealt by their
row number, as nothing else tells them apart. Both lists are part of each version, so the map table alone finds a record again,
but for those last. What is once on a list stays on it.

What reaches the driver is a few numbers per slot. Places inside a shard come from counts per (slot, salt), with a salt for every
``part_rows`` records of a slot, dealt by row number, and a place inside each: no window holds a whole shard or slot.

Edge cases: null text counts as no bytes plus one; null doc_id is allowed; repeated rows are placed each; other columns are not
read; an empty table gives no rows and leaves the map as it is but for its version.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspark.llm.common import text_bytes
from voxelspark.plans.iterate import Scratch

#: A row per slot (kind ``slot``: key is the slot), per text that is dealt by doc_id (kind ``hot``: key is its hash) and per text and doc_id
#: whose rows are dealt by number (kind ``same``: key is the hash of both).
MAP = "kind string, key long, shard int, version int"


def edited(sizes: list[int], shard_of: list[int], shards: int) -> list[int]:
    """The map after moves that even out ``sizes`` (bytes per slot) over shards; constant-size work on the driver."""
    where = list(shard_of)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, (size, shard) in enumerate(zip(sizes, where, strict=True)):
        load[shard] += size
        held[shard].append((size, slot))
    while True:
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        fits = [x for x in held[full] if 0 < x[0] < gap]
        if not fits:
            return where
        best = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))  # halves the gap as nearly as one slot can
        held[full].remove(best)
        held[empty].append(best)
        load[full], load[empty] = load[full] - best[0], load[empty] + best[0]
        where[best[1]] = empty


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int], list[tuple[str, int]]]:
    """(version, shard of each slot, (kind, hash) of what is dealt apart); the latest version if none is named, version 0 if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return 0, [], []
    table = spark.read.schema(MAP).parquet(path)
    rows = (table.where(F.col("version") == version) if version else table.where(F.col("version") == (table.agg(F.max("version")).first()[0] or 0))).collect()  # a row per slot
    if not rows:
        raise ValueError(f"no version {version} at {path}")
    return rows[0]["version"], [r["shard"] for r in sorted(rows, key=lambda r: r["key"]) if r["kind"] == "slot"], sorted((r["kind"], r["key"]) for r in rows if r["kind"] != "slot")


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int], apart: list[tuple[str, int]]) -> None:
    """Stores a version; one that is there already is never overwritten."""
    dealt = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(shard_of)), "array<int>")).alias("k", "shard")).select(F.lit("slot").alias("kind"), F.col("k").cast("long").alias("key"), "shard")
    for kind in ("hot", "same"):
        keys = hashes(apart, kind)
        dealt = dealt.unionByName(spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<long>")).alias("key")).select(F.lit(kind).alias("kind"), "key", F.lit(None).cast("int").alias("shard")))
    dealt.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, h: hash of the text, row: its number) of every row. To be settled before it is read twice."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    return docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text_bytes(text_col)).alias("text_crc32"), F.xxhash64(F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("row"))


def hashes(apart: list[tuple[str, int]], kind: str) -> list[int]:
    return [k for of, k in apart if of == kind]


def slot_of(apart: list[tuple[str, int]], slots: int):
    """Column: a record's virtual slot."""
    hot, same = hashes(apart, "hot"), hashes(apart, "same")
    both = F.xxhash64("doc_id", "h")
    key = F.when(F.col("h").isin(hot), F.when(both.isin(same), F.xxhash64("h", "row")).otherwise(both) if same else both).otherwise(F.col("h")) if hot else F.col("h")
    return F.pmod(key, F.lit(slots)).cast("int")


def rebalance(records: DataFrame, path: str, shards: int = 16, slots: int = 4096) -> int:
    """Edits the latest map for ``records`` (of ``measured``) and stores it as the next version, whose number is returned.

    Without a map at ``path``, version 1 (``slots`` slots in turn) is stored first. ``shards`` may differ from the last version's:
    a shard that is new starts empty, slots of one that is gone are dealt to the others in turn.
    """
    spark = records.sparkSession
    version, shard_of, apart = read_map(spark, path)
    if not version:
        version, shard_of = 1, [s % shards for s in range(slots)]
        write_map(spark, path, 1, shard_of, apart)
    shard_of, slots = [s if s < shards else k % shards for k, s in enumerate(shard_of)], len(shard_of)

    def bytes_of(apart) -> list[int]:
        out = [0] * slots
        for r in records.groupBy(slot_of(apart, slots).alias("k")).agg(F.sum("size").alias("b")).collect():  # at most one row per slot
            out[r["k"]] = r["b"]
        return out

    sizes = bytes_of(apart)
    fair = sum(sizes) / shards
    for kind, key in (("hot", F.col("h")), ("same", F.xxhash64("doc_id", "h"))):
        heavy = [s for s, b in enumerate(sizes) if b > fair]  # fewer than shards
        if not heavy:
            break
        some = records.where(slot_of(apart, slots).isin(heavy) & ~key.isin(hashes(apart, kind)))
        if kind == "same":
            some = some.where(F.col("h").isin(hashes(apart, "hot")))
        new = some.groupBy(key.alias("key")).agg(F.sum("size").alias("b")).where(F.col("b") > fair).collect()  # fewer than shards
        if new:
            apart = sorted({*apart, *((kind, r["key"]) for r in new)})
            sizes = bytes_of(apart)
    write_map(spark, path, version + 1, edited(sizes, shard_of, shards), apart)
    return version + 1


def placed(records: DataFrame, path: str, version: int | None = None, part_rows: int = 200_000) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) of ``records`` (of ``measured``) by a stored map; slot is the place in the shard."""
    spark = records.sparkSession
    _, shard_of, apart = read_map(spark, path, version)
    rows = records.withColumn("virtual_slot", slot_of(apart, len(shard_of)))
    salts = [1] * len(shard_of)
    for r in rows.groupBy("virtual_slot").count().collect():  # at most one row per slot
        salts[r["virtual_slot"]] += r["count"] // part_rows
    told = F.from_json(F.lit(json.dumps(list(zip(shard_of, salts, strict=True)))), "array<array<int>>")
    slot = spark.range(1).select(F.posexplode(told).alias("virtual_slot", "t")).select("virtual_slot", F.col("t")[0].alias("shard"), F.col("t")[1].alias("salts"))
    rows = rows.join(F.broadcast(slot), "virtual_slot").withColumn("salt", F.pmod(F.xxhash64("row", F.lit("salt")), F.col("salts")).cast("int"))  # a row per slot
    per = rows.groupBy("shard", "virtual_slot", "salt").agg(F.count(F.lit(1)).alias("n"))  # at most a row per slot and part_rows records
    before = Window.partitionBy("shard").orderBy("virtual_slot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    layout = per.select("virtual_slot", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("virtual_slot", "salt").orderBy("doc_id", "text_crc32", "size", "row")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(layout, ["virtual_slot", "salt"]).select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("at")).alias("slot"))


def shard_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, slots: int = 4096, part_rows: int = 200_000) -> DataFrame:
    """All records placed by the map at ``path`` after it was rebalanced for them."""
    records = Scratch(docs.sparkSession, "slots").settle(measured(docs, id_col, text_col))
    return placed(records, path, rebalance(records, path, shards, slots), part_rows)


def op10_slots(spark, sf_dir: str) -> DataFrame:
    records = shard_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{Scratch(spark, 'slotmap').root}/map")
    return records.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")

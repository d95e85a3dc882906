"""User functions per block, and blocks that arrive in a folder, each processed once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxelspark.functions.roi import Roi, halo_blocks
from voxelspark.operators.voxels import clip01, to_byte
from voxelspark.plans.iterate import bounded_batches
from voxelspark.sources.schema import AXES, POS


@dataclass(frozen=True)
class BlockInput:
    """A volume that block functions read: voxels (z, y, x and values), world units per voxel, and the context they need of it."""

    voxels: DataFrame
    context: tuple[int, int, int] = (0, 0, 0)
    voxel_size: tuple[int, int, int] = (1, 1, 1)


def map_blocks(inputs: Mapping[str, BlockInput], fn: Callable[[dict[str, pa.Table], Roi], pa.Table], schema: str, block: tuple[int, int, int], voxel_size: tuple[int, int, int] = (1, 1, 1), as_bytes: Sequence[str] = ()) -> DataFrame:
    """(z, y, x, columns of ``schema``): ``fn`` applied per block of world units to what each input has in it and in its context.

    fn gets an Arrow table per input (z, y, x in that input's voxels, its values, ``owned``: in the block itself), an empty one where
    an input has nothing there, and the block's box in world units. It returns z, y, x in voxels of ``voxel_size`` and the columns of
    ``schema``; rows outside the block go. A voxel belongs to the block that holds its lower corner. Columns named by ``as_bytes``
    are taken as 0..1 and come as 0..255. Blocks in which no input has a voxel are left out, and so are voxels without a position.
    All inputs go through one shuffle; a block's box bounds a group.
    """
    if not inputs:
        raise ValueError("no input")
    spark = next(iter(inputs.values())).voxels.sparkSession
    bounded_batches(spark)
    keys, corners, rows = [f"block_{a}" for a in AXES], [f"_w{a}" for a in AXES], None
    for k, one in enumerate(inputs.values()):
        there = F.col("z").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
        values = [c for c in one.voxels.columns if c not in POS]
        placed = one.voxels.where(there).select(F.struct(*POS, *values).alias(f"_{k}"), *((F.col(a).cast("long") * s).alias(w) for a, w, s in zip(AXES, corners, one.voxel_size, strict=True)))
        halo = halo_blocks(placed, block, one.context, corners).select(*(F.col(f"block_{w}").alias(b) for w, b in zip(corners, keys, strict=True)), F.lit(k).alias("_input"), "owned", f"_{k}")
        rows = halo if rows is None else rows.unionByName(halo, allowMissingColumns=True)
    out = f"z int, y int, x int, {schema}"
    arrow, names = to_arrow_schema(StructType.fromDDL(out)), list(inputs)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        box = Roi(tuple(k.as_py() * b for k, b in zip(key, block, strict=True)), tuple(block))
        read = {}
        for k, name in enumerate(names):
            part = t.filter(pc.equal(t.column("_input"), k)).select([f"_{k}", "owned"]).combine_chunks()
            voxels = part.column(f"_{k}")
            read[name] = pa.table({f.name: pc.struct_field(voxels, f.name) for f in voxels.type} | {"owned": part.column("owned")})
        if not any(pc.any(r.column("owned")).as_py() for r in read.values()):
            return arrow.empty_table()
        found = fn(read, box).select(arrow.names)
        inside = None
        for a, s, low, high in zip(AXES, voxel_size, box.off, box.end, strict=True):
            at = pc.multiply(found.column(a).cast(pa.int64()), s)
            test = pc.and_(pc.greater_equal(at, low), pc.less(at, high))
            inside = test if inside is None else pc.and_(inside, test)
        return found.filter(inside).cast(arrow)

    found = rows.groupBy(*keys).applyInArrow(run, out)
    return found.withColumns({c: to_byte(clip01(F.col(c))) for c in as_bytes}) if as_bytes else found


def process_new_blocks(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("block_id",)) -> None:
    """Takes the blocks that are new in ``source`` through ``transform`` into ``sink`` and stops.

    The checkpoint is the log of finished blocks. A batch that is run again after a failure overwrites its own blocks only.
    """

    def write(batch: DataFrame, _: int) -> None:
        transform(batch).write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(sink)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def block_summary(batch: DataFrame, label: str = "label") -> DataFrame:
    return batch.groupBy("block_id").agg(F.count(F.lit(1)).alias("voxels"), F.countDistinct(label).alias("labels"))

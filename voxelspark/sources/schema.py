"""Schemas of the engine's tables. Positions are voxel indices in z, y, x order; ids are signed 64-bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


VOXELS = _struct(("volume", T.StringType()), ("z", _INT), ("y", _INT), ("x", _INT), ("label", _LONG))
NODES = _struct(("id", _LONG), ("center_z", _DOUBLE), ("center_y", _DOUBLE), ("center_x", _DOUBLE))
EDGES = _struct(("u", _LONG), ("v", _LONG), ("merge_score", _DOUBLE), ("agglomerated", T.BooleanType()))
MERGES = _struct(("a", _LONG), ("b", _LONG), ("c", _LONG), ("score", _DOUBLE), ("round", _INT))
LUT = _struct(("threshold", T.DecimalType(6, 4)), ("fragment", _LONG), ("segment", _LONG))
META = _struct(("volume", T.StringType()), ("off", T.ArrayType(_LONG)), ("voxel_size", T.ArrayType(_LONG)), ("shape", T.ArrayType(_LONG)))
AXES = ("z", "y", "x")
POS = list(AXES)


def checked_ids(df: DataFrame, col: str) -> DataFrame:
    """Ids that came as unsigned 64-bit decimals become signed ones; those above 2**63 - 1 raise when read."""
    as_number = F.col(col).cast("decimal(20,0)")
    fits = as_number.between(F.lit(0), F.lit(2**63 - 1).cast("decimal(20,0)"))
    return df.withColumn(col, F.when(fits | as_number.isNull(), as_number.cast("long")).otherwise(F.raise_error(F.lit(f"{col}: id out of range")).cast("long")))

"""Spark types of the nested records."""

from pyspark.sql import types as T

SHIFT = T.StructType(
    [
        T.StructField("atom_index", T.IntegerType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("shift_ppm", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("attached_atom_index", T.IntegerType()),
        T.StructField("assignment_group", T.StringType()),
        T.StructField("multiplicity", T.StringType()),
        T.StructField("coupling_hz", T.DoubleType()),
        T.StructField("neighbor_count", T.IntegerType()),
    ]
)

CONSENSUS_SHIFT = T.StructType(
    SHIFT.fields
    + [
        T.StructField("contributing_engines", T.ArrayType(T.StringType())),
        T.StructField("std_ppm", T.DoubleType()),
    ]
)

ENGINE_RESULT = T.StructType(
    [
        T.StructField("engine", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("shifts", T.ArrayType(SHIFT)),
    ]
)

CONSENSUS_RESULT = T.StructType(
    [
        T.StructField("shifts", T.ArrayType(CONSENSUS_SHIFT)),
        T.StructField("weights_used", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

PREDICTION_RESPONSE = T.StructType(
    [
        T.StructField("mol_id", T.LongType()),
        T.StructField("canonical_smiles", T.StringType()),
        T.StructField("atom_symbols", T.ArrayType(T.StringType())),
        T.StructField("engines", T.MapType(T.StringType(), ENGINE_RESULT)),
        T.StructField("consensus", CONSENSUS_RESULT),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("smiles", T.StringType()),
        T.StructField("engines", T.ArrayType(T.StringType())),
        T.StructField("mode", T.StringType()),
        T.StructField("nucleus", T.StringType()),
        T.StructField("conformer_strategy", T.StringType()),
        T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

REFERENCE_DOCUMENT = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))

REFERENCE_SIGMA = T.StructType(
    [
        T.StructField("functional", T.StringType()),
        T.StructField("basis", T.StringType()),
        T.StructField("nucleus", T.StringType()),
        T.StructField("sigma", T.DoubleType()),
    ]
)

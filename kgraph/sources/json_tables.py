"""JSON tables: arrays of records as files, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Records of JSON files that hold one array each, or, with ``lines``, one record a line; a schema saves the pass that
    finds one. Files of lines are split among tasks, an array is one task's."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def write_json(df: DataFrame, path: str) -> None:
    """Files that hold one array of records each, null members left out, as partitions finish: no task sees more
    than its own records, and a reader takes the folder as one table."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    def arrays(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        empty = True
        for b in batches:
            if not b.num_rows:
                continue
            marks = pa.array(["[" if empty else ","] + [","] * (b.num_rows - 1))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, b.column(0), "")], names=["value"])
            empty = False
        if not empty:
            yield pa.RecordBatch.from_pydict({"value": ["]"]})

    rows.mapInArrow(arrays, "value string").write.mode("overwrite").text(path)

"""Parquet profiles from the footers alone, read in the workers, a file a row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "file string, row_group int, rows long, bytes long, column_name string, has_stats boolean, nulls long, low string, high string, low_number double, high_number double"


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row group and leaf column of the files under path."""
    files = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string")

    def run(frames):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in frames:
            for file in pdf["file"]:
                disk, name = fs.FileSystem.from_uri(file)
                meta, out = pq.read_metadata(disk.open_input_file(name)), []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        col = group.column(c)
                        s = col.statistics
                        has = s is not None and s.has_min_max
                        numeric = has and isinstance(s.min, (int, float)) and not isinstance(s.min, bool)
                        out.append((file, g, group.num_rows, group.total_byte_size, col.path_in_schema, has, s.null_count if s is not None and s.has_null_count else None, str(s.min) if has else None, str(s.max) if has else None, float(s.min) if numeric else None, float(s.max) if numeric else None))
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])
                frame["nulls"] = frame["nulls"].astype("Int64")
                yield frame

    return files.repartition(max(1, files.count())).mapInPandas(run, ROWS)


def footer_profile(groups: DataFrame) -> DataFrame:
    """Least, most and nulls of each column; blank where a row group has no statistics."""
    whole = F.every("has_stats")
    numeric = F.max("low_number").isNotNull()
    low = F.when(numeric, (F.min("low_number") + 0.0).cast("string")).otherwise(F.min("low"))
    high = F.when(numeric, (F.max("high_number") + 0.0).cast("string")).otherwise(F.max("high"))
    return groups.groupBy("column_name").agg(F.when(whole, low).alias("low"), F.when(whole, high).alias("high"), F.when(F.every(F.col("nulls").isNotNull()), F.sum("nulls")).alias("nulls"))


def leading_groups(groups: DataFrame, rows: int = 200, most_bytes: int = 256 << 20) -> DataFrame:
    """The row groups of each file that hold its first rows, up to a declared size."""
    from pyspark.sql import Window

    own = groups.select("file", "row_group", "rows", "bytes").distinct()
    w = Window.partitionBy("file").orderBy("row_group")
    own = own.withColumns({"before": F.sum("rows").over(w) - F.col("rows"), "size": F.sum("bytes").over(w)})
    return own.where((F.col("before") < rows) & (F.col("size") <= most_bytes)).select("file", "row_group", "rows")

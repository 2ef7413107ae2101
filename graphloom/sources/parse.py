"""The parse step: the one place where Python runs on rows, a file at a time in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import PARSED
from .parse_java import parse_java
from .parse_python import parse_python

#: Files whose symbols a task hands on at once.
BATCH_FILES = 256

PARSERS = {"python": parse_python, "java": parse_java}


def parse_files(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, rel_path, lang, the columns of `carry`, error and the columns of PARSED; files of other languages are left out.

    `error` is true for files that can't be parsed; indexing drops them. No content fails the step.
    """
    kept = ["key", "rel_path", "lang", *carry]
    types = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"{types}, error boolean, {PARSED}"
    one = F.lit(None).cast(StructType.fromDDL(schema)).alias("row")
    fields = files.sparkSession.range(0).select(one).select("row.*").toArrow().schema
    none = dict.fromkeys(fields.names) | {"package": ""}

    def run(batches):
        for batch in (batch.slice(at, BATCH_FILES) for batch in batches for at in range(0, batch.num_rows, BATCH_FILES)):
            rows = []
            for row in batch.to_pylist():
                out = PARSERS[row["lang"]](row.pop("content"))
                rows.append({**none, **row, "error": out is None, **(out or {})})
            yield pa.RecordBatch.from_pylist(rows, fields)

    known = files.where(F.col("lang").isin(list(PARSERS))).select(*kept, "content")
    return known.mapInArrow(run, schema)


def parsed_only(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("error")).drop("error")

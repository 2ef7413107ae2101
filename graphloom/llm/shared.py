"""Helpers that several operators share."""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import cut, ensure_checkpoint_dir, tidy  # noqa: F401

#: The words of every contract here: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


@contextlib.contextmanager
def steady(spark: SparkSession):
    """Actions inside are planned once. Loops of many small joins would else keep a driver thread for each of their
    exchanges; what adaptive plans do about skew, Spread does there."""
    name = "spark.sql.adaptive.enabled"
    old = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


#: Rows that are worth a partition of their own, and rows above which a result stays as it is dealt.
GATHER, FEW = 50_000, 200_000


def gathered(df: DataFrame) -> DataFrame:
    """df checkpointed; where it has few rows (narrow ones, for loops over links, labels and sums), in as few partitions as they are worth.

    What is done with one partition needs no exchange. A loop over few rows would else run a task for each shuffle partition at each of
    its steps, and what Spark notes of a task (5 KB in an event log, and the driver's memory) would exceed the rows by far."""
    done = cut(df)
    parts = done._jdf.toJavaRDD().getNumPartitions()
    if parts == 1:
        return done
    n = done.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()
    worth = max(1, -(-n // GATHER))
    return done if n > FEW or worth >= parts else cut(done.coalesce(worth))


def sized_anew(df: DataFrame) -> DataFrame:
    """df gathered, without the size that Spark has estimated for it. A checkpoint keeps that estimate, which is the product of
    the sizes for a join: in a loop of joins its digits multiply with each round, up to numbers of megabytes that the driver
    computes with for seconds. This is createDataFrame(df.rdd, df.schema) without the way through Python."""
    spark, done = df.sparkSession, gathered(df)
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_index(values: DataFrame, col: str, to: str) -> DataFrame:
    """Distinct values of `col` numbered from 0 in code-point order, null last, without a global window.

    Range partitions are numbered on their own and shifted by the counts of those before them.
    """
    spark = values.sparkSession
    distinct = values.select(F.col(col)).distinct()
    ranged = gathered(
        distinct.repartitionByRange(shuffle_width(spark), F.col(col).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    )
    shift = {}
    total = 0
    for part, n in sorted(map(tuple, ranged.groupBy("_part").count().collect())):  # a row for each partition at most
        shift[part] = total
        total += n
    if not shift:
        return ranged.select(col, F.lit(0).cast("long").alias(to))
    base = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair])
    order = Window.partitionBy("_part").orderBy(F.col(col).asc_nulls_last())
    return ranged.select(col, (base[F.col("_part")] + F.row_number().over(order) - 1).cast("long").alias(to))


def collected(rows: DataFrame) -> pd.DataFrame:
    """Rows of bounded number on the driver, as Arrow batches; texts become categories."""
    import pyarrow as pa

    out = rows.toArrow().to_pandas(strings_to_categorical=True, self_destruct=True)
    pa.default_memory_pool().release_unused()
    return out


def byte_words(text: str | None) -> list[bytes]:
    """bytes.split() cuts at the six ASCII white-space characters and no others."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finishing mixer on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(_MUL[0])
    x ^= x >> np.uint64(29)
    x *= np.uint64(_MUL[1])
    x ^= x >> np.uint64(32)
    return x


class WordCodes(dict):
    """Codes for words over many batches: a word keeps its code until the table is emptied.

    The table is a cache with a fixed number of entries; emptying it never changes a result.
    """

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit, self.words = limit, []

    def __missing__(self, word):
        code = self[word] = len(self.words)
        self.words.append(word)
        return code

    def encode(self, words: list) -> tuple[np.ndarray, int]:
        """Codes of the words, and the first code that is new since the last call (0 after emptying)."""
        if len(self.words) > self.limit:
            self.clear()
            self.words = []
        known = len(self.words)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)), known


def flat_words(texts) -> tuple[list[bytes], np.ndarray]:
    """All words of a batch of texts one after the other, and the number of words of each text."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = byte_words(t)
        counts[i] = len(w)
        words += w
    return words, counts


def char_grams(words: list[str], n: int, left: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every n-gram of each word between its marks: (grams x n matrix, index of the word of each gram)."""
    joined = "".join([left + w + right for w in words])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words)) + len(left) + len(right)
    per = np.maximum(lengths - n + 1, 0)
    owner = np.repeat(np.arange(len(words)), per)
    starts = np.cumsum(lengths) - lengths
    first = np.cumsum(per) - per
    at = np.arange(per.sum()) - first[owner] + starts[owner]
    return np.stack([points[at + k] for k in range(n)], axis=1) if len(at) else np.zeros((0, n), np.uint32), owner


def hash_rows(grams: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    h = np.full(len(grams), seed & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(grams.shape[1]):
        h = mix64(h ^ (grams[:, k].astype(np.uint64) + np.uint64(_MUL[2])))
    return h


def arrow_slices(record_batches, max_chars: int = 2_000_000, text: str = "text"):
    """Arrow batches cut into slices of bounded total text, so that long documents don't pile up as Python objects."""
    import pyarrow.compute as pc

    for batch in record_batches:
        sizes = np.asarray(pc.fill_null(pc.utf8_length(batch[text]), 0).to_numpy(zero_copy_only=False), np.int64)
        part = sizes.cumsum() // max_chars
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


#: Rows of an Arrow batch, where the session allows more: a batch of texts is held by the JVM and by Python.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over batches of few rows; the session's own setting is lowered for that, as texts may be long."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInPandas over slices of bounded text; longs stay exact where some are null."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T.StructType.fromDDL(schema)

    def arrow(record_batches):
        types = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
        made = to_arrow_schema(spark_schema)
        for out in run(x.to_pandas(types_mapper=types.get) for x in arrow_slices(record_batches)):
            yield pa.RecordBatch.from_pandas(out, schema=made, preserve_index=False)

    return map_arrow(df, arrow, spark_schema)


def arrow_parts(record_batches, text: str = "text"):
    """Slices of bounded text with their texts as a list; all columns stay as they are."""
    for own in arrow_slices(record_batches, text=text):
        yield own, own[text].to_pylist()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have."""
    out = []
    for name in names:
        while name in df.columns or name in out:
            name = "_" + name
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row; equal rows have equal ones. Maps, which Spark doesn't hash, count by their
    sorted entries, or, where they lie inside other values, by their JSON. Of n rows some n * n / 2^65 pairs that differ may
    share a hash (none to be expected under 10^9 rows); their rows count as equal then."""
    cols = []
    for field, c in zip(docs.schema.fields, own_columns(docs)):
        kind = field.dataType
        if isinstance(kind, T.MapType) and not _holds_map(kind.keyType) and not _holds_map(kind.valueType):
            c = F.array_sort(F.map_entries(c))
        elif _holds_map(kind):
            c = F.to_json(F.struct(c.alias("value")))
        cols.append(c)
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


#: Sides of a join with more rows than this are not broadcast; rows of one key that a task of a spread join gets.
SMALL, SPREAD = 200_000, 256


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """rows, marked for broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= most else rows


class Spread:
    """Joins `many` to sides with one row for each key, where a key of many rows is dealt to several tasks.

    The keys with more than `most` rows are counted first; rows of theirs get a salt from a hash of the row, and the
    side's row is copied to each salt. There are at most 1 / most as many such keys as rows.
    """

    def __init__(self, many: DataFrame, key: str, most: int = SPREAD):
        self.key = key
        self.parts, self.salt = fresh(many, "parts", "salt")
        often = gathered(many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(self.parts)).where(F.col(self.parts) > 1))
        n = often.count()
        self.often = (F.broadcast(often) if n <= SMALL else often) if n else None
        if n:
            salt = F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col(self.parts)), F.lit(0)).alias(self.salt)
            many = many.join(self.often, key, "left").select(*many.columns, salt)
        self.many = many

    def join(self, side: DataFrame, how: str = "inner") -> DataFrame:
        if self.often is None:
            return self.many.join(side, self.key, how)
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(self.parts), F.lit(1)).cast("long") - 1)).alias(self.salt)
        copied = side.join(self.often, self.key, "left").select(*side.columns, salts)
        # a broadcast of the many rows would bring the copies of a side's row, and so its matches, back into one task
        return self.many.join(copied.hint("merge"), [self.key, self.salt], how).drop(self.salt)

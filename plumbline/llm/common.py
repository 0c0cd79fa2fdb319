"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the characters 9 to 13.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (a test) gets a temporary folder; on a cluster that is an error, as the executors
    would not see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths of the tables written inside each open scratch() block, the innermost last.
_scratch: list[list[str]] = []


def stored(df: DataFrame, name: str, *, lasting: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and return a read of it.

    Cuts the lineage; unlike cached blocks, the files outlive a lost executor. lasting: scratch() leaves the table alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch and not lasting:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that operators have stored inside it.

    A result must have been written before the end: operators return plans that still read those tables.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing will read again."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_repeats(rows: DataFrame, counted: DataFrame, key: str, *, hot: int = 1000) -> DataFrame:
    """rows joined to counted (one row a key, with `copies`: how many rows have it), whatever share of rows a key holds.

    Keys that more than 1 in `hot` rows have are joined by a broadcast: there are fewer than `hot` of them. The others
    are joined by a shuffle that rows of hot keys don't enter. Both inputs should be stored tables; they are read twice.
    """
    limit = rows.count() / hot
    often = F.broadcast(counted.where(F.col("copies") > limit))
    rest = rows.join(often.select(key), key, "left_anti").join(counted.where(F.col("copies") <= limit), key)
    return rows.join(often, key).unionByName(rest)


def marks(places: Column) -> Column:
    """Binary string of ones at the sorted, distinct places and zeros between: marked() reads it in constant time."""
    gap = lambda p, i: F.concat(F.repeat(F.lit("0"), (p - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1).cast("int")), F.lit("1"))
    return F.array_join(F.transform(places, gap), "").cast("binary")


def marked(flags: Column, place: Column) -> Column:
    """Whether marks() has a one at a place."""
    return F.substring(flags, place + 1, F.lit(1)) == F.lit(b"1")


def let(value: Column, body) -> Column:
    """body(x) where x is value, evaluated once for the row.

    Inside a lambda a captured expression would be evaluated for each element.
    """
    return F.transform(F.array(value), body)[0]


def named(**fields: Column) -> Column:
    """A struct whose names also hold inside lambdas, where Spark may trim aliases."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def count_of(text: Column, others: str) -> Column:
    """Characters of text left when runs that match others are removed."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), others, "")).cast("long")


def row_key(*columns: str) -> Column:
    """64 bits that stand for a row, also where its id is null or not unique."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def agreed(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under internal names: other columns can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(own) for own, source in names.items()])

"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Stands in for a null document id inside the engine: no id is greater, so a null id never wins a tie.
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the session names in spark.checkpoint.dir.

    Where it names none, a temporary one is set on a single machine (master local); elsewhere executors
    could not see it, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievestone-checkpoint-"))
    return context.getCheckpointDir()


#: Folders that cut() wrote since the last call of forget(), oldest first.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder and cuts its lineage."""
    shared_folder(df.sparkSession)
    done = df.checkpoint()
    file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _written.append(file.get())
    return done


def written() -> list[str]:
    """Takes note of what cut() wrote so far."""
    return list(_written)


def forget(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders of tables that nothing reads any more."""
    for name in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written[:] = [f for f in _written if f not in set(folders)]


def n_words(text) -> "F.Column":
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_or_last(column) -> "F.Column":
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def last_to_null(column) -> "F.Column":
    return F.when(column != NO_ID, column)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

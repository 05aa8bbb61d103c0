"""What several operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a session within one process gets a temporary folder; on a cluster that is an error, since each
    machine would write to a disk of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quireflow-"))
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there.

    Spark deletes the files of a result that is no longer referenced where spark.cleaner.referenceTracking.cleanCheckpoints
    is set; otherwise they stay, like the tables below fresh_dir(), until the folder is cleared.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes of a batch that a Python worker receives at once.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


_held: dict = {}


def held(name: str, make=dict):
    """What a Python worker keeps from task to task under a name; work under another name gives it back first."""
    if name not in _held:
        _held.clear()
        gc.collect()
        _held[name] = make()
    return _held[name]


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose texts Python workers are to receive in batches of bounded size."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def shielded(docs: DataFrame, *needed: str):
    """docs with all but the needed columns renamed, so that none clashes with a working column, and what undoes it."""
    prefix = "_c"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "c"
    columns = docs.columns
    names = {c: c if c in needed else f"{prefix}{k}" for k, c in enumerate(columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    plain = docs.select([quoted(c).alias(names[c]) for c in columns])
    return plain, lambda df: df.select([F.col(names[c]).alias(c) for c in columns])


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def row_hash(df: DataFrame, *skipped: str) -> list:
    """Two 64-bit hashes of a whole row (maps left out), which know it again when its table is read once more.

    Unlike a number that a scan gives, they do not depend on how files are split among tasks, which changes with the
    number of live executors. Rows that are equal in all columns have the same.
    """
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.name not in skipped]
    return [F.xxhash64(F.lit(seed), *[c.isNull() for c in quoted], *quoted) for seed in (11, 12)]


def one_of_each(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows, with one of those that share a _h1 and _h2 in repeated, and all others."""
    if repeated.isEmpty():
        return rows
    keys = ["_h1", "_h2"]
    again = rows.join(repeated.select(*keys), keys, "left_semi").dropDuplicates(keys)
    return rows.join(repeated.select(*keys), keys, "left_anti").unionByName(again)

"""What the operators share: the shared folder, reading tables, and defined row handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator whose contract names words.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster gets an error, because a
    machine-local folder would be invisible to the other executors.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="strandline-"))
    return spark.conf.get("spark.checkpoint.dir")


class Stored:
    """A table written to the shared folder: lineage ends there, and lost executors cost a re-read."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files once no later plan reads them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str, *used: Stored) -> DataFrame:
    """``df``, written to the shared folder, so that the tables it was made from can go."""
    out = Stored(df, name).df
    for stored in used:
        stored.drop()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % folds

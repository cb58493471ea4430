"""Small helpers shared by the operators: word rules, columns, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of these separate words (ASCII white space only).
SPACES = r"[\x20\x09-\x0D]+"
#: Separators of letter-and-digit words; upper case still counts as a letter here.
NON_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


#: Bytes of one Arrow batch between Spark and Python (Spark's default is 64 MB).
BATCH_BYTES, BATCH_KEY = 2 * 1024 * 1024, "spark.sql.execution.arrow.maxBytesPerBatch"


def map_in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of about ``BATCH_BYTES``, however long the
    texts are: every task holds its batches outside the heap, on the way to
    Python and back and in Python itself.  The setting stays in the session,
    as frames run after they are built; one that the cluster names is left."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its plain name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The whole text, null as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def space_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def letter_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, case as it is."""
    return F.array_remove(F.split(text, NON_WORDS), "")

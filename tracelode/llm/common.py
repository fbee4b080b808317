"""What the training-data operators share: the shared folder, batch iteration and joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.sources.shared import delete, scratch, shared_dir, written  # noqa: F401  (for the operators)

#: Characters of text that a Python worker handles at once.
BATCH_CHARS = 4_000_000
#: A key with over 1 / PARTS of all rows is hot, so at most PARTS keys are.
PARTS = 200


def slim(spark: SparkSession, records: int = 1000) -> None:
    """Whole texts make wide rows: at most so many of them go to a Python worker at once. A session setting, as the
    results of the operators are lazy and run after they have returned; the README says so."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Only the keys and the text, null texts as empty ones."""
    return df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(text))


def in_slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in slices of about `chars` (BATCH_CHARS) bytes of text, with the texts as a list."""
    chars = chars or BATCH_CHARS
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.binary_length(column).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            held += size or 0
            if held >= chars or i + 1 == len(sizes):
                part = batch.slice(begin, i + 1 - begin)
                yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                begin, held = i + 1, 0


def own_name(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined with table, which has one row per key and, in weight, how many of rows have it (the column goes).

    Rows of a hot key are dealt to parts of about 1 / PARTS of all rows, and the key's row is repeated for each part:
    at most 2 * PARTS rows more. Only the hot keys are broadcast, of which there are at most PARTS."""
    every = table.agg(F.sum(weight).alias("__all"))  # one row
    hot = table.crossJoin(F.broadcast(every)).where(F.col(weight) * PARTS > F.col("__all"))
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col(weight) * PARTS / F.col("__all")).cast("long").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts)).drop("__parts")
    right = table.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts", weight)
    return left.join(right, [*keys, "__part"]).drop("__part")

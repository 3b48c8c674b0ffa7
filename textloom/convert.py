"""Text files to CoNLL-U: `spark-submit textloom/convert.py in out` or `python -m textloom.convert in out`."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from textloom.operators.segment import annotated
from textloom.session import session
from textloom.sources import conllu


def main(source: str, out: str) -> None:
    """Every file at source, one document each, is segmented and written to a file of out."""
    spark = session("convert")
    files = spark.read.text(source, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    conllu.rendered(annotated(files, key="path")).select("value").write.text(out)


if __name__ == "__main__":
    main(*sys.argv[1:3])

"""op5: licence paragraphs of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import licenses
from trawldex.llm.common import table


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = licenses.scan(docs, licenses.train(docs))
    known = F.filter("licences", lambda x: x["family"] != "unknown")
    return rows.select(
        "doc_id", "n_paragraphs",
        F.size(F.array_distinct(F.transform("licences", lambda x: x["paragraph"]))).cast("long").alias("n_license"),
        F.size(F.filter("licences", lambda x: x["family"] == "unknown")).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("families"),
    )

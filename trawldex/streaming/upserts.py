"""Index maintenance from a stream of page versions (structured streaming, one micro-batch at a time)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trawldex.operators import analyzer, index
from trawldex.plans.store import Store
from trawldex.sources import files
from trawldex.sources.tables import write_table

PARTS = 64


def replace_in(path: str, lex: DataFrame, profile: str = "latin") -> Callable[[DataFrame, int], None]:
    """A sink that replaces the term rows of each micro-batch's pages (site, page_id, content, version) in the table at path.

    The table is laid out by hash parts of the site; only the parts of the batch's sites are rewritten, and a part that nothing is left of is
    removed. Of several versions of a page in a batch the greatest counts. A batch that runs again writes the same rows, so a
    retry after a lost executor changes nothing.
    """

    part = F.pmod(F.xxhash64("site"), F.lit(PARTS)).cast("int")

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("site", "page_id").agg(F.max_by("content", "version").alias("content"))
        come = index.term_freq(analyzer.lemmas(analyzer.token_rows(newest, ["site", "page_id"], profile=profile), lex))
        come = come.withColumn("part", part)
        try:
            old = spark.read.parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            write_table(come, path, "part")
            return
        touched = {r.part for r in newest.select(part.alias("part")).distinct().collect()}  # PARTS numbers at most
        mine = old.filter(F.col("part").isin(*touched)).select(*come.columns)
        # checkpoint: the table is read before its parts are replaced
        rows = index.replace_pages(mine, come, ["site", "page_id"], newest).checkpoint()
        left = {r.part for r in rows.select("part").distinct().collect()}
        write_table(rows, path, "part")
        for gone in sorted(touched - left):
            files.delete(spark, f"{path}/part={gone}")

    return sink


def layered(store: Store) -> Callable[[DataFrame, int], None]:
    """A sink that puts each micro-batch's pages (page_id, url, html, version) into a persisted index as one small layer.

    Only what the batch's pages held is read and nothing is rewritten; of several versions of a page in a batch the greatest counts. The layer
    bears the number of the batch, so a batch that runs again changes nothing.
    """

    def sink(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("page_id", "url").agg(F.max_by("html", "version").alias("html"))
        store.upsert(newest, tag=f"stream{number}")

    return sink


def maintain_index(pages: DataFrame, store: Store, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream of pages into an index; start it with the trigger that suits. One stream writes to an index."""
    return pages.writeStream.foreachBatch(layered(store)).option("checkpointLocation", checkpoint)


def maintain(pages: DataFrame, path: str, checkpoint: str, lex: DataFrame) -> DataStreamWriter:
    """A writer over a stream of pages; start it with the trigger that suits."""
    return pages.writeStream.foreachBatch(replace_in(path, lex)).option("checkpointLocation", checkpoint)

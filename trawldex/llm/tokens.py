"""Token counts kept up to date by signed deltas.

A batch is a table of changes (op, source, lang, version, tokens, old_tokens): `insert` adds a document and its tokens,
`delete` takes them away, `revise` replaces old_tokens by tokens. Batches become additive sums by source, language and
tokenizer version; the sums are combined before their shuffle, so one source may hold any part of the rows.

`Ledger` keeps the sums of each batch as a table of its own. A commit is whole once its success marker stands: a batch that
failed half-way is written again, and a batch that is committed twice counts once. A batch is written to a folder of its own and then
renamed into place, so of two writers of one batch the first to end counts and the other changes nothing. `compact` folds committed
batches into a base that names them, so they still count once if they come again. Any string may name a batch.

Defined results: null texts count no tokens; null counts are 0; null sources and languages are groups of their own; rows
with an unknown op are an error; groups whose documents and tokens are both 0 are left out; empty batches are recorded
and change nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "version"]
OPS = ["insert", "delete", "revise"]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """A byte-level BPE from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs plus the number of tokens of each text. `path` is read on each executor, where the tokenizer is installed.

    The number takes the place of a column of docs that is named `out`; all other columns are carried, whatever their names.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, out)], F.lit(None).cast("int").alias("__none")).alias("__doc"), F.col(text).alias("__text"))

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            docs, texts = batch.column("__doc"), batch.column("__text")
            for at in range(0, len(texts), 256):
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([docs.slice(at, 256), pa.array(n, pa.int64())], names=["__doc", "__n"])

    from pyspark.sql import types as T

    schema = T.StructType([packed.schema["__doc"], T.StructField("__n", T.LongType())])
    names = [c for c in docs.columns if c not in (text, out)]
    return packed.mapInArrow(run, schema).select(*[F.col(f"__doc.`{c}`").alias(c) for c in names], F.col("__n").alias(out))


def signed(changes: DataFrame) -> DataFrame:
    """Sums (source, lang, version, docs, tokens) of a batch of changes."""
    n, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - old)
    return changes.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


def _name(folder: str) -> str:
    return unquote(folder.rsplit("/batch=", 1)[1])


class Ledger:
    """Rollup sums by batch in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _has(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _folders(self, kind: str) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(s.getPath()) for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(f for f in found if self._has(f"{f}/_SUCCESS"))

    def _base(self) -> str | None:
        bases = self._folders("base")
        return max(bases, key=lambda b: int(b.rsplit("-", 1)[1])) if bases else None

    def committed(self) -> set[str]:
        """Names of the batches that count (one name per commit, not per row)."""
        own = {_name(f) for f in self._folders("batches")}
        base = self._base()
        return own | ({r.batch for r in self.spark.read.parquet(f"{base}").select("batch").filter("batch IS NOT NULL").collect()} if base else set())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before."""
        if self._counts(batch):
            return False
        # quoting keeps separators out of the path; the file system bounds its length
        final, attempt = f"{self.path}/batches/batch={quote(batch, safe='')}", f"{self.path}/attempts/{uuid.uuid4().hex}"
        signed(changes).write.parquet(attempt)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (attempt, final))
        fs = target.getFileSystem(conf)
        if fs.exists(target) and not self._has(f"{final}/_SUCCESS"):
            fs.delete(target, True)
        fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(source, target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            fs.delete(source, True)
            return False
        return True

    def _counts(self, batch: str) -> bool:
        base = self._base()
        if self._has(f"{self.path}/batches/batch={quote(batch, safe='')}/_SUCCESS"):
            return True
        return base is not None and not self.spark.read.parquet(base).filter(F.col("batch") == batch).isEmpty()

    def _live(self) -> DataFrame | None:
        base = self._base()
        done = set()
        parts = []
        if base:
            rows = self.spark.read.parquet(base)
            done = {r.batch for r in rows.select("batch").filter("batch IS NOT NULL").collect()}
            parts.append(rows.filter("batch IS NULL").select(*GROUP, "docs", "tokens"))
        folders = [f for f in self._folders("batches") if _name(f) not in done]
        if folders:
            parts.append(self.spark.read.parquet(*folders).select(*GROUP, "docs", "tokens"))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def rollup(self) -> DataFrame:
        rows = self._live()
        if rows is None:
            rows = self.spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in GROUP], F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens"))
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Write a new base: the sums, and the names of the batches in it. Older files stay until the caller removes them."""
        names = sorted(self.committed())
        base = self._base()
        number = int(base.rsplit("-", 1)[1]) + 1 if base else 1
        sums = self.rollup().withColumn("batch", F.lit(None).cast("string"))
        marks = self.spark.createDataFrame([(n,) for n in names], "batch string").select(*[F.lit(None).cast("string").alias(c) for c in GROUP], F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens"), "batch")
        sums.unionByName(marks).write.mode("overwrite").parquet(f"{self.path}/base/v-{number}")

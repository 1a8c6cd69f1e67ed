"""Line deduplication on levelled sorted runs of line hashes.

A run is a table of (hash, n): n documents of some batches hold the line, counted up to the threshold. It is stored bucketed and sorted by
hash, so that joins with a run move only the other side. A new batch merge-anti-joins the runs for lines that have reached the threshold
(these need no more counting) and adds what is left as a run of level 0; `fanout` runs of one level are compacted into one of the next, which
covers their batches. A run counts once its marker stands, and a batch is added once however often it is tried, so a job that is lost
half-way changes nothing.

Lines are keyed without white space at both ends and with A-Z lower-cased; empty keys are no lines to compare. Keys are known by 128 bits
of hash (two seeds), not by their text.

Defined results: a null or empty text is one empty line, which always stays; rows that share an id are one document, and a row without an id
is a document of its own; repeated rows come out as often as they go in; empty tables give none; only the named columns are read, whatever
others there are; a text of any length is split whole, in one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm.common import WS_CHARS
from trawldex.llm.sqltext import LOWER, UPPER
from trawldex.sources import files

HASH = ["h1", "h2"]
#: A batch's most frequent lines that are kept as hot: any that one in so many of its (document, line) pairs holds is among them.
HOT_SHARE = 2000
#: Hot lines that are broadcast; all others meet in the merge join.
HOT_MOST = 10_000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), UPPER, LOWER)


def _keys(text: Column) -> Column:
    return F.transform(split_lines(text), line_key)


def _hashes(keys: Column) -> Column:
    """Array of (h1, h2) of the keys; null where the key is empty."""
    return F.transform(keys, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"))))


def document_counts(docs: DataFrame, by: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """by, h1, h2, n: documents that hold the line. Each row's lines are made distinct before anything moves; counts are combined map-side."""
    own = F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id())
    rows = docs.select(*by, F.col(doc_id).alias("_doc"), own.alias("_own"), F.explode(_hashes(F.array_distinct(_keys(F.col(text))))).alias("h")).filter("h IS NOT NULL")
    once = rows.select(*by, "_doc", "_own", "h.h1", "h.h2").distinct()
    return once.groupBy(*by, *HASH).agg(F.count("*").alias("n"))


class Run(NamedTuple):
    first: int  # batches that the run covers
    last: int
    level: int


class LineRuns:
    """Runs in a folder that driver and executors share. `buckets` is fixed by the first run; `at_least` by the caller, for good."""

    def __init__(self, spark: SparkSession, path: str, at_least: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path, self.at_least, self.fanout = spark, path.rstrip("/"), at_least, fanout
        self._tables: dict[Run, str] = {}
        kept = [int(n.split("-")[1]) for n in files.names(spark, f"{self.path}/layout")]
        self.buckets = kept[0] if kept else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not kept:
            files.touch(spark, f"{self.path}/layout/buckets-{self.buckets}")

    # what counts

    def _markers(self) -> list[tuple[Run, str]]:
        found = [n.split("-", 3) for n in files.names(self.spark, f"{self.path}/done")]
        return [(Run(int(a), int(b), int(level)), unquote(name)) for level, a, b, name in found]

    def batches(self) -> dict[str, int]:
        return {name: run.first for run, name in self._markers() if run.level == 0}

    def runs(self) -> list[Run]:
        """Runs that no larger run covers."""
        every = sorted((r for r, _ in self._markers()), key=lambda r: (r.first, -r.last, -r.level))
        out: list[Run] = []
        for run in every:
            if not out or run.last > out[-1].last:
                out.append(run)
        return out

    def _at(self, run: Run) -> str:
        return f"{self.path}/runs/{run.level}-{run.first}-{run.last}"

    def _read(self, run: Run) -> DataFrame:
        """A run as a bucketed table of the session's catalog."""
        if run not in self._tables:
            name = f"trawldex_lines_{uuid.uuid4().hex}"
            columns, place = ", ".join(HASH), self._at(run).replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            self._tables[run] = name
        return self.spark.table(self._tables[run])

    def _write(self, rows: DataFrame, run: Run, name: str = "") -> None:
        """rows lie in the buckets' partitions already: one sorted file a bucket."""
        table = f"trawldex_lines_{uuid.uuid4().hex}"
        files.delete(self.spark, self._at(run))  # what an attempt that was lost left
        rows.select(*HASH, "n").sortWithinPartitions(*HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").option("path", self._at(run)).saveAsTable(table)
        self._tables[run] = table
        files.touch(self.spark, f"{self.path}/done/{run.level}-{run.first}-{run.last}-{quote(name, safe='')}")

    def close(self) -> None:
        """Forget the session's tables; the folder stays."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()

    # batches

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.select(*HASH, "n").repartition(self.buckets, *HASH)

    def add(self, name: str, counts: DataFrame) -> bool:
        """Add a batch's counts (h1, h2, n: see document_counts); False if the batch was added before. A document's lines belong to one batch."""
        known = self.batches()
        if name in known:
            return False
        number = max(known.values(), default=-1) + 1
        counts.orderBy(F.desc("n"), *HASH).limit(HOT_SHARE).select(*HASH, "n").write.mode("overwrite").parquet(f"{self.path}/hot/{number}")
        rows = self._dealt(counts)
        for run in self.runs():
            full = self._read(run).filter(F.col("n") >= self.at_least).hint("merge")
            rows = rows.join(full, HASH, "left_anti")
        self._write(rows.withColumn("n", F.least("n", F.lit(self.at_least).cast("long"))), Run(number, number, 0), name)
        self._compact()
        return True

    def _merged(self, runs: Sequence[Run]) -> DataFrame:
        rows = None
        for run in runs:
            rows = self._read(run) if rows is None else rows.unionByName(self._read(run))
        if rows is None:
            rows = self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return self._dealt(rows).groupBy(*HASH).agg(F.least(F.sum("n"), F.lit(self.at_least).cast("long")).alias("n"))

    def _compact(self) -> None:
        while True:
            live = self.runs()
            level = min((r.level for r in live), default=0)
            mine = [r for r in live if r.level == level]
            if len(mine) < self.fanout:
                return
            self._write(self._merged(mine), Run(mine[0].first, mine[-1].last, level + 1))

    # answers

    def repeated(self) -> DataFrame:
        """h1, h2 of lines that at least `at_least` documents hold."""
        live = self.runs()
        rows = self._read(live[0]) if len(live) == 1 else self._merged(live)
        return rows.filter(F.col("n") >= self.at_least).select(*HASH)

    def _hot(self) -> DataFrame:
        """Hot lines of the batches, most frequent first: no more than HOT_MOST, as each is joined with a third of all rows at most."""
        paths = [f"{self.path}/hot/{i}" for i in sorted(self.batches().values())]
        if not paths:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        rows = self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths)
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), *HASH).limit(HOT_MOST).select(*HASH)

    def strip(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, n_lines, n_dropped, kept: documents without the lines that at least `at_least` documents of the added batches hold.

        Only (row key, place, hash) of the lines moves to the runs, and only places come back to the texts. Hot lines, whose number is bounded,
        are found by broadcast, so that no task gets all their places.
        """
        key = [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit("row"), text, doc_id).alias("k2")]
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *key)
        places = rows.select("k1", "k2", F.posexplode(_hashes(_keys(F.col("text")))).alias("at", "h")).filter("h IS NOT NULL").select("k1", "k2", "at", "h.h1", "h.h2")
        hot = F.broadcast(self._hot().withColumn("hot", F.lit(True)))
        repeated = self.repeated()
        marked = places.join(hot, HASH, "left")
        often = marked.filter("hot").drop("hot").join(F.broadcast(repeated.join(hot.drop("hot"), HASH, "left_semi")), HASH, "left_semi")
        seldom = marked.filter("hot IS NULL").drop("hot").repartition(self.buckets, *HASH).join(repeated.hint("merge"), HASH, "left_semi")
        gone = often.unionByName(seldom).groupBy("k1", "k2").agg(F.collect_set(F.col("at") + 1).alias("gone"))
        found = rows.join(gone, ["k1", "k2"], "left")
        lines = split_lines(F.col("text"))
        # lines and places are bound once; the lambda would split the text for every line otherwise
        bound = F.array(F.struct(lines.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone")))
        left = lambda b: F.array_except(F.sequence(F.lit(1), F.size(b["lines"])), b["gone"])
        cut = lambda b: F.struct(F.size(b["lines"]).cast("long").alias("n_lines"), F.size(b["gone"]).cast("long").alias("n_dropped"), F.array_join(F.transform(left(b), lambda i: F.element_at(b["lines"], i)), "\n").alias("kept"))
        return found.select("doc_id", F.explode(F.transform(bound, cut)).alias("c")).select("doc_id", "c.*")

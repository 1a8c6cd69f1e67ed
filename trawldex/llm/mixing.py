"""Mixing sources to target weights by soft membership.

A classifier trained on the labelled table gives every document a posterior over domains. Projected-gradient least squares then
finds a rate for each document, not negative, so that the expected tokens of each domain (rate x tokens x posterior, summed over all
documents) match the targets: the squares of what is missing, each by its target, are made least. All rates start alike. A step moves
a document's rate against the gradient, which is its posterior times one number a domain, and cuts it at 0 (and at max_rate, if the caller sets
one); steps have momentum, which starts anew where it leads uphill. So the rates of all documents follow from few numbers a step, which are
sums over the documents, combined before their shuffle: a pass a step, with no rates sent around. Every REPLAY steps the rates so far are
written, so a pass does not repeat all steps before. It ends when what a step still moves is below `tolerance` of each domain's target; if that does
not come about, `solve` raises.

Texts are scored once; the scores are written beside what is carried, and rates are an expression of the scores. Targets are never lowered. If they
cannot be met (posteriors are soft, so they can contradict each other, and max_rate can forbid them), `plan` raises unless the caller allows the
gap; `Mix` has what was asked of each domain and what the rates give.

The classifier is fitted on at most `sample` of the labelled rows whose documents are given (those with the least hash of their id), of
which the driver gets the hashed words and signs only, 2^16 numbers a document at most; everything else covers all documents.

Defined results: a null or empty text has no tokens, the prior as posterior and takes part with no weight; a null label counts as 0, and of
several labels of an id the worst counts; labels of unknown documents are ignored; of the rows of one labelled id the classifier sees one;
without labelled rows the posterior is uniform; repeated rows are rated alike; an empty table gives an empty result; other columns are
carried, whatever their names. A text is scored whole, in batches of about a MB: memory is bounded by the longest text.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawldex.llm.arrays import give_back
from trawldex.llm.common import materialize
from trawldex.llm.linear import Bag

DOMAINS = ["good", "poor", "toxic"]
SAMPLE = 4000
BITS = 16
BATCH_BYTES = 1 << 20
REPLAY = 25  # steps after which rates are written
log = logging.getLogger("trawldex")


def _batches(texts: pa.Array):
    """(first, texts) in batches of bounded size."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield at, [t or b"" for t in texts.slice(at, end - at).to_pylist()]
        at = end


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Bag:
    """Domains from the labels: toxic rows are `toxic`, others `good` or `poor` by quality."""
    kind = F.when(F.coalesce("toxic", F.lit(0)) > 0, 2).when(F.coalesce("quality", F.lit(0)) > 0, 0).otherwise(1).alias("kind")
    chosen = labels.filter("doc_id IS NOT NULL").select("doc_id", kind).groupBy("doc_id").agg(F.max("kind").alias("kind"))
    chosen = chosen.join(docs.select("doc_id").filter("doc_id IS NOT NULL"), "doc_id", "left_semi")  # only labels that have a text here
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound of the training sample
    model = Bag(BITS, DOMAINS)

    def run(batches):
        for batch in batches:
            for at, texts in _batches(batch.column("text")):
                owner, feature, times, _ = model.features(texts)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                pack = lambda x, kind, cut=cut: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, len(texts)) for c in ("doc_id", "kind")] + [pack(feature, np.uint16), pack(times, np.uint32)], names=["doc_id", "kind", "feature", "times"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    counted = texts.select("doc_id", "kind", "text").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, kind int, feature binary, times binary")
    rows = counted.groupBy("doc_id").agg(F.min(F.struct("feature", "times", "kind")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    if rows:
        model.fit([(np.frombuffer(r.feature, np.uint16), np.frombuffer(r.times, np.uint32)) for r in rows], np.array([r.kind for r in rows]))
    return model


def posteriors(packed: DataFrame, model: Bag, carry: list[str] | None = None) -> DataFrame:
    """Column __doc (struct with `text`; of its fields those in `carry`, by default all) plus tokens (words) and posterior."""
    sent = packed.sparkSession.sparkContext.broadcast(model)
    whole = packed.schema["__doc"].dataType
    names = carry or [f.name for f in whole.fields]
    kept = T.StructType([f for f in whole.fields if f.name in names]) if carry else whole
    schema = T.StructType([T.StructField("__doc", kept), T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def run(batches):
        m = sent.value
        for batch in batches:
            docs = batch.column("__doc")
            out = pa.StructArray.from_arrays([docs.field(n) for n in names], names=names) if carry else docs
            for at, texts in _batches(docs.field("text").cast(pa.binary())):
                p, n = m.of(texts)
                yield pa.RecordBatch.from_arrays([out.slice(at, len(texts)), pa.array(n.astype(np.int64)), pa.array(list(p), pa.list_(pa.float64()))], names=["__doc", "tokens", "posterior"])
        give_back()

    return packed.mapInArrow(run, schema)


Step = tuple[np.ndarray, float]


class MixGap(RuntimeError):
    """Targets that no rates can meet."""


@dataclass
class Solver:
    """Projected gradient with momentum. `history` has (gradient by domain, momentum) of the steps so far: with them, a document's posterior gives its rate."""

    max_rate: float | None
    start: float
    history: list[Step] = field(default_factory=list)

    def walk(self, p: np.ndarray, r: np.ndarray, y: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rate, where the next step starts, rate before, where the last step started) of documents with posteriors p, from rates r and starts y."""
        before, begun = r, y
        for gradient, momentum in steps:
            before, begun = r, y
            r = np.clip(y - p @ gradient, 0, self.max_rate)
            y = r + momentum * (r - before)
        return r, y, before, begun

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.full(len(p), self.start)
        return self.walk(p, r, r, self.history)[0]

    def rate(self) -> Column:
        """The same as an expression of the column `posterior`."""
        number = lambda x: F.lit(float(x))
        steps = F.array(*[F.struct(F.array(*map(number, g)).alias("g"), number(m).alias("m")) for g, m in self.history])
        if not self.history:
            return number(self.start)

        def step(now: Column, s: Column) -> Column:
            moved = now["y"]
            for i in range(len(DOMAINS)):
                moved = moved - F.col("posterior")[i] * s["g"][i]
            r = F.greatest(number(0), moved if self.max_rate is None else F.least(number(self.max_rate), moved))
            # bound once: r is used three times
            return F.transform(F.array(r), lambda r: F.struct(r.alias("r"), (r + s["m"] * (r - now["r"])).alias("y")))[0]

        return F.aggregate(steps, F.struct(number(self.start).alias("r"), number(self.start).alias("y")), step, lambda x: x["r"])


def _blocks(batch: pa.RecordBatch, k: int, solver: Solver):
    """(tokens, posteriors, rates, starts) in pieces that stay in a core's cache."""
    p = np.array(batch.column("posterior").flatten()).reshape(-1, k)
    tokens = batch.column("tokens").to_numpy()
    state = [batch.column(c).to_numpy() if c in batch.schema.names else np.full(len(p), solver.start) for c in ("r", "y")]
    for i in range(0, len(p), 1 << 14):
        part = slice(i, i + (1 << 14))
        yield tokens[part], p[part], state[0][part], state[1][part]


def _summed(rows: DataFrame, width: int, of) -> np.ndarray:
    """Sums over all rows of the vectors that `of` gives for each batch, combined before the shuffle."""

    def run(batches):
        sums = np.zeros(width)
        for batch in batches:
            sums += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(sums)], names=["k", "v"])

    found = {r.k: r.v for r in rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return np.array([found.get(i, 0.0) for i in range(width)])


def solve(rows: DataFrame, targets: np.ndarray, max_rate: float | None, steps: int = 2000, tolerance: float = 1e-4) -> Solver:
    """rows: tokens, posterior; targets: tokens wanted of each domain. What a step still moves must come below tolerance of each target."""
    k = len(targets)
    first = Solver(max_rate, 0.0)
    gram = _summed(rows.select("tokens", "posterior"), k * k + 1, lambda b: sum(np.r_[((p * t[:, None]).T @ p).ravel(), t.sum()] for t, p, _, _ in _blocks(b, k, first)))
    total = gram[-1]
    if not total:
        return first
    wanted = np.asarray(targets, float) / total
    scale = np.maximum(wanted, 1e-3 * wanted.sum())
    solver = Solver(max_rate, float(wanted.sum()) if max_rate is None else min(max_rate, float(wanted.sum())))
    # the gradient cannot change faster than by the largest eigenvalue
    fastest = np.linalg.eigvalsh((gram[:-1] / total).reshape(k, k) / np.sqrt(np.outer(scale, scale)))[-1]
    size = 1 / (1.001 * fastest)

    def sums(batch, late):
        out = np.zeros(3 * k + 1)
        for tokens, p, r, y in _blocks(batch, k, solver):
            r, y, before, begun = solver.walk(p, r, y, late)
            w = tokens / total
            out += np.r_[(w * r) @ p, (w * y) @ p, (w * np.abs(r - begun)) @ p, (w * (begun - r)) @ (r - before)]
        return out

    late: list[Step] = []
    state, age, left = rows.select("tokens", "posterior"), 1.0, np.inf
    for n in range(steps + 1):
        found = _summed(state, 3 * k + 1, lambda b, late=tuple(late): sums(b, late))
        at_rate, at_start, moved, uphill = found[:k], found[k : 2 * k], found[2 * k : 3 * k], found[-1]
        left = float((moved / scale).max()) if n else np.inf
        if left < tolerance * size:
            return solver
        if uphill > 0 and late:  # momentum starts anew: the last step ends where its rates are
            age, at_start = 1.0, at_rate
            late[-1] = solver.history[-1] = (late[-1][0], 0.0)
        older, age = age, (1 + np.sqrt(1 + 4 * age * age)) / 2
        solver.history.append((size * (at_start - wanted) / scale, (older - 1) / age))
        late.append(solver.history[-1])
        if len(late) > REPLAY:
            state, late = materialize(_written(state, solver, tuple(late[:-1])), "rates"), late[-1:]
    raise RuntimeError(f"mixing rates did not settle: a step still moves {left:.1e} of a domain's target")


def _written(state: DataFrame, solver: Solver, late: tuple[Step, ...]) -> DataFrame:
    """tokens, posterior, r, y after the steps so far."""

    def run(batches):
        for batch in batches:
            for tokens, p, r, y in _blocks(batch, p_width, solver):
                r, y, *_ = solver.walk(p, r, y, late)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(list(p), pa.list_(pa.float64())), pa.array(r), pa.array(y)], names=["tokens", "posterior", "r", "y"])

    p_width = len(DOMAINS)
    return state.mapInArrow(run, "tokens long, posterior array<double>, r double, y double")


@dataclass
class Mix:
    """Rated rows (__doc: struct of the carried columns, tokens, posterior, rate, copies), and the totals of the domains: what was asked of them and what the rates give."""

    rows: DataFrame
    model: Bag
    asked: dict[str, float]
    achieved: dict[str, float]

    def gap(self) -> float:
        """The largest part of a domain's asked total that is missing or too much."""
        return max((abs(self.achieved[d] - x) / x for d, x in self.asked.items() if x > 0), default=0.0)


def plan(docs: DataFrame, labels: DataFrame, weights: dict[str, float], tokens: float | None = None, max_rate: float | None = None, sample: int = SAMPLE, carry: list[str] | None = None, allow_gap: bool = False) -> Mix:
    """weights: wanted share of each domain; tokens: wanted total, by default as many as let the first domain keep all it has.

    copies realises the rate: its whole part, and one more with the remainder as probability, decided by the id's hash. Raises MixGap if a domain's
    total is off by more than a hundredth, unless allow_gap is set.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    model = train(docs, labels, sample)
    rated = materialize(posteriors(packed, model, carry), "scored")
    has = rated.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("posterior")[i]), F.lit(0.0)) for i in range(len(DOMAINS))]).first()
    share = np.array([weights[d] for d in DOMAINS], float)
    share = share / share.sum()
    if tokens is None:
        tokens = has[0] / share[0]
    solver = solve(rated.select("tokens", "posterior"), share * tokens, max_rate)
    rated = rated.withColumn("rate", solver.rate())
    given = rated.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("rate") * F.col("posterior")[i]), F.lit(0.0)) for i in range(len(DOMAINS))]).first()
    luck = (F.pmod(F.xxhash64(F.col("__doc.doc_id"), F.lit("mix")), F.lit(1 << 32)) / float(1 << 32)) if "doc_id" in docs.columns else F.lit(0.5)
    rated = rated.withColumn("copies", (F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))
    named = lambda x: dict(zip(DOMAINS, map(float, x), strict=True))
    found = Mix(rated, model, named(share * tokens), named(given))
    if found.gap() > 0.01:
        text = f"asked for {found.asked} tokens, the rates give {found.achieved}"
        if not allow_gap:
            raise MixGap(text)
        log.warning(text)
    return found


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """The rated rows of `plan`, with its options, and in columns of each domain what was asked and achieved."""
    found = plan(docs, labels, weights, **options)
    told = {f"{kind}_{d}": F.lit(totals[d]) for kind, totals in (("asked", found.asked), ("achieved", found.achieved)) for d in DOMAINS}
    return found.rows.withColumns(told)


def apply_mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float | None = 1.0, allow_gap: bool = False) -> DataFrame:
    """The documents as often as their copies say, with all their columns."""
    rows = plan(docs, labels, weights, max_rate=max_rate, allow_gap=allow_gap).rows.filter("copies > 0")
    if max_rate is None or max_rate > 1:
        rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])

"""Mixing sources to target shares of tokens.

Entropy balancing: among all rates w of use, those closest to one use of each document that give every source its tokens are
w = exp(l * tokens), capped, with one dual variable l for each source. Newton steps on the dual, guarded by bisection, run
over counts by source and number of tokens, in the executors. Rates are rounded to whole copies by a hash of the document,
with a cut for each source that brings its tokens to the target.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split of text before merges, a fixed value of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources are few; more than this are refused.
MAX_SOURCES = 10_000
STEPS, PRECISION, BINS = 200, 1e-9, 4096


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents(doc_id, source, text) as doc_id, source, n_tokens; a null text has none. The vocabulary, a file
    of the driver's, is sent to the executors with the job."""

    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(SparkFiles.get(name))
        for b in batches:
            n = [len(x) for x in enc.encode_ordinary_batch([t or "" for t in b.column("text").to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def source_name(c: str) -> Column:
    """Labels that differ only in case, '-' for '_' or outer blanks are one."""
    return F.lower(F.replace(F.trim(F.col(c)), F.lit("-"), F.lit("_")))


def _goals(have: dict[str, int], targets: list[dict], total: float) -> dict[str, float]:
    """Tokens of each source: its share of the total, or all it can give; what it can't give goes to the others by their shares."""
    left = {t["source"]: t for t in targets if have.get(t["source"])}
    goals, rest = {}, total
    while left:
        shares = sum(t["share"] for t in left.values())
        full = [s for s, t in left.items() if t["cap"] * have[s] <= rest * t["share"] / shares] if shares > 0 else list(left)
        if not full:
            return goals | {s: rest * t["share"] / shares for s, t in left.items()}
        for s in full:
            goals[s] = float(left[s]["cap"] * have[s]) if shares > 0 else 0.0
        rest -= sum(goals[s] for s in full)
        for s in full:
            del left[s]
    return goals


def _of(values: dict[str, float]) -> Column:
    """The value of the row's source."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("source")]


def mix(documents: DataFrame, targets: DataFrame, size: float = 1.0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) for documents(doc_id, source, text) and targets(source, target_share, max_repeats).

    copies: doc_id, source, n_tokens, copies >= 1. shares: one row per target with what is there, wanted, used and reached. The
    mixture has size times the tokens of the listed sources. Null sources and those not listed are left out; absent sources
    get nothing; sources too small are used as often as allowed and the others keep their proportions. No document is used more
    than the whole part of max_repeats. Repeated documents are used alike; empty tables give no copies.
    """
    spark = documents.sparkSession
    rows = targets.select(source_name("source").alias("source"), F.col("target_share").alias("share"), F.floor(F.coalesce("max_repeats", F.lit(0.0))).alias("cap")).where("source IS NOT NULL").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = [{"source": r["source"], "share": float(r["share"] or 0), "cap": max(0, int(r["cap"]))} for r in rows]
    if len({t["source"] for t in wanted}) < len(wanted):
        raise ValueError("a source is listed twice")
    own = documents.select("doc_id", source_name("source").alias("source"), "text").where(F.col("source").isin([t["source"] for t in wanted]))
    sized = cut(token_counts(own, vocabulary))
    counts = cut(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    there = {r["source"]: (r["docs"], r["tokens"], r["most"]) for r in counts.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("most")).collect()}
    have = {s: x[1] for s, x in there.items()}
    caps = {t["source"]: float(t["cap"]) for t in wanted}
    goals = _goals(have, wanted, size * sum(have.values()))
    unit = {s: have[s] / there[s][0] for s in goals}
    low = {s: -60.0 * max(1.0, unit[s]) for s in goals}
    high = {s: math.log(max(caps[s], 1)) * unit[s] + 1 for s in goals}
    dual = {s: 0.0 for s in goals}
    open_ = {s for s in goals if 0 < goals[s] < caps[s] * have[s]}
    x = F.col("n_tokens") / _of(unit) if goals else F.lit(0.0)
    for _ in range(STEPS):
        if not open_:
            break
        w = F.exp(F.least(_of({s: dual[s] for s in open_}) * x, F.lit(50.0)))
        free = w < _of(caps)
        used = F.least(w, _of(caps)) * F.col("n_tokens") * F.col("n")
        sums = counts.where(F.col("source").isin(list(open_))).groupBy("source").agg(F.sum(used).alias("f"), F.sum(F.when(free, used * x)).alias("g")).collect()
        for r in sums:
            s, gap = r["source"], r["f"] - goals[r["source"]]
            if abs(gap) <= PRECISION * goals[s]:
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = dual[s]
            step = dual[s] - gap / r["g"] if r["g"] else math.inf
            dual[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    if open_:
        raise RuntimeError(f"no rates found in {STEPS} steps for {sorted(open_)}")
    if not goals:
        copies = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, copies bigint")
    else:
        full = {s for s in goals if goals[s] >= caps[s] * have[s]}
        rate = F.when(F.col("source").isin(list(full)), _of(caps)).when(_of(goals) <= 0, 0.0).otherwise(F.least(F.exp(F.least(_of(dual) * x, F.lit(50.0))), _of(caps)))
        u = (F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        rated = sized.withColumn("rate", rate).withColumn("base", F.floor("rate")).withColumn("edge", F.when(F.col("base") + 1 <= _of(caps), F.col("rate") - F.col("base") - u))
        edges = _edges(rated, goals)
        copies = rated.select("doc_id", "source", "n_tokens", (F.col("base") + F.coalesce((F.col("edge") > _of(edges)).cast("bigint"), F.lit(0))).cast("bigint").alias("copies")).where("copies > 0")
    asked = spark.createDataFrame([(t["source"], t["share"], t["cap"], int(there.get(t["source"], (0, 0))[0]), int(have.get(t["source"], 0)), float(goals.get(t["source"], 0))) for t in wanted], "source string, target_share double, max_copies bigint, n_documents bigint, available_tokens bigint, wanted_tokens double")
    used = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = asked.join(used, "source", "left").select(*asked.columns, zero("used_tokens"), zero("n_copies"), zero("most_copies"))
    total = shares.agg(F.sum("used_tokens")).scalar()
    return copies, shares.withColumn("reached_share", F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), total), F.lit(0.0)))


def _edges(rated: DataFrame, goals: dict[str, float]) -> dict[str, float]:
    """For each source the edge above which a document gets one more copy, so that its tokens come closest to the goal from
    below, to within a BINS-th of a BINS-th of the documents."""
    base = {r["source"]: float(r["t"] or 0) for r in rated.groupBy("source").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("t")).collect()}
    need = {s: goals[s] - base.get(s, 0.0) for s in goals}
    top, width = dict.fromkeys(goals, 1.0), dict.fromkeys(goals, 2.0)
    for _ in range(2):
        bin_ = F.floor((_of(top) - F.col("edge")) / _of(width) * BINS).cast("int")
        sums: dict[str, dict[int, int]] = {s: {} for s in goals}
        inside = rated.where(F.col("edge").isNotNull()).select("source", "n_tokens", bin_.alias("bin")).where(F.col("bin").between(0, BINS - 1))
        for r in inside.groupBy("source", "bin").agg(F.sum("n_tokens").alias("t")).collect():
            sums[r["source"]][r["bin"]] = r["t"]
        for s in goals:
            k = 0
            while k < BINS and sums[s].get(k, 0) <= need[s]:
                need[s] -= sums[s].get(k, 0)
                k += 1
            top[s] -= k * width[s] / BINS
            width[s] /= BINS
    return top

"""Implausible readings: impossible values, spikes against a source's normal behaviour, and stuck values.

Normal behaviour of a source is learnt from its daily profile matrices, one for each reading: a row for each day (days with few
records are joined to the next), a column for each bin of the reading, entries the share of the row's records. Robust principal
components split a matrix into a low-rank part, what the source reports day after day, and a sparse part. A record is a spike
if its cell, its day and bin, is mostly sparse, and if it lies outside the bands about the levels that the low-rank part
holds; the second test keeps the thin ends of normal levels. Matrices are bounded by days and bins, whatever the number of
records.

Runs are found in blocks of record numbers, so that a source with most of the records is spread over many tasks. What
touches a block's ends is put together in blocks of blocks, and so on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.robust import robust_pca, segments, weighted_quantiles
from ..session import cut, union_all

#: Record numbers in a block, and blocks in a block of blocks, as powers of 2.
BLOCK_BITS, SUPER_BITS = 15, 12
#: Rows of bands, runs or cells that may be broadcast; beyond that they are joined on salted keys.
BROADCAST_ROWS, SALTS = 100_000, 64


@dataclass(frozen=True)
class Limits:
    """max_weeks, max_days, days_per_week: what can exist. run: records of a run. habit: share of a period's records from which
    a value is habitual. row: records that a row of a profile matrix has at least, less for sources with few. sparse: share
    of a cell that must be sparse. pay_floor: share of a row below which the low-rank part is no level. sigmas: distance of a pay
    level in robust standard deviations. pay, days, weeks: shares of a source from which bins count as normal; margins
    beyond them for days (log) and weeks."""

    max_weeks: int = 53
    max_days: int = 366
    days_per_week: int = 7
    run: int = 8
    habit: float = 0.15
    row: int = 250
    sparse: float = 0.5
    pay_floor: float = 0.002
    sigmas: float = 5.8
    pay_share: float = 0.004
    days_share: float = 0.02
    weeks_share: float = 0.01
    days_margin: float = 0.15
    weeks_margin: int = 1


#: Widths of the bins: log pay per week (fine, and times PAY_COARSE in the matrix), log days per week, weeks (times WEEKS_COARSE).
PAY_BIN, PAY_COARSE, DAYS_BIN, WEEKS_COARSE = 0.02, 5, 0.05, 3
#: Fine bins of pay that a period can have, and values followed when habits are looked for.
PAY_BINS, FOLLOWED = 4_000, 1_024
#: Rows that the matrix of a source with few records has at least, down to MIN_ROW records each.
ROWS, MIN_ROW = 12, 15


def _normal(records: DataFrame) -> DataFrame:
    """source, period, day, id, pay, days, weeks; null source and period as values of their own, NaN as null."""
    day = F.col("day").cast("bigint") if "day" in records.columns else F.shiftright("id", 5)
    return records.select(
        F.coalesce("source", F.lit("\0")).alias("source"), F.coalesce(F.col("period").cast("bigint"), F.lit(-1)).alias("period"), F.coalesce(day, F.lit(-1)).alias("day"), "id",
        F.when(~F.isnan("pay"), F.col("pay")).alias("pay"), "days", "weeks",
    )


def _weeks_ok(lim: Limits) -> Column:
    return F.col("weeks").between(1, lim.max_weeks)


def _readings(lim: Limits) -> dict[str, Column]:
    """The three readings that have profiles, null where they don't apply."""
    return {
        "p": F.when(_weeks_ok(lim) & (F.col("pay") > 0), F.ln(F.col("pay") / F.col("weeks"))),
        "d": F.when(_weeks_ok(lim) & F.col("days").between(1, lim.max_days) & (F.col("days") <= lim.days_per_week * F.col("weeks")), F.ln(F.col("days") / F.col("weeks"))),
        "w": F.when(_weeks_ok(lim), F.col("weeks").cast("double")),
    }


def _fine(lim: Limits) -> Column:
    """Fine bin of pay a week, bounded."""
    return F.greatest(F.least(F.floor(_readings(lim)["p"] / PAY_BIN), F.lit(PAY_BINS // 2 - 1)), F.lit(-PAY_BINS // 2)).cast("int")


def _bins(lim: Limits, centre: Column) -> dict[str, Column]:
    """Bins of the profile matrices; pay counts from the centre of its source and period."""
    r = _readings(lim)
    return {"p": F.floor((_fine(lim) - centre) / PAY_COARSE).cast("int"), "d": F.floor(r["d"] / DAYS_BIN).cast("int"), "w": F.floor(r["w"]).cast("int")}


def impossible(lim: Limits) -> Column:
    """True for a record with a reading that cannot exist; never null."""
    below = (F.col("pay") < 0) | (F.col("days") < 0) | (F.col("weeks") < 0)
    above = (F.col("weeks") > lim.max_weeks) | (F.col("days") > lim.max_days)
    odd = F.col("weeks").between(0, lim.max_weeks) & (F.col("days") > lim.days_per_week * F.col("weeks"))
    return F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False)) | F.coalesce(odd, F.lit(False))


def _centre(bins: np.ndarray, n: np.ndarray) -> int:
    """Middle of the period's main level: weighted median about the densest stretch."""
    order = np.argsort(bins)
    bins, n = bins[order], n[order]
    reach = int(0.15 / PAY_BIN)
    c = np.r_[0, np.cumsum(n)]
    density = c[np.searchsorted(bins, bins + reach, "right")] - c[np.searchsorted(bins, bins - reach)]
    near = np.abs(bins - bins[np.argmax(density)]) <= 0.6 / PAY_BIN
    return int(weighted_quantiles(bins[near], n[near], [0.5])[0])


def periods(records: DataFrame, measures: list[str], lim: Limits) -> DataFrame:
    """source, period, n, fine ARRAY of (item, count), the records of each fine bin of pay, and for each measure the values
    that hold a share of habit of the period, h_measure ARRAY<DOUBLE>. One pass; sketches merge across partitions.

    The sketch of fine bins follows more than there can be and is exact.
    """
    top = lambda c: F.expr(f"transform(filter(approx_top_k(CAST(`{c}` AS DOUBLE), {int(2 / lim.habit) + 1}, {FOLLOWED}), x -> x.count >= {lim.habit} * count(1) AND x.item IS NOT NULL), x -> x.item)").alias(f"h_{c}")
    fine = F.expr(f"filter(approx_top_k(_fine, {PAY_BINS + 1}, {8 * PAY_BINS}), x -> x.item IS NOT NULL)").alias("fine")
    rows = records.withColumn("_fine", F.when(~impossible(lim), _fine(lim)))
    return rows.groupBy("source", "period").agg(F.count(F.lit(1)).alias("n"), fine, *[top(c) for c in measures])


def habits(found: DataFrame, measures: list[str]) -> DataFrame:
    """_s and _h_measure, an array of habitual values of each measure: those habitual in half of a source's periods."""
    n = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    parts = [found.select("source", F.lit(c).alias("m"), F.explode(f"h_{c}").alias("v")) for c in measures]
    held = union_all(parts).groupBy("source", "m", "v").agg(F.count(F.lit(1)).alias("k")).join(n, "source").where(F.col("k") * 2 >= F.col("n"))
    return held.groupBy(F.col("source").alias("_s")).agg(*[F.collect_set(F.when(F.col("m") == c, F.col("v"))).alias(f"_h_{c}") for c in measures])


def _rows_of(day: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Row number of each of ascending days: days are joined until they have so many records; a short rest joins the last row."""
    row, cur, acc = np.zeros(day.size, np.int64), 0, 0
    for i, x in enumerate(n.tolist()):
        row[i] = cur
        acc += x
        if acc >= least:
            cur, acc = cur + 1, 0
    if acc and cur:
        row[row == cur] = cur - 1
    return row


def profile(day: np.ndarray, bins: np.ndarray, n: np.ndarray, floor: float, lim: Limits) -> tuple[np.ndarray, int, np.ndarray]:
    """For counts by day and bin: the low-rank part's share of each bin, rows weighted by the square root of their records;
    the first bin; and for each count whether its cell is mostly sparse."""
    days, at = np.unique(day, return_inverse=True)
    daily = np.bincount(at, weights=n)
    row = _rows_of(days, daily, int(min(lim.row, max(MIN_ROW, n.sum() // ROWS))))[at]
    first = int(bins.min())
    m = np.zeros((int(row.max()) + 1, int(bins.max()) - first + 1))
    np.add.at(m, (row, bins - first), n)
    total = m.sum(1)
    m /= total[:, None]
    low, _ = robust_pca(m)
    level = np.where(low >= floor, low, 0.0)
    sparse = m - level >= lim.sparse * m
    w = np.sqrt(total)
    return (level * w[:, None]).sum(0) / w.sum(), first, sparse[row, bins - first]


def _pay_bands(on: np.ndarray, first: int, fine: pd.DataFrame, centres: dict[int, int], lim: Limits) -> list[tuple[float, float]]:
    """Bands, relative to the centre, about the levels in on; their widths are those of the counts by fine bin."""
    away = (fine["bin"] - fine["period"].map(centres)).to_numpy()
    order = np.argsort(away, kind="stable")
    away, count, out = away[order], fine["n"].to_numpy()[order], []
    for a, b in segments(on, 2):
        near = (away >= (a + first - 3) * PAY_COARSE) & (away < (b + first + 4) * PAY_COARSE)
        if near.any():
            q16, mid, q84 = weighted_quantiles(away[near], count[near], [0.16, 0.5, 0.84]) * PAY_BIN
            reach = lim.sigmas * max((q84 - q16) / 2, PAY_BIN)
            out.append((mid - reach, mid + reach))
    return out


def source_profile(fine: pd.DataFrame, cells: pd.DataFrame, centres: dict[int, int], lim: Limits) -> tuple[dict[str, list[tuple[float, float]]], pd.DataFrame]:
    """Bands of each reading (of pay relative to the centres), and the sparse cells among cells, for one source's counts: fine by
    period and fine bin of pay, cells by day, reading and bin."""
    bands: dict[str, list[tuple[float, float]]] = {"p": [], "d": [], "w": []}
    kept = []
    for reading, floor, share, margin, coarse in (("p", lim.pay_floor, lim.pay_share, 0, 1), ("d", lim.days_share, lim.days_share, lim.days_margin / DAYS_BIN, 1), ("w", lim.weeks_share, lim.weeks_share, lim.weeks_margin, WEEKS_COARSE)):
        x = cells[cells["reading"] == reading]
        if not len(x):
            continue
        bins, n = x["bin"].to_numpy(), x["n"].to_numpy()
        held, first, sparse = profile(x["day"].to_numpy(), bins // coarse, n, floor, lim)
        on = held >= max(share, 1.5 / n.sum())
        on[int(np.argmax(held))] = True
        if reading == "p":
            bands["p"] = _pay_bands(on, first, fine, centres, lim)
        else:
            unit = DAYS_BIN if reading == "d" else 1
            for a, b in segments(on, 1):
                inside = x[(x["bin"] >= (a + first) * coarse) & (x["bin"] < (b + first + 1) * coarse)].groupby("bin")["n"].sum()
                if len(inside):
                    usual = inside[inside >= 0.1 * inside.mean()].index
                    bands[reading].append(((int(usual.min()) - margin) * unit, (int(usual.max()) + margin + (reading == "d")) * unit))
        # a cell that lies within a band as a whole holds no spike
        lo, width = (bins, 1) if reading == "w" else (bins * DAYS_BIN, DAYS_BIN) if reading == "d" else (bins * PAY_COARSE * PAY_BIN, (PAY_COARSE + 1) * PAY_BIN)
        within = np.zeros(bins.size, bool)
        for a, b in bands[reading]:
            within |= (lo >= a) & (lo + (0 if reading == "w" else width) <= b)
        kept.append(x[sparse & ~within])
    return bands, pd.concat(kept) if kept else cells.iloc[:0]


def normal_behaviour(records: DataFrame, found: DataFrame, lim: Limits) -> tuple[DataFrame, DataFrame]:
    """Bands: source, period, c, p, d, w (centre of pay in fine bins, arrays of (lo, hi)). Cells: source, day, reading, bin, those
    mostly sparse. found is what periods() gave for records."""

    def centre(g: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, p, _centre(np.array([x["item"] for x in f]), np.array([x["count"] for x in f])) if len(f) else None) for s, p, f in zip(g["source"], g["period"], g["fine"], strict=True)]
        return pd.DataFrame(rows, columns=["source", "period", "c"]).astype({"c": "Int32"})

    centres = cut(found.select("source", "period", "fine").mapInPandas(lambda gs: (centre(g) for g in gs), "source string, period bigint, c int"))
    centred = _lookup(records.where(~impossible(lim)), centres.withColumnsRenamed({"source": "_s", "period": "_p"}), {"source": "_s", "period": "_p"})
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("reading"), x.alias("bin")) for k, x in _bins(lim, F.col("c")).items()]), lambda x: x["bin"].isNotNull()))
    counts = centred.select("source", "day", each.alias("x")).groupBy("source", "day", "x.reading", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    fine = found.join(centres, ["source", "period"]).select("source", "period", "c", F.explode_outer("fine").alias("x")).select("source", "period", "c", F.col("x.item").alias("bin"), F.col("x.count").alias("n"))

    def one_source(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        source, all_periods = f["source"].iloc[0], sorted(set(f["period"]))
        f = f.dropna(subset=["bin"]).astype({"bin": "int64", "n": "int64", "c": "int64"})
        own = dict(zip(f["period"], f["c"], strict=True))
        bands, cells = source_profile(f, g, own, lim)
        out = [(source, int(p), "c", float(c), None, None, None) for p, c in own.items()]
        out += [(source, int(p), "p", (c + 0.5) * PAY_BIN + a, (c + 0.5) * PAY_BIN + b, None, None) for a, b in bands["p"] for p, c in own.items()]
        out += [(source, int(p), k, a, b, None, None) for k in "dw" for a, b in bands[k] for p in all_periods]
        out += [(source, None, r, None, None, d, b) for r, d, b in zip(cells["reading"], cells["day"], cells["bin"], strict=True)]
        return pd.DataFrame(out, columns=["source", "period", "reading", "lo", "hi", "day", "bin"]).astype({"period": "Int64", "day": "Int64", "bin": "Int32"})

    known = cut(fine.groupBy("source").cogroup(counts.groupBy("source")).applyInPandas(one_source, "source string, period bigint, reading string, lo double, hi double, day bigint, bin int"))
    of = lambda k: F.collect_list(F.when(F.col("reading") == k, F.struct("lo", "hi"))).alias(k)
    bands = known.where("day IS NULL").groupBy(F.col("source").alias("_s"), F.col("period").alias("_p")).agg(F.max(F.when(F.col("reading") == "c", F.col("lo"))).cast("int").alias("c"), of("p"), of("d"), of("w"))
    return bands, known.where("day IS NOT NULL").select("source", "day", "reading", "bin")


def _lookup(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """left with what right knows of it, nulls where that is nothing; right's keys are dropped. A right side of more rows than may
    be broadcast is joined on salted keys, so that a hot key is spread."""
    match = F.lit(True)
    for a, b in on.items():
        match = match & (F.col(a) == F.col(b))
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), match, "left").drop(*on.values())
    copies = right.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(copies, match & (F.col("_salt") == F.col("_rsalt")), "left").drop(*on.values(), "_salt", "_rsalt")


def worked() -> Column:
    """False for a record of no paid work, which is never a case."""
    zero = lambda c: F.coalesce(F.col(c) == 0, F.lit(True))
    return ~(zero("pay") & zero("days") & zero("weeks"))


def _outside(lim: Limits) -> dict[str, Column]:
    """For each reading whether it lies outside every band of its source; a source without bands has nothing outside."""

    def one(k: str, x: Column) -> Column:
        return F.coalesce((F.size(k) > 0) & ~F.exists(k, lambda b: (x >= b["lo"]) & (x <= b["hi"])), F.lit(False))

    return {k: one(k, x) for k, x in _readings(lim).items()}


_PIECE = ["source", "g", "m", "v", "n", "a", "z", "left", "right"]
_PIECE_TYPES = "source string, g bigint, m int, v double, n bigint, a bigint, z bigint, left boolean, right boolean"


def _joined(group: np.ndarray, v: np.ndarray, n: np.ndarray, a: np.ndarray, z: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Neighbouring pieces of a group put together: those of equal value of which one reaches its block's end and the next its
    block's start. What comes out is a run of k or touches its group's ends. group is true where another group begins."""
    new = group | ~np.r_[False, right[:-1] & left[1:] & (v[1:] == v[:-1])]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], v.size] - 1
    total = np.add.reduceat(n, s) if s.size else n[:0]
    last = np.r_[group[1:], True] if v.size else group
    x = {"s": s, "v": v[s], "n": total, "a": a[s], "z": z[e], "left": group[s] & left[s], "right": last[e] & right[e]}
    keep = (total >= k) & ~np.isnan(x["v"]) | x["left"] | x["right"]
    return {c: y[keep] for c, y in x.items()}


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str], f: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f of whole groups of rows that come sorted by keys, with where groups begin; a group may cross batches."""

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in keys:
            x = t.column(c).combine_chunks()
            x = (x.dictionary_encode().indices if pa.types.is_string(x.type) else x).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return new

    held: list = []
    for b in batches:
        t = pa.Table.from_batches([*held, b])
        new = begins(t)
        last = int(np.flatnonzero(new)[-1]) if t.num_rows else 0
        if last:
            yield f(t.slice(0, last), new[:last])
        held = t.slice(last).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield f(t, begins(t))


def runs(records: DataFrame, measures: list[str], lim: Limits, usual: DataFrame) -> DataFrame:
    """source, m, v, n, a, z: each run, consecutive in id order within a source, of at least lim.run equal non-null values of a
    measure (by number) that its source doesn't hold habitually, with its first and last id."""
    k = lim.run

    def first_level(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        source, g, at, out = t.column("source").combine_chunks(), t.column("g").to_numpy(), t.column("id").to_numpy(), []
        one, yes = np.ones(at.size, np.int64), np.ones(at.size, bool)
        for i, c in enumerate(measures):
            x = _joined(new, t.column(c).to_numpy(), one, at, at, yes, yes, k)
            s = pa.array(x.pop("s"))
            out.append(pa.RecordBatch.from_arrays([source.take(s), pa.array(g[s]), pa.array(np.full(len(s), i, np.int32)), *[pa.array(x[y]) for y in _PIECE[3:]]], _PIECE))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if any(b.num_rows for b in out) else out[0]

    def next_level(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        x = _joined(new, *[t.column(y).to_numpy() for y in _PIECE[3:]], k)
        s = pa.array(x.pop("s"))
        return pa.RecordBatch.from_arrays([*[t.column(y).combine_chunks().take(s) for y in _PIECE[:3]], *[pa.array(x[y]) for y in _PIECE[3:]]], _PIECE)

    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in measures]
    rows = records.select("source", F.shiftright("id", BLOCK_BITS).alias("g"), "id", *values).repartition("source", "g").sortWithinPartitions("source", "g", "id", *measures)
    parts = rows.mapInArrow(lambda bs: _by_group(bs, ["source", "g"], first_level), _PIECE_TYPES)
    for up in (F.shiftright("g", SUPER_BITS), F.lit(0).cast("bigint")):
        sent = parts.withColumn("g", up).repartition("source", "g", "m").sortWithinPartitions("source", "g", "m", "a", "z")
        parts = sent.mapInArrow(lambda bs: _by_group(bs, ["source", "g", "m"], next_level), _PIECE_TYPES)
    found = cut(parts.where((F.col("n") >= k) & ~F.isnan("v")).select("source", "m", "v", "n", "a", "z", F.col("a").alias("id")))
    held = F.lit(False)
    for i, c in enumerate(measures):
        held = held | ((F.col("m") == i) & F.coalesce(F.array_contains(f"_h_{c}", F.col("v")), F.lit(False)))
    return _lookup(found, usual, {"source": "_s"}).where(~held).select("source", "m", "v", "n", "a", "z")


def _in_run(records: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
    """records with _runs, the runs that touch their source's block, and the condition that one of them holds the record."""
    blocks = found.select("source", F.explode(F.sequence(F.shiftright("a", BLOCK_BITS), F.shiftright("z", BLOCK_BITS))).alias("_rb"), "a", "z")
    blocks = cut(blocks.groupBy(F.col("source").alias("_s"), "_rb").agg(F.collect_set(F.struct("a", "z")).alias("_runs")))
    out = _lookup(records.withColumn("_b", F.shiftright("id", BLOCK_BITS)), blocks, {"source": "_s", "_b": "_rb"}).drop("_b")
    return out, F.coalesce(F.exists("_runs", lambda r: F.col("id").between(r["a"], r["z"])), F.lit(False))


MEASURES = ["pay", "days", "weeks"]


def stuck(records: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """id, once for each record of a run; records as for implausible."""
    rows = _normal(records)
    usual = cut(habits(periods(rows, MEASURES, lim), MEASURES))
    held, inside = _in_run(rows, runs(rows, MEASURES, lim, usual))
    return held.where(inside & worked()).select("id").distinct()


def out_of_range(records: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """id, once for each record with a reading that cannot exist; records as for implausible."""
    return _normal(records).where(impossible(lim)).select("id").distinct()


def implausible(records: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """id, once for each implausible record of records(id BIGINT, source, period, pay DOUBLE, days, weeks, and day if known).

    Nulls and NaN are no readings and break runs; records of no paid work (all three zero or null) are in no run. A null
    source, period or day is one of its own; without a column day, stretches of record numbers take its place. Ids are taken as
    unique; repeated rows with one id come out once. The records are read four times: levels and habits, daily profiles,
    runs, and the records themselves.
    """
    rows = _normal(records)
    found = cut(periods(rows, MEASURES, lim))
    bands, cells = normal_behaviour(rows, found, lim)
    stretches = runs(rows, MEASURES, lim, cut(habits(found, MEASURES)))
    held, inside = _in_run(_lookup(rows, cut(bands), {"source": "_s", "period": "_p"}), stretches)
    out = _outside(lim)
    bins = _bins(lim, F.col("c"))
    apart = F.filter(F.array(*[F.struct(F.lit(k).alias("reading"), F.when(out[k], bins[k]).alias("bin")) for k in out]), lambda x: x["bin"].isNotNull())
    marked = cut(held.select("id", "source", "day", (impossible(lim) | inside & worked()).alias("sure"), apart.alias("apart")).where(F.col("sure") | (F.size("apart") > 0)))
    spikes = marked.where(~F.col("sure")).select("id", "source", "day", F.explode("apart").alias("x")).select("id", "source", "day", "x.reading", "x.bin")
    return union_all([marked.where("sure").select("id"), spikes.join(cells, ["source", "day", "reading", "bin"], "left_semi").select("id")]).distinct()

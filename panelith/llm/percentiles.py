"""Percentiles by group: distributed multi-select, and mergeable summaries.

Tasks sort their own values by group once and keep them as runs of different values with their counts. In every round each run
proposes local quantiles of its values still in question, weighted by the values they stand for, or all of these values
where they are few; weighted medians of the proposals, one for each percentile, become pivots, with a neighbour on either
side; all runs count below, at and above the pivots, and the ranges that cannot hold the percentile are discarded. A
percentile is found when a pivot has its rank, or when the proposals were all that is left. Results are exact. Groups of
every size take this one path; the state of a round is a table by group.

For partial results that are to be combined, values are cut into cells of equal weight. Ranks in a union of summaries are off
by at most the share EPSILON of its rows, whatever the number of parts.

Sorted values and their weights travel as pairs of doubles in one binary value. What many runs give for one group is put
together in two steps, first within salts, so that a group with most rows is never gathered from all runs at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, union_all

#: Different values that a run proposes as they are; more are proposed as so many quantiles.
PROPOSALS = 63
#: Distance of a pivot's neighbours from it, as a share of the values in question.
BESIDE = 0.02
#: Rounds after which the search gives up with an error; each leaves at most a twentieth or so of the values.
ROUNDS = 60
EPSILON = 0.005
CHUNK = 400_000
#: Rows of a round's state that may be broadcast: at most some 500 bytes each.
BROADCAST_ROWS = 40_000
#: Runs of a group, of at most PROPOSALS pairs each, that are gathered in one step.
FEW = 1024
#: Salts within which summaries are put together.
SALTS = 16


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)


def runs(rows: DataFrame, dims: list[str], measures: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """level, dims, measure, n, values, counts and salt: one row for a group and chunk of a task, the group's different non-null,
    non-NaN values of a measure, ascending, with their counts (empty where all are 1), and the number of values. salt is the task's number.

    rows has dims (as they are to come out) and the measures as DOUBLE. Each level groups by those dims that it names; the
    others are null. Dims that it names with a "!" must not be null. Rows are sent to Python once for all levels and measures.
    """
    keys = ["level", *dims, "measure"]
    data = rows.select(*dims, *measures)

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = {k: t.column(k).combine_chunks().dictionary_encode(null_encoding="encode") for k in dims}
        values = {m: t.column(m).combine_chunks().to_numpy(zero_copy_only=False) for m in measures}
        for level, named in levels.items():
            group, usable = np.zeros(t.num_rows, np.int64), np.ones(t.num_rows, bool)
            for k in named:
                x = coded[k.rstrip("!")]
                if k.endswith("!"):
                    usable &= t.column(k.rstrip("!")).combine_chunks().is_valid().to_numpy(zero_copy_only=False)
                group = group * len(x.dictionary) + x.indices.to_numpy(zero_copy_only=False)
                if group.max(initial=0) >= 2**40:
                    _, group = np.unique(group, return_inverse=True)
            for m in measures:
                row = np.flatnonzero(usable & ~np.isnan(values[m]))
                order = np.lexsort((values[m][row], group[row]))
                row = row[order]
                g, v = group[row], values[m][row]
                new = np.r_[True, g[1:] != g[:-1]][: g.size]
                other = np.flatnonzero(new | np.r_[True, v[1:] != v[:-1]][: g.size])
                count = np.diff(np.r_[other, v.size])
                at = np.flatnonzero(new)
                ends = np.searchsorted(other, np.r_[at[1:], v.size][: at.size])
                tied = np.maximum.reduceat(count, np.r_[0, ends[:-1]]) > 1 if at.size else np.zeros(0, bool)
                size = np.diff(np.r_[0, ends])
                pick = pa.array(row[at])
                none = lambda k: pa.nulls(at.size, t.schema.field(k).type)
                out = [t.column(k).combine_chunks().take(pick) if k in named or f"{k}!" in named else none(k) for k in dims]
                for i in range(0, at.size, 50_000):
                    z = slice(i, i + 50_000)
                    lo, hi = (0 if i == 0 else ends[i - 1]), ends[z][-1]
                    counts = count[lo:hi][np.repeat(tied[z], size[z])].astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([level] * len(ends[z]), pa.string()), *[c.slice(i, 50_000) for c in out], pa.array([m] * len(ends[z]), pa.string()), pa.array(np.diff(np.r_[at, v.size])[z]),
                         _bytes(v[other[lo:hi]], ends[z] - lo), _bytes(counts, np.cumsum(np.where(tied[z], size[z], 0)))], [*keys, "n", "values", "counts"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK:
                yield from flush(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from flush(pa.Table.from_batches(held))

    return data.mapInArrow(local, f"level string, {_types(data, dims)}, measure string, n bigint, values binary, counts binary").withColumn("salt", F.spark_partition_id())


def _bytes(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers, cut at ends, as binary values."""
    offsets = (np.r_[0, ends] * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _numbers(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and the offsets of its rows in them."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data, size = col.buffers()[2], np.dtype(kind).itemsize
    flat = np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), kind), (off - off[0]).astype(np.int64) // size


def _binary(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pairs, cut at ends, as binary values."""
    return _bytes(x.reshape(-1), np.asarray(ends) * 2)


def _pairs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a binary column, and the offsets of its rows in them."""
    flat, off = _numbers(col, np.float64)
    return flat.reshape(-1, 2), off // 2


def _of_run(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Runs as pairs, and the offsets of rows in them."""
    v, off = _numbers(b.column("values"), np.float64)
    c, coff = _numbers(b.column("counts"), np.uint32)
    w = np.ones(v.size)
    w[np.repeat(np.diff(coff) > 0, np.diff(off))] = c
    return np.stack([v, w], 1), off


def _quantiles(x: np.ndarray, k: int, middle: bool) -> np.ndarray:
    """Ascending pairs as at most k of equal weight: the middle value of each, or its last one."""
    if len(x) <= k:
        return x
    c = np.cumsum(x[:, 1])
    ends = np.unique(np.searchsorted(c, np.linspace(0, c[-1], k + 1)[1:])) + 1
    ends[-1] = len(x)
    start = np.r_[0, ends[:-1]]
    weight = c[ends - 1] - np.r_[0, c[ends[:-1] - 1]]
    at = np.minimum(np.searchsorted(c, c[ends - 1] - weight / 2), ends - 1) if middle else ends - 1
    return np.stack([x[np.maximum(at, start), 0], weight], 1)


def _each(x: np.ndarray, off: np.ndarray, k: int, middle: bool) -> tuple[pa.Array, np.ndarray]:
    """The rows' pairs, those of rows with more than k as k quantiles, and whether a row is as it was."""
    size = np.diff(off)
    big = np.flatnonzero(size > k)
    if not big.size:
        return _binary(x, off[1:]), size <= k
    parts, last = [], 0
    size = size.copy()
    same = size <= k
    for i in big.tolist():
        small = _quantiles(x[off[i] : off[i + 1]], k, middle)
        parts += [x[last : off[i]], small]
        last, size[i] = off[i + 1], len(small)
    return _binary(np.concatenate([*parts, x[last:]]), np.cumsum(size)), same


def _sorted(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each row's pairs in ascending order."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return x[np.lexsort((x[:, 0], owner))]


def _ranks(n: np.ndarray, q: float) -> np.ndarray:
    return np.maximum(1, np.ceil(q * n)).astype(np.int64)


def _at_ranks(x: np.ndarray, off: np.ndarray, ranks: list[np.ndarray]) -> list[np.ndarray]:
    """For each row, whose pairs are ascending, the values at which the weight first reaches each rank, or the last."""
    c = np.cumsum(x[:, 1])
    before = np.r_[0.0, c][off[:-1]]
    return [x[np.minimum(np.searchsorted(c, before + r), off[1:] - 1), 0] for r in ranks]


def _salts(local: DataFrame) -> int:
    """Salts by which the runs of one group are gathered: the root of the number of runs that a group can have at most. What
    FEW runs propose is gathered at once."""
    n = (local.agg(F.sum("n")).first()[0] or 0) // CHUNK + local.rdd.getNumPartitions()
    return 1 if n <= FEW else math.isqrt(n)


def _gathered(parts: DataFrame, keys: list[str], salts: int, k: int, middle: bool) -> DataFrame:
    """keys, n, exact, values: parts(keys, n, exact, values, salt) put together, first within salts, where more than 16 k pairs
    become 8 k; exact is false for a group that anything was left out of."""

    def smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = _pairs(b.column("values"))
            exact = b.column("exact").to_numpy(zero_copy_only=False)
            if np.diff(off).max(initial=0) > 16 * k:
                x = _sorted(x, off)
                size = np.diff(off) > 16 * k
                out = [_quantiles(x[s:e], 8 * k, middle) if big else x[s:e] for s, e, big in zip(off[:-1], off[1:], size, strict=True)]
                values, exact = _binary(np.concatenate(out), np.cumsum([len(o) for o in out])), exact & ~size
            else:
                values = b.column("values")
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], b.column("n"), pa.array(exact), values], [*keys, "n", "exact", "values"])

    sums = [F.sum("n").alias("n"), F.bool_and("exact").alias("exact"), F.expr("listagg(values)").alias("values")]
    if salts > 1:
        parts = parts.groupBy(*keys, F.pmod("salt", F.lit(salts)).alias("salt")).agg(*sums).drop("salt").mapInArrow(smaller, f"{_types(parts, keys)}, n bigint, exact boolean, values binary")
    return parts.groupBy(*keys).agg(*sums)


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def _with_state(local: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of the groups in state, with it. A large state goes to its groups' salts, so that the runs of one group are spread."""
    other = state.withColumnsRenamed({k: f"_{k}" for k in keys})
    if state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return local.join(F.broadcast(other), _same(keys)).drop(*[f"_{k}" for k in keys])
    sites = local.groupBy(*keys, "salt").agg(F.lit(1).alias("_one")).drop("_one").withColumnRenamed("salt", "_salt")
    placed = sites.join(other, _same(keys)).drop(*keys)
    return local.join(placed, _same(keys) & (F.col("salt") == F.col("_salt"))).drop(*[f"_{k}" for k in keys], "_salt")


def _names(shares: list[float]) -> list[str]:
    return [f"p{round(100 * q)}" for q in shares]


def percentiles(rows: DataFrame, dims: list[str], measures: list[str], levels: dict[str, list[str]], shares: list[float]) -> DataFrame:
    """level, dims, measure, n and for each share q a column p{100 q}: the smallest value with at least q of the group's values at or
    below it; rows, dims, measures and levels as for runs().

    Null and NaN values don't count; groups without values don't come out; null dims are groups of their own, unless named
    with "!". Ties and repeated rows count as they stand.
    """
    keys, local, names, count = ["level", *dims, "measure"], cut(runs(rows, dims, measures, levels)), _names(shares), len(shares)
    types, salts = _types(local, keys), _salts(local)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, exact = _each(*_of_run(b), PROPOSALS, True)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("n"), pa.array(exact), values, b.column("salt")], [*keys, "n", "exact", "values", "salt"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = _pairs(b.column("values"))
            n = b.column("n").to_numpy(zero_copy_only=False)
            x, ranks = _sorted(x, off), [_ranks(n, q) for q in shares]
            found = _at_ranks(x, off, ranks)
            beside = [_at_ranks(x, off, [np.clip(r + s * n * BESIDE, 1, n) for r in ranks]) for s in (-1, 1)]
            pivots = np.stack([beside[0], found, beside[1]], 2).transpose(1, 0, 2).reshape(-1)
            still = ~b.column("exact").to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(still * (3 * count))].astype(np.int32)
            pivots = pivots.reshape(b.num_rows, -1)[still].reshape(-1)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("n"), b.column("exact"), *[pa.array(v) for v in found], pa.ListArray.from_arrays(pa.array(at), pa.array(pivots))], [*keys, "n", "exact", *names, "pivots"])

    proposed = local.mapInArrow(first, f"{types}, n bigint, exact boolean, values binary, salt int")
    answers = cut(_gathered(proposed, keys, salts, PROPOSALS, True).mapInArrow(settle, f"{types}, n bigint, exact boolean, {', '.join(f'{x} double' for x in names)}, pivots array<double>"))
    done = answers.where("exact").select(*keys, "n", *names)
    open_ = answers.where("NOT exact")
    if open_.isEmpty():
        return done
    rest = _select(local, open_.select(*keys, "n", "pivots"), keys, shares, salts)
    return done.unionByName(rest.select(*keys, "n", *[F.get("answer", F.lit(i)).alias(x) for i, x in enumerate(names)]))


def _count(local: DataFrame, pivots: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts ARRAY of (i, below, upto) of the values of each group of pivots(keys, pivots) below each and up to it, null pivots
    left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = _of_run(b)
            take, index, below, upto = [], [], [], []
            for i, p in enumerate(b.column("pivots").to_pylist()):
                own = x[off[i] : off[i + 1]]
                c = np.r_[0.0, np.cumsum(own[:, 1])]
                for k, v in enumerate(p):
                    if v is not None:
                        take.append(i)
                        index.append(k)
                        below.append(int(c[np.searchsorted(own[:, 0], v)]))
                        upto.append(int(c[np.searchsorted(own[:, 0], v, "right")]))
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keys], pa.array(index, pa.int32()), pa.array(below, pa.int64()), pa.array(upto, pa.int64())], [*keys, "i", "below", "upto"])

    held = _with_state(local.select(*keys, "values", "counts", "salt"), pivots.select(*keys, "pivots"), keys)
    sums = held.mapInArrow(count, f"{_types(local, keys)}, i int, below bigint, upto bigint").groupBy(*keys, "i").agg(F.sum("below").alias("below"), F.sum("upto").alias("upto"))
    return sums.groupBy(*keys).agg(F.collect_list(F.struct("i", "below", "upto")).alias("counts"))


def _beside(state: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """state with the columns of other, both one row a group."""
    return state.join(other.withColumnsRenamed({k: f"_{k}" for k in keys}), _same(keys)).drop(*[f"_{k}" for k in keys])


def _select(local: DataFrame, open_: DataFrame, keys: list[str], shares: list[float], salts: int) -> DataFrame:
    """keys, n, answer ARRAY<DOUBLE> of the groups of open_(keys, n, pivots), by rounds of counting and proposing.

    The state of a group has for each share the range in question, from above lo to below hi (null: open), the numbers of
    values up to lo and below hi, and the answer once it is found.
    """
    names = ["lo", "hi", "base", "top", "answer"]
    kinds = dict(zip([*names, "pivots"], ["double", "double", "bigint", "bigint", "double", "double"], strict=True))
    arrow = {k: pa.list_(pa.float64() if t == "double" else pa.int64()) for k, t in kinds.items()}
    schema = f"{_types(local, keys)}, n bigint, " + ", ".join(f"{k} array<{kinds[k]}>" for k in names)

    def each_group(b: pa.RecordBatch, columns: list[str], made: list[str], f) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in made}
        for row in zip(b.column("n").to_pylist(), *[b.column(c).to_pylist() for c in columns], strict=True):
            for k, x in zip(made, f(*row), strict=True):
                out[k].append(x)
        return pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("n"), *[pa.array(out[k], arrow[k]) for k in made]], [*keys, "n", *made])

    def rank(n: int, j: int) -> int:
        return max(1, math.ceil(shares[j] * n))

    def narrowed(n, pivots, counts, lo, hi, base, top, answer):
        by = {c["i"]: c for c in counts}
        for j in range(len(shares)):
            for k in range(3 * j, 3 * j + 3):
                if answer[j] is not None or k not in by:
                    continue
                if by[k]["below"] < rank(n, j) <= by[k]["upto"]:
                    answer[j] = pivots[k]
                elif rank(n, j) > by[k]["upto"] >= base[j]:
                    lo[j], base[j] = pivots[k], by[k]["upto"]
                elif rank(n, j) <= by[k]["below"] <= top[j]:
                    hi[j], top[j] = pivots[k], by[k]["below"]
        return lo, hi, base, top, answer

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield each_group(b, ["pivots", "counts", *names], names, narrowed)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = _of_run(b)
            take, js, n, exact, values = [], [], [], [], []
            for i, (lo, hi, answer) in enumerate(zip(*[b.column(k).to_pylist() for k in ("lo", "hi", "answer")], strict=True)):
                own = x[off[i] : off[i + 1]]
                for j in [j for j, v in enumerate(answer) if v is None]:
                    inside = own[0 if lo[j] is None else np.searchsorted(own[:, 0], lo[j], "right") : len(own) if hi[j] is None else np.searchsorted(own[:, 0], hi[j])]
                    if len(inside):
                        take.append(i)
                        js.append(j)
                        n.append(int(inside[:, 1].sum()))
                        exact.append(len(inside) <= PROPOSALS)
                        values.append(_quantiles(inside, PROPOSALS, True))
            at = pa.array(take, pa.int64())
            pairs = _binary(np.concatenate(values) if values else np.zeros((0, 2)), np.cumsum([len(v) for v in values]))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keys], pa.array(js, pa.int32()), pa.array(n, pa.int64()), pa.array(exact, pa.bool_()), pairs, b.column("salt").take(at)], [*keys, "j", "n", "exact", "values", "salt"])

    def chosen(n, proposals, base, top, answer):
        pivots: list = [None] * (3 * len(shares))
        for p in proposals:
            j, x = p["j"], np.frombuffer(p["values"]).reshape(-1, 2)
            x = x[np.argsort(x[:, 0], kind="stable")]
            beside = 0 if p["exact"] else (top[j] - base[j]) * BESIDE
            at = np.searchsorted(np.cumsum(x[:, 1]), [rank(n, j) - base[j] + d for d in (-beside, 0, beside)])
            v = x[np.minimum(at, len(x) - 1), 0].tolist()
            if p["exact"]:
                answer[j] = v[1]
            else:
                pivots[3 * j : 3 * j + 3] = v
        return pivots, answer

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield each_group(b, ["proposals", "base", "top", "answer"], ["pivots", "answer"], chosen)

    all_of = lambda x: F.array_repeat(x, len(shares))
    nothing = all_of(F.lit(None).cast("double"))
    state = open_.select(*keys, "n", "pivots", nothing.alias("lo"), nothing.alias("hi"), all_of(F.lit(0).cast("bigint")).alias("base"), all_of(F.col("n")).alias("top"), nothing.alias("answer"))
    missing = F.exists("answer", lambda v: v.isNull())
    found = []
    for _ in range(ROUNDS):
        state = cut(_beside(state, _count(local, state, keys), keys).mapInArrow(narrow, schema))
        found.append(state.where(~missing).select(*keys, "n", "answer"))
        state = state.where(missing)
        if state.isEmpty():
            return union_all(found)
        held = _with_state(local.select(*keys, "values", "counts", "salt"), state.select(*keys, "lo", "hi", "answer"), keys)
        proposed = held.mapInArrow(propose, f"{_types(local, keys)}, j int, n bigint, exact boolean, values binary, salt int")
        gathered = _gathered(proposed, [*keys, "j"], salts, PROPOSALS, True).groupBy(*keys).agg(F.collect_list(F.struct("j", "exact", "values")).alias("proposals"))
        picked = _beside(state, gathered, keys).mapInArrow(pick, f"{_types(local, keys)}, n bigint, pivots array<double>, answer array<double>")
        picked = cut(_beside(picked, state.select(*keys, "lo", "hi", "base", "top"), keys))
        found.append(picked.where(~missing).select(*keys, "n", "answer"))
        state = picked.where(missing)
        if state.isEmpty():
            return union_all(found)
    raise RuntimeError(f"percentiles not found in {ROUNDS} rounds")


def summaries(rows: DataFrame, dims: list[str], measures: list[str], levels: dict[str, list[str]], epsilon: float = EPSILON) -> DataFrame:
    """level, dims, measure, n, values and salt: the number of a group's values and at most 4/epsilon weighted ones of them, for each
    part (task or file) of rows; rows, dims, measures and levels as for runs().

    Summaries of other days or files are combined by union; combined() reads percentiles off the union.
    """
    keys = ["level", *dims, "measure"]
    cells, local = math.ceil(4 / epsilon), runs(rows, dims, measures, levels)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("n"), _each(*_of_run(b), cells, False)[0], b.column("salt")], [*keys, "n", "values", "salt"])

    return local.mapInArrow(cells_of, f"{_types(local, keys)}, n bigint, values binary, salt int")


def combined(parts: DataFrame, keys: list[str], shares: list[float], epsilon: float = EPSILON) -> DataFrame:
    """keys, n and the percentiles of the union of summaries made with epsilon, ranks off by at most epsilon of n: a quarter from
    the parts' cells, an eighth or less from putting them together within salts."""
    names, types = _names(shares), _types(parts, keys)
    cells = math.ceil(1 / epsilon)
    gathered = _gathered(parts.select(*keys, "n", F.lit(True).alias("exact"), "values", "salt"), keys, SALTS, cells, False)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = _pairs(b.column("values"))
            n = b.column("n").to_numpy(zero_copy_only=False)
            found = _at_ranks(_sorted(x, off), off, [_ranks(n, q) for q in shares])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("n"), *[pa.array(v) for v in found]], [*keys, "n", *names])

    return gathered.mapInArrow(read, f"{types}, n bigint, {', '.join(f'{x} double' for x in names)}")


def rank_errors(rows: DataFrame, dims: list[str], measures: list[str], levels: dict[str, list[str]], found: DataFrame, shares: list[float]) -> DataFrame:
    """level, dims, measure, n, error: how far the ranks of found, percentiles of rows by group, lie from those asked for at most, as a
    share of n: 0 if a value has the rank."""
    keys = ["level", *dims, "measure"]
    local, found = cut(runs(rows, dims, measures, levels)), cut(found)
    counts = _count(local, found.select(*keys, F.array(*_names(shares)).alias("pivots")), keys)
    ranks = F.array(*[F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))).cast("bigint") for q in shares])
    off = F.array_max(F.transform("counts", lambda c: F.greatest(c["below"] + 1 - F.get("ranks", c["i"]), F.get("ranks", c["i"]) - c["upto"], F.lit(0))))
    return _beside(found.select(*keys, "n").withColumn("ranks", ranks), counts, keys).select(*keys, "n", (off / F.col("n")).alias("error"))

"""Distinct counts from logarithmic-base set registers.

Each identifier falls by its hash into one of a number of registers with a value 1 + floor(log_base(scale / x)), x exponential by
its hash; a register keeps the largest. Registers of a union are the larger of both, so partial results of days, files or
groups merge without loss. With n different identifiers a register stays at or below k with probability
exp(-n/registers (1 - exp(-scale base^-k))): counts, and for pairs union, intersection and Jaccard, are its maximum-likelihood
estimates. One register an identifier, rather than all, is touched: the law is the same, the work less by their
number. Base and number of registers are parameters (Law).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task sketches at a time.
CHUNK = 300_000


@dataclass(frozen=True)
class Law:
    """How registers are filled. registers: their number, a power of 2, 65,536 at most; base: of the logarithm, above 1; scale: values
    start where an exponential draw of this size lies. A smaller base costs larger values and tells more."""

    registers: int = 4096
    base: float = 1.05
    scale: float = 20.0

    def __post_init__(self) -> None:
        if not 1 <= self.registers <= 1 << 16 or self.registers & (self.registers - 1) or self.base <= 1 or self.top >= 1 << 16:
            raise ValueError("registers must be a power of 2 up to 65,536, and base above 1 by more than 0.0007")

    @property
    def top(self) -> int:
        """Largest value a register can have, with 52 bits of hash."""
        return int(np.ceil(np.log(self.scale * 2.0**53) / np.log(self.base))) + 2

    @property
    def bits(self) -> int:
        """Width of a value."""
        return int(self.top).bit_length()

    @property
    def error(self) -> float:
        """Relative standard error of a count; two of them are what is stated as the bound."""
        return float(np.sqrt((self.base + 1) / (self.base - 1) * np.log(self.base) - 1) / np.sqrt(self.registers))

    def above(self) -> np.ndarray:
        """Chance that an identifier raises a register above 0, 1, ..., top."""
        return 1 - np.exp(-self.scale * self.base ** -np.arange(self.top + 1).astype(float))


LAW = Law()
ERROR = LAW.error


def observe(h: np.ndarray, law: Law = LAW) -> tuple[np.ndarray, np.ndarray]:
    """Register and value for 64-bit hashes."""
    h = h.view(np.uint64)
    u = ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
    k = 1 + np.floor(np.log(law.scale / -np.log(u)) / np.log(law.base))
    return (h & np.uint64(law.registers - 1)).astype(np.int64), np.clip(k, 1, law.top).astype(np.int64)


def estimate(registers: list[np.ndarray], law: Law = LAW) -> np.ndarray:
    """Number of different identifiers for each (register, value) list, by maximum likelihood.

    While few registers are taken their number alone decides; else Newton steps on the logarithm of the count.
    """
    above = law.above()
    taken = np.array([len(r) for r in registers], dtype=float)
    n = -law.registers * np.log1p(-np.minimum(taken, law.registers - 0.5) / law.registers)
    full = np.flatnonzero(taken > law.registers / 20)
    for i in range(0, full.size, 256):
        part = full[i : i + 256]
        c = np.stack([np.bincount(registers[j][:, 1], minlength=law.top + 1) for j in part]).astype(float)
        c[:, 0] = law.registers - taken[part]
        used = np.flatnonzero(c.sum(0))
        c, hi, lo = c[:, used], above[used], np.where(used > 0, above[np.maximum(used - 1, 0)], np.inf)
        x = np.maximum(n[part], 1.0) / law.registers
        gap = np.where(used > 0, lo - hi, 0.0)
        for _ in range(40):
            # each register adds log(exp(-x hi) - exp(-x lo)); its slope is -hi + gap / (exp(x gap) - 1)
            z = np.minimum(x[:, None] * gap, 500)
            more = np.where(used > 0, gap / np.maximum(np.expm1(z), 1e-300), 0.0)
            first = (c * (more - hi)).sum(1)
            second = -(c * np.where(used > 0, more * (more + gap), 0.0)).sum(1)
            # in log x the curvature is x first + x^2 second
            curve = x * first + x * x * second
            step = np.where(curve < 0, -x * first / np.minimum(curve, -1e-12), np.sign(first) * 0.5)
            step = np.clip(step, -1, 1)
            x = x * np.exp(step)
            if np.abs(step).max() < 1e-9:
                break
        n[part] = x * law.registers
    return n


def joint(a: np.ndarray, b: np.ndarray, law: Law = LAW) -> tuple[float, float, float, float, float, float]:
    """Union, intersection and Jaccard of two (register, value) lists, and the standard error of each: Newton steps for the sizes
    of a only, b only and both under their joint law, on logarithms. The errors follow from the likelihood's curvature at its top
    (the observed information), for sizes that are all but none from the error of a count."""
    above, registers = law.above(), law.registers
    va, vb = np.zeros(registers, np.int64), np.zeros(registers, np.int64)
    va[a[:, 0]], vb[b[:, 0]] = a[:, 1], b[:, 1]
    pairs, c = np.unique(np.stack([va, vb]), axis=1, return_counts=True)
    na, nb = estimate([a, b], law)
    nu = estimate([_union(a, b)], law)[0]
    both = min(max(na + nb - nu, 0.001 * min(na, nb), 0.5), 0.999 * min(na, nb) + 0.5)
    t = np.log(np.maximum([na - both, nb - both, both], 0.25))
    below = lambda v: np.where(v > 0, above[np.maximum(v - 1, 0)], np.inf)
    ha, hb, la, lb = above[pairs[0]], above[pairs[1]], below(pairs[0]), below(pairs[1])

    def value(t: np.ndarray) -> float:
        x, y, z = np.exp(t) / registers
        f = lambda p, q: np.exp(-x * p - y * q - z * np.maximum(p, q))
        prob = f(ha, hb) - f(la, hb) - f(ha, lb) + f(la, lb)
        return float((c * np.log(np.maximum(prob, 1e-300))).sum())

    h = 1e-3

    def curve(t: np.ndarray, best: float) -> tuple[np.ndarray, np.ndarray]:
        e = np.eye(3) * h
        up, down = np.array([value(t + x) for x in e]), np.array([value(t - x) for x in e])
        hess = np.diag((up - 2 * best + down) / h**2)
        for i, j in combinations(range(3), 2):
            hess[i, j] = hess[j, i] = (value(t + e[i] + e[j]) - value(t + e[i] - e[j]) - value(t - e[i] + e[j]) + value(t - e[i] - e[j])) / (4 * h * h)
        return (up - down) / (2 * h), hess

    best = value(t)
    for _ in range(60):
        grad, hess = curve(t, best)
        w, v = np.linalg.eigh(hess)
        step = np.clip(v @ ((v.T @ grad) / np.maximum(np.abs(w), 1e-3)), -1, 1)
        while (new := value(t + step)) < best and np.abs(step).max() > 1e-7:
            step = step / 2
        if new < best or np.abs(step).max() < 1e-6:
            break
        t, best = t + step, new
    x, y, z = np.exp(t)
    n = x + y + z
    # by the logarithms of the sizes; information below that of a size that doesn't matter is taken as that
    w, v = np.linalg.eigh(-curve(t, best)[1])
    cov = (v / np.maximum(w, 1e-2)) @ v.T
    slopes = np.array([[x, y, z], [0, 0, z], [-x * z / n**2, -y * z / n**2, z / n - z * z / n**2]])
    sizes = np.minimum(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", slopes, cov, slopes), 0)), [law.error * n + 1, law.error * n + 1, law.error + 1 / n])
    return float(n), float(z), float(z / n), *map(float, sizes)


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return unpack(pack(np.concatenate([a, b])))


def pack(x: np.ndarray) -> bytes:
    """(register, value) rows, the largest value of each register, as bytes."""
    code = np.sort(x[:, 0] * 65_536 + x[:, 1])
    return code[np.r_[code[1:] >> 16 != code[:-1] >> 16, True][: code.size]].astype(np.uint32).tobytes()


def unpack(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint32).astype(np.int64)
    return np.stack([x >> 16, x & 65_535], 1)


def sketches(rows: DataFrame, dims: list[str], fields: list[str], law: Law = LAW) -> DataFrame:
    """level INT, dims as STRING, field, registers BINARY: a sketch of each field's different non-null values for every group of
    every combination of dims, of the dims that level names by their bits; the others are null.

    rows has dims and BIGINT fields under these names. Null dims are groups of their own. Sketches of the same group from other
    rows merge with merged(). Tasks pre-aggregate, so that a group that holds most rows reaches its merge as one sketch a task.
    """
    data = rows.select(*[F.col(d).cast("string").alias(d) for d in dims], *[F.when(F.col(f).isNotNull(), F.xxhash64(f)).alias(f) for f in fields])
    levels = range(2 ** len(dims))
    schema = ", ".join(["level int", *[f"{d} string" for d in dims], "field string", "registers binary"])

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = [table.column(d).combine_chunks().dictionary_encode(null_encoding="encode") for d in dims]
        index = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in coded]
        names = [x.dictionary.to_pylist() for x in coded]
        for f in fields:
            col = table.column(f).combine_chunks()
            ok = ~col.is_null().to_numpy(zero_copy_only=False)
            reg, val = observe(col.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), law)
            for level in levels:
                group = np.zeros(reg.size, np.int64)
                use = [i for i in range(len(dims)) if level >> i & 1]
                for i in use:
                    group = group * len(names[i]) + index[i][ok]
                code = np.sort((group * law.registers + reg) << law.bits | val)
                code = code[np.r_[code[1:] >> law.bits != code[:-1] >> law.bits, True][: code.size]]
                g = code >> law.bits
                g, r = g // law.registers, g % law.registers
                packed = (r * 65_536 + (code & (1 << law.bits) - 1)).astype(np.uint32)
                cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: g.size])
                out: dict[str, list] = {d: [None] * cut.size for d in dims}
                rest = g[cut].copy()
                for i in reversed(use):
                    out[dims[i]] = [names[i][k] for k in (rest % len(names[i])).tolist()]
                    rest //= len(names[i])
                ends = np.r_[cut[1:], g.size][: cut.size]
                yield pa.RecordBatch.from_arrays([pa.array([level] * cut.size, pa.int32()), *[pa.array(out[d], pa.string()) for d in dims], pa.array([f] * cut.size, pa.string()), pa.array([packed[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())], ["level", *dims, "field", "registers"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield from flush(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from flush(pa.Table.from_batches(held))

    return merged(data.mapInArrow(local, schema), ["level", *dims, "field"])


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch for each group, the registers' maxima over its parts, of which a task sends at most one for CHUNK rows; put together
    within salts first, so that no task has all parts of a group that every task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, first = None, [], None

        def closed() -> pa.RecordBatch:
            x = held[0] if len(held) == 1 else pack(unpack(b"".join(held)))
            return pa.RecordBatch.from_arrays([*[c for c in first], pa.array([x], pa.binary())], [*keys, "registers"])

        for b in batches:
            rows = list(zip(*[b.column(k).to_pylist() for k in keys], strict=True))
            change = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)]
            regs = b.column("registers").to_pylist()
            single: list[int] = []
            merged_regs: list[bytes] = []
            for s, e in zip(change, change[1:], strict=False):
                if s == e:
                    continue
                if rows[s] != key:
                    if key is not None:
                        yield closed()
                    if e < len(rows):
                        single.append(s)
                        merged_regs.append(regs[s] if e - s == 1 else pack(unpack(b"".join(regs[s:e]))))
                        key, held = None, []
                    else:
                        key, held, first = rows[s], regs[s:e], [b.column(k).slice(s, 1) for k in keys]
                else:
                    held += regs[s:e]
                    if len(held) > 64:
                        held = [pack(unpack(b"".join(held)))]
                    if e < len(rows):
                        yield closed()
                        key, held = None, []
            if single:
                take = pa.array(single)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in keys], pa.array(merged_regs, pa.binary())], [*keys, "registers"])
        if key is not None:
            yield closed()

    salt = F.pmod(F.xxhash64("registers"), F.lit(max(2, math.isqrt(parts.rdd.getNumPartitions()))))
    some = parts.repartition(*keys, salt).sortWithinPartitions(*keys).mapInArrow(run, parts.schema)
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, parts.schema)


def counts(sketched: DataFrame, law: Law = LAW) -> DataFrame:
    """sketched with its registers replaced by estimate, low and high: the count and its bound of two standard errors."""
    names = [c for c in sketched.columns if c != "registers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = estimate([unpack(x) for x in b.column("registers").to_pylist()], law)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n), pa.array(n * (1 - 2 * law.error)), pa.array(n * (1 + 2 * law.error))], [*names, "estimate", "low", "high"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in sketched.schema.fields if f.name != "registers"] + ["estimate double", "low double", "high double"])
    return sketched.mapInArrow(run, schema)


def overlaps(pairs: DataFrame, law: Law = LAW) -> DataFrame:
    """pairs (with registers a and b) with union_size, intersection_size and jaccard by joint maximum likelihood, and the standard error
    of each, absolute: union_error, intersection_error, jaccard_error."""
    names = [c for c in pairs.columns if c not in ("a", "b")]
    made = ["union_size", "intersection_size", "jaccard", "union_error", "intersection_error", "jaccard_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [joint(unpack(p), unpack(q), law) for p, q in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
            cols = list(zip(*got, strict=True)) if got else [[]] * len(made)
            yield pa.RecordBatch.from_arrays([*[x.column(c) for c in names], *[pa.array(v, pa.float64()) for v in cols]], [*names, *made])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name not in ("a", "b")] + [f"{c} double" for c in made])
    return pairs.mapInArrow(run, schema)

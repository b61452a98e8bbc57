"""Evaluation texts in a corpus: latent semantic retrieval, then exact checks.

Terms are the word trigrams of the test items, weighted by their IDF over all passages (blocks of WINDOW words) of the
corpus. A distributed randomised SVD of the items' TF-IDF passages gives a latent space of a quarter as many dimensions as
there are texts; windows of every document are compared with every passage and prompt there. What the space keeps of a text is
known, so that the latent product divided by it estimates the cosine in full; windows above LATENT are candidates, and those
whose exact cosine reaches COVER are compared in words. Items are taken in blocks of bounded size that every task holds, one after
another, however many there are. No weight lies below FLOOR of the greatest, and none grows beyond CAP, so that neither the
size of the corpus nor the number of copies in it decides what is compared.

Candidates are aligned by longest common subsequence of words; a case needs SPAN words of the item found in order, by weight, so
that stock phrases with other content between them don't count. A paraphrase, of which less is found, counts if the document
gives the item's answer as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, union_all

GRAM, WINDOW, STEP = 3, 24, 8
#: Dimensions of the latent space as a share of the texts, but so many at least; more for the iteration; passes after the first.
REDUCED, LEAST_RANK, OVER, POWER, SEED = 0.25, 64, 8, 1, 11
#: Texts (passages and prompts) of a block of items.
BLOCK_TEXTS = 640
#: Least estimate by the latent space, on COVER's scale, of a candidate, in a space of a REDUCED share of the dimensions, which lets texts
#: that share phrases add to each other; the less is reduced the closer to COVER.
LATENT = 0.6
#: Least cosine of a window and a text, as a share of the cosine that a window copied from the text would have.
COVER = 0.38
#: Greatest IDF that counts, also for words that no item has; the least weight of an item's term in COVER as a share of it. 12 of a window's
#: 22 terms reach COVER at the least weight: a copy of SPAN words with two of them changed, where STEP cuts it worst.
CAP, FLOOR = 9.0, 0.75
#: Consecutive words of an item that make a case; the share of their weight found in order: alone, and for pairs with a high cosine.
SPAN, FOUND, FOUND_NEAR, NEAR = 25, 0.9, 0.84, 0.6
#: Share and cosine that are enough if the document gives the answer.
FOUND_ANSWERED, NEAR_ANSWERED = 0.78, 0.5
#: Words of the document about a window that are aligned.
AROUND = 40
#: Windows of a document that are compared at a time.
GROUP = 64

_JOIN, _WORD = re.compile(r"[-‐‑\xad](?<=\w.)\s*(?=\w)"), re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Lower-case words; hyphens, also those at line ends, join."""
    return _WORD.findall(_JOIN.sub("", text.lower()))


def grams(ids: np.ndarray) -> np.ndarray:
    """A number for each GRAM words on; 0 where one of them isn't in the vocabulary."""
    n = max(0, ids.size - GRAM + 1)
    x, h, known = ids.astype(np.uint64), np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : n + k]
        known &= ids[k : n + k] > 0
    return np.where(known, h | np.uint64(1), np.uint64(0))


@dataclass
class Items:
    """Different texts (passages and prompts) of the items: their owners (item numbers), word numbers and term numbers."""

    names: list[str]
    answers: list[list[str]]
    vocabulary: dict[str, int]
    owners: list[list[int]] = field(default_factory=list)
    ids: list[np.ndarray] = field(default_factory=list)
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    rows: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def of(rows: list) -> Items:
        """rows with item_id, prompt, passage, answer; null and empty texts are left out, equal ones kept once with all their items."""
        by: dict[tuple[str, ...], list[int]] = {}
        for i, r in enumerate(rows):
            for t in (r["passage"], r["prompt"]):
                if t and (w := tuple(words(t))):
                    mine = by.setdefault(w, [])
                    if i not in mine:
                        mine.append(i)
        answers = [words(r["answer"] or "") for r in rows]
        # answers' words have numbers, so that they can be found in documents, but make no terms
        voc = {w: k + 1 for k, w in enumerate(sorted({w for t in [*by, *answers] for w in t}))}
        out = Items([r["item_id"] for r in rows], answers, voc)
        for t, owners in by.items():
            out.owners.append(owners)
            out.ids.append(np.array([voc[w] for w in t], dtype=np.int32))
        if out.ids:
            out.terms = np.unique(np.concatenate([grams(x) for x in out.ids]))
        out.rows = [out.term(grams(x)) for x in out.ids]
        return out

    def term(self, h: np.ndarray) -> np.ndarray:
        """Term numbers; the number of terms where it is none."""
        n = self.terms.size
        if not n:
            return np.zeros(h.size, np.int64)
        p = np.minimum(np.searchsorted(self.terms, h), n - 1)
        return np.where((self.terms[p] == h) & (h > 0), p, n)


def encode(texts: list[str | None], voc: dict[str, int]) -> list[bytes]:
    """Word numbers of each text (0: not in the vocabulary), as bytes; a null text is empty."""
    get, kind = voc.get, np.uint16 if len(voc) < 65_535 else np.int32
    return [np.array([get(w, 0) for w in words(t)] if t else [], dtype=kind).tobytes() for t in texts]


def _docs(batch: pa.RecordBatch, voc: int) -> list[np.ndarray]:
    kind = np.uint16 if voc < 65_535 else np.int32
    return [np.frombuffer(x, dtype=kind).astype(np.int32) for x in batch.column("ids").to_pylist()]


def term_weights(encoded: DataFrame, items: Items) -> tuple[np.ndarray, float, np.ndarray]:
    """IDF of each term (and last 0, for none) as a share of CAP, 1 at most; that of an unseen term; and IDF of each word, over all passages of the corpus."""
    nt, nw = items.terms.size, len(items.vocabulary) + 1

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(nt + 1 + nw, np.int64), 0
        for b in batches:
            docs = [ids for ids in _docs(b, nw - 1) if ids.size]
            for i in range(0, len(docs), 64):
                some = docs[i : i + 64]
                for x, low, width in ((some, nt + 1, nw), ([items.term(grams(ids)) for ids in some], 0, nt + 1)):
                    sizes = np.array([-(-v.size // WINDOW) for v in x])
                    kind = np.int32 if int(sizes.sum()) * width < 2**31 else np.int64
                    first = np.cumsum(sizes) - sizes
                    codes = np.concatenate([(np.arange(v.size, dtype=kind) // WINDOW + kind(f)) * kind(width) + v.astype(kind) for v, f in zip(x, first.tolist(), strict=True)])
                    codes.sort()
                    codes = codes[np.r_[True, codes[1:] != codes[:-1]][: codes.size]]
                    df += np.bincount(codes % width + low, minlength=df.size)
                    n += int(sizes.sum()) if low else 0
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"k": pa.array([*k, -1], pa.int32()), "n": pa.array([*df[k], n], pa.int64())})

    df, n = np.zeros(nt + 1 + nw), 0
    for r in encoded.select("ids").mapInArrow(counts, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["k"] < 0:
            n = r["n"]
        else:
            df[r["k"]] = r["n"]
    idf = np.log((2 + n) / (1 + df))
    idf[nt] = idf[nt + 1] = 0
    return np.minimum(idf[: nt + 1] / min(CAP, np.log(2 + n)), 1) if n else idf[: nt + 1], 1.0, idf[nt + 1 :]


def gate(idf: np.ndarray) -> np.ndarray:
    """Weights of the terms for COVER: at least FLOOR, but for the last, which is none."""
    return np.r_[np.maximum(idf[:-1], FLOOR), 0.0]


def _tf_idf(rows: list[np.ndarray], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and unit-length weights of each text."""
    out = []
    for r in rows:
        t, n = np.unique(r[r < idf.size - 1], return_counts=True)
        v = n * idf[t]
        out.append((t, v / max(np.linalg.norm(v), 1e-9)))
    return out


def latent_space(spark, items: Items, idf: np.ndarray) -> np.ndarray:
    """(terms + 1, rank) orthonormal basis by randomised SVD: in each pass every partition of the texts makes its part of A'AQ,
    and the parts are added up by term in the executors."""
    nt = items.terms.size
    texts = _tf_idf(items.rows, gate(idf))
    rank = min(max(math.ceil(REDUCED * len(texts)), LEAST_RANK), len(texts), nt)
    width = min(rank + OVER, len(texts), nt)
    passages = spark.createDataFrame(pd.DataFrame({"text": range(len(texts))})).repartition(max(1, len(texts) // 128), "text")
    q = np.random.default_rng(SEED).standard_normal((nt, width)).astype(np.float32)
    for _ in range(1 + POWER):
        held = spark.sparkContext.broadcast(q)

        def product(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [texts[k] for k in b.column("text").to_pylist()]
                if not own:
                    continue
                cols = np.unique(np.concatenate([t for t, _ in own]))
                a = np.zeros((len(own), cols.size), np.float32)
                for i, (t, v) in enumerate(own):
                    a[i, np.searchsorted(cols, t)] = v
                z = a.T @ (a @ held.value[cols])
                for i in range(0, cols.size, 4096):
                    yield pa.RecordBatch.from_pydict({"term": pa.array(cols[i : i + 4096], pa.int32()), "z": pa.array([x.tobytes() for x in z[i : i + 4096]], pa.binary())})

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = [np.sum([np.frombuffer(x, np.float32) for x in row], 0).tobytes() for row in b.column("zs").to_pylist()]
                yield pa.RecordBatch.from_pydict({"term": b.column("term"), "z": pa.array(z, pa.binary())})

        sums = passages.mapInArrow(product, "term int, z binary").groupBy("term").agg(F.collect_list("z").alias("zs")).mapInArrow(added, "term int, z binary")
        q = np.zeros((nt, width), np.float32)
        for row in sums.toLocalIterator():
            q[row["term"]] = np.frombuffer(row["z"], np.float32)
        held.unpersist()
        held.destroy()
        q = _orthonormal(q)
    return np.vstack([q[:, :rank], np.zeros((1, q[:, :rank].shape[1]), np.float32)])


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """Left singular vectors of z, the leading first, through its small Gram matrix; directions without energy are dropped."""
    value, vector = np.linalg.eigh((z.T @ z).astype(np.float64))
    keep = value > value[-1] * 1e-9
    return z @ (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)[:, ::-1]


def lcs_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions in a and b of one longest common subsequence; 0 matches nothing. Bit-parallel over a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        if x:
            at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, [full]
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a) - 1, len(b)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1
        elif not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append((i, j - 1))
            i, j = i - 1, j - 1
    return out[::-1]


def span_found(item: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> float:
    """The largest share, by weight, of SPAN consecutive words of item that a longest common subsequence with doc holds.

    The item is cut about the diagonal on which most words of its grams agree, so that far pieces cannot add up.
    """
    gi, gd = grams(item), grams(doc)
    order = np.argsort(gi, kind="stable")
    lo, hi = np.searchsorted(gi[order], gd), np.searchsorted(gi[order], gd, "right")
    hits = np.flatnonzero((hi > lo) & (gd > 0))
    if hits.size:
        diagonal = np.concatenate([order[lo[k] : hi[k]] - k for k in hits])
        values, n = np.unique(diagonal // 4, return_counts=True)
        shift = int(values[np.argmax(n)]) * 4
        item = item[max(0, shift - 12) : max(0, shift + doc.size + 16)]
    if item.size == 0:
        return 0.0
    got, w = np.zeros(item.size), weight[item]
    for p, _ in lcs_pairs(item.tolist(), doc.tolist()):
        got[p] = w[p]
    one = np.ones(min(SPAN, item.size))
    return float((np.convolve(got, one, "valid") / np.maximum(np.convolve(w, one, "valid"), 1e-9)).max())


@dataclass
class Search:
    """What every task holds."""

    items: Items
    idf: np.ndarray
    unseen: float
    weight: np.ndarray
    space: np.ndarray
    #: What a term adds to a window's latent vector; the texts' vectors by what the space keeps of them; the texts that have each term.
    adds: np.ndarray = None
    texts: np.ndarray = None
    member: np.ndarray = None
    #: Items with an answer; where its word numbers begin in all of them; these; and as texts.
    asked: tuple | None = None
    #: All texts' words one after another; where each begins; how many words are to be found at once; the weight of that many from each word on.
    flat: np.ndarray = None
    first: np.ndarray = None
    span: np.ndarray = None
    full: np.ndarray = None

    def __post_init__(self) -> None:
        self.gate = gate(self.idf)
        self.squared = self.gate**2
        # a term counts once for a text, else a phrase that the text repeats would make up for terms that are missing
        own, nt = [np.unique(r) for r in self.items.rows], self.idf.size - 1
        self.adds = self.gate[:, None].astype(np.float32) * self.space
        latent, whole = np.array([self.gate[r] @ self.space[r] for r in own]), np.array([(self.gate[r] ** 2).sum() for r in own])
        kept = (latent**2).sum(1) / np.maximum(whole, 1e-9)
        self.texts = np.ascontiguousarray((latent / np.maximum(kept, 1e-3)[:, None]).T, dtype=np.float32)
        self.least = COVER + (LATENT - COVER) * max(0.0, 1 - self.space.shape[1] / len(own)) / (1 - REDUCED)
        self.space = None
        self.member = np.zeros((nt + 1, len(own)), bool)
        for k, r in enumerate(own):
            self.member[r[r < nt], k] = True
        self.size = np.array([x.size for x in self.items.ids])
        self.flat, self.first, self.span = np.concatenate(self.items.ids), np.cumsum(self.size) - self.size, np.minimum(SPAN, self.size)
        self.full = np.full(self.flat.size, np.inf)
        for x, a, k in zip(self.items.ids, self.first.tolist(), self.span.tolist(), strict=True):
            self.full[a : a + x.size - k + 1] = np.maximum(np.convolve(self.weight[x], np.ones(k), "valid"), 1e-9)

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first word, text, cosine by the best attainable) for windows of one document: those near by the latent space whose exact
        cosine reaches COVER, too."""
        size = WINDOW - GRAM + 1
        t = self.items.term(grams(ids))
        if not t.size:
            return
        known = self.squared[t]
        all_of = np.r_[0, np.cumsum(np.where(t < self.idf.size - 1, known, self.unseen**2))]
        known = np.r_[0, np.cumsum(known)]
        start = np.r_[np.arange(0, max(1, t.size - size + 1), STEP), max(0, t.size - size)]
        end = np.minimum(start + size, t.size)
        energy = all_of[end] - all_of[start]
        keep = known[end] - known[start] >= COVER * energy
        start, end, energy = start[keep], end[keep], energy[keep]
        if not start.size:
            return
        for i in range(0, start.size, GROUP):
            a, b = start[i : i + GROUP], end[i : i + GROUP]
            # known terms are fetched once, into memory that stays; the windows add them up
            first, last = int(a[0]), int(b[-1])
            known = first + np.flatnonzero(t[first:last] < self.idf.size - 1)
            rows = np.take(self.adds, t[known], axis=0, out=self._room(known.size), mode="clip")
            x = ((known >= a[:, None]) & (known < b[:, None])).astype(np.float32) @ rows
            at = np.flatnonzero(x @ self.texts >= (self.least * energy[i : i + GROUP, None]).astype(np.float32))
            if not at.size:
                continue
            j, k = np.divmod(at, self.texts.shape[1])
            inside = np.minimum(a[j, None] + np.arange(size), t.size - 1)
            held = np.where(a[j, None] + np.arange(size) < b[j, None], t[inside], self.idf.size - 1)
            cover = (self.member[held, k[:, None]] * self.squared[held]).sum(1) / energy[i + j]
            for z in np.flatnonzero(cover >= COVER).tolist():
                yield int(a[j[z]]), int(k[z]), float(cover[z])

    def _room(self, n: int) -> np.ndarray:
        """n rows of memory that stays."""
        if getattr(self, "_buffer", None) is None or len(self._buffer) < n:
            self._buffer = np.empty((max(n, 4 * GROUP * STEP), self.adds.shape[1]), np.float32)
        return self._buffer[:n]

    def most(self, texts: np.ndarray, which: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
        """What span_found cannot exceed for each of texts and docs[which]: the share of words that the document has at all, in any order."""
        n = self.size[texts]
        start = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(self.first[texts] - start, n)
        has = np.zeros((len(docs), self.weight.size))
        for i, x in enumerate(docs):
            has[i, x] = self.weight[x]
        c = np.zeros(at.size + 1)
        np.cumsum(has.ravel()[self.flat[at] + np.repeat(which * self.weight.size, n)], out=c[1:])
        end = np.minimum(np.arange(at.size) + np.repeat(self.span[texts], n), at.size)
        return np.maximum.reduceat((c[end] - c[:-1]) / self.full[at], start)

    def near(self, ids: np.ndarray, k: int) -> float:
        """Cosine of a window and a text as in COVER, but exact and by IDF, so that frequent terms count little."""
        t = self.items.term(grams(ids))
        of = np.isin(t, self.items.rows[k]) & (t < self.idf.size - 1)
        own = float((self.idf[t[of]] ** 2).sum())
        return own / max(own + self.unseen**2 * float((~of).sum()), 1e-9)

    def answered(self, ids: np.ndarray) -> set[int]:
        """The items whose answer the document gives, all its words in order and together."""
        if self.asked is None:
            coded = [[self.items.vocabulary.get(w, 0) for w in a] for a in self.items.answers]
            own = [(i, a) for i, a in enumerate(coded) if a and 0 not in a]
            self.asked = [i for i, _ in own], np.cumsum([0, *[len(a) for _, a in own]])[:-1], np.array([w for _, a in own for w in a], np.int64), [f" {' '.join(map(str, a))} " for _, a in own]
        who, first, flat, text = self.asked
        if not who:
            return set()
        has = np.zeros(self.weight.size, bool)
        has[ids] = True
        likely = np.flatnonzero(np.logical_and.reduceat(has[flat], first)).tolist()
        whole = f" {' '.join(map(str, ids.tolist()))} " if likely else ""
        return {who[k] for k in likely if text[k] in whole}

    def found(self, ids: np.ndarray) -> tuple[dict[int, float], set[int]]:
        """Best share by text, of the texts that the document gives away, and the items it answers if there are any candidates."""
        best: dict[int, float] = {}
        some, worth = list(self.candidates(ids)), []
        given = self.answered(ids) if some else set()
        helped = {k for k, own in enumerate(self.items.owners) if given.intersection(own)} if given else given
        for i in range(0, len(some), GROUP):
            part = some[i : i + GROUP]
            windows, which = np.unique([at for at, _, _ in part], return_inverse=True)
            most = self.most(np.array([k for _, k, _ in part]), which, [ids[max(0, at - AROUND) : at + WINDOW + AROUND] for at in windows.tolist()])
            worth += [c for c, m in zip(part, most.tolist(), strict=True) if m >= (FOUND_ANSWERED if c[1] in helped else FOUND_NEAR) - 1e-9]
        tried: dict[int, list[int]] = {}
        for at, k, _ in sorted(worth, key=lambda c: -c[2]):
            # a piece of SPAN words about a window lies whole in what was aligned about one this close, which had the higher cosine
            if k not in best and all(abs(at - x) > AROUND - SPAN for x in tried.get(k, ())):
                tried.setdefault(k, []).append(at)
                share = span_found(self.items.ids[k], ids[max(0, at - AROUND) : at + WINDOW + AROUND], self.weight)
                if share >= FOUND or share >= (FOUND_ANSWERED if k in helped else FOUND_NEAR) and self.near(ids[at : at + WINDOW], k) >= (NEAR_ANSWERED if k in helped else NEAR):
                    best[k] = share
        return best, given


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks of BLOCK_TEXTS texts at most; the driver holds one at a time."""
    held: list = []
    for r in items.select("item_id", "prompt", "passage", "answer").toLocalIterator():
        held.append(r)
        if 2 * len(held) + 2 > BLOCK_TEXTS:
            yield held
            held = []
    if held:
        yield held


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, share, answered: one row per document of documents(doc_id, text) and item of
    items(item_id, prompt, passage, answer) of which it contains SPAN consecutive words of passage or prompt.

    answered: the item's answer stands in the document, all its words in order and together; less of the words is then enough.
    Null and empty texts contain nothing; repeated documents and items each come out; texts are searched whole, however long.
    Items shorter than SPAN words count if found whole. Empty tables give no rows.
    """
    parts = [_leaks(documents, Items.of(block)) for block in _blocks(items)]
    return union_all(parts) if parts else documents.sparkSession.createDataFrame([], SCHEMA)


SCHEMA = "doc_id bigint, item_id string, share double, answered boolean"


def _leaks(documents: DataFrame, own: Items) -> DataFrame:
    spark = documents.sparkSession
    if not own.terms.size:
        return spark.createDataFrame([], SCHEMA)
    voc = own.vocabulary

    def encoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array(encode(b.column("text").to_pylist(), voc), pa.binary())})

    encoded = cut(documents.select("doc_id", "text").mapInArrow(encoding, "doc_id bigint, ids binary"))
    if encoded.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    idf, unseen, weight = term_weights(encoded, own)
    shared = spark.sparkContext.broadcast(Search(own, idf, unseen, weight, latent_space(spark, own, idf)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            out: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), _docs(b, len(voc)), strict=True):
                by: dict[int, float] = {}
                best, given = s.found(ids)
                for k, share in best.items():
                    for i in s.items.owners[k]:
                        by[i] = max(share, by.get(i, 0.0))
                out += [(doc, s.items.names[i], share, i in given) for i, share in by.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], ["doc_id", "item_id", "share", "answered"])

    return encoded.mapInArrow(search, SCHEMA)

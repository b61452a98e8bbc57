"""Template residue: placeholders, filler, error messages and script notices in place of content.

Character n-gram models: one of the corpus itself, counted over all documents, one of placeholders and one of residue
passages, both fitted on the texts of residue_seeds. The log-likelihood ratio, summed over the best stretch of a line,
localises residue; a sentence counts if such stretches cover most of it, so that rulings that mention such wording in
passing don't. Placeholders count wherever they stand outside quotation marks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import residue_seeds

#: Symbols: letters (without case or accent), a digit for all, these marks, and one for all else.
MARKS = " \n.,;:'\"()[]{}<>%$_/-=“”«»@#|&•"
#: Those of them that placeholders are made with.
BRACKETS = "[]{}<>%$_=«»@#|&•"
SIZE, ORDER = 28 + len(MARKS), 4
#: Evidence in nats: what a character costs a stretch, less among placeholders whose letters are neutral, and the least sum of a stretch that counts.
COST, COST_FIELD, LEAST, LEAST_FIELD, LEAST_LITERAL = 0.25, 0.1, 13.0, 7.9, 16.0
#: Multiple of the evidence from which the first fit takes a document out of natural prose; weight of the passages found in
#: the corpus, as a share of the samples'.
STRICT, SELF = 1.5, 0.5
#: Share of a sentence that residue must cover.
COVERED = 0.6
#: Step of the stored ratios, and the greatest.
UNIT, LIMIT = 0.0625, 7.9
WINDOW = 12

_FOLD = str.maketrans("àáâäèéêëìíîïòóôöùúûüç’‘‑–—●", "aaaaeeeeiiiioooouuuuc''---•")


def _codes() -> np.ndarray:
    code = np.full(0x3000, 27, np.int64)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        code[ord(c)] = code[ord(c.upper())] = i
    code[ord("0") : ord("9") + 1] = 26
    for i, c in enumerate(MARKS):
        code[ord(c)] = 28 + i
    for a, b in _FOLD.items():
        code[a] = code[ord(b) if isinstance(b, str) else b]
        if (up := ord(chr(a).upper())) < 0x3000 and chr(a).isalpha():
            code[up] = code[a]
    return code


CODE = _codes()


def symbols(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return CODE[np.minimum(x, CODE.size - 1)]


def ngrams(s: np.ndarray) -> np.ndarray:
    """Number of the n-gram that ends at each symbol; before the first stand line ends."""
    s = np.r_[np.full(ORDER - 1, 29), s]
    n = s.size - ORDER + 1
    out = s[:n].copy()
    for k in range(1, ORDER):
        out *= SIZE
        out += s[k : n + k]
    return out


def conditional(counts: np.ndarray, size: int = SIZE, strength: float = 6.0) -> np.ndarray:
    """Log probability of the last of size symbols of every n-gram given the others, lower orders interpolated. Single precision
    and in place, as the driver makes several of them."""
    p = np.full(size, 1 / size, np.float32)
    for order in range(1, ORDER + 1):
        c = (counts.astype(np.float32) if order == ORDER else counts.reshape(-1, size**order).sum(0, dtype=np.float64).astype(np.float32)).reshape(-1, size)
        total = c.sum(1, keepdims=True)
        view, lower = c.reshape(-1, *p.reshape(-1, size).shape), p.reshape(1, -1, size)
        view += strength * lower
        c /= total + strength
        p = c.reshape(-1)
    return np.log(p, out=p)


def _shapes() -> np.ndarray:
    """Number of each n-gram when all letters are one symbol, the first."""
    shape = np.r_[np.zeros(26, np.int32), np.arange(1, SIZE - 25, dtype=np.int32)]
    out = np.zeros(1, np.int32)
    for _ in range(ORDER):
        out = (out[:, None] * (SIZE - 25) + shape).reshape(-1)
    return out


def count(texts: list[str]) -> np.ndarray:
    return np.bincount(np.concatenate([ngrams(symbols(t)) for t in texts]), minlength=SIZE**ORDER)


def corpus_counts(documents: DataFrame, parts: Callable[[str], list[list[str]]] = lambda t: [[t]], kinds: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """N-grams and their counts of all texts, or of as many kinds of texts as parts makes of each; the driver gets no more rows
    than there are n-grams of each kind."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(SIZE**ORDER, np.int32) for _ in range(kinds)]
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                made = [parts(t) for t in b.column("text").slice(i, 1000).to_pylist() if t]
                for kind in range(kinds):
                    texts = [x for m in made for x in m[kind]]
                    if texts:
                        total[kind] += count(texts).astype(np.int32)
        for kind in range(kinds):
            k = np.flatnonzero(total[kind])
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(k.size, kind), pa.int32()), "k": pa.array(k, pa.int32()), "n": pa.array(total[kind][k], pa.int64())})

    sums = documents.select("text").mapInArrow(local, "kind int, k int, n bigint").groupBy("kind", "k").agg(F.sum("n").alias("n"))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * kinds
    for r in sums.groupBy("kind").agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("n")).toLocalIterator():
        out[r["kind"]] = (np.array(r["k"], np.int64), np.array(r["n"], np.int64))
    return out


def _stored(ratio: np.ndarray) -> np.ndarray:
    """Of floats that are overwritten."""
    np.clip(ratio, -LIMIT, LIMIT, out=ratio)
    ratio /= UNIT
    return np.rint(ratio, out=ratio).astype(np.int8)


def _dense(sums: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(SIZE**ORDER, np.float32)
    out[sums[0]] = sums[1]
    return out


def _is(chars: str) -> np.ndarray:
    out = np.zeros(SIZE, bool)
    out[[28 + MARKS.index(c) for c in chars]] = True
    return out


def _holds_any(chars: str) -> np.ndarray:
    """Whether each n-gram holds one of chars."""
    out = np.zeros(1, bool)
    for _ in range(ORDER):
        out = (out[:, None] | _is(chars)).reshape(-1)
    return out


def _of_marks() -> np.ndarray:
    """Whether each n-gram is evidence for a placeholder: a mark or digit with one of BRACKETS about it, or a letter after "["."""
    letter = np.r_[np.ones(26, bool), np.zeros(SIZE - 26, bool)] | _is(" ")
    letter[27] = True
    return np.where(np.tile(letter, SIZE ** (ORDER - 1)), _holds_any("["), _holds_any(BRACKETS))


def ratios(corpus: np.ndarray, found: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood ratios against the corpus of each n-gram, in units of UNIT: for placeholders, words left in their place, and
    residue passages, whose counts those found in the corpus join. A byte each, as every task holds them.

    What a field is called says nothing: in the model of placeholders all letters are one and neutral, but after "[", which
    rulings have too. Its marks, but "[" and "_", are held against how rare they are in the corpus whatever stands before
    them, as in their usual places they may be residue for the most part.
    """
    natural, last = conditional(corpus), np.arange(SIZE**ORDER, dtype=np.int32) % SIZE
    single = corpus.reshape(-1, SIZE).sum(0, dtype=np.float64)

    def against(counts: np.ndarray) -> np.ndarray:
        x = conditional(counts)
        x -= natural
        return _stored(x)

    passages = count([f"\n{t}\n" for t in residue_seeds.passages()]).astype(np.float32)
    if found is not None and found.any():
        passages += found * (SELF * passages.sum() / found.sum())
    passages = against(passages)
    passages[last == 27] = 0  # a symbol without a number of its own says nothing
    words = count([f" {t} " for t in residue_seeds.literals()]).astype(np.float32)
    literals = against(words)
    literals[(words == 0) & (literals > 0)] = 0  # words count only as the samples have them
    del words
    marks = natural.reshape(-1, SIZE)
    for c in np.flatnonzero(_is(BRACKETS) & ~_is("[]_")).tolist():
        marks[:, c] = np.log((single[c] + 1) / (single.sum() + SIZE))
    seeds = count([x for t in residue_seeds.placeholders() for x in (f"ab {t} ab", f"ab\n{t}\nab", f"ab: {t}, ab", f"ab ({t}).", f"\n\n{t} ab. ab")]).astype(np.float32)
    size, shapes, at = SIZE - 25, _shapes(), np.flatnonzero(seeds)
    shaped, square = conditional(np.bincount(shapes[at], seeds[at], size**ORDER), size), _holds_any("[")
    seeds = conditional(seeds)
    np.copyto(seeds, shaped[shapes], where=~square)
    del shapes
    seeds -= natural
    fields = _stored(seeds)
    fields[~_of_marks()] = 0
    return fields, literals, passages


def score(ratio: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio at each n-gram."""
    return ratio[g] * np.float32(UNIT)


def stretches(llr: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Start, end and sum of the stretches whose sum, less COST a symbol, reaches least; each as far as its highest sum."""
    c = np.r_[0.0, np.cumsum(llr - COST)]
    out, i = [], 0
    while i < llr.size:
        low = np.minimum.accumulate(c[i:])
        gain = c[i:] - low
        hit = np.flatnonzero(gain >= least)
        if not hit.size:
            break
        h = int(hit[0])
        start = i + int(np.flatnonzero(c[i : i + h + 1] == low[h])[-1])
        after = np.flatnonzero(c[i + h :] <= c[start])
        stop = i + h + (int(after[0]) if after.size else c.size - i - h)
        peak = start + int(np.argmax(c[start:stop]))
        out.append((start, peak, float(c[peak] - c[start])))
        i = max(peak, start + 1)
    return out


_QUOTED = re.compile(r"“[^”\n]*”|\"[^\"\n]*\"|‘[^’\n]*’|«[^»\n]*[ \W][^»\n]*»")
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?!\s|$)[^.!?\n]*)*[.!?]*\s*")
_NUMBER = re.compile(r"^\s*(?:[(\[§]?\s*\d+\s*[)\].]?\s+)")


def residue_sentences(text: str, passage: np.ndarray, times: float = 1.0) -> list[tuple[int, int]]:
    """Sentences that residue covers for the most part."""
    p = score(passage, ngrams(symbols(_QUOTED.sub(lambda m: " " * len(m.group()), text))))
    out = []
    for a, b, _ in stretches(p, times * LEAST):
        start, end = text.rfind("\n", 0, a + 1) + 1, text.find("\n", b)
        end = len(text) if end < 0 else end
        m = _NUMBER.match(text[start:end])
        start += m.end() if m else 0
        for s in _SENTENCE.finditer(text, start, end):
            x, y = s.span()
            if y - x >= 8 and x < b and y > a and covered(p[x:y]) >= COVERED:
                out.append((x, y))
    return out


def has_field(text: str, field: np.ndarray, literal: np.ndarray, times: float = 1.0) -> bool:
    """Whether a text holds a placeholder or a word left in its place outside quotation marks; times: multiple of the evidence needed."""
    g = ngrams(symbols(_QUOTED.sub(lambda m: " " * len(m.group()), text)))
    return _peak(score(field, g), COST_FIELD) >= times * LEAST_FIELD or _peak(score(literal, g)) >= times * LEAST_LITERAL


def _peak(llr: np.ndarray, cost: float = COST) -> float:
    """The largest sum of a stretch."""
    c = np.cumsum(llr - cost)
    return float((c - np.minimum.accumulate(np.minimum(c, 0))).max()) if llr.size else 0.0


def residue_in(text: str, field: np.ndarray, literal: np.ndarray, passage: np.ndarray) -> bool:
    """Whether a text holds residue."""
    return has_field(text, field, literal) or bool(residue_sentences(text, passage))


def covered(llr: np.ndarray) -> float:
    """Share of symbols in windows of WINDOW whose mean ratio is positive."""
    n = min(WINDOW, llr.size)
    good = np.convolve(llr - COST, np.ones(n), "valid") > 0
    return float((np.convolve(good, np.ones(n), "full") > 0).mean())


def _holds(text: str, field: np.ndarray, literal: np.ndarray, passage: np.ndarray) -> bool:
    """residue_in, after a cheaper test that most texts fail."""
    g = ngrams(symbols(text))
    if _peak(score(field, g), COST_FIELD) >= LEAST_FIELD or _peak(score(literal, g)) >= LEAST_LITERAL:
        return residue_in(text, field, literal, passage)
    return _peak(score(passage, g)) >= LEAST and bool(residue_sentences(text, passage))


def _strict(text: str, field: np.ndarray, literal: np.ndarray, passage: np.ndarray) -> list[list[str]]:
    """The text if the first fit finds residue in it, and its sentences of strong evidence."""
    fits = _peak(score(passage, ngrams(symbols(text)))) >= STRICT * LEAST
    sentences = [text[a:b] for a, b in residue_sentences(text, passage, STRICT)] if fits else []
    return [[text] if sentences or has_field(text, field, literal) else [], [f"\n{s.strip()}\n" for s in sentences]]


def residue(documents: DataFrame, corpus: np.ndarray | None = None) -> DataFrame:
    """doc_id of each document of documents(doc_id, text) that holds residue.

    Null and empty texts hold none; texts are read whole; repeated documents each come out. corpus: n-gram counts of natural
    prose; by default those of all the documents given, less those that the model of all of them finds residue in, whose
    residue sentences join the samples that residue is fitted on.
    """
    context, found = documents.sparkSession.sparkContext, None
    if corpus is None:
        corpus = _dense(corpus_counts(documents)[0])
        first = context.broadcast(ratios(corpus))
        (at, n), sentences = corpus_counts(documents, lambda t: _strict(t, *first.value), 2)
        corpus[at] = np.maximum(corpus[at] - n, 0)
        first.unpersist()
        found = _dense(sentences)
    shared = context.broadcast(ratios(corpus, found))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            texts = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc for doc, t in texts if t and _holds(t, *models)], pa.int64())})

    return documents.select("doc_id", "text").mapInArrow(find, "doc_id bigint")

import os
import random

import numpy as np
import pandas as pd
import pytest
from panelith.llm import leaks

SCHEMA = "doc_id bigint, text string, item_id string, ids string"
ITEM = "item_id string, prompt string, passage string, answer string, text string"


def prose(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def world():
    rng = random.Random(5)
    pool = [f"w{i}x" for i in range(400)]
    stock = "the appeal is dismissed and each side bears its own costs"
    items = []
    for i in range(12):
        items.append((f"e{i}", prose(rng, 45, pool), f"{prose(rng, 60, pool)} {stock}. {prose(rng, 40, pool)}", f"answer {i}", "x"))
    items.append(("shared", prose(rng, 45, pool), items[0][2], None, "x"))
    items.append(("empty", None, "", None, None))
    docs, truth = [], set()
    for d in range(60):
        text = f"{prose(rng, 150, pool)} {stock}. {prose(rng, 150, pool)}"
        if d % 3 == 0:
            it = items[d // 3 % 12]
            source = it[2] if d % 2 else it[1]
            w = source.split()
            a = rng.randrange(0, len(w) - 32)
            piece = w[a : a + 32]
            if d % 4 == 0:
                piece[9] = "█████"
                piece[20] = "changed"
            if d % 5 == 0:
                piece[15] = "-\n".join([piece[15][:2], piece[15][2:]])
            text = text[:600] + " " + "\n".join(piece).upper() + " " + text[600:]
            truth.add((d, it[0]))
            if it[0] == "e0" and source == it[2]:
                truth.add((d, "shared"))
        elif d % 3 == 1:
            w = items[d % 12][2].split()
            text += " " + " ".join(w[:14])
        docs.append((d, text, "clash", "clash"))
    docs += [(100, None, None, None), (101, "", None, None), (102, "short", None, None), docs[0]]
    return items, docs, truth


def test_planted_pieces_come_out(spark, world):
    items, docs, truth = world
    got = leaks.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEM)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    assert len(got) == len(truth) + sum(d == 0 for d, _ in truth)


def test_empty_tables(spark, world):
    items, docs, _ = world
    assert leaks.leaks(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, ITEM)).collect() == []
    assert leaks.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], ITEM)).collect() == []


def _recall(spark, items, texts):
    """Shares of exact candidates, windows and pairs, that are candidates by the latent space, their number, rank and texts."""
    own = leaks.Items.of(items)
    coded = leaks.encode(texts, own.vocabulary)
    idf, unseen, weight = leaks.term_weights(spark.createDataFrame(list(enumerate(coded)), "doc_id bigint, ids binary"), own)
    space = leaks.latent_space(spark, own, idf)
    exact = leaks.Search(own, idf, unseen, weight, np.vstack([np.eye(own.terms.size, dtype=np.float32), np.zeros((1, own.terms.size), np.float32)]))
    latent = leaks.Search(own, idf, unseen, weight, space)
    want, got = set(), set()
    for d, b in enumerate(coded):
        ids = np.frombuffer(b, np.uint16).astype(np.int32)
        for out, s in ((want, exact), (got, latent)):
            out |= {(d, i, k) for i, k, _ in s.candidates(ids)}
    pairs = {(d, k) for d, _, k in want}
    return len(want & got) / len(want), len({(d, k) for d, _, k in got} & pairs) / len(pairs), len(want), space.shape[1], len(own.ids)


def test_recall_of_candidates_against_brute_force(spark, world):
    """Pairs whose exact, not latent, cover reaches the threshold are nearly all candidates in the latent space."""
    items, docs, _ = world
    windows, pairs, n, rank, texts = _recall(spark, [dict(zip(("item_id", "prompt", "passage", "answer"), i[:4], strict=True)) for i in items], [x[1] for x in docs])
    assert n > 20 and rank <= texts and windows >= 0.9 and pairs >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_recall_of_candidates_on_the_test_table(spark):
    """The documents whose id is divisible by 20 against all items."""
    items = pd.read_parquet("/root/testdata/sf0.1/eval_items.parquet").to_dict("records")
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    windows, pairs, n, rank, texts = _recall(spark, items, docs[docs["doc_id"] % 20 == 0]["text"].tolist())
    assert n > 300 and rank <= (texts + 3) / 4 and windows >= 0.9 and pairs >= 0.9


def test_recall_with_thousands_of_texts(spark):
    """5,000 texts, in blocks: pieces of them with two words changed are candidates."""
    rng = np.random.default_rng(3)
    voc = [f"w{i}x" for i in range(3000)]
    items = [{"item_id": f"e{i}", "prompt": " ".join(rng.choice(voc, 40)), "passage": " ".join(rng.choice(voc, 60)), "answer": None} for i in range(2500)]
    found = total = 0
    for block in leaks._blocks(spark.createDataFrame(pd.DataFrame(items).astype(object), "item_id string, prompt string, passage string, answer string")):
        own = leaks.Items.of(block)
        assert len(own.ids) <= leaks.BLOCK_TEXTS
        if total > 100:
            continue
        idf = np.r_[np.full(own.terms.size, 1.0), 0.0]
        s = leaks.Search(own, idf, 1.0, np.ones(len(own.vocabulary) + 1), leaks.latent_space(spark, own, idf))
        for k in rng.choice(len(own.ids), 60, replace=False).tolist():
            piece = own.ids[k][5:35].copy()
            piece[[8, 20]] = 0
            total += 1
            found += k in {c for _, c, _ in s.candidates(np.r_[np.zeros(30, np.int32), piece, np.zeros(30, np.int32)])}
    assert total == 120 and found >= 0.9 * total


def test_blocks_of_items_give_what_all_do(spark, world, monkeypatch):
    items, docs, truth = world
    monkeypatch.setattr(leaks, "BLOCK_TEXTS", 8)
    got = leaks.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEM)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth


def test_a_paraphrase_needs_the_answer(world, monkeypatch):
    """A piece with so many words changed that it takes the answer to tell, but not with so many that it is another text."""
    own = leaks.Items.of([dict(zip(("item_id", "prompt", "passage", "answer"), i[:4], strict=True)) for i in world[0]])
    s = leaks.Search(own, np.r_[np.ones(own.terms.size), 0.0], 1.0, np.ones(len(own.vocabulary) + 1), np.vstack([np.eye(own.terms.size, dtype=np.float32), np.zeros((1, own.terms.size), np.float32)]))
    monkeypatch.setattr(leaks, "NEAR_ANSWERED", 0.4)
    answer = np.array([own.vocabulary[w] for w in own.answers[3]], np.int32)
    for changed, alone, with_answer in (((12,), True, True), ((5, 11, 17, 23), False, True), ((4, 7, 11, 14, 18, 21, 25), False, False)):
        piece = own.ids[6][5:31].copy()
        piece[list(changed)] = 0
        text = [np.zeros(24, np.int32), piece, np.zeros(50, np.int32)]
        assert (6 in s.found(np.concatenate(text))[0]) is alone
        best, given = s.found(np.concatenate([*text, answer]))
        assert (6 in best) is with_answer and given <= {3}


def test_lcs_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y and x else max(t[i, j + 1], t[i + 1, j])
        pairs = leaks.lcs_pairs(a, b)
        assert len(pairs) == t[-1, -1]
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_words_join_hyphens():
    assert leaks.words("Harbour-master, ware-\nhouse; in‑parte È") == ["harbourmaster", "warehouse", "inparte", "è"]


def _grown(world, times):
    """The weights of the world's items in a corpus of that many passages in which a hundredth hold each term."""
    own = leaks.Items.of([dict(zip(("item_id", "prompt", "passage", "answer"), i[:4], strict=True)) for i in world[0]])
    return own, 1000 * times, 10 * times


@pytest.mark.parametrize("times", [1, 100, 100_000])
def test_a_leak_comes_out_however_large_the_corpus(spark, world, times, monkeypatch):
    """Copies and corpus grow alike: 25 words with two changed, cut where the windows lie worst, among words that no item has."""
    own, n, df = _grown(world, times)
    item = own.ids[0]
    copy = item[5:30].copy()
    copy[[8, 16]] = 0
    ids = np.r_[np.zeros(28, np.int32), copy, np.zeros(40, np.int32)]
    counts = pd.DataFrame({"k": [-1, *range(own.terms.size), *range(own.terms.size + 2, own.terms.size + 2 + len(own.vocabulary))], "n": [n, *[df] * (own.terms.size + len(own.vocabulary))]})

    class Counted:
        """Stands for the encoded corpus; its counts are given."""

        def __getattr__(self, name):
            return lambda *_, **__: self

        def toLocalIterator(self):  # noqa: N802
            return iter(counts.to_dict("records"))

    idf, unseen, weight = leaks.term_weights(Counted(), own)
    s = leaks.Search(own, idf, unseen, weight, leaks.latent_space(spark, own, idf))
    assert 0 in s.found(ids)[0]


def test_the_bound_is_never_below_the_share(world):
    own, *_ = _grown(world, 1)
    rng = np.random.default_rng(3)
    s = leaks.Search(own, np.r_[np.ones(own.terms.size), 0.0], 1.0, np.r_[0.0, rng.uniform(1, 9, len(own.vocabulary))], np.zeros((own.terms.size + 1, 2), np.float32))
    texts = np.arange(len(own.ids))
    for _ in range(20):
        x = own.ids[rng.integers(texts.size)]
        a = int(rng.integers(x.size))
        doc = np.r_[rng.integers(0, len(own.vocabulary) + 1, 30), x[a : a + 30]].astype(np.int32)
        most = s.most(texts, np.zeros(texts.size, np.int64), [doc])
        assert all(most[k] >= leaks.span_found(own.ids[k], doc, s.weight) - 1e-9 for k in texts)


def test_answers_in_words_of_their_own_are_found(spark):
    rng = random.Random(8)
    passage = prose(rng, 60, [f"w{i}x" for i in range(400)])
    items = [("own", None, passage, "Forty-two zlotys", None), ("absent", None, passage, "fifty zlotys", None), ("none", None, passage, None, None)]
    docs = [(1, f"{passage} and the sum was forty-two\nzlotys in all", None, None), (2, f"{passage} and zlotys fortytwo", None, None)]
    got = leaks.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEM)).collect()
    assert len(got) == 6
    assert {(r["doc_id"], r["item_id"]) for r in got if r["answered"]} == {(1, "own")}

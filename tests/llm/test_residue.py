import numpy as np
import pytest
from panelith.llm import residue

NATURAL = [
    "1 The carrier silently cancelled the regional covenant unless the declaration had been overlooked at the quarry.",
    "2 Liability for the late survey rests with whoever cancelled the indemnity first, within 38 days of the notice.",
    "§ 3  Il contratto successivo è stato espressamente confermato dal datore, entro 3 giorni dal sollecito.",
    "[4] The respondent [redacted] and N.N. appeared. The defendant is ordered to pay 343,558 to the claimant.",
    "High Court of Estrand\nCase No. D 73/1981\nDelivered on 13.12.1981\nVorut v. Weskut Insurance\nBefore: Lundevstra",
    "5 The brochure still carried the words “lorem ipsum” on its third page, a circumstance of no weight.",
    "6 According to the expert, the notice “please enable JavaScript” hid the general terms from the buyer.",
    "7 It is argued that a page which needs scripts to be enabled cannot count as a durable medium; that argument fails.",
    "8 The template contract leaves “{{customer_name}}” to be completed by hand, as was common practice.",
    "9 In the form signed the field «${price}» had been left as printed. See HCO 1980, 403 – Quasor.\n____________________\nHask",
    "10 The log lists 141 entries reading “404 Not Found”, each of them followed by a successful delivery.",
]
BAD = [
    "Before: {{ judge }}", "Delivered on <<Date>>", "In the matter of ${claimant} against Vork", "5 Interest runs from %(date)s until payment.", "Giudice: [INSERIRE GIUDICE]", "«Convenuto» (ricorrente) contro Hask (resistente)",
    "2 Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.", "§ 2  asdf qwer foo bar blah xxx asdf tst foo bar blah asdf", "[3] sample text sample text sample text sample text", "4 Testo segnaposto Testo segnaposto Testo segnaposto",
    "403 Forbidden\n\nYou are not allowed to view /rulings/12/3 on this server.", "Traceback (most recent call last):\nFile \"show.py\", line 3, in main\nKeyError: 'doc'", "Please enable JavaScript to view this document.", "Per proseguire bisogna consentire JavaScript nel browser.",
]


@pytest.fixture(scope="module")
def counts():
    return residue.count([t for t in NATURAL for _ in range(2000)])


def test_residue_and_mentions(spark, counts):
    docs = [(i, t) for i, t in enumerate(NATURAL)] + [(100 + i, f"{NATURAL[4]}\n{NATURAL[0]}\n{t}\n{NATURAL[1]}") for i, t in enumerate(BAD)] + [(200 + i, t) for i, t in enumerate(BAD)]
    docs += [(300, None), (301, ""), (302, "\n \n"), (303, "ж🙂" * 50), docs[-1]]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, field string")
    got = sorted(r[0] for r in residue.residue(df, counts).collect())
    assert got == sorted([*(100 + i for i in range(len(BAD))), *(200 + i for i in range(len(BAD))), 200 + len(BAD) - 1])


def test_empty(spark):
    assert residue.residue(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_counts_equal_brute_force(spark):
    texts = ["Abcà 12", None, "", "xyz {{a}}"]
    (got,) = residue.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert (residue._dense(got) == residue.count([t for t in texts if t])).all()
    assert got[1].sum() == sum(len(t) for t in texts if t)


def test_conditional_probabilities_sum_to_one(counts):
    p = np.exp(residue.conditional(counts)).reshape(-1, residue.SIZE).sum(1)
    assert np.allclose(p, 1, atol=1e-3)


def test_stretches_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.normal(0, 2, 40)
        best = max((x[i:j] - residue.COST).sum() for i in range(40) for j in range(i + 1, 41))
        got = residue.stretches(x, 5.0)
        assert bool(got) == (best >= 5)
        if got:
            assert abs(max(s for _, _, s in got) - best) < 1e-9


def test_held_out_accuracy(spark, counts):
    """Wording that isn't among the seeds: other fields and other sentences of the same kinds."""
    models = residue.ratios(counts)
    unseen = ["Before: {{ chair_of_panel }}", "Delivered on ${sentencing_day}", "Consectetur dolor magna lorem elit amet dolore ipsum sit.", "Session timed out. Log in once more to read on.", "Turn on scripts to read the decision; your browser blocks them.",
              "In the matter of {7} against Vork", "Interest runs from %(sentencing_day)s until payment.", "Before: @@chair_of_panel@@", "Between <<RespondingSide>>, claimant", "ricorrente $parte_lesa$ contro Hask"]
    assert sum(residue.residue_in(t, *models) for t in unseen) >= 9
    assert not any(residue.residue_in(t, *models) for t in NATURAL)


def test_classes_left_out_of_the_samples(counts, monkeypatch):
    """Forms and phrases of a class that the samples don't hold are found by their likeness to the rest."""
    monkeypatch.setattr(residue.residue_seeds, "WRAPS", [w for w in residue.residue_seeds.WRAPS if "@" not in w and "<<" not in w])
    monkeypatch.setattr(residue.residue_seeds, "NOTICES", [n for n in residue.residue_seeds.NOTICES if "Loading" not in n and "Checking" not in n])
    models = residue.ratios(counts)
    left_out = ["Before: @@judge@@", "Between <<Debtor>>, claimant", "Loading the text ... If nothing happens, enable scripting.", "Checking your browser before accessing this site. Please turn on JavaScript and cookies."]
    assert sum(residue.residue_in(t, *models) for t in left_out) >= 3

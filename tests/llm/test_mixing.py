import pytest
from panelith.llm import mixing

DOCS, TARGETS = "doc_id bigint, source string, text string, n_tokens bigint", "source string, target_share double, max_repeats double, note string"


def docs(spark, plan):
    rows, i = [], 0
    for source, n, size in plan:
        for k in range(n):
            rows.append((i, source, " word" * (size + k % 7), 0))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def run(spark, plan, targets, **kw):
    copies, shares = mixing.mix(docs(spark, plan), spark.createDataFrame([(*t, "x") for t in targets], TARGETS), **kw)
    return copies.collect(), {r["source"]: r for r in shares.collect()}


def test_targets_are_met_within_a_document(spark):
    copies, shares = run(spark, [("A-b", 300, 20), (" a_B ", 300, 20), ("c", 900, 10), (None, 50, 500), ("other", 50, 50)], [("a_b", 0.3, 1.0), ("c", 0.7, 4.0)])
    total = sum(r["used_tokens"] for r in shares.values())
    for s, want in (("a_b", 0.3), ("c", 0.7)):
        assert abs(shares[s]["used_tokens"] - shares[s]["wanted_tokens"]) <= 60
        assert abs(shares[s]["reached_share"] - want) < 0.01
    assert total == sum(r["copies"] * r["n_tokens"] for r in copies)
    assert {r["source"] for r in copies} == {"a_b", "c"}
    assert max(r["copies"] for r in copies if r["source"] == "a_b") == 1


def test_small_and_absent_sources(spark):
    copies, shares = run(spark, [("a", 100, 20), ("b", 5, 20)], [("a", 0.5, 9.0), ("b", 0.3, 2.5), ("gone", 0.2, 3.0)])
    assert {r["copies"] for r in copies if r["source"] == "b"} == {2}
    assert shares["gone"]["used_tokens"] == 0 and shares["gone"]["n_documents"] == 0
    assert shares["b"]["reached_share"] < 0.3 and abs(sum(r["reached_share"] for r in shares.values()) - 1) < 1e-9


def test_rates_are_exponential_in_tokens(spark):
    """Longer documents are used more where a source is repeated, less where it is thinned out."""
    copies, _ = run(spark, [("a", 400, 20), ("b", 100, 20)], [("a", 0.3, 9.0), ("b", 0.7, 9.0)])
    by = {}
    for r in copies:
        if r["source"] == "b":
            by.setdefault(r["n_tokens"], []).append(r["copies"])
    mean = [sum(v) / len(v) for _, v in sorted(by.items())]
    assert mean[0] < mean[-1]


def test_empty_and_twice(spark):
    copies, shares = run(spark, [], [("a", 1.0, 2.0)])
    assert copies == [] and shares["a"]["reached_share"] == 0
    assert run(spark, [("a", 3, 5)], [])[0] == []
    with pytest.raises(ValueError):
        run(spark, [("a", 3, 5)], [("a", 0.5, 1.0), ("A", 0.5, 1.0)])


def test_null_and_odd_texts(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (2, "a", "", 1), (3, "a", "x" * 100_000, 1), (3, "a", "x" * 100_000, 1), (None, "a", "y", 1)], DOCS)
    copies, _ = mixing.mix(df, spark.createDataFrame([("a", 1.0, 2.0, "x")], TARGETS))
    assert sum(r["doc_id"] == 3 for r in copies.collect()) == 2


def test_token_counts_round_trip(spark):
    text = "The carrier's 12 claims — «È» <|endoftext|>\n\n  end"
    enc = mixing._encoding(mixing.VOCABULARY)
    assert enc.decode(enc.encode_ordinary(text)) == text
    got = mixing.token_counts(spark.createDataFrame([(1, "a", text, 0)], DOCS)).first()
    assert got["n_tokens"] == len(enc.encode_ordinary(text))

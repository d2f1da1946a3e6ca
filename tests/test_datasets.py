"""Strict decoding of evaluation datasets."""

import json

from sedge.sources import datasets

GOOD = {"id": "a", "query": "q", "tags": ["t"], "goldEvidence": [{"evidenceId": "d1", "relevance": 2}], "expectedAbstain": False, "more": 1}


def test_first_error_of_each_case(spark):
    def but(**x):
        return json.dumps({k: v for k, v in (GOOD | x).items() if v != "gone"})

    cases = [
        (json.dumps(GOOD), None, None), ("{", "", "must be JSON"), (None, "", "must be JSON"), ("[]", "", "must be an object"), (but(expectedAbstain="no"), ".expectedAbstain", "must be a boolean"), (but(goldEvidence={}), ".goldEvidence", "must be an array"),
        (but(goldEvidence=[1]), ".goldEvidence[0]", "must be an object"), (but(goldEvidence=[{"evidenceId": " ", "relevance": 1}]), ".goldEvidence[0].evidenceId", "must be a non-empty string"), (but(goldEvidence=[{"evidenceId": "x", "relevance": 4}]), ".goldEvidence[0].relevance", "must be one of 1, 2, or 3"),
        (but(goldEvidence=[{"evidenceId": "x", "relevance": True}]), ".goldEvidence[0].relevance", "must be one of 1, 2, or 3"), (but(goldEvidence=GOOD["goldEvidence"] * 2), ".goldEvidence[1].evidenceId", "duplicate value d1"), (but(expectedAbstain=True), ".goldEvidence", "must be empty when expectedAbstain is true"),
        (but(tags="x"), ".tags", "must be an array"), (but(tags=["a", ""]), ".tags[1]", "must be a non-empty string"), (but(id="gone"), ".id", "must be a non-empty string"), (but(query=5), ".query", "must be a non-empty string"), (but(goldEvidence=[], expectedAbstain=True), None, None),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(cases)], "n int, j string, id string").repartition(3)
    got = {r.at: r for r in datasets.decode_cases(df, "n", "j").collect()}
    for i, (_, path, error) in enumerate(cases):
        assert (got[i].path, got[i].error) == ((None, None) if error is None else (f"$.cases[{i}]{path}", error)) and (got[i].id is None) == (error is not None), i
    assert got[0].gold[0].evidence == "d1" and got[0].tags == ["t"] and got[0].abstain is False


def test_ids_and_references(spark):
    rows = [(i, json.dumps(GOOD | {"id": x, "goldEvidence": [{"evidenceId": e, "relevance": 1} for e in own]})) for i, (x, own) in enumerate([("a", ["d1"]), ("b", ["d1", "d9"]), ("a", []), ("a", ["d2"])])] + [(7, "{")]
    cases = datasets.decode_cases(spark.createDataFrame(rows, "n int, j string"), "n", "j")
    corpus = spark.createDataFrame([("d1",), ("d2",), ("d2",), (None,)], "evidence string")
    assert {tuple(r) for r in datasets.dataset_errors(cases, corpus).collect()} == {
        ("$.cases[7]", "must be JSON"), ("$.cases[2].id", "duplicate value a"), ("$.cases[3].id", "duplicate value a"), ("$.cases[1].goldEvidence[1].evidenceId", "references unknown corpus evidence d9"),
    }
    assert datasets.dataset_errors(cases.limit(0), corpus).count() == 0

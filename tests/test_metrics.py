import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import analysis as A
from graphloom.operators import checks as C
from graphloom.operators import infer as I
from graphloom.operators import metrics as M
from graphloom.operators import orchestrate as O

LOG = "question_id string, true_hop int, recurrence_k int, adapter_control string, correct boolean, split string, pos long"


def test_scorer_cases(spark):
    cases = [
        ("The  Man!", ["men"], "men", 1, 1, 1), ("a green apple", ["apple", "pear"], "green apple", 0, 2 / 3, 1), ("x x y", ["x x x"], "x x y", 0, 2 / 3, 0),
        ("", [""], "", 1, 0, 1), ("blue", ["the"], "blue", 0, 0, 1), (None, ["a"], "", 1, 0, 1), ("x", [], "x", 0, 0, 0),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, *_) in enumerate(cases)], "i int, prediction string, targets array<string>")
    rows = df.select("i", X.normalize_answer(F.col("prediction")).alias("n"), *M.metric_columns(["em", "f1", "hit"])).orderBy("i").collect()
    for r, (_, _, n, em, f1, hit) in zip(rows, cases, strict=True):
        assert (r.n, r.em, pytest.approx(r.f1), r.hit) == (n, em, f1, hit)


def test_prediction_log_cases(spark):
    a = [("q1", 1, 1, True), ("q1", 1, 4, True), ("q2", 4, 1, False), ("q2", 4, 4, True), ("q3", 3, 1, False), ("q3", 3, 4, False)]
    log = spark.createDataFrame([(q, h, k, "correct", c, None, i) for i, (q, h, k, c) in enumerate(a)], LOG)
    assert {r.question_id: r.best_k for r in A.best_depths(log).collect()} == {"q1": 1, "q2": 4, "q3": None}
    assert tuple(A.solved_counts(A.best_depths(log)).first()) == (2, 1)
    assert A.depth_correlation(log).first().rho == pytest.approx(1.0)
    assert A.overall_summary(log).first().accuracy == 0.5
    b = [("q1", None, 1, True, "test"), ("q1", None, 2, False, "test"), ("q2", 3, 1, False, "validation"), ("q2", 3, 2, True, "validation")]
    log = spark.createDataFrame([(q, h, k, None, c, s, i) for i, (q, h, k, c, s) in enumerate(b)], LOG)
    s = A.overall_summary(log).first()
    assert (s.n, s.known_hop, s.unknown_hop) == (4, 2, 2)
    families = [r.family for r in A.accuracy_buckets(log).collect()]
    assert (families.count("hop"), families.count("k"), families.count("split")) == (2, 2, 4)
    assert A.depth_correlation(log).first().rho == 0.0
    none = spark.createDataFrame([], LOG)
    assert tuple(A.overall_summary(none).first()) == (0, 0.0, 0.0, 0, 0)
    assert A.accuracy_buckets(none).count() == 0 and A.depth_correlation(none).first().rho == 0.0


def test_constraint_checks(spark):
    schema = "graph_id string, question_id string, true_hop int, recurrence_k int, adapter_control string, latency_seconds double"
    good = [("g", "a", 3, 4, "shuffled", 0.0), ("g", "b", None, 2, "correct", 1.0)]
    bad = [("g", "c", 0, 1, "correct", 0.0), ("g", "d", 1, 0, "none", 0.0), ("g", "e", 1, 1, "other", 0.0), ("", "f", 1, 1, "none", 0.0), ("g", "h", 1, 1, "none", -1.0)]
    found = C.violations(spark.createDataFrame(good + bad, schema), F.col("question_id"), C.prediction_rules())
    assert sorted(r.row_key for r in found.collect()) == ["c", "d", "e", "f", "h"]
    with pytest.raises(ValueError):
        C.require_none(found)
    with pytest.raises(ValueError):
        C.check_arguments([1, 2], [2, 3], [1])


def test_inference_rows_that_fail_have_an_error(spark):
    def model(prompts):
        if any(p == "bad" for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    rows = I.infer(spark.createDataFrame([("good",), ("bad",)], "prompt string"), "prompt", model).collect()
    assert {r.prompt: (r.response, r.error) for r in rows} == {"good": ("GOOD", None), "bad": (None, "RuntimeError: no")}
    with pytest.raises(ValueError):
        I.backend("nothing")


def test_one_graph_has_no_shuffled_adapter(spark):
    one = spark.createDataFrame([("g", 0)], "graph_id string, idx long")
    assert sorted(r.adapter_control for r in O.adapter_graphs(one).collect()) == ["correct", "none"]

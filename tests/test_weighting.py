import numpy as np
import pytest
from pyspark.sql import functions as F

from aridscape.operators import weighting as A
from aridscape.sources import survey

# The nine-criterion comparison matrix.
NINE = [
    [1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 9.0],
    [1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 5.0, 7.0],
    [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 6.0],
    [0.5, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 5.0],
    [0.5, 0.5, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0],
    [0.3333, 0.5, 0.5, 0.5, 1.0, 1.0, 2.0, 2.0, 3.0],
    [0.25, 0.3333, 0.3333, 0.5, 0.5, 0.5, 1.0, 1.0, 2.0],
    [0.2, 0.2, 0.25, 0.3333, 0.3333, 0.5, 1.0, 1.0, 2.0],
    [0.1111, 0.1429, 0.1667, 0.2, 0.25, 0.3333, 0.5, 0.5, 1.0],
]


def matrix(spark, **named):
    rows = [(k, i, j, float(a)) for k, m in named.items() for i, row in enumerate(m) for j, a in enumerate(row)]
    return spark.createDataFrame(rows, "respondent string, i int, j int, a double")


def consistent(w):
    return [[a / b for b in w] for a in w]


def test_consistent_matrices_recover_their_weights(spark):
    w = np.array([0.47, 0.36, 0.17])
    df = matrix(spark, a=consistent(w), b=[[1, 4], [0.25, 1]])
    rows = {r["respondent"]: r for r in A.solve(df).collect()}
    np.testing.assert_allclose(rows["a"]["weights"], w, atol=1e-12)
    assert rows["a"]["lambda_max"] == pytest.approx(3) and rows["a"]["cr"] == pytest.approx(0, abs=1e-12)
    assert rows["b"]["cr"] == 0 and rows["b"]["accepted"]
    geo = {(r["respondent"], r["i"]): r["weight"] for r in A.geometric_weights(df).collect()}
    assert geo[("a", 1)] == pytest.approx(0.36)
    assert A.method_gap(A.solve(df), A.geometric_weights(df)).agg(F.max("max_gap")).first()[0] < 1e-12


def test_published_nine_criterion_solution(spark):
    row = A.solve(matrix(spark, m=NINE)).first()
    np.testing.assert_allclose(np.round(row["weights"], 4), [0.2135, 0.1782, 0.1585, 0.1336, 0.1117, 0.0843, 0.0523, 0.0425, 0.0254])
    assert (round(row["lambda_max"], 4), round(row["ci"], 4), round(row["cr"], 4)) == (9.1073, 0.0134, 0.0093)


def test_cyclic_judgements_are_rejected(spark):
    cyclic = [[1, 5, 1 / 5], [1 / 5, 1, 5], [5, 1 / 5, 1]]
    solved = A.solve(matrix(spark, x=cyclic))
    assert not solved.first()["accepted"]
    with pytest.raises(A.InconsistentMatrixError):
        A.require_consistent(solved)


def test_index_table_ends_at_ten(spark):
    row = A.solve(matrix(spark, m=consistent(np.arange(1, 11))), random_index=A.RANDOM_INDEX[:10]).first()
    assert row["cr"] == pytest.approx(0, abs=1e-9)
    short = A.solve(matrix(spark, m=consistent(np.arange(1, 5))), random_index=A.RANDOM_INDEX[:3] + (0.0,)).first()
    assert short["cr"] is None


@pytest.mark.parametrize(
    "bad,rule",
    [
        ([[1, 2], [0.9, 1]], "reciprocity"),
        ([[2, 1], [1, 1]], "diagonal"),
        ([[1, -2], [-0.5, 1]], "not positive"),
        ([[1, float("nan")], [1, 1]], "not finite"),
        ([[1.0]], "shape"),
    ],
)
def test_violations_are_named(spark, bad, rule):
    assert rule in {r["rule"] for r in A.matrix_violations(matrix(spark, m=bad)).collect()}


def test_valid_matrix_has_no_violation(spark):
    assert A.matrix_violations(matrix(spark, m=NINE)).isEmpty()


def test_perturbation_keeps_the_sum_and_ratios(spark):
    w = spark.createDataFrame([("m", 0, "a", 0.5), ("m", 1, "b", 0.3), ("m", 2, "c", 0.2)], "respondent string, i int, name string, weight double")
    sets = {}
    for r in A.perturbed(w, 0.2).collect():
        sets.setdefault(r["scenario"], {})[r["name"]] = r["weight"]
    assert set(sets) == {"baseline", *(f"{n}_{t}20" for n in "abc" for t in ("plus", "minus"))}
    assert sets["a_plus20"]["a"] == pytest.approx(0.6)
    assert sets["a_plus20"]["b"] / sets["a_plus20"]["c"] == pytest.approx(1.5)
    assert all(sum(s.values()) == pytest.approx(1) for s in sets.values())
    assert any(r["weight"] is None for r in A.perturbed(w, 1.0).collect())
    free = {r["name"]: r["weight"] for r in A.perturbed(w, 0.2, renormalize=False).where("scenario = 'b_minus20'").collect()}
    assert free == {"a": 0.5, "b": pytest.approx(0.24), "c": 0.2}


def test_aggregation_is_geometric(spark):
    upper = spark.createDataFrame([("x", 0, 1, 4.0), ("y", 0, 1, 0.25)], "respondent string, i int, j int, a double")
    got = {(r["i"], r["j"]): r["a"] for r in A.aggregate_judgements(A.full_matrix(upper)).collect()}
    assert got[(0, 1)] == pytest.approx(1) and got[(0, 0)] == 1.0


def test_group_leaves_out_the_inconsistent(spark):
    good = consistent([0.46, 0.33, 0.21])
    cyclic = [[1, 5, 1 / 5], [1 / 5, 1, 5], [5, 1 / 5, 1]]
    group, report = A.group_solution(matrix(spark, g=good, bad=cyclic))
    np.testing.assert_allclose(group.first()["weights"], [0.46, 0.33, 0.21], atol=1e-9)
    assert {r["respondent"]: r["accepted"] for r in report.collect()} == {"g": True, "bad": False}
    everyone, _ = A.group_solution(matrix(spark, g=good, bad=cyclic), exclude_inconsistent=False)
    assert abs(everyone.first()["weights"][0] - 0.46) > 0.01
    nobody, _ = A.group_solution(matrix(spark, bad=cyclic))
    assert nobody.isEmpty()


FORM = "\ufeff# survey, with comma\n\nno,A_kod,A_aciklama,B_kod,B_aciklama,cevap\n1,p,P,q,Q,{}\n2,p,P,r,R,-3\n\n# note\n3,q,Q,r,R,\"2,5\"\n"


def answers(spark, text):
    return survey.parse_forms(spark.createDataFrame([("u1", text)], "respondent string, text string"))


def test_survey_roundtrip(spark, tmp_path):
    (tmp_path / "expert_01.csv").write_text(FORM.format("5"), encoding="utf-8")
    parsed = survey.parse_forms(survey.read_forms(spark, str(tmp_path)))
    rows = {(r["i"], r["j"]): r["a"] for r in survey.judgements(parsed, ["p", "q", "r"]).collect()}
    assert rows == {(0, 1): 5.0, (0, 2): pytest.approx(1 / 3), (1, 2): 2.5}
    assert parsed.first()["respondent"] == "expert_01"
    assert survey.survey_errors(parsed, ["p", "q", "r"]).isEmpty()
    survey.require_complete(parsed, ["p", "q", "r"])


@pytest.mark.parametrize("cell,problem", [("10", "outside the scale"), ("-37", "outside the scale"), ("seven", "not a number"), ("-0.25", "outside the scale"), ("  ", "not answered")])
def test_survey_errors_are_named(spark, cell, problem):
    parsed = answers(spark, FORM.format(cell))
    assert [r["problem"] for r in survey.survey_errors(parsed, ["p", "q", "r"]).collect()] == [problem]
    with pytest.raises(ValueError, match=problem):
        survey.require_complete(parsed, ["p", "q", "r"])


def test_missing_and_unknown_pairs(spark):
    parsed = answers(spark, FORM.format("5"))
    assert {r["problem"] for r in survey.survey_errors(parsed, ["p", "q", "r", "s"]).collect()} == {"missing"}
    assert "unknown criterion" in {r["problem"] for r in survey.survey_errors(parsed, ["p", "q"]).collect()}


def test_questionnaire_numbers_every_pair(spark):
    people = spark.createDataFrame([("u1",), ("u2",)], "respondent string")
    rows = survey.questionnaire(people, list("abcd"), {c: c.upper() for c in "abcd"}).where("respondent = 'u2'").orderBy("no").collect()
    assert [(r["no"], r["A_kod"], r["B_kod"]) for r in rows] == [(1, "a", "b"), (2, "a", "c"), (3, "a", "d"), (4, "b", "c"), (5, "b", "d"), (6, "c", "d")]


def test_matrices_beyond_the_index_table_are_rejected(spark):
    from aridscape.operators.weighting import solve

    rows = [(r, i, j, 1.0) for r, n in (("small", 4), ("large", 12)) for i in range(n) for j in range(n)]
    got = {r["respondent"]: r for r in solve(spark.createDataFrame(rows, "respondent string, i int, j int, a double")).collect()}
    assert got["small"]["accepted"] and got["small"]["n"] == 4
    assert got["large"]["n"] == 12 and got["large"]["cr"] is None and got["large"]["accepted"] is False

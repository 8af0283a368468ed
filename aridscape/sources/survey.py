"""Questionnaires: generate, read and check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aridscape.operators.weighting import decode_answer

# Header of a questionnaire.
HEADER = ["no", "A_kod", "A_aciklama", "B_kod", "B_aciklama", "cevap"]


def questionnaire(respondents: DataFrame, criteria: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Numbered unordered criterion pairs for every row of ``respondents``.

    The pair list belongs to the criteria (at most ten) and is a literal.
    """
    labels = labels or {c: c for c in criteria}
    pairs = [(a, b) for k, a in enumerate(criteria) for b in criteria[k + 1 :]]
    rows = F.array(
        *[
            F.struct(
                F.lit(no).alias("no"), F.lit(a).alias("A_kod"), F.lit(labels[a]).alias("A_aciklama"),
                F.lit(b).alias("B_kod"), F.lit(labels[b]).alias("B_aciklama"),
            )
            for no, (a, b) in enumerate(pairs, start=1)
        ]
    )
    return respondents.select("*", F.inline(rows))


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """One row ``respondent, text`` per form file."""
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return raw.select(F.regexp_extract("file", r"([^/]+?)(\.csv)?$", 1).alias("respondent"), F.col("value").alias("text"))


def parse_forms(forms: DataFrame) -> DataFrame:
    """Answer rows of each form: everything before the header, comments and blanks are skipped."""
    lines = F.split(F.regexp_replace("text", "^\uFEFF", ""), r"\r?\n")
    start = F.array_position(F.transform(lines, lambda s: F.trim(s).startswith("no,")), F.lit(True))
    body = F.when(start > 0, F.slice(lines, (start + 1).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(body, lambda s: (F.trim(s) != "") & ~F.trim(s).startswith("#"))
    schema = ", ".join(f"`{c}` string" for c in HEADER)
    return (
        forms.select("respondent", F.explode(kept).alias("line"))
        .select("respondent", F.from_csv("line", F.lit(schema)).alias("r"))
        .select("respondent", F.col("r.A_kod").alias("a_code"), F.col("r.B_kod").alias("b_code"), F.trim(F.coalesce("r.cevap", F.lit(""))).alias("raw"))
        .where((F.coalesce("a_code", F.lit("")) != "") & (F.coalesce("b_code", F.lit("")) != ""))
        .withColumn("answer", F.regexp_replace("raw", ",", ".").try_cast("double"))
    )


def _position(column: str, criteria: Sequence[str]):
    names = F.array(*[F.lit(c) for c in criteria])
    return (F.array_position(names, F.col(column)) - 1).cast("int")


def survey_errors(answers: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """``respondent, problem, a_code, b_code``: unknown, blank, non-numeric, out-of-scale and missing answers."""
    known = list(criteria)
    problem = (
        F.when(~F.col("a_code").isin(known) | ~F.col("b_code").isin(known), "unknown criterion")
        .when(F.col("raw") == "", "not answered")
        .when(F.col("answer").isNull(), "not a number")
        .when(~F.abs("answer").between(1, 9), "outside the scale")
    )
    bad = answers.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("respondent", "problem", "a_code", "b_code")
    expected = questionnaire(answers.select("respondent").distinct(), criteria).select(
        "respondent", F.col("A_kod").alias("a_code"), F.col("B_kod").alias("b_code")
    )
    missing = expected.join(answers, ["respondent", "a_code", "b_code"], "left_anti").select(
        "respondent", F.lit("missing").alias("problem"), "a_code", "b_code"
    )
    return bad.unionByName(missing)


def judgements(answers: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """Valid answers as ``respondent, i, j, a``."""
    return answers.select(
        "respondent", _position("a_code", criteria).alias("i"), _position("b_code", criteria).alias("j"),
        decode_answer(F.col("answer")).alias("a"),
    )


def require_complete(answers: DataFrame, criteria: Sequence[str]) -> DataFrame:
    bad = survey_errors(answers, criteria).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['respondent']}: {r['a_code']} vs {r['b_code']} {r['problem']}" for r in bad))
    return answers

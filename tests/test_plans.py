"""Layouts, rules and sizes."""

import pytest
from pyspark.sql import functions as F

from tidewater.model import ERROR, WARN, Format, Plan, SchemaError, Variable, VariableMetadata, errors, warnings
from tidewater.plans import planner, rules, sizes


def make(*variables, name="AE", label="Adverse Events"):
    return Plan(name, label, tuple(variables)).laid_out()


def codes(issues):
    return [i.code for i in issues]


def test_positions():
    plan = make(Variable("A", True, 8), Variable("B", False, 20), Variable("C", True, 8))
    assert [v.position for v in plan.variables] == [0, 8, 28] and plan.row_bytes == 36
    assert [v.name for v in plan.numeric_variables] == ["A", "C"] and [v.name for v in plan.character_variables] == ["B"]


def test_types_and_lengths(spark):
    df = spark.sql("select 1 as i, true as b, date'2024-01-01' as d, timestamp_ntz'2024-01-01 00:00:00' as t, 'é' as s, cast(null as string) as e, cast('abc' as binary) as x")
    plan = planner.plan_table(df, "T")
    assert [(v.name, v.numeric, v.length) for v in plan.variables] == [("i", True, 8), ("b", True, 8), ("d", True, 8), ("t", True, 8), ("s", False, 2), ("e", False, 1), ("x", False, 3)]
    plan = planner.plan_table(df, "T", variables=[VariableMetadata("d", numeric=False), VariableMetadata("t", numeric=False)])
    assert [v.length for v in plan.variables if v.name in "dt"] == [10, 19]
    with pytest.raises(SchemaError):
        planner.plan_table(df, "T", variables=[VariableMetadata("i", numeric=False)])
    with pytest.raises(SchemaError):
        planner.plan_table(spark.sql("select array(1) as a"), "T")
    with pytest.raises(SchemaError):
        planner.plan_table(df.select("i", F.col("b").alias("i")), "T")


def test_lengths_given(spark):
    df = planner.with_metadata(spark.sql("select 'abcdef' as s"), "s", length=10)
    assert planner.plan_table(df, "T", variables=[VariableMetadata("s", length=50)]).variables[0].length == 10
    with pytest.raises(SchemaError, match="max observed 6 > specified 3"):
        planner.plan_table(spark.sql("select 'abcdef' as s"), "T", variables=[VariableMetadata("s", length=3)])
    assert planner.plan_table(spark.sql("select 'abcdef' as s"), "T", variables=[VariableMetadata("s", length=3)], strict=False).variables[0].length == 3


def test_metadata_order_and_labels(spark):
    df = planner.with_metadata(spark.sql("select 1 as a, 2 as b, 3 as c"), "a", label="own", format="8.2", role="Topic")
    about = [VariableMetadata("c", order=1), VariableMetadata("a", label="有害事象" * 5, format="broken")]
    plan = planner.plan_table(df, "T", variables=about)
    assert [v.name for v in plan.variables] == ["c", "a", "b"] and [v.source_index for v in plan.variables] == [2, 0, 1]
    a = plan.variables[1]
    assert len(a.label.encode()) == 39 and a.format == Format.parse("8.2") and a.role == "Topic"
    assert [v.name for v in planner.plan_table(df, "t", upper=True).variables] == ["A", "B", "C"]
    moved = planner.carry_metadata(df, df.select((F.col("a") + 1).alias("a")))
    assert moved.schema["a"].metadata["transport.label"] == "own"
    with pytest.raises(SchemaError):
        planner.with_metadata(df, "a", colour="red")


def test_structural_rules():
    good = make(Variable("AESEQ", True, 8, "Sequence"))
    assert rules.structural(good) == []
    bad = make(Variable("AESEQ", True, 4, "x"), Variable("TOOLONGNAME", False, 0, ""), Variable("C", False, 201, "y" * 41), name="LONGDATASET", label=None)
    assert codes(rules.structural(bad)) == ["DatasetNameTooLong", "MissingDatasetLabel", "NumericWrongLength", "VariableNameTooLong", "MissingVariableLabel", "CharacterLengthTooShort", "VariableLabelTooLong", "CharacterLengthTooLong"]
    assert codes(rules.structural(make(label="x" * 41))) == ["DatasetLabelTooLong"] and rules.structural(make(label="")) == []
    broken = Plan("AE", "x", (Variable("A", True, 8, "l"),), 9)
    assert str(rules.structural(broken)[0]) == "[ERROR] row_len inconsistency: recorded 9 but computed 8"


@pytest.mark.parametrize("agency", rules.AGENCIES.values())
def test_agencies(agency):
    good = make(Variable("AESEQ", True, 8, "Sequence"))
    assert rules.validate(good, agency) == [] and rules.validate(good, agency, "/x/ae.xpt") == []
    assert codes(rules.validate(good, agency, "/x/dm.xpt")) == ["DatasetNameFileStemMismatch"]
    plan = make(Variable("_A", False, 201, "Événements indésirables graves xx"), Variable("9A", True, 8, "é" * 21), name="AÉ", label="有害事象")
    want = ["NonAsciiDatasetName", "AgencyLabelTooLong", "CharacterValueLengthExceeded", "DatasetNamePatternMismatch", "VariableNamePatternMismatch"]
    got = codes(rules.policy(plan, agency))
    assert [c for c in got if c not in ("MultiByteLabelNearLimit", "NonAsciiDatasetLabel", "NonAsciiVariableLabel")] == want
    assert ("NonAsciiDatasetLabel" in got) == agency.ascii_labels and got.count("MultiByteLabelNearLimit") == 1
    assert codes(rules.policy(make(name="AE\n"), agency)) == ["DatasetNamePatternMismatch"]


def test_issue_text(spark):
    plan = make(Variable("TOOLONGNAME", True, 8, ""))
    issues = rules.validate(plan, rules.FDA)
    assert str(issues[0]) == "[ERROR] variable name 'TOOLONGNAME' exceeds 8 bytes (has 11 bytes) (variable: TOOLONGNAME)"
    assert {i.severity for i in warnings(issues)} == {WARN} and {i.severity for i in errors(issues)} == {ERROR}
    assert rules.issue_frame(spark, issues).count() == len(issues)


def test_values(spark):
    df = spark.createDataFrame([("a", "é"), (None, "bb"), ("c", None)], "x string, y string")
    assert {tuple(r) for r in rules.non_ascii_values(df).collect()} == {("x", 0, 1), ("y", 1, 2)}
    assert rules.non_ascii_values(spark.range(3)).count() == 0


def test_sizes():
    plan = make(Variable("A", True, 8), Variable("B", False, 20))
    assert sizes.file_size(plan, 0) == 9 * 80 + 320 and sizes.file_size(plan, 3, compat=True) == 8 * 80 + 320 + 160
    fits = sizes.rows_that_fit(plan, 2000)
    assert sizes.file_size(plan, fits) <= 2000 < sizes.file_size(plan, fits + 3)
    assert sizes.rows_that_fit(plan, 100) is None and sizes.rows_that_fit(make(), 10**6) == 2**63 - 1
    assert sizes.part_path("/a/b.c/out.xpt", 2) == "/a/b.c/out_002.xpt" and sizes.part_path("out", 12) == "out_012.xpt"

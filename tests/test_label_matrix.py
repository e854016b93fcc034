from pyspark.sql import functions as F

from panelfill.operators import labels as ol
from panelfill.operators.runs import packed_runs
from panelfill.schemas import TAXONOMY


def code(sakey, svkey, multi, attribute, alternate, value):
    return (sakey, svkey, multi, attribute, alternate, value, *[None] * 6)


def tables(spark):
    codes = [code(1, 10 + k, False, "1", None, k) for k in range(3)] + [code(2, 21, False, "2_21", 22, None), code(2, 22, False, "2_22", 22, None)]
    codes += [code(3, 31, True, "3_31", None, None), code(3, 31, True, "again", None, None)]  # one answer may have two codes
    asked = [(1, 10, False), (1, 11, False), (2, 21, False), (2, 22, False), (3, 31, True), (9, 90, True)]
    answers = [(u, f"w{u % 2}", *a, float((u + k) % 2)) for u in range(40) for k, a in enumerate(asked)]
    answers += [(7, None, 3, 31, True, 1.0), (None, "w1", 3, 31, True, 1.0), (8, "w0", 3, 31, True, None), (5, "w1", 1, 12, False, 1.0)]
    people = [(u, "train" if u % 3 else "test") for u in range(35)] + [(1, "train")]
    return (
        spark.createDataFrame(answers, "uid long, wavekey string, sakey int, svkey int, multi boolean, label double"),
        spark.createDataFrame(codes, TAXONOMY), spark.createDataFrame(people, "uid long, set_uid string"),
    )


def test_packed_labels_are_those_of_single_rows(spark):
    bsm, taxonomy, people = tables(spark)
    codes = taxonomy.select("sakey", "svkey", "multi", ol.ALTERNATE, "attribute", "value")
    single = ol.known_respondents(ol.code_labels(bsm.join(codes, ["sakey", "svkey", "multi"])), people)
    columns = ["uid", "wavekey", "set_uid", "sakey", "svkey", "multi", "attribute"]
    want = sorted(map(str, single.select(*columns, F.col("attribute_value").alias("label")).collect()))
    for rows in (bsm, bsm.orderBy(F.rand(3))):  # the answers of a respondent need not be adjacent
        got = ol.attribute_matrix(rows, taxonomy, people)
        assert got.columns == [*columns, "label"] and sorted(map(str, got.collect())) == want


def test_labels_of_a_respondent_are_dealt_as_one_row(spark):
    plan = ol.attribute_matrix(*tables(spark))._jdf.queryExecution().executedPlan().toString()
    after_shuffle, _, before_shuffle = plan.partition("hashpartitioning(uid#")  # a plan is written from its end
    assert "MapInArrow" in before_shuffle and "Generate inline" in after_shuffle


def test_runs_keep_several_columns_side_by_side(spark):
    table = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 3, "c")], "uid long, x int, y string").coalesce(1)
    assert [tuple(r) for r in packed_runs(table, ["uid"], "x", "y").collect()] == [(1, [1, 2], ["a", None]), (2, [3], ["c"])]

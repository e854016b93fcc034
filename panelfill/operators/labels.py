"""From long answers to coded labels, and the wide label matrices made of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfill.operators.runs import packed_runs
from panelfill.session import stored

ALTERNATE = "alternate_svkey_binary_single"
RESPONDENT = ["uid", "wavekey", "set_uid"]


def binomial_rows(df: DataFrame) -> DataFrame:
    """Pick-many answers, and the answers of two-answer questions other than the alternate one.

    A null alternate makes the comparison null, so such rows stay only when ``multi``.
    """
    return df.where(F.col("multi") | (F.col("svkey") != F.col(ALTERNATE))).withColumn("attribute_value", F.col("label"))


def multinomial_rows(df: DataFrame) -> DataFrame:
    """The chosen answer of each single-choice question, as its answer code."""
    chosen = ~F.col("multi") & F.col(ALTERNATE).isNull() & (F.col("label") == 1.0)
    return df.where(chosen).withColumn("attribute_value", F.col("value").cast("double"))


def code_labels(df: DataFrame) -> DataFrame:
    """Both kinds in a single pass; the two conditions exclude each other."""
    binomial = F.col("multi") | (F.col("svkey") != F.col(ALTERNATE))
    multinomial = ~F.col("multi") & F.col(ALTERNATE).isNull() & (F.col("label") == 1.0)
    return df.where(binomial | multinomial).withColumn(
        "attribute_value", F.when(binomial, F.col("label")).otherwise(F.col("value").cast("double"))
    )


def known_respondents(df: DataFrame, people: DataFrame) -> DataFrame:
    """Keep respondents of ``people`` and attach their ``set_uid``.

    Partitioning by ``uid`` first serves both the distinct and the join. Respondents grow with the survey and their
    files are far smaller than the rows in memory, so they are never broadcast: the driver would have to hold them.
    """
    keys = people.select("uid", "set_uid").repartition("uid").distinct()
    return df.join(keys.hint("merge"), "uid")


def attribute_matrix(bsm: DataFrame, taxonomy: DataFrame, people: DataFrame) -> DataFrame:
    """Long label matrix: one row per respondent and attribute with an observed label.

    Answers lie respondent by respondent: the labels of one, with the numbers of their codes, travel to the join as one row.
    """
    codes = taxonomy.select("sakey", "svkey", "multi", ALTERNATE, "attribute", "value")
    codes = stored(codes.withColumn("code", F.row_number().over(Window.orderBy("sakey", "svkey"))), "codes")
    coded = code_labels(bsm.join(codes.drop("attribute"), ["sakey", "svkey", "multi"])).drop("label")
    packed = packed_runs(coded.withColumnRenamed("attribute_value", "label"), ["uid", "wavekey"], "code", "label")
    known = known_respondents(packed, people).select("uid", "wavekey", "set_uid", F.inline(F.arrays_zip("code", "label")))
    return known.join(codes, "code").select("uid", "wavekey", "set_uid", "sakey", "svkey", "multi", "attribute", "label")


def attribute_counts(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("attribute").agg(F.countDistinct("uid").alias("n_respondents"))


def covered_at_levels(matrix: DataFrame, levels: Iterable[tuple[float, bool]]) -> DataFrame:
    """:func:`covered_attributes` of several (share, strict) levels, counted once: (level, attribute, n_respondents)."""
    counts = attribute_counts(matrix).withColumn("everyone", matrix.select(F.countDistinct("uid")).scalar())
    each = F.array(*[F.struct(F.lit(share).alias("level"), F.lit(strict).alias("strict")) for share, strict in levels])
    limit, n = F.col("everyone") * F.col("l.level"), F.col("n_respondents")
    reached = F.when(F.col("l.strict"), n > limit).otherwise(n >= limit)
    return counts.withColumn("l", F.explode(each)).where(reached).select("l.level", "attribute", "n_respondents")


def covered_attributes(matrix: DataFrame, min_share: float, strict: bool = False) -> DataFrame:
    """Attributes answered by at least (``strict``: more than) a share of all respondents."""
    counts = attribute_counts(matrix)
    everyone = matrix.select(F.countDistinct("uid")).scalar()
    limit = everyone * F.lit(min_share)
    n = F.col("n_respondents")
    return counts.where(n > limit if strict else n >= limit)


def wide_labels(
    matrix: DataFrame, attributes: Iterable[str] | None = None, value: str = "label", name: str = "attribute"
) -> DataFrame:
    """One column per attribute: those given, which costs no job, or else all that occur."""
    keys = [c for c in RESPONDENT if c in matrix.columns]
    return matrix.groupBy(*keys).pivot(name, None if attributes is None else list(attributes)).agg(F.max(value))


def coverage_matrix(matrix: DataFrame, min_share: float) -> DataFrame:
    """Wide labels of the attributes that reach ``min_share`` (1.0: answered by everyone)."""
    names = sorted(r.attribute for r in covered_attributes(matrix, min_share).select("attribute").collect())
    kept = matrix.where(F.col("attribute").isin(names))
    return wide_labels(kept, names)


def covered_labels(matrix: DataFrame, min_share: float) -> DataFrame:
    """Long labels of the attributes that reach ``min_share``; no column and no literal for each attribute."""
    return matrix.join(covered_attributes(matrix, min_share).select("attribute"), "attribute", "left_semi")


def exclude_attributes(df: DataFrame, excluded: Iterable[str], target: str | None = None, name: str = "attribute") -> DataFrame:
    """Drop a fixed list of attributes and the target itself from a long feature table."""
    return df.where(~F.col(name).isin([*excluded, *([target] if target else [])]))

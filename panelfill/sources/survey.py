"""Survey tables derived from the order tables: one order is one respondent.

Everything is computed by Spark from the parquet files, so it grows with them. Answers of
question 102 are missing for a hash-chosen part of the respondents (item non-response); that is
the gap the engine fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfill import schemas
from panelfill.functions.rng import hash_uniform
from panelfill.functions.survey import attribute_kind, attribute_value, zero_based
from panelfill.operators.labels import attribute_matrix
from panelfill.session import shared_dir, ship, stored
from panelfill.sources.tables import materialize_once

# fixed values: the code book of the derived survey
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
RETURN_FLAGS = ["A", "N", "R"]
CODE_BOOK = (
    [(101, 1010 + k, False, "101", None, k, 0, False) for k in range(1, 6)]
    + [(102, 1020 + k, False, "102", None, k, 0, True) for k in range(1, 6)]
    + [(103, 1031, False, "103_1031", 1032, None, 0, False), (103, 1032, False, "103_1032", 1032, None, 0, False)]
    + [(104, 1040 + k, True, f"104_{1040 + k}", None, None, 0, True) for k in range(1, 4)]
)
ANSWER_RATE = 0.7


class Survey:
    """Lazily built survey tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that the pipeline takes as stored input: written once per application, then read."""
        return materialize_once(self.spark, self.place(name), build)

    def place(self, name: str) -> str:
        """A path of this survey and application in the shared folder."""
        place = hashlib.md5(self.folder.encode()).hexdigest()[:12]
        return f"{shared_dir(self.spark).rstrip('/')}/survey-{self.spark.sparkContext.applicationId}-{place}/{name}"

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with what the questions need from their lines and customers."""
        lines = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("uid"))
            .agg(
                F.count(F.lit(1)).alias("n_lines"),
                F.sum("l_quantity").alias("quantity"),
                (F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))).alias("discount"),
                *[F.max(F.col("l_returnflag") == f).alias(f"flag_{f}") for f in RETURN_FLAGS],
            )
        )
        segment = F.lit(len(SEGMENTS) + 1)
        for k, name in reversed(list(enumerate(SEGMENTS, start=1))):
            segment = F.when(F.col("c_mktsegment") == name, k).otherwise(segment)
        customers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), segment.alias("segment"))
        orders = self.table("orders").select(
            F.col("o_orderkey").cast("long").alias("uid"),
            "o_custkey",
            (F.col("o_orderstatus") == "F").alias("final"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
            "o_totalprice",
            F.year("o_orderdate").alias("wave"),
        )
        # customers first: where both joins are shuffled, what the lines add is moved once
        return orders.join(customers, "o_custkey").join(lines, "uid", "left")

    @cached_property
    def respondents(self) -> DataFrame:
        """One row per respondent; needs the order table alone."""
        split = F.col("o_orderkey") % 10
        return self.table("orders").select(
            F.col("o_orderkey").cast("long").alias("uid"),
            F.year("o_orderdate").cast("string").alias("wavekey"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("respondentweight"),
            F.when(split <= 5, "train").when(split <= 7, "test").otherwise("validation").alias("set_uid"),
        )

    @cached_property
    def latent(self) -> DataFrame:
        return self.stored("latent", self._latent)

    def _latent(self) -> DataFrame:
        split = F.col("uid") % 10
        return self.orders.select(
            "uid",
            F.when(split <= 5, "train").when(split <= 7, "test").otherwise("validation").alias("set_uid"),
            (F.col("o_totalprice") / 1e5).alias("ld_0"),
            F.col("n_lines").cast("double").alias("ld_1"),
            F.col("quantity").cast("double").alias("ld_2"),
            F.col("discount").alias("ld_3"),
        )

    @cached_property
    def latent_uids(self) -> DataFrame:
        return self.respondents.select("uid", "set_uid")

    @cached_property
    def bsm(self) -> DataFrame:
        return self.stored("bsm", self._bsm)

    def _bsm(self) -> DataFrame:
        """Long answers: one row per respondent and answer asked, label 1.0 when chosen.

        All questions come out of one pass over the orders.
        """
        priority, segment, final = F.col("priority"), F.col("segment"), F.col("final")

        def answers(sakey, multi, chosen):
            return F.array(
                *[
                    F.struct(
                        F.lit(sakey).alias("sakey"),
                        F.lit(svkey).alias("svkey"),
                        F.lit(multi).alias("multi"),
                        flag.cast("double").alias("label"),
                    )
                    for svkey, flag in chosen
                ]
            )

        nothing = F.array().cast("array<struct<sakey:int,svkey:int,multi:boolean,label:double>>")
        asked_102 = (F.col("wave") >= 1997) & (hash_uniform(F.col("uid"), 102) < ANSWER_RATE)
        asked_104 = (F.col("wave") <= 1999) & F.col("n_lines").isNotNull()
        rows = F.concat(
            answers(101, False, [(1010 + k, priority == k) for k in range(1, 6)]),
            F.when(asked_102, answers(102, False, [(1020 + k, segment == k) for k in range(1, 6)])).otherwise(nothing),
            answers(103, False, [(1031, final), (1032, ~final)]),
            F.when(
                asked_104,
                answers(104, True, [(1040 + k, F.col(f"flag_{f}")) for k, f in enumerate(RETURN_FLAGS, start=1)]),
            ).otherwise(nothing),
        )
        return self.orders.select(
            "uid", F.col("wave").cast("string").alias("wavekey"), F.explode(rows).alias("answer")
        ).select("uid", "wavekey", "answer.*")

    @cached_property
    def taxonomy(self) -> DataFrame:
        rows = [
            (s, v, multi, attribute, alternate, value, i, round_, s == 104, False, 1 if s < 104 else 2, needs)
            for i, (s, v, multi, attribute, alternate, value, round_, needs) in enumerate(CODE_BOOK)
        ]
        names = schemas.TAXONOMY.names
        types = {"boolean": pa.bool_(), "string": pa.string(), "integer": pa.int32()}
        columns = {
            f.name: pa.array([r[i] for r in rows], types[f.dataType.typeName()]) for i, f in enumerate(schemas.TAXONOMY)
        }
        return self.spark.createDataFrame(pa.table(columns)).select(*names)

    @cached_property
    def answer_codes(self) -> DataFrame:
        """Taxonomy with zero-based answer codes, as results are joined to it."""
        return self.taxonomy.select(
            "sakey", "svkey", "multi", "attribute", attribute_value(F.col("value")).alias("attribute_value")
        )

    @cached_property
    def matrix(self) -> DataFrame:
        return self.stored("matrix", lambda: attribute_matrix(self.bsm, self.taxonomy, self.latent_uids))

    @cached_property
    def labels(self) -> DataFrame:
        """Label matrix with zero-based labels and the kind of each attribute."""
        kind = attribute_kind(F.col("attribute"))
        return self.matrix.withColumn("kind", kind).withColumn("label", zero_based(F.col("label"), F.col("kind")).cast("int"))

    @cached_property
    def distributions(self) -> DataFrame:
        return self.stored("distributions", self._distributions)

    def _distributions(self) -> DataFrame:
        """Weighted share of each observed answer among those asked, with a nearby production share."""
        calc = (
            self.bsm.join(self.respondents.select("uid", "wavekey", "respondentweight"), ["uid", "wavekey"])
            .groupBy("sakey", "svkey", "multi")
            .agg((F.sum(F.when(F.col("label") == 1.0, F.col("respondentweight"))).cast("double") / F.sum("respondentweight").cast("double")).alias("calc"))
        )
        return calc.join(self.taxonomy.select("sakey", "svkey", "needs_imputation"), ["sakey", "svkey"]).select(
            "sakey",
            "svkey",
            "multi",
            (F.round("calc", 6) + 0.02 * (hash_uniform(F.col("svkey"), "prod") - 0.5)).alias("prod_distribution"),
            F.round("calc", 6).alias("calc_distribution"),
            "needs_imputation",
        )

    @cached_property
    def model_plan(self) -> DataFrame:
        return self.stored("model_plan", self._model_plan)

    def _model_plan(self) -> DataFrame:
        """What to model: code book, shares, and how many respondents each attribute has."""
        counts = self.matrix.groupBy("attribute").agg(F.countDistinct("uid").alias("n_respondents"))
        return (
            self.taxonomy.drop("needs_imputation")
            .join(self.distributions, ["sakey", "svkey", "multi"])
            .join(counts, "attribute", "left")
            .select(
                "attribute", "sakey", "svkey", "multi", "proposed_round", "needs_imputation",
                F.coalesce("n_respondents", F.lit(0)).alias("n_respondents"), "prod_distribution", "calc_distribution",
            )
        )

    @cached_property
    def people(self) -> DataFrame:
        return self.stored("people", self._people)

    def _people(self) -> DataFrame:
        """Every respondent once, with the label of each modelled attribute (null: none) as a column."""
        held = self.labels.groupBy("uid").agg(*[F.max(F.when(F.col("attribute") == a, F.col("label"))).alias(f"l{a}") for a in MODELS])
        return self.respondents.join(held.hint("merge"), "uid", "left")

    @cached_property
    def scores(self) -> DataFrame:
        return self.stored("scores", self._scores)

    def _scores(self) -> DataFrame:
        """Scores of every respondent for every modelled attribute: smoothed class frequencies of the train labels among alike respondents.

        Alike are those of the same wave and the same answers to questions 101 and 103, but for the answer that is modelled. Adding
        one to every class keeps probabilities above zero; where nobody alike has a label they are equal.
        Columns uid, set_uid, wavekey, weight, attribute_model, label, probs.
        """
        own = lambda a, model: F.lit(-1) if a == model else F.coalesce(f"l{a}", F.lit(-1))
        models = F.array(
            *[
                F.struct(
                    F.lit(name).alias("attribute_model"), F.lit(size).alias("num_class"), F.col(f"l{name}").alias("label"),
                    own("101", name).alias("c101"), own("103_1031", name).alias("c103"),
                )
                for name, size in MODELS.items()
            ]
        )
        alike = ["attribute_model", "wavekey", "c101", "c103"]
        rows = self.people.select(
            "uid", "set_uid", "wavekey", F.col("respondentweight").cast("double").alias("weight"), F.explode(models).alias("m")
        ).select("uid", "set_uid", "wavekey", "weight", "m.*")
        seen = rows.where((F.col("set_uid") == "train") & F.col("label").isNotNull()).groupBy(*alike).agg(
            F.array(*[F.count_if(F.col("label") == k) for k in range(max(MODELS.values()))]).alias("seen")
        )
        rows = rows.join(stored(seen, "seen"), alike, "left")
        counts = F.coalesce("seen", F.array(*[F.lit(0).cast("long") for _ in range(max(MODELS.values()))]))
        n = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
        smooth = F.transform(F.slice(counts, 1, F.col("num_class")), lambda x: (x + 1).cast("double") / (n + F.col("num_class")).cast("double"))
        binomial = F.array(1.0 - F.get(smooth, F.lit(1)), F.get(smooth, F.lit(1)))
        return rows.withColumn("probs", F.when(F.col("num_class") == 2, binomial).otherwise(smooth)).select(
            "uid", "set_uid", "wavekey", "weight", "attribute_model", "num_class", "label", "probs"
        )

    @cached_property
    def answer_pairs(self) -> DataFrame:
        return self.stored("answer_pairs", self._answer_pairs)

    def _answer_pairs(self) -> DataFrame:
        """Answers of two questions that were asked on the same wave.

        The list is made of the code book's answers per wave, not of respondents.
        """
        asked = self.bsm.select("wavekey", "sakey", "svkey").distinct()
        left = asked.select("wavekey", F.col("sakey").alias("sakey_1"), F.col("svkey").alias("svkey_1"))
        right = asked.select("wavekey", F.col("sakey").alias("sakey_2"), F.col("svkey").alias("svkey_2"))
        return left.join(right, "wavekey").where("sakey_1 < sakey_2")


# fixed values: modelled attributes and their number of classes
MODELS = {"101": 5, "102": 5, "103_1031": 2, "104_1041": 2, "104_1042": 2, "104_1043": 2}

"""Feature vectors from long answers and latent layers.

Answers stay long until the last step, where each respondent's answers become one array and
then one vector; there are no thousands of pivot columns for Catalyst to plan. Answers are
shuffled once, by respondent, for both groupings and the join.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureSpec:
    """Order and meaning of the vector entries: categorical answers first, then latent columns.

    ``levels`` maps an attribute to its number of answer codes; code c is stored as c + 1 and a
    missing answer is level 0. A latent column takes two entries: its value (mean where missing)
    and whether it was missing.
    """

    levels: dict[str, int]
    latent: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.levels, *[n for c in self.latent for n in (c, f"{c}_missing")]]

    @property
    def max_bins(self) -> int:
        return max([32, *[n + 1 for n in self.levels.values()]])

    def metadata(self) -> dict:
        """ML attributes, so that trees treat answers as categories."""
        nominal = [
            {"idx": i, "name": name, "vals": [str(v) for v in range(n + 1)]}
            for i, (name, n) in enumerate(self.levels.items())
        ]
        start = len(self.levels)
        numeric = [{"idx": start + i, "name": name} for i, name in enumerate(self.names[start:])]
        groups = {k: v for k, v in (("nominal", nominal), ("numeric", numeric)) if v}
        return {"ml_attr": {"attrs": groups, "num_attrs": len(self.names)}}

    def without(self, name: str) -> list[int]:
        """Positions of all entries but those of one attribute."""
        return [i for i, n in enumerate(self.names) if n != name]


def covered_levels(labels: DataFrame, min_share: float, sizes: dict[str, int], proposed: DataFrame | None = None) -> dict[str, int]:
    """Attributes usable as first-round features: answered by more than ``min_share`` of respondents.

    ``proposed`` (column attribute) restricts them to the plan of the round.
    """
    from panelfill.operators.labels import covered_attributes

    kept = covered_attributes(labels, min_share, strict=True)
    if proposed is not None:
        kept = kept.join(proposed.select("attribute").distinct(), "attribute", "left_semi")
    names = sorted(r.attribute for r in kept.select("attribute").collect())
    return {n: sizes[n] for n in names}


def _dense(held: str, n: int) -> Column:
    """Array of ``n`` levels from (idx, level) pairs in order of idx: each pair behind the zeros since the last one."""

    def zeros(count: Column) -> Column:
        return F.array_repeat(F.lit(0.0), count)

    def step(pair: Column, i: Column) -> Column:
        last = F.coalesce(F.get(held, i - 1)["idx"], F.lit(-1))
        return F.concat(zeros(pair["idx"] - last - 1), F.array(pair["level"]))

    return F.concat(F.flatten(F.transform(held, step)), zeros(F.lit(n - 1) - F.element_at(held, -1)["idx"]))


def assemble_features(
    respondents: DataFrame, answers: DataFrame, spec: FeatureSpec, latent: DataFrame | None = None
) -> DataFrame:
    """``respondents`` with a vector column ``features``.

    ``answers`` is long (uid, attribute, code >= 0); attributes outside the spec are ignored.
    """
    spark = respondents.sparkSession
    out = respondents
    n = len(spec.levels)
    parts = []
    if n:
        positions = spark.createDataFrame(pa.table({"attribute": list(spec.levels), "idx": pa.array(range(n), pa.int32())}))
        held = (
            answers.where(F.col("code").isNotNull())
            .join(positions, "attribute")
            .repartition("uid")
            .groupBy("uid", "idx")
            .agg((F.max("code") + 1).cast("double").alias("level"))
            .groupBy("uid")
            .agg(F.sort_array(F.collect_list(F.struct("idx", "level"))).alias("_held"))
        )
        out = out.join(held, "uid", "left")
        parts.append(F.when(F.col("_held").isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(_dense("_held", n)))
    if spec.latent:
        means = latent.agg(*[F.avg(c).alias(c) for c in spec.latent]).first()
        out = out.join(latent.select("uid", *spec.latent), "uid", "left")
        entries = []
        for c in spec.latent:
            entries += [F.coalesce(F.col(c), F.lit(means[c])), F.col(c).isNull().cast("double")]
        parts.append(F.array(*entries))
    vector = array_to_vector(F.concat(*parts) if len(parts) > 1 else parts[0])
    return out.select(*respondents.columns, vector.alias("features", metadata=spec.metadata()))

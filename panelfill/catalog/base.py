"""Registration of queries, and the survey tables in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfill.sources.survey import Survey

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def u(*keys: str) -> str:
    """SQL of the hash-uniform draw; keys are SQL expressions."""
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 8)) AS BIGINT)::DOUBLE / 4294967296)"


def hashed(*keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws('|', {text}))"


def argmax(array: str) -> str:
    return f"(list_position({array}, list_max({array})) - 1)"


VIEWS = {
    "respondents": """
        SELECT CAST(o_orderkey AS BIGINT) AS uid, CAST(year(o_orderdate) AS VARCHAR) AS wavekey,
               CAST(o_totalprice AS DECIMAL(18,2)) AS respondentweight,
               CASE WHEN o_orderkey % 10 <= 5 THEN 'train' WHEN o_orderkey % 10 <= 7 THEN 'test' ELSE 'validation' END AS set_uid
        FROM orders""",
    "people": """
        SELECT CAST(o.o_orderkey AS BIGINT) AS uid, year(o.o_orderdate) AS wave, o.o_totalprice, o.o_orderstatus,
               o.o_orderpriority, c.c_mktsegment, l.n_lines, l.quantity, l.discount, l.flag_a, l.flag_n, l.flag_r
        FROM orders o
        JOIN customer c ON c.c_custkey = o.o_custkey
        LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity,
                          CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS discount,
                          max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS flag_a,
                          max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS flag_n,
                          max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS flag_r
                   FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "latent": """
        SELECT uid, CASE WHEN uid % 10 <= 5 THEN 'train' WHEN uid % 10 <= 7 THEN 'test' ELSE 'validation' END AS set_uid,
               o_totalprice / 1e5 AS ld_0, CAST(n_lines AS DOUBLE) AS ld_1, CAST(quantity AS DOUBLE) AS ld_2, discount AS ld_3
        FROM people""",
    "taxonomy": """
        SELECT sakey, svkey, multi, attribute, alternate, value, proposed_round, needs_imputation,
               sakey = 104 AS is_display_logic_sakey, false AS is_display_logic_svkey,
               CASE WHEN sakey < 104 THEN 1 ELSE 2 END AS min_level
        FROM (VALUES
            (101, 1011, false, '101', NULL, 1, 0, false), (101, 1012, false, '101', NULL, 2, 0, false),
            (101, 1013, false, '101', NULL, 3, 0, false), (101, 1014, false, '101', NULL, 4, 0, false),
            (101, 1015, false, '101', NULL, 5, 0, false),
            (102, 1021, false, '102', NULL, 1, 0, true), (102, 1022, false, '102', NULL, 2, 0, true),
            (102, 1023, false, '102', NULL, 3, 0, true), (102, 1024, false, '102', NULL, 4, 0, true),
            (102, 1025, false, '102', NULL, 5, 0, true),
            (103, 1031, false, '103_1031', 1032, NULL, 0, false), (103, 1032, false, '103_1032', 1032, NULL, 0, false),
            (104, 1041, true, '104_1041', NULL, NULL, 0, true), (104, 1042, true, '104_1042', NULL, NULL, 0, true),
            (104, 1043, true, '104_1043', NULL, NULL, 0, true)
        ) t(sakey, svkey, multi, attribute, alternate, value, proposed_round, needs_imputation)""",
    "answer_codes": "SELECT sakey, svkey, multi, attribute, coalesce(value - 1, 1) AS attribute_value FROM taxonomy",
    "bsm": f"""
        SELECT p.uid, CAST(p.wave AS VARCHAR) AS wavekey, t.sakey, t.svkey, t.multi,
               CAST(CASE t.sakey
                    WHEN 101 THEN CAST(substr(p.o_orderpriority, 1, 1) AS INTEGER) = t.svkey - 1010
                    WHEN 102 THEN (CASE p.c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                                   WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END) = t.svkey - 1020
                    WHEN 103 THEN (p.o_orderstatus = 'F') = (t.svkey = 1031)
                    ELSE (CASE t.svkey WHEN 1041 THEN p.flag_a WHEN 1042 THEN p.flag_n ELSE p.flag_r END) = 1
                    END AS DOUBLE) AS label
        FROM people p JOIN taxonomy t
          ON t.sakey IN (101, 103)
          OR (t.sakey = 102 AND p.wave >= 1997 AND {u('p.uid', '102')} < 0.7)
          OR (t.sakey = 104 AND p.wave <= 1999 AND p.n_lines IS NOT NULL)""",
    "coded": """
        SELECT b.uid, b.wavekey, b.sakey, b.svkey, b.multi, b.label, t.attribute, t.alternate, t.value
        FROM bsm b JOIN taxonomy t ON b.sakey = t.sakey AND b.svkey = t.svkey AND b.multi = t.multi""",
    "matrix": """
        SELECT c.uid, c.wavekey, l.set_uid, c.sakey, c.svkey, c.multi, c.attribute, CAST(c.label AS DOUBLE) AS label
        FROM (SELECT * FROM coded WHERE multi OR svkey <> alternate
              UNION ALL
              SELECT * REPLACE (CAST(value AS DOUBLE) AS label) FROM coded WHERE NOT multi AND alternate IS NULL AND label = 1.0) c
        JOIN (SELECT DISTINCT uid, set_uid FROM respondents) l ON l.uid = c.uid""",
    "coded_labels": """
        SELECT uid, wavekey, set_uid, sakey, svkey, multi, attribute,
               CASE WHEN contains(attribute, '_') THEN 'binomial' ELSE 'multinomial' END AS kind,
               CAST(CASE WHEN contains(attribute, '_') THEN label ELSE label - 1 END AS INTEGER) AS label
        FROM matrix""",
    "distributions": f"""
        SELECT d.sakey, d.svkey, d.multi, round(d.calc, 6) + 0.02 * ({u('d.svkey', "'prod'")} - 0.5) AS prod_distribution,
               round(d.calc, 6) AS calc_distribution, t.needs_imputation
        FROM (SELECT b.sakey, b.svkey, b.multi,
                     CAST(sum(CASE WHEN b.label = 1.0 THEN r.respondentweight END) AS DOUBLE) / CAST(sum(r.respondentweight) AS DOUBLE) AS calc
              FROM bsm b JOIN respondents r ON r.uid = b.uid AND r.wavekey = b.wavekey GROUP BY ALL) d
        JOIN taxonomy t ON t.sakey = d.sakey AND t.svkey = d.svkey""",
    "model_plan": """
        SELECT t.attribute, t.sakey, t.svkey, t.multi, t.proposed_round, d.needs_imputation,
               coalesce(n.n_respondents, 0) AS n_respondents, d.prod_distribution, d.calc_distribution
        FROM taxonomy t JOIN distributions d ON t.sakey = d.sakey AND t.svkey = d.svkey AND t.multi = d.multi
        LEFT JOIN (SELECT attribute, count(DISTINCT uid) AS n_respondents FROM matrix GROUP BY attribute) n ON n.attribute = t.attribute""",
    "model_sizes": """
        SELECT * FROM (VALUES ('101', 5), ('102', 5), ('103_1031', 2), ('104_1041', 2), ('104_1042', 2), ('104_1043', 2)) m(attribute_model, num_class)""",
    "alike": """
        SELECT p.uid, p.set_uid, p.wavekey, CAST(p.respondentweight AS DOUBLE) AS weight, m.attribute_model, m.num_class, l.label,
               CASE WHEN m.attribute_model = '101' THEN -1 ELSE coalesce(a.c101, -1) END AS c101,
               CASE WHEN m.attribute_model = '103_1031' THEN -1 ELSE coalesce(a.c103, -1) END AS c103
        FROM respondents p CROSS JOIN model_sizes m
        LEFT JOIN (SELECT uid, max(CASE WHEN attribute = '101' THEN label END) AS c101, max(CASE WHEN attribute = '103_1031' THEN label END) AS c103
                   FROM coded_labels GROUP BY uid) a ON a.uid = p.uid
        LEFT JOIN coded_labels l ON l.uid = p.uid AND l.attribute = m.attribute_model""",
    "class_counts": """
        SELECT attribute_model, wavekey, c101, c103, count(*) AS n, [count(*) FILTER (label = 0), count(*) FILTER (label = 1), count(*) FILTER (label = 2),
               count(*) FILTER (label = 3), count(*) FILTER (label = 4)] AS seen
        FROM alike WHERE set_uid = 'train' AND label IS NOT NULL GROUP BY ALL""",
    "scores": """
        SELECT uid, set_uid, wavekey, weight, attribute_model, num_class, label,
               CASE WHEN num_class = 2 THEN [1.0::DOUBLE - smooth[2], smooth[2]] ELSE smooth END AS probs
        FROM (SELECT a.*, list_transform(range(1, a.num_class + 1), lambda k: CAST(coalesce(s.seen[k], 0) + 1 AS DOUBLE) / CAST(coalesce(s.n, 0) + a.num_class AS DOUBLE)) AS smooth
              FROM alike a LEFT JOIN class_counts s
                ON s.attribute_model = a.attribute_model AND s.wavekey = a.wavekey AND s.c101 = a.c101 AND s.c103 = a.c103)""",
    "predictions": f"""
        SELECT uid, set_uid, wavekey, attribute_model, label, CAST({argmax('probs')} AS INTEGER) AS max_prediction,
               CAST(coalesce(label, {argmax('probs')}) AS INTEGER) AS selected_value
        FROM scores""",
    "totals": "SELECT wavekey, CAST(sum(respondentweight) AS DOUBLE) AS wave_total_weight FROM respondents GROUP BY wavekey",
    "n_waves": "SELECT count(DISTINCT wavekey) AS n FROM respondents",
    "wave_shares": """
        SELECT c.attribute, c.sakey, c.svkey, x.wavekey, x.w / t.wave_total_weight AS wave_share
        FROM (SELECT p.attribute_model, p.selected_value, p.wavekey, CAST(sum(r.respondentweight) AS DOUBLE) AS w
              FROM predictions p JOIN respondents r ON r.uid = p.uid AND r.wavekey = p.wavekey GROUP BY ALL) x
        JOIN totals t ON t.wavekey = x.wavekey
        JOIN answer_codes c ON c.attribute = x.attribute_model AND c.attribute_value = x.selected_value""",
    "univariate": """
        SELECT attribute, sakey, svkey, sum(wave_share) / (SELECT n FROM n_waves) AS average_imputed_distribution
        FROM wave_shares GROUP BY attribute, sakey, svkey""",
    "class_scores": """
        SELECT s.uid, s.attribute_model, s.set_uid, k.value, s.probs[k.value + 1] AS p, CAST(s.label = k.value AS INTEGER) AS y
        FROM scores s JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS value) k ON k.value < s.num_class
        WHERE s.label IS NOT NULL AND (NOT contains(s.attribute_model, '_') OR k.value = 1)""",
    "roc_points": """
        SELECT attribute_model, value, set_uid, p, pos, neg,
               coalesce(sum(pos) OVER w, 0) AS pos_below, coalesce(sum(neg) OVER w, 0) AS neg_below,
               sum(pos) OVER (PARTITION BY attribute_model, value, set_uid) AS all_pos,
               sum(neg) OVER (PARTITION BY attribute_model, value, set_uid) AS all_neg
        FROM (SELECT attribute_model, value, set_uid, p, sum(y) AS pos, sum(1 - y) AS neg FROM class_scores GROUP BY ALL)
        WINDOW w AS (PARTITION BY attribute_model, value, set_uid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "auc": """
        SELECT attribute_model, value, set_uid,
               sum(pos * (neg_below + neg / 2.0::DOUBLE)) / nullif(max(all_pos)::DOUBLE * max(all_neg), 0) AS roc_score
        FROM roc_points GROUP BY attribute_model, value, set_uid""",
    "losses": """
        SELECT attribute_model, value, set_uid,
               avg(-CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END) AS log_loss
        FROM class_scores GROUP BY attribute_model, value, set_uid""",
    "curve": """
        SELECT attribute_model, value, set_uid, p AS threshold, (all_pos - pos_below)::DOUBLE AS tp, (all_neg - neg_below)::DOUBLE AS fp,
               all_pos::DOUBLE AS positives, all_neg::DOUBLE AS negatives FROM roc_points
        UNION ALL
        SELECT attribute_model, value, set_uid, max(p) + 1.0, 0.0, 0.0, max(all_pos)::DOUBLE, max(all_neg)::DOUBLE
        FROM roc_points GROUP BY attribute_model, value, set_uid""",
    "answer_pairs": """
        SELECT a.wavekey, a.sakey AS sakey_1, a.svkey AS svkey_1, b.sakey AS sakey_2, b.svkey AS svkey_2
        FROM (SELECT DISTINCT wavekey, sakey, svkey FROM bsm) a JOIN (SELECT DISTINCT wavekey, sakey, svkey FROM bsm) b
          ON a.wavekey = b.wavekey AND a.sakey < b.sakey""",
    "labeled": """
        SELECT l.uid, l.attribute AS attribute_model, l.wavekey, l.label, CAST(r.respondentweight AS DOUBLE) AS weight
        FROM coded_labels l JOIN respondents r ON r.uid = l.uid AND r.wavekey = l.wavekey WHERE l.label IS NOT NULL""",
}

def _poisson_sql(draw: str) -> str:
    """Poisson(1) count of a uniform draw."""
    from panelfill.functions.rng import poisson_steps

    return " + ".join(f"CAST({draw} >= {step!r}::DOUBLE AS INTEGER)" for step in poisson_steps())


def _mix_stages(name: str, source: str, start: str) -> dict[str, str]:
    """The splitmix64 mix of ``start`` over the rows of ``source``, one view per step (column z)."""
    from panelfill.functions.rng import MIX_1, MIX_2

    def times(z: str, shift: int, factor: int) -> str:
        return f"CAST((CAST(xor({z}, {z} >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"

    return {
        f"{name}_a": f"SELECT * REPLACE ({times('z', 30, MIX_1)} AS z) FROM (SELECT *, {start} AS z FROM {source})",
        f"{name}_b": f"SELECT * REPLACE ({times('z', 27, MIX_2)} AS z) FROM {name}_a",
        name: f"SELECT * REPLACE (xor(z, z >> 31) AS z) FROM {name}_b",
    }


def _golden(number: str) -> str:
    from panelfill.functions.rng import GOLDEN

    return f"CAST((CAST({number} AS UHUGEINT) * {GOLDEN}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"


VIEWS |= _mix_stages("mixed_uids", "(SELECT DISTINCT uid FROM labeled)", _golden("uid"))
VIEWS["reps"] = "SELECT unnest(range(1, 1001)) AS rep"
VIEWS |= _mix_stages(
    "mixed_draws", f"(SELECT m.uid, r.rep, xor(m.z, {_golden('r.rep')}) AS mixed FROM mixed_uids m CROSS JOIN reps r)", "mixed"
)
VIEWS["draws"] = f"""
        SELECT uid, rep, {_poisson_sql('u')} AS times FROM (SELECT uid, rep, CAST(z >> 32 AS DOUBLE) / 4294967296 AS u FROM mixed_draws)"""
VIEWS["replicates"] = """
        SELECT l.attribute_model, l.wavekey, l.label, d.rep, l.weight * d.times AS w
        FROM labeled l JOIN draws d ON d.uid = l.uid WHERE d.times > 0"""
VIEWS["rep_cells"] = """
        SELECT attribute_model, wavekey, rep, label, sum(w) AS w FROM replicates GROUP BY ALL"""
VIEWS["rep_waves"] = """
        SELECT attribute_model, rep, wavekey, sum(w) AS total FROM rep_cells GROUP BY ALL"""
VIEWS["rep_shares"] = """
        SELECT s.attribute_model, s.rep, k.value, coalesce(sum(c.w / v.total), 0.0) / max(s.n) AS share
        FROM (SELECT attribute_model, rep, count(*) AS n FROM rep_waves GROUP BY ALL) s
        JOIN model_sizes m ON m.attribute_model = s.attribute_model
        JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS value) k ON k.value < m.num_class
        LEFT JOIN rep_cells c ON c.attribute_model = s.attribute_model AND c.rep = s.rep AND c.label = k.value
        LEFT JOIN rep_waves v ON v.attribute_model = c.attribute_model AND v.rep = c.rep AND v.wavekey = c.wavekey
        GROUP BY s.attribute_model, s.rep, k.value"""
VIEWS["bounds"] = """
        SELECT attribute_model, value, quantile_cont(share, 0.025) AS lower_bound_distribution,
               quantile_cont(share, 0.975) AS upper_bound_distribution, avg(share) AS simulation_distribution
        FROM rep_shares GROUP BY attribute_model, value"""
VIEWS["histogram"] = """
        SELECT t.attribute_model, t.wavekey, k.value, coalesce(c.w, 0.0) / t.total AS share
        FROM (SELECT p.attribute_model, p.wavekey, sum(CAST(r.respondentweight AS DOUBLE)) AS total
              FROM predictions p JOIN respondents r ON r.uid = p.uid GROUP BY ALL) t
        JOIN model_sizes m ON m.attribute_model = t.attribute_model
        JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS value) k ON k.value < m.num_class
        LEFT JOIN (SELECT p.attribute_model, p.wavekey, p.selected_value, sum(CAST(r.respondentweight AS DOUBLE)) AS w
                   FROM predictions p JOIN respondents r ON r.uid = p.uid GROUP BY ALL) c
          ON c.attribute_model = t.attribute_model AND c.wavekey = t.wavekey AND c.selected_value = k.value"""


def with_views(sql: str) -> str:
    """Put the survey tables a statement refers to in front of it."""
    needed: list[str] = []

    def visit(text: str, above: tuple[str, ...] = ()) -> None:
        for name in VIEWS:
            if name not in needed and name not in above and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name], (*above, name))
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"    {name} AS ({VIEWS[name]}\n    )" for name in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a function of the survey tables under ``name``, with SQL for the same rows if there is any."""

    def register(build: Callable[[Survey], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Survey(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return build

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    column_ = F.col(column) if isinstance(column, str) else column
    return F.round(column_, 6).alias(name or column)


def predictions_of(s: Survey) -> DataFrame:
    """Predictions made of the scores: most probable class, observed label first."""
    from panelfill.functions.survey import argmax_class, observed_wins

    best = argmax_class(F.col("probs"))
    return s.scores.select(
        "uid", "set_uid", "wavekey", "attribute_model", "label", best.alias("max_prediction"),
        observed_wins(F.col("label"), best).alias("selected_value"),
    )


def answers_of(s: Survey) -> DataFrame:
    """The predictions with the weight of their respondent, as a round writes them: reports join no respondents."""
    from panelfill.functions.survey import argmax_class, observed_wins

    best = argmax_class(F.col("probs"))
    return s.scores.select(
        "uid", "set_uid", "wavekey", "attribute_model", "label", best.alias("max_prediction"),
        observed_wins(F.col("label"), best).alias("selected_value"), F.col("weight").cast("decimal(18,2)").alias("respondentweight"),
    )

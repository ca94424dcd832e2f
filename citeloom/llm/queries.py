"""Queries pN_... of the training-data problems, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import answers, consensus, leaks, lookalike, mixing, neardups, sampling, sentences, splitting
from citeloom.sources.tables import table


def p1_found(s: SparkSession, d: str) -> DataFrame:
    """The categories that the report of the drawn sample marks as short."""
    _, report = sampling.proportional_sample(table(s, d, "sample_batch1"), table(s, d, "sample_targets"))
    return report.where("short").select("engine", "failure_mode").distinct()


def p1_report(s: SparkSession, d: str) -> DataFrame:
    _, report = sampling.proportional_sample(table(s, d, "sample_batch1"), table(s, d, "sample_targets"))
    return report.select("engine", "failure_mode", "available", F.round("wanted", 3).alias("wanted"), "quota", "drawn", "short")


def p1_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.proportional_sample(table(s, d, "sample_batch1"), table(s, d, "sample_targets"))[0]


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return answers.flag_answers(table(s, d, "answers"), table(s, d, "questions")).where("rank = 0").select("ord", "defect").distinct()


def p2_all_defects(s: SparkSession, d: str) -> DataFrame:
    return answers.flag_answers(table(s, d, "answers"), table(s, d, "questions"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    units = sentences.units_of_tables(table(s, d, "corpus"), table(s, d, "sample_batch1"))
    return units.select("src_table", "rec_key", "piece", "end_char").distinct()


def p4_found(s: SparkSession, d: str) -> DataFrame:
    found, _ = consensus.truth_discovery(table(s, d, "labels"))
    return found.where("n_labelers >= 3").select("claim_id", "verdict")


def p4_consensus(s: SparkSession, d: str) -> DataFrame:
    found, _ = consensus.truth_discovery(table(s, d, "labels"))
    return found.select("claim_id", "verdict", "n_labelers", "votes_for", F.round("agreement", 6).alias("agreement"), F.round("confidence", 6).alias("confidence"))


def p4_reliability(s: SparkSession, d: str) -> DataFrame:
    return consensus.truth_discovery(table(s, d, "labels"))[1]


def p4_alpha(s: SparkSession, d: str) -> DataFrame:
    return consensus.nominal_alpha(table(s, d, "labels")).withColumn("alpha", F.round("alpha", 6))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return neardups.near_pairs(table(s, d, "corpus"), "doc_index", "text").select(F.col("a").alias("doc_index_a"), F.col("b").alias("doc_index_b"))


def p5_groups(s: SparkSession, d: str) -> DataFrame:
    return neardups.near_groups(table(s, d, "corpus"), "doc_index", "text").withColumnRenamed("id", "doc_index")


def p6_found(s: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(s, d, "corpus"), "doc_index", "text")
    return pieces.where("piece = 0").select("doc_index", (F.col("longest_unit") > 2000).cast("int").alias("hard_cut")).distinct()


def p6_pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(s, d, "corpus"), "doc_index", "text")


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id")


def p7_leaks(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(s, d, "documents"), table(s, d, "eval_items"))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    """The sources whose share in the mixture stays below the target with every row at its cap."""
    _, report = mixing.entropy_balanced(table(s, d, "documents"), table(s, d, "mix_targets"))
    return report.where("short").select("source").distinct()


def p8_mixture(s: SparkSession, d: str) -> DataFrame:
    return mixing.entropy_balanced(table(s, d, "documents"), table(s, d, "mix_targets"))[0].withColumnsRenamed({"doc": "doc_id", "src": "source"})


def p8_report(s: SparkSession, d: str) -> DataFrame:
    return mixing.entropy_balanced(table(s, d, "documents"), table(s, d, "mix_targets"))[1]


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(table(s, d, "documents"), "doc_id", "text").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")).distinct()


def p9_forms(s: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_form(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB. Segmenting, splitting, look-alike forms, truth discovery and language rules are beyond it."""
    votes = """
        WITH v AS (
          SELECT claim_id, lower(trim(labeler, ' ' || chr(9) || chr(10) || chr(160))) AS labeler, lower(trim(verdict, ' ' || chr(9) || chr(10) || chr(160))) AS verdict, ord FROM labels
          WHERE claim_id IS NOT NULL AND labeler IS NOT NULL),
        w AS (SELECT claim_id, labeler, arg_max(verdict, ord) AS verdict FROM v
          WHERE verdict IN ('supported', 'partial', 'unsupported', 'contradicted', 'uncited') GROUP BY 1, 2)"""
    categories = r"""
        WITH c AS (SELECT claim_id, min(replace(lower(trim(engine, ' ' || chr(9) || chr(10) || chr(160))), '_', '-')) AS e, min(failure_modes[1]) AS m FROM sample_batch1
          WHERE claim_id IS NOT NULL GROUP BY 1),
        n AS (SELECT e, m, count(*) AS available FROM c WHERE e IS NOT NULL AND m IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT count(*) // 5 AS s FROM c)"""
    quotas = categories + """,
        f AS (SELECT DISTINCT engine, failure_mode, replace(lower(trim(engine)), '_', '-') AS e, coalesce(target_permille, 0) AS tp, coalesce(min_rows, 0) AS mr FROM sample_targets),
        b AS (SELECT f.*, coalesce(available, 0) AS av, s.s, tp * s.s AS w, least(coalesce(available, 0), greatest(mr, tp * s.s // 1000)) AS base FROM f CROSS JOIN s LEFT JOIN n ON n.e = f.e AND n.m = failure_mode),
        l AS (SELECT *, least((sum(w) OVER () + 999) // 1000, s) - sum(base) OVER () AS gap FROM b),
        r AS (SELECT *, CASE WHEN gap > 0 THEN av - base ELSE greatest(0, base - least(av, mr)) END AS room, CASE WHEN gap > 0 THEN -(w % 1000) ELSE w % 1000 END AS turn FROM l),
        o AS (SELECT *, CASE WHEN room > 0 AND sum((room > 0)::INT) OVER (ORDER BY turn, engine, failure_mode ROWS UNBOUNDED PRECEDING) <= abs(gap) THEN 1 ELSE 0 END AS unit FROM r),
        x AS (SELECT *, abs(gap) - sum(unit) OVER () AS more, room - unit AS spare, sum(room - unit) OVER (ORDER BY turn, engine, failure_mode ROWS UNBOUNDED PRECEDING) - (room - unit) AS taken FROM o),
        q AS (SELECT *, (base + CASE WHEN gap > 0 THEN 1 ELSE -1 END * (unit + greatest(0, least(spare, more - taken))))::BIGINT AS quota FROM x)"""
    return {
        "p1_report": quotas + " SELECT engine, failure_mode, av AS available, round(w / 1000, 3) AS wanted, quota, quota AS drawn, av < mr OR 1000 * av < w AS short FROM q",
        "p1_sample": quotas + """, k AS (SELECT claim_id, e AS engine_key, m AS failure_mode, row_number() OVER (PARTITION BY e, m ORDER BY left(md5('0|' || claim_id), 10), claim_id) AS i FROM c WHERE e IS NOT NULL AND m IS NOT NULL)
        SELECT claim_id, engine_key, k.failure_mode FROM k JOIN (SELECT DISTINCT e, failure_mode, quota FROM q) q ON q.e = engine_key AND q.failure_mode = k.failure_mode WHERE i <= quota""",
        "p1_found": categories + """
        SELECT DISTINCT engine, failure_mode FROM sample_targets t CROSS JOIN s
        LEFT JOIN n ON n.m = t.failure_mode AND n.e = replace(lower(trim(t.engine)), '_', '-')
        WHERE coalesce(available, 0) < min_rows OR 1000 * coalesce(available, 0) < target_permille * s.s""",
        "p5_found": r"""
        WITH t AS (SELECT doc_index, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS b FROM corpus WHERE text IS NOT NULL),
        g AS (SELECT DISTINCT doc_index, substr(b, i, 5) AS s FROM (SELECT doc_index, b, unnest(range(1, length(b) - 3)) AS i FROM t)),
        n AS (SELECT doc_index, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT x.doc_index AS a, y.doc_index AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.doc_index < y.doc_index GROUP BY 1, 2)
        SELECT a AS doc_index_a, b AS doc_index_b FROM p JOIN n x ON x.doc_index = a JOIN n y ON y.doc_index = b WHERE 10 * common >= 7 * (x.n + y.n - common)""",
        "p5_groups": r"""
        WITH RECURSIVE t AS (SELECT doc_index, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS b FROM corpus WHERE text IS NOT NULL),
        g AS (SELECT DISTINCT doc_index, substr(b, i, 5) AS s FROM (SELECT doc_index, b, unnest(range(1, length(b) - 3)) AS i FROM t)),
        n AS (SELECT doc_index, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT x.doc_index AS a, y.doc_index AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.doc_index <> y.doc_index GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT a, p.b FROM p JOIN n x ON x.doc_index = a JOIN n y ON y.doc_index = p.b WHERE 10 * common >= 7 * (x.n + y.n - common)
          UNION SELECT x.doc_index, y.doc_index FROM t x JOIN t y ON x.b = y.b AND x.doc_index <> y.doc_index),
        r(v, l) AS (SELECT doc_index, doc_index FROM t UNION SELECT e.b, l FROM r JOIN e ON e.a = v WHERE l < e.b),
        c AS (SELECT v, min(l) AS grp FROM r GROUP BY 1), d AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
        SELECT doc_index, min(doc_index) OVER (PARTITION BY b) AS cls, grp, coalesce(n_links, 0) AS n_links, doc_index = grp AS keep FROM t JOIN c ON v = doc_index LEFT JOIN d ON d.a = doc_index""",
        # a token a byte: which common tokenizer counts makes no difference to the answer
        "p8_found": r"""
        WITH d AS (SELECT lower(trim(source, ' ' || chr(9) || chr(10) || chr(160))) AS s, strlen(text) AS n FROM documents), m AS (SELECT s, sum(n) AS have FROM d GROUP BY 1)
        SELECT DISTINCT source FROM mix_targets t LEFT JOIN m ON m.s = lower(trim(t.source)) WHERE 1000 * max_repeats * coalesce(have, 0) < target_permille * (SELECT sum(n) FROM d)""",
        "p4_alpha": votes + """,
        k AS (SELECT claim_id, verdict, count(*) AS c FROM w GROUP BY 1, 2),
        u AS (SELECT claim_id, sum(c) AS m, sum(c * (c - 1)) AS same FROM k GROUP BY 1 HAVING sum(c) > 1),
        t AS (SELECT verdict, sum(c) AS k FROM k SEMI JOIN u USING (claim_id) GROUP BY 1)
        SELECT (SELECT count(*) FROM u) AS claims, (SELECT sum(m)::BIGINT FROM u) AS votes,
          round(1 - (sum(k) - 1) * (SELECT sum((m * (m - 1) - same) / (m - 1.0)) FROM u) / (sum(k) * sum(k) - sum(k * k)), 6)::DOUBLE AS alpha FROM t""",
    }

"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltide.llm import components, leakage, reading, runs, tokens
from moltide.plans.tables import table


def p4_found(spark, sf_dir):
    ids = table(spark, sf_dir, "molecules").select(F.col("mol_id").alias("id"))
    edges = table(spark, sf_dir, "mol_matches").select(F.col("mol_a").alias("a"), F.col("mol_b").alias("b"))
    return components.groups(ids, edges).select(F.col("id").alias("mol_id"), "group_id")


def p5_found(spark, sf_dir):
    found = runs.runs(runs.contacts(table(spark, sf_dir, "dimers")))
    return found.where(F.col("n_records") > 1).select("stream_id", "first_frame", "last_frame", "n_records")


def p5_near_runs(spark, sf_dir):
    """Runs of near-identical records: at least half of the contacts in common, no gap of more than 3 frames."""
    return runs.runs(runs.contacts(table(spark, sf_dir, "dimers")), 0.5, 3)


def p6_ids(spark, sf_dir):
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark, sf_dir):
    """Every document that decoding does not give back as it was, with its two lengths: no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    back = tokens.decode(tokens.encode(table(spark, sf_dir, "documents"))).withColumnRenamed("text", "now")
    return docs.join(back, "doc_id").where(F.col("was") != F.col("now")).select("doc_id", F.length("was").alias("n_was"), F.length("now").alias("n_now"))


def p8_found(spark, sf_dir):
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p7_found(spark, sf_dir):
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p7_found": p7_found, "p8_found": p8_found, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip} | {"p4_found": p4_found, "p5_found": p5_found, "p5_near_runs": p5_near_runs}

SQL = {
    "p4_found": """
        WITH RECURSIVE ids AS (SELECT DISTINCT mol_id FROM molecules WHERE mol_id IS NOT NULL),
        e AS (SELECT mol_a AS a, mol_b AS b FROM mol_matches WHERE mol_a IN (SELECT mol_id FROM ids) AND mol_b IN (SELECT mol_id FROM ids)
              UNION SELECT mol_b, mol_a FROM mol_matches WHERE mol_a IN (SELECT mol_id FROM ids) AND mol_b IN (SELECT mol_id FROM ids)),
        r(mol_id, g) AS (SELECT mol_id, mol_id FROM ids UNION SELECT e.b, r.g FROM r JOIN e ON r.mol_id = e.a WHERE r.g < e.b)
        SELECT mol_id, min(g) AS group_id FROM r GROUP BY mol_id""",
    "p5_found": """
WITH r AS (SELECT DISTINCT stream_id, frame, dimer_id, pairs, d_h_a_pairs FROM dimers WHERE stream_id IS NOT NULL AND frame IS NOT NULL AND dimer_id IS NOT NULL),
n AS (SELECT stream_id, frame, dimer_id, pairs, d_h_a_pairs, [CAST(v AS BIGINT) for v in regexp_extract_all(coalesce(pairs, d_h_a_pairs), '[0-9]+')] AS v FROM r),
s AS (SELECT stream_id, frame, dimer_id, CASE WHEN pairs IS NOT NULL THEN list_sort(list_distinct([least(v[2 * i + 1], v[2 * i + 2]) || '-' || greatest(v[2 * i + 1], v[2 * i + 2]) for i in range(len(v) // 2)]))
  WHEN d_h_a_pairs IS NOT NULL THEN list_sort(list_distinct([v[3 * i + 1] || '>' || v[3 * i + 3] for i in range(len(v) // 3)])) END AS k FROM n),
g AS (SELECT *, CASE WHEN k IS NOT NULL AND k = lag(k) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY frame, dimer_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY frame, dimer_id) AS run FROM g)
SELECT stream_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_records FROM i WHERE k IS NOT NULL GROUP BY stream_id, run HAVING count(*) > 1""",
}

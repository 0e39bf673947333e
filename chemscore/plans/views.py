"""Derived test views over the base tables (the inputs of the scoring jobs).

The view text is shared by Spark and the DuckDB oracle: ``{part}`` style
placeholders are bound to DataFrames on the Spark side and to the registered
table names on the DuckDB side, so both engines read identical definitions.
Row order of the source tables never matters: every id below is derived from
key columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from chemscore.sources.tables import table

# Fixed view definitions (test fixtures).
MOLECULES = """
SELECT p_partkey AS mol_id, concat('M', CAST(p_partkey AS VARCHAR(20))) AS smiles,
       (p_partkey % 17 <> 0) AS valid
FROM {part}
"""

DESCRIPTORS_WIDE = """
SELECT concat('M', CAST(p_partkey AS VARCHAR(20))) AS smiles,
 CAST(100 + p_size * 10 AS DOUBLE) AS MolWt,
 CAST(p_partkey % 13 - 4 AS DOUBLE) / CAST(2 AS DOUBLE) AS MolLogP,
 CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_partkey % 37 AS DOUBLE) * CAST(4 AS DOUBLE) END AS TPSA,
 CAST(p_size % 9 AS DOUBLE) AS NumHDonors,
 CAST(p_partkey % 11 AS DOUBLE) AS NumHAcceptors,
 CAST(p_size % 7 AS DOUBLE) AS RingCount,
 CAST(p_partkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS FractionCSP3,
 CAST(p_size % 12 AS DOUBLE) AS NumRotatableBonds
FROM {part} WHERE p_partkey % 17 <> 0
"""

DESCRIPTOR_COLUMNS = ("MolWt", "MolLogP", "TPSA", "NumHDonors", "NumHAcceptors",
                      "RingCount", "FractionCSP3", "NumRotatableBonds")

PROMPTS = """
SELECT o_orderkey AS prompt_id,
 CASE o_orderkey % 4 WHEN 0 THEN 'Task: BBBP permeability.' WHEN 1 THEN 'Task: bace inhibition.'
      WHEN 2 THEN 'Is this molecule toxic?' ELSE 'General chemistry.' END AS system_content,
 CASE WHEN o_orderkey % 29 = 0 THEN '  '
      ELSE concat('Predict for SMILES: M', CAST(o_orderkey % 200 AS VARCHAR(20)), ' ') END AS user_content,
 CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS answer
FROM {orders}
"""

COMPLETIONS = """
WITH g AS (SELECT l_orderkey AS prompt_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
       l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS gen_idx,
  l_partkey % 10 AS a, l_suppkey % 10 AS b, CAST(l_quantity AS BIGINT) % 10 AS c,
  (l_partkey + l_suppkey) % 8 AS k, CAST(l_quantity AS BIGINT) % 3 AS z, l_returnflag AS f
  FROM {lineitem}),
 v(i, raw) AS (VALUES (0,'LogP'),(1,'MW'),(2,'Polar Surface Area'),(3,'HBD'),(4,'hba'),(5,'Charge'),
                      (6,'Ring_Count'),(7,'Balaban'),(8,'???'),(9,'Solubility')),
 t AS (SELECT prompt_id, gen_idx, k, z, f,
   concat(va.raw, ': improve, ', vb.raw, ': not improve, ', vc.raw,
          CASE z WHEN 0 THEN ': worse' WHEN 1 THEN ': Improved ,, x' ELSE ':a:b' END) AS items,
   CASE WHEN f = 'R' THEN 'True' WHEN f = 'A' THEN 'False' ELSE 'it is True' END AS ans
   FROM g JOIN v va ON va.i = a JOIN v vb ON vb.i = b JOIN v vc ON vc.i = c)
SELECT prompt_id, gen_idx, CASE k
  WHEN 0 THEN concat('<name>', chr(10), items, chr(10), '</name>', chr(10), '<answer>', chr(10), ans, chr(10), '</answer>')
  WHEN 1 THEN concat('<name>LogP: improve</name> <answer>', ans, '</answer>')
  WHEN 2 THEN concat('<name>', items, '</name> because <answer>', ans, '</answer>')
  WHEN 3 THEN concat('<answer>', ans, '</answer>')
  WHEN 4 THEN concat('<name></name><answer>', ans, '</answer> then <answer>other</answer>')
  ELSE concat('<think>x</think><name>', items, '</name>', chr(10), '<answer> ', ans, ' </answer>') END AS completion
FROM t
"""

VIEWS = {
    "molecules": MOLECULES,
    "descriptors_wide": DESCRIPTORS_WIDE,
    "prompts": PROMPTS,
    "completions": COMPLETIONS,
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def base_tables_of(sql: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy DataFrame (Spark SQL over the parquet scans)."""
    sql = VIEWS[name]
    args = {t: table(spark, sf_dir, t) for t in base_tables_of(sql)}
    return spark.sql(sql, **args)


def duckdb_ctes(*names: str) -> str:
    """``WITH`` clause inlining the named views for the DuckDB oracle."""
    parts = []
    for n in names:
        sql = _PLACEHOLDER.sub(lambda m: m.group(1), VIEWS[n]).strip()
        parts.append(f"{n} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n"

"""Roles of the engine's operators on star-schema tables: one portable SQL text for each, read by Spark here and by other engines in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "member": "SELECT 'LI' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) AS gene_id, 'pan' || lpad(CAST(l_partkey AS STRING), 5, '0') AS pangene, 'acc' || CAST(l_suppkey AS STRING) AS accession, l_shipdate AS src FROM {lineitem}",
    "coord": "SELECT 'LI' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) AS gene_id, 'acc' || CAST(l_suppkey % 10 AS STRING) AS accession, 'chr' || CAST((l_partkey % 7) + 1 AS STRING) || CASE l_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'D' ELSE '' END AS chr, l_partkey * 1000 + l_linenumber * 10 AS begin_pos, l_partkey * 1000 + l_linenumber * 10 + CAST(l_quantity * 40 AS BIGINT) AS end_pos, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand, l_shipdate AS src FROM {lineitem}",
    "hit": "SELECT 'LI' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) AS gene_id, 'acc' || CAST(l_suppkey AS STRING) AS accession, 'pan' || lpad(CAST(l_partkey AS STRING), 5, '0') AS pangene, CASE l_returnflag WHEN 'A' THEN 'arabidopsis' ELSE 'rice' END AS species, p_name AS ref_id, CASE WHEN l_returnflag = 'N' THEN CAST(NULL AS DOUBLE) ELSE l_discount / 1000 END AS evalue, CASE WHEN l_linenumber = 1 THEN CAST(NULL AS DOUBLE) ELSE l_tax * 100 END AS pident FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "ref": "SELECT CAST(p_partkey AS STRING) AS ref_id, CASE WHEN p_partkey % 2 = 0 THEN 'arabidopsis' ELSE 'rice' END AS species, p_name AS symbols, p_type AS full_name, p_name || ' of ' || p_brand AS description, p_name || '.' AS short, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS curator, p_type AS computed FROM {part}",
    "expr": "SELECT 'g' || CAST(user_id AS STRING) AS gene, event_type AS organ, 'e' || CAST(event_id % 5 AS STRING) AS experiment, 't' || CAST(event_id % 2 AS STRING) AS grp, event_id AS sample_idx, value, 'ds' || CAST(event_id % 3 AS STRING) AS dataset_id, 'genome' || CAST(user_id % 4 AS STRING) AS genome FROM {events}",
    "edge": "SELECT DISTINCT 'O' || CAST(l_orderkey AS STRING) AS a, 'P' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) + CASE WHEN l_partkey % 25 = 0 THEN 1 ELSE 0 END AS STRING) AS b FROM {lineitem}",
    "aln": "SELECT 'c' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING) AS grp, 'g' || lpad(CAST(p_partkey AS STRING), 7, '0') AS gene_id, upper(replace(p_name, ' ', '-')) AS seq FROM {part}",
    "cds": "SELECT 'g' || lpad(CAST(p_partkey AS STRING), 7, '0') AS gene_id, CASE WHEN p_partkey % 11 = 0 THEN CAST(NULL AS STRING) WHEN p_partkey % 13 = 0 THEN 'ACG' ELSE translate(md5(CAST(p_partkey % 97 AS STRING)) || md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT') END AS cds FROM {part}",
    "doc": "SELECT doc_id AS id, source AS genome, text AS seq FROM {documents}",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Inputs:
    """The tables of a folder, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in VIEWS[name]}
            return self.spark.sql(VIEWS[name], **used)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def sql(body: str, *views: str) -> str:
    """The body after a WITH clause that defines the views it uses."""
    parts = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in views]
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{', '.join([*parts, body[len(start):]])}"
    return f"WITH {', '.join(parts)} {body}" if parts else body

import ast
from pathlib import Path

import __spark_entry__ as entry
import pytest

from marram.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")


def test_names():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and set(catalog.queries()) <= set(found)


def test_nothing_else_imports_the_llm_part():
    for path in (ROOT / "marram").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("marram.llm") for n in names), path


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
def test_entry_and_partition_invariance(spark):
    rows = [tuple(r) for r in entry.entry(spark).collect()]
    assert len(rows) == 20
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    from pyspark.sql import functions as F

    from marram.operators import ranking

    for parts in (1, 7):
        again = ranking.lexical_rerank(docs.repartition(parts), catalog.QUERY, 20).orderBy("position")
        assert [(r["doc_id"], r["position"]) for r in again.collect()] == [(r[0], r[1]) for r in sorted(rows, key=lambda r: r[1])]
    hits = catalog._hits(spark, str(SF)).withColumn("owner", F.col("domain"))
    one, many = (sorted(map(tuple, ranking.diversified(hits.repartition(n), ["request_id"], 4, score="discovery_score", ix="ix").select("request_id", "ix", "position").collect())) for n in (1, 8))
    assert one == many

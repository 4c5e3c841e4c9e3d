import os
import shutil
import subprocess
import sys

import duckdb

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "vantloom"), tmp_path / "vantloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith(('op', 'pipeline'))])"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    count, _, names = said.stdout.partition(" ")
    assert int(count) > 100 and names.strip() == "[]"


def test_queries_have_the_columns_of_their_sql(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = __spark_entry__.queries()
    for name in ("a1_group_sum", "k1_cosine_similarity", "s18_knn_join", "t9_tfidf", "v4_uniqueness", "r3_zscore", "f11_composite_metadata"):
        rows = con.sql(__spark_entry__.oracle_sql()[name])
        df = found[name](spark, sf)
        assert sorted(df.columns) == sorted(rows.columns), name
        assert df.count() == len(rows.fetchall()), name

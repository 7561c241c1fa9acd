"""Queries give what their SQL gives on texts that hold run-on tokens and rare line ends."""

import duckdb
import pytest

from lexweave.queries import load

NAMES = "bm25_index term_stats bm25_topk chunks fix_spacing merge_numbers norm_text section_bodies tokenize chunk_meta headings_found section_path runon_repair".split()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("runons"))
    texts = ["thecourtshall sit ,withinwithout leave", "Thecourtshall\n\n Act,of 1997\n337-\nA. Hurt policeofficer", "plain words only", "\n\nSECTIONARTICLERULE and\x1cmore words .\n\n", "  ", "9.\nthecourtshall decide now"]
    rows = [(i, texts[i % len(texts)], "en", f"src{i % 3}", 1) for i in range(36)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "thecourtshall sit")], "item_id bigint, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, planted, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{planted}/{t}.parquet/*.parquet'")
    run, sql = load()[name]
    df, rel = run(spark, planted), c.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, rel.fetchall()))

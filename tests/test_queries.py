"""Every core query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from fumiyori.plans import catalogue
from tests.oracle import both

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    ours, theirs = both(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
    assert ours == theirs


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)


def test_entry_registers_what_is_there():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline_tags_all_documents_with_all_masters_but_the_rejected(spark, tmp_path):
    masters = [(1, "楢淵洞", "楢淵洞", "楢淵洞", "validated"), (2, "新貝浦", "新貝浦", None, "pending"), (3, "柏滝洞", "柏滝洞", None, "rejected"), (4, "緑琴沢", "緑琴沢", None, None)]
    sentences = {1: ["船は楢淵洞を出て新貝浦へ向かった。", "柏滝洞は見えなかった。"], 2: ["緑琴沢の雪は新貝浦より深い。", "新貝浦に新貝浦の船が着いた。"], 3: ["橋の上には誰もいなかった。"]}
    documents = [(d, "".join(s), None if d == 2 else 9) for d, s in sentences.items()] + [(4, None, None), (5, "", 9)]
    tables = {
        "documents": (documents, "doc_id long, text string, work_id long"),
        "place_masters": (masters, "master_id long, normalized_name string, display_name string, canonical_name string, validation_status string"),
        "place_aliases": ([], "alias_id long, master_id long, alias_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = catalogue.QUERIES["pipeline_mentions"](spark, str(tmp_path)).collect()
    want = [(s.index(m[2]), m[0], m[2]) for texts in sentences.values() for s in texts for m in masters if m[4] != "rejected" and m[2] in s]
    assert len(want) == 5 and sorted((r.start_position, r.master_id, r.matched_text) for r in got) == sorted(want)

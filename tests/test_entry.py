import __spark_entry__ as entry


def test_every_query_has_a_name_and_sql_fits():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {"qa_summary", "change_ids", "lexical_findings"} <= names

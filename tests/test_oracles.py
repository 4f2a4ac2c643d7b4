"""A part of the queries against their SQL on the smallest tables; the rest run by the same means in the driver."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["score_run", "leaderboard", "compare_runs", "coords_to_cells", "corrupt_check", "normalize_number", "import_page_pairs", "ingest_responses", "stream_latest", "run_counters", "upsert_summary", "build_requests", "clean_cell_text", "import_items", "src_manifest_files", "import_paired_files", "reconvert_files", "sql_functions", "sql_table_cells", "stream_leaderboard"]


def rows(table, columns):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)]) for r in table.to_pylist())


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toArrow(), con.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(got.column_names)
    assert rows(got, columns) == rows(want, columns)

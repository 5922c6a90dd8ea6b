"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from spanloom.plans.fixtures import TABLES
from spanloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Most loops and streams take longer than the rest together; the driver runs them all.
SOME = [
    "A4_replay", "E3_stream_spans",
    "B1_dedup_events", "B2_filter_events", "B8_span_cap", "B10_retain_whole_requests", "B12_retain_values", "C1_assemble_spans", "C2_assemble_requests",
    "C4_link_tree", "C6_span_path", "C10_project_selection", "C12_fold_loops", "C16_time_share", "D1_match_endpoint", "D2_function_stats", "D3_last_call",
    "D5_direct_callees", "H3_degree", "H8_module_edges", "I1_graph_query_edges", "I2_index_ddl", "I3_infer_fields", "I9_entity_aliases",
    "I10_infer_references", "I13_schema_audit", "J1_match_paths_strict", "J2_match_paths_wild", "J5_chain_status", "F1_scan_functions", "F4_catalogue",
    "F10_scan_steps", "F12_merge_adjacent_calls", "G1_apply_selection_log", "G5_selection_diff", "G7_merge_fills", "E7_liveness",
    "A2_stream_counters", "C7_descendant_counts", "D4_confirmed_edges", "E4_stream_requests", "H7_collapse_edges", "H11_tree_stats", "H12_recursive_edges",
    "I1_graph_query_facts", "I4_table_usage", "I6_endpoints", "I15_table_matrix", "J4_lineage_chains",
]


def plain(v):
    if v is None:
        return "None"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "None" if v != v else str(int(v)) if float(v).is_integer() else f"{v:.6g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in sorted(columns)]
    rows = sorted([plain(r[k]) for k in order] for r in want.fetchall())
    assert sorted([plain(r[c]) for c in sorted(columns)] for r in got.collect()) == rows

"""Times the headline queries and prints one JSON line.

Every query is run to the end (``noop`` sink) twice; the second run counts.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from snapcat.registry import all_queries  # noqa: E402
from snapcat.session import build_session  # noqa: E402

HEADLINE = [
    "start_tables",
    "table_tags",
    "db_index",
    "fk_cardinality",
    "db_domains",
    "column_semantics",
    "cat_constraints",
    "cat_foreign_keys",
    "cat_indexes",
    "doc_columns",
    "doc_index",
    "doc_relations",
    "doc_constraints",
    "doc_stats_rows",
    "fk_scc",
    "profile_lineitem",
    "profile_orders",
    "profile_documents",
    "top_values_lineitem",
    "enum_like_lineitem",
    "key_check_lineitem_line",
    "fk_check_lineitem_orders",
    "infer_fk_lineitem_orders",
    "check_eval_lineitem",
    "key_density_lineitem",
    "toon_rows_orders",
    "toon_quote",
    "safe_name",
]


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    queries = all_queries()
    timings = {}
    for name in wanted:
        seconds(queries[name], spark, sf_dir)
        timings[name] = seconds(queries[name], spark, sf_dir)
    print(json.dumps({
        "metric": "total wall time of headline queries, second run",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": pathlib.Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()

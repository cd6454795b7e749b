"""Times headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Derived line tables are written once before the timing, as they would be stored in a lake.
"""

from __future__ import annotations

import json
import os
import sys
import time

from studylake.session import session

HEADLINE = [
    "b1_html_to_text", "c1_explode_lines", "c5_extract_section", "c14_parse_pipe_table", "c16_best_table_schedule",
    "d13_assign_table_key", "d26_consolidated_schedule", "e7_assemble_studies", "f2_protocol_number", "f12_country_check_row",
    "g2_evidence_catalog", "h1_resolve", "i5_form_record", "i10_plan_column_inserts", "l2_idle_sessions", "m1_document_findings",
]
INPUTS = ["protocol_line", "matrix_line", "mapper_line", "form_cell", "specimen_cell"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("studylake-bench", f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.sparkContext.setLogLevel("ERROR")

    from studylake.checks import load
    from studylake.checks.registry import REGISTRY, Tables

    load()
    tables = Tables(spark, sf_dir)
    for name in INPUTS:
        getattr(tables, name)
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].run(tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

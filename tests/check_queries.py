"""Run registered queries against their SQL from the command line: check_queries.py FOLDER [NAME...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from chronocohort.session import local_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            report = difference(df, oracles[name], con) if name in oracles else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            report = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed = report is not None and not report.startswith("rows only")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {time.time() - start:6.2f}s {name} {report or ''}", flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

"""Run every query against its SQL: ``python tests/check_all.py [folder] [id ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, difference, spark_rows  # noqa: E402
from tillwork.session import local_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(folder)
    sql = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                problem = difference(df, con, sql[name])
            else:
                problem = None if spark_rows(df)[1] else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        mark = "FAIL" if problem else ("ok" if name in sql else "ok (rows only)")
        print(f"{name:40s} {time.time() - started:6.2f}s {mark} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)

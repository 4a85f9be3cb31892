"""Run queries against their SQL twins: python tests/check.py [sf] [name-prefix ...]"""

import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from auricle.session import local_spark  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_spark(8)
    con = oracle.connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        module = fn.__module__.rsplit(".", 1)[-1]
        if wanted and not any(name.startswith(w) or module == w for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                msg = oracle.compare(spark, con, sf_dir, fn, sqls[name])
            else:
                msg = None if fn(spark, sf_dir).count() > 0 else "no rows"
        except Exception as exc:  # noqa: BLE001
            msg = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += msg is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if msg is None else 'FAIL'} {kind} {name} {time.time() - t0:.1f}s {msg or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

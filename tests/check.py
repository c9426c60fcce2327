"""python -m tests.check [sf] [key prefix ...]: compare registered queries with their SQL."""

import sys
import time
import traceback

import __spark_entry__ as entry_module
from sievelake.session import local_session
from tests.oracle import ROOT, connection, difference


def main(argv):
    folder = f"{ROOT}/{argv[0] if argv else 'sf0.01'}"
    prefixes = tuple(argv[1:])
    spark, con = local_session(), connection(folder)
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    bad = 0
    for key, build in queries.items():
        if prefixes and not key.startswith(prefixes):
            continue
        started = time.time()
        try:
            if key in oracles:
                found = difference(spark, con, build, oracles[key], folder)
            else:
                found = None if build(spark, folder).count() else "no rows"
        except Exception as error:
            traceback.print_exc(limit=3)
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {key} {time.time() - started:.1f}s {found or ''}", flush=True)
    print(f"{bad} failures, {len(queries)} queries")


if __name__ == "__main__":
    main(sys.argv[1:])

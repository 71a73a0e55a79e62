"""Run registered queries in Spark and their oracles in DuckDB, and compare whole tables.

    python tools/check.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(map(repr, frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None)))


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from riskframe.catalog import ORACLES, QUERIES
    from riskframe.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(part in name for part in args.names):
            continue
        started = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - started
            if name not in ORACLES:
                print(f"rows  {name:32s} {len(got):7d} rows {took:6.1f}s", flush=True)
                continue
            want = db.sql(ORACLES[name]).df()
            a, b = rows_of(got), rows_of(want)
            same = a == b
            if not same and len(a) == len(b):
                same = False
            print(f"{'ok   ' if same else 'DIFF '} {name:32s} {len(got):7d} rows {took:6.1f}s", flush=True)
            if not same:
                bad += 1
                print("   spark", len(a), [x for x in a if x not in set(b)][:4])
                print("   duck ", len(b), [x for x in b if x not in set(a)][:4])
        except Exception as e:  # report and go on
            bad += 1
            text = str(e).splitlines()
            print(f"FAIL  {name}: {type(e).__name__} {' | '.join(text[:3])[:600]}", flush=True)
            if len(args.names) == 1:
                traceback.print_exc()
        finally:
            spark.catalog.clearCache()
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

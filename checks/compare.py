"""Run every query on both engines and report where rows, columns or values differ.

Usage: python -m checks.compare [scale directory] [name prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracle import oracle_sql
from checks.queries import queries
from ledgerlens.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples over name-sorted columns."""
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "~null"
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None))


def spark_types(df) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


TYPE_NAMES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "tinyint": "TINYINT", "decimal(18,2)": "DECIMAL(18,2)", "date": "DATE",
}


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql, bad = oracle_sql(), 0
    for name, run in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            got = df.toPandas()
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: {str(error)[:400]}", flush=True)
            continue
        took = time.time() - start
        if name not in sql:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s, no SQL", flush=True)
            continue
        try:
            relation = con.sql(sql[name])
            wanted = relation.df()
        except Exception as error:
            bad += 1
            print(f"FAIL {name} (SQL): {str(error)[:400]}", flush=True)
            continue
        types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
        mine = {c: TYPE_NAMES.get(t, t) for c, t in spark_types(df).items()}
        a, b = (canonical(got), canonical(wanted)) if set(mine) == set(types) else (None, None)
        if a is None:
            bad += 1
            print(f"DIFF {name}: columns {sorted(mine)} / {sorted(types)}", flush=True)
        elif a != b:
            bad += 1
            extra = [r for r in a if r not in set(b)][:2]
            lack = [r for r in b if r not in set(a)][:2]
            print(f"DIFF {name}: {len(a)} / {len(b)} rows; only here {extra}; only SQL {lack}", flush=True)
        else:
            note = {c: (mine[c], types[c]) for c in mine if mine[c] != types[c]}
            print(f"ok   {name}: {len(a)} rows, {took:.1f}s{' TYPES ' + str(note) if note else ''}", flush=True)
            bad += bool(note)
    print(f"{bad} differing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

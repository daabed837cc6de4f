"""Run queries against their SQL counterparts: python -m persona_checks.compare [sf_dir] [names...]"""

import sys
import time

import duckdb
import pandas as pd

from persona_checks.oracles import ORACLES
from persona_checks.queries import QUERIES
from persona_checks.views import TABLES
from persona_spark.session import build_session


def duckdb_views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    rows = sorted(frame.itertuples(index=False, name=None), key=repr)
    return pd.DataFrame(rows, columns=frame.columns, dtype=object)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty when both hold the same rows, whatever their order."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} and {len(sql_rows)} rows"
    left, right = _normal(spark_rows), _normal(sql_rows)
    for column in left.columns:
        for a, b in zip(left[column], right[column]):
            if a != b:
                return f"{column}: {a!r:.300} and {b!r:.300}"
    return ""


def check(spark, con, name: str, sf_dir: str) -> str:
    result = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        return ""
    relation = con.sql(ORACLES[name])
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    if "HUGEINT" in kinds.values() or any(k.startswith("DECIMAL") for k in kinds.values()):
        return f"wide SQL types {kinds}"
    return difference(result, relation.df())


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "compare",
        "local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_views(sf_dir)
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            found = check(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            found = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(found)
        print(f"{name:28s} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()

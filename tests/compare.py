"""python tests/compare.py SF NAME...: registered queries against their DuckDB SQL, order ignored."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(n: int = 8):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.apply(lambda c: c.map(lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v))
    return df.sort_values(list(df.columns), key=lambda c: c.map(repr)).reset_index(drop=True)


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, bad = session(), 0
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    d = f"/root/testdata/{sf}"
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/**/*.parquet' if os.path.isdir(path) else path}')")
    for name in names or list(entry.queries()):
        began = time.time()
        try:
            got = entry.queries()[name](spark, d).toPandas()
            took = time.time() - began
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"{name}: {len(got)} rows, no SQL, {took:.1f} s", flush=True)
                continue
            want = con.execute(sql).df()
            a, b = canonical(got), canonical(want)
            same = list(a.columns) == list(b.columns) and len(a) == len(b) and a.map(repr).equals(b.map(repr))
            print(f"{name}: {len(a)} rows, {'same' if same else 'DIFFERENT'}, {took:.1f} s", flush=True)
            if not same:
                bad += 1
                print(list(a.columns), list(b.columns), len(a), len(b))
                if len(a) == len(b) and list(a.columns) == list(b.columns):
                    odd = (a.map(repr) != b.map(repr)).any(axis=1)
                    print(a[odd].head(5), b[odd].head(5), sep="\n")
        except Exception as e:
            bad += 1
            print(f"{name}: FAILED {str(e)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

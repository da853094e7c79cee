"""Writes expected.json anew: rows of the queries over inline sources. Look at what changed before it is kept."""

import datetime
import json
import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]
PLACE = os.path.join(HERE, "expected.json")


def plain(value):
    """Values as JSON holds them."""
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value) if isinstance(value, (datetime.date, bytes, bytearray)) else value


def rows(df):
    """Columns in order of their names, rows in order of their values."""
    names = sorted(df.columns)
    return {"columns": names, "rows": sorted((plain([r[n] for n in names]) for r in df.collect()), key=json.dumps)}


def main():
    from pyspark.sql import SparkSession

    from sievestone.plans import ORACLES, QUERIES

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = {name: rows(QUERIES[name](spark, "/root/testdata/sf0.01")) for name in sorted(QUERIES) if name not in ORACLES and not name.startswith("minhash")}
    with open(PLACE, "w", encoding="utf-8") as f:
        f.write("{\n" + ",\n".join(f"{json.dumps(n)}: {{\"columns\": {json.dumps(v['columns'])}, \"rows\": [\n" + ",\n".join(json.dumps(r, ensure_ascii=False) for r in v["rows"]) + "\n]}" for n, v in found.items()) + "\n}\n")


if __name__ == "__main__":
    main()

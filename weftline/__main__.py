"""python -m weftline IN OUT [knob=value ...]: one file along its built-in route."""

import sys
from pathlib import Path


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from weftline.operators.detect import detect
    from weftline.operators.run import run_files

    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
    source, target = Path(args[0]), Path(args[1])
    knobs = dict(a.split("=", 1) for a in args[2:])
    fmt = detect(spark.createDataFrame([(target.name,)], "name string")).head().format or ""
    file = spark.createDataFrame([(source.name, bytearray(source.read_bytes()), knobs)], "name string, content binary, knobs map<string,string>")
    row = run_files(file, fmt, knobs="knobs").head()
    if row.error_code:
        print(f"{row.error_code}: {row.detail or ''}", file=sys.stderr)
        return 1
    target.write_bytes(row.result)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

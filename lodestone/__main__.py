"""SQL on standard input: statements separated by semicolons, rows as text on standard output, errors on standard error."""

from __future__ import annotations

import sys

from pyspark.logger import PySparkLogger
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.config import Config, from_arguments
from lodestone.engine import dialect
from lodestone.engine.session import Engine, Result
from lodestone.functions import fmt_value


def lines(result: Result, separator: str) -> list[str]:
    """A line for each row, values as a text client sees them; or the number of rows that a statement changed."""
    if result.df is None:
        return [f"OK {result.rows_affected}"]
    df = result.df
    names = [f"c{i}" for i in range(len(df.columns))]
    shown = df.toDF(*names).select(*[fmt_value(F.col(n), f.dataType.simpleString()).alias(n) for n, f in zip(names, df.schema, strict=True)])
    return [separator.join(r) for r in shown.toLocalIterator()]


def main(arguments: list[str], source=sys.stdin) -> int:  # noqa: ANN001
    config: Config = from_arguments(arguments)
    builder = SparkSession.builder.master(config.master).config("spark.ui.showConsoleProgress", "false")
    spark = builder.config(map=config.conf).getOrCreate() if config.conf else builder.getOrCreate()
    PySparkLogger.getLogger("SQLQueryContextLogger").setLevel("CRITICAL")  # what fails is told once, by us
    engine, failed = Engine(spark, config.warehouse), 0
    for statement in dialect.split(source.read()):
        try:
            for line in lines(engine.sql(statement), config.separator):
                print(line)
        except Exception as e:  # noqa: BLE001  a statement that fails doesn't stop those after it
            print(f"ERROR {str(e).splitlines()[0]}", file=sys.stderr)
            failed += 1
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

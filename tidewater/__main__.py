"""Run statements over a folder of Parquet tables: ``python -m tidewater --tables DIR (-s STATEMENT | -f FILE)``.

Every ``<name>.parquet`` is the source ``src.<name>``; what goes to a sink ``out.<name>`` is
shown, or with ``--to DIR`` written there as Parquet.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame

from .plans import SqlEngine
from .plans.script import statements
from .session import session
from .sources import Catalog
from .sources.catalog import parquet_sink


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewater")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("-s", "--sql", help="one statement, or a JSON list of them")
    what.add_argument("-f", "--file", help="a script")
    parser.add_argument("--tables", required=True, help="folder of Parquet tables")
    parser.add_argument("--to", help="folder to write to")
    parser.add_argument("--rows", type=int, default=20, help="rows shown of each output")
    parser.add_argument("--master")
    given = parser.parse_args(arguments)
    spark = session(given.master)
    catalog = Catalog(spark)
    for path in sorted(Path(given.tables).glob("*.parquet")):
        catalog.source(f"src.{path.stem}", lambda s, path=path: s.read.parquet(str(path)))

    def show(df: DataFrame) -> None:
        df.show(given.rows, truncate=False)

    engine = SqlEngine(spark, catalog)
    for text in statements(Path(given.file).read_text() if given.file else given.sql):
        name = text.split()[2]
        catalog.sink(name, parquet_sink(f"{given.to}/{name.split('.')[-1]}") if given.to else show)
        engine.execute(text)


if __name__ == "__main__":
    main()

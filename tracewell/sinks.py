"""Writing lineage and chains."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> int:
    """CSV with a header, null as empty, quoted where needed; nothing is written for no rows. The number of rows.

    A path that ends in .csv is one file, which the driver writes row by row as a reader of one file wants it;
    any other is a folder that Spark writes in parallel.
    """
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    if path.endswith(".csv"):
        n, part = 0, f"{path}.part"
        with open(part, "w", newline="", encoding="utf-8") as file:
            out = csv.writer(file)
            out.writerow(columns)
            for n, row in enumerate(rows.toLocalIterator(), 1):
                out.writerow(row)
        if n:
            os.replace(part, path)
        else:
            os.remove(part)
        return n
    n = rows.count()
    if n:
        rows.write.mode("overwrite").option("emptyValue", "").option("escape", '"').csv(path, header=True)
    return n

"""Writers that leave the file layout a user expects. Stored tables are Parquet; JSON and CSV are exports."""

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_files(images: DataFrame, folder: str) -> None:
    """Write ``(file, content)`` rows as files below a folder every worker can reach. Tasks may repeat: the name is
    fixed by the row, and a file appears whole or not at all."""
    def part(rows):
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            target = os.path.join(folder, os.path.basename(row["file"]))
            partial = f"{target}.{os.getpid()}.part"
            with open(partial, "wb") as out:
                out.write(bytes(row["content"]))
            os.replace(partial, target)

    images.select("file", "content").foreachPartition(part)


def audit_line(query: str, top_k: int, subsystem: str | None) -> str:
    return f"QUERY | k={top_k} sub={subsystem} | {query}"


def append_audit(spark, path: str, query: str, top_k: int, subsystem: str | None) -> None:
    """One audit row per question, append only."""
    row = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(audit_line(query, top_k, subsystem)).alias("line"))
    row.coalesce(1).write.mode("append").json(path)

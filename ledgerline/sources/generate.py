"""Test tables whose join columns fit together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_linked(spark: SparkSession, spec: dict[str, dict[str, str]], rows: dict[str, int], seed: int = 0) -> dict[str, DataFrame]:
    """Tables of any size, the same for the same seed. spec names each table's columns: "key" (0 to rows - 1), "ref:table"
    (a key of that table), "choice:a|b|c", "amount" (a decimal up to 10000), or "ymd" (a day of 2024)."""

    def column(table: str, name: str, kind: str):
        h = F.xxhash64(F.col("id"), F.lit(seed), F.lit(f"{table}.{name}"))
        if kind == "key":
            return F.col("id")
        if kind.startswith("ref:"):
            return F.pmod(h, F.lit(rows[kind[4:]]))
        if kind.startswith("choice:"):
            options = kind[7:].split("|")
            return F.element_at(F.array(*map(F.lit, options)), (F.pmod(h, F.lit(len(options))) + 1).cast("int"))
        if kind == "amount":
            return (F.pmod(h, F.lit(100_000_000)) / 10_000).cast("decimal(19,4)")
        if kind == "ymd":
            return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(h, F.lit(366)).cast("int")), "yyyyMMdd")
        raise ValueError(f"{table}.{name}: {kind}")

    return {t: spark.range(rows[t]).select(*(column(t, n, k).alias(n) for n, k in columns.items())) for t, columns in spec.items()}

"""Result tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv", "json")


def save_tables(
    tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> dict[str, str]:
    """Write each table to ``folder/name``; returns the paths.

    CSV has no arrays: store nested tables as parquet or JSON.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {fmt!r}")
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(paths[name])
    return paths

"""Whole sessions as snapshots: tables in a folder of their own, and a manifest that is written last.

A snapshot exists once its manifest does, so a crash between tables leaves the one
before readable. The manifest has the schema version, and of each table its rows and
a digest that doesn't depend on their order; loading checks what it reads, and takes
older versions through conversions, one version at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number long, version int, folder string, name string, n long, digest string"
Tables = dict[str, DataFrame]
#: What to do with the tables of a version to get those of the next.
Conversions = dict[int, Callable[[Tables], Tables]]


def digest(df: DataFrame) -> DataFrame:
    """(n, digest) of a table, whatever its order: the sum of the rows' hashes, added up where they are."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        found = spark.read.schema(MANIFEST).json(f"{path}/manifests")
    except AnalysisException:  # no snapshot yet
        return None
    return found.where("folder IS NOT NULL")


def save(tables: Tables, path: str, version: int = 1) -> int:
    """Writes a snapshot beside those that are there, and returns its number."""
    spark = next(iter(tables.values())).sparkSession
    before = _manifests(spark, path)
    number = 1 + ((before.agg(F.max("number")).first()[0] or 0) if before is not None else 0)
    folder, rows = f"{number}-{uuid.uuid4().hex}", []
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{path}/{folder}/{name}")
        stored = spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}")
        rows.append((number, version, folder, name, *digest(stored).first()))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")  # a row for each table
    return number


def load(spark: SparkSession, path: str, version: int = 1, conversions: Conversions | None = None, number: int | None = None, check: bool = True) -> Tables:
    """The tables of the last snapshot, or of the one with a number, as of a schema version."""
    found = _manifests(spark, path)
    rows = [] if found is None else found.collect()  # a row for each table and snapshot
    numbers = {r["number"] for r in rows}
    if not numbers or number is not None and number not in numbers:
        raise ValueError(f"no such snapshot in {path}")
    rows = [r for r in rows if r["number"] == (max(numbers) if number is None else number)]
    tables = {r["name"]: spark.read.parquet(f"{path}/{r['folder']}/{r['name']}") for r in rows}
    for r in rows if check else ():
        if tuple(digest(tables[r["name"]]).first()) != (r["n"], r["digest"]):
            raise ValueError(f"table {r['name']} of snapshot {r['number']} isn't what was saved")
    at = rows[0]["version"]
    while at < version and conversions and at in conversions:
        tables, at = conversions[at](tables), at + 1
    if at != version:
        raise ValueError(f"snapshot of version {at}, not {version}")
    return tables


def merged(a: Tables, b: Tables) -> Tables:
    """One session of two: facts once, counters of records and skills added, episodes of both."""
    from ..operators import sets

    one = lambda name: a[name].unionByName(b[name])
    skills = one("skills").groupBy("pattern").agg(F.sum("success").alias("success"), F.sum("failure").alias("failure"))
    return {"facts": sets.merge(a["facts"], b["facts"]), "records": sets.merge_provenance(a["records"], b["records"]), "skills": skills, "episodes": one("episodes").distinct()}

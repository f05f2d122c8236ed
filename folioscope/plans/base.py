"""What the modules of queries share: the tables of queries and SQL twins, views of the driver's tables, and the index of each folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import store
from folioscope.sources import vault
from folioscope.sources.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERM, TERMS = "the thing tionble", ["thing", "tionble"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(s: SparkSession, d: str) -> DataFrame:
    return vault.raw_documents(s, d)


def labelled(s: SparkSession, d: str) -> DataFrame:
    return vault.with_status(s, d, docs(s, d))


def files(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", "document_id", "path", "category", "client", "text", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def mod(n: int, k: int = 0):
    return F.col("doc_id") % n == k


def with_project(rows: DataFrame) -> DataFrame:
    return rows.withColumn("project", F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")))


_indexes: dict[tuple, store.Store] = {}


def kept_index(s: SparkSession, d: str, name: str, rows: Callable[[], DataFrame], cutter: store.Cutter | None = None, also: tuple[str, ...] = ()) -> store.Store:
    """The index of a folder's table, written once for each state of its files and read by all searches after that."""
    listed = s.read.format("binaryFile").load([f"{d}/{t}.parquet" for t in (name, *also)]).select("path", "modificationTime", "length").collect()
    key = (s.sparkContext.applicationId, name, cutter is None, *sorted(map(tuple, listed)))
    if key not in _indexes:
        _indexes[key] = store.build(rows(), new_folder(s, "index"), cutter)
    return _indexes[key]


def index_of(s: SparkSession, d: str) -> store.Store:
    """The index of all documents with their status, without passages."""
    return kept_index(s, d, "documents", lambda: with_project(labelled(s, d)), also=("labels",))

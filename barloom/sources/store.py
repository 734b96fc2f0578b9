"""Sinks and readers of archive tables, snapshots, datasets and exports."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.archive import ARCHIVE_KEY, archive_upsert, with_key_defaults
from ..operators.blocks import join_on
from .versioned import VersionedTables

DATASET_BAR = (
    "struct<date:string,source_timestamp:string,open:double,high:double,low:double,close:double,volume_shares:double,"
    "amount_cny:double,complete:boolean,calendar_completion:boolean,completion_basis:string,period_end_session:string,"
    "observed_latest:boolean,source_finality:string>"
)
DATASET = (
    "dataset_id string, symbol string, source string, interval string, adjustment string, target_session string, "
    "calendar_version string, policy_version string, content_hash string, request_started_at string, completion_cutoff string, "
    "fetched_at string, source_timestamp string, source_finality string, point_in_time boolean, "
    "coverage struct<requested:int,returned:int,first_date:string,last_date:string,calendar_unverified_rows:int,"
    "missing_scheduled_session_dates:array<string>,calendar_gaps_unverified:boolean>, "
    f"bars array<{DATASET_BAR}>"
)


def write_archive(archive: DataFrame, path: str, mode="overwrite") -> None:
    """Archive rows laid out by interval and adjustment, sorted for lookups."""
    by = ["interval", "adjustment"]
    archive.repartition(*by, F.col("symbol")).sortWithinPartitions(*by, "symbol", "source_timestamp").write.mode(
        mode).partitionBy(*by).parquet(path)


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("overwrite").parquet(path)


def upsert_archive(arrivals: DataFrame, path: str, keys=ARCHIVE_KEY, buckets: int = 64) -> None:
    """Fold arrivals into a stored archive: only the buckets of their keys are read and written."""
    keys = list(keys)
    store = VersionedTables(arrivals.sparkSession, path, keys, buckets)
    stored = store.read_for("archive", with_key_defaults(arrivals, keys), keys)
    store.commit(store.version().number + 1, {"archive": (archive_upsert(arrivals, stored, keys), keys)})


def read_archive(spark: SparkSession, path: str, keys=ARCHIVE_KEY) -> DataFrame | None:
    return VersionedTables(spark, path, keys).read("archive")


#: A frozen series; its header row and its bars carry these.
SERIES_ID = ["run_id", "symbol", "interval", "adjustment"]


def dataset_store(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTables:
    return VersionedTables(spark, path, ["symbol"], buckets)


def write_dataset(header: DataFrame, bars: DataFrame, path: str, buckets: int = 64) -> None:
    """Publish series headers and their bars together, in the buckets of their symbols.

    A series written again replaces its header and all its bars; other
    series stay. A failed write leaves the version before it.
    """
    store = dataset_store(header.sparkSession, path, buckets)
    store.commit(store.version().number + 1, {"series": (header, SERIES_ID), "bars": (bars, SERIES_ID)})


def commit_attempts(header: DataFrame, bars: DataFrame, path: str, buckets: int = 64) -> None:
    """Publish a retry: series that are stored as ready keep header and bars, the others take the attempt's."""
    stored = dataset_store(header.sparkSession, path, buckets).read_for("series", header, SERIES_ID)
    if stored is not None:
        ready = stored.filter("status = 'ready'").select(*SERIES_ID)
        header, bars = (join_on(x, ready, SERIES_ID, "left_anti") for x in (header, bars))
    write_dataset(header, bars, path, buckets)


def read_dataset_tables(spark: SparkSession, path: str, run_id: str):
    """(series headers, bars) of one run, both of the newest version."""
    store = dataset_store(spark, path)
    return tuple(store.read(t).filter(F.col("run_id") == run_id) for t in ("series", "bars"))


def export_json(window: DataFrame, path: str) -> None:
    window.write.mode("overwrite").json(path)


def read_dataset_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET).json(path)


def explode_dataset_documents(documents: DataFrame):
    """Dataset documents to (series header, bars with their stored position)."""
    header = documents.drop("bars")
    keys = ["dataset_id", "symbol", "source", "interval", "adjustment"]
    bars = documents.select(*keys, F.posexplode("bars").alias("row_no", "_b")).select(*keys, "row_no", "_b.*")
    return header, bars

"""Tables in immutable runs under a manifest: published together, read bucket by bucket.

Rows lie in buckets of their key columns' hash. A commit writes one run (a
folder that is never changed) with the new rows of the buckets it touches, and
then a manifest that lists every bucket's runs. The manifest is what makes a
version visible: it is written last, into the slot that does not hold the
newest version, and counts only if it is complete. So all tables of a commit
appear at once, a commit that fails leaves the version before it readable, and
a commit that is run again replaces itself.

Runs are levelled: where a bucket's new run is at least half as large as the
run before it, the two are merged (newest row of each key), and so on towards
older runs. A bucket therefore holds few runs of falling size, and what is
read for a key depends on the live rows of its bucket, not on the number of
commits.

A manifest has one row for each table, bucket and run, so the driver may hold
it whole. Two commits at once are not kept apart: one writer at a time.
"""

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.blocks import join_on

_MANIFEST = "version long, entries long, table string, bucket int, run string, n long, keys array<string>"
RUN, BUCKET = "_run", "_bucket"


def _rows(spark: SparkSession, path: str, schema: str) -> list:
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":  # a broken manifest is not an absent one
            raise
        return []


@dataclass(frozen=True)
class Version:
    """One manifest: its number, slot and {table: {bucket: [(run, rows)], oldest first}}."""

    number: int = -1
    slot: int = 1
    runs: dict = field(default_factory=dict)
    keys: dict = field(default_factory=dict)


class VersionedTables:
    """Tables below `path` that are bucketed by the columns `by`."""

    def __init__(self, spark: SparkSession, path: str, by, buckets: int = 64):
        self.spark, self.path, self.by, self.buckets = spark, path.rstrip("/"), list(by), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def version(self, below: int | None = None) -> Version:
        """Newest complete manifest, optionally only those below a number."""
        found = Version()
        for slot in (0, 1):
            rows = _rows(self.spark, f"{self.path}/manifest-{slot}", _MANIFEST)
            if not rows or rows[0].entries != len(rows):
                continue
            if rows[0].version > found.number and (below is None or rows[0].version < below):
                runs, keys = {}, {}
                for r in sorted((r for r in rows if r.table is not None), key=lambda r: r.run):
                    runs.setdefault(r.table, {}).setdefault(r.bucket, []).append((r.run, r.n))
                    keys[r.table] = r["keys"]
                found = Version(rows[0].version, slot, runs, keys)
        return found

    def _scan(self, table: str, parts: list[tuple[str, int]]) -> DataFrame:
        base = f"{self.path}/{table}"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/{RUN}={run}/{BUCKET}={b}" for run, b in parts])

    def _newest(self, rows: DataFrame, keys) -> DataFrame:
        """Rows of each key's newest run; a key may have several rows, which are replaced together."""
        last = F.rank().over(Window.partitionBy(BUCKET, *keys).orderBy(F.desc(RUN)))
        return rows.withColumn("_rn", last).filter("_rn = 1").drop("_rn")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows: at most `buckets` numbers."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def read(self, table: str, buckets=None, below: int | None = None) -> DataFrame | None:
        """Newest row of every key, optionally of some buckets or of an older version; None where there are no runs."""
        version = self.version(below)
        runs = version.runs.get(table, {})
        parts = [(run, b) for b, listed in runs.items() if buckets is None or b in buckets for run, _ in listed]
        if not parts:
            return None
        rows = self._scan(table, parts)
        if any(len(runs[b]) > 1 for _, b in parts):
            rows = self._newest(rows, version.keys[table])
        return rows.drop(RUN, BUCKET)

    def read_for(self, table: str, rows: DataFrame, keys, below: int | None = None) -> DataFrame | None:
        """Newest row of every key that occurs in `rows`; other buckets are not read."""
        stored = self.read(table, set(self.touched(rows)), below)
        return None if stored is None else join_on(stored, rows.select(*keys).distinct(), keys, "left_semi")

    def commit(self, number: int, changes: dict[str, tuple[DataFrame, list]], replace: bool = False) -> None:
        """Publish {table: (new rows, key columns)} as version `number`.

        A new row takes the place of the stored one of its key. With
        `replace`, the touched buckets of each table keep nothing else.
        """
        before = self.version(below=number)
        runs = {t: {b: list(r) for b, r in buckets.items()} for t, buckets in before.runs.items()}
        keys = {**before.keys, **{t: list(k) for t, (_, k) in changes.items()}}
        for table, (rows, _) in changes.items():
            run = f"r{number:012d}"
            self._write(rows.withColumn(BUCKET, self.bucket()), table, run)
            mine = runs.setdefault(table, {})
            due: dict[int, list] = {}
            for bucket, n in self._sizes(table, run).items():
                held = [] if replace else mine.get(bucket, [])
                size, merged = n, [(run, n)]
                while held and held[-1][1] <= 2 * size:
                    size += held[-1][1]
                    merged.append(held.pop())
                mine[bucket] = [*held, (run, n)]
                if len(merged) > 1:
                    due[bucket] = merged
            if due:
                whole = self._scan(table, [(r, b) for b, listed in due.items() for r, _ in listed])
                self._write(self._newest(whole, keys[table]).drop(RUN), table, f"{run}m")
                for bucket, n in self._sizes(table, f"{run}m").items():
                    mine[bucket] = [*mine[bucket][:-1], (f"{run}m", n)]
        entries = [(t, b, r, n, keys[t]) for t, buckets in runs.items() for b, listed in buckets.items() for r, n in listed] or [(None,) * 5]
        lines = [(number, len(entries), *e) for e in entries]
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{1 - before.slot}")

    def _write(self, rows: DataFrame, table: str, run: str) -> None:
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{table}/{RUN}={run}")

    def _sizes(self, table: str, run: str) -> dict[int, int]:
        """Rows of every bucket of a run, from its footers."""
        rows = self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.path}/{table}/{RUN}={run}")
        return {r[BUCKET]: r["count"] for r in rows.groupBy(BUCKET).count().collect()}

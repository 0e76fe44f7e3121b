"""Ingestion, the dataset store and sinks.

Every dataset has Parquet folders of its own, named by the catalog row of its
organisation and id, so a read touches no other dataset's files (S11) and
datasets of different schemas never meet.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..operators import profile_state as PS
from .versions import Versions

MAX_COLUMNS = 200
CORRUPT = "_corrupt_record"
PREVIEW_ROWS = 50
SAMPLE_ROWS = 10
MAX_PROBLEM_SAMPLES = 10
DELETED = "deleted"


# ------------------------------------------------------------------ S5 S6

def sanitize_headers(raw: list[str]) -> list[str]:
    """Trim, drop empty, keep ``[a-zA-Z0-9_ ]``, empty -> 'column',
    repeats get ``_1, _2 ...``.  Works on the header list only."""
    seen: dict[str, int] = {}
    out = []
    for h in raw:
        h = (h or "").strip()
        if not h:
            continue
        c = re.sub(r"[^a-zA-Z0-9_ ]", "", h) or "column"
        if c in seen:
            seen[c] += 1
            c = f"{c}_{seen[c]}"
        else:
            seen[c] = 0
        out.append(c)
    return out


def header_errors(df: DataFrame, max_columns: int = MAX_COLUMNS) -> list[str]:
    """S6 guards on the schema (no data read): no headers, too many."""
    errs = []
    if not df.columns:
        errs.append("No column headers detected in the uploaded file")
    if len(df.columns) > max_columns:
        errs.append(f"The dataset exceeds the maximum allowable column count of {max_columns}")
    return errs


# ------------------------------------------------------------------ S1 S2

def read_csv(spark: SparkSession, path: str, keep_corrupt: bool = False, multi_line: bool = True) -> DataFrame:
    """Header row, every cell a string, trimmed, '' -> null, blank lines
    skipped, headers sanitized.  Rows with more fields than the header land
    in ``_corrupt_record`` (kept only with ``keep_corrupt``; see
    ``csv_errors`` for the fail-on-too-many-fields check).

    Quoted fields may hold line ends and doubled quotes.  That costs the
    splitting of single files (each file is read by one task); for large
    files without such fields ``multi_line=False`` reads them in splits."""
    options = {"quote": '"', "escape": '"', "multiLine": str(multi_line).lower()}
    header = spark.read.option("header", True).option("inferSchema", False).options(**options).csv(path).columns
    keep = [i for i, h in enumerate(header) if (h or "").strip()]
    names = sanitize_headers(header)
    raw_names = [f"_c{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in raw_names] +
                          [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.option("header", True).option("mode", "PERMISSIVE").options(**options)
          .option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path))
    cols = [F.nullif(F.trim(F.col(raw_names[i])), F.lit("")).alias(n) for i, n in zip(keep, names)]
    if keep_corrupt:
        cols.append(F.col(CORRUPT))
    return df.select(*cols)


def csv_errors(df_with_corrupt: DataFrame) -> list[str]:
    """Fail-fast checks that need the data: no rows, rows with too many
    fields (one bounded probe each)."""
    errs = []
    if df_with_corrupt.isEmpty():
        errs.append("The uploaded file contains no data rows")
    elif CORRUPT in df_with_corrupt.columns and \
            not df_with_corrupt.filter(F.col(CORRUPT).isNotNull()).isEmpty():
        errs.append("CSV Parse Error: Too many fields")
    return errs


def read_csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV read (dynamic typing by Spark's schema inference)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


# ------------------------------------------------------------------ S7

def cast_column(c: str, typ: str) -> Column:
    """Numeric strips ``$ ,``; date parses; boolean from the word set;
    values that do not convert become null."""
    v = F.col(c)
    if typ in ("numeric", "currency", "percentage"):
        return P.numeric_value(v).alias(c)
    if typ == "date":
        return P.parse_date(v).alias(c)
    if typ == "boolean":
        return F.when(F.trim(v.cast("string")) == "", F.lit(None)).otherwise(P.boolean_value(v)).alias(c)
    return v.alias(c)


def cast_to_schema(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[cast_column(c, types.get(c, "text")) for c in df.columns])


def types_from_profile(profile: DataFrame) -> dict[str, str]:
    """The (column -> type) map of a profile; one row per column, so the
    collected result is bounded by the column limit."""
    return {r["column"]: r["type"] for r in profile.select("column", "type").collect()}


# ------------------------------------------------------------------ store

class DatasetStore:
    """Datasets as Parquet parts, metadata as versioned states.

    A dataset's rows live in part folders ``<root>/rows/<org>/<dataset>/<id>``
    that are written once and never changed; its state (see ``versions``) names
    the parts that make it up and their merged schema.  A change writes new parts first and then switches the state, so a
    crash in between leaves the old state readable, and two writers at once both
    succeed: the second one builds on the first one's state."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.states = Versions(spark, f"{self.root}/catalog")

    @staticmethod
    def _name(org_id: str, dataset_id: str) -> str:
        return f"{quote(org_id, safe='')}/{quote(dataset_id, safe='')}"

    # S3 / S11
    def read(self, org_id: str, dataset_id: str, limit: int | None = None, order_key: str | None = None) -> DataFrame:
        """Rows of one dataset of one organisation, from its own parts only.
        ``limit`` gives the first n rows by ``order_key`` (preview / sample)."""
        meta = self._known(org_id, dataset_id)
        schema = T.StructType.fromJson(json.loads(meta["schema"]))
        df = (self.spark.read.schema(schema).parquet(*meta["parts"]) if meta["parts"]
              else self.spark.createDataFrame([], schema))
        if limit is not None:
            df = (df.orderBy(order_key) if order_key else df).limit(limit)
        return df

    def profile(self, org_id: str, dataset_id: str) -> DataFrame:
        """The column profile of one dataset (see ``profile_state``), joined from
        the states of its parts.  A part is read once in its life, the first time
        that a profile is asked for; after an append only the new part is."""
        meta = self._known(org_id, dataset_id)
        schema = T.StructType.fromJson(json.loads(meta["schema"]))
        if not meta["parts"]:
            return PS.profile_of(PS.part_state(self.spark.createDataFrame([], schema)), schema)
        return PS.profile_of(self.spark.read.schema(PS.STATE).parquet(*[self._part_profile(p, schema) for p in meta["parts"]]), schema)

    def _state_folder(self, part: str) -> str:
        return f"{self.root}/profiles/{part.removeprefix(f'{self.root}/rows/')}"

    def _part_profile(self, part: str, schema: T.StructType) -> str:
        """Folder of a part's profile state, which is made if it is not there.  It
        appears in one step; of two readers that make it at once, one wins."""
        folder = self._state_folder(part)
        path, fs = self.states._fs(folder)
        if not fs.exists(path):
            own = self.spark.read.parquet(part).columns
            rows = self.spark.read.schema(T.StructType([f for f in schema.fields if f.name in own])).parquet(part)
            draft, _ = self.states._fs(f"{self.root}/drafts/{uuid.uuid4().hex}")
            PS.part_state(rows).write.parquet(draft.toString())
            fs.mkdirs(path.getParent())
            if fs.exists(path) or not fs.rename(draft, path):
                fs.delete(draft, True)
        return folder

    def catalog(self) -> DataFrame:
        """Metadata of all datasets; empty if there is none."""
        return self.states.all(_CATALOG_SCHEMA).filter(F.col("status") != DELETED)

    def meta(self, org_id: str, dataset_id: str) -> dict | None:
        state = self.states.latest(self._name(org_id, dataset_id))[1]
        return None if state is None or state["status"] == DELETED else state

    def _known(self, org_id: str, dataset_id: str) -> dict:
        meta = self.meta(org_id, dataset_id)
        if meta is None:
            raise KeyError(f"dataset {dataset_id!r} of {org_id!r} not found")
        return meta

    def _write_part(self, df: DataFrame, org_id: str, dataset_id: str) -> tuple[str, int]:
        part = f"{self.root}/rows/{self._name(org_id, dataset_id)}/{uuid.uuid4().hex}"
        df.write.parquet(part)
        return part, self.spark.read.schema(df.schema).parquet(part).count()

    # S8 / S9
    def import_rows(self, df: DataFrame, org_id: str, dataset_id: str, file_name: str, mode: str = "confirm",
                    problem_count: int = 0, problem_samples: list | None = None) -> None:
        """S8: 'confirm' / 'preview' create the dataset, 'replace' puts new
        rows (also none) in the place of the old, 'append' adds rows (bag
        union; new columns are null in old rows, known ones keep their type),
        sums problem counts and keeps at most 10 problem samples.  Only the new
        rows are read."""
        samples = list(problem_samples or [])
        now = datetime.now(timezone.utc).replace(tzinfo=None).isoformat(" ")
        written: dict = {}  # the part, and the types that it was written with

        def part_for(types: dict) -> tuple:
            own = {f.name: types.get(f.name, f.dataType) for f in df.schema.fields}
            if written.get("types") != own:  # a column got its type from another writer meanwhile
                self._drop(written)
                rows = df.select(*[F.col(c).alias(c) if own[c] == df.schema[c].dataType else F.col(c).try_cast(own[c]).alias(c) for c in df.columns])
                written.update(types=own, schema=rows.schema, part=self._write_part(rows, org_id, dataset_id))
            return written["part"], written["schema"]

        def next_state(old: dict | None) -> dict:
            live = old if old and old["status"] != DELETED else None
            if mode == "append" and live:
                known = T.StructType.fromJson(json.loads(live["schema"]))
                (part, rows), schema = part_for({f.name: f.dataType for f in known.fields})
                schema = T.StructType(known.fields + [f for f in schema.fields if f.name not in known.names])
                return dict(live, parts=[*live["parts"], part], schema=schema.json(), columns=schema.names,
                            row_count=live["row_count"] + rows, problem_count=live["problem_count"] + problem_count,
                            problem_samples=(live["problem_samples"] + samples)[:MAX_PROBLEM_SAMPLES], updated_at=now)
            (part, rows), schema = part_for({})
            return {"org_id": org_id, "dataset_id": dataset_id, "file_name": file_name, "parts": [part], "row_count": rows,
                    "schema": schema.json(), "columns": schema.names, "status": "preview" if mode == "preview" else "confirmed",
                    "problem_count": problem_count, "problem_samples": samples[:MAX_PROBLEM_SAMPLES],
                    "created_at": live["created_at"] if live and mode == "replace" else now, "updated_at": now}

        old: dict = {}

        def noting(state: dict | None) -> dict:
            old["state"] = state
            return next_state(state)

        new = self.states.change(self._name(org_id, dataset_id), noting)
        self._drop_unused(old["state"], new)

    # S10
    def delete(self, org_id: str, dataset_id: str) -> None:
        """Mark the dataset's state as deleted, then drop its parts."""
        if self.meta(org_id, dataset_id) is None:
            return
        old: dict = {}

        def gone(state: dict) -> dict:
            old["state"] = state
            return dict(state, parts=[], columns=[], row_count=0, status=DELETED)

        new = self.states.change(self._name(org_id, dataset_id), gone)
        self._drop_unused(old["state"], new)

    def _drop(self, written: dict) -> None:
        for folder in written.pop("part", ())[:1]:
            delete_folder(self.spark, folder)

    def _drop_unused(self, old: dict | None, new: dict) -> None:
        for part in set(old["parts"] if old else []) - set(new["parts"]):
            delete_folder(self.spark, part)
            delete_folder(self.spark, self._state_folder(part))

    # S4
    def list(self, org_id: str) -> DataFrame:
        return self.catalog().filter(F.col("org_id") == org_id).orderBy(F.desc("created_at"), "dataset_id")


def delete_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_CATALOG_SCHEMA = ("file_name string, parts array<string>, schema string, row_count long, columns array<string>, "
                   "status string, problem_count long, problem_samples array<string>, created_at timestamp_ntz, "
                   "updated_at timestamp_ntz, org_id string, dataset_id string")


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union of old and new rows by column name (missing -> null)."""
    return old.unionByName(new, allowMissingColumns=True)


# ------------------------------------------------------------------ S12 S13

class ResultStore:
    """Precomputed results of datasets, several tables each.

    The rows of a call are written first, into folders of their own; then the
    state of each dataset (see ``versions``) is switched to them, all its tables
    at once.  Readers see the old results of a dataset or the new ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.states = Versions(spark, f"{self.root}/versions")

    def put(self, tables: dict[str, DataFrame], datasets: list[str], key: str = "dataset_id") -> None:
        """Replace the results of the named datasets in the given tables; a dataset
        without new rows loses its old ones.  Other tables stay."""
        batch, news = uuid.uuid4().hex, {}
        for name, df in tables.items():
            df = df.filter(F.col(key).isin(datasets))
            df.write.parquet(f"{self.root}/data/{name}/{batch}")
            news[name] = {"batch": batch, "schema": df.schema.json(), "key": key}
        for d in datasets:
            self.states.change(quote(d, safe=""), lambda old, d=d: {"dataset": d, "tables": json.dumps({**json.loads((old or {}).get("tables", "{}")), **news})})

    def read(self, name: str, dataset: str | None = None) -> DataFrame:
        """Rows of one table, of one dataset or of all."""
        states = self.states.all("dataset string, tables string")
        if dataset is not None:
            states = states.filter(F.col("dataset") == dataset)
        entry = F.from_json(F.get_json_object("tables", f"$.{name}"), "batch string, schema string, key string")
        now = states.select("dataset", entry.alias("e")).filter("e is not null").select("dataset", "e.*")
        kinds = now.select("batch", "schema", "key").distinct().collect()  # one row per call of put still in use
        if not kinds:
            raise KeyError(f"no results {name!r}")
        out = None
        for schema, key in {(r.schema, r.key) for r in kinds}:
            folders = [f"{self.root}/data/{name}/{r.batch}" for r in kinds if (r.schema, r.key) == (schema, key)]
            rows = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*folders)
            rows = rows.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]*)/[^/]*$", 1))
            own = now.select(F.col("dataset").alias("_dataset"), F.col("batch").alias("_b"))
            rows = rows.join(own, (F.col(key).cast("string") == F.col("_dataset")) & (F.col("_batch") == F.col("_b")), "left_semi").drop("_batch")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


def persist_results(df: DataFrame, path: str, datasets: list[str], partition: str = "dataset_id") -> None:
    """S12 for one table: new results in the place of the old ones of the named datasets."""
    ResultStore(df.sparkSession, path).put({"results": df}, datasets, partition)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results that ``persist_results`` wrote to a path."""
    return ResultStore(spark, path).read("results")


def export_series_csv(series: DataFrame, path: str, columns=("x", "y", "n")) -> None:
    """Series as CSV files with a header, every field quoted and quotes
    doubled; one file per partition of the series (a small one, after AQE
    has coalesced it, is one file)."""
    (series.select(*columns).write.mode("overwrite")
     .option("header", True).option("quoteAll", True).option("escape", '"').csv(path))

"""Configuration tables: price sheets, cache schemas, profiles, command sets, skills."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..plans.local import local_table
from ..plans.staging import stage
from ..schemas import CACHE_SCHEMA, COMMAND_SETS, PRICE_SHEET, PROFILES, SKILLS

# Executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The built-in price sheet (USD per million tokens) and cache schemas.
BUILTIN_PRICES = [
    ("2026-07-15", "openai/gpt-5-5", 1.25, 0.125, 10.00, None, "cache reads are not shown"),
    ("2026-07-15", "anthropic/claude-cache", 3.00, 0.30, 15.00, 3.75, "shows reads and writes"),
]
_CACHED = ["prompt_tokens_details", "cached_tokens"]
_CREATION = ["prompt_tokens_details", "cache_creation_tokens"]
_REASONING = ["completion_tokens_details", "reasoning_tokens"]
BUILTIN_CACHE_SCHEMAS = [
    ("openai/gpt-5-5", "cached_tokens", False, _CACHED),
    ("openai/gpt-5-5", "cache_creation_tokens", False, None),
    ("openai/gpt-5-5", "reasoning_tokens", True, _REASONING),
    ("anthropic/claude-cache", "cached_tokens", True, _CACHED),
    ("anthropic/claude-cache", "cache_creation_tokens", True, _CREATION),
    ("anthropic/claude-cache", "reasoning_tokens", False, None),
]


def builtin_prices(spark: SparkSession) -> DataFrame:
    return local_table(spark, BUILTIN_PRICES, PRICE_SHEET)


def builtin_cache_schemas(spark: SparkSession) -> DataFrame:
    return local_table(spark, BUILTIN_CACHE_SCHEMAS, CACHE_SCHEMA)


def profiles(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Rows of (dialect, name, accountant_model, price_date)."""
    return local_table(spark, rows, PROFILES)


def _insert_only(dim: DataFrame, new: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``dim`` plus ``new``; reading the result fails when a key is already there."""
    known = dim.select(*keys).distinct().withColumn("_known", F.lit(True))
    described = F.concat_ws(" on ", *[F.col(k) for k in reversed(keys)])
    checked = new.join(known, keys, "left").filter(
        F.when(
            F.col("_known"),
            F.raise_error(F.concat(F.lit(f"{label} already registered: "), described)).cast("boolean"),
        ).otherwise(F.lit(True))
    )
    return dim.unionByName(checked.drop("_known").select(*dim.columns))


def register_prices(dim: DataFrame, new: DataFrame) -> DataFrame:
    """Append price rows; a known key or a missing required rate is an error."""
    required = ["input_per_1m", "cached_input_per_1m", "output_per_1m"]
    condition = F.lit(True)
    for rate in required:
        condition = F.when(
            F.col(rate).isNull(),
            F.raise_error(
                F.concat(F.lit(f"price {rate} is required for "), F.col("accountant_model"))
            ).cast("boolean"),
        ).otherwise(condition)
    return _insert_only(dim, new.filter(condition), ["price_date", "accountant_model"], "price")


def register_cache_schema(dim: DataFrame, new: DataFrame) -> DataFrame:
    """Append the three category rows of each new model; a known model is an error."""
    categories = F.explode(
        F.array(*[F.lit(c) for c in ("cached_tokens", "cache_creation_tokens", "reasoning_tokens")])
    )
    full = (
        new.select("accountant_model").distinct().withColumn("category", categories)
        .join(new, ["accountant_model", "category"], "left")
        .select(
            "accountant_model", "category",
            F.coalesce("surfaces", F.lit(False)).alias("surfaces"), "path",
        )
    )
    known = dim.select("accountant_model").distinct()
    marked = _insert_only(known, full.select("accountant_model").distinct(),
                          ["accountant_model"], "cache schema")
    return dim.unionByName(full.join(marked, "accountant_model", "left_semi"))


def load_command_sets(spark: SparkSession, path: str) -> DataFrame:
    """``{task: {kind_key: {cmd, kind, credible}}}`` documents as one row per task and kind."""
    spec = "MAP<STRING, MAP<STRING, STRUCT<cmd: STRING, kind: STRING, credible: BOOLEAN>>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", spec).alias("doc"))
    tasks = docs.select(F.explode("doc").alias("task_id", "kinds"))
    return (
        tasks.select("task_id", F.explode("kinds").alias("kind_key", "c"))
        .select("task_id", "kind_key", "c.cmd", "c.kind", "c.credible")
        .to(StructType.fromDDL(COMMAND_SETS))
    )


_FRONT_MATTER = r"(?s)\A---\n(.*?)\n---\n(.*)\z"


def load_skills(spark: SparkSession, directory: str) -> DataFrame:
    """Markdown skills with YAML front matter, ordered by file name.

    A missing folder is an empty library; a file without front matter or without ``name``,
    ``signature`` and ``steps_replaced`` fails the job.
    """
    try:
        files = spark.read.text(directory, wholetext=True, pathGlobFilter="*.md")
    except Exception as error:  # noqa: BLE001 - only the missing folder is tolerated
        if "PATH_NOT_FOUND" in str(error):
            return local_table(spark, [], SKILLS)
        raise
    split = files.select(
        F.col("_metadata.file_name").alias("file_order"),
        F.regexp_extract("value", _FRONT_MATTER, 1).alias("meta"),
        F.btrim(F.regexp_extract("value", _FRONT_MATTER, 2), F.lit(" \t\n\r\x0b\x0c")).alias("body"),
        F.rlike("value", F.lit(_FRONT_MATTER)).alias("ok"),
    ).filter(
        F.when(F.col("ok"), F.lit(True)).otherwise(
            F.raise_error(
                F.concat(F.col("file_order"), F.lit(": expected YAML front matter delimited by ---"))
            ).cast("boolean")
        )
    )
    return split.select("file_order", "meta", "body").mapInPandas(_read_front_matter, SKILLS)


def _read_front_matter(batches):
    import yaml

    for batch in batches:
        rows = []
        for file_order, meta, body in batch.itertuples(index=False):
            fields = yaml.safe_load(meta) or {}
            missing = sorted({"name", "signature", "steps_replaced"} - set(fields))
            if missing:
                raise ValueError(f"{file_order}: missing front-matter keys {missing}")
            rows.append(
                {
                    "name": fields["name"],
                    "description": fields.get("description", ""),
                    "signature": [str(s) for s in fields["signature"]],
                    "steps_replaced": int(fields["steps_replaced"]),
                    "body": body,
                    "preconditions": [str(p) for p in fields.get("preconditions") or []],
                    "source": fields.get("source", ""),
                    "file_order": file_order,
                }
            )
        yield pd.DataFrame(
            rows,
            columns=["name", "description", "signature", "steps_replaced", "body",
                     "preconditions", "source", "file_order"],
        )


# Profiles of backends

PROFILE_FILES = (
    "file STRING, name STRING, dialect STRING, base_url STRING, accountant_model STRING, price_date STRING, "
    "cache_schema ARRAY<STRUCT<category: STRING, surfaces: BOOLEAN, path: ARRAY<STRING>>>, "
    "prices STRUCT<input_per_1m: DOUBLE, cached_input_per_1m: DOUBLE, output_per_1m: DOUBLE, cache_creation_per_1m: DOUBLE>, "
    "priced BOOLEAN"
)
_CATEGORIES = ("cached_tokens", "cache_creation_tokens", "reasoning_tokens")
#: Profile files that one task reads.
FILES_PER_TASK = 64


def _number(value) -> float | None:
    return None if value is None else float(value)


def profile_row(file: str, text: str) -> tuple:
    """The fields of one YAML profile, as ``PROFILE_FILES``."""
    import yaml

    # The safe loader over libyaml, where that is there, reads the same in a tenth of the time.
    data = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}
    if not isinstance(data, dict) or "base_url" not in data:
        raise ValueError(f"{file}: a profile needs base_url")
    schema = None
    if "cache_schema" in data:
        given = data["cache_schema"] or {}
        specs = {c: given.get(c) or {} for c in _CATEGORIES}
        schema = [(c, bool(s.get("surfaces")), [str(p) for p in s["path"]] if s.get("path") else None) for c, s in specs.items()]
    priced, prices = "prices_per_1m" in data, None
    if priced:
        given = data["prices_per_1m"] or {}
        prices = tuple(_number(given.get(k)) for k in ("input", "cached_input", "output", "cache_creation"))
    text_or_none = lambda k: None if data.get(k) is None else str(data[k])
    return (
        file, str(data.get("name", file.rsplit("/", 1)[-1].rsplit(".", 1)[0])), str(data.get("dialect", "openai")),
        str(data["base_url"]).rstrip("/"), text_or_none("accountant_model"), text_or_none("price_date"), schema, prices, priced,
    )


def _is_profile(info) -> bool:
    return info.is_file and info.path.endswith((".yaml", ".yml"))


class ProfilePartition(InputPartition):
    """Some profile files, or a folder that its task lists by itself."""

    def __init__(self, files: list[str], folder: str | None = None):
        self.files, self.folder = files, folder


class ProfileReader(DataSourceReader):
    """Reads the profiles under a path, some files or a folder a task.

    The driver lists the path alone, so of files in folders it holds the folders' names only.
    """

    def __init__(self, path: str):
        self.path = path

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def partitions(self) -> list[ProfilePartition]:
        from pyarrow import fs

        system, root = self._system()
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return [ProfilePartition([])]
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root))
        names = sorted(f.path for f in found if _is_profile(f))
        folders = sorted(f.path for f in found if f.type == fs.FileType.Directory)
        parts = [ProfilePartition(names[i : i + FILES_PER_TASK]) for i in range(0, len(names), FILES_PER_TASK)]
        return parts + [ProfilePartition([], f) for f in folders] or [ProfilePartition([])]

    def read(self, partition: ProfilePartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = self._system()
        folders, files = [partition.folder] if partition.folder else [], partition.files
        while files or folders:
            for name in files:
                with system.open_input_stream(name) as f:
                    yield profile_row(name, f.read().decode("utf-8"))
            found = system.get_file_info(fs.FileSelector(folders.pop())) if folders else []
            files = sorted(f.path for f in found if _is_profile(f))
            folders += sorted((f.path for f in found if f.type == fs.FileType.Directory), reverse=True)


class ProfileSource(DataSource):
    """``spark.read.format("backend_profiles").load(path)``: YAML profiles, one row per file."""

    @classmethod
    def name(cls) -> str:
        return "backend_profiles"

    def schema(self) -> str:
        return PROFILE_FILES

    def reader(self, schema: StructType) -> ProfileReader:
        return ProfileReader(self.options["path"])


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``PROFILE_FILES`` of the YAML files under a path; a file without ``base_url`` fails the job."""
    spark.dataSource.register(ProfileSource)
    return spark.read.format(ProfileSource.name()).load(path)


def _unique(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``rows``; reading the result fails where two of them have the same keys."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    described = F.concat_ws(" on ", *[F.col(k) for k in reversed(keys)])
    twice = F.raise_error(F.concat(F.lit(f"{label} already registered: "), described)).cast("boolean")
    return rows.join(counts, keys).filter(F.when(F.col("_n") > 1, twice).otherwise(F.lit(True))).drop("_n")


def register_profiles(read: DataFrame, prices: DataFrame, cache_schemas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, and the price and cache-schema tables with what the profiles define.

    A profile without model or price date registers nothing.  One may name a known model; defining
    a model's schema or its price of a date again, in the tables or in two profiles, is an error, and
    so is a price without one of the required rates.

    The profiles are staged: every table below reads them, and files of their own are slow to read.
    """
    read = stage(read, "profiles")
    routed = read.filter((F.coalesce("accountant_model", F.lit("")) != "") & (F.coalesce("price_date", F.lit("")) != ""))
    priced = routed.filter("priced").select(
        "price_date", "accountant_model", "prices.*", F.concat(F.lit("from profile "), F.col("name")).alias("notes"))
    defined = routed.filter(F.col("cache_schema").isNotNull()).select("accountant_model", "cache_schema")
    categories = _unique(defined, ["accountant_model"], "cache schema").select(
        "accountant_model", F.explode("cache_schema").alias("s")).select("accountant_model", "s.*")
    return (
        read.select("dialect", "name", "accountant_model", "price_date"),
        register_prices(prices, _unique(priced, ["price_date", "accountant_model"], "price").select(*prices.columns)),
        register_cache_schema(cache_schemas, categories),
    )

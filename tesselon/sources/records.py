"""Raw records and the pipeline's tables."""

from __future__ import annotations

import os
import shutil
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tesselon.sources import files

GZIP_MAGIC = b"\x1f\x8b"


def resolve_existing(path: str | Path) -> Path:
    """The file itself, or for a ``.jsonl.gz`` that isn't there the ``.jsonl`` beside it; neither raises."""
    path = Path(path)
    for p in (path, path.with_suffix("") if path.suffix == ".gz" else path):
        if p.exists():
            return p
    raise FileNotFoundError(path)


def is_gzip(path: str | Path) -> bool:
    with open(path, "rb") as f:
        return f.read(2) == GZIP_MAGIC


def _readable(path: Path, scratch: str | None) -> str:
    """A path whose name tells what the content is, as Spark goes by names: a misnamed file is linked under a right one."""
    packed = is_gzip(path)
    if packed == (path.suffix == ".gz"):
        return str(path)
    folder = Path(scratch or path.parent)
    link = folder / (path.name + ".gz" if packed else path.name.removesuffix(".gz"))
    if link == path:
        raise ValueError(f"can't name {path}")
    if not link.exists():
        os.symlink(path.resolve(), link)
    return str(link)


def read_jsonl(spark: SparkSession, path: str | Path, schema: T.StructType | None = None, limit: int | None = None, scratch: str | None = None) -> DataFrame:
    """JSON lines, packed or not whatever the name says. Blank lines are skipped, a malformed line raises when it is read.

    Without a schema each record is a variant column ``v``, in which fields may have other types in other rows. ``limit``
    is the number of records, for development runs.
    """
    place = _readable(resolve_existing(path), scratch)
    if schema is not None:
        out = spark.read.option("mode", "FAILFAST").schema(schema).json(place)
    else:
        out = spark.read.text(place).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    return out.limit(limit) if limit is not None else out


def variant_interactions(records: DataFrame) -> DataFrame:
    """The raw interaction fields of variant records."""
    kinds = {"user_id": "string", "parent_asin": "string", "rating": "double", "timestamp": "bigint", "text": "string"}
    return records.select(*[F.try_variant_get("v", f"$.{c}", t).alias(c) for c, t in kinds.items()])


#: The protocol whose tables lie in the folder of the dataset's plain name.
DEFAULT_PROTOCOL = "per_user_chronological_80_20"


def table_dir(root: str | Path, dataset: str, protocol: str | None = None, default: str = DEFAULT_PROTOCOL) -> str:
    """``root/dataset``, with ``__protocol`` once for another protocol than the default one."""
    suffix = f"__{protocol}" if protocol and protocol != default and not dataset.endswith(f"__{protocol}") else ""
    return files.joined(root, dataset + suffix)


def write_tables(folder: str | Path, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(files.joined(folder, f"{name}.parquet"))


def read_tables(spark: SparkSession, folder: str | Path, *names: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(files.joined(folder, f"{n}.parquet")) for n in names)


def split_protocol(spark: SparkSession, root: str | Path, dataset: str, configured: str) -> str:
    """The protocol that the summary of the configured protocol's tables, else of the plain folder's, names; else the configured one."""
    for folder in (table_dir(root, dataset, configured), files.joined(root, dataset)):
        found = files.read_json(spark, files.joined(folder, "eda_summary.json"), {}).get("split_protocol")
        if found:
            return found
    return configured


def key_hash(df: DataFrame, *keys: str) -> str:
    """A provenance hash of a table's keys, independent of their order: sums of row hashes, nothing is gathered."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)
    part: Callable[[int], Column] = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = df.agg(F.count(F.lit(1)).cast("string").alias("n"), *[part(i).alias(f"s{i}") for i in range(4)])
    return sums.select(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in sums.columns]), 256).alias("h")).first()["h"]


def store_embeddings(folder: str, df: DataFrame, id_col: str, text: Column, embed: Callable[[Column], Column], model: str) -> DataFrame:
    """``(id_col, vector)`` from the folder if it was made by the same model from the same ids and texts, else computed and kept there."""
    rows = df.select(id_col, text.alias("text"))
    stamp = {"model_name": model, "content_hash": key_hash(rows, id_col, "text")}
    spark, side, vectors = df.sparkSession, files.joined(folder, "embedding_meta.json"), files.joined(folder, "vectors.parquet")
    if files.read_json(spark, side) != stamp:
        rows.select(id_col, embed(F.col("text")).alias("vector")).write.mode("overwrite").parquet(vectors)
        files.write_json(spark, side, stamp)
    return spark.read.parquet(vectors)


def download(url: str, path: str | Path, opener: Callable = urllib.request.urlopen, chunk: int = 1 << 20) -> Path:
    """The file at ``url``, unless it is there already; it gets its name only when it is complete."""
    path = Path(path)
    if path.exists():
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    with opener(url) as source, open(part, "wb") as out:
        shutil.copyfileobj(source, out, chunk)
    part.replace(path)
    return path

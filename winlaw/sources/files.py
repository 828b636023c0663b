"""Readers: hourly tables, turbine logs, labelled series; verified files and result tables."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOURLY = "date_time string, holiday string, temp double, rain_1h double, snow_1h double, traffic_volume long"


def verified(path: str, registry: str) -> str:
    """path, if its SHA-256 is the recorded one; the first time it is recorded. Another digest raises."""
    known = json.loads(Path(registry).read_text()) if Path(registry).exists() else {}
    digest = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    name = Path(path).name
    if known.setdefault(name, digest) != digest:
        raise ValueError(f"{name} isn't the file that was recorded")
    Path(registry).write_text(json.dumps(known, indent=1))
    return path


def hourly(spark: SparkSession, path: str, schema: str = HOURLY) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def members(spark: SparkSession, path: str, ending: str = ".csv") -> DataFrame:
    """(archive, member, line, text): the lines of the members of zip archives and of gzip files, by their names. An archive is one
    task's; its lines are read one at a time."""
    import gzip
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = name.rsplit("/", 1)[-1]
                if raw[:2] == b"PK":
                    archive = zipfile.ZipFile(io.BytesIO(raw))
                    files = [(m, archive.open(m)) for m in sorted(archive.namelist()) if m.endswith((ending, ending + ".gz"))]
                else:
                    files = [(base, io.BytesIO(raw))]
                for member, f in files:
                    f = gzip.GzipFile(fileobj=f) if member.endswith(".gz") else f
                    held = []
                    for i, line in enumerate(f):
                        held.append((base, member, i, line.decode("utf-8", "replace").rstrip("\r\n")))
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["archive", "member", "line", "text"])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["archive", "member", "line", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line long, text string")


def from_csv_lines(lines: DataFrame, schema: str, skip: int = 1, sep: str = ",") -> DataFrame:
    """Columns of the lines of members(), without the first `skip` of each; archive and member stay."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    row = F.from_csv("text", schema, {"sep": sep})
    return lines.filter(F.col("line") >= skip).select("archive", "member", row.alias("_r")).select("archive", "member", *[F.col(f"_r.{n}").alias(n) for n in names])


def scada(spark: SparkSession, path: str, columns: dict[str, str], skip: int = 9) -> DataFrame:
    """CSV members of archives (or plain files) with `skip` head lines each, dropped by their number; columns: {position: name}; turbine
    from the digits of the member's name. Values that aren't numbers are null, but for a column named time."""
    lines = members(spark, path)
    parts = F.split("text", ",")
    cell = lambda i: F.try_element_at(parts, F.lit(int(i) + 1))
    value = lambda i, n: (F.try_to_timestamp(cell(i)) if n == "time" else cell(i).try_cast("double")).alias(n)
    rows = lines.filter((F.col("line") >= skip) & (F.trim("text") != ""))
    return rows.select(F.regexp_extract("member", r"(\d+)", 1).cast("int").alias("turbine"), *[value(i, n) for i, n in columns.items()])


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(turbine, Latitude, Longitude) of a small static table, its rows numbered from 1 as they stand."""
    lines = members(spark, path)
    rows = from_csv_lines(lines.filter("trim(text) <> ''").withColumn("text", F.concat_ws(",", "text", F.col("line").cast("string"))), "Latitude double, Longitude double, line long")
    return rows.select(F.col("line").cast("int").alias("turbine"), "Latitude", "Longitude")


def both_splits(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Training and test series with `code`, their labels numbered together in their order."""
    return encode_labels(series(spark, train, "train").unionByName(series(spark, test, "test")))


def published(spark: SparkSession, path: str, name: str = "dataset") -> DataFrame:
    """A reference table whose head may be wrapped and whose names carry notes: the first token of the name, numbers as doubles, other cells null."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    first = F.regexp_extract(F.trim(F.col(name)), r"^(\S+)", 1)
    rest = [F.trim(F.col(f"`{c}`")).try_cast("double").alias(c) for c in df.columns if c != name]
    return df.select(first.alias(name), *rest)


SOURCES: dict[str, dict] = {}


def register(name: str, path: str, digest: str | None = None, rebuild: str = "") -> None:
    """Names a source: where its file is kept, what it must hash to, and how it is had again."""
    SOURCES[name] = {"path": path, "digest": digest, "rebuild": rebuild}


def available() -> dict[str, bool]:
    """Which registered sources are here and whole."""
    out = {}
    for name, s in SOURCES.items():
        path = Path(s["path"])
        out[name] = path.exists() and (s["digest"] is None or hashlib.sha256(path.read_bytes()).hexdigest() == s["digest"])
    return out


def source(name: str) -> str:
    """The path of a registered source; where it is missing or damaged the error says how it is had again."""
    if not available()[name]:
        raise FileNotFoundError(f"{name} isn't at {SOURCES[name]['path']}; {SOURCES[name]['rebuild'] or 'fetch it first'}")
    return SOURCES[name]["path"]


def result_path(root: str, block: str, table_name: str, rebuild: str = "") -> str:
    """Where a block's table is written; its folder is made."""
    folder = Path(root) / block
    folder.mkdir(parents=True, exist_ok=True)
    if rebuild:
        (folder / "REBUILD").write_text(rebuild + "\n")
    return str(folder / f"{table_name}.csv")


def series(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(series_id, split, label, t, value) of a text file of labelled series: head lines of @ and #, then "v,v,?:label"."""
    rows = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id()).filter(~F.col("value").rlike("^[@#]") & (F.trim("value") != ""))
    rows = rows.select(F.concat_ws("-", F.lit(split), F.col("_id").cast("string")).alias("series_id"), F.lit(split).alias("split"), F.trim(F.substring_index("value", ":", -1)).alias("label"), F.split(F.regexp_replace("value", ":[^:]*$", ""), ",").alias("_v"))
    return rows.select("series_id", "split", "label", F.posexplode("_v").alias("t", "_x")).select("series_id", "split", "label", "t", F.when(F.trim("_x") != "?", F.trim("_x").cast("double")).alias("value"))


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """label as 0.. in its order; the labels are a few."""
    codes = df.select(label).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(F.broadcast(codes), label)


def results(spark: SparkSession, path: str) -> DataFrame:
    """A result table; "None" stays a value. A missing one raises."""
    return spark.read.option("header", True).option("inferSchema", True).option("nullValue", "\u0000").csv(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)

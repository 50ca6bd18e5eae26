"""Readers and writers by file extension, and the registry that plugins extend.

Readers give frames: tables as they are, array bundles as (path, name, dtype,
shape, data), audio as (signal_id, sr, channel, samples). Writers take the same.
"""

from __future__ import annotations

import io
import json
import os
import sys
import wave
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE = "path string, name string, dtype string, shape array<int>, data array<double>"
AUDIO = "signal_id string, sr int, channel int, samples array<double>"
MODES = ("overwrite", "append", "fail")


def extension(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


# -- readers -----------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    schema = options.pop("schema", None)
    reader = spark.read.options(header=True, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """An array of records; if it is none, one record per line."""
    whole = spark.read.options(multiLine=True, **options).json(path)
    corrupt = spark.conf.get("spark.sql.columnNameOfCorruptRecord")
    lines = spark.read.options(**options).json(path)
    if corrupt in whole.columns:
        return lines
    # several records on lines of their own read as the first one in multi-line mode
    return lines if corrupt not in lines.columns else whole


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Every array of every bundle, flattened by rows; a task reads one file at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    yield pd.DataFrame([(file, k, str(arrays[k].dtype), list(arrays[k].shape), arrays[k].astype(float).ravel()) for k in arrays.files], columns=["path", "name", "dtype", "shape", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, BUNDLE)


def decode_wav(content: bytes, mono: bool = True, offset: float = 0.0, duration: float | None = None) -> tuple[int, np.ndarray]:
    """(rate, channels x samples in -1..1) of PCM audio."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        w.setpos(min(w.getnframes(), int(offset * rate)))
        raw = w.readframes(w.getnframes() if duration is None else int(duration * rate))
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(float) / 0x800000 - 1
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels).T
    return rate, x.mean(axis=0, keepdims=True) if mono else x


def read_wav(spark: SparkSession, path: str, sr: int | None = None, mono: bool = True, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """PCM audio, one row per file and channel; ``sr`` resamples."""
    from brinewave.operators.kernels import resample

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                rate, x = decode_wav(content, mono, offset, duration)
                if sr and sr != rate:
                    x, rate = np.stack([resample(c, int(round(len(c) * sr / rate))) for c in x]), sr
                yield pd.DataFrame([(file, rate, i, c) for i, c in enumerate(x)], columns=["signal_id", "sr", "channel", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, AUDIO)


def read_stdin(spark: SparkSession) -> DataFrame:
    """A CSV from standard input; it is read on the driver, as is its nature."""
    return spark.createDataFrame(pd.read_csv(sys.stdin))


# -- writers -----------------------------------------------------------------

def _mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return "errorifexists" if mode == "fail" else mode


def write_csv(df: DataFrame, path: str, mode: str = "fail", **options) -> None:
    df.write.mode(_mode(mode)).options(header=True, **options).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "fail", records: bool = False, **options) -> None:
    """One record per line; with ``records`` every file is one array of records, written as a stream."""
    if not records:
        df.write.mode(_mode(mode)).options(**options).json(path)
        return

    def bracket(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        comma = ""
        for part in parts:
            if len(part):
                yield pd.DataFrame({"value": [comma + part["value"].iloc[0], *("," + v for v in part["value"].iloc[1:])]})
                comma = ","
        yield pd.DataFrame({"value": ["]"]})

    lines = df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(bracket, "value string")
    lines.write.mode(_mode(mode)).options(**options).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "fail", **options) -> None:
    df.write.mode(_mode(mode)).options(**options).parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    df.write.mode(_mode(mode)).saveAsTable(name)


def query_table(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    return spark.sql(query, args=args or {})


def write_npz(df: DataFrame, path: str, most: int = 10_000_000) -> None:
    """One array per column into one file; made on the driver, so bounded by ``most`` rows."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows do not go into one bundle; write Parquet")
    pdf = df.toPandas()
    np.savez(path, **{c: pdf[c].to_numpy() for c in pdf.columns})


def save_arrays(data: np.ndarray | dict[str, np.ndarray], path: str) -> None:
    """Arrays in memory: one goes into a bundle as ``data`` or into a CSV, named ones into a bundle only."""
    kind = extension(path)
    if isinstance(data, dict):
        if kind != ".npz":
            raise ValueError(f"named arrays go into .npz, not {kind!r}")
        np.savez(path, **data)
    elif kind == ".npz":
        np.savez(path, data=data)
    elif kind == ".csv" and data.ndim <= 2:
        pd.DataFrame(data, columns=["value"] if data.ndim == 1 else None).to_csv(path, index=False, header=data.ndim == 1)
    else:
        raise ValueError(f"an array of {data.ndim} dimensions does not go into {kind!r}")


def bundle_files(bundles: DataFrame) -> DataFrame:
    """(path, content): rows as read_npz gives them, each path's arrays as one bundle, made by the executors."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.savez(out, **{k: np.asarray(x, float).astype(t).reshape(tuple(s)) for k, t, s, x in zip(part["name"], part["dtype"], part["shape"], part["data"], strict=True)})
        return pd.DataFrame({"path": [part["path"].iloc[0]], "content": [out.getvalue()]})

    return bundles.groupBy("path").applyInPandas(pack, "path string, content binary")


def write_bundles(bundles: DataFrame, folder: str) -> None:
    """Each path's arrays as a file of a folder that the driver reaches, one at a time."""
    os.makedirs(folder, exist_ok=True)
    for row in bundle_files(bundles).toLocalIterator():
        with open(os.path.join(folder, PurePosixPath(row["path"]).stem + ".npz"), "wb") as f:
            f.write(row["content"])


def read_points(spark: SparkSession, path: str, sr: float = 44100.0) -> DataFrame:
    """(signal_id, sr, samples): the ``amplitude`` of each record of a JSON array in its order, one row per file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(file, float(sr), [float(p["amplitude"]) for p in json.loads(content)]) for file, content in zip(part["path"], part["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["signal_id", "sr", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "signal_id string, sr double, samples array<double>")


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of channels x samples (or samples), clipped to -1..1."""
    x = np.atleast_2d(samples)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(x))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(np.clip(x.T, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_files(df: DataFrame, name: str = "name") -> DataFrame:
    """(name, content): the audio rows (name, sr, samples) as files in memory, made by the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            files = [encode_wav(np.asarray(x, float), int(r)) for x, r in zip(part["samples"], part["sr"], strict=True)]
            yield pd.DataFrame({"name": part[name], "content": files})

    return df.select(name, "sr", "samples").mapInPandas(run, "name string, content binary")


def write_wav(df: DataFrame, folder: str, name: str = "name") -> None:
    """Each row (name, sr, samples) as a file of a folder that the driver reaches, one at a time."""
    os.makedirs(folder, exist_ok=True)
    for row in wav_files(df, name).toLocalIterator():
        with open(os.path.join(folder, f"{row['name']}.wav"), "wb") as f:
            f.write(row["content"])


def segment_names(df: DataFrame, stem: str, n: int) -> DataFrame:
    """Rows with segment_id get their file's name, numbers padded to the width of n."""
    width = max(1, len(str(max(0, n - 1))))
    return df.withColumn("name", F.concat(F.lit(f"{stem}_segment_"), F.lpad(F.col("segment_id").cast("string"), width, "0")))


# -- registry ------------------------------------------------------------------

class Registry:
    """Readers, writers and named column functions; the last registration wins."""

    def __init__(self) -> None:
        self.readers: dict[str, Callable] = {}
        self.writers: dict[str, Callable] = {}
        self.functions: dict[str, Callable] = {}

    @staticmethod
    def _ext(ext: str) -> str:
        ext = ext.lower()
        return ext if ext.startswith(".") else f".{ext}"

    def add_reader(self, ext: str, f: Callable) -> None:
        self.readers[self._ext(ext)] = f

    def add_writer(self, ext: str, f: Callable) -> None:
        self.writers[self._ext(ext)] = f

    def register(self, f: Callable | None = None, *, name: str | None = None) -> Callable:
        """Decorator for named functions."""
        if f is None:
            return lambda g: self.register(g, name=name)
        self.functions[name or f.__name__] = f
        return f

    def extensions(self) -> list[str]:
        return sorted({*self.readers, *self.writers})


def default_registry() -> Registry:
    out = Registry()
    for ext, f in ((".csv", read_csv), (".json", read_json), (".jsonl", read_json), (".parquet", read_parquet), (".npz", read_npz), (".wav", read_wav)):
        out.add_reader(ext, f)
    for ext, f in ((".csv", write_csv), (".json", write_json), (".parquet", write_parquet), (".npz", write_npz)):
        out.add_writer(ext, f)
    return out


REGISTRY = default_registry()


def read(spark: SparkSession, path: str, registry: Registry | None = None, **options) -> DataFrame:
    """Any supported file or folder by its extension; ``-`` is standard input."""
    if path == "-":
        return read_stdin(spark)
    found = (registry or REGISTRY).readers.get(extension(path)) or REGISTRY.readers.get(extension(path))
    if found is None:
        raise ValueError(f"no reader for {extension(path)!r}; there are {', '.join(REGISTRY.extensions())}")
    return found(spark, path, **options)


def write(df: DataFrame, path: str, registry: Registry | None = None, **options) -> None:
    found = (registry or REGISTRY).writers.get(extension(path)) or REGISTRY.writers.get(extension(path))
    if found is None:
        raise ValueError(f"no writer for {extension(path)!r}; there are {', '.join(REGISTRY.extensions())}")
    found(df, path, **options)


def read_folder(spark: SparkSession, folder: str, ext: str, schema: str) -> DataFrame:
    """Every file of a folder with one extension, with its path; a bad row stays out of the others' way."""
    kind = ext.lstrip(".")
    rows = spark.read.options(header=True, pathGlobFilter=f"*.{kind}").schema(schema).format("csv" if kind == "csv" else kind).load(folder)
    return rows.withColumn("path", F.input_file_name())

"""Sinks: GeoJSON collections, layers under a hash of their parameters, and pictures of layers."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions import geo


def feature(geometry: Column, kind: str, properties: Column) -> Column:
    """SNK-03: one GeoJSON feature as text. properties is a struct."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.lit(kind).alias("kind"), properties.alias("values")).alias("properties")))


def polygon(ring: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def pond_features(sites: DataFrame) -> DataFrame:
    """SNK-03, SNK-04: sites(job_id, rank, lon, lat, top_m, ...) -> job_id, feature of the pond's rectangle."""
    ring = geo.pond_rectangle(F.col("lon"), F.col("lat"), F.col("top_m"), F.col("top_m"))
    return sites.select("job_id", F.col("rank").alias("place"), feature(polygon(ring), "pond_footprint", F.struct("rank", "top_m")).alias("feature"))


def collections(features: DataFrame) -> DataFrame:
    """SNK-03: features(job_id, place, feature) -> job_id, collection: a survey's features in order; they are few, as a map is drawn of them."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "feature"))), lambda x: x["feature"])
    return features.groupBy("job_id").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(parts, ","), F.lit("]}")).alias("collection"))


def content_key(layer: DataFrame) -> str:
    """A digest of a layer's rows, whatever their order and partitions: their number, and sums of two hashes of each."""
    cols = sorted(layer.columns)
    # modulo a prime below 2^61, so that sums of many rows fit a decimal; nulls and column names count too
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})), F.lit((1 << 61) - 1)).cast("decimal(38,0)"))
    r = layer.agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(2).alias("b")).first()
    return f"{r.n}-{r.a}-{r.b}"


def _finished(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_layer(layer: DataFrame, root: str, *parts: object) -> str:
    """SNK-02: Parquet by grid, under a hash of the parameters and of the layer's rows: the same layer is written once, a changed one goes elsewhere. A folder that a failed job left is written anew."""
    import hashlib

    path = f"{root}/{hashlib.sha256('|'.join([*map(str, parts), content_key(layer)]).encode()).hexdigest()}"
    if not _finished(layer.sparkSession, path):
        layer.write.mode("overwrite").partitionBy("grid_id").parquet(path)
    return path


def png(rgba: np.ndarray) -> bytes:
    """SNK-05: rows by columns by four bytes."""
    n, m, _ = rgba.shape
    raw = b"".join(b"\0" + rgba[r].astype(np.uint8).tobytes() for r in range(n))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", m, n, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pixels(data: bytes) -> np.ndarray:
    """rows by columns by four bytes of a picture that png made."""
    m, n = struct.unpack(">II", data[16:24])
    size = struct.unpack(">I", data[33:37])[0]
    return np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(n, 1 + 4 * m)[:, 1:].reshape(n, m, 4)


def pictures(cells: DataFrame, value: str, low: float, high: float, grey: bool = False) -> DataFrame:
    """SNK-05: grid_id, png of a layer from white to dark blue, or from black to white as for hillshade; nodata is clear."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), np.nan)
        a[pdf["row"], pdf["col"]] = pdf[value].to_numpy(float, na_value=np.nan)
        t = np.clip((a - low) / (high - low), 0, 1)
        t0 = np.nan_to_num(t)
        ramp = [np.rint(255 * t0)] * 3 if grey else [255 * (1 - t0), 255 * (1 - 0.8 * t0), 255 - 100 * t0]
        out = np.stack([*ramp, np.where(np.isfinite(t), 255, 0)], 2)
        return pd.DataFrame({"grid_id": [pdf["grid_id"].iloc[0]], "png": [png(out)]})

    return cells.select("grid_id", "row", "col", value).groupBy("grid_id").applyInPandas(run, "grid_id long, png binary")


def retained(catalogue: DataFrame, most: int, order: str = "used_at", by: str | None = None, now: Column | None = None, hours: int | None = None) -> DataFrame:
    """K-09, ST-07: the newest rows of each store (by; one store without it), at most that many, and none older than some hours before now."""
    d = catalogue if hours is None or now is None else catalogue.where(F.col(order) >= now - F.expr(f"interval {hours} hours"))
    if by is None:
        return d.orderBy(F.desc(order)).limit(most)
    return d.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__k") <= most).drop("__k")

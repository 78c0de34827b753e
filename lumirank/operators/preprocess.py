"""Images to model tensors and back, as one pass over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.functions.pixels import from_planes, resize_and_crop, to_planes

SIZE = 224
CHUNK = 16  # rows of one output batch: a tensor of 224 × 224 takes 602 KB

# Byte order of Spark's image rows per channel count, and its mode for three channels.
CHANNEL_ORDER = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}
MODE_3_CHANNELS = 16


def image_tensor(image: dict, size: int, gray: str) -> np.ndarray:
    """Normalised planes (3, size, size) of one image row."""
    height, width, channels = image["height"], image["width"], image["nChannels"]
    if height is None or height <= 0 or width <= 0:
        raise ValueError("not an image")
    if channels == 1 and gray == "reject":
        raise ValueError("image has one channel")
    pixels = np.frombuffer(image["data"], np.uint8).reshape(height, width, channels)
    return to_planes(resize_and_crop(pixels[..., CHANNEL_ORDER[channels]], size))


def tensors_of(images: list[dict | None], size: int, gray: str) -> tuple[list[np.ndarray | None], list[str | None]]:
    """(tensor or None, error or None) of each image row; a bad image is reported, never raised."""
    tensors, errors = [], []
    for image in images:
        try:
            if image is None:
                raise ValueError("no image")
            tensors.append(image_tensor(image, size, gray))
            errors.append(None)
        except Exception as problem:  # noqa: BLE001 - any unreadable image becomes a reject
            tensors.append(None)
            errors.append(f"{type(problem).__name__}: {problem}")
    return tensors, errors


def float_lists(rows: list[np.ndarray | None]) -> pa.Array:
    """A float list column of the given arrays; None gives null."""
    flat = [r.ravel() for r in rows if r is not None]
    values = np.concatenate(flat).astype(np.float32, copy=False) if flat else np.empty(0, np.float32)
    lengths = [0 if r is None else r.size for r in rows]
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    mask = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=mask)


def without_pixels(batch: pa.RecordBatch, image: str = "image") -> dict[str, pa.Array]:
    """The batch's columns with the pixel bytes left out of the image struct."""
    columns = {name: batch.column(name) for name in batch.schema.names}
    column = columns[image]
    names = [f.name for f in column.type if f.name != "data"]
    mask = column.is_null() if column.null_count else None
    columns[image] = pa.StructArray.from_arrays([column.field(n) for n in names], names=names, mask=mask)
    return columns


def stripped_schema(df: DataFrame, *more: T.StructField) -> T.StructType:
    """Schema of `df` without pixel bytes and with more columns."""
    fields = []
    for field in df.schema:
        if field.name == "image":
            kept = T.StructType([f for f in field.dataType if f.name != "data"])
            field = T.StructField("image", kept)
        fields.append(field)
    return T.StructType([*fields, *more])


def preprocess_images(df: DataFrame, size: int = SIZE, gray: str = "replicate") -> DataFrame:
    """Resize, crop to the middle, normalise: adds `tensors` (3·size·size floats) and `error`.

    A bad image keeps its row with null tensors and the reason. One-channel images give three equal
    planes, or are refused with `gray="reject"`. Pixel bytes are dropped.
    """
    schema = stripped_schema(
        df, T.StructField("tensors", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())
    )

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                tensors, errors = tensors_of(part.column("image").to_pylist(), size, gray)
                columns = without_pixels(part)
                columns["tensors"] = float_lists(tensors)
                columns["error"] = pa.array(errors, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def tensor_to_image(df: DataFrame, size: int = SIZE, tensors: str = "tensors", origin: str | None = None) -> DataFrame:
    """Tensors back to image rows (three channels), readable by `preprocess_images` again."""
    path = F.lit(None).cast("string") if origin is None else F.col(origin)

    @F.arrow_udf("binary")
    def pixels(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            planes = None if row.as_py() is None else row.values.to_numpy().reshape(3, size, size)
            out.append(None if planes is None else from_planes(planes)[..., ::-1].tobytes())
        return pa.array(out, pa.binary())

    image = F.struct(
        path.alias("origin"),
        F.lit(size).alias("height"),
        F.lit(size).alias("width"),
        F.lit(3).alias("nChannels"),
        F.lit(MODE_3_CHANNELS).alias("mode"),
        F.col("_pixels").alias("data"),
    )
    rest = [c for c in df.columns if c not in (tensors, "image")]
    return df.withColumn("_pixels", pixels(F.col(tensors))).select(*rest, F.when(F.col("_pixels").isNotNull(), image).alias("image"))

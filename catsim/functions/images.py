"""Image columns: validity, information, sharpness, model tensors and embeddings by a model of the caller.

`read_image_files` and `examine` read a folder once and do all work on a file's bytes in one pass: pixels never become a
column. The other functions take pixels as Spark's ``image`` struct (height, width, nChannels, data in BGR or BGRA order),
whose decoding is Spark's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catsim.functions.decode import Decoder, decode, file_format

EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp")
MAX_BYTES = 5 * 1024 * 1024
MIN_SHARPNESS = 20.0
SIDE = 224
# Means and deviations of the channels (red, green, blue) that models expect.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

Model = Callable[[list], tuple[np.ndarray, np.ndarray]]


def extension(path: str | Column) -> Column:
    """The lower-case extension of a path, without the dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _file_options(extensions: tuple[str, ...]) -> dict:
    """Options of a file source that list files of some extensions only, in any case."""
    any_case = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    return {"recursiveFileLookup": True, "pathGlobFilter": "*.{" + ",".join(map(any_case, extensions)) + "}"}


def read_image_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content) of all image files below a folder, for `examine`: each is read once.

    Files of more than ``max_bytes`` are listed without content and not read at all.
    """
    files = spark.read.format("binaryFile").options(**_file_options(extensions)).load(path)
    small = files.where(F.col("length") <= max_bytes).select("path", "length", "content")
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def read_image_dir(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length, content, image) of all image files below a folder; ``image`` is the decoded struct, -1 channels if invalid.

    Both sources list files of the wanted extensions only, so nothing else is read or decoded. Spark's file sources list no
    files of zero bytes; ``invalid_reason`` finds empty contents that come by other ways.
    """
    files = _file_options(extensions)
    found = spark.read.format("binaryFile").options(**files).load(path).select("path", "length", "content")
    decoded = spark.read.format("image").options(**files).load(path).select("image")
    # Both sources write a file's URI in their own way (one slash or three).
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return found.withColumn("_key", key(F.col("path"))).join(decoded.withColumn("_key", key(F.col("image.origin"))), "_key", "left").drop("_key")


def invalid_reason(length: str = "length", image: str = "image", max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is no valid image: empty, too_large or undecodable, the first that holds; null if it is valid."""
    channels = F.coalesce(F.col(image)["nChannels"], F.lit(-1))
    return F.when(F.coalesce(F.col(length), F.lit(0)) == 0, "empty").when(F.col(length) > max_bytes, "too_large").when(channels < 1, "undecodable")


def image_info(content: str = "content", image: str = "image") -> Column:
    """Struct of format (by the leading bytes), mode, channels, width, height and size_bytes."""
    head = F.hex(F.substring(content, 1, 4))
    kind = F.when(head.startswith("FFD8FF"), "JPEG").when(head == "89504E47", "PNG").when(head == "52494646", "WEBP").when(head.startswith("424D"), "BMP").when(head == "47494638", "GIF")
    pixels = F.col(image)
    mode = F.when(pixels["nChannels"] == 1, "L").when(pixels["nChannels"] == 3, "RGB").when(pixels["nChannels"] == 4, "RGBA")
    return F.struct(kind.alias("format"), mode.alias("mode"), pixels["nChannels"].alias("channels"), pixels["width"].alias("width"), pixels["height"].alias("height"), F.length(content).alias("size_bytes"))


def _curvature_spread(gray: np.ndarray) -> float:
    """Variance of the curvature (second differences down and across, summed), which counts as 0 along the border."""
    if min(gray.shape) < 3:
        return 0.0
    bend = np.diff(gray, 2, axis=0)[:, 1:-1] + np.diff(gray, 2, axis=1)[1:-1]
    return float(np.square(bend).sum() / gray.size - (bend.sum() / gray.size) ** 2)


@F.pandas_udf(T.DoubleType())
def sharpness(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Sharpness of gray pixels (array<double>, row by row): the variance of the Laplacian, or 0.7 of that of the middle half.

    Null pixels or sizes that do not fit give null.
    """

    def one(values, w, h) -> float | None:
        if values is None or not w == w or not h == h or len(values) != int(w) * int(h):
            return None
        return _sharpness(np.asarray(values, dtype=np.float64).reshape(int(h), int(w)))

    return pd.Series([one(*row) for row in zip(pixels, width, height, strict=True)], dtype="float64")


def filter_sharp(images: DataFrame, pixels: str, width: str | Column, height: str | Column, min_score: float = MIN_SHARPNESS) -> DataFrame:
    """Rows whose sharpness reaches ``min_score``, with ``sharpness``; rows without pixels go."""
    return images.withColumn("sharpness", sharpness(pixels, width, height)).where(F.col("sharpness") >= min_score)


def rgb(image: pd.DataFrame) -> Iterator[np.ndarray | None]:
    """Pixels (height, width, 3) as floats, transparent ones on white; None for an undecodable image."""
    for row in image.itertuples(index=False):
        if not row.nChannels or not row.nChannels > 0:
            yield None
            continue
        flat = np.frombuffer(row.data, dtype=np.uint8).reshape(int(row.height), int(row.width), int(row.nChannels)).astype(np.float32)
        yield _on_white(np.concatenate([flat[..., 2::-1], flat[..., 3:]], axis=2) if flat.shape[2] > 2 else flat[..., :1])


def _on_white(pixels: np.ndarray) -> np.ndarray:
    """Pixels (height, width, 3) as floats from gray, gray and alpha, RGB or RGBA."""
    pixels = pixels.astype(np.float32)
    channels = pixels.shape[2]
    colour = pixels[..., :3] if channels > 2 else np.repeat(pixels[..., :1], 3, axis=2)
    if channels in (2, 4):
        alpha = pixels[..., -1:] / 255
        colour = np.round(colour * alpha + 255 * (1 - alpha))
    return colour


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gray_pixels(image: pd.DataFrame) -> pd.Series:
    """Gray values of an image struct, row by row."""
    return pd.Series([None if p is None else _gray(p).ravel() for p in rgb(image)])


def _gray(colour: np.ndarray) -> np.ndarray:
    return np.round(colour @ np.array([0.299, 0.587, 0.114]))


def _sharpness(gray: np.ndarray) -> float:
    """The greater of the curvature's spread and of 0.7 times that of the middle half."""
    top, left = gray.shape[0] // 4, gray.shape[1] // 4
    middle = gray[top : gray.shape[0] - top, left : gray.shape[1] - left]
    return max(_curvature_spread(gray), 0.7 * _curvature_spread(middle))


def _triangle(old: int, new: int) -> np.ndarray:
    """Weights (new x old) of bilinear resampling; the triangle widens where the image shrinks."""
    ratio = old / new
    reach = max(ratio, 1.0)
    centre = (np.arange(new) + 0.5) * ratio
    weight = np.maximum(0.0, 1 - np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) / reach)
    return weight / weight.sum(axis=1, keepdims=True)


def tensor(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(3, side, side): the short side resized to ``side``, the centre cut out, channels normalised."""
    height, width = pixels.shape[:2]
    scale = side / min(height, width)
    high, wide = max(side, int(height * scale)), max(side, int(width * scale))
    made = np.einsum("ah,hwc->awc", _triangle(height, high), pixels)
    made = np.round(np.einsum("bw,awc->abc", _triangle(width, wide), np.round(made)))
    top, left = (high - side) // 2, (wide - side) // 2
    cut = made[top : top + side, left : left + side] / 255
    return ((cut - np.array(MEAN)) / np.array(DEVIATION)).transpose(2, 0, 1).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def model_tensor(image: pd.DataFrame) -> pd.Series:
    """The tensor of an image struct, flat in the order channel, row, column; null for an undecodable image."""
    return pd.Series([None if p is None else tensor(p).ravel() for p in rgb(image)])


EXAMINED = "reason string, format string, mode string, channels int, width int, height int, size_bytes long, sharpness double"
MODES = {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}
#: Pictures whose tensors a task holds at once.
TENSORS = 16


def _examine(content: bytes | None, length: int | None, max_bytes: int, min_sharpness: float | None, side: int | None, decoder: Decoder) -> tuple[tuple, np.ndarray | None]:
    """The columns `EXAMINED` of one file, and its tensor if ``side`` is given and the file is good."""
    size = len(content) if content is not None else length or 0
    kind = file_format(content) if content else None
    told = lambda reason, *rest: (reason, kind, *(rest or (None,) * 4), size)
    if not size or size > max_bytes:
        return (*told("too_large" if size else "empty"), None), None
    try:
        pixels = decoder(content)
        shape = (MODES[pixels.shape[2]], pixels.shape[2], pixels.shape[1], pixels.shape[0])
    except ImportError:
        raise
    except Exception:  # a damaged file may break a decoder in any way
        return (*told("undecodable"), None), None
    colour = _on_white(pixels)
    sharp = _sharpness(_gray(colour))
    if min_sharpness is not None and sharp < min_sharpness:
        return (*told("blurred", *shape), sharp), None
    return (*told(None, *shape), sharp), None if side is None else tensor(colour, side)


def examine(files: DataFrame, keep: list[str], max_bytes: int = MAX_BYTES, min_sharpness: float | None = None, side: int | None = None, model_factory: Callable[[], Model] | None = None, decoder: Decoder = decode) -> DataFrame:
    """The columns ``keep`` of ``files`` (length, content, more) with `EXAMINED`: what a file's bytes say, in one pass.

    ``reason`` is why a file is no good: empty, too_large, undecodable or, with ``min_sharpness``, blurred; null for a good one.
    Each file is decoded once, and one that is too large not at all. With ``side`` a good file gets its ``tensor``, flat in the
    order channel, row, column. With ``model_factory``, which each task calls once, it gets ``coarse`` and ``fine``, unit
    vectors by a model that takes a list of tensors (3, side, side), or an ``error``. A null content of a known length counts as
    a file that wasn't read.
    """
    wide = side if side is not None else SIDE if model_factory is not None else None
    schema = f"{', '.join(f'`{c}` {files.schema[c].dataType.simpleString()}' for c in keep)}, {EXAMINED}"
    schema += ", coarse array<float>, fine array<float>, error string" if model_factory else ", tensor array<float>" if side else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_factory() if model_factory else None
        for batch in batches:
            for at in range(0, len(batch), TENSORS):
                part = batch.slice(at, TENSORS)
                length, content = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows, tensors = zip(*(_examine(c, n, max_bytes, min_sharpness, wide, decoder) for c, n in zip(content, length, strict=True)), strict=True)
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
                columns = [*part.columns[2:], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                if model is not None:
                    good = [i for i, t in enumerate(tensors) if t is not None]
                    made = dict(zip(good, _embed(model, [tensors[i] for i in good]), strict=True))
                    columns += [pa.array([made.get(i, (None,) * 3)[c] for i in range(len(part))], k) for c, k in enumerate((pa.list_(pa.float32()), pa.list_(pa.float32()), pa.string()))]
                elif side:
                    columns.append(pa.array([None if t is None else t.ravel() for t in tensors], pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return files.select(F.col("length").cast("long"), "content", *keep).mapInArrow(run, schema)


def _embed(model: Model, inputs: list) -> list[tuple]:
    """(coarse, fine, error) of each input. When a batch fails its inputs are tried one by one, so that only the bad ones fail."""
    if not inputs:
        return []
    try:
        coarse, fine = model(inputs)
        return list(zip(_unit_rows(coarse).tolist(), _unit_rows(fine).tolist(), [None] * len(inputs), strict=True))
    except Exception as problem:  # a model may fail in any way; the reason is kept with the row
        if len(inputs) == 1:
            return [(None, None, f"{type(problem).__name__}: {problem}"[:500])]
        return [r for x in inputs for r in _embed(model, [x])]


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, dtype=np.float64)
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-8)


def embed_images(images: DataFrame, id_column: str, input_column: str, model_factory: Callable[[], Model], batch_size: int = 16) -> DataFrame:
    """(id, coarse, fine, error): unit vectors by a model that each task loads once.

    The model takes a list of inputs and returns two matrices. When a batch fails its inputs are tried one by one, so that
    only the bad ones fail; ``error`` says why.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()

        for frame in frames:
            ids, inputs = frame[id_column].tolist(), frame[input_column].tolist()
            for at in range(0, len(ids), batch_size):
                own = ids[at : at + batch_size]
                made = _embed(model, inputs[at : at + batch_size])
                yield pd.DataFrame([(i, *r) for i, r in zip(own, made, strict=True)], columns=[id_column, "coarse", "fine", "error"])

    kind = images.schema[id_column].dataType.simpleString()
    return images.select(id_column, input_column).mapInPandas(run, f"`{id_column}` {kind}, coarse array<float>, fine array<float>, error string")


def rebuild_vectors(catalogue: DataFrame, images: DataFrame, model_factory: Callable[[], Model], batch_size: int = 16) -> DataFrame:
    """(faiss_id, coarse, fine, error): new vectors for catalogue rows under their old ids, from images (image_url, content).

    A row whose image is missing has the error ``missing``. `catsim.jobs.rebuild` writes the good ones as a new store.
    """
    joined = catalogue.select("faiss_id", "image_url").join(images.select("image_url", "content"), "image_url", "left")
    made = embed_images(joined.where("content IS NOT NULL"), "faiss_id", "content", model_factory, batch_size)
    none = F.lit(None).cast("array<float>")
    return made.unionByName(joined.where("content IS NULL").select("faiss_id", none.alias("coarse"), none.alias("fine"), F.lit("missing").alias("error")))

"""Images in files to pixels and back: portable grey maps, PNG, BMP and raw samples.

Files are read by Spark's own binary file source, batch or stream, so any store
that Spark reads will do; one file is decoded at a time. Grey values are 8 bits;
colours become grey by (77 r + 150 g + 29 b) >> 8. ``encoded`` gives each image's
bytes as a column, for whatever sink the caller has; ``write_images`` writes a file
an image through pyarrow's file systems.

Cases. Null or other content gives no row, a cut grey map the pixels it has, any
other cut file none. Values are clamped to a byte, missing pixels are 0.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Magic, width, height and greatest value, parted by blanks or comments, then one blank.
_HEAD = re.compile(rb"P5(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
_PNG = b"\x89PNG\r\n\x1a\n"
FORMATS = ("pgm", "png", "bmp")


def header(content: bytes | None) -> tuple[int, int, int] | None:
    """Width, height and offset of the pixels; None if this is no 8-bit grey map."""
    m = _HEAD.match(content or b"")
    return (int(m[1]), int(m[2]), m.end()) if m and 0 < int(m[3]) < 256 else None


def _grey(a: np.ndarray) -> np.ndarray:
    """Samples (height, width, channels) as grey values; an alpha channel is left out."""
    if a.shape[2] < 3:
        return a[:, :, 0]
    a = a.astype(np.int32)
    return ((77 * a[:, :, 0] + 150 * a[:, :, 1] + 29 * a[:, :, 2]) >> 8).astype(np.uint8)


def from_png(content: bytes) -> np.ndarray | None:
    """Grey values of an 8-bit PNG that is not interlaced; None for others."""
    at, data, shape, palette = len(_PNG), [], None, None
    while at + 12 <= len(content):
        n, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8:at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced or colour not in (0, 2, 3, 4, 6):
                return None
            shape = h, w, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error:
        return None
    if not shape or len(raw) != shape[0] * (shape[1] * shape[2] + 1):
        return None
    h, w, c = shape
    lines = raw.reshape(h, w * c + 1)
    out = np.zeros((h + 1, w * c), np.uint8)  # a line of zeros above the first
    for y in range(h):
        kind, line, up = lines[y, 0], lines[y, 1:], out[y]
        if kind == 2:
            out[y + 1] = line + up
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(w, c), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind in (3, 4):
            row = [0] * c + line.tolist()
            above = [0] * c + up.tolist()
            for i in range(c, len(row)):
                a, b, d = row[i - c], above[i], above[i - c]
                if kind == 3:
                    row[i] = (row[i] + (a + b) // 2) & 255
                else:
                    p, q, r = abs(b - d), abs(a - d), abs(a + b - 2 * d)
                    row[i] = (row[i] + (a if p <= q and p <= r else b if q <= r else d)) & 255
            out[y + 1] = row[c:]
        else:
            out[y + 1] = line
    a = out[1:].reshape(h, w, c)
    return _grey(palette[a[:, :, 0]]) if palette is not None and c == 1 else _grey(a)


def from_bmp(content: bytes) -> np.ndarray | None:
    """Grey values of an uncompressed BMP of 8, 24 or 32 bits; None for others."""
    if len(content) < 54 or content[:2] != b"BM":
        return None
    start, size, w, h, _, bits, packed = struct.unpack_from("<I", content, 10)[0], *struct.unpack_from("<IiiHHI", content, 14)
    line = (abs(w) * bits // 8 + 3) // 4 * 4
    if bits not in (8, 24, 32) or packed or len(content) < start + line * abs(h) or w <= 0 or not h:
        return None
    a = np.frombuffer(content, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, :w * bits // 8].reshape(abs(h), w, bits // 8)
    a = a[::-1] if h > 0 else a
    if bits > 8:
        return _grey(a[:, :, 2::-1])
    n = (start - 14 - size) // 4
    palette = np.frombuffer(content, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1] if n else np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
    same = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return palette[a[:, :, 0]][:, :, 0] if same else _grey(palette[a[:, :, 0]])


def to_bytes(a: np.ndarray, kind: str) -> bytes:
    """A file of grey values (height, width)."""
    h, w = a.shape
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (w, h) + a.tobytes()
    if kind == "png":
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        lines = np.concatenate([np.zeros((h, 1), np.uint8), a], axis=1).tobytes()
        return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
    if kind == "bmp":
        line = (w + 3) // 4 * 4
        body = np.zeros((h, line), np.uint8)
        body[:, :w] = a[::-1]
        palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
        palette[:, 3] = 0
        return b"BM" + struct.pack("<IHHI", 1078 + body.size, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, body.size, 0, 0, 256, 0) + palette.tobytes() + body.tobytes()
    raise ValueError(f"unknown format {kind!r}")


def _image(g: pd.DataFrame) -> np.ndarray:
    a = np.zeros((int(g["y"].max()) + 1, int(g["x"].max()) + 1), np.uint8)
    a[g["y"].to_numpy(), g["x"].to_numpy()] = np.clip(g["v"].to_numpy(), 0, 255)
    return a


def encoded(px: DataFrame, kind: str = "pgm") -> DataFrame:
    """Each image's file: ``image_id, content``."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    ship(px.sparkSession)
    t = dict(px.dtypes)["image_id"]
    return px.dropna().groupBy("image_id").applyInPandas(lambda g: pd.DataFrame({"image_id": [g["image_id"].iloc[0]], "content": [to_bytes(_image(g), kind)]}), f"image_id {t}, content binary")


def write_images(px: DataFrame, folder: str, kind: str = "pgm") -> DataFrame:
    """Write a file for each image below a folder that the executors reach by its URI; returns ``image_id, path, bytes`` as files are written.

    A file is named by its image and written whole, so a task that runs again
    writes the same. Nothing is written before the result is read.
    """
    files = encoded(px, kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for f in frames:
            paths = []
            for name, content in zip(f["image_id"], f["content"], strict=True):
                paths.append(f"{top}/{re.sub(r'[^A-Za-z0-9._-]', '_', str(name))}.{kind}")
                with store.open_output_stream(paths[-1]) as out:
                    out.write(content)
            yield pd.DataFrame({"image_id": f["image_id"], "path": paths, "bytes": [len(c) for c in f["content"]]})

    return files.mapInPandas(run, f"image_id {dict(files.dtypes)['image_id']}, path string, bytes long")


def _values(content: bytes | None) -> np.ndarray | None:
    if not content:
        return None
    if head := header(content):
        w, h, at = head
        return np.frombuffer(content, np.uint8, min(w * h, len(content) - at), at), w
    a = from_png(content) if content.startswith(_PNG) else from_bmp(content) if content.startswith(b"BM") else None
    return None if a is None else (a.ravel(), a.shape[1])


def _pixels(name, a: np.ndarray, w: int) -> pd.DataFrame:
    return pd.DataFrame({"image_id": name, "y": np.arange(len(a)) // w, "x": np.arange(len(a)) % w, "v": a.astype(np.int32)})


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for name, content in zip(f["image_id"], f["content"], strict=True):
            if (found := _values(content)) is not None:
                yield _pixels(name, *found)


def decoded(files: DataFrame) -> DataFrame:
    """Pixels of ``files(image_id, content)``, the format told by the content."""
    ship(files.sparkSession)
    t = dict(files.dtypes)["image_id"]
    return files.select("image_id", "content").mapInPandas(_decode, f"image_id {t}, y int, x int, v int")


def decoded_raw(files: DataFrame, width: int, kind: str = "u1", offset: int = 0) -> DataFrame:
    """Pixels of raw samples in rows of a width after an offset: u1, <u2, >u2, <i2 or <f4 (truncated); samples of a cut row count."""
    if kind not in ("u1", "<u2", ">u2", "<i2", "<f4"):
        raise ValueError(f"unknown sample type {kind!r}")
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = np.dtype(kind).itemsize
        for f in frames:
            for name, content in zip(f["image_id"], f["content"], strict=True):
                if content and len(content) >= offset + size:
                    yield _pixels(name, np.frombuffer(content, kind, (len(content) - offset) // size, offset), width)

    return files.select("image_id", "content").mapInPandas(run, f"image_id {dict(files.dtypes)['image_id']}, y int, x int, v int")


def headers(files: DataFrame) -> DataFrame:
    """Width and height of grey maps by the header alone, in built-in functions: no pixel is decoded.

    The start of a file is enough for almost all; a header with longer comments
    is read from the whole content.
    """
    gap = r"(?:\s|#[^\n]*\n)+"
    part = lambda text, i: F.regexp_extract(text, rf"^P5{gap}(\d+){gap}(\d+){gap}(\d+)\s", i)
    start, whole = F.decode(F.substring("content", 1, 512), "ISO-8859-1"), F.decode("content", "ISO-8859-1")
    found = lambda i: F.when(part(start, 1) != "", part(start, i)).when(F.substring("content", 1, 2) == F.lit(b"P5"), part(whole, i)).otherwise("")
    return files.select("image_id", found(1).alias("_w"), found(2).alias("_h")).where("_w <> ''").select("image_id", F.col("_w").cast("int").alias("width"), F.col("_h").cast("int").alias("height"))


def _files(reader, path, pattern: str | None):
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", pattern) if pattern else reader


def read_images(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Pixels of all files below a path (of which the names match a glob pattern); an image's name is its file's path."""
    return decoded(_files(spark.read, path, pattern).load(path).select(F.col("path").alias("image_id"), "content"))


def read_sequence(spark: SparkSession, pattern: str, first: int, last: int) -> DataFrame:
    """Pixels of numbered files, such as ``shot_%03d.png``, with ``number`` in place of a name; missing numbers are an error, as for any path."""
    paths = [pattern % i for i in range(first, last + 1)]
    numbers = F.create_map(*[x for i, p in enumerate(paths, first) for x in (F.lit(p.rpartition("/")[2]), F.lit(i))])
    files = spark.read.format("binaryFile").load(paths)
    return decoded(files.select(F.try_element_at(numbers, F.element_at(F.split("path", "/"), -1)).cast("long").alias("image_id"), "content"))


def frames(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """A stream of the pixels of files as they arrive below a path."""
    schema = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary").schema
    return decoded(_files(spark.readStream.schema(schema), path, pattern).load(path).select(F.col("path").alias("image_id"), "content"))


def numbered(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pixels with numbers as ids, and ``image_id, name``: for operators and tables that want numbers."""
    from ..session import saved

    names = px.select(F.col("image_id").alias("name")).distinct().repartitionByRange("name").sortWithinPartitions("name")
    names, _ = saved(names.withColumn("image_id", F.monotonically_increasing_id()), "names")
    return px.withColumnRenamed("image_id", "name").join(names, "name").select("image_id", "y", "x", "v"), names

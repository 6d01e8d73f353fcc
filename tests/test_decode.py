"""Decoders against pictures made here, the one pass over files, and the import of a folder."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catsim.functions import decode, images
from catsim.jobs import imports, maintain
from catsim.jobs.queries import _png

PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predict(kind, a, b, c):
    p = a + b - c
    return (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v))))[kind]


def _lines(samples, depth, first):
    """Filtered lines, byte by byte as the format's description says."""
    height, width, channels = samples.shape
    step, before, out = max(1, channels * depth // 8), None, b""
    for y in range(height):
        if depth == 16:
            raw = b"".join(int(v).to_bytes(2, "big") for v in samples[y].ravel())
        else:
            bits = "".join(f"{int(v):0{depth}b}" for v in samples[y].ravel())
            raw = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
        kind, before = (y + first) % 5, before or bytes(len(raw))
        at = lambda line, i: line[i] if i >= 0 else 0
        out += bytes([kind]) + bytes((raw[i] - _predict(kind, at(raw, i - step), before[i], at(before, i - step))) & 255 for i in range(len(raw)))
        before = raw
    return out


def _make(samples, depth, colour, interlaced=False, first=0, extra=b""):
    height, width, _ = samples.shape
    parts = [samples[y::dy, x::dx] for y, x, dy, dx in PASSES] if interlaced else [samples]
    data = b"".join(_lines(p, depth, first) for p in parts if p.size)
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    packed = zlib.compress(data)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + extra + _chunk(b"tEXt", b"a\0b") + _chunk(b"IDAT", packed[:7]) + _chunk(b"IDAT", packed[7:]) + _chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png_kinds(colour, depth, interlaced):
    rng = np.random.default_rng(depth + colour)
    for height, width in ((1, 1), (3, 2), (13, 17), (16, 9)):
        samples = rng.integers(0, 1 << depth, (height, width, decode._CHANNELS[colour]))
        got = decode.decode(_make(samples, depth, colour, interlaced, height))
        want = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
        assert got.dtype == np.uint8 and np.array_equal(got, want)


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_palettes(depth):
    rng = np.random.default_rng(depth)
    table = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
    index = rng.integers(0, 1 << depth, (7, 11, 1))
    plain = decode.decode(_make(index, depth, 3, extra=_chunk(b"PLTE", table.tobytes())))
    assert np.array_equal(plain, table[index[..., 0]])
    clear = decode.decode(_make(index, depth, 3, True, extra=_chunk(b"PLTE", table.tobytes()) + _chunk(b"tRNS", b"\x00\x80")))
    alpha = np.array([0, 128] + [255] * 254)
    assert np.array_equal(clear[..., :3], plain) and np.array_equal(clear[..., 3], alpha[index[..., 0]])


def test_damage_is_told():
    good = _make(np.arange(64).reshape(8, 8, 1), 8, 0)
    assert decode.decode(good).shape == (8, 8, 1)
    for at in range(8, len(good)):
        with pytest.raises(Exception):
            decode.decode(good[:at] + bytes([good[at] ^ 255]) + good[at + 1 :])
    for n in (0, 1, 8, 20, len(good) // 2, len(good) - 13):
        with pytest.raises(Exception):
            decode.decode(good[:n])
    head = struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 0, 0, 0, 0)
    with pytest.raises(ValueError, match="unfit size"):
        decode.decode(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(bytes(1000))) + _chunk(b"IEND", b""))


def _bmp(pixels, bits):
    height, width = pixels.shape[:2]
    table = b"".join(bytes([i, i, i, 0]) for i in range(256)) if bits == 8 else b""
    row = (width * bits + 31) // 32 * 4
    lines = b"".join((line.astype(np.uint8).tobytes() if bits == 8 else np.concatenate([line[:, ::-1], np.zeros((width, bits // 8 - 3))], axis=1).astype(np.uint8).tobytes()).ljust(row, b"\0") for line in pixels[::-1])
    start = 54 + len(table)
    return b"BM" + struct.pack("<IHHI", start + len(lines), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(lines), 0, 0, 0, 0) + table + lines


@pytest.mark.parametrize("bits", [8, 24, 32])
def test_bmp(bits):
    pixels = np.random.default_rng(bits).integers(0, 256, (5, 7) if bits == 8 else (5, 7, 3))
    assert np.array_equal(decode.decode(_bmp(pixels, bits)), np.stack([pixels] * 3, axis=2) if bits == 8 else pixels)


def test_large_pictures_take_no_loop_over_pixels():
    pixels = np.random.default_rng(1).integers(0, 256, (300, 500))
    assert np.array_equal(decode.decode(_png(pixels, 3))[..., 1], pixels)


def _folder(tmp_path):
    rng = np.random.default_rng(2)
    (tmp_path / "in/sub").mkdir(parents=True)
    gray = rng.integers(0, 256, (9, 12))
    files = {"a.png": _png(gray, 1), "sub/b.PNG": _png(gray, 4), "c.bmp": _bmp(np.stack([gray] * 3, axis=2), 24), "flat.png": _png(gray * 0 + 7, 3), "bad.png": b"\x89PNG no", "d.jpg": b"\xff\xd8\xff\xe0 no", "huge.png": bytes(images.MAX_BYTES + 1), "note.txt": b"x"}
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    return f"file://{tmp_path}/in", gray


def test_one_pass_over_a_folder(spark, tmp_path):
    folder, gray = _folder(tmp_path)
    files = images.read_image_files(spark, folder)
    got = {r.path.rpartition("/")[2]: r for r in images.examine(files, ["path"], min_sharpness=1.0, side=8).collect()}
    assert {n: r.reason for n, r in got.items()} == {"a.png": None, "b.PNG": None, "c.bmp": None, "flat.png": "blurred", "bad.png": "undecodable", "d.jpg": "undecodable", "huge.png": "too_large"}
    assert [(got[n].format, got[n].mode, got[n].channels, got[n].width, got[n].height) for n in ("a.png", "b.PNG", "c.bmp")] == [("PNG", "L", 1, 12, 9), ("PNG", "RGBA", 4, 12, 9), ("BMP", "RGB", 3, 12, 9)]
    assert got["huge.png"].size_bytes == images.MAX_BYTES + 1 and got["huge.png"].format is None and got["flat.png"].tensor is None
    want = images.tensor(np.stack([gray] * 3, axis=2).astype(np.float32), 8).ravel()
    assert all(np.allclose(got[n].tensor, want) and got[n].sharpness == got["a.png"].sharpness for n in ("a.png", "b.PNG", "c.bmp"))
    assert got["a.png"].sharpness == pytest.approx(images._sharpness(gray.astype(float)))
    # Contents are read in one scan, of files that are not too large, and no pixels are a column.
    plan = images.examine(files, ["path"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan binaryFile" in line or "Scan binaryFile" in line]
    assert sum("content:binary" in line for line in scans) == 1 and "LessThanOrEqual(length" in plan and "array<double>" not in plan


def test_cases_of_contents(spark):
    rows = [(1, b"", 0, "x"), (2, None, None, "x"), (3, None, 99_000_000, "x"), (4, _png(np.zeros((2, 2)), 2), 1, "x"), (5, b"BM", 2, None)]
    df = spark.createDataFrame(rows, "id int, content binary, length int, reason string")
    got = {r.id: r for r in images.examine(df, ["id"], side=4).collect()}
    assert [got[i].reason for i in range(1, 6)] == ["empty", "empty", "too_large", None, "undecodable"] and len(got[4].tensor) == 48
    assert images.examine(df.limit(0), ["id"]).collect() == []
    other = images.examine(df.where("id = 5"), ["id"], decoder=lambda content: np.full((3, 3, 1), 9, np.uint8)).first()
    assert other.reason is None and other.mode == "L" and other.sharpness == 0


def test_import_of_a_folder(spark, tmp_path):
    folder, _ = _folder(tmp_path)
    at = {k: f"file://{tmp_path}/{k}" for k in ("catalogue", "vectors")}
    maintain.publish_catalogue(spark.createDataFrame([(7, "old")], "faiss_id long, image_url string"), at["catalogue"])

    def model_factory():
        def model(inputs):
            if any(t.std() < 1e-6 for t in inputs):
                raise ValueError("nothing to see")
            fine = np.stack([t.mean(axis=(1, 2)) for t in inputs]) + 5
            return fine[:, :2], fine

        return model

    run = lambda: imports.import_directory(spark, folder, "bags", at["catalogue"], at["vectors"], model_factory, "canvas tote")
    made = run()
    assert {r.status: r.n for r in made.counts.collect()} == {"ok": 4, "undecodable": 2, "too_large": 1} and made.version == 2
    rows = maintain.read_published(spark, at["catalogue"]).where("image_url <> 'old'").orderBy("faiss_id").collect()
    assert [(r.faiss_id, r.image_url.rpartition("/")[2], r.category, r.keywords_en, r.width, r.height) for r in rows][0] == (8, "a.png", "bags", "canvas tote", 12, 9) and [r.faiss_id for r in rows] == [8, 9, 10, 11]
    assert sorted(r.faiss_id for r in maintain.read_published_vectors(spark, at["vectors"]).collect()) == [8, 9, 10, 11]
    again = run()
    assert {r.status: r.n for r in again.counts.collect()} == {"skipped": 4, "undecodable": 2, "too_large": 1}
    assert maintain.read_published(spark, at["catalogue"]).count() == 5

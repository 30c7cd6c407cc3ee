"""Media columns: ISO base media files are walked box by box and described by columns; payloads are never decoded.

read_media() walks nested boxes (32- and 64-bit sizes, boxes that reach the end), decodes the sample tables (stsd, mdhd, stts,
stsc, stsz or stz2, stco or co64, stss) and gives per track: codec, timescale, duration, samples and the byte range of each
keyframe. write_media() makes such a file around a payload: one track of uncompressed units of UNIT bytes in chunks of
CHUNK units, of which every KEY-th is a keyframe; the same payload gives the same bytes.

Edge cases: null or empty text: one unit of zero bytes. Malformed files (boxes that overrun their parent, tables that
disagree, ranges outside the file): a description with error set and no tracks, never an exception. Equal texts have equal
values; repeated rows are described each for itself; null doc_id stays null; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_column

UNIT, CHUNK, KEY, TIMESCALE = 64, 8, 16, 8000
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_media(payload: bytes) -> bytes:
    """An ISO media file whose one track holds the payload, a multiple of UNIT bytes, as uncompressed 8-bit samples."""
    units = len(payload) // UNIT
    if units * UNIT != len(payload) or not units:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    length = units * UNIT
    chunks, left = divmod(units, CHUNK)
    runs = ([(1, CHUNK)] if chunks else []) + ([(chunks + 1, left)] if left else [])
    # One sound sample is one byte; an access unit groups UNIT of them.
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    keys = np.arange(1, units + 1, KEY, dtype=">u4")
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(0, length, UNIT * CHUNK, dtype=np.int64)
        wide = first + length >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, length, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), MATRIX, bytes(8), flags=7), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, length, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    at = len(head) + len(moov(0)) + 8
    return head + moov(at) + struct.pack(">I4s", 8 + length, b"mdat") + payload


class Malformed(ValueError):
    pass


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray  # indices of keyframes
    ranges: list[tuple[int, int]] = field(default_factory=list)


def walk(data: memoryview, start: int, end: int):
    """The boxes of data[start:end]: kind, begin and end of the body."""
    while start < end:
        if end - start < 8:
            raise Malformed("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed("a box is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise Malformed("a box overruns its parent")
        yield kind, start + head, start + size
        start += size


def tree(data: memoryview, start: int, end: int) -> list:
    return [(kind, a, b, tree(data, a, b) if kind in CONTAINERS else []) for kind, a, b in walk(data, start, end)]


def find(boxes: list, *path: bytes):
    for kind in path:
        hit = next((x for x in boxes if x[0] == kind), None)
        if hit is None:
            return None
        boxes = hit[3]
    return hit


def numbers(data: memoryview, a: int, b: int, kind: str, count: int) -> np.ndarray:
    if count * np.dtype(kind).itemsize > b - a:
        raise Malformed("a table overruns its box")
    return np.frombuffer(data, kind, count, a).astype(np.int64)


def table_of(data: memoryview, boxes: list, kind: bytes, columns: int) -> np.ndarray | None:
    """A table of 32-bit numbers that follows a count."""
    hit = find(boxes, kind)
    if hit is None:
        return None
    _, a, b, _ = hit
    if b - a < 8:
        raise Malformed("a table is cut off")
    n = struct.unpack_from(">I", data, a + 4)[0]
    return numbers(data, a + 8, b, ">u4", n * columns).reshape(n, columns)


def sample_sizes(data: memoryview, stbl: list, limit: int) -> np.ndarray:
    if hit := find(stbl, b"stsz"):
        _, a, b, _ = hit
        if b - a < 12:
            raise Malformed("stsz is cut off")
        size, n = struct.unpack_from(">II", data, a + 4)
        if size and size * n > limit:
            raise Malformed("samples exceed the file")
        return np.full(n, size, np.int64) if size else numbers(data, a + 12, b, ">u4", n)
    if hit := find(stbl, b"stz2"):
        _, a, b, _ = hit
        if b - a < 12:
            raise Malformed("stz2 is cut off")
        bits, n = struct.unpack_from(">3xBI", data, a + 4)
        if bits in (8, 16):
            return numbers(data, a + 12, b, f">u{bits // 8}", n)
        if bits == 4:
            pairs = numbers(data, a + 12, b, ">u1", (n + 1) // 2)
            return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
        raise Malformed("stz2 has an unknown width")
    raise Malformed("there are no sample sizes")


def read_track(data: memoryview, trak: list) -> Track:
    hit = find(trak, b"mdia", b"mdhd")
    stbl = find(trak, b"mdia", b"minf", b"stbl")
    if hit is None or stbl is None:
        raise Malformed("a track has no media header or sample table")
    a, stbl = hit[1], stbl[3]
    form, width = (">16xIQ", 32) if data[a : a + 1] == b"\1" else (">8xII", 20)
    if hit[2] - a < width:
        raise Malformed("mdhd is cut off")
    timescale, duration = struct.unpack_from(form, data, a + 4)
    stsd = find(stbl, b"stsd")
    if stsd is None or stsd[2] - stsd[1] < 16:
        raise Malformed("there is no sample description")
    codec = bytes(data[stsd[1] + 12 : stsd[1] + 16]).decode("latin-1")
    sizes = sample_sizes(data, stbl, len(data))
    n = len(sizes)
    if (wide := find(stbl, b"co64")) is not None:
        chunks = numbers(data, wide[1] + 8, wide[2], ">u8", struct.unpack_from(">I", data, wide[1] + 4)[0])
    else:
        found = table_of(data, stbl, b"stco", 1)
        if found is None:
            raise Malformed("there are no chunk offsets")
        chunks = found[:, 0]
    runs = table_of(data, stbl, b"stsc", 3)
    if n and (runs is None or not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks)):
        raise Malformed("sample-to-chunk disagrees with chunk offsets")
    if n:
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        if per.sum() != n:
            raise Malformed("chunks hold another number of samples")
        first = np.cumsum(per) - per
        inside = np.cumsum(sizes) - sizes
        offsets = np.repeat(chunks - inside[np.minimum(first, n - 1)], per) + inside
        if (offsets < 0).any() or (offsets + sizes > len(data)).any():
            raise Malformed("a sample lies outside the file")
    else:
        offsets = np.zeros(0, np.int64)
    times = table_of(data, stbl, b"stts", 2)
    if times is not None and n and times[:, 0].sum() != n:
        raise Malformed("stts holds another number of samples")
    if not duration and times is not None:
        duration = int((times[:, 0] * times[:, 1]).sum())
    sync = table_of(data, stbl, b"stss", 1)
    keys = np.arange(n) if sync is None else sync[:, 0] - 1
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise Malformed("a keyframe is no sample")
    return Track(codec, timescale, duration, offsets, sizes, keys, [(int(offsets[k]), int(offsets[k] + sizes[k])) for k in keys])


def read_media(data: bytes) -> list[Track]:
    """The tracks of a file; Malformed if its boxes or tables don't fit together."""
    view = memoryview(data)
    try:
        boxes = tree(view, 0, len(view))
        moov = find(boxes, b"moov")
        if moov is None:
            raise Malformed("there is no moov box")
        return [read_track(view, x[3]) for x in moov[3] if x[0] == b"trak"]
    except (struct.error, RecursionError) as e:
        raise Malformed(str(e)) from None


def samples_of(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples in order, copied range by range as the tables say."""
    out, k, ends = [], 0, track.offsets + track.sizes
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    for k, e in zip([0, *breaks], [*breaks, len(ends)], strict=True):
        if e > k:
            out.append(data[track.offsets[k] : ends[e - 1]])
    return b"".join(out)


def describe(tracks: list[Track]) -> str:
    return "|".join(f"codec={t.codec.strip()};timescale={t.timescale};duration={t.duration};samples={len(t.sizes)};keyframes=" + ",".join(f"{a}-{b}" for a, b in t.ranges) for t in tracks)


def media_columns(files: DataFrame, column: str = "content") -> DataFrame:
    """Adds media_error and media_tracks, an array of codec, timescale, duration, samples and keyframe byte ranges, to files of bytes."""
    kind = "array<struct<codec:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:array<struct<first:bigint,end:bigint>>>>"
    added = F.pandas_udf(_describe_series, f"struct<error:string,tracks:{kind}>")(F.col(column))
    return files.withColumn("_media", added).withColumns({"media_error": F.col("_media.error"), "media_tracks": F.col("_media.tracks")}).drop("_media")


def _describe_series(contents):
    import pandas as pd

    def one(data):
        if data is None:
            return {"error": "there is no file", "tracks": []}
        try:
            return {"error": None, "tracks": [{"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "keyframes": [{"first": a, "end": b} for a, b in t.ranges]} for t in read_media(data)]}
        except Malformed as e:
            return {"error": str(e), "tracks": []}

    return pd.DataFrame([one(x) for x in contents], columns=["error", "tracks"])




def digest_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text in batch.column(1):
        raw = text.as_buffer().to_pybytes()
        payload = raw + bytes(-len(raw) % UNIT if raw else UNIT)
        media = write_media(payload)
        tracks = read_media(media)
        back = samples_of(media, tracks[0])
        rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(tracks)))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), text_column().alias("text"))
    return map_batches(docs, digest_batch, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""Operator 2, media columns: ISO base media containers.

A container is a tree of boxes. `walk` descends through it, `parse` decodes the sample
tables of each track, and the runs of its fragments, and returns codec, duration and byte ranges of
the first video track, or of the first track if there is none; the payload itself is never decoded.

Edge cases: a null text counts as empty; an empty text gives one frame of 64 zero bytes; a
null, cut short or malformed container gives null features and a reason in `error`, and no count in
it makes the reader hold more than the container's own size allows; ties and repeated rows are
kept as they come; an empty table gives an empty table; the features replace columns of their
names, other columns are carried whatever they are called.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FRAME = 64  # bytes of one 8x8 grey frame of 8-bit samples
FRAMES_A_CHUNK = 16
KEY_EVERY = 16
TIMESCALE, TICKS_A_FRAME = 25_000, 1_000

#: Fixed values of the container format: boxes that hold boxes, and the bytes before their first child.
CONTAINERS = {b"moov": 0, b"trak": 0, b"edts": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"udta": 0, b"meta": 4, b"dref": 8, b"mvex": 0, b"moof": 0, b"traf": 0}
#: The unity matrix of a movie and of a track header.
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Malformed(ValueError):
    """The bytes are no well-formed container."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes with zeros up to a positive multiple of a frame; and their number without the zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % FRAME or (0 if raw else FRAME)), len(raw)


def encode(payload: bytes) -> bytes:
    """A grey raw video track whose frames are the payload's bytes, one 8-bit sample each."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError("the payload is no positive multiple of a frame")
    chunks, last = -(-frames // FRAMES_A_CHUNK), frames % FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK, 1)] if chunks > 1 or not last else []
    runs += [(chunks, last, 1)] if last else []
    duration = frames * TICKS_A_FRAME
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4").tobytes()

    def movie(offsets: np.ndarray) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, TICKS_A_FRAME)),
            full(b"stss", struct.pack(">I", len(keys) // 4), keys),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQI", 0, 0, TIMESCALE, duration, 0x55C40000), version=1),
            full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(16), UNITY, struct.pack(">II", 8 << 16, 8 << 16), version=1, flags=3)
        header = full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", header, box(b"trak", track, media))

    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    at = np.arange(chunks, dtype=np.int64) * FRAME * FRAMES_A_CHUNK
    data = box(b"mdat", payload)
    start = len(kind) + len(movie(at)) + len(data) - len(payload)
    return kind + movie(at + start) + data


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of each box, parents first. A size of 0 reaches to the parent's end, 1 means a 64-bit size."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Malformed("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed("a 64-bit box size is cut short")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        size = end - start if size == 0 else size
        if size < head or start + size > end:
            raise Malformed(f"box {kind!r} leaves its parent")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS and len(path) < 16:
            yield from walk(data, start + head + CONTAINERS[kind], start + size, (*path, kind))
        start += size


def table(data: memoryview, at: tuple[int, int], kind: str, skip: int = 4) -> np.ndarray:
    """The entries of a counted table, as a matrix of big-endian numbers `kind` wide."""
    start, end = at
    (count,) = struct.unpack_from(">I", data, start + skip)
    dtype = np.dtype(kind)
    if start + skip + 4 + count * dtype.itemsize > end:
        raise Malformed("a sample table is cut short")
    return np.frombuffer(data, dtype, count, start + skip + 4)


TABLES = (b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz", b"stco", b"co64", b"stss")
NEEDED = (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz")
#: Which optional fields the flags of a fragment's header, and of a run and its samples, announce, in their order.
HEADER_FIELDS = ((0x1, 8), (0x2, 4), (0x8, 4), (0x10, 4), (0x20, 4))
RUN_FIELDS, SAMPLE_FIELDS = (0x1, 0x4), (0x100, 0x200, 0x400, 0x800)
NOT_KEY = 0x10000


def parse(media: bytes) -> dict:
    """Codec, sizes, duration and sample byte ranges of the first video track, else of the first track."""
    data = memoryview(media)
    try:
        tracks: list[dict[bytes, tuple[int, int]]] = []
        defaults: dict[int, tuple[int, ...]] = {}
        fragments: list[tuple[int, bytes, int, int]] = []
        moof = 0
        for path, start, end in walk(data):
            if path == (b"moov", b"trak"):
                tracks.append({})
            elif path[:2] == (b"moov", b"trak") and path[-1] in TABLES and tracks:
                tracks[-1].setdefault(path[-1], (start, end))
            elif path == (b"moov", b"mvex", b"trex"):
                track, *rest = struct.unpack_from(">5I", data, start + 4)
                defaults[track] = tuple(rest[1:])
            elif path == (b"moof",):
                moof = start - 8
            elif path[:2] == (b"moof", b"traf") and path[-1] in (b"tfhd", b"trun"):
                fragments.append((moof, path[-1], start, end))
        whole = [t for t in tracks if all(k in t for k in NEEDED) and (b"stco" in t or b"co64" in t)]
        if not whole:
            raise Malformed("no sample table")
        chosen = next((t for t in whole if b"hdlr" in t and bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]) == b"vide"), whole[0])
        found = _track(data, chosen)
        if fragments:
            _add_fragments(data, found, fragments, defaults)
    except Malformed:
        raise
    except (struct.error, ValueError, IndexError, OverflowError, MemoryError) as e:
        raise Malformed(f"{type(e).__name__}: {e}") from e
    return found


def _track(data: memoryview, first: dict[bytes, tuple[int, int]]) -> dict:
    at = first[b"mdhd"][0]
    long = data[at] == 1
    timescale, duration = struct.unpack_from(">IQ" if long else ">II", data, at + (20 if long else 12))
    codec = bytes(data[first[b"stsd"][0] + 12 : first[b"stsd"][0] + 16]).decode("latin-1")
    video = b"hdlr" not in first or bytes(data[first[b"hdlr"][0] + 8 : first[b"hdlr"][0] + 12]) == b"vide"
    width, height = struct.unpack_from(">HH", data, first[b"stsd"][0] + 16 + 24) if video else (0, 0)
    track = 0
    if b"tkhd" in first:
        at = first[b"tkhd"][0]
        (track,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    size, frames = struct.unpack_from(">II", data, first[b"stsz"][0] + 4)
    if size and size * frames > len(data):
        raise Malformed("more samples than the file can hold")
    sizes = np.full(frames, size, np.int64) if size else table(data, first[b"stsz"], ">u4", 8).astype(np.int64)
    offsets = (table(data, first[b"co64"], ">u8") if b"co64" in first else table(data, first[b"stco"], ">u4")).astype(np.int64)
    runs = table(data, first[b"stsc"], ">u4,>u4,>u4")
    if frames and (not len(runs) or not len(offsets) or runs["f0"][0] != 1):
        raise Malformed("samples without chunks")
    reach = np.diff(np.append(runs["f0"].astype(np.int64), len(offsets) + 1))
    if (reach < 0).any() or int((reach * runs["f1"].astype(np.int64)).sum()) != frames:
        raise Malformed("chunks and samples disagree")
    a_chunk = np.repeat(runs["f1"].astype(np.int64), reach)
    if frames and len(a_chunk) != len(offsets):
        raise Malformed("chunks and samples disagree")
    start = np.zeros(0, np.int64)
    if frames:
        chunk = np.repeat(np.arange(len(offsets)), a_chunk)
        before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        firsts = np.cumsum(a_chunk) - a_chunk
        start = offsets[chunk] + before - before[np.minimum(firsts, frames - 1)][chunk]
        if (offsets < 0).any() or (start + sizes).max() > len(data):
            raise Malformed("a sample lies beyond the file")
    times = table(data, first[b"stts"], ">u4,>u4")
    ticks = int((times["f0"].astype(np.int64) * times["f1"].astype(np.int64)).sum())
    keys = table(data, first[b"stss"], ">u4").astype(np.int64) - 1 if b"stss" in first else np.arange(frames)
    if len(keys) and (keys.min() < 0 or keys.max() >= frames):
        raise Malformed("a keyframe is no sample")
    return {"codec": codec, "width": width, "height": height, "frames": int(frames), "timescale": timescale, "duration": duration, "ticks": ticks, "start": start, "size": sizes, "keys": keys, "track": track}


def _add_fragments(data: memoryview, found: dict, fragments: list[tuple[int, bytes, int, int]], defaults: dict[int, tuple[int, ...]]) -> None:
    """The samples of the track's runs, after those of its table."""
    starts, sizes, keys, ticks = [], [], [], 0
    mine, base, usual, after = False, 0, (0, 0, 0), 0
    for moof, kind, start, end in fragments:
        (flags,) = struct.unpack_from(">I", data, start)
        flags &= 0xFFFFFF
        at = start + 4
        if kind == b"tfhd":
            (track,) = struct.unpack_from(">I", data, at)
            mine = track == found["track"]
            at += 4
            fields = {}
            for flag, width in HEADER_FIELDS:
                if flags & flag:
                    (fields[flag],) = struct.unpack_from(">Q" if width == 8 else ">I", data, at)
                    at += width
            base = after = fields.get(0x1, moof)
            default = defaults.get(track, (0, 0, 0))
            usual = (fields.get(0x8, default[0]), fields.get(0x10, default[1]), fields.get(0x20, default[2]))
            continue
        if not mine:
            continue
        (n,) = struct.unpack_from(">I", data, at)
        at += 4
        head = {}
        for flag in RUN_FIELDS:
            if flags & flag:
                (head[flag],) = struct.unpack_from(">i" if flag == 0x1 else ">I", data, at)
                at += 4
        present = [f for f in SAMPLE_FIELDS if flags & f]
        if n * (4 * len(present) or usual[1] or len(data) + 1) > len(data) or at + n * 4 * len(present) > end:
            raise Malformed("a run is cut short")
        rows = np.frombuffer(data, ">u4", n * len(present), at).reshape(n, len(present)).astype(np.int64)
        column = lambda flag, otherwise: rows[:, present.index(flag)] if flag in present else np.full(n, otherwise, np.int64)  # noqa: E731, B023
        size, flag = column(0x200, usual[1]), column(0x400, usual[2])
        if 0x4 in head and n and 0x400 not in present:
            flag[0] = head[0x4]
        first = base + head[0x1] if 0x1 in head else after
        begin = first + np.concatenate(([0], np.cumsum(size)))[:-1]
        after = first + int(size.sum())
        if n and (first < 0 or after > len(data)):
            raise Malformed("a sample lies beyond the file")
        keys.append(np.flatnonzero(flag & NOT_KEY == 0) + found["frames"] + sum(map(len, starts)))
        starts.append(begin)
        sizes.append(size)
        ticks += int(column(0x100, usual[0]).sum())
    found["start"], found["size"], found["keys"] = (np.concatenate([found[k], *more]).astype(np.int64) for k, more in (("start", starts), ("size", sizes), ("keys", keys)))
    found["frames"] = len(found["start"])
    found["ticks"] += ticks
    found["duration"] = max(found["duration"], found["ticks"])


def samples(media: bytes, found: dict) -> bytes:
    """The samples' bytes in order, read by their ranges; neighbouring ranges are read at once."""
    start, size = found["start"], found["size"]
    if not len(start):
        return b""
    cut = np.flatnonzero(start[1:] != (start + size)[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(start)])) - 1
    data = memoryview(media)
    return b"".join(data[a:b] for a, b in zip(start[first].tolist(), (start + size)[last].tolist(), strict=True))


SCHEMA = "codec string, width int, height int, frames long, duration_s double, keyframes array<struct<offset: long, length: long>>, error string"


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """`df` with the columns of SCHEMA, from the containers in its binary column `media`."""
    own = [f"c{i}" for i in range(len(df.columns))]  # so that no name of `df` clashes
    at = df.columns.index(media)
    plain = df.toDF(*own)
    added = T._parse_datatype_string(SCHEMA)
    kinds = to_arrow_schema(added)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_features(x) for x in b.column(at).to_pylist()]
            new = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)]
            yield pa.record_batch([*b.columns, *new], [*own, *(f"m{i}" for i in range(len(new)))])

    found = plain.mapInArrow(read, T.StructType([*plain.schema.fields, *(T.StructField(f"m{i}", f.dataType) for i, f in enumerate(added))]))
    names = {f.name for f in added}
    return found.select(*[F.col(c).alias(n) for c, n in zip(own, df.columns, strict=True) if n.lower() not in names], *[F.col(f"m{i}").alias(f.name) for i, f in enumerate(added)])


def _features(data: bytes | None) -> tuple:
    try:
        if data is None:
            raise Malformed("null")
        x = parse(bytes(data))
    except Malformed as e:
        return None, None, None, None, None, None, str(e)
    return x["codec"], x["width"], x["height"], x["frames"], x["duration"] / max(x["timescale"], 1), [{"offset": int(x["start"][k]), "length": int(x["size"][k])} for k in x["keys"]], None


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media binary, n_bytes long): each whole text's payload in a container."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [payload_of(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([encode(p) for p, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int64())], ["doc_id", "media", "n_bytes"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(store, "doc_id long, media binary, n_bytes long")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_keyframes long"


def digest(stored: DataFrame) -> DataFrame:
    """What `store_texts` made, read back by its sample tables, as digests and features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, media, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = parse(media)
                data = samples(media, x)
                ranges = np.stack([x["start"][x["keys"]], x["size"][x["keys"]]], axis=1).astype("<i8")
                feature = f"{x['codec'].strip()} {x['width']}x{x['height']} frames={x['frames']} ticks={x['ticks']}/{x['timescale']} keys={len(ranges)} ranges={zlib.crc32(ranges.tobytes()):08x} sum={int(np.frombuffer(data, np.uint8).sum(dtype=np.int64))}"
                rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature, x["codec"], x["duration"] / x["timescale"], len(ranges)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            names = [c.split()[0] for c in DIGEST.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

    return stored.mapInArrow(read, DIGEST)

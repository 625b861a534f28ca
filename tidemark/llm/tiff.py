"""TIFF pages as rows.

``read_pages`` walks the chain of image directories of each file, decodes
strips or tiles (stored, PackBits, LZW, deflate), undoes the horizontal
predictor and emits one row per page.  ``write_gray`` makes the one-page files
that the round trip needs.  Both work file by file inside tasks; nothing is
shuffled and no file depends on another.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import small_batches

# Fixed values of the TIFF 6.0 format: tags, field sizes, compression codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


# ------------------------------------------------------------------ codecs
def packbits_encode_rows(rows: np.ndarray) -> bytes:
    """PackBits, each row on its own as the format asks."""
    n, width = rows.shape
    runs = np.zeros(n, bool)
    if width > 2:
        runs = ((rows[:, :-2] == rows[:, 1:-1]) & (rows[:, 1:-1] == rows[:, 2:])).any(axis=1)
    out = []
    plain = np.flatnonzero(~runs)
    if width <= 128 and len(plain):  # whole rows are one literal each
        packed = np.empty((n, width + 1), np.uint8)
        packed[:, 0], packed[:, 1:] = width - 1, rows
        for i in range(n):
            out.append(_packbits_row(rows[i].tobytes()) if runs[i] else packed[i].tobytes())
    else:
        out = [_packbits_row(r.tobytes()) for r in rows]
    return b"".join(out)


def _packbits_row(row: bytes) -> bytes:
    out, i, literal, n = bytearray(), 0, 0, len(row)

    def flush(upto: int) -> None:
        nonlocal literal
        while literal < upto:
            part = row[literal : min(upto, literal + 128)]
            out.append(len(part) - 1)
            out.extend(part)
            literal += len(part)

    while i < n:
        j = i + 1
        while j < n and j - i < 128 and row[j] == row[i]:
            j += 1
        if j - i >= 3:
            flush(i)
            out.append(257 - (j - i))
            out.append(row[i])
            literal = j
        i = j
    flush(n)
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes widen one entry early."""
    codes, widths = [256], [9]
    table: dict[int, int] = {}
    free, width, prefix = 258, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        longer = prefix << 8 | byte
        code = table.get(longer)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        widths.append(width)
        table[longer] = free
        free += 1
        if free == 4094:
            codes.append(256)
            widths.append(width)
            table, free, width = {}, 258, 9
        elif free + 1 > 1 << width:
            width += 1
        prefix = byte
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    return _pack_codes(np.array(codes, np.int64), np.array(widths, np.int64))


def _pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = (codes[:, None] >> (widths[:, None] - 1 - np.arange(12))) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out, made = list(singles), 9, [], 0
    held = bits = 0
    last = b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or made >= size:
            break
        if code == 256:
            table, width, last = list(singles), 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError(f"LZW code {code} of {len(table)}")
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(entry)
        made += len(entry)
        last = entry
    return b"".join(out)[:size]


def decode_segment(data: bytes, compression: int, size: int) -> bytes:
    if compression == STORED:
        out = data[:size]
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < size:
        raise ValueError(f"a segment holds {len(out)} of {size} bytes")
    return out


#: Bytes of a page that one byte of a file can make, by compression, and of the largest page that fits a column.
MOST = {STORED: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
LARGEST = 2**31 - 2


# ------------------------------------------------------------------ reading
def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The tags of each page, in file order."""
    if data[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF byte order")
    e = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(f"{e}HI", data, 2)
    if magic != 42:
        raise ValueError("no TIFF magic number")
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (count,) = struct.unpack_from(f"{e}H", data, at)
        tags = {"order": e}
        for k in range(count):
            tag, kind, n = struct.unpack_from(f"{e}HHI", data, at + 2 + 12 * k)
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            if letter:  # the tags used here are whole numbers
                where = at + 10 + 12 * k
                if n * FIELD_SIZE[kind] > 4:
                    (where,) = struct.unpack_from(f"{e}I", data, where)
                tags[tag] = list(struct.unpack_from(f"{e}{n}{letter}", data, where))
        yield tags
        (at,) = struct.unpack_from(f"{e}I", data, at + 2 + 12 * count)


def decode_page(data: bytes, tags: dict) -> tuple[dict, np.ndarray]:
    """(facts, samples): samples are rows x columns x samples per pixel."""
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, length, bits = one(WIDTH), one(LENGTH), one(BITS, 1)
    samples, compression, predictor = one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    planar = one(PLANAR, 1) if samples > 1 else 1
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits per sample")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    kind = np.dtype(np.uint8 if bits == 8 else f"{tags['order']}u2")
    tiled = TILE_OFFSETS in tags
    if tiled:
        sw, sl, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        sw, sl = width, min(one(ROWS_PER_STRIP, length) or 0, length or 0)
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if not all(isinstance(x, int) and x > 0 for x in (width, length, samples, sw, sl)):
        raise ValueError("a width, length, strip or tile of no samples")
    across, down = -(-width // sw), -(-length // sl)
    if tiled and sw * sl > 4 * max(width, 64) * max(length, 64):
        raise ValueError(f"tiles of {sw} x {sl} for a page of {width} x {length}")
    depth, planes = (samples, 1) if planar == 1 else (1, samples)
    size = length * width * samples * kind.itemsize
    if size > min(LARGEST, (len(data) + 64) * MOST.get(compression, 1)):
        raise ValueError(f"a page of {size} bytes in a file of {len(data)}")
    if len(offsets) != across * down * planes:
        raise ValueError(f"{len(offsets)} segments of {across * down * planes}")
    out = np.zeros((length, width, samples), kind.newbyteorder("="))
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = (place // across) * sl, (place % across) * sw
        rows = sl if tiled else min(sl, length - y)
        raw = decode_segment(data[at : at + n], compression, rows * sw * depth * kind.itemsize)
        part = np.frombuffer(raw, kind).reshape(rows, sw, depth).astype(kind.newbyteorder("="))
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        high, wide = min(rows, length - y), min(sw, width - x)
        target = slice(None) if planar == 1 else slice(plane, plane + 1)
        out[y : y + high, x : x + wide, target] = part[:high, :wide]
    facts = {"width": width, "height": length, "bits": bits, "samples": samples, "compression": compression,
             "predictor": predictor, "layout": "tiles" if tiled else "strips"}
    return facts, out


PAGE_FIELDS = [("page", "int"), ("width", "int"), ("height", "int"), ("bits", "int"), ("samples", "int"),
               ("compression", "int"), ("predictor", "int"), ("layout", "string"), ("pixels", "binary"), ("error", "string")]


def read_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the other columns of ``files`` and PAGE_FIELDS.

    A file that can't be read (null, empty, cut short, unknown compression, sizes of
    zero or beyond what its bytes can hold) gives one row with ``error`` set and null pixels after its good pages, so
    no file vanishes.  Input columns named like a page field are left out.
    Pixels are rows of samples, 16-bit ones little-endian.
    """
    fields = [name for name, _ in PAGE_FIELDS]
    keep = [c for c in files.columns if c != media and c not in fields]
    schema = T.StructType([*(files.schema[c] for c in keep), *T.StructType.fromDDL(
        ", ".join(f"{a} {b}" for a, b in PAGE_FIELDS)).fields])

    def pages(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows, found, held = [], [], 0
            for i in range(batch.num_rows):
                data = batch.column(batch.schema.get_field_index(media))[i].as_py() or b""
                page = 0
                try:
                    for tags in directories(data):
                        facts, samples = decode_page(data, tags)
                        pixels = samples.astype(f"<u{samples.itemsize}", copy=False).tobytes()
                        found.append(facts | {"page": page, "pixels": pixels, "error": None})
                        rows.append(i)
                        held += len(pixels)
                        page += 1
                except (ValueError, KeyError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error, IndexError) as e:
                    found.append({"page": page, "error": f"{type(e).__name__}: {e}"[:200]})
                    rows.append(i)
                if held > 1 << 24:
                    yield _page_batch(batch, keep, rows, found, arrow)
                    rows, found, held = [], [], 0
            if rows:
                yield _page_batch(batch, keep, rows, found, arrow)

    return files.mapInArrow(pages, schema)


def _page_batch(batch, keep, rows, found, arrow):
    taken = pa.array(rows, pa.int64())
    columns = [batch.column(batch.schema.get_field_index(c)).take(taken) for c in keep]
    for field in list(arrow)[len(keep):]:
        columns.append(pa.array([f.get(field.name) for f in found], field.type))
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


# ------------------------------------------------------------------ writing
def write_gray(rows: np.ndarray, compression: int, predictor: int = 1, tile: int = 0, rows_per_strip: int = 128) -> bytes:
    """A one-page little-endian file of 8-bit samples, in strips or square tiles."""
    length, width = rows.shape
    if tile:
        parts = []
        for y in range(0, length, tile):
            for x in range(0, width, tile):
                part = np.zeros((tile, tile), np.uint8)
                cut = rows[y : y + tile, x : x + tile]
                part[: cut.shape[0], : cut.shape[1]] = cut
                parts.append(part)
    else:
        parts = [rows[y : y + rows_per_strip] for y in range(0, length, rows_per_strip)]
    segments = []
    for part in parts:
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=np.uint8(0))
        if compression == PACKBITS:
            segments.append(packbits_encode_rows(part))
        elif compression == LZW:
            segments.append(lzw_encode(part.tobytes()))
        elif compression == DEFLATE:
            segments.append(zlib.compress(part.tobytes(), 1))
        else:
            segments.append(part.tobytes())
    counts = [len(s) for s in segments]
    offsets = np.cumsum([8, *counts])[:-1].tolist()
    at = 8 + sum(counts)
    pad = at % 2
    tags = {WIDTH: [width], LENGTH: [length], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
    tags |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {
        STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows_per_strip], STRIP_COUNTS: counts}
    directory, beyond = struct.pack("<H", len(tags)), b""
    after = at + pad + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        values = tags[tag]
        directory += struct.pack("<HHI", tag, 4, len(values))
        if len(values) == 1:
            directory += struct.pack("<I", values[0])
        else:
            directory += struct.pack("<I", after + len(beyond))
            beyond += struct.pack(f"<{len(values)}I", *values)
    return b"".join([b"II", struct.pack("<HI", 42, at + pad), *segments, b"\0" * pad, directory, b"\0\0\0\0", beyond])


#: (compression, predictor, tile) of the stored form; the payload's CRC picks one.
FORMS = [(PACKBITS, 1, 0), (LZW, 1, 0), (DEFLATE, 2, 64)]


def store_payload(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as a page 64 samples wide."""
    compression, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write_gray(np.frombuffer(payload, np.uint8).reshape(-1, 64), compression, predictor, tile)


def texts_to_tiff(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text, zero-padded, as a TIFF file.

    Null and empty texts become 64 zero bytes.  Equal texts give equal files.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def store(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            lo, lengths, files, held = 0, [], [], 0
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                files.append(store_payload(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))))
                lengths.append(len(raw))
                held += len(files[-1])
                if held > 1 << 24 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(lo, i + 1 - lo), pa.array(lengths, pa.int64()), pa.array(files, pa.binary())],
                        [key, "n_bytes", "media"])
                    lo, lengths, files, held = i + 1, [], [], 0

    return docs.select(key, text).mapInArrow(store, schema)


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = texts_to_tiff(docs).withColumns({
        "media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    page = read_pages(files)
    feature = F.format_string("page=%d;%dx%d;bits=%d;compression=%d;predictor=%d;%s", "page", "width", "height",
                              "bits", "compression", "predictor", "layout")
    return page.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        "media_bytes", "media_sha256", F.coalesce(feature, "error").alias("feature"))

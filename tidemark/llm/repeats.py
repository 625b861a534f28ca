"""Suffix-array dedup by bucket-pointer refinement.

Suffixes are refined only as far as the contract needs: until it is known
whether a string of ``length`` bytes also starts in an earlier document.

1. Every place of a text has the identifier of its q-gram; two identifiers at
   later offsets make that of a longer string, two of those that of a longer
   one still (``Unit.window``, ``Unit.region``, ``Unit.core``).  No text is
   compared again.
2. Initial buckets.  A suffix enters by its anchor, the least-hashed q-gram of
   the window of ``length`` bytes that it starts with.  Equal windows have equal
   anchors, so the windows that share an anchor are one entry.
3. Each level sorts the entries on two identifiers: the core, which all windows
   of the entry hold, and the whole.  A core of one document only settles its
   entry, which repeats nothing.  A whole that an earlier document has too
   settles it as a repeat.  What is left is split, a narrower range of windows has a longer
   core, and the sub-buckets go to the next level: whole anchors, groups of
   windows, single windows.

Documents are packed into units, rows of a written table.  A unit settles what
its own documents settle, and sends each identifier once, with its least
document, so a passage of a third of all documents gives one entry a unit.  Entries
travel as sorted columns, cut into ``part`` by their first bits; a part's size
does not depend on the corpus.  The answer to an entry is one bit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.scratch import Scratch, small_batches
from tidemark.llm.text import byte_chunks, byte_planes, from_planes, mix64, powers, prefix_hash, text_or_empty

NO_KEY = 2**63 - 1
#: Bytes of text of a unit, bytes that are hashed together, and bytes of text whose entries make a part.
UNIT, CHUNK, PART = 1 << 22, 1 << 19, 1 << 24
CORE, WHOLE, STATE = 0, 1, 2
#: Cores go by their first 48 bits: a chance meeting only refines an entry in vain.
CORE_BITS = np.uint64(16)
#: Low bits of a window's key that hold the place; a text has fewer bytes than this.
PLACE = np.uint64(31)
LEVELS = 3
_A, _B, _C = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xDB4F0B9175AE2165))
_BLOCK = "part int, kind int, unit long, n int, body binary"
_REPLY = "unit long, part int, kind int, n int, bits binary"


def _join(one, two):
    """The identifier of a string, in two independent halves, from those of its ends."""
    return mix64(one[0] * _A + two[0]), mix64(one[1] * _B + two[1] + _C)


def _anchors(grams: np.ndarray, offsets: np.ndarray, length: int, n: int):
    """(place, first window, last window) of the anchors of a slice of ``n`` bytes."""
    width = length - (length // 2 + 1) + 1
    low = grams >> PLACE << PLACE | np.arange(len(grams), dtype=np.uint64)
    least, span = low, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    inside = np.zeros(n + 1, np.int8)
    long_enough = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long_enough], 1)
    np.add.at(inside, offsets[1:][long_enough] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8))
    place = (least[window] & np.uint64((1 << 31) - 1)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (np.diff(window) != 1)
    at = np.flatnonzero(new)
    return place[at], window[at], window[np.append(at[1:], len(window)) - 1]


class Entries:
    """Ranges of windows that share an anchor, with their documents and identifiers."""

    def __init__(self, doc, place, first, last, core, whole):
        self.doc, self.place, self.first, self.last = doc, place, first, last
        self.core = core >> CORE_BITS << CORE_BITS if core is not None else None
        self.whole, self.more = whole[0], (whole[1] >> np.uint64(32)).astype(np.uint32)

    def cores(self):
        """(distinct cores, number of each entry's core, whether documents of this unit share it)."""
        order = np.argsort(self.core)
        core, doc = self.core[order], self.doc[order]
        new = np.append(True, core[1:] != core[:-1])[: len(core)]
        at = np.flatnonzero(new)
        number = np.empty(len(core), np.int64)
        number[order] = np.cumsum(new) - 1
        shared = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        return core[at], number, shared

    def wholes(self):
        """(ids, ids' other half, least documents) of the distinct wholes, and the number of each entry's."""
        order, new, least = _grouped(self.whole, self.more, self.doc)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return self.whole[order][new], self.more[order][new], least, number


def _grouped(ids: np.ndarray, more: np.ndarray, doc: np.ndarray):
    """(order by identifier, which places of it are the first of their identifier, least document of each)."""
    order = np.argsort(ids)
    one, two = ids[order], more[order]
    same = one[1:] == one[:-1]
    if (two[1:][same] != two[:-1][same]).any():  # the first halves agree by chance
        order = np.lexsort((more, ids))
        one, two = ids[order], more[order]
        same = one[1:] == one[:-1]
    new = np.append(True, ~same | (two[1:] != two[:-1]))[: len(order)]
    return order, new, np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc


class Unit:
    """The texts of one unit: identifiers of all their q-grams, and what is known of their windows.

    ``ranges`` (place of the anchor, first and last window) are the entries that are not settled yet, and ``removed``
    the windows settled as repeats; both start from the anchors, or from the ``state`` that a level before left.
    """

    def __init__(self, texts: pa.Array, docs: np.ndarray, length: int, state: bytes | None = None):
        self.length, self.q = length, length // 2 + 1
        self.width = length - self.q + 1
        self.group = max(1, math.isqrt(self.width))
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        self.docs, chunks, at = docs, list(byte_chunks(texts, CHUNK)), 0
        self.grams = np.zeros(sum(len(data) for *_, data, _ in chunks), np.uint64)
        self.data = np.zeros(len(self.grams), np.uint8)
        found = []
        for lo, hi, data, offsets in chunks:
            n = len(data)
            self.data[at : at + n] = data
            self.offsets[lo + 1 : hi + 1] = offsets[1:] + at
            if n >= length and (np.diff(offsets) >= length).any():
                prefix = prefix_hash(data)
                _, down = powers(n + 1)
                grams = mix64((prefix[self.q :] - prefix[: -self.q]) * down[: n - self.q + 1])
                self.grams[at : at + len(grams)] = grams
                if state is None:
                    found.append(tuple(x + at for x in _anchors(grams, offsets, length, n)))
            at += n
        none = (np.zeros(0, np.int64),) * 3
        self.ranges = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none
        self.removed = none[:2]
        if state is not None:
            self._restore(state)

    def _pair(self, start, size: int):
        """The identifier of a string of ``size`` bytes, from the q-grams at its start and at its end."""
        one, two = self.grams[start], self.grams[start + size - self.q]
        return _join((one, one), (two, two))

    def window(self, start):
        return self._pair(start, self.length)

    def region(self, first, last):
        """The identifier of the bytes of overlapping windows."""
        return _join(self.window(first), self.window(last))

    def core(self, start, number):
        """The bytes that all windows of one group hold, and the group's number."""
        return mix64(self._pair(start, self.length - self.group + 1)[0] + number.astype(np.uint64) * _C)

    def _doc(self, start):
        return self.docs[np.searchsorted(self.offsets, start, "right") - 1]

    def state(self) -> bytes:
        """What is known so far: removed windows as runs, and the ranges left, as differences."""
        first, last = self.removed
        place, low, high = self.ranges
        order = np.argsort(first)
        numbers = np.concatenate([[len(first), len(place)], np.diff(first[order], prepend=0), (last - first)[order], np.diff(place, prepend=0), place - low, place - high])
        return byte_planes(numbers)

    def _restore(self, state: bytes) -> None:
        numbers = from_planes(state, np.int64, len(state) // 8)
        n, m = numbers[:2]
        cuts = np.cumsum([2, n, n, m, m])
        first, size, place, low, high = np.split(numbers, cuts)[1:]
        first, place = np.cumsum(first), np.cumsum(place)
        self.removed, self.ranges = (first, first + size), (place, place - low, place - high)

    def entries(self, level: int) -> Entries:
        """The entries of a level from the ranges that are left."""
        place, first, last = self.ranges
        if level == 0:
            return Entries(self._doc(first), place, first, last, self.grams[place], self.region(first, last))
        if level == 1:
            lo, hi = (place - last) // self.group, (place - first) // self.group
            count = hi - lo + 1
            owner = np.repeat(np.arange(len(place)), count)
            number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[owner]
            place = place[owner]
            low = np.maximum(first[owner], place - (number + 1) * self.group + 1)
            high = np.minimum(last[owner], place - number * self.group)
            return Entries(self._doc(low), place, low, high, self.core(place - number * self.group, number), self.region(low, high))
        count = last - first + 1
        owner = np.repeat(np.arange(len(place)), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        return Entries(self._doc(start), place[owner], start, start, None, self.window(start))

    def settle(self, level: int, bits: dict[int, np.ndarray]) -> None:
        """Keep the ranges that a level leaves, given its answers, and note what it settles as repeats."""
        entries = self.entries(level)
        _, _, least, number = entries.wholes()
        repeats = bits[WHOLE][number] | (entries.doc > least[number])
        self.removed = tuple(np.append(x, y[repeats]) for x, y in zip(self.removed, (entries.first, entries.last), strict=True))
        left = ~repeats
        if entries.core is not None:
            _, number, shared = entries.cores()
            left &= bits[CORE][number] | shared[number]
        self.ranges = entries.place[left], entries.first[left], entries.last[left]

    def cut(self):
        """(bytes, bytes removed, runs, kept bytes' offsets, kept bytes) of all texts."""
        self.grams = None  # the largest part of a unit, and not needed any more
        n = len(self.data)
        edge = np.zeros(n + 1, np.int32)
        first, last = self.removed
        np.add.at(edge, first, 1)
        np.add.at(edge, last + self.length, -1)
        gone = np.cumsum(edge[:n], dtype=np.int32) > 0
        start = gone.copy()
        start[1:] &= ~gone[:-1]
        borders = self.offsets[1:-1]
        borders = borders[(borders > 0) & (borders < n)]
        start[borders] |= gone[borders]
        # Places of bytes that go, and of those that start a run, are counted text by text.
        upto = lambda flags: np.searchsorted(np.flatnonzero(flags), self.offsets)
        removed = upto(gone)
        return np.diff(self.offsets), np.diff(removed), np.diff(upto(start)), self.offsets - removed, self.data[~gone]


def _part_of(ids: np.ndarray, part_bits: int) -> np.ndarray:
    return (ids >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(ids), np.int64)


def _blocks(kind: int, part_bits: int, ids: np.ndarray, *more: np.ndarray):
    """(part, kind, n, body) for the parts of sorted identifiers."""
    part = _part_of(ids, part_bits)
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(ids) else np.zeros(0, np.int64)
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=False):
        steps = np.diff(ids[lo:hi], prepend=np.uint64(0))
        yield int(part[lo]), kind, hi - lo, byte_planes(steps) + b"".join(byte_planes(x[lo:hi]) for x in more)


def _pack(docs: DataFrame, text: str) -> DataFrame:
    """(unit, n_bytes, payload): rows of ``docs`` as Arrow streams of about ``UNIT`` bytes of text."""
    where = docs.columns.index(text)

    def run(batches):
        unit, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                              ["unit", "n_bytes", "payload"])

        for batch in batches:
            for lo, hi, data, _ in byte_chunks(batch.column(where), CHUNK):
                if held and size + len(data) > UNIT:
                    yield flush()
                    unit, held, size = unit + 1, [], 0
                held.append(batch.slice(lo, hi - lo))
                size += len(data)
        if held:
            yield flush()

    return docs.mapInArrow(run, "unit long, n_bytes long, payload binary")


def _open(batches, where: int, length: int):
    """(number, rows, Unit, answers of the last level by kind) of every unit of (unit, payload, state, replies)."""
    for batch in batches:
        for i in range(batch.num_rows):
            with pa.ipc.open_stream(batch.column(1)[i].as_buffer()) as stream:
                rows = stream.read_all().combine_chunks()
            answers: dict[int, list] = {CORE: [], WHOLE: []}
            for r in sorted(batch.column(3)[i].as_py() or [], key=lambda r: r["part"]):
                answers[r["kind"]].append(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"], bitorder="little").astype(bool))
            replies = {kind: np.concatenate([np.zeros(0, bool), *x]) for kind, x in answers.items()}
            order = rows.column(rows.num_columns - 1).to_numpy()
            yield batch.column(0)[i].as_py(), rows, Unit(rows.column(where), order, length, batch.column(2)[i].as_py()), replies


def _ask(units: DataFrame, where: int, length: int, level: int, part_bits: int) -> DataFrame:
    """The entries of a level, as blocks of sorted identifiers, and from the second level on the units' states."""
    def run(batches):
        for number, _, unit, replies in _open(batches, where, length):
            if level:
                unit.settle(level - 1, replies)
            entries = unit.entries(level)
            ids, more, least, _ = entries.wholes()
            rows = list(_blocks(WHOLE, part_bits, ids, more, least))
            if entries.core is not None:
                rows += _blocks(CORE, part_bits, entries.cores()[0])
            if level:
                rows.append((0, STATE, 0, unit.state()))
            part, kind, n, body = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array([number] * len(part), pa.int64()),
                                              pa.array(n, pa.int32()), pa.array(body, pa.binary())], ["part", "kind", "unit", "n", "body"])

    return units.mapInArrow(run, _BLOCK)


def _answers(kind: int, sizes: list[int], bodies: list) -> np.ndarray:
    """A flag per entry of the blocks of one part: shared core, or whole of an earlier document."""
    ids = np.concatenate([np.cumsum(from_planes(b, np.uint64, n), dtype=np.uint64) for n, b in zip(sizes, bodies, strict=True)])
    flags = np.zeros(len(ids), bool)
    if kind == CORE:
        order = np.argsort(ids)
        same = ids[order][1:] == ids[order][:-1]
        flags[order[1:][same]] = flags[order[:-1][same]] = True
        return flags
    more = np.concatenate([from_planes(b[8 * n :], np.uint32, n) for n, b in zip(sizes, bodies, strict=True)])
    doc = np.concatenate([from_planes(b[12 * n :], np.int64, n) for n, b in zip(sizes, bodies, strict=True)])
    order, new, least = _grouped(ids, more, doc)
    flags[order] = doc[order] > least[np.cumsum(new) - 1]
    return flags


def _sort_out(blocks: DataFrame) -> DataFrame:
    """Sort each part's entries of all units and answer them, a bit each."""
    def answer(part, kind, rows):
        units, sizes, bodies = zip(*rows, strict=True)
        flags = np.split(_answers(kind, list(sizes), list(bodies)), np.cumsum(sizes)[:-1])
        bits = [np.packbits(f, bitorder="little").tobytes() for f in flags]
        return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array([part] * len(units), pa.int32()), pa.array([kind] * len(units), pa.int32()),
                                           pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], ["unit", "part", "kind", "n", "bits"])

    def run(batches):
        held, rows = None, []
        for batch in batches:
            parts, kinds, units, sizes = (batch.column(i).to_pylist() for i in range(4))
            for i, key in enumerate(zip(parts, kinds, strict=True)):
                if key != held and rows:
                    yield answer(*held, rows)
                    rows = []
                held = key
                rows.append((units[i], sizes[i], batch.column(4)[i].as_py()))
        if rows:
            yield answer(*held, rows)

    return blocks.select("part", "kind", "unit", "n", "body").repartition("part", "kind").sortWithinPartitions("part", "kind").mapInArrow(run, _REPLY)


def remove_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut every byte covered by a ``length``-byte string that also starts in an earlier document.

    Adds ``__n_bytes``, ``__n_removed``, ``__n_spans`` and ``__kept`` (binary)
    to the columns of ``docs``.  Earlier means a smaller key, a whole number; rows of equal key
    do not cut one another, and null keys come last and do not either.  Null
    and empty texts and those under ``length`` bytes lose nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    names, where = docs.columns, docs.columns.index(text)
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"the key {key} orders documents and must be a whole number")
    order = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    units = scratch.table(_pack(docs.select(*names, order.alias("__order")), text), "units",
                          **{"parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 25)})
    total = units.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    part_bits = max(0, math.ceil(math.log2(max(1, total) / PART)))
    state, replies = None, None

    def informed() -> DataFrame:
        """Units with what the level before knows of them."""
        if replies is None:
            return units.select("unit", "payload", F.lit(None).cast("binary").alias("state"), F.lit(None).cast(f"array<struct<{_REPLY}>>").alias("replies"))
        told = replies.groupBy("unit").agg(F.collect_list(F.struct("part", "kind", "n", "bits")).alias("replies"))
        if state is not None:
            told = told.join(state, "unit", "full")
        told = told.select("unit", state["state"] if state is not None else F.lit(None).cast("binary").alias("state"), "replies")
        return units.select("unit", "payload").join(told.hint("shuffle_hash"), "unit", "left").select("unit", "payload", "state", "replies")

    for level in range(LEVELS):
        asked = _ask(informed(), where, length, level, part_bits)
        if level:
            asked = scratch.table(asked, f"asked{level}", ("kind",))
            known = asked.where(F.col("kind") == STATE).select("unit", F.col("body").alias("state"))
            asked = asked.where(F.col("kind") != STATE)
        replies = scratch.table(_sort_out(asked), f"level{level}")
        state = known if level else None
    scratch.release()
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("__n_bytes long, __n_removed long, __n_spans long, __kept binary").fields])

    def cut(batches):
        arrow = to_arrow_schema(schema)
        for _, rows, unit, answers in _open(batches, where, length):
            unit.settle(LEVELS - 1, answers)
            n_bytes, removed, runs, offsets, kept = unit.cut()
            del unit
            # Long texts make large batches, so the rows go in slices.
            for lo, hi, *_ in byte_chunks(rows.column(where), 1 << 22):
                own = offsets[lo : hi + 1] - offsets[lo]
                column = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(own.astype(np.int32)), pa.py_buffer(kept[offsets[lo] : offsets[hi]])])
                part = rows.slice(lo, hi - lo).combine_chunks()
                given = [c.combine_chunks().cast(f.type) for c, f in zip(part.columns[: len(names)], list(arrow), strict=False)]
                yield pa.RecordBatch.from_arrays([*given, *(pa.array(x[lo:hi]) for x in (n_bytes, removed, runs)), column], schema=arrow)

    return informed().mapInArrow(cut, schema)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"),
        F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))

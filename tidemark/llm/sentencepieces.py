"""SentencePiece encoding, N-best segmentation and decoding.

Forward Viterbi scores V give every arc i -> j with piece score s the reduced
cost V[j] - (V[i] + s), which is what a backward A-star search with the exact
heuristic V pays beyond the best path.  The best path costs 0, and the N best
are the N cheapest.  Whole texts are cut where no piece of the vocabulary can
cross (before a word mark, around a line end), so a text's lattice is a chain
of small ones: Viterbi runs for all distinct segments of a slice together, the
A-star search only in those segments whose second-best path can still be among
the N best of the text.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import pieces
from tidemark.llm.pieces import SEGMENT, Vocabulary
from tidemark.llm.scratch import small_batches
from tidemark.llm.text import byte_chunks

#: Bytes of text whose distinct segments are treated together.
SLICE = 1 << 22


#: Segmentations of a text that the query asks for.
N_BEST = 8

#: A segment of more bytes than this is taken place by place, in memory of a few numbers a byte.
LONG = 1 << 14


def _long(vocabulary: Vocabulary, string: bytes) -> tuple[float, float, np.ndarray]:
    """(score, cost of the second segmentation, piece rows) of one long segment."""
    n, get, prior = len(string), vocabulary.by_string.get, vocabulary.scores
    best, slack = np.full(n + 1, -np.inf), np.full(n + 1, np.inf)
    back, took = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    best[0] = 0
    window = [0.0]  # the best scores of the last places, oldest first
    for end in range(1, n + 1):
        top, second, at, row = -math.inf, -math.inf, 0, -1
        for k in range(min(end, vocabulary.longest)):
            found = get(string[end - 1 - k : end])
            if found is None and not k:
                found = int(vocabulary.byte_row[string[end - 1]])
            if found is not None:
                value = window[-1 - k] + prior[found]
                if value > top:
                    top, second, at, row = value, top, k, found
                elif value > second:
                    second = value
        best[end], back[end], took[end], slack[end] = top, at, row, top - second
        window.append(top)
        if len(window) > 2 * vocabulary.longest:
            del window[: vocabulary.longest]
    rows, cheapest, end = [], math.inf, n
    while end:
        rows.append(took[end])
        cheapest = min(cheapest, slack[end])
        end -= 1 + int(back[end])
    return float(best[n]), float(cheapest), np.array(rows[::-1], np.int32)


class Segments:
    """Viterbi results of many segments: score, second cost and piece rows of each."""

    def __init__(self, vocabulary: Vocabulary, strings: list[bytes]):
        n = len(strings)
        self.score, self.second = np.zeros(n), np.full(n, np.inf)
        lengths, paths = np.zeros(n, np.int64), []
        weights = np.append(vocabulary.prior, -np.inf)
        for i in [i for i, s in enumerate(strings) if len(s) > LONG]:
            self.score[i], self.second[i], rows = _long(vocabulary, strings[i])
            lengths[i] = len(rows)
            paths.append((np.array([i]), rows))
        short = [s if len(s) <= LONG else b"" for s in strings]
        for places, block in pieces.by_length(short, vocabulary.longest):
            cells = vocabulary.cells(block)
            count, length, reach = cells.shape
            best = np.full((count, length + 1), -np.inf)
            best[:, 0] = 0
            back = np.zeros((count, length + 1), np.int64)
            slack = np.full((count, length + 1), np.inf)
            every = np.arange(count)
            for end in range(1, length + 1):
                k = np.arange(min(end, reach))
                terms = best[:, end - 1 - k] + weights[cells[:, end - 1 - k, k]]
                arg = terms.argmax(axis=1)
                top = terms[every, arg]
                best[:, end], back[:, end] = top, arg
                if len(k) > 1:
                    terms[every, arg] = -np.inf
                    slack[:, end] = top - terms.max(axis=1)
            self.score[places] = best[:, length]
            # Walk all best paths back together, one arc a round.
            at = np.full(count, length)
            second = np.full(count, np.inf)
            steps = []
            while (on := at > 0).any():
                k = back[every, at]
                start = np.where(on, at - 1 - k, 0)
                steps.append(np.where(on, cells[every, start, np.where(on, k, 0)], -1))
                second = np.where(on, np.minimum(second, slack[every, at]), second)
                at = start
            self.second[places] = second
            path = np.stack(steps[::-1], axis=1)
            lengths[places] = (path >= 0).sum(axis=1)
            paths.append((places, path[path >= 0]))
        # All best paths in one array, in the order of the strings.
        self.ends = np.cumsum(lengths)
        self.flat = np.empty(int(lengths.sum()), np.int32)
        for places, rows in paths:
            self.flat[_ranges(self.ends[places] - lengths[places], lengths[places])] = rows


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each of the given ranges, in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class SegmentCache:
    """Segments seen so far in a task; emptied when it holds ``limit`` of them."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 400_000):
        self.vocabulary, self.limit = vocabulary, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbered()
        self.score, self.second = np.zeros(0), np.zeros(0)
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.searched: dict[bytes, list] = {}

    def codes(self, cut_up: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.index) > self.limit:
            self._clear()
        known = len(self.index)
        codes = [np.fromiter(map(self.index.__getitem__, part), np.int64, len(part)) for part in cut_up]
        if len(self.index) > known:
            done = Segments(self.vocabulary, list(islice(self.index, known, None)))
            self.score, self.second = np.append(self.score, done.score), np.append(self.second, done.second)
            lengths = np.diff(done.ends, prepend=0)
            self.starts = np.append(self.starts, done.ends - lengths + len(self.flat))
            self.lengths, self.flat = np.append(self.lengths, lengths), np.append(self.flat, done.flat)
        return codes


def n_best(vocabulary: Vocabulary, string: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations as (cost beyond the best, piece rows).

    Backward A-star: an item is a suffix that starts at some place, ordered by
    its cost, which with the exact heuristic is that of its best completion.
    Equal costs are ordered by place and then by when they came up, so reruns
    agree.  A suffix is kept as its first piece and the suffix after it, and
    arcs are looked up where the search comes by, so memory is linear in the string.
    """
    length, get, prior = len(string), vocabulary.by_string.get, vocabulary.scores
    best = [0.0] + [-math.inf] * length

    def arcs(end: int) -> list[tuple[int, int]]:
        found = []
        for start in range(end - 1, max(-1, end - 1 - vocabulary.longest), -1):
            row = get(string[start:end])
            if row is None and start == end - 1:
                row = int(vocabulary.byte_row[string[start]])
            if row is not None:
                found.append((start, row))
        return found

    for end in range(1, length + 1):
        best[end] = max(best[start] + prior[row] for start, row in arcs(end))
    agenda: list[tuple[float, int, int, tuple | None]] = [(0.0, length, 0, None)]
    out, came = [], 0
    while agenda and len(out) < n:
        cost, at, _, suffix = heapq.heappop(agenda)
        if at == 0:
            rows = []
            while suffix is not None:
                rows.append(suffix[0])
                suffix = suffix[1]
            out.append((cost, tuple(rows)))
            continue
        for start, row in arcs(at):
            came += 1
            heapq.heappush(agenda, (cost + best[at] - (best[start] + prior[row]), start, came, (row, suffix)))
    return out


def cheapest_sums(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums of one entry from each ascending list, with the entries' places."""
    agenda = [(sum(x[0] for x in lists), (0,) * len(lists))]
    seen, out = {agenda[0][1]}, []
    while agenda and len(out) < n:
        cost, at = heapq.heappop(agenda)
        out.append((cost, at))
        for i, x in enumerate(lists):
            if at[i] + 1 < len(x):
                new = (*at[:i], at[i] + 1, *at[i + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(agenda, (cost - x[at[i]] + x[at[i] + 1], new))
    return out


def encode_texts(vocabulary: Vocabulary, texts: list[bytes], n: int = 2,
                 cache: SegmentCache | None = None) -> Iterator[list[tuple[float, np.ndarray]]]:
    """For each text its n best (score, piece rows); fewer where there are fewer.

    A space is put before the text, as the vocabulary's word mark asks.
    """
    cache = cache or SegmentCache(vocabulary)
    cut = pieces.can_cut(vocabulary)
    cut_up = [SEGMENT.findall(b" " + t) if cut else [b" " + t] for t in texts]
    for part, codes in zip(cut_up, cache.codes(cut_up), strict=True):
        score = float(cache.score[codes].sum())
        lengths = cache.lengths[codes]
        rows = cache.flat[_ranges(cache.starts[codes], lengths)]
        # Any of the n best differs from the best one in the n - 1 cheapest places only.
        second = cache.second[codes]
        places = np.argsort(second, kind="stable")[: n - 1] if n > 2 else np.array([second.argmin()])[: n - 1]
        places = np.sort(places[np.isfinite(second[places])]).tolist()
        lists = []
        for place in places:
            if part[place] not in cache.searched:
                cache.searched[part[place]] = n_best(vocabulary, part[place], n)
            lists.append(cache.searched[part[place]])
        ends = np.cumsum(lengths)
        found = []
        for cost, choice in cheapest_sums([[x[0] for x in one] for one in lists], n):
            own, at = [], 0
            for place, one, i in zip(places, lists, choice, strict=True):
                own += [rows[at : ends[place] - lengths[place]], np.array(one[i][1], np.int32)]
                at = ends[place]
            found.append((score - cost, np.concatenate([*own, rows[at:]])))
        yield found


def decode(vocabulary: Vocabulary, rows: np.ndarray) -> bytes:
    """The text of piece rows; inverse of encoding for any bytes."""
    return b"".join(map(vocabulary.strings.__getitem__, rows.tolist()))[1:]


FIELDS = "n_bytes long, n_pieces long, score double, n_found int, second_score double, ids_sha256 string, nbest_sha256 string, decoded_sha256 string, round_trip boolean"


def encode(docs: DataFrame, model: str = pieces.DEFAULT_MODEL, n: int = 2, key: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Encode whole texts; one row per row of ``docs``: key and FIELDS.

    ``score`` is the log weight of the best segmentation, ``second_score`` that
    of the second (null where there is one only), ``ids_sha256`` is over the
    best ids as little-endian 32-bit numbers, ``nbest_sha256`` over all of the
    n best, ``decoded_sha256`` over the text decoded from the best ids.  Null
    and empty texts encode the bare word mark.  ``with_ids`` adds the ids.
    """
    vocabulary = pieces.load(model)
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(FIELDS + (", ids array<array<int>>" if with_ids else "")).fields])

    def run(batches):
        cache = SegmentCache(vocabulary)
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch.column(1), SLICE):
                raw = data.tobytes()
                texts = [raw[offsets[i] : offsets[i + 1]] for i in range(hi - lo)]
                out = []
                for t, found in zip(texts, encode_texts(vocabulary, texts, n, cache), strict=True):
                    ids = [vocabulary.ids[rows] for _, rows in found]
                    back = decode(vocabulary, found[0][1])
                    every = hashlib.sha256()
                    for one in ids:
                        every.update(len(one).to_bytes(8, "little") + one.tobytes())
                    out.append((len(t), len(ids[0]), found[0][0], len(found), found[1][0] if len(found) > 1 else None,
                                hashlib.sha256(ids[0].tobytes()).hexdigest(), every.hexdigest(),
                                hashlib.sha256(back).hexdigest(), back == t, *([[x.tolist() for x in ids]] if with_ids else [])))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.bool_(),
                         *([pa.list_(pa.list_(pa.int32()))] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))],
                                                 schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=N_BEST)


def decode_ids(encoded: DataFrame, model: str = pieces.DEFAULT_MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of a column of ids (array<int>); null ids give null.  Unknown ids raise."""
    vocabulary = pieces.load(model)
    row_of = {int(i): r for r, i in enumerate(vocabulary.ids)}

    @F.pandas_udf("string")
    def to_text(column):
        return column.map(lambda x: None if x is None else decode(vocabulary, np.array([row_of[int(i)] for i in x], np.int64)).decode("utf-8", "replace"))

    return encoded.withColumn(out, to_text(F.col(ids)))

"""A fixed piece vocabulary and its lattices over byte strings.

The vocabulary is a public tokenizer's file and is never trained here.  Pieces
are byte strings in which the word mark U+2581 is one space byte; 256 byte
pieces make every string segmentable.  Lattices of many strings of one length
are computed together in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from tidemark.llm.text import prefix_hash, span_hash

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A byte piece costs this much more than the rarest piece, in nats.
BYTE_PENALTY = 10.0
#: Cells (string, start, length) that one block of lattices may hold.
CELLS = 1 << 20


class Vocabulary:
    """Pieces by id: ``strings`` (bytes) and ``prior`` (log weight)."""

    def __init__(self, ids: np.ndarray, strings: list[bytes], prior: np.ndarray, is_byte: np.ndarray):
        self.ids, self.strings, self.prior, self.is_byte = ids, strings, prior, is_byte
        self.longest = max(map(len, strings))
        self.scores = prior.tolist()  # for loops over single pieces
        self.by_string = {s: i for i, s in enumerate(strings) if not is_byte[i]}
        self.byte_row = np.zeros(256, np.int32)
        for i in np.flatnonzero(is_byte):
            self.byte_row[strings[i][0]] = i
        self._index()

    def _index(self) -> None:
        """An open-addressing table from string hash to row."""
        rows = np.flatnonzero(~self.is_byte)
        size = 1 << max(12, int(len(rows) * 24).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.table = np.full(size + 64, -1, np.int32)
        self.hashes = np.zeros(len(self.strings), np.uint64)
        self.reach = 1
        for i in rows:
            s = np.frombuffer(self.strings[i], np.uint8)
            h = span_hash(prefix_hash(s), np.array([0]), np.array([len(s)]))[0]
            self.hashes[i] = h
            at = step = int(h >> self.shift)
            while self.table[at] >= 0:
                at += 1
            self.table[at] = i
            self.reach = max(self.reach, at - step + 1)

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where no piece has it."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.arange(len(hashes))
        for step in range(self.reach):
            found = self.table[slot[open_] + step]
            held = found >= 0
            open_, found = open_[held], found[held]
            if not len(open_):
                break
            same = self.hashes[found] == hashes[open_]
            out[open_[same]] = found[same]
            open_ = open_[~same]
        return out

    def cells(self, block: np.ndarray) -> np.ndarray:
        """block: strings x bytes.  Row of the piece block[w, i:i+1+k], at [w, i, k]; -1 if none."""
        count, length = block.shape
        reach = min(self.longest, length)
        prefix = prefix_hash(block.ravel())
        out = np.full((count, length, reach), -1, np.int32)
        base = np.arange(count)[:, None] * length
        for k in range(reach):
            start = (base + np.arange(length - k)[None, :]).ravel()
            out[:, : length - k, k] = self.rows_of(span_hash(prefix, start, start + k + 1)).reshape(count, length - k)
        alone = out[:, :, 0]
        out[:, :, 0] = np.where(alone >= 0, alone, self.byte_row[block])
        return out


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read a sentencepiece model file on the driver.

    Unigram models bring log probabilities.  Merge-ranked models bring minus
    the rank r of a piece; its weight is then 1 / (r + 10), normalised.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, strings, scores, is_byte = [], [], [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        byte = sp.is_byte(i)
        ids.append(i)
        is_byte.append(byte)
        strings.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace(MARK, " ").encode())
        scores.append(sp.get_score(i))
    scores, is_byte = np.array(scores), np.array(is_byte)
    real = np.where(is_byte, np.nan, np.clip(scores, -1e6, None))
    if np.nanmin(real) < -1000:
        order = np.argsort(np.argsort(-np.nan_to_num(real, nan=-1e9), kind="stable"), kind="stable")
        real = np.where(is_byte, np.nan, -np.log(order + 10.0))
    real -= np.log(np.nansum(np.exp(real)))
    return Vocabulary(np.array(ids, np.int32), strings, np.where(is_byte, np.nanmin(real) - BYTE_PENALTY, real), is_byte)


def by_length(strings: list[bytes], reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, strings x bytes) in blocks of equal length; empty strings are left out."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for places in np.split(order, cuts):
        length = int(lengths[places[0]]) if len(places) else 0
        if not length:
            continue
        step = max(1, CELLS // (length * min(reach, length)))
        for lo in range(0, len(places), step):
            part = places[lo : lo + step]
            yield part, np.frombuffer(b"".join([strings[i] for i in part]), np.uint8).reshape(len(part), length)


class Arcs:
    """The arcs of the lattices of one block, ordered by the place that they lead to."""

    def __init__(self, cells: np.ndarray, backwards: bool = False):
        self.count, self.length, reach = cells.shape
        by_place = np.full((self.length, self.count, reach), -1, np.int32)
        for k in range(reach):
            part = cells[:, : self.length - k, k].T
            if backwards:
                by_place[: self.length - k, :, k] = part
            else:
                by_place[k:, :, k] = part
        place, self.string, k = np.nonzero(by_place >= 0)
        self.row = by_place[place, self.string, k]
        # Going backwards, an arc leads from its end to its start.
        self.source = place + 1 + k if backwards else place - k
        self.cuts = np.searchsorted(place, np.arange(self.length + 1))
        new = np.ones(len(place), bool)
        new[1:] = (self.string[1:] != self.string[:-1]) | (place[1:] != place[:-1])
        self.heads = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.heads, len(place)))
        self.backwards = backwards

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Log-space sums over all paths to each place; weights: classes x rows -> classes x strings x places.

        Every place of every string has an arc, as a byte is always a piece.
        """
        out = np.full((len(weights), self.count, self.length + 1), -np.inf)
        out[:, :, self.length if self.backwards else 0] = 0
        log_weight = weights[:, self.row]
        for step in range(self.length):
            place = self.length - 1 - step if self.backwards else step
            lo, hi = self.cuts[place], self.cuts[place + 1]
            terms = out[:, self.string[lo:hi], self.source[lo:hi]] + log_weight[:, lo:hi]
            group = slice(place * self.count, (place + 1) * self.count)
            heads, sizes = self.heads[group] - lo, self.sizes[group]
            top = np.maximum.reduceat(terms, heads, axis=1)
            total = np.add.reduceat(np.exp(terms - np.repeat(top, sizes, axis=1)), heads, axis=1)
            out[:, :, place if self.backwards else place + 1] = top + np.log(total)
        return out


def marginals(vocabulary: Vocabulary, strings: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Log marginal over all segmentations; weights: classes x rows -> strings x classes."""
    out = np.zeros((len(strings), len(weights)))
    for places, block in by_length(strings, vocabulary.longest):
        out[places] = Arcs(vocabulary.cells(block)).sums(weights)[:, :, -1].T
    return out


def expected_counts(vocabulary: Vocabulary, strings: list[bytes], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each row; counts: strings x classes -> rows x classes."""
    n = len(vocabulary.strings)
    out = np.zeros((n, counts.shape[1]))
    for places, block in by_length(strings, vocabulary.longest):
        cells = vocabulary.cells(block)
        arcs = Arcs(cells)
        alpha = arcs.sums(weights[None])[0]
        beta = Arcs(cells, backwards=True).sums(weights[None])[0]
        end = np.repeat(np.arange(1, arcs.length + 1), np.diff(arcs.cuts))
        use = np.exp(alpha[arcs.string, arcs.source] + weights[arcs.row] + beta[arcs.string, end] - alpha[arcs.string, -1])
        for c in range(counts.shape[1]):
            own = counts[places, c]
            if own.any():
                out[:, c] += np.bincount(arcs.row, use * own[arcs.string], n)
    return out


SEGMENT = re.compile(rb" *[^ \n]+| +|\n")


def can_cut(vocabulary: Vocabulary) -> bool:
    """Whether no piece spans a place where ``SEGMENT`` cuts."""
    return not any(b"\n" in s or b" " in s.lstrip(b" ") for s, b in zip(vocabulary.strings, vocabulary.is_byte, strict=True) if not b)

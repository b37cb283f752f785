"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is split into words (a run of spaces and what follows it); a vocabulary with a
piece that crosses such a boundary is refused, so a text's best segmentation is its
words' best segmentations in a row.  Time is linear in a word's length.  A slab's distinct words of equal byte
length advance together: all their substrings are hashed at once from prefix
hashes and probed against the sorted piece keys, and for each end position a
vectorised strict maximum keeps the score and the backpointer.

Scores are the vocabulary's, added in double precision; the segmentation with the
largest sum wins, ties going to the longest last piece.  A character without a
piece of its own costs the lowest score less 10 and is written as byte pieces.

Defined results: null text is the empty text and has no pieces; U+2581 counts as a
space, as in the library; decoding gives back the text with that one change;
repeated rows, null ids and ties are kept as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, mix, narrow_batches, powers, prefix_hash, slabs, span_hash

META = "▁".encode()
NEG = -np.inf


@dataclass
class Vocabulary:
    """Pieces as bytes (spaces for U+2581), their scores, and where single bytes are."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray

    def __post_init__(self) -> None:
        usable = [i for i, p in enumerate(self.pieces) if p and not np.isnan(self.scores[i])]
        flat = b"".join(self.pieces[i] for i in usable)
        size = np.array([len(self.pieces[i]) for i in usable])
        end = np.cumsum(size)
        keys = span_hash(prefix_hash(np.frombuffer(flat, np.uint8)), end - size, end)
        o = np.argsort(keys)
        self.keys, self.ids, self.worth = keys[o], np.array(usable)[o], self.scores[np.array(usable)[o]]
        self.sizes = np.unique(size)
        self.unknown = float(self.worth.min()) - 10.0
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & U64((1 << 20) - 1)).astype(np.int64)] = True
        self.width = np.array([len(p) for p in self.pieces])
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a SentencePiece model file; scores of control and unknown pieces are not used."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        pieces, scores, byte_ids = [], [], np.full(256, -1)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
                pieces.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
            else:
                off = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
                pieces.append(b"" if off else sp.id_to_piece(i).encode().replace(META, b" "))
            scores.append(np.nan if sp.is_byte(i) or not pieces[-1] else sp.get_score(i))
            if not sp.is_byte(i) and b" " in pieces[-1].lstrip(b" "):
                raise ValueError(f"piece {i} crosses a word boundary; words can't be segmented one by one")
        return Vocabulary(pieces, np.array(scores, np.float64), byte_ids)


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start:start + length] of each row, one after the other."""
    end = np.cumsum(length)
    return values[np.repeat(start - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)]


def viterbi(v: Vocabulary, data: np.ndarray, h: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of words of one byte length: ids row by row, right-aligned, and their numbers."""
    n = len(start)
    score = np.full((n, size + 1), NEG)
    score[:, 0] = 0
    back = np.zeros((n, size + 1), np.int32)  # length of the last piece
    piece = np.zeros((n, size + 1), np.int32)
    inverse = powers(len(h), True)
    lead = data[start[:, None] + np.arange(size)]
    char = np.where(lead < 0x80, 1, np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))))
    step = max(1, (1 << 22) // max(1, n * len(v.sizes)))
    for p0 in range(0, size, step):
        ps = np.arange(p0, min(size, p0 + step))
        p, s = np.meshgrid(ps, v.sizes, indexing="ij")
        fits = p + s <= size
        p, s = p[fits], s[fits]
        a, b = start[:, None] + p, start[:, None] + p + s
        key = span_hash_at(h, inverse, a, b)
        maybe = v.seen[(key & U64((1 << 20) - 1)).astype(np.int64)]
        at = np.nonzero(maybe)
        k = np.minimum(np.searchsorted(v.keys, key[at]), len(v.keys) - 1)
        hit = v.keys[k] == key[at]
        worth = np.full(key.shape, NEG)
        worth[at[0][hit], at[1][hit]] = v.worth[k[hit]]
        name = np.zeros(key.shape, np.int32)
        name[at[0][hit], at[1][hit]] = v.ids[k[hit]]
        live = np.isfinite(worth).any(axis=0)
        at_q = np.searchsorted(p, np.append(ps, ps[-1] + 1))  # pairs stand in order of their start
        for k, q in enumerate(ps):
            here = score[:, q]
            own = np.zeros(n, bool)
            for c in at_q[k] + np.flatnonzero(live[at_q[k] : at_q[k + 1]]):
                end = q + int(s[c])
                cand = here + worth[:, c]
                own |= np.isfinite(worth[:, c]) & (char[:, q] == s[c])
                better = cand > score[:, end]
                score[better, end] = cand[better]
                back[better, end] = s[c]
                piece[better, end] = name[better, c]
            byte = here + np.where(char[:, q] == 0, 0.0, np.where(own, NEG, v.unknown))
            better = byte > score[:, q + 1]
            score[better, q + 1] = byte[better]
            back[better, q + 1] = 1
            piece[better, q + 1] = v.byte_ids[lead[better, q]]
    out = np.zeros((n, size), np.int32)
    used = np.zeros(n, np.int64)
    pos, rows = np.full(n, size), np.arange(n)
    while len(rows):
        used[rows] += 1
        out[rows, size - used[rows]] = piece[rows, pos[rows]]
        pos[rows] -= back[rows, pos[rows]]
        rows = rows[pos[rows] > 0]
    return out, used


def span_hash_at(h: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((h[b] - h[a]) * inverse[a] + (b - a).astype(U64))


def encode(v: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and their number in each text; a space is put before each non-empty text."""
    raw = data.tobytes()
    texts = [raw[a:b].replace(META, b" ") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    texts = [b" " + t if t else t for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    end = np.cumsum(size)
    space = data == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[(end - size)[size > 0]] = True
    start = np.flatnonzero(first)
    stop = np.append(start[1:], len(data))
    h = prefix_hash(data)
    _, one, inv = np.unique(span_hash(h, start, stop), return_index=True, return_inverse=True)
    length = (stop - start)[one]
    ids, count, where = [], np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    total = 0
    for L in np.unique(length):
        group = np.flatnonzero(length == L)
        part = max(1, (1 << 21) // (int(L) * min(int(L), 48)))
        for i in range(0, len(group), part):
            g = group[i : i + part]
            out, used = viterbi(v, data, h, start[one[g]], int(L))
            flat = out[np.arange(L) >= (L - used)[:, None]]
            ids.append(flat)
            count[g] = used
            where[g] = total + np.cumsum(used) - used
            total += len(flat)
    flat = gather(np.concatenate(ids), where[inv], count[inv])
    before = np.concatenate([[0], np.cumsum(count[inv])])
    return flat, np.diff(before[np.searchsorted(start, np.concatenate([[0], end]))])


def decode(v: Vocabulary, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Bytes of each text from its ids, without the space put before it."""
    raw = gather(v.flat, v.start[ids], v.width[ids]).tobytes()
    end = np.concatenate([[0], np.cumsum(v.width[ids])])[np.concatenate([[0], np.cumsum(count)])].tolist()
    return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(end[:-1], end[1:], strict=True)]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.load(path)
    return _VOCABULARIES[path]


def encode_decode(documents: DataFrame, model: str, *, keep_text: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip, ids (and the decoded text) of every document.

    One narrow pass: nothing is shuffled and memory follows the slab.
    """
    import zlib

    narrow_batches(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>" + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for slab in slabs(batch.column(1), 4 << 20):
                ids, count = encode(v, slab.data, slab.offs)
                back = decode(v, ids, count)
                raw = slab.data.tobytes()
                o = slab.offs.tolist()
                same = [raw[a:b].replace(META, b" ") == t for a, b, t in zip(o[:-1], o[1:], back, strict=True)]
                at = np.concatenate([[0], np.cumsum(count)])
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                cols = [batch.column(0).slice(slab.lo, slab.hi - slab.lo), pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
                if keep_text:
                    cols.append(pa.array([t.decode(errors="replace") for t in back], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)

"""Token ids in compressed wavelet-matrix files, one per shard, and their reader.

Texts are range-partitioned by doc_id; each partition encodes its texts, builds a
wavelet matrix over its ids (one bit-plane per bit of an id, most significant
first, each plane stably partitioned by the plane before) and writes one file.
A file answers access, rank (counting) and select (occurrence lookup) without
decoding the shard; ``decode`` restores all ids.

File (format "TWM1"): magic, header length, JSON header (n, bits, doc ids and
lengths, plane sizes), then per plane a zstd frame of its packed bits.  Rank
directories (a popcount per 64 bytes) are rebuilt when a plane is opened.

Defined results: null text encodes as the empty text and has only the end id;
null doc_id sorts first; repeated rows each get their own range (order among
equal ids follows the text); an empty table gives no rows and no files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, narrow_batches, scratch

MAGIC = b"TWM1"
BLOCK = 64  # bytes of a plane per rank-directory entry


class Plane:
    """A bit-plane with constant-time rank and logarithmic select."""

    def __init__(self, packed: np.ndarray, n: int) -> None:
        self.packed, self.n = packed, n
        self._rank: np.ndarray | None = None

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3] >> (7 - (i & 7))) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        if self._rank is None:
            pop = np.bitwise_count(self.packed).astype(np.int64)
            starts = np.arange(0, len(pop), BLOCK)
            self._rank = np.concatenate([[0], np.cumsum(np.add.reduceat(pop, starts))]) if len(pop) else np.zeros(1, np.int64)
        byte, rest = i >> 3, i & 7
        block = byte // BLOCK
        r = int(self._rank[block]) + int(np.bitwise_count(self.packed[block * BLOCK : byte]).sum())
        return r + (int(self.packed[byte] >> (8 - rest)).bit_count() if rest else 0)

    def rank(self, b: int, i: int) -> int:
        r = self.rank1(i)
        return r if b else i - r

    def select(self, b: int, k: int) -> int:
        """Position of the k-th bit equal to b, from 0."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if self.rank(b, mid + 1) <= k:
                lo = mid + 1
            else:
                hi = mid
        return lo


class WaveletMatrix:
    """A wavelet matrix over non-negative integer ids."""

    def __init__(self, planes: list[Plane], n: int) -> None:
        self.planes, self.n = planes, n
        self.zeros = [p.rank(0, n) for p in planes]

    @staticmethod
    def planes_of(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        """Packed bit-planes, most significant first."""
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = (x & (1 << level)) != 0
            yield np.packbits(one)
            if level:
                x = np.concatenate([x[~one], x[one]])

    def access(self, i: int) -> int:
        v = 0
        for p, z in zip(self.planes, self.zeros, strict=True):
            b = p.bit(i)
            v = v << 1 | b
            i = z + p.rank1(i) if b else p.rank(0, i)
        return v

    def _bounds(self, v: int, i: int) -> tuple[int, int]:
        """Range in the last level's order of the occurrences of v among the first i ids."""
        lo, hi = 0, i
        for k, (p, z) in enumerate(zip(self.planes, self.zeros, strict=True)):
            b = v >> (len(self.planes) - 1 - k) & 1
            lo, hi = p.rank(b, lo) + z * b, p.rank(b, hi) + z * b
        return lo, hi

    def rank(self, v: int, i: int) -> int:
        """Occurrences of v among the first i ids."""
        lo, hi = self._bounds(v, i)
        return hi - lo

    def count(self, v: int) -> int:
        return self.rank(v, self.n)

    def select(self, v: int, k: int) -> int:
        """Position of the k-th occurrence of v, from 0."""
        lo, hi = self._bounds(v, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            b = v >> (len(self.planes) - 1 - level) & 1
            i = self.planes[level].select(b, i - self.zeros[level] * b)
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the last plane upwards."""
        x = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, p in enumerate(reversed(self.planes)):
            one = np.unpackbits(p.packed, count=self.n).view(bool)
            if k:
                z, y = self.n - int(one.sum()), np.empty_like(x)
                y[~one], y[one] = x[:z], x[z:]
                x = y
            x |= one.astype(x.dtype) << k
        return x


def dump(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], vocabulary: int) -> bytes:
    """One shard as bytes."""
    bits = max(1, int(max(vocabulary - 1, int(ids.max()) if len(ids) else 0)).bit_length())
    pack = zstandard.ZstdCompressor(level=1)
    planes = [pack.compress(p.tobytes()) for p in WaveletMatrix.planes_of(ids, bits)]
    head = json.dumps({"n": len(ids), "bits": bits, "doc_ids": doc_ids, "lengths": lengths, "planes": [len(p) for p in planes]}).encode()
    head = pack.compress(head)
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *planes])


def load(blob: bytes) -> tuple[WaveletMatrix, list[int | None], list[int]]:
    if blob[:4] != MAGIC:
        raise ValueError("not a TWM1 file")
    size = struct.unpack("<I", blob[4:8])[0]
    unpack = zstandard.ZstdDecompressor()
    head = json.loads(unpack.decompress(blob[8 : 8 + size]))
    at, planes, raw = 8 + size, [], (head["n"] + 7) // 8
    for length in head["planes"]:
        plane = unpack.decompress(blob[at : at + length], max_output_size=max(raw, 1)) if raw else b""
        planes.append(Plane(np.frombuffer(plane, np.uint8), head["n"]))
        at += length
    return WaveletMatrix(planes, head["n"]), head["doc_ids"], head["lengths"]


#: Letters up to U+024F and ASCII signs: between one of the former and one of the latter the pre-tokeniser always breaks.
_LETTER, _SIGN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~"
#: A chunk: white space and letters up to a sign or white space, or white space and all up to the next, or white space.
_CHUNK = re.compile(rf"[ \t\n\r]*+[{_LETTER}]++(?=[{_SIGN} \t\n\r]|\Z)|[ \t\n\r]*+[^ \t\n\r]++|[ \t\n\r]++")
#: White space and separators other than blank, tab, LF and CR: such texts are encoded in one piece.
_ODD_POINTS = [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_ODD = re.compile("[" + "".join(map(chr, _ODD_POINTS)) + "]")
_ENCODERS: dict[tuple[str, int], "ChunkEncoder"] = {}


def worker_encoder(path: str, cache: int = 800_000) -> "ChunkEncoder":
    """The encoder of this Python worker: its chunk cache outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, cache)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, cache)
    return _ENCODERS[key]


class ChunkEncoder:
    """Encodes with the tokenizers library, once for each distinct white-space-led chunk.

    The byte-level pre-tokeniser always breaks between a non-space character and
    the blank that follows, and between a letter and a sign, so a text's ids are
    its chunks' ids in a row, and chunks that begin with white space can be put in
    a row, encoded in one call and parted by byte lengths.
    The first `cache` chunk types seen stay known; others are encoded for their
    batch.  Texts with added-token strings or unusual spaces are encoded whole.
    """

    def __init__(self, path: str, cache: int = 800_000) -> None:
        from tokenizers import Tokenizer

        self.tok, self.cache, self.known = Tokenizer.from_file(path), cache, {}
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        state = json.loads(self.tok.to_str())
        pre = state.get("pre_tokenizer") or {}
        self.chunked = state.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.width = np.zeros(self.size, np.int64)  # bytes of each id: a byte-level piece has a character for each
        for piece, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(piece)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks."""
        led = [c for c in chunks if c[0] in " \t\n\r" and c[-1] not in " \t\n\r"]
        out = {c: self.whole(c) for c in set(chunks) - set(led)} if len(led) < len(chunks) else {}
        for i in range(0, len(led), 4000):
            part = led[i : i + 4000]
            text = "".join(part)
            ids = np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            size = np.fromiter(map(len, part if text.isascii() else [c.encode() for c in part]), np.int64, len(part))
            ends = (np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size)) + 1) * ids.itemsize
            raw, ends = ids.tobytes(), ends.tolist()
            out.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian integers."""
        out: list[bytes | None] = [None] * len(texts)
        rows, new, get = [], set(), self.known.get
        for i, text in enumerate(texts):
            if not self.chunked or _ODD.search(text) or any(a in text for a in self.added):
                out[i] = self.whole(text)
                continue
            chunks = _CHUNK.findall(text)
            got = list(map(get, chunks))
            if None in got:
                rows.append((i, chunks, got))
                new.update([c for c, g in zip(chunks, got, strict=True) if g is None])
            else:
                out[i] = b"".join(got)
        if rows:
            fresh = self._chunks(list(new))
            for i, chunks, got in rows:
                out[i] = b"".join([fresh[c] if g is None else g for c, g in zip(chunks, got, strict=True)])
            if len(self.known) < self.cache:
                self.known.update(fresh)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def write_file(folder: str, name: str, blob: bytes) -> str:
    """Writes through a temporary name, so that a retried task leaves one whole file."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(blob)
    fs.move(part, f"{root}/{name}")
    return f"{folder}/{name}"


MOST_PARTS = 50_000


def write_tokens(documents: DataFrame, folder: str, encoder: Callable[[], ChunkEncoder], *, end_id: int = 0, shard_bytes: int = 8 << 20, shard_tokens: int = 1 << 22) -> DataFrame:
    """Writes shard files in ascending doc_id order; returns (part, seq, file, n_docs, n_tokens) rows.

    Shards follow the range partitions, about shard_bytes of text each and at most MOST_PARTS; a
    partition that holds more than shard_tokens ids is cut into several files.
    """
    docs = documents.select("doc_id", "text")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(-(-total // shard_bytes), MOST_PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(), TaskContext.get().partitionId()
        end = np.asarray([end_id], enc.kind).tobytes()
        width, seq = len(end), 0
        ids, lengths, out, held = [], [], [], 0

        def flush() -> dict:
            nonlocal seq, held
            flat = np.frombuffer(b"".join(out), enc.kind)
            path = write_file(folder, f"shard-{part:08d}-{seq:05d}.twm", dump(flat, ids, lengths, enc.size))
            row = {"part": [part], "seq": [seq], "file": [path.rsplit("/", 1)[1]], "n_docs": [len(ids)], "n_tokens": [len(flat)]}
            seq, held = seq + 1, 0
            ids.clear(), lengths.clear(), out.clear()
            return row

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            blobs = (b for i in range(0, len(texts), 100) for b in enc.encode_many(texts[i : i + 100]))
            for doc, blob in zip(batch.column(0).to_pylist(), blobs, strict=True):
                blob += end
                ids.append(doc)
                lengths.append(len(blob) // width)
                out.append(blob)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield pa.RecordBatch.from_pydict(flush(), _FILES)
        if ids:
            yield pa.RecordBatch.from_pydict(flush(), _FILES)

    ranged = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return materialize(ranged.mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long"), "token-files")


_FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    `files` has one row a shard; running sums over parts and over the shards of a part are the only ordered steps.
    """
    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # Offsets in two levels: one row a part meets in one task, at most MOST_PARTS.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    before = files.join(F.broadcast(parts), "part").select("file", (F.col("_before") + own).alias("before"))
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.twm").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix, docs, lengths = load(content.as_buffer().to_pybytes())
                flat = matrix.decode().astype("<u4")
                n = np.asarray(lengths, np.int64)
                start = np.cumsum(n) - n
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(start.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blobs.join(before, "file").select("before", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer: str, folder: str | None = None, **params) -> DataFrame:
    """Encodes, writes and reads back: doc_id, start, n_tokens, ids_crc32."""
    narrow_batches(documents.sparkSession)
    folder = folder or scratch(documents.sparkSession, "tokens")
    files = write_tokens(documents, folder, lambda: worker_encoder(tokenizer), **params)
    return read_tokens(files, folder)

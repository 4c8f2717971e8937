"""Token files of directly addressable codes: any token can be read without decoding a block.

Ids are cut into 8-bit chunks, lowest first. Level 0 holds one chunk of every id; a level's bitmap says
which of its ids continue on the next level, and a directory holds the number of set bits before each 512,
so the place on the next level is a count over at most 64 bytes.

A dataset is a Parquet folder of rows (part, segment, start, n_tokens, payload), parts in ascending order of
documents. A payload is one segment of whole documents, little-endian:

    "DAC1", levels u32, documents u64, tokens u64
    documents x id i64, documents x null flag u8, documents x first token u64
    for each level: entries u64, chunks u8 x entries, and unless it is the last:
        bitmap u8 x 64 * ceil(entries / 512), directory u64 x ceil(entries / 512)

Where a tokenizer's normalizer and pre-tokenizer are those of ``WORDWISE``, its parts never span white space,
so a word's ids are the same wherever it stands, and texts are encoded a distinct word at a time: words seen
before are looked up by a 64-bit hash. With any other tokenizer whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import running_totals, shared_dir, small_join
from factloom.llm.wordbytes import LOWER, Chunk, chunks, span_hashes

MAGIC, SEGMENT_TOKENS, WORDS_KEPT = b"DAC1", 1 << 20, 1_000_000
#: The parts of a tokenizer file under which words can be encoded apart.
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_ENDING = np.zeros(256, bool)
_ENDING[list(b".,!?;:")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


# ---- codes ----


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A payload of documents with ``sizes`` ids each."""
    ids = ids.astype(np.uint32)
    levels = []
    while True:
        more = ids > 0xFF
        levels.append(((ids & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        ids = ids[more] >> 8
    out = [MAGIC, struct.pack("<IQQ", len(levels), len(sizes), int(sizes.sum()))]
    out.append(np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes())
    out.append(bytes(i is None for i in doc_ids))
    out.append((np.cumsum(sizes) - sizes).astype("<u8").tobytes())
    for depth, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if depth < len(levels) - 1:
            blocks = -(-len(more) // 512)
            bits = np.zeros(blocks * 512, bool)
            bits[: len(more)] = more
            per = bits.reshape(-1, 512).sum(axis=1)
            out += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(per) - per).astype("<u8").tobytes()]
    return b"".join(out)


class Segment:
    """A payload, read in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        depth, docs, self.n_tokens = struct.unpack_from("<IQQ", payload, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if empty else int(i) for i, empty in zip(ids, null, strict=True)]
        self.first = np.append(take("<u8", docs).astype(np.int64), self.n_tokens)
        self.levels = []
        for level in range(depth):
            n = int(take("<u8", 1)[0])
            chunk, last = take("u1", n), level == depth - 1
            blocks = -(-n // 512)
            self.levels.append((chunk, None if last else take("u1", 64 * blocks), None if last else take("<u8", blocks)))

    def token(self, i: int) -> int:
        """Id of token ``i``: one chunk, one bit and one short count for each of its levels."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunk, bitmap, directory in self.levels:
            value |= int(chunk[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i >> 9
            before = int(_POPCOUNT[bitmap[block * 64 : i >> 3]].sum()) + bin(int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
            i, shift = int(directory[block]) + before, shift + 8
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        values = np.zeros(self.n_tokens, np.uint32)
        where = np.arange(self.n_tokens)
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            values[where] |= chunk.astype(np.uint32) << np.uint32(8 * level)
            if bitmap is not None:
                where = where[np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)]
        return values


# ---- encoding ----


class Encoder:
    """Ids of texts by a ``tokenizers`` file; ids of words are kept, up to ``WORDS_KEPT``."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_word = all(told[part] == WORDWISE[part] for part in WORDWISE) and told["post_processor"] is None
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each process and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.size, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.int32), 0

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        for a in range(0, len(texts), 5000):
            for h, e in zip(hashes[a : a + 5000], self.tokenizer.encode_batch_fast(texts[a : a + 5000], add_special_tokens=False), strict=True):
                k, new = len(self.known), e.ids
                if k == len(self.start):
                    self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
                while self.used + len(new) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[self.used : self.used + len(new)] = new
                self.start[k], self.size[k], self.known[h] = self.used, len(new), k
                self.used += len(new)

    def encode(self, c: Chunk, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each row of a chunk (of these texts) one after the other, and how many each has."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), np.array([len(x) for x in found], np.int64)
        special = b"<|" in c.data.tobytes()  # special tokens are told apart by case
        data, start, end, row = c.data, c.start, c.end, c.row_of_word()
        if not special:
            # copies of a word in another case share its ids; with other letters case and composition can meet
            data = LOWER[data]
            beyond = np.concatenate([[0], np.cumsum(data > 127)])
            other = np.flatnonzero(beyond[end] > beyond[start])
            where = _ranges(start[other], end[other] - start[other])
            data[where] = c.data[where]
        if not special and len(start):
            # "then," is "then" and ",": the tokenizer parts letters and digits from punctuation
            tail = end.copy()
            for _ in range(4):
                tail -= (tail > start + 1) & _ENDING[data[tail - 1]]
            tail = np.where(_PLAIN[data[tail - 1]], tail, end)
            two = tail < end
            place = np.arange(len(start)) + np.cumsum(two) - two
            n = len(start) + int(two.sum())
            s, e, r = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
            s[place], e[place], r[place] = start, tail, row
            s[place[two] + 1], e[place[two] + 1], r[place[two] + 1] = tail[two], end[two], row[two]
            start, end, row = s, e, r
        if len(self.known) > WORDS_KEPT:
            self._forget()
        hashes = span_hashes(data.astype(np.uint64) + np.uint64(1), 0x5851F42D4C957F2D, start, end)
        unique, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = unique.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            raw, at = data.tobytes(), example[new]
            spans = zip(start[at].tolist(), end[at].tolist(), strict=True)
            self._learn([keys[i] for i in new], [raw[a:b].decode("utf-8", "replace") for a, b in spans])
        k = np.array([self.known[h] for h in keys], np.int64)[inverse]
        sizes = self.size[k]
        return self.ids[_ranges(self.start[k], sizes)], np.bincount(row, sizes, len(c.count)).astype(np.int64)


def _write(path: str, end_id: int, segment_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        number = begin = held = 0
        names: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            nonlocal number, begin, held, names, sizes, ids
            payload = pack(names, np.concatenate(sizes), np.concatenate(ids))
            row = [[part], [number], [begin], [held], [payload]]
            number, begin, held, names, sizes, ids = number + 1, begin + held, 0, [], [], []
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "segment", "start", "n_tokens", "payload"])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for c in chunks(batch.column(1)):
                flat, n = encoder.encode(c, batch.column(1).slice(c.first, len(c.count)))
                row = np.repeat(np.arange(len(n)), n)
                out = np.full(len(flat) + len(n), end_id, np.int64)
                out[np.arange(len(flat)) + row] = flat
                names += docs[c.first : c.first + len(n)]
                sizes.append(n + 1)
                ids.append(out)
                held += len(out)
                if held >= segment_tokens:
                    yield segment()
        if names:
            yield segment()

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, segment_tokens: int = SEGMENT_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes whole texts in ascending order of ids (null first; ties by a hash of the text) into ``folder``.

    Null and empty texts are the end id alone. Repeated rows are documents of their own; rows of one id, and
    rows equal in all, can lie in several parts. The folder must not exist; Spark commits it as a whole. An
    empty table makes an empty dataset.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["id", "hash", "row"]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    schema = "part int, segment long, start long, n_tokens long, payload binary"
    dealt.mapInArrow(_write(tokenizer_path, end_id, segment_tokens), schema).write.option("compression", "none").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            s = Segment(payload)
            raw, first = s.tokens().astype("<u4").tobytes(), s.first.tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first, first[1:], strict=False)]
            columns = [pa.array([part] * len(crc), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.first[:-1] + start), pa.array(np.diff(s.first)), pa.array(crc, pa.int64())]
            yield pa.record_batch(columns, ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(folder_rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (tokens of all documents before), ``n_tokens`` and ``ids_crc32`` from a dataset's files."""
    parts = folder_rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = running_totals(parts, "part", "n", "ahead")
    rows = folder_rows.select("part", "start", "payload").mapInArrow(_read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return small_join(rows, ahead, ["part"]).select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(folder_rows: DataFrame, positions: DataFrame) -> DataFrame:
    """``position`` and ``token`` for each different ``position`` (from 0 over the whole dataset) that there is.

    A segment is joined once with all that is asked of it, by cells as wide as segments are at least (but for
    the last of a part), and each token is read in place.
    """
    parts = folder_rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    placed = small_join(folder_rows, running_totals(parts, "part", "n", "ahead"), ["part"])
    placed = placed.select("part", "segment", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens")
    cell = lambda x: F.floor(x / F.lit(SEGMENT_TOKENS))
    cells = placed.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("n_tokens") - 1))))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position is not null").distinct().withColumn("cell", cell(F.col("position")))
    found = asked.join(cells, "cell").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens")))
    per = found.groupBy("part", "segment", "start").agg(F.collect_list("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, start, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Segment(payload)
                yield pa.record_batch([pa.array(wanted, pa.int64()), pa.array([s.token(p - start) for p in wanted], pa.int64())], ["position", "token"])

    rows = folder_rows.select("part", "segment", "payload").join(per, ["part", "segment"]).select("payload", "start", "positions")
    return rows.mapInArrow(run, "position long, token long")


def dataset_folder(spark, label: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/factloom/{label}-{uuid.uuid4().hex}"

"""Token ids stored with a static range asymmetric numeral system (rANS).

The corpus is range-partitioned and sorted by document id; each task tokenises its documents and closes a
*segment* after ``segment_tokens`` ids. A segment is one self-describing record: a frequency table counted over all
its ids and shared by all its blocks, then independent blocks of ``BLOCK`` ids. In a block, ids are dealt over
``LANES`` interleaved coder states that share one stream of 16-bit words. Every ``CHECKPOINT`` steps the states and the
stream position are kept, so blocks and the runs inside them decode in parallel. Each block carries the CRC-32 of
its words and of its ids. Memory is bounded by the segment, whatever the partition holds.

Defined cases: a null text is an empty text (its only id is the end id); repeated document ids keep one entry per row,
ordered by the text's hash; null ids sort first; an empty table gives an empty corpus.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, small_batches

MAGIC = b"RNSB"
LANES, BLOCK, CHECKPOINT = 128, 65536, 256
STEPS = BLOCK // LANES
#: Characters that the library gets at once of a long text.
PIECE = 1 << 17
SCALE_BITS = 16
SCALE = 1 << SCALE_BITS


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**16, at least 1 for every counted symbol."""
    used = np.flatnonzero(counts)
    if len(used) > SCALE:
        raise ValueError("more distinct ids than the coder's resolution")
    spare = SCALE - len(used)
    share = counts[used].astype(np.float64) / counts[used].sum() * spare
    freq = np.floor(share).astype(np.int64)
    rest = spare - int(freq.sum())
    freq[np.argsort(freq - share, kind="stable")[:rest]] += 1
    out = np.zeros(len(counts), np.int64)
    out[used] = freq + 1
    return out


def encode_segment(ids: np.ndarray) -> bytes:
    """Ids (below 2**16, at least one) to a segment record."""
    total = len(ids)
    counts = np.bincount(ids)
    freq = quantise(counts).astype(np.uint32)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint32)
    blocks = -(-total // BLOCK)
    steps = STEPS if blocks > 1 else -(-total // LANES)
    padded = np.full(blocks * steps * LANES, int(counts.argmax()), np.uint16)
    padded[:total] = ids
    sym = padded.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), SCALE, np.uint32)  # states stay below 2**32
    words = np.zeros((steps, blocks, LANES), np.uint16)
    out = np.zeros((steps, blocks, LANES), bool)
    marks = np.zeros((-(-steps // CHECKPOINT), blocks, LANES), np.uint32)
    bits = np.uint32(SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        s = sym[:, t]
        f = freq[s]
        high = x >> bits
        emit = high >= f
        words[t], out[t] = x & np.uint32(0xFFFF), emit
        x = np.where(emit, high, x)
        q = x // f
        x = (q << bits) + (x - q * f) + start[s]
        if t % CHECKPOINT == 0:
            marks[t // CHECKPOINT] = x
    used = np.flatnonzero(counts)
    table = np.diff(used, prepend=0).astype("<u2").tobytes() + (freq[used] - np.uint32(1)).astype("<u2").tobytes()
    table = zlib.compress(table, 1)
    head, body = [], []
    per_step = out.sum(2)
    for b in range(blocks):
        stream = words[:, b][out[:, b]].astype("<u2").tobytes()
        at = np.concatenate([[0], np.cumsum(per_step[:, b])])[: steps : CHECKPOINT].astype("<u4")
        mine = ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4")
        head.append(struct.pack("<III", len(stream), zlib.crc32(stream), zlib.crc32(mine.tobytes())) + at.tobytes() + marks[:, b].astype("<u4").tobytes())
        body.append(stream)
    return MAGIC + struct.pack("<QIIIII", total, len(used), len(table), blocks, steps, len(marks)) + table + b"".join(head) + b"".join(body)


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment record; raises ValueError where a checksum doesn't hold."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    total, distinct, table_len, blocks, steps, n_marks = struct.unpack_from("<QIIIII", data, 4)
    at = 4 + struct.calcsize("<QIIIII")
    table = np.frombuffer(zlib.decompress(data[at : at + table_len]), "<u2")
    at += table_len
    used = np.cumsum(table[:distinct].astype(np.int64))
    freq = table[distinct:].astype(np.uint32) + np.uint32(1)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint32)
    slot = np.repeat(np.arange(distinct, dtype=np.uint16), freq)
    lens, sums, firsts, states = [], [], [], []
    for _ in range(blocks):
        lens.append(struct.unpack_from("<III", data, at))
        at += 12
        firsts.append(np.frombuffer(data, "<u4", n_marks, at))
        at += 4 * n_marks
        states.append(np.frombuffer(data, "<u4", n_marks * LANES, at).reshape(n_marks, LANES))
        at += 4 * n_marks * LANES
    base = 0
    pos = []
    for (size, crc, _), first in zip(lens, firsts):
        if zlib.crc32(data[at + base : at + base + size]) != crc:
            raise ValueError("a block's words fail their checksum")
        pos.append(first.astype(np.int32) + base // 2)
        base += size
    words = np.concatenate([np.frombuffer(data, "<u2", base // 2, at), [0]]).astype(np.uint32)
    # every run between checkpoints of every block is one row of lanes, all decoded together
    x = np.stack(states).reshape(-1, LANES).astype(np.uint32)
    ptr = np.stack(pos).reshape(-1)
    run = min(CHECKPOINT, steps)
    left = np.tile(np.minimum(steps - np.arange(n_marks) * CHECKPOINT, run), blocks)
    got = np.zeros((len(ptr), run, LANES), np.uint16)
    last = len(words) - 1
    for t in range(run):
        low = x & np.uint32(SCALE - 1)
        s = slot[low]
        got[:, t] = s
        x = freq[s] * (x >> np.uint32(SCALE_BITS)) + low - start[s]
        need = (x < np.uint32(SCALE)) & (t < left)[:, None]
        where = np.cumsum(need, 1, dtype=np.int32)
        x = np.where(need, (x << np.uint32(16)) | words[np.minimum(ptr[:, None] + where - 1, last)], x)
        ptr = ptr + where[:, -1]
    ids = used.astype("<u4")[got].reshape(blocks, n_marks * run, LANES)[:, :steps].reshape(-1)[:total]
    for b, (_, _, crc) in enumerate(lens):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes()) != crc:
            raise ValueError("a block's ids fail their checksum")
    return ids


class ChunkTokeniser(dict):
    """Ids of whole texts by the tokenizers library, remembering the ids of recurring words.

    The byte-level pre-tokeniser of this family begins a new pre-token at each single space before a visible
    character, and takes a line feed between visible characters as a pre-token of its own. Texts are cut there, and each
    part is encoded alone. Texts with white space of other kinds or with added tokens go to the library, long ones in
    pieces that end where a pre-token ends for certain.

    Parts are remembered in two generations of at most ``most`` parts of at most ``LONGEST`` characters each, so a
    worker holds some 60 MB of them whatever it has read.
    """

    #: White space other than the space and the line feed; Python's \s holds all that a tokeniser may take for it.
    ODD = re.compile(r"[^\S \n]")
    ODD_ASCII = "\t\r\v\f\x1c\x1d\x1e\x1f"
    MARKS = frozenset(",.;:!?")
    LONGEST = 64
    #: Where a letter or digit ends and white space or a mark begins, a pre-token ends, whatever stands around.
    SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n\t,.;:!?()])")

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.most, self.older = most, {}
        self.lib = Tokenizer.from_file(path)
        if self.lib.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        encode = lambda x: self._pack(self.lib.encode(x, add_special_tokens=False).ids)
        self.cuttable = not any(self.SAFE.search(a) for a in self.added)
        self.feed = encode("\n")
        self.marks = {m: encode(m) for m in self.MARKS}
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (chr(256 + i) for i in range(256))
        self.alphabet = {b: chr(b) if b in shown else next(hidden) for b in range(256)}
        self.model = self.lib.model.tokenize

    @staticmethod
    def _pack(ids) -> bytes:
        return array("H", ids).tobytes()

    def _spaced(self, text: str) -> bool:
        """Are all runs of white space single spaces or line feeds between visible characters?"""
        if not text or "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] in " \n":
            return False
        odd = any(c in text for c in self.ODD_ASCII) if text.isascii() else self.ODD.search(text)
        return not odd and not any(a in text for a in self.added)

    def __missing__(self, p: str) -> bytes:
        """Ids of a part: one that begins with a line feed as it is, any other after a space."""
        ids = self.older.get(p)
        if ids is None:
            # one pre-token: letters (of blocks that never change) after a space or a line feed
            mark = self.marks.get(p[-1:])
            if mark is None or not p[-2:-1].isalpha():
                ids = self._ids(p)
            else:
                bare = p[:-1]
                ids = (self.get(bare) or self.older.get(bare) or self._ids(bare)) + mark
        if len(p) <= self.LONGEST:
            self[p] = ids
        return ids

    def _ids(self, p: str) -> bytes:
        if p.isalpha():
            if p.isascii():
                return array("H", [t.id for t in self.model("\u0120" + p)]).tobytes()
            if max(p) <= "\u024f":
                return array("H", [t.id for t in self.model("\u0120" + p.encode().decode("latin-1").translate(self.alphabet))]).tobytes()
        elif p[:1] == "\n":
            bare = p[1:]
            if bare.isalpha() and bare.isascii():
                return self.feed + array("H", [t.id for t in self.model(bare)]).tobytes()
            return self.feed + self._pack(self.lib.encode(bare, add_special_tokens=False).ids)
        return self._pack(self.lib.encode(" " + p, add_special_tokens=False).ids)

    def _by_parts(self, text: str) -> bytes:
        # a line feed is put before the text, and its id dropped again, so that its first word is unspaced
        parts = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        out = []
        for a in range(0, len(parts), PIECE):
            out.append(b"".join(map(self.__getitem__, parts[a : a + PIECE])))
            if len(self) > self.most:
                self.older = dict(self)
                self.clear()
        return b"".join(out)[len(self.feed) :]

    def _whole(self, text: str) -> bytes:
        """A text of any kind; long ones are cut at ``SAFE`` places, so the library gets about ``PIECE`` characters at
        once, or a longer run that has no such place."""
        out, at = [], 0
        if len(text) > PIECE and self.cuttable:
            for m in self.SAFE.finditer(text):
                if m.start() - at >= PIECE:
                    out.append(self._pack(self.lib.encode(text[at : m.start()], add_special_tokens=False).ids))
                    at = m.start()
        return b"".join([*out, self._pack(self.lib.encode(text[at:], add_special_tokens=False).ids)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as unsigned 16-bit integers."""
        return [self._by_parts(t) if self._spaced(t) else self._whole(t) for t in texts]


_tokenisers: dict[str, ChunkTokeniser] = {}


def tokeniser(path: str) -> ChunkTokeniser:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    if path not in _tokenisers:
        _tokenisers[path] = ChunkTokeniser(path)
    return _tokenisers[path]


_SEGMENT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment_tokens: int = 2_000_000, partitions: int | None = None) -> None:
    """Tokenise ``docs`` and write their ids in ascending id order as segments under ``path``.

    A text whose ids alone exceed a segment makes a segment of its own size.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        shard, number, held, names, lengths, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        tok = tokeniser(vocabulary)
        end = np.array([end_id], np.uint16).tobytes()

        def close():
            data = encode_segment(np.frombuffer(b"".join(held), np.uint16))
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": number, "n_ids": size, "doc_ids": names, "lengths": lengths, "data": data}], schema=arrow)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = tok.encode([text.as_py() or ""])[0]
                held.append(ids + end)
                names.append(key.as_py())
                lengths.append(len(ids) // 2 + 1)
                size += lengths[-1]
                if size >= segment_tokens:
                    yield close()
                    number, held, names, lengths, size = number + 1, [], [], [], 0
        if held:
            yield close()

    arrow = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
    n = partitions or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = rows.repartitionByRange(n, F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"))
    rows.mapInArrow(run, _SEGMENT).write.option("compression", "none").parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, segment, base): how many ids stand before each segment. Only one total per shard reaches the driver,
    and their number is that of the writing job's tasks."""
    meta = spark.read.schema(_SEGMENT).parquet(path).select("shard", "segment", "n_ids")
    totals = dict(meta.groupBy("shard").agg(F.sum("n_ids")).collect())
    bases, before = [], 0
    for shard in sorted(totals):
        bases.append((shard, before))
        before += totals[shard]
    bases = spark.createDataFrame(bases, "shard int, before long")
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return meta.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(bases), "shard").select("shard", "segment", (F.col("before") + F.col("inside")).alias("base"))


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Decode a corpus: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches):
        for segment in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            for row in segment.to_pylist():
                ids = decode_segment(row["data"])
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - row["lengths"]
                raw = ids.tobytes()
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(np.full(len(ends), row["segment"], np.int32)), pa.array(starts), pa.array(np.array(row["lengths"], np.int64)), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    small_batches(spark)
    rows = spark.read.schema(_SEGMENT).parquet(path).mapInArrow(run, T.StructType(fields))
    out = rows.join(segment_starts(spark, path), ["shard", "segment"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

"""SentencePiece encoding that keeps source offsets, and decoding.

A model's compiled character map is a double-array trie followed by its replacement strings. ``Normaliser`` walks it
with longest-prefix matching and records, for each byte of the normalised text, the source byte it came from;
``PieceCodec`` projects every piece back through that alignment to the span of source bytes it covers. A model whose map
is empty, such as the one of the registered query, aligns every byte with itself but for escaped and added spaces; that
alignment is made at once (``Normaliser.copied``) instead of byte by byte.

Defined cases: a null text is an empty text; an empty text has no ids and decodes to the empty string; texts are
never cut; rows with a repeated or null id are encoded one by one.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PartCache, slices, small_batches

#: Fixed values of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
META = "▁"


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class ModelFile:
    """The parts of a model file that offsets depend on."""

    def __init__(self, path_or_bytes: str | bytes):
        data = path_or_bytes
        if isinstance(data, str):
            with open(data, "rb") as f:
                data = f.read()
        self.pieces: list[tuple[str, int]] = []
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape, self.model_type, self.suffix = b"", True, True, True, 1, False
        for n, v in _fields(data):
            if n == 1:
                p = dict(_fields(v))
                self.pieces.append((p[1].decode(), p.get(3, NORMAL)))
            elif n == 2:
                spec = dict(_fields(v))
                self.model_type, self.suffix = spec.get(3, 1), bool(spec.get(24, 0))
            elif n == 3:
                spec = dict(_fields(v))
                self.charsmap = spec.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))


class Normaliser:
    """Longest-prefix normalisation with alignment."""

    def __init__(self, charsmap: bytes = b"", *, dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True, symbols: tuple[str, ...] = (), suffix: bool = False):
        self.dummy_prefix, self.squeeze, self.suffix = dummy_prefix, squeeze, suffix
        self.space = META.encode() if escape else b" "
        self.escape = escape
        self.symbols = sorted((s.encode() for s in symbols), key=len, reverse=True)
        self.units: list[int] = []
        self.strings = b""
        if charsmap:
            size = int.from_bytes(charsmap[:4], "little")
            self.units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist()
            self.strings = charsmap[4 + size :]

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """Replacement for the longest known prefix at ``at``, and how many source bytes it stands for."""
        for s in self.symbols:
            if text.startswith(s, at):
                return s, len(s)
        best = None
        if self.units:
            units = self.units
            # a unit holds its label in the low byte, a leaf flag in bit 8 and the distance to its children above
            hop = lambda u: (u >> 10) << ((u & 512) >> 6)
            node = hop(units[0])
            for i in range(at, len(text)):
                node ^= text[i]
                if node >= len(units) or units[node] & 0x800000FF != text[i]:
                    break
                u = units[node]
                node ^= hop(u)
                if u & 256:
                    best = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if best:
            end = self.strings.index(b"\0", best[0])
            return self.strings[best[0] : end], best[1]
        lead = text[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + size], size

    def run(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) the source offset."""
        src = text.encode()
        if not (self.units or self.symbols or self.squeeze or self.suffix) and self.escape:
            return self.copied(src)
        out, origin, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(src):
                p, n = self._prefix(src, at)
                if p != b" ":
                    break
                at += n
        if at == len(src):
            return b"", np.zeros(1, np.int64)

        def put(piece: bytes, where: int):
            out.extend(piece)
            origin.extend([where] * len(piece))

        if self.dummy_prefix and not self.suffix:
            put(self.space, at)
        after_space = self.squeeze
        while at < len(src):
            p, n = self._prefix(src, at)
            if after_space:
                p = p.lstrip(b" ")
            if p:
                put(p.replace(b" ", self.space) if self.escape else p, at)
                after_space = p.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(self.space):
                at = origin[len(out) - len(self.space)]
                del out[-len(self.space) :], origin[-len(self.space) :]
        if self.dummy_prefix and self.suffix:
            put(self.space, at)
        return bytes(out), np.array([*origin, at], np.int64)


    def copied(self, src: bytes) -> tuple[bytes, np.ndarray]:
        """``run`` of a model without a character map: every byte stands for itself, but for the escaped spaces."""
        if not src:
            return b"", np.zeros(1, np.int64)
        width = np.ones(len(src) + 1, np.int64)
        width[:-1][np.frombuffer(src, np.uint8) == 32] = len(self.space)
        origin = np.repeat(np.arange(len(src) + 1), width)
        if self.dummy_prefix:
            origin = np.concatenate([np.zeros(len(self.space), np.int64), origin])
        return self.space * self.dummy_prefix + src.replace(b" ", self.space), origin


class PieceCodec:
    """Encodes texts to ids with the source span of each, and decodes ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = ModelFile(path)
        symbols = tuple(p for p, kind in model.pieces if kind == USER_DEFINED)
        self.norm = Normaliser(model.charsmap, dummy_prefix=model.dummy_prefix, squeeze=model.squeeze, escape=model.escape, symbols=symbols, suffix=model.suffix)
        self.cache = PartCache(self._learn)
        # Merges never cross the start of a run of spaces or a line feed if no piece holds one after another
        # character; then such parts of a text can be encoded one by one and remembered.
        free = all(META not in p.lstrip(META) and "\n" not in p for p, kind in model.pieces if kind == NORMAL)
        self.by_parts = free and model.model_type == 2 and not model.charsmap and model.dummy_prefix and model.escape and not model.squeeze and not model.suffix and not symbols and any(k == BYTE for _, k in model.pieces) and all(k != UNUSED for _, k in model.pieces)
        # how many normalised bytes each piece stands for
        self.width = np.array([1 if kind == BYTE else len(p.encode()) for p, kind in model.pieces], np.int64)
        self.unknown = np.array([kind == UNKNOWN for _, kind in model.pieces])
        self.is_byte = np.array([kind == BYTE for _, kind in model.pieces])
        self.alone = np.array([self.lib.piece_to_id(META)], np.int32).tobytes()

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts: one that begins with a line feed as it is, any other after a space."""
        some = [p for p in parts if p]
        # the library's own added space never joins a line feed: it stands alone as the first id
        out = {p: array("i", ids[1:] if p[0] == "\n" else ids).tobytes() for p, ids in zip(some, self.lib.encode(some, num_threads=1))}
        out[""] = self.alone
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_parts:
            return [np.array(i, np.int32) for i in self.lib.encode(texts, num_threads=1)]
        plain = [bool(t) and "  " not in t and t[0] != " " and META not in t for t in texts]
        done = iter(self.cache.join([t.replace("\n", " \n").split(" ") for t, ok in zip(texts, plain) if ok]))
        return [np.frombuffer(next(done), np.int32) if ok else np.array(self.lib.encode(t), np.int32) for t, ok in zip(texts, plain)]

    def ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Where each piece's source bytes end, through the alignment of the normalised text; it begins where the one
        before it ends. An added space covers none."""
        if not len(ids):
            return np.zeros(0, np.int32)
        size = self.width[ids]
        if self.unknown[ids].any():  # an unknown piece stands for what it shows
            pieces = self.lib.encode(text, out_type=str)
            size = np.array([n if not u else len(p.encode()) for n, u, p in zip(size, self.unknown[ids], pieces)], np.int64)
        return self.norm.run(text)[1][np.cumsum(size)].astype(np.int32)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [self.lib.decode(i.tolist()) if len(i) else "" for i in ids]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, ends, decoded) for each row: the ids, the source byte where each piece ends, and decode(ids)."""

    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                texts = [x or "" for x in part.column("t").to_pylist()]
                ids = c.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                ends = [c.ends(t, i) for t, i in zip(texts, ids)]
                flat = lambda xs: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(xs).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("k"), flat(ids), flat(ends), pa.array(c.decode(ids), pa.string())], names=[id_col, "ids", "ends", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    ints = T.ArrayType(T.IntegerType())
    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, T.LongType()), T.StructField("ids", ints), T.StructField("ends", ints), T.StructField("decoded", T.StringType())]))


def spans(encoded: DataFrame) -> DataFrame:
    """``encoded`` with ``spans``: for each piece a struct (id, begin, end) of source bytes."""
    begin = F.slice(F.concat(F.array(F.lit(0)), F.col("ends")), F.lit(1), F.size("ends"))
    zipped = F.arrays_zip(F.col("ids").alias("id"), begin.alias("begin"), F.col("ends").alias("end"))
    return encoded.withColumn("spans", zipped.cast("array<struct<id:int,begin:int,end:int>>"))

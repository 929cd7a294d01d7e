"""Quality rules from tokeniser fertility.

Each text is encoded with public vocabularies, SentencePiece models and byte-level ones; per vocabulary the operator
measures characters per token, the share of byte-fallback tokens (byte pieces, those of white space aside; of byte-level
vocabularies, tokens that are a part of a character) and the mean entropy, in bits, of the tokens in windows of ``WINDOW``
(a window's entropy doesn't depend on the text's length). A text is rejected when a measure of any vocabulary leaves

* the fixed band of its script, or
* the band of its language: quartiles over all documents that pass the base rule, widened by multiples of their
  distance (below ``SPREAD[0]``, above ``SPREAD[1]``). Quartiles come from counts on a grid of ``GRID``, so they are
  exact on it and the same however rows are partitioned. Languages of under ``LEAST`` such documents have no band.

Beside these come plain counts over words (runs without space, tab, LF, VT, FF, CR) and a base rule that fails short or
repetitive texts.

Defined cases: a null or empty text has no words and fails the base rule; measures of a text without tokens are null;
repeated ids give one row per input row; a null language is a language of its own; a script without a band takes that
of ``"other"``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, durable, join_small, slices, small_batches
from .pieces import codec
from .token_blocks import tokeniser

SYMBOLS = "#*$%&|<>"

#: First and last code points that tell a script; the most frequent script of a text's letters counts.
SCRIPTS = {"greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F), "hangul": (0xAC00, 0xD7AF), "kana": (0x3040, 0x30FF), "han": (0x3400, 0x9FFF)}


WINDOW, GRID, SPREAD, LEAST = 64, 0.005, (3.0, 5.0), 50


@dataclass(frozen=True)
class Band:
    """Accepted characters per token, the largest share of byte pieces, the least windowed entropy in bits."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float


#: Accepted ranges by script for a vocabulary of about 32,000 pieces that was built for European languages.
BANDS = {
    "latin": Band((1.5, 8.0), 0.05, 3.5),
    "cyrillic": Band((1.2, 6.0), 0.10, 3.5),
    "greek": Band((0.8, 4.0), 0.20, 3.0),
    "han": Band((0.3, 2.5), 0.80, 3.0),
    "kana": Band((0.4, 2.5), 0.80, 3.0),
    "other": Band((0.25, 8.0), 1.0, 2.5),
}

#: The same for a byte-level vocabulary of about 50,000 tokens that was built for English.
BYTE_BANDS = {
    "latin": Band((1.2, 8.0), 0.25, 3.5),  # accented letters after rare ones are cut into bytes
    "cyrillic": Band((0.4, 4.0), 0.60, 2.5),
    "greek": Band((0.3, 3.0), 0.60, 2.5),
    "han": Band((0.25, 2.0), 1.0, 2.5),
    "kana": Band((0.25, 2.5), 1.0, 2.5),
    "other": Band((0.2, 8.0), 1.0, 2.0),
}


def script_of(text: str) -> str:
    """The script of most letters; ``latin`` where no other is seen."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    best, most = "latin", int((((codes | 32) >= 97) & ((codes | 32) <= 122) | (codes >= 0xC0) & (codes < 0x250)).sum())
    for name, (a, b) in SCRIPTS.items():
        n = int(((codes >= a) & (codes <= b)).sum())
        if n > most:
            best, most = name, n
    return best if most else "other"


_words = re.compile(WORD).findall
_word = re.compile(WORD).search


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _words(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if _word(x)] if "\n" in text else []
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        if len(number) < n:
            m = len(number)
            pair = ids[:-1] * m + ids[1:]
            # pairs below 2**40 or so; renumber them so that three words fit
            _, pair = np.unique(pair, return_inverse=True)
            _, where, count = np.unique(pair[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
            again = count[where] > 1
            if again.any():
                hit = np.zeros(n, bool)
                hit[:-2] |= again
                hit[1:-1] |= again
                hit[2:] |= again
                repeat = int(hit.sum())
    return n, chars, symbols, dup_lines, repeat


def token_measures(ids: np.ndarray, n_chars: int, is_byte: np.ndarray) -> tuple[float, float, float] | None:
    """Characters per token, byte share and windowed entropy; None without tokens. Whole windows count, or all tokens
    where there are fewer than one window's. ``is_byte`` marks the byte pieces of other than white space."""
    n = len(ids)
    if not n:
        return None
    wide = min(n, WINDOW)
    rows = n // wide
    window = np.sort(ids[: rows * wide].reshape(rows, wide), axis=1)
    new = np.ones(window.shape, bool)
    new[:, 1:] = window[:, 1:] != window[:, :-1]
    runs = np.diff(np.append(np.flatnonzero(new), rows * wide))
    return n_chars / n, float(is_byte[ids].mean()), float(np.log2(wide) - (runs * np.log2(runs)).sum() / (rows * wide))


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def in_band(m: tuple[float, float, float], band: Band) -> bool:
    return band.chars_per_token[0] <= m[0] <= band.chars_per_token[1] and m[1] <= band.byte_share and m[2] >= band.entropy


class Pieces:
    """A SentencePiece model: ids of texts, and which of them are byte pieces of other than white space."""

    bands = BANDS

    def __init__(self, path: str):
        self.codec = codec(path)
        self.is_byte = self.codec.is_byte.copy()
        self.is_byte[[self.codec.lib.piece_to_id(f"<0x{b:02X}>") for b in b"\t\n\x0b\x0c\r "]] = False

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.codec.encode(texts)


class ByteLevel:
    """A byte-level vocabulary: ids of texts, and which tokens are a part of a character."""

    bands = BYTE_BANDS

    def __init__(self, path: str):
        self.tokeniser = tokeniser(path)
        byte_of = {c: b for b, c in self.tokeniser.alphabet.items()}
        vocabulary = self.tokeniser.lib.get_vocab(with_added_tokens=True)
        self.is_byte = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            try:
                bytes(byte_of[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError) as e:
                self.is_byte[i] = isinstance(e, UnicodeDecodeError)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint16) for x in self.tokeniser.encode(texts)]


_tools: dict[str, Pieces | ByteLevel] = {}


def tool(path: str) -> Pieces | ByteLevel:
    if path not in _tools:
        _tools[path] = (Pieces if path.endswith(".model") else ByteLevel)(path)
    return _tools[path]


def measure(docs: DataFrame, vocabularies: dict[str, str], *, bands: dict[str, dict[str, Band]] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the counts, base_failed, the script, each vocabulary's measures, and in_script_band. ``bands``
    may give a vocabulary's own by its name; else they are those of its kind (a file that ends in .model, or any other)."""
    names = list(vocabularies)
    doubles = [f"{v}_{c}" for v in names for c in ("chars_per_token", "byte_share", "entropy")]
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("language", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType()), T.StructField("in_script_band", T.BooleanType()), T.StructField("script", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in doubles)])
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * len(doubles)

    def run(batches):
        tools = [tool(vocabularies[v]) for v in names]
        by_script = [(bands or {}).get(v, x.bands) for v, x in zip(names, tools)]
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                texts = [x or "" for x in part.column("t").to_pylist()]
                coded = [c.encode(texts) for c in tools]
                rows = []
                for i, text in enumerate(texts):
                    base = base_counts(text)
                    script = script_of(text)
                    fits, measures = True, []
                    for ids, x, ranges in zip(coded, tools, by_script):
                        m = token_measures(ids[i], len(text), x.is_byte)
                        fits = fits and m is not None and in_band(m, ranges.get(script, ranges["other"]))
                        measures += m or (None, None, None)
                    rows.append((*base, base_fails(base[0], base[4]), fits, script, *measures))
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("l"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    lang = F.coalesce(F.concat(F.lit("="), lang), F.lit("null"))  # a key of its own for null
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"), lang.alias("l")).mapInArrow(run, schema)


def language_bands(measured: DataFrame, column: str) -> DataFrame:
    """(language, low, high): the band of one measure over all documents that pass the base rule."""
    cell = F.floor(F.col(column) / GRID)
    cells = measured.where(~F.col("base_failed") & F.col(column).isNotNull()).groupBy("language", cell.alias("cell")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("language")
    cells = cells.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("total", F.sum("n").over(by))
    quart = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("cell"))) * GRID
    quarts = cells.groupBy("language").agg(*(quart(q).alias(n) for q, n in ((0.25, "a"), (0.5, "m"), (0.75, "b"))), F.max("total").alias("total"))
    width = F.greatest(F.col("b") - F.col("a"), F.lit(4 * GRID))
    return quarts.where(F.col("total") >= LEAST).select("language", (F.col("m") - SPREAD[0] * width).alias("low"), (F.col("m") + SPREAD[1] * width).alias("high"))


def fertility(docs: DataFrame, vocabularies: dict[str, str], *, bands: dict[str, dict[str, Band]] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``measure`` with ``kept``: the base rule passes, and all measures lie in the script's and the language's bands."""
    measured = durable(measure(docs, vocabularies, bands=bands, id_col=id_col, text_col=text_col, lang_col=lang_col), "fertility")
    kept, drop = ~F.col("base_failed") & F.col("in_script_band"), []
    out = measured
    for v in vocabularies:
        for c in ("chars_per_token", "entropy"):
            low, high = f"_{v}_{c}_low", f"_{v}_{c}_high"
            found = language_bands(measured, f"{v}_{c}").withColumnsRenamed({"low": low, "high": high})
            out = join_small(out, found, "language")
            kept &= F.coalesce(F.col(f"{v}_{c}").between(F.col(low), F.col(high)), F.lit(True))
            drop += [low, high]
    return out.withColumn("kept", F.coalesce(kept, F.lit(False))).drop(*drop, "in_script_band", "language")

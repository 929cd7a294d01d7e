"""Line deduplication by winnowing over line hashes.

A document is its sequence of lines that hold a word, each as a 128-bit hash of the line without white space at its
ends. A *window* begins at every line and ends with the first line that makes it ``window_lines`` lines or
``window_words`` words; it depends on its content alone. Each window selects its least line hash (the last of equal
ones): the winnowed fingerprints. A repeated run of at least a window holds a selected fingerprint at the same place of
each of its copies, so it can't be missed; runs shorter than any window are not looked for.

1. Positions of fingerprints are counted; those of fingerprints that stand at one position alone fall away (of prose
   that nobody copied, nearly all).
2. Positions are joined on the fingerprint *and* the content around it that the match must at least have: a window that
   selected it. So a line that stands in a third of all documents doesn't bring all of its positions together, and each
   joined pair is a true match. A position is joined with the first of its equals alone, in ascending order of id and
   text hash; inside one document the earlier position is the first.
3. Matches extend both ways: to the left over the windows that begin earlier and still select a fingerprint of the run,
   to the right over those that begin later, and at the right end line by line up to where the next window would end
   (``tails``). Extension goes by content, not along one chosen copy, so it reaches as far as *any* earlier copy does;
   pairs of all copies, which extension along the lines of two documents would need for this, are never made.
4. Extended matches of a document are merged to maximal runs, and its text is cut there.

With ``sentences`` lines are also cut at sentence ends, and runs of whole sentences that hold ``window_words`` words are
found in the same way, wherever lines begin and end. A line that loses only some sentences keeps the others. Passages
that begin or end inside a sentence lose their whole sentences only, and stay where these hold fewer words.

Defined cases: null texts stay null; texts without words are unchanged; a run that repeats inside one document loses its
later copy (in overlapping copies, all lines but the first window's beginning); blank lines go with the run around them;
rows of equal id and text count as one document and get the same result; null ids come first; an empty table gives no
rows; all other columns keep their names and values, whatever these are.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_paths, numbered, place, restored, scratch, slices, small_batches

#: White space inside a line that ends a sentence (ASCII marks, ellipsis, danda, Arabic and full-width marks).
_SENTENCE = re.compile("(?:[.!?]|…|।|؟|。|！|？)([ \t\v\f\r]+)".encode())


def line_units(data: bytes) -> list[tuple[bytes, int, int]]:
    """(bare line, begin, end) of each line that holds a word. It ends where the next line begins."""
    out, at, n = [], 0, len(data)
    for line in data.split(b"\n"):
        to = min(at + len(line) + 1, n)
        if bare := line.strip():  # strips the six characters that separate words
            out.append((bare, at, to))
        at = to
    return out


def sentence_units(data: bytes, lines: list[tuple[bytes, int, int]]) -> list[tuple[bytes, int, int]]:
    """The same of each sentence. It ends where the next sentence or line begins."""
    out = []
    for bare, begin, end in lines:
        at, first = 0, begin + len(data[begin:end]) - len(data[begin:end].lstrip())
        for m in _SENTENCE.finditer(bare):
            out.append((bare[at : m.start(1)], begin, first + m.end()))
            at, begin = m.end(), first + m.end()
        out.append((bare[at:], begin, end))
    return out


def tails(found: list[tuple[int, int, int]], n: int):
    """The spans (at, first, last) that prolong each window of ``found``, of a text of n units, unit by unit: to before
    the next window's end, or to the text's end after the last. Where a repeated run ends inside the next window, one of
    them ends with it. After a window of a single unit the next one's end is tried as well, as only a span over both
    covers the gap between them. Ends never go back, so these are no more than twice the text's units."""
    for i, (at, first, last) in enumerate(found):
        end = found[i + 1][2] + (first == last) if i + 1 < len(found) else n
        for to in range(last + 1, end):
            yield at, first, to


def windows(units: list[tuple[bytes, int, int]], window_lines: int, window_words: int, *, short: bool = False) -> list[tuple[int, bytes, bytes, int, int]]:
    """(position, line hash, content hash, begin, end) of each window and tail, by the position that the window selected.
    With ``short`` windows of ``window_words`` words are left out."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    hashes = [digest(u[0]) for u in units]
    words = [len(u[0].split()) for u in units]
    found, low = [], deque()  # units that can still be a window's least, hashes ascending
    n, end, held = len(units), 0, 0
    for first in range(n):
        while end < n and not (end - first >= window_lines or held >= window_words and end > first):
            while low and hashes[low[-1]] >= hashes[end]:
                low.pop()
            low.append(end)
            held += words[end]
            end += 1
        if not (end - first >= window_lines or held >= window_words):
            break
        if low[0] < first:
            low.popleft()
        if not short or held < window_words:
            found.append((low[0], first, end - 1))
        held -= words[first]
    whole = b"".join(hashes)
    spans = [*found, *(() if short else tails(found, n))]
    return [(at, hashes[at], digest(whole[16 * a : 16 * b + 16]), units[a][1], units[b][2]) for at, a, b in spans]


def marks(data: bytes, window_lines: int, window_words: int, sentences: bool) -> dict[tuple[int, bytes], list[tuple[bytes | None, int, int]]]:
    """By fingerprint (position, hash): the spans around it as (content hash, begin, end), the hash None where the same
    content begins earlier in this text."""
    lines = line_units(data)
    if sentences:  # runs of lines with enough words are runs of sentences, too
        units = sentence_units(data, lines)
        found = windows(units, len(units) + 1, window_words) + [(-1 - at, *x) for at, *x in windows(lines, window_lines, window_words, short=True)]
    else:
        found = windows(lines, window_lines, window_words)
    seen: dict[bytes, tuple[int, int]] = {}
    for _, _, content, begin, end in found:
        if content not in seen or begin < seen[content][0]:
            seen[content] = begin, end
    out: dict[tuple[int, bytes], list[tuple[bytes | None, int, int]]] = {}
    for at, mark, content, begin, end in found:
        out.setdefault((at, mark), []).append((content if seen[content][0] == begin else None, begin, end))
    return out


def fingerprints(docs: DataFrame, *, window_lines: int, window_words: int, sentences: bool) -> DataFrame:
    """(k, h, print, a, b, begins, ends) for each fingerprint of documents (k, h, t): 96 bits of the content hashes (null
    for later copies inside the text) and the byte offsets of its spans, as arrays."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                rows, prints, sizes, contents, begins, ends = [], [], [], [], [], []
                for i, data in enumerate(part.column("t").cast(pa.binary()).to_pylist()):
                    for (_, mark), spans in marks(data or b"", window_lines, window_words, sentences).items():
                        rows.append(i)
                        prints.append(mark[:8])
                        sizes.append(len(spans))
                        for content, begin, end in spans:
                            contents.append(content)
                            begins.append(begin)
                            ends.append(end)
                at = pa.array(rows, pa.int32())
                raw = np.frombuffer(b"".join(x or bytes(16) for x in contents), np.dtype([("a", "<i8"), ("b", "<i4"), ("rest", "<i4")]))
                again = np.array([x is None for x in contents], bool)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(raw["a"], mask=again), pa.array(raw["b"]), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("k").take(at), part.column("h").take(at), pa.array(np.frombuffer(b"".join(prints), "<i8")), *lists], names=["k", "h", "print", "a", "b", "begins", "ends"])

    return docs.mapInArrow(run, "k long, h long, print long, a array<long>, b array<int>, begins array<int>, ends array<int>")


def kept_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and where."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def repeated_runs(docs: DataFrame, *, window_lines: int, window_words: int, sentences: bool) -> DataFrame:
    """(k, h, runs) for each document (k, h, t) that holds later copies: its maximal runs as ascending (begin, end)."""
    found, path = kept_table(fingerprints(docs, window_lines=window_lines, window_words=window_words, sentences=sentences), "fingerprints")
    # tables that are joined are written first: then both sides of a join are plain shuffles, and Spark splits the
    # partitions of hot keys
    often, often_path = kept_table(found.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "often")
    spans = found.join(often, "print", "left_semi").select("k", "h", F.inline(F.arrays_zip("a", "b", "begins", "ends"))).toDF("k", "h", "a", "b", "begin", "end")
    spans, _ = kept_table(spans, "spans")
    drop_paths(docs.sparkSession, path, often_path)
    who = F.struct(F.coalesce("k", F.lit(-(1 << 63))).alias("k"), "h")
    outer = spans.where("a IS NOT NULL")
    firsts, _ = kept_table(outer.groupBy("a", "b").agg(F.min(who).alias("least"), F.count("*").alias("n")).where("n > 1").select("a", "b", "least"), "firsts")
    later = outer.join(firsts, ["a", "b"]).where(who > F.col("least")).select("k", "h", "begin", "end").union(spans.where("a IS NULL").select("k", "h", "begin", "end"))
    # each begin's longest span is enough; rows of equal id and text are one document
    own = later.groupBy("k", "h").agg(F.collect_set(F.struct("begin", "end")).alias("s"))
    by = Window.partitionBy("k", "h").orderBy("begin", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = own.select("k", "h", F.inline("s")).withColumn("new", F.coalesce(F.col("begin") > before, F.lit(True)).cast("long"))
    own = own.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.groupBy("k", "h", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return own.groupBy("k", "h").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))


def without(text: Column, runs: Column) -> Column:
    """The text without the bytes of ``runs``. Of a run that begins inside a line and ends with one, the line's end
    stays; of a run that ends a text without a last line feed, the line feed before it goes."""
    data = text.cast("binary")
    feed = lambda at: F.substring(data, at, F.lit(1)) == F.lit(bytearray(b"\n"))  # noqa: E731  at counts from 1
    inner = lambda r: (r["begin"] > 0) & ~feed(r["begin"]) & feed(r["end"])
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"] - inner(r).cast("int")))
    stops = F.concat(F.transform(runs, lambda r: r["begin"]), F.array(F.octet_length(text)))
    rest = F.array_join(F.zip_with(starts, stops, lambda a, b: F.substring(data, a + 1, b - a).cast("string")), "")
    to_end = F.element_at(runs, -1)["end"] == F.octet_length(text)
    return F.when(to_end & ~text.endswith("\n") & rest.endswith("\n"), F.substring(rest, F.lit(1), F.length(rest) - 1)).otherwise(rest)


def n_lines(text: Column) -> Column:
    """How many lines hold a word."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")


def dedup_lines(docs: DataFrame, *, window_lines: int = 3, window_words: int = 50, sentences: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from the text; adds ``n_lines`` and ``n_removed_lines`` (lines
    with a word before, and those deleted), and with ``sentences`` ``n_removed_chars``, since lines can lose a part; they
    are named otherwise where the input has such columns (see ``restored``)."""
    rows, text = numbered(docs), F.col(place(docs, text_col)).cast("string")
    rows = rows.withColumn(place(docs, text_col), text).withColumns({"k": F.col(place(docs, id_col)).cast("long"), "h": F.xxhash64(text)})
    runs = repeated_runs(rows.select("k", "h", F.col(place(docs, text_col)).alias("t")), window_lines=window_lines, window_words=window_words, sentences=sentences)
    found = runs.toDF("rk", "rh", "runs")
    rows = rows.join(found, F.col("k").eqNullSafe(F.col("rk")) & (F.col("h") == F.col("rh")), "left")
    text, runs = F.col(place(docs, text_col)), F.col("runs")
    rows = rows.withColumn("new", F.when(runs.isNull(), text).otherwise(without(text, runs)))
    rows = rows.withColumn("n_lines", F.when(text.isNull(), F.lit(0)).otherwise(n_lines(text)).cast("long"))
    rows = rows.withColumn("n_removed_lines", F.when(runs.isNull(), F.lit(0)).otherwise(F.col("n_lines") - n_lines(F.col("new"))).cast("long"))
    rows = rows.withColumn("n_removed_chars", F.when(runs.isNull(), F.lit(0)).otherwise(F.length(text) - F.length("new")).cast("long"))
    return restored(rows.withColumn(place(docs, text_col), F.col("new")), docs, "n_lines", "n_removed_lines", *["n_removed_chars"] * sentences)

"""Toxicity by a weighted lexicon.

Texts are folded: lower case, full-width forms and look-alike letters of other scripts to Latin ones, digits and signs
inside words to the letters they stand for. An Aho-Corasick automaton finds the lexicon's terms as whole words in one
pass; matches inside an exception phrase don't count. The sum of the weights is divided by a slowly growing function of
the number of words, and a logistic curve turns it into a score from 0 to 1.

Weights are learned from labelled rows: how many toxic and other documents hold each word gives its log-likelihood
ratio, and words whose share in toxic documents can't be chance enter the lexicon beside a short list of general
insults. Counting covers the labelled rows up to ``MAX_LABELLED``, chosen by a hash of their ids (a bounded, documented
sample); the lexicon holds at most ``MAX_TERMS`` terms, so it is broadcast whatever the corpus's size.

Defined cases: a null or empty text has no match and takes the curve's lowest score; repeated ids give one row per
input row; a null id is scored like any other; an empty table gives no rows; without labels the general list is used
with its own weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, durable, numbered, place, restored, slices, small_batches

MAX_LABELLED, MAX_TERMS = 40_000, 4_000

#: General insults, and phrases in which such words are harmless.
GENERAL = "asshole bastard bitch bullshit clown crap cretin disgusting dumbass fool freak idiot idiots imbecile jerk loser losers moron morons pathetic pig scum shit stupid trash vermin worthless arschloch blödmann depp dummkopf idioten schwachkopf trottel versager abschaum connard crétin débile imbécile merde ordure salaud basura estúpido gilipollas idiota imbécil mierda payaso pendejo".split()
EXCEPTIONS = ["trash can", "trash bin", "take out the trash", "idiot proof", "idiot's guide", "clown fish", "class clown", "stupid simple", "pig iron", "guinea pig", "freak accident", "freak of nature", "sore loser"]
GENERAL_WEIGHT = 3.0

#: Look-alikes of Latin letters in Cyrillic and Greek, and signs that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ꜱ": "s"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}

VOWELS = "aeiouáéíóúäöüàèìòùâêîôû"

_gaps = dict.fromkeys("\t\n\v\f\r", " ")
_table = str.maketrans(LOOKALIKES | DIGITS | _gaps | {"l": "i", "\u00a0": " "} | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {c: "" for c in "​‌‍⁠­﻿"})
_ascii_table = str.maketrans(DIGITS | _gaps | {"l": "i"})
_signs = re.compile(r"(?<=[^\W_])[@$!|€+]+(?=[^\W_])")
_any_sign = re.compile(r"[^\W_][@$!|€+]")
_words = re.compile(r"[^\W_]+").findall
_count = re.compile(WORD).findall


def fold(text: str) -> str:
    """The folded text, runs of white space as single spaces. ``l``, ``i`` and ``1`` are one letter: a 1 can stand for
    either."""
    text = text.lower()
    text = text.translate(_ascii_table) if text.isascii() else text.translate(_table)
    if _any_sign.search(text):
        text = _signs.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def masked(term: str) -> set[str]:
    """A folded term and its spellings with an asterisk for one inner vowel, or for all."""
    inner = [i for i, c in enumerate(term) if 0 < i < len(term) - 1 and c in VOWELS]
    one = {term[:i] + "*" + term[i + 1 :] for i in inner}
    return {term, *one, "".join("*" if i in inner else c for i, c in enumerate(term))}


@dataclass
class Lexicon:
    """Folded terms with weights, folded exception phrases, and the curve's slope and intercept."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    slope: float = 1.5
    intercept: float = -3.0

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            for spelling in masked(term) - (self.terms.keys() - {term}):
                out.add_word(spelling, (len(spelling), weight))
        for phrase in self.exceptions:
            p = fold(phrase)
            out.add_word(p, (len(p), None))
        out.make_automaton()
        return out


def load(folded: str, automaton) -> float:
    """The sum of the weights of whole-word matches outside exception phrases; the time is linear in the text and its
    matches, but for sorting these."""
    hits, safe, n = [], [], len(folded)
    for last, (size, weight) in automaton.iter(folded):
        first = last - size + 1
        if (first and folded[first - 1].isalnum()) or (last + 1 < n and folded[last + 1].isalnum()):
            continue
        if weight is None:
            safe.append((first, last))
        else:
            hits.append((first, last, weight))
    if safe:
        # a hit is safe if one of the phrases that begin no later ends no earlier
        safe.sort()
        hits.sort()
        outside, at, reach = [], 0, -1
        for first, last, weight in hits:
            while at < len(safe) and safe[at][0] <= first:
                reach = max(reach, safe[at][1])
                at += 1
            if last > reach:
                outside.append(weight)
        return math.fsum(outside)
    return math.fsum(w for _, _, w in hits)


def normalised(total: float, n_words: int) -> float:
    return total / (1.0 + 0.25 * math.log1p(n_words / 200.0))


def score_of(x: float, slope: float, intercept: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, slope * x + intercept))))


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, *, label_col: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """(k, t, y) of at most ``most`` labelled documents that ``allowed`` (an expression over column k) admits, written to
    the shared folder. Rows of equal id and text are one document, so the bound holds for rows.

    Labels with a null id or label don't count; of several labels of one id the largest does."""
    marks = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & allowed)
    # at most ``most`` rows of a few numbers: bounded, so they may be broadcast
    chosen = F.broadcast(marks.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most))
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.md5(F.coalesce("t", F.lit(""))))
    pairs = texts.join(chosen, "k").select("k", "h").distinct().orderBy(F.xxhash64("k"), "k", "h").limit(most)
    rows = texts.join(F.broadcast(pairs), ["k", "h"]).groupBy("k", "h").agg(F.first("t").alias("t")).join(chosen, "k")
    return durable(rows.select("k", "t", "y"), "labelled")


def learn_lexicon(sample: DataFrame, *, general: list[str] = GENERAL, least: int = 4, chance: float = 14.0, sure: float = 0.75, max_terms: int = MAX_TERMS) -> Lexicon:
    """The lexicon of a labelled sample (k, t, y).

    A word enters if it stands in ``least`` toxic documents or more, a share of ``sure`` of the documents that hold it is
    toxic, and its log-likelihood statistic is ``chance`` or more. Documents of equal text count once.
    """

    def words(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                terms, ys = [], []
                for t, y in zip(part.column("t").to_pylist(), part.column("y").to_pylist()):
                    own = {w for w in _words(fold(t or "")) if len(w) > 2}
                    terms += own
                    ys += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ys, pa.int32())], names=["term", "y"])

    distinct = sample.groupBy(F.md5(F.coalesce("t", F.lit(""))).alias("_h")).agg(F.first("t").alias("t"), F.max("y").alias("y"))
    n, n_toxic = distinct.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    weights = {fold(w): GENERAL_WEIGHT for w in general}
    if n_toxic == 0 or n_toxic == n:
        return Lexicon(weights)
    counts = distinct.select("t", "y").mapInArrow(words, "term string, y int").groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("d"))
    share = n_toxic / n
    b = F.col("d") - F.col("a")
    part = lambda x, rate: F.when(x > 0, x * F.log(x / (F.col("d") * rate))).otherwise(0.0)
    counts = counts.where((F.col("a") >= least) & (F.col("a") >= sure * F.col("d"))).withColumn("g", 2 * (part(F.col("a"), share) + part(b, 1 - share)))
    found = counts.where(F.col("g") >= chance).orderBy(F.desc("g"), "term").limit(max_terms).collect()
    for term, a, d, _ in found:
        weights[term] = max(0.5, math.log((a + 0.5) / (n_toxic + 1)) - math.log((d - a + 0.5) / (n - n_toxic + 1)))
    return Lexicon(weights)


def loads(docs: DataFrame, lexicon: Lexicon, *, columns: list[str]) -> DataFrame:
    """(columns..., x): the normalised load of text column t."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("x", T.DoubleType())])

    def run(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            for part in slices(batch, "t"):
                xs = []
                for t in part.column("t").to_pylist():
                    total = load(fold(t), automaton) if t else 0.0
                    xs.append(normalised(total, len(_count(t))) if total else 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(xs, pa.float64())], names=[*columns, "x"])

    return docs.mapInArrow(run, schema)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit with a weak prior, by Newton steps."""
    data = np.stack([x, np.ones_like(x)], 1)
    w = np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        grad = data.T @ (p - y) + 0.1 * w
        hess = (data * (p * (1 - p))[:, None]).T @ data + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, abs(step).max())  # short steps: the data may be separable
        w -= step
        if abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.1), float(w[1])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, *, label_col: str = "toxic", most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Lexicon and curve from the labelled rows that ``allowed`` admits."""
    sample = labelled_sample(docs, labels, allowed, label_col=label_col, most=most, id_col=id_col, text_col=text_col)
    lexicon = learn_lexicon(sample)
    # two numbers for each of at most ``most`` rows reach the driver
    rows = loads(sample, lexicon, columns=["y"]).toPandas()
    if len(rows) and rows["y"].nunique() > 1:
        lexicon.slope, lexicon.intercept = fit_curve(rows["x"].to_numpy(), rows["y"].to_numpy().astype(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, load, score) for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))
    z = F.lit(lexicon.slope) * F.col("x") + F.lit(lexicon.intercept)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return loads(rows, lexicon, columns=[id_col]).select(id_col, F.col("x").alias("load"), (1 / (1 + F.exp(-z))).alias("score"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose score reaches ``threshold``; columns are kept as they are. Only texts go to Python."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lex = shared.value
        automaton = lex.automaton()
        for texts in batches:
            out = []
            for t in texts:
                t = t.as_py()
                total = load(fold(t), automaton) if t else 0.0
                out.append(score_of(normalised(total, len(_count(t))) if total else 0.0, lex.slope, lex.intercept))
            yield pa.array(out, pa.float64())

    return restored(numbered(docs).where(scores(F.col(place(docs, text_col)).cast("string")) < threshold), docs)

"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, quality, toxicity
from .ann import neighbours
from .common import drop_paths, durable, scratch
from .fertility import fertility
from .line_dedup import dedup_lines
from .mixing import replicate
from .near_dup import near_duplicates
from .pieces import encode_pieces
from .token_blocks import read_tokens, write_tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


#: The share of all documents, best first, that the ranking keeps.
KEPT_SHARE = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility(table(spark, sf_dir, "documents"), {"pieces": PIECES, "bytes": BYTE_BPE})


def op3_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = scratch(spark, "arcs"), scratch(spark, "warcs")
    # these archives are read once and deleted
    archives.write_arcs(table(spark, sf_dir, "pages"), arcs, level="BEST_SPEED")
    archives.convert_arcs(spark, arcs, warcs)
    drop_paths(spark, arcs)
    records = durable(archives.read_warcs(spark, warcs, with_payload=False), "records")
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    out = records.join(responses, "refers_to_id", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date")


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def crc_fold(column: str, parts: int):
    """crc32 of the id as text, mod ``parts``: the folds of labels."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def op6_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality.train(docs, table(spark, sf_dir, "labels"), crc_fold("k", 3) != 1)
    out = quality.keep_best(durable(quality.score(docs, ranker), "ranks"), KEPT_SHARE)
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rank", "kept")


def op7_weighted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_fold("k", 4) != 2)
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "load")


def op8_rans_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return read_tokens(spark, path, with_ids=False)


def op9_poisson_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


def op10_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(spark, sf_dir, "documents"), PIECES)
    listed = lambda c: F.sha2(F.concat_ws(",", F.col(c).cast("array<string>")), 256)
    # spans follow each other, so their ends tell them all; the last is the text's length in bytes
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), listed("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), listed("ends").alias("ends_sha256"), F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("covered_bytes"))


QUERIES = {f.__name__: f for f in (op1_winnowed_line_dedup, op2_tokeniser_fertility, op3_balanced_postings, op4_arc_to_warc, op5_superminhash, op6_bradley_terry, op7_weighted_lexicon, op8_rans_token_blocks, op9_poisson_replication, op10_piece_offsets)}

ORACLES = {
    # all spans that hold one window of the production parameters (3 lines, or fewer that hold 50 words) and end before
    # the next window's end or with it: their union is the set of maximal repeated runs of at least a window
    "op1_winnowed_line_dedup": r"""
WITH raw AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM raw),
y AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM x),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS n, len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) AS words FROM y WHERE bare <> ''),
d AS (SELECT doc_id, text, list(bare ORDER BY n) AS bares, list(pos ORDER BY n) AS ats, count(*) AS units FROM u GROUP BY doc_id, text),
v AS (SELECT *, lead(words, 1) OVER o AS w2, lead(n, 2) OVER o AS n3 FROM u WINDOW o AS (PARTITION BY doc_id, text ORDER BY n)),
s AS (SELECT doc_id, text, n, CASE WHEN words >= 50 THEN n WHEN words + w2 >= 50 THEN n + 1 ELSE n3 END AS last FROM v),
t AS (SELECT *, lead(last) OVER (PARTITION BY doc_id, text ORDER BY n) AS upto FROM s WHERE last IS NOT NULL),
p AS (SELECT doc_id, text, n, unnest(range(last, coalesce(upto, units) + 1)) AS to_n FROM t JOIN d USING (doc_id, text)),
k AS (SELECT doc_id, text, n, ats[n] AS a, ats[to_n] AS b, bares[n : to_n] AS content FROM p JOIN d USING (doc_id, text)),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, n) AS place FROM k),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(a, b + 1)) AS pos FROM r WHERE place > 1),
z AS (SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g.pos IS NULL), '') AS cleaned, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (bare <> '' AND g.pos IS NOT NULL) AS n_removed_lines FROM y LEFT JOIN gone g USING (doc_id, text, pos) GROUP BY doc_id, text)
SELECT d.doc_id, z.cleaned AS text, coalesce(z.n_lines, 0) AS n_lines, coalesce(z.n_removed_lines, 0) AS n_removed_lines FROM documents d LEFT JOIN z ON z.doc_id IS NOT DISTINCT FROM d.doc_id AND z.text = d.text
""",
    "op5_superminhash": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i : i + 2] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op9_poisson_replication": """
WITH d AS (SELECT *, coalesce('s' || source, 'null') AS sk, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS ident FROM documents),
s AS (SELECT sk, sum(coalesce(length(text), 0))::DOUBLE AS size, count(*)::DOUBLE AS n FROM d GROUP BY sk),
z AS (SELECT sk, CASE WHEN size > 0 THEN size ELSE n END AS size, size AS raw FROM s),
r AS (SELECT sk, pow(size, 0.7) / sum(pow(size, 0.7)) OVER () * sum(raw) OVER () / size AS rate FROM z),
p AS (SELECT sk, greatest(1, ceil(rate / 16)) AS parts, rate / greatest(1, ceil(rate / 16)) AS m FROM r),
f AS (SELECT k::DOUBLE AS k FROM range(0, 97) t(k)),
c AS (SELECT sk, parts, k, sum(exp(-m) * pow(m, k) / gamma(k + 1)) OVER (PARTITION BY sk ORDER BY k) AS cdf FROM p, f),
l AS (SELECT sk, any_value(parts)::INT AS parts, list(cdf) AS cdf FROM c GROUP BY sk),
n AS (SELECT d.*, list_sum([len(list_filter(l.cdf, lambda c: c <= ('0x' || substr(md5('mix-1|' || d.ident || '|' || part::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0)) for part in range(1, l.parts + 1)])::INT AS copies FROM d JOIN l USING (sk)),
e AS (SELECT *, unnest(range(1, copies + 1))::INT AS replica FROM n)
SELECT doc_id, text, lang, source, n_chars, replica, substr(md5('mix-1|order|' || ident || '|' || replica::VARCHAR), 1, 16) AS shuffle_key FROM e
""",
}

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import editprint, fim, language, ngramjoin, packing, quality, simhash, sstable, suffixes, toxicity, vectorcodes, warc, wordjoin
from .shared import SPACES, crc32_of, cut, table


def op1_warc(spark, sf_dir):
    """Write a record per page, then read every archive back by its index."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language(spark, sf_dir):
    """Name the language of every document; rows whose crc32 leaves 2 when divided by 4 teach nothing."""
    docs, held_out = table(spark, sf_dir, "documents"), crc32_of("doc_id") % 4 == 2
    net = language.fit(docs.where(~held_out))
    found = language.predict(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_simhash(spark, sf_dir):
    """Fingerprint every document and name its component of linked fingerprints."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_sstable(spark, sf_dir):
    """Write the ids of every document into sorted-string-table shards and read the shards back."""
    shards = sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return sstable.read_shards(shards)


def op8_wordjoin(spark, sf_dir):
    """Encode every document through the global table of its distinct words, and decode it."""
    return wordjoin.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_toxicity(spark, sf_dir):
    """Score every document; rows whose crc32 is a multiple of 5 teach nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc32_of("doc_id") % 5 == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model).withColumnRenamed("toxic_score", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark, sf_dir):
    """Pack every document into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op4_fingerprint(spark, sf_dir):
    """Fingerprint every document and its edited text, compare both and the next document, and name its class of near copies."""
    return editprint.classes(cut(editprint.fingerprints(table(spark, sf_dir, "documents")), "edit-documents"))


def op5_suffixes(spark, sf_dir):
    """Remove every byte of a 200-byte string that starts anywhere else too."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), kept=False).drop("kept")


def op6_quality(spark, sf_dir):
    """Judge every document line by line."""
    return quality.measure(table(spark, sf_dir, "documents")).drop("clean_text", "lost")


def op11_fim(spark, sf_dir):
    """Rearrange every document for filling in its middle, and rebuild its text from the output."""
    found, digest = fim.transform(table(spark, sf_dir, "documents")), lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_codes(spark, sf_dir):
    """Code every vector by exponion search, with the errors of its label and the final codebooks."""
    return vectorcodes.codes(table(spark, sf_dir, "embeddings")).drop("label")


def op13_ngramjoin(spark, sf_dir):
    """Link documents whose sets of five-word shingles are similar, and name their components."""
    return ngramjoin.classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_warc": op1_warc, "op2_language": op2_language, "op3_simhash": op3_simhash, "op4_fingerprint": op4_fingerprint, "op5_suffixes": op5_suffixes, "op6_quality": op6_quality, "op7_sstable": op7_sstable, "op8_wordjoin": op8_wordjoin, "op9_toxicity": op9_toxicity, "op10_packing": op10_packing, "op11_fim": op11_fim, "op12_codes": op12_codes, "op13_ngramjoin": op13_ngramjoin}


def _literals(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(text, '[^{SPACES}]+') AS words FROM d),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, line, regexp_extract_all(line, '[^{SPACES}]+') AS words, length(regexp_replace(line, '[^{quality.SYMBOLS}]', '', 'g')) AS symbols,
             length(regexp_replace(line, '[^|]', '', 'g')) AS bars FROM line),
n AS (SELECT *, len(words) AS n, length(array_to_string(words, '')) AS chars, len(list_distinct(words)) AS kinds FROM m),
j AS (SELECT r, n, line, symbols, chars,
        bars > {quality.MAX_SEPARATORS}e0 * n OR symbols > {quality.MAX_SYMBOLS}e0 * n
        OR n >= {quality.SHORT_LINE} AND (kinds < {quality.MIN_DISTINCT}e0 * n OR upper(line) = line AND lower(line) <> line
                          OR n < {quality.LONG_LINE} AND right(rtrim(line), 1) NOT IN ({_literals(quality.ENDS)}))
        OR n < {quality.LONG_LINE} AND list_bool_or(list_transform([{_literals(quality.BOILERPLATE)}], lambda x: contains(lower(line), x))) AS bad FROM n),
by_line AS (SELECT r, sum(symbols) AS n_symbols, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
                   coalesce(sum(chars) FILTER (NOT bad), 0) AS kept_chars FROM j GROUP BY r),
places AS (SELECT r, words, range(1, len(words) - {quality.WINDOW - 2}) AS starts FROM w),
strung AS (SELECT r, unnest(starts) AS i, unnest(list_transform(starts, lambda i: array_to_string(words[i : i + {quality.WINDOW - 1}], ' '))) AS piece FROM places),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, piece) AS times FROM strung),
cover AS (SELECT DISTINCT r, i + unnest(range({quality.WINDOW})) AS place FROM win WHERE times > 1),
repeated AS (SELECT r, count(*) AS n_repeat_words FROM cover GROUP BY r),
base AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
                CAST(n_dup_lines AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, kept_chars
         FROM w JOIN by_line USING (r) LEFT JOIN repeated USING (r)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (word_chars = 0 OR (word_chars - kept_chars) / word_chars <= {quality.MAX_LOST}e0) AS kept FROM f"""

OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, t, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '{fim.PREFIX}') OR contains(text, '{fim.SUFFIX}') OR contains(text, '{fim.MIDDLE}') OR h3 % 100 >= {fim.REARRANGED} THEN 'plain'
                  WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{fim.PREFIX}' || prefix || '{fim.SUFFIX}' || suffix || '{fim.MIDDLE}' || middle
                        ELSE '{fim.SUFFIX}' || suffix || '{fim.PREFIX}' || prefix || '{fim.MIDDLE}' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256 FROM p"""

def _round(k):
    """Assignment a{k + 1} to the codebooks b{k}, and the codebooks after it."""
    return f"""
a{k + 1} AS MATERIALIZED (SELECT r, part, min(d * {vectorcodes.ENTRIES} + entry) AS m FROM (SELECT r, part, entry, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM c JOIN b{k} USING (part, pos) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, CAST(coalesce((s - ((s % n) + n) % n) // n, y) AS BIGINT) AS y FROM b{k}
       LEFT JOIN (SELECT part, m % {vectorcodes.ENTRIES} AS entry, pos, sum(x) AS s, count(*) AS n FROM c JOIN a{k + 1} USING (r, part) GROUP BY ALL) USING (part, entry, pos))"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding, len(embedding) // {vectorcodes.PARTS} AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (SELECT r, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor({vectorcodes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x
      FROM (SELECT r, w, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, r AS entry, pos, x AS y FROM c WHERE r < {vectorcodes.ENTRIES}),{_round(0)},{_round(1)},{_round(2)},
f AS (SELECT r, string_agg(printf('%02x', m % {vectorcodes.ENTRIES}), '' ORDER BY part) AS code, CAST(sum(m // {vectorcodes.ENTRIES}) AS BIGINT) AS error FROM a3 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256 FROM v JOIN f USING (r)"""

OP13_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACES}]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) BETWEEN 1 AND {ngramjoin.SHINGLE - 1} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {ngramjoin.SHINGLE - 2}), lambda i: array_to_string(w[i : i + {ngramjoin.SHINGLE - 1}], ' ')) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON x = a.r JOIN n b ON y = b.r WHERE 100 * k >= 80 * (a.n + b.n - k)),
reached AS (SELECT r AS x, r AS y FROM d UNION SELECT reached.x, l.y FROM reached JOIN l ON reached.y = l.x),
c AS (SELECT x AS r, min(doc_id) AS component_id FROM reached JOIN d ON d.r = y GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)"""

ORACLE_SQL = {
    "op13_ngramjoin": OP13_SQL,
    "op12_codes": OP12_SQL,
    "op11_fim": OP11_SQL,
    "op6_quality": OP6_SQL,
    "op1_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < p.page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100""",
}

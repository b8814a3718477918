"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, gif, language_model, line_dedup, mixing, near_dup, packing, quality, suffix_dedup, toxicity
from tidelog.llm.common import materialise, table


def remainder(column: str, n: int) -> F.Column:
    """crc32 of an id's text modulo n, by which labelled and training rows are told from held-out ones."""
    return F.crc32(F.col(column).cast("string")) % n


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gif.decode(gif.store(table(spark, sf_dir, "documents")))
    shown = F.element_at("frames", -1)
    # of each colour, the pixels of all frames as each shows them
    bins = F.sequence(F.lit(0), F.size(shown["histogram"]) - 1)
    histogram = F.transform(bins, lambda i: F.aggregate("frames", F.lit(0).cast("long"), lambda s, f: s + f["histogram"][i]))
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("ms="), shown["start_ms"] + shown["delay_ms"]), F.concat(F.lit("hist="), F.concat_ws(",", histogram)))
    return out.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("later_copies")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialise(mixing.sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "sized")
    mixed = mixing.mix_sized(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = materialise(quality.features(table(spark, sf_dir, "documents")), "quality")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    scored = quality.score_features(feats, quality.fit(feats, labels))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2))
    return toxicity.score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_gif, op2_line_dedup, op3_near_dup, op4_suffix_dedup, op5_mixing, op6_packing, op7_quality, op8_language_model, op9_toxicity, op10_exact_dedup)}


OP2_SQL = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS w
         FROM (SELECT doc_id, lines, unnest(range(len(lines) - 2)) AS i FROM docs WHERE len(lines) >= 3)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM each WHERE length(w) > 2),
covered AS (SELECT DISTINCT doc_id, i + d AS i FROM ranked, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
singles AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs),
kept AS (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.i) AS text, count(*) AS n
         FROM singles s ANTI JOIN covered c ON s.doc_id = c.doc_id AND s.i = c.i GROUP BY s.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(d.lines), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS text_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP5_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM by_source),
capped AS (SELECT *, source_size * 3 AS most, source_size * 3 / weight AS ratio FROM ranked),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(most) OVER b AS DOUBLE), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own
           FROM capped WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT own AS level FROM levels WHERE own <= ratio ORDER BY ratio, own LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL OR most <= level * weight THEN CAST(most AS DOUBLE) ELSE level * weight END AS target
            FROM levels LEFT JOIN level ON true),
rates AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rates
"""

OP3_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i + 1:i + 5], ' ')) AS h
             FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.y, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""

OP4_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, md5_number(array_to_string(w[s + 1:s + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM docs WHERE len(w) >= 50)),
shared AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, s, doc_id <> first AS later FROM windows JOIN shared USING (h)),
near AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM hits),
islands AS (SELECT *, sum(CASE WHEN s > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM near),
gone AS (SELECT doc_id, s, least(50, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s) - s, 50)) AS n FROM hits WHERE later)
SELECT i.doc_id, min(i.s) AS start_word, max(i.s) + 50 AS end_word, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS removable
FROM islands i LEFT JOIN gone g ON g.doc_id = i.doc_id AND g.s = i.s GROUP BY i.doc_id, i.island
"""

NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = f"""
WITH docs AS (SELECT doc_id, {NORMAL} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM docs WINDOW w AS (PARTITION BY t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_near_dup": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op5_mixing": OP5_SQL, "op10_exact_dedup": OP10_SQL}

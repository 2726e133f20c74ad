"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat, decontam, fingerprints, html_text, katz, mixing, ngram_join, quality, suffixes, wordpiece


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = fingerprints.version_changes(table(spark, sf_dir, "documents"))
    return changes.withColumns({c: F.array_join(F.transform(c, lambda d: d.cast("string")), ",") for c in ("added", "removed")})


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat.formatted(table(spark, sf_dir, "conversations"))
    return formatted.withColumn("attachments", F.to_json("attachments"))


def _with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, to each message of which an attachment of some kind is added, or a list of typed parts is made of it."""
    n = (F.col("turn") + F.col("conv_id")) % 5
    number = F.concat("conv_id", F.lit("_"), "turn")
    listed = F.concat(F.lit('[{"type": "document", "ref": "d'), number, F.lit('", "size": 3}, {"type": "odd", "b": 1, "a": 2}, {"type": "text", "text": "and that"}]'))
    shown = F.when(n == 0, F.concat("text", F.lit(" ![image: i"), number, F.lit(".png]"))).when(n == 1, F.concat(F.lit("![audio: a"), number, F.lit(".wav 2.5] "), "text")).when(n == 2, F.concat("text", F.lit(" ![document: d"), number, F.lit(" 1e9]"))).when(n == 3, listed).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").withColumn("text", shown)


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over messages that hold parts of every type: tokens and attachments of each conversation."""
    formatted = chat.formatted(_with_parts(spark, sf_dir))
    return formatted.select("conv_id", "n_messages", "n_tokens", F.md5("text").alias("digest"), F.to_json("attachments").alias("attachments"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"chat_parts": chat_parts}


#: DuckDB's ASCII words of a text, as ``tokens`` has them: lower-cased ASCII letters, digits, and any other non-ASCII character.
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10ffff}]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op7_pareto_mixing": """
WITH base AS (SELECT doc_id, source, coalesce(ceil(sqrt(n_chars::DOUBLE)), 0)::BIGINT AS m FROM documents),
s AS (SELECT source, count(*) AS documents, sum(m)::BIGINT AS total, floor(1000 * pow(count(*)::DOUBLE, 0.5))::BIGINT AS weight FROM base GROUP BY source),
r AS (SELECT source, total, (sum(documents) OVER ())::BIGINT AS copies, (sum(weight) OVER (ORDER BY source NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, (sum(weight) OVER ())::BIGINT AS everything FROM s),
d AS (SELECT source, total, (copies * upto) // everything - coalesce(lag((copies * upto) // everything) OVER (ORDER BY source NULLS FIRST), 0) AS due FROM r),
e AS (SELECT base.doc_id, base.source, due, due::DOUBLE * m::DOUBLE / total::DOUBLE AS x, (('0x' || substring(md5(coalesce(base.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM base JOIN d ON base.source IS NOT DISTINCT FROM d.source WHERE total > 0 AND due > 0),
f AS (SELECT *, floor(x)::BIGINT AS certain, x - floor(x) AS p FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) * (1 - p) / p ELSE 'inf'::DOUBLE END, doc_id) AS place, due - sum(certain) OVER (PARTITION BY source) AS room FROM f)
SELECT doc_id, source, certain, (place <= room)::BIGINT AS drawn, certain + (place <= room)::BIGINT AS copies FROM o WHERE certain + (place <= room)::BIGINT > 0""",
        "op1_iblt_fingerprints": f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS k, trim(unnest(ls), ' ') AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
o AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id, p ORDER BY k) AS again FROM l WHERE p <> ''),
d AS (SELECT doc_id, p, again, ('0x' || substring(md5(CASE WHEN again = 1 THEN p ELSE p || chr(10) || again::VARCHAR END), 1, 15))::BIGINT AS digest FROM o),
a AS (SELECT documents.doc_id, coalesce(list(digest ORDER BY digest) FILTER (WHERE digest IS NOT NULL), []) AS ds FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id GROUP BY documents.doc_id),
v AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY digest ORDER BY doc_id) AS before FROM d WHERE again = 1 AND length(p) >= {fingerprints.LONG_CHARS}),
b AS (SELECT doc_id, before FROM (SELECT doc_id, before, count(*) AS n FROM v WHERE before IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, before DESC) = 1),
x AS (SELECT a.doc_id, a.ds, b.before, o.ds AS old, list_filter(a.ds, lambda x: NOT list_contains(o.ds, x)) AS added, list_filter(o.ds, lambda x: NOT list_contains(a.ds, x)) AS removed FROM a LEFT JOIN b ON a.doc_id = b.doc_id LEFT JOIN a o ON o.doc_id = b.before),
y AS (SELECT *, before IS NOT NULL AND 2 * (len(ds) - len(added)) >= least(len(ds), len(old)) AS alike FROM x)
SELECT doc_id, len(ds)::INTEGER AS n_paragraphs, CASE WHEN alike THEN before END AS version_of, CASE WHEN alike THEN array_to_string(added, ',') END AS added, CASE WHEN alike THEN array_to_string(removed, ',') END AS removed FROM y""",
        "op10_chat_format": """
SELECT conv_id, count(*)::INTEGER AS n_messages,
string_agg('<|' || regexp_replace(lower(coalesce(role, 'user')), '[^a-z_]', '_', 'g') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text,
'[]' AS attachments,
sum(2 + len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')))::BIGINT AS n_tokens
FROM conversations GROUP BY conv_id""",
        "chat_parts": """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, text AS t, (turn + conv_id) % 5 AS n, conv_id || '_' || turn AS k FROM conversations),
a AS (SELECT *, CASE n WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 3 THEN 'document' END AS kind, CASE n WHEN 0 THEN 256 WHEN 1 THEN 63 WHEN 3 THEN 1536 ELSE 0 END AS worth FROM m),
b AS (SELECT *, count(kind) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS number FROM a),
c AS (SELECT *, '<|' || kind || ':' || number || '|>' AS mark, CASE n WHEN 3 THEN '{"type": "odd", "b": 1, "a": 2}and that' WHEN 2 THEN t || ' ![document: d' || k || ' 1e9]' ELSE t END AS told FROM b)
SELECT conv_id, count(*)::INTEGER AS n_messages, sum(2 + worth + len(regexp_extract_all(CASE n WHEN 3 THEN '{"type": "odd", "b": 1, "a": 2} and that' ELSE told END, '[^\\s]+')))::BIGINT AS n_tokens,
md5(string_agg('<|' || regexp_replace(lower(role), '[^a-z_]', '_', 'g') || '|>' || chr(10) || CASE n WHEN 0 THEN told || ' ' || mark WHEN 1 THEN mark || ' ' || told WHEN 3 THEN mark || told ELSE told END || '<|end|>' || chr(10), '' ORDER BY turn)) AS digest,
coalesce('[' || string_agg('{"number":' || number || ',"kind":"' || kind || '","ref":"' || CASE n WHEN 0 THEN 'i' || k || '.png' WHEN 1 THEN 'a' || k || '.wav' ELSE 'd' || k END || '","tokens":' || worth || '}', ',' ORDER BY turn) FILTER (WHERE kind IS NOT NULL) || ']', '[]') AS attachments FROM c GROUP BY conv_id""",
        "op3_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT r, doc_id, CASE WHEN len(ws) < {ngram_join.N} THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - {ngram_join.N - 2}), lambda i: array_to_string(ws[i:i + {ngram_join.N - 1}], ' '))) END AS gs FROM w WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT min(doc_id) AS least, list(doc_id) AS ids, any_value(gs) AS gs, len(any_value(gs)) AS n, row_number() OVER () AS k FROM (SELECT doc_id, gs, list_sort(gs) AS key FROM g) GROUP BY key),
x AS (SELECT k, n, unnest(gs) AS gram FROM s),
c AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.gram = b.gram AND a.k < b.k GROUP BY ALL),
p AS MATERIALIZED (SELECT a, b FROM c WHERE c::DOUBLE / (na + nb - c)::DOUBLE >= {ngram_join.THRESHOLD} - 1e-12),
both_ AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
l AS (SELECT s.k, any_value(len(s.ids)) - 1 + coalesce(sum(len(o.ids)), 0) AS links FROM s LEFT JOIN both_ ON s.k = both_.a LEFT JOIN s o ON o.k = both_.b GROUP BY s.k),
m AS MATERIALIZED (SELECT k, least, unnest(ids) AS doc_id FROM s),
e AS MATERIALIZED (SELECT doc_id AS a, least AS b FROM m UNION SELECT least, doc_id FROM m UNION SELECT s.least, o.least FROM both_ JOIN s ON s.k = both_.a JOIN s o ON o.k = both_.b),
t(doc_id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, t.root FROM t JOIN e ON t.doc_id = e.a),
roots AS (SELECT doc_id, min(root) AS root FROM t GROUP BY doc_id),
n AS (SELECT m.doc_id, sum(l.links)::BIGINT AS links FROM m JOIN l ON m.k = l.k GROUP BY m.doc_id)
SELECT d.doc_id, coalesce(roots.root, d.doc_id) AS class_id, coalesce(n.links, 0) AS n_links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN roots ON d.doc_id = roots.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    }

"""The operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, chat, codes, decontaminate, divergence, embed, langid, licenses, lines, pages, quality, secrets, simhash
from marginalia.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def _hex(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(langid.sample(docs.where(~out)))
    return langid.identify(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "literal"), told), ",")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), _hex(base).alias("base_sha256"), F.array_join(F.transform("spans", told), ",").alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(id AS BIGINT) AS turn, CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)"
    )
    chats = chat.format_chats(said.union(probe).withColumn("parts", chat.text_parts(F.col("text"))))
    back = chat.read_back(chats)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _hex(turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), _hex(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = quality.scores(docs, quality.fit(quality.sample(docs, labels)))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= quality.ACCEPT, 1).otherwise(0).alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _hex(F.array_join("ids", ",")).alias("ids_sha256"), _hex(F.col("decoded")).alias("decoded_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = codes.encode(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("entry", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    return codes.label_errors(done).select("vec_id", code.alias("code"), "error", "label_error", F.lit(done.digest).alias("codebooks_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), templates=licenses.BASE + licenses.MORE)
    base = F.filter("matches", lambda m: m["template"] < len(licenses.BASE))
    told = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda m: m["label"]))), ",")
    start = F.transform(base, lambda m: m["start"].cast("long"))
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), told(base).alias("base_labels"), told(F.col("matches")).alias("labels"), score.alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_secret_scan, op3_line_dedup, op4_chat_format, op5_quality, op6_simhash, op7_bpe, op8_decontaminate, op9_embedding_dedup, op10_html_extract, op11_vector_codes, op12_source_divergence, op13_license_scan)
    return {f.__name__: f for f in own}


_DIVERGENCE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS MATERIALIZED (
  SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]+')) AS w FROM d)
), k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30
), l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL
), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL
), f AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM f QUALIFY part = 'pair' OR rank <= 50
"""

_LINES_SQL = """
WITH l AS (
  SELECT doc_id, i - 1 AS ln, x AS raw, trim(x, ' ') AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(d.xs) AS x, unnest(range(1, len(d.xs) + 1)) AS i)
), t AS (
  SELECT line, min(struct_pack(d := doc_id, a := ln)) AS pos FROM l WHERE line <> '' GROUP BY line
), w AS (SELECT line, pos, string_split(line, ' ') AS ws FROM t WHERE len(string_split(line, ' ')) >= 5
), v AS (
  SELECT line, pos, -1 AS slot, line AS key FROM w
  UNION ALL
  SELECT line, pos, s AS slot, array_to_string(list_concat(ws[1:s], ws[s + 2:]), ' ') AS key
  FROM w, LATERAL (SELECT unnest(range(0, len(w.ws))) AS s)
), bs AS (SELECT key, slot, min(pos) AS m FROM v GROUP BY key, slot
), bk AS (SELECT key, min(m) FILTER (slot < 0) AS mf, min(m) FILTER (slot >= 0) AS mv FROM bs GROUP BY key
), n AS (
  SELECT v.line, min(least(bs.m, CASE WHEN v.slot < 0 THEN coalesce(bk.mv, bs.m) ELSE coalesce(bk.mf, bs.m) END)) AS best
  FROM v JOIN bs ON bs.key = v.key AND bs.slot = v.slot JOIN bk ON bk.key = v.key GROUP BY v.line
), f AS (SELECT t.line, least(t.pos, coalesce(n.best, t.pos)) AS first FROM t LEFT JOIN n USING (line)
), k AS (
  SELECT l.doc_id, l.ln, l.raw, l.line = '' OR struct_pack(d := l.doc_id, a := l.ln) <= f.first AS kept
  FROM l LEFT JOIN f USING (line)
)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY ln) FILTER (kept), '') AS text, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_removed
FROM k GROUP BY doc_id
"""

_CHATS_SQL = r"""
WITH s AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + (length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '[', ''))) AS n FROM s
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 8 + 8 + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _licenses_sql() -> str:
    """Every phrase at every place and every block of every notice, without any filter."""
    order, sides = licenses.sides(licenses.BASE + licenses.MORE, {})
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = ", ".join(f"('{s.template.label}', {s.number < len(licenses.BASE)}, {listed(s.sequence)})" for s in sides if s.template.phrase)
    notices = ", ".join(f"('{s.template.label}', {s.need}, {s.stride}, {listed(s.ordered)})" for s in sides if not s.template.phrase)
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents
), p AS (
  SELECT r, label, base, i - 1 AS start, 1.0::DOUBLE AS share
  FROM (SELECT r, label, base, phrase, ws, unnest(range(1, len(ws) - len(phrase) + 2)) AS i FROM d, (VALUES {phrases}) t(label, base, phrase))
  WHERE ws[i] = phrase[1] AND ws[i:i + len(phrase) - 1] = phrase
), b AS (
  SELECT r, label, need, ordered, ws[k * stride + 1:(k + 2) * stride] AS block
  FROM (SELECT *, unnest(range(0, len(ws) // stride + 1)) AS k FROM d, (VALUES {notices}) t(label, need, stride, ordered))
), n AS (
  SELECT r, label, len(list_intersect(ordered, block)) / len(ordered)::DOUBLE AS share FROM b WHERE len(list_intersect(ordered, block)) >= need
), m AS (SELECT r, label, base, start, share FROM p UNION ALL SELECT r, label, false, NULL, share FROM n
), g AS (
  SELECT r, count(*) FILTER (base) AS n, min(start) FILTER (base) AS a, max(start) FILTER (base) AS z, max(share) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al FROM m GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN g USING (r)
"""


def _codes_sql() -> str:
    """Every distance of every round."""
    near = lambda k: f"a{k} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, e := e)) AS best FROM (SELECT r, v.part, e, sum((x - c) * (x - c)) AS d FROM v JOIN c{k} USING (part, i) GROUP BY ALL) GROUP BY ALL)"
    moved = lambda k: f"c{k + 1} AS MATERIALIZED (SELECT part, e, i, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT v.part, best.e AS e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM v JOIN a{k} USING (r, part) GROUP BY ALL) USING (part, e, i))"
    rounds = ", ".join(f"{near(k)}, {moved(k)}" for k in range(codes.ROUNDS))
    return f"""
WITH w AS MATERIALIZED (
  SELECT vec_id, label, len(embedding) // {codes.PARTS} AS n, row_number() OVER (ORDER BY vec_id, embedding) AS r, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), v AS MATERIALIZED (
  SELECT r, k // n AS part, k % n AS i, CAST(floor(CAST(embedding[k + 1] AS DOUBLE) * {codes.SCALE}) AS BIGINT) AS x FROM (SELECT *, unnest(range(0, len(embedding))) AS k FROM w)
), c0 AS MATERIALIZED (SELECT part, r - 1 AS e, i, x AS c FROM v WHERE r <= {codes.ENTRIES}
), {rounds}, {near(codes.ROUNDS)}, t AS (
  SELECT r, string_agg(lower(printf('%02x', best.e)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY r
), s AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, e, i)) AS digest FROM c{codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM w JOIN t USING (r), s
"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; the others are tested against brute force."""
    return {"op3_line_dedup": _LINES_SQL, "op4_chat_format": _CHATS_SQL, "op11_vector_codes": _codes_sql(), "op12_source_divergence": _DIVERGENCE_SQL, "op13_license_scan": _licenses_sql()}

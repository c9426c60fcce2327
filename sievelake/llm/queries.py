"""The registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import cotraining, decontam, fingerprints, jaccard_join, langid, merkle, packing, quality_rules, ranked_search, secret_scan, suffix_dedup, toxicity, warc
from .common import held_out, kept, table

QUERIES: dict = {}
SQL: dict = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def register(key: str, sql: str | None = None):
    def add(build):
        QUERIES[key] = build
        if sql is not None:
            SQL[key] = sql
        return build

    return add


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAM_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT DISTINCT item_id, {_WORDS} AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM items WHERE len(ws) > 0),
starts AS (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM starts),
sizes AS (SELECT DISTINCT k FROM windows),
doc_starts AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, sizes WHERE len(ws) >= k),
doc_windows AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w FROM doc_starts),
found AS (SELECT r, d.k, i, item_id FROM doc_windows d JOIN windows b ON d.k = b.k AND d.w = b.w),
places AS (SELECT r, unnest(range(i, i + k)) AS p FROM found),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM places GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items,
                  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""


@register("op1_decontaminate", DECONTAM_SQL)
def op1(spark, sf_dir):
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("longest")


SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM d),
s AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM w),
m AS (SELECT r, p, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM s),
starts AS (SELECT r, p, coalesce(p - lag(p) OVER o <= 50, false) AS joined FROM m WHERE gone WINDOW o AS (PARTITION BY r ORDER BY p)),
runs AS (SELECT r, p, sum((NOT joined)::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM starts),
spans AS (SELECT r, k, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY r, k),
edges AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before, lead(a) OVER (PARTITION BY r ORDER BY a) AS after FROM spans),
parts AS (SELECT d.r, any_value(d.h) AS h, sum(b - a) AS removed, count(*) AS n_spans,
                 string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a)
                 || substr(any_value(h), 2 * max(b) + 1) AS rest
          FROM edges JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, d.h))) AS kept_sha256
FROM d LEFT JOIN parts USING (r)
"""


@register("op2_suffix_dedup", SUFFIX_SQL)
def op2(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@register("op3_quality_rules")
def op3(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("perplexity")


#: The rank file holds the vocabulary of byte_bpe_50k.json, whose added tokens are read too; both give the same ids.
TOKENIZER = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op4_pack")
def op4(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), *TOKENIZER)


@register("op5_langid")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out("doc_id", 4, 2))
    model = langid.train(docs.where("NOT held_out"))
    return langid.identify(docs, model, carry=("doc_id", "held_out")).drop("spans")


@register("op6_secrets")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ratios = secret_scan.log_ratios(kept(secret_scan.labelled_sample(docs), "tokens"))
    return secret_scan.scan(docs, ratios).drop("found")


@register("op7_toxicity")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).withColumnRenamed("toxic", "label")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model, ("doc_id", "held_out"))


_JACCARD_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"

JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_JACCARD_WORDS} AS ws FROM documents),
g AS (SELECT DISTINCT r, s FROM (
    SELECT r, array_to_string(ws[i:i + 4], ' ') AS s
    FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0))),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS n_both FROM g a JOIN g b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * n_both >= 75 * (a.n + b.n - n_both)),
walk AS (SELECT r AS x, r AS y FROM d UNION SELECT walk.x, e.y FROM walk JOIN e ON walk.y = e.x)
SELECT a.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b.doc_id) AS component_id
FROM walk JOIN d a ON a.r = walk.x JOIN d b ON b.r = walk.y LEFT JOIN n ON n.r = a.r
GROUP BY a.r, a.doc_id
"""


@register("op8_jaccard_join", JACCARD_SQL)
def op8(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@register("op9_cotraining")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5, 0))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).withColumnRenamed("quality", "label")
    return cotraining.classify(docs, labels, ("doc_id", "held_out"))


_QUINTET = "('0x' || substr(sha1(payload), {0}, 10))::BIGINT"
_BASE32 = " || ".join(
    "array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda b: "
    f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((({_QUINTET.format(at)}) >> b) & 31) + 1]), '')"
    for at in (1, 11, 21, 31)
)

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, row_number() OVER () AS r FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, r) AS place,
             first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, r) AS largest FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN largest END AS refers_to
FROM k
"""


@register("op10_warc", WARC_SQL)
def op10(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@register("op11_fingerprints")
def op11(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return f"sha256({' || '.join(_FIELD.format(f'({f})') for f in fields)})"


def _crc32_sql(text: str) -> str:
    """The unsigned crc32 of ASCII text, a step per bit."""
    bits = f"flatten(list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, b: {step}), 4294967295)"


#: Levels of each tree by recursion, the path of each leaf by its runs, then the fold along the path.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql('text')} AS leaf,
         CASE WHEN {_crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 5 = 0
              THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source, 0 AS lv, i, n, leaf AS h FROM l
      UNION ALL
      SELECT source, lv + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i))
      FROM t WHERE n > 1 GROUP BY source, lv, i // 16, n),
sub AS (SELECT source, lv AS top, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i,
               count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, i, n, subroot AS h FROM sub
      UNION ALL
      SELECT lv + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 16, n),
steps AS (
  SELECT l.r, a.lv, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM l JOIN t a ON a.source IS NOT DISTINCT FROM l.source AND a.n > 1 AND a.i = l.i // (16 ** a.lv)::BIGINT
  JOIN t b ON b.source IS NOT DISTINCT FROM a.source AND b.lv = a.lv AND b.i // 16 = a.i // 16 GROUP BY l.r, a.lv
  UNION ALL
  SELECT l.r, sub.top + a.lv, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), ''),
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '')
  FROM l JOIN sub ON sub.source IS NOT DISTINCT FROM l.source JOIN u a ON a.n > 1 AND a.i = sub.i // (16 ** a.lv)::BIGINT
  JOIN u b ON b.lv = a.lv AND b.i // 16 = a.i // 16 GROUP BY l.r, sub.top, a.lv),
folded AS (SELECT r, 0 AS lv, coalesce(altered, leaf) AS h FROM l
           UNION ALL
           SELECT f.r, f.lv + 1, sha256(before || h || after) FROM folded f JOIN steps s ON s.r = f.r AND s.lv = f.lv),
ends AS (SELECT r, arg_max(h, lv) AS h FROM folded GROUP BY r),
proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY lv)) AS p FROM steps GROUP BY r)
SELECT l.doc_id, l.leaf, subroot, u.h AS root, coalesce(p, sha256('')) AS proof_sha256, ends.h AS folded_root,
       ends.h = u.h AS verified
FROM l JOIN sub ON sub.source IS NOT DISTINCT FROM l.source JOIN u ON u.n = 1 JOIN ends USING (r) LEFT JOIN proof USING (r)
"""


@register("op12_merkle_manifest", MERKLE_SQL)
def op12(spark, sf_dir):
    altered = merkle.leaf_of(text=F.translate("text", UPPER, LOWER))
    return merkle.verify(table(spark, sf_dir, "documents"), F.when(merkle.tampered(), altered))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ranked_search.TERM}')"

RANKED_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
x AS (SELECT r, doc_id, ws, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM x),
m AS (SELECT r, doc_id, 10 + (90 * n * big_n) // big_l AS m FROM x, total),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS t FROM x) GROUP BY r, t),
f AS (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, total),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS ts FROM benchmark),
q AS (SELECT q, item_id, unnest(ts) AS t FROM i),
s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY q, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""


@register("op13_ranked_search", RANKED_SQL)
def op13(spark, sf_dir):
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)

"""Registered queries of the operators of this folder, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle_sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLE[name] = oracle_sql
        return fn
    return deco


# --------------------------------------------------------------- 8 URL filter
#: The rules of the query, as its contract gives them.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

OP8_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
s AS (SELECT page_id,
        translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'allow'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'block'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'allow'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM s
"""


@register("op8_url_filter", OP8_SQL)
def op8_url_filter(spark, sf_dir):
    from .url_filter import judge_urls
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


# ------------------------------------------------------------ 5 quality rules
OP5_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
p AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, unnest(generate_series(1, len(w) - 2)) AS g(i)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM p),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM n, unnest([i, i + 1, i + 2]) AS x(j) WHERE k > 1 GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
      FROM l LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > n_words AS f2,
        n_dup_lines >= 2 AND 2 * n_dup_lines >= n_lines AS f3,
        word_chars < 2 * n_words OR word_chars > 20 * n_words AS f4 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
  CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT AS BIGINT) AS failed,
  f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4) AS kept
FROM f
"""


@register("op5_quality_rules", OP5_SQL)
def op5_quality_rules(spark, sf_dir):
    from .rules import apply_policy, ledger
    return apply_policy(ledger(table(spark, sf_dir, "documents")))


# ------------------------------------------------- 7 BPE encoding and decoding
@register("op7_bpe")
def op7_bpe(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from .bpe import encode_documents
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


# --------------------------------------------------------- 1 suffix-array dedup
@register("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from .suffix import dedup_substrings
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------ 10 n-gram Jaccard join
@register("op10_jaccard_join")
def op10_jaccard_join(spark, sf_dir):
    from .jaccard import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


# ------------------------------------------------------------ 2 best-fit packing
@register("op2_pack")
def op2_pack(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# ------------------------------------------------------------------------ 6 PII
@register("op6_pii")
def op6_pii(spark, sf_dir):
    from pyspark.sql import functions as F

    from .pii import KINDS, detect_pii
    found = detect_pii(table(spark, sf_dir, "documents"))

    def listed(spans):
        rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank(s), s["end"], s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"),
                        listed(F.concat("spans", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


# ---------------------------------------------------------------- 3 LM scoring
@register("op3_lm_score")
def op3_lm_score(spark, sf_dir):
    from pyspark.sql import functions as F

    from .ppm import score_documents
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score_documents(table(spark, sf_dir, "documents"), held_out)


# ------------------------------------------------ 9 approximate nearest neighbours
@register("op9_ann")
def op9_ann(spark, sf_dir):
    from .graph_ann import nearest, usable
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


# ------------------------------------------------------------ 4 substring dedup
@register("op4_paragraph_dedup")
def op4_paragraph_dedup(spark, sf_dir):
    from .paragraphs import repeated_paragraphs
    from .passages import repeated_passages
    from .repeats import repeats
    docs = table(spark, sf_dir, "documents")
    found = repeats(docs)
    unit = F.when(F.col("paragraph") == F.col("last"), "line").otherwise("lines")
    return (repeated_paragraphs(docs, found=found).withColumn("unit", unit)
            .unionByName(repeated_passages(docs, found).withColumn("unit", F.lit("passage"))).drop("row_key"))


# ------------------------------------------------------- 11 source divergence audit
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS k,
        1 + CAST((1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (n.n + 2 * v.v) AS BIGINT) AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
ln AS (SELECT lang, sum(n) AS n FROM n GROUP BY lang),
q AS (SELECT lang, term, 1 + CAST((1000000000::HUGEINT * (sum(k) + 2)) // (any_value(ln.n) + 2 * any_value(v.v)) AS BIGINT) AS q
      FROM p JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
          FROM p JOIN q USING (lang, term) WHERE k > 0 AND p > q),
x AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""


@register("op11_source_divergence", OP11_SQL)
def op11_source_divergence(spark, sf_dir):
    from .divergence import source_divergence
    return source_divergence(table(spark, sf_dir, "documents"))


# ------------------------------------------------ 13 conversation structure repair
@register("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    from .repair import damaged, repair_conversations
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


# --------------------------------------------------- 12 token-id / binary output
@register("op12_token_files")
def op12_token_files(spark, sf_dir):
    import uuid

    import public_tokenizers

    from ..session import ensure_checkpoint_dir
    from .token_files import read_token_files, write_token_files
    folder = f"{ensure_checkpoint_dir(spark)}/gleaner-token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder)

"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.bpe import encode
from courtside.llm.collocations import collocations
from courtside.llm.decontaminate import leaks
from courtside.llm.html_text import extract_text
from courtside.llm.line_dedup import dedup_lines
from courtside.llm.manifest import digest_of, folded, proof_digest, proofs
from courtside.llm.near_dups import near_duplicates
from courtside.llm.quality_rules import judge_quality
from courtside.llm.secret_scan import scan_secrets
from courtside.llm.sharding import read_shards, shard_of, with_slots, write_shards
from courtside.llm.token_counts import count_tokens
from courtside.llm.url_filters import judge_urls
from courtside.llm.warc import id_of, read_warc, resolve_revisits, write_warc
from courtside.shared import fresh_path, materialize
from courtside.tables import table

#: The rules of op4.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


#: Tokens that one training sequence holds.
TOKEN_LIMIT = 2048


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_covered", "coverage", F.size("tiles").alias("n_tiles"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_repeated", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("quality") == 0)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    found = resolve_revisits(materialize(read_warc(spark, path).drop("payload"), "warc-headers"))
    return found.select(
        id_of(F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of(F.col("refers_to_id")).cast("long").alias("refers_to")
    )


#: Letters that tampering changes, and what they become.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARDS, SHARD_SEED = 8, 20
SHARD_LAW = "key"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in fields]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf = digest_of(*[F.col(c) for c in fields])
    leaves = docs.select("doc_id", "source", leaf.alias("digest"), F.when(tampered, digest_of(*lower)).alias("tampered"))
    found = proofs(leaves, "source", ["doc_id"]).withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    write_shards(docs, path, shards=SHARDS, seed=SHARD_SEED)
    text, doc_id = F.coalesce("record.text", F.lit("")), F.col("record.doc_id")
    laid = read_shards(spark, path, docs.schema)
    found = with_slots(laid.select("shard", "bucket", "place", doc_id.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), laid)
    return found.select("doc_id", "size", "text_crc32", F.lit(SHARD_LAW).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), shard_of(F.col("doc_id"), SHARDS + 1, SHARD_SEED).alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_bpe, op3_line_dedup, op4_url_filters, op5_html, op6_near_dups, op7_secret_scan, op8_quality_rules, op9_token_counts, op10_warc, op11_merkle_manifest, op12_collocations, op13_sharding)}

_HOST_PATH = r"""
  SELECT page_id,
         lower(regexp_extract(rest, '^[^/?#]*')) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)
"""
#: Base 32 of a SHA-1 ``s`` in hex, digit by digit.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(s, {1 + 10 * i}, 10) AS BIGINT) >> {35 - 5 * j}) & 31)::INT, 1)" for i in range(4) for j in range(8)
)
#: The unsigned CRC-32 of the text ``{0}``, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ord(substr({0}, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


def _merkle_levels(name: str, group: str, levels: int) -> str:
    """Tables {name}1.. of the nodes above those of {name}0(group, p, d), with what stands left and right of each node."""
    out = []
    for k in range(levels):
        run = f"PARTITION BY {group}, p // 16 ORDER BY p"
        out.append(f"""{name}s{k} AS (SELECT *, coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {name}{k}) WHERE n > 1)""")
        out.append(f"{name}{k + 1} AS (SELECT {group}, p // 16 AS p, sha256(string_agg(d, '' ORDER BY p)) AS d FROM {name}s{k} GROUP BY ALL)")
    return ",\n".join(out)


def _folds(digest: str, steps: list[str]) -> str:
    for s in steps:
        digest = f"CASE WHEN {s}.l IS NULL THEN {digest} ELSE sha256({s}.l || {digest} || {s}.r) END"
    return digest


def _merkle_sql(levels: int = 4, upper: int = 2) -> str:
    """Good for 16 ** levels documents of a source and 16 ** upper sources."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    steps = [f"a{k}" for k in range(levels)] + [f"b{k}" for k in range(upper)]
    joins = "".join(f" LEFT JOIN es{k} a{k} ON a{k}.g = e0.g AND a{k}.p = e0.p // {16**k}" for k in range(levels)) + "".join(f" LEFT JOIN ts{k} b{k} ON b{k}.p = e0.g // {16**k}" for k in range(upper))
    tops = " UNION ALL ".join(f"SELECT g, any_value(d) AS d FROM e{k} GROUP BY g HAVING count(*) = 1" for k in range(levels + 1))
    # a group's node that stays alone is carried no further: the first of these tables that has it alone is its subroot
    roots = " UNION ALL ".join(f"SELECT any_value(d) AS d FROM t{k} HAVING count(*) = 1" for k in range(upper + 1))
    return f"""WITH h AS (SELECT doc_id, source, {leaf("text")} AS d, CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS x FROM documents),
e0 AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS p FROM h),
{_merkle_levels("e", "g", levels)},
tops AS ({tops}),
t0 AS (SELECT 0 AS z, g AS p, d FROM tops),
{_merkle_levels("t", "z", upper)},
roots AS ({roots})
SELECT e0.doc_id, e0.d AS leaf, tops.d AS subroot, roots.d AS root, sha256({" || ".join(f"coalesce({s}.l || {s}.r, '')" for s in steps)}) AS proof_sha256,
  {_folds("coalesce(e0.x, e0.d)", steps)} AS folded_root, {_folds("coalesce(e0.x, e0.d)", steps)} = roots.d AS verified
FROM e0 JOIN tops ON tops.g = e0.g CROSS JOIN roots{joins}"""


_GRAMS = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: w[i:i + {m - 1}])) AS g FROM w" for m in (1, 2, 3, 4))
_CUTS = " UNION ALL ".join(f"SELECT lang, g, a, {k} AS k, g[:{k}] AS x, g[{k + 1}:] AS y FROM c WHERE len(g) > {k}" for k in (1, 2, 3))
SQL = {
    "op11_merkle_manifest": _merkle_sql(),
    "op12_collocations": rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]'), lambda x: x <> '') AS w FROM pieces),
f AS (SELECT lang, g, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL),
c AS (SELECT *, array_to_string(g, ' ') AS phrase FROM f WHERE a >= 30 AND len(g) > 1),
cuts AS (SELECT q.lang, q.g, q.a, k, l.a AS l, r.a AS r, 2000000::HUGEINT * q.a // (l.a + r.a) AS score FROM ({_CUTS}) q JOIN f l ON l.lang = q.lang AND l.g = q.x JOIN f r ON r.lang = q.lang AND r.g = q.y),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM cuts),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = c.lang AND len(b.g) > len(c.g) AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * b.a >= 80 * c.a)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, best.a DESC, phrase) AS rank, phrase, best.a AS a, l, r, score FROM best JOIN kept USING (lang, g) WHERE nth = 1)
SELECT lang, rank, phrase, a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang) USING (lang) WHERE rank <= 2000
""",
    "op4_url_filters": f"""
WITH u AS ({_HOST_PATH}),
r(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
m AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
""",
    # pages with one article element without frames of its own, as the given ones are
    "op5_html": r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '</?(p|h1|br)>', ' ', 'g') AS t FROM pages
),
b AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;?', '&', 'g') AS t FROM a
)
SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS n_chars FROM b
""",
    "op6_near_dups": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS s FROM p),
b AS (
  SELECT page_id, payload_bytes, s,
         {_BASE32} AS payload_digest
  FROM d
),
k AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS keep_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep_id THEN NULL ELSE keep_id END AS refers_to
FROM k
""",
}

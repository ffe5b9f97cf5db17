"""Registered queries of the subpackage: one ``opN_<name>`` per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.common import table
from tabsight.llm.cover_tree import embedding_links
from tabsight.llm.decontamination import contaminated
from tabsight.llm.hard_negatives import hard_negatives, whole_vector
from tabsight.llm.language_id import held_out, identify, learn
from tabsight.llm.license_scan import scan
from tabsight.llm.minhash import near_duplicates
from tabsight.llm.packing import pack
from tabsight.llm.periodic_runs import periodic_runs
from tabsight.llm.sharding import shard_documents
from tabsight.llm.suffix_dedup import remove_repeats
from tabsight.llm.toxicity import toxicity
from tabsight.llm.url_filter import evaluate, host_of, intervals
from tabsight.llm.warc import read_packages, write_packages


def tokenizer_path() -> str:
    """The vocabulary that the queries pack with."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(write_packages(table(spark, sf_dir, "pages"))).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("left", "kept_text")


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch times and dated entries are derived from all pages: a page is fetched ``page_id`` mod 365 days
    after the epoch's 20,000th day; every page names its host (odd crc32) or domain as listed or delisted on
    day crc32 mod 12 of a month."""
    day = lambda n: F.timestamp_seconds((F.lit(20_000) + n) * 86_400)
    host = host_of(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day(F.col("page_id") % 365).alias("fetched_at"),
                                                 host.alias("host"), F.crc32(host.cast("binary")).alias("c"))
    domain = F.regexp_extract("host", r"[^.]+\.[^.]+$", 0)
    code = F.crc32(F.concat_ws("/", "host", (F.col("page_id") % 12).cast("string")).cast("binary"))
    entries = pages.filter("host <> ''").select(
        F.when(F.col("c") % 3 == 0, "spam").otherwise("adult").alias("list"),
        F.when(code % 16 == 0, domain).otherwise(F.col("host")).alias("pattern"),
        day((F.col("page_id") % 12) * 30).alias("at"), (code % 4 == 0).alias("listed"))
    return evaluate(pages, intervals(entries, day(F.lit(400)))).withColumn(
        "fetched_at", F.unix_timestamp("fetched_at"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(vec_id, label.alias("label"), whole_vector(F.col("embedding")).alias("vec"))
    return hard_negatives(vectors, vec_id % 100 == 0)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"))
    model = learn(docs.filter(~apart).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model, reject=False).select(
        "doc_id", apart.alias("held_out"), "lang_pred", "score", "distance", "foreign")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by crc32 of the id, gets a periodic rest before its runs are sought."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = F.expr("""array_join(transform(sequence(0, size(words) - 1),
        i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')""")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("a", F.expr("g % nullif(size(words), 0)")).withColumn(
        "p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    text = F.when(F.size("words") > 0, planted).otherwise(F.col("text"))
    runs = periodic_runs(docs.select("doc_id", text.alias("text")))
    best = F.col("strongest")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
        best.period.alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_hash_tree": op6_hash_tree,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_cover_tree": op8_cover_tree,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language_id": op12_language_id,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
             m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY s, n) ELSE page_id END AS rep FROM d)
        SELECT page_id, n AS payload_bytes, s AS payload_digest,
               CASE WHEN rep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN rep <> page_id THEN rep END AS refers_to
        FROM m""",
    # crc32 by its table: 256 remainders of the reflected polynomial, then one look-up a byte.
    "op9_url_filter": """
        WITH RECURSIVE steps AS (
            SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
            UNION ALL
            SELECT i, xor(v >> 1, (v & 1) * 3988292384), k + 1 FROM steps WHERE k < 8),
        remainders AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
        fetched AS (
            SELECT page_id, (20000 + page_id % 365) * 86400 AS moment,
                   regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''),
                       '(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS host
            FROM pages),
        named AS (
            SELECT DISTINCT host, page_id % 12 AS m, hex(encode(host)) AS hx, hex(encode(host || '/' || (page_id % 12))) AS mx
            FROM fetched WHERE host <> ''),
        bytes AS (
            SELECT host, m, list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT) AS hb,
                   list_transform(range(1, length(mx), 2), lambda i: ('0x' || substr(mx, i, 2))::BIGINT) AS mb
            FROM named),
        codes AS (
            SELECT host, m,
                   xor(list_reduce(list_prepend(4294967295, hb), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS c,
                   xor(list_reduce(list_prepend(4294967295, mb), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS code
            FROM bytes, remainders),
        entries AS (
            SELECT CASE WHEN c % 3 = 0 THEN 'spam' ELSE 'adult' END AS list,
                   CASE WHEN code % 16 = 0 THEN regexp_extract(host, '[^.]+\\.[^.]+$') ELSE host END AS pattern,
                   (20000 + m * 30) * 86400 AS moment, code % 4 = 0 AS listed
            FROM codes WHERE m IS NOT NULL),
        dated AS (SELECT list, pattern, moment, bool_and(listed) AS listed FROM entries GROUP BY ALL),
        runs AS (
            SELECT *, coalesce(lead(moment) OVER (PARTITION BY list, pattern ORDER BY moment), 20400 * 86400) AS until FROM dated),
        hits AS (
            SELECT f.page_id, f.host, f.moment, count(DISTINCT r.list) AS n_lists,
                   max(struct_pack(n := length(r.pattern), p := r.pattern)) AS best
            FROM fetched f JOIN runs r ON r.listed AND f.moment >= r.moment AND f.moment < r.until
                 AND (f.host = r.pattern OR ends_with(f.host, '.' || r.pattern))
            WHERE f.host <> '' GROUP BY ALL)
        SELECT f.page_id, f.host, f.moment AS fetched_at, h.n_lists IS NOT NULL AS blocked,
               coalesce(h.n_lists, 0) AS n_lists, h.best.p AS pattern
        FROM fetched f LEFT JOIN hits h
             ON f.page_id IS NOT DISTINCT FROM h.page_id AND f.host = h.host AND f.moment = h.moment""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   list_dot_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
        p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
}

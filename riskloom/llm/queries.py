"""Queries of the training-data operators over the whole test tables, and their SQL where there is any."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    fingerprints, language, owners, pagetext, phrases, pieces, quality, ranked, repeats, reputation, sharding,
    tokenfiles, toxicity)
from riskloom.llm.common import crc_of_id
from riskloom.staging import staging_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return fingerprints.near_components(marked).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score_texts(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in the flat files that a tokenising job writes."""
    folder = f"{staging_root(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = tokenfiles.write_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), folder)
    counts = tokenfiles.token_counts(manifest.select("file"), end=2)
    return manifest.join(counts, ["file", "doc"]).select(F.col("key").alias("doc_id"), "n_tokens", "ended")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners.exact_owners(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


#: Fixed values of the contract.
URL_RULES = [
    reputation.Rule("allow", "org", "/"), reputation.Rule("block", "example.org", "/es/"),
    reputation.Rule("block", "example.org", "/en/1"), reputation.Rule("allow", "com", "/fr/"),
    reputation.Rule("block", "com", "/de/"),
]


def op11_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the quality that ``labels`` gives under their id."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = reputation.judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)
    return judged.withColumn("reputation", F.round("reputation", 6))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of every tenth document, by the crc32 of its id, end in a period of their own."""
    h = crc_of_id("doc_id")
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    a = F.pmod(F.col("g"), n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(F.col("g"), F.lit(8)))).cast("long")
    tailed = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    marked = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn(
        "words", F.when(F.size("words") > 0, F.col("words")))
    return marked.withColumns({"a": F.when(F.col("words").isNotNull(), a), "p": F.when(F.col("words").isNotNull(), p)}).select(
        "doc_id", F.when(F.col("words").isNotNull(), F.array_join(tailed, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.collapse_runs(with_tails(table(spark, sf_dir, "documents")))
    # Runs come by start, then period, so the first of equal exponents stays.
    best = F.aggregate(
        "runs", F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda b, x: F.when(b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"]), x).otherwise(b))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_html": op5_html,
    "op6_quality": op6_quality,
    "op7_language_model": op7_language_model,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_host_reputation": op11_host_reputation,
    "op12_ranked_search": op12_ranked_search,
    "op13_periodic_runs": op13_periodic_runs,
}


def _level(name: str, units: str, prior: str, parent: str = "") -> str:
    """SQL of one level: ``units`` with the prior mean, its moment strength, and its posterior."""
    return f"""
        {name}_prior AS (SELECT u.*, {prior} AS prior FROM ({units}) u {parent}),
        {name}_rho AS (
            SELECT greatest(least(coalesce(
                       sum((good - trials * prior) * (good - trials * prior) - trials * prior * (1 - prior))
                       / nullif(sum(trials * (trials - 1) * prior * (1 - prior)), 0), 1e-4), 0.5), 1e-4) AS rho
            FROM {name}_prior WHERE trials > 0),
        {name}_beta AS (
            SELECT p.*, good + (1 - rho) / rho * prior AS a, trials - good + (1 - rho) / rho * (1 - prior) AS b
            FROM {name}_prior p, {name}_rho),
        {name} AS (
            SELECT *, a / (a + b) AS mean,
                   a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM {name}_beta)"""


def _sums(table: str, *keys: str) -> str:
    return (f"SELECT {', '.join(keys)}, sum(trials)::DOUBLE AS trials, sum(good)::DOUBLE AS good FROM {table} "
            f"GROUP BY {', '.join(keys)}")


def _last(n: int) -> str:
    return f"CASE WHEN len(p) <= {n} THEN name ELSE array_to_string(p[-{n}:], '.') END"


_DOUBLE = f"({_last(2)}) IN ({', '.join(repr(x) for x in reputation.SUFFIXES)})"
_WHOLE = r"(len(p) = 1 OR regexp_matches(name, '^[0-9.]+$|^\['))"
_RULES = sorted(URL_RULES, key=lambda r: -len(r.text))


def _by_rule(what: str) -> str:
    return "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
        f"THEN '{getattr(r, what)}'" for r in _RULES) + " END"


ORACLES = {
    "op11_host_reputation": rf"""
        WITH parsed AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                                      '{reputation.UPPER}', '{reputation.LOWER}') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        marks AS (
            SELECT doc_id, count(*) AS trials, sum(quality) AS good FROM labels
            WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
        counted AS (
            SELECT host, coalesce(sum(trials), 0)::DOUBLE AS trials, coalesce(sum(good), 0)::DOUBLE AS good
            FROM parsed LEFT JOIN marks ON doc_id = page_id GROUP BY host),
        named AS (
            SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\.+$', '', 'g') AS name FROM counted),
        split AS (SELECT *, string_split(name, '.') AS p FROM named),
        hosts AS (
            SELECT host, trials, good,
                   CASE WHEN {_WHOLE} THEN name WHEN {_DOUBLE} THEN {_last(2)} ELSE {_last(1)} END AS suffix,
                   CASE WHEN {_WHOLE} THEN name WHEN {_DOUBLE} THEN {_last(3)} ELSE {_last(2)} END AS domain
            FROM split),
        {_level("tops", _sums("hosts", "suffix"), "(SELECT (sum(good) + 0.5) / (sum(trials) + 1) FROM hosts)")},
        {_level("domains", _sums("hosts", "suffix", "domain"), "t.mean", "JOIN tops t USING (suffix)")},
        {_level("judged", "SELECT * FROM hosts", "d.mean", "JOIN domains d USING (domain)")}
        SELECT page_id, host, path, {_by_rule("text")} AS rule,
               coalesce({_by_rule("action")}, CASE WHEN bound >= 0.8 THEN 'allow' ELSE 'block' END) AS verdict,
               round(mean, 6) AS reputation, trials::BIGINT AS n_labelled
        FROM parsed JOIN judged USING (host)""",
    "op12_ranked_search": r"""
        WITH plain AS (
            SELECT doc_id AS id, true AS doc, text FROM documents
            UNION ALL SELECT item_id, false, text FROM benchmark),
        words AS (
            SELECT id, doc, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM plain),
        totals AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM words WHERE doc AND len(w) > 0),
        counts AS (
            SELECT id, doc, n, term, count(*) AS tf
            FROM (SELECT id, doc, len(w) AS n, unnest(w) AS term FROM words) GROUP BY id, doc, n, term),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM counts, totals WHERE doc GROUP BY term, docs),
        scored AS (
            SELECT i.id AS item_id, d.id AS doc_id,
                   sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * d.n * docs) // terms))))::BIGINT
                       AS score
            FROM counts i JOIN counts d ON d.term = i.term AND d.doc AND NOT i.doc
            JOIN weights ON weights.term = i.term, totals GROUP BY i.id, d.id),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
            FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20""",
    "op9_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS words FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(words) AS text_sha256
        FROM texts WINDOW same AS (PARTITION BY words)""",
    "op10_decontamination": r"""
        WITH plain AS (
            SELECT doc_id AS id, true AS doc, text FROM documents
            UNION ALL SELECT item_id, false, text FROM benchmark),
        words AS (
            SELECT id, doc, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM plain),
        items AS (SELECT id, w, least(len(w), 13) AS n FROM words WHERE NOT doc AND len(w) > 0),
        wanted AS (
            SELECT DISTINCT id, n, list_slice(w, i, i + n - 1) AS win
            FROM items, unnest(range(1, len(w) - n + 2)) AS t(i)),
        sizes AS (SELECT DISTINCT n FROM items),
        present AS (
            SELECT d.id AS doc_id, n, i, list_slice(w, i, i + n - 1) AS win
            FROM words d, sizes, unnest(range(1, len(d.w) - n + 2)) AS t(i) WHERE d.doc),
        found AS (SELECT doc_id, i, p.n, b.id AS item_id FROM present p JOIN wanted b USING (n, win)),
        hits AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM found, unnest(range(i, i + n)) AS t(pos) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT w.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM words w LEFT JOIN hits h ON h.doc_id = w.id LEFT JOIN named m ON m.doc_id = w.id WHERE w.doc""",
}

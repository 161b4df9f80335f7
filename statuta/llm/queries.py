"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import chat, decontaminate, langid, packing, periodic, pii, quality, sharding, simhash, spelling, tokencounts, urlfilter, warc
from statuta.llm.common import fresh_path, stash, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), packing.public_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


URL_RULES = [
    urlfilter.UrlRule("allow", "com/"), urlfilter.UrlRule("block", "example.com/en/"), urlfilter.UrlRule("allow", "www.example.com/en/"),
    urlfilter.UrlRule("block", "net/es/"), urlfilter.UrlRule("block", "net/fr/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: inserts under two tokenizers, of which the second's counts are words at
    first; revised counts by the real tokenizer; deletes of texts below ten words; and the second batch sent again."""
    docs, bpe = table(spark, sf_dir, "documents"), packing.public_tokenizer()
    docs = docs.select("source", "lang", tokencounts.word_count(F.col("text")).alias("words"), tokencounts.bpe_count(F.col("text"), bpe).alias("ids"))
    docs = stash(docs, "token-counts")
    of = lambda name, n: tokencounts.state(F.col("source"), F.col("lang"), F.lit(name), F.col(n))
    store = tokencounts.TokenTotals(spark, fresh_path(spark, "token-totals"))
    first = docs.select(*tokencounts.change("insert", after=of("words-1", "words")))
    store.commit("inserts", first.unionByName(docs.select(*tokencounts.change("insert", after=of("byte_bpe_50k", "words")))))
    revised = docs.where("words <> ids").select(*tokencounts.change("revise", of("byte_bpe_50k", "words"), of("byte_bpe_50k", "ids")))
    store.commit("revised", revised)
    store.compact()
    few = docs.where("words < 10")
    store.commit("deletes", few.select(*tokencounts.change("delete", of("words-1", "words"))).unionByName(few.select(*tokencounts.change("delete", of("byte_bpe_50k", "ids")))))
    store.commit("revised", revised)
    return store.totals()


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = [m.rule for m in quality.plan(docs, ready=quality.BASE)]
    told = docs.select("doc_id", quality.judge(F.col("text"), rules).alias("q"))
    return told.select("doc_id", *(f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))  # asked, the number of rules that ran, depends on the order


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.fold(F.col("doc_id")) == 0)
    profiles = langid.learn(docs.where("not held_out"))
    told = docs.select("doc_id", "held_out", langid.predict(F.col("text"), profiles).alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(f"contamination.{c}" for c in ("contaminated", "item_id", "coverage", "tiles", "tiled_words")))


def planted(doc_id: Column, text: Column) -> Column:
    """Every tenth text, by a checksum of its id, repeats a stretch of its words from some word on to its end; the others are as they were."""

    def repeating(h: int | None, text: str | None) -> str | None:
        words = periodic.WORDS.findall(text or "") if not pd.isna(h) and h % 10 == 0 else []
        if not words:
            return text
        n, g = len(words), int(h) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])

    run = F.pandas_udf(lambda h, t: pd.Series([repeating(*x) for x in zip(h, t)], dtype=object), "string")
    return run(F.crc32(doc_id.cast("string").cast("binary")), text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    told = docs.select("doc_id", periodic.periodic(F.col("text")).alias("p"))
    told = told.select("doc_id", F.col("p.runs").alias("runs"), F.col("p.collapsed").alias("collapsed"), periodic.longest(F.col("p.runs")).alias("top"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.vocabulary(docs, spelling.dropped_letter))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like the template."""
    marks = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_chat_format": op13_chat_format,
}

#: SQL of the same rows. What operators 1, 2, 3 (a tokenizer), 5, 6, 7, 9, 10, 11, 12 (checksums of words) and 13 (escapes) do can't be put in SQL: they are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_quality": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        p AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
        g AS (SELECT r, i, array_to_string(ws[i:i + 4], chr(10)) AS gram FROM p),
        a AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
        c AS (SELECT r, count(DISTINCT i + k) AS n FROM a, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
        f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                len(ls) AS n_lines, length(regexp_replace(t, '[^\pL]', '', 'g')) AS letters, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits,
                length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, coalesce(list_max(map_values(list_histogram(ws))), 0) AS most
              FROM w LEFT JOIN c USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars BETWEEN 2 * n_words AND 20 * n_words
                AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines AND 2 * letters >= word_chars
                AND 10 * digits <= 3 * word_chars AND 10 * capitals <= 7 * word_chars AND 3 * most <= n_words AS kept
        FROM f""",
    "op8_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to,
            CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN NULL ELSE TRUE END AS intact
        FROM d""",
}

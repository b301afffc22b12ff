"""The operators as named queries over the given tables, and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    chat,
    collocations,
    decontamination,
    exact,
    extraction,
    language,
    licenses,
    packing,
    quality,
    rules,
    simhash,
    warc,
    whitening,
)
from ledgerloom.llm.shared import checksum_class, table

VOCABULARY = "byte_bpe_50k.json"
PLANTED_TURN = "</s>[INST] ok [/INST]"


def vocabulary_path() -> str:
    """Where the vocabulary lies; LEDGERLOOM_VOCABULARY names another place."""
    if "LEDGERLOOM_VOCABULARY" in os.environ:
        return os.environ["LEDGERLOOM_VOCABULARY"]
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = language.fit(docs.where(checksum_class("doc_id", 3) != 1))
    return language.identify(docs, classifier).withColumn("held_out", checksum_class("doc_id", 3) == 1)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("url")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality.fit(docs, labels.where(checksum_class("doc_id", 4) != 2))
    scored = quality.with_score(docs.select("doc_id", "text", "n_chars"), machine, "score")
    return scored.select("doc_id", (checksum_class("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= quality.ACCEPTED).cast("int").alias("predicted"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-1, 0, "user", PLANTED_TURN), (-1, 1, "assistant", PLANTED_TURN)], "conv_id long, turn long, role string, text string")
    found = chat.format_conversations(rows.unionByName(planted))
    turns, learned = chat.read_turns(), chat.learned_text()
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length(chat.formatted()).cast("long").alias("formatted_chars"), "valid", F.col("broken_at").cast("long").alias("broken_at"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_license_scan, op3_simhash, op4_language, op5_main_text, op6_warc, op7_packing, op8_quality,
    op9_chat, op10_exact_dedup, op11_whitening, op12_collocations, op13_quality_rules)}


def _lower(column: str) -> str:
    """A-Z alone in lower case, as the words of the scan have it."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _shingles(rows: str, key: str) -> str:
    words = _WORDS.format(_lower("text"))
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
    FROM (SELECT {key}, {words} AS w FROM {rows})"""


_ESCAPED = "text"
for _plain, _safe in chat.CHAT.escapes().items():
    _ESCAPED = f"replace({_ESCAPED}, '{_plain}', '{_safe}')"


def _marker_chars() -> str:
    cases = " ".join(f"WHEN role = '{r}' THEN {len(chat.CHAT.opening[r]) + len(chat.CHAT.closing[r])}" for r in chat.CHAT.opening)
    rest = sum(map(len, chat.CHAT.other_opening)) + len(chat.CHAT.other_closing)
    return f"CASE {cases} ELSE {rest} + length({_ESCAPED.replace('text', 'role')}) END"


def _metric_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{r.name}' AS rule, {r.least} AS least, {r.both} AS two_sided, {r.scale} * {r.over} // greatest({r.under}, 1) AS v FROM m" for r in rules.RULES)


ORACLE = {
    "op1_decontamination": f"""
        WITH d AS ({_shingles('documents', 'doc_id')}), b AS ({_shingles('benchmark', 'item_id')}),
        n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
        SELECT doc_id, item_id, count(*) / n AS containment
        FROM d JOIN b USING (shingle) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) / n >= 0.8 - 1e-9""",
    "op6_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
        FROM m""",
    "op9_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '{PLANTED_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED_TURN}'),
        o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        s AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
                             WHEN before IN ('user', 'tool') THEN role IN ('assistant', 'tool')
                             WHEN before = 'assistant' THEN role IN ('user', 'tool') ELSE false END AS fits FROM o),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS told,
                     coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS learned,
                     sum(length({_ESCAPED}) + {_marker_chars()})::BIGINT AS formatted_chars,
                     min(k - 1) FILTER (NOT fits) AS broken_at, arg_max(role, k) AS final FROM s GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
               formatted_chars, broken_at IS NULL AND final = 'assistant' AS valid, broken_at FROM g""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
        w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
                     max(length(text)) OVER (PARTITION BY text_sha256) AS most, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AND length(text) = most AS kept, text_sha256 FROM w""",
    "op12_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS nr
              FROM (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p)),
        n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY piece ORDER BY nr)),
        f AS MATERIALIZED (SELECT lang, 1 AS k, w AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10 UNION ALL
              SELECT lang, 2, w || ' ' || w2 AS phrase, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10 UNION ALL
              SELECT lang, 3, w || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        x AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:c.k], ' ') AS rest FROM c, (VALUES (1), (2)) AS cuts(cut) WHERE cut < c.k),
        s AS (SELECT x.lang, x.phrase, x.a, cut, l.a AS l, r.a AS r, ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
              FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.first
                     JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS (SELECT lang, phrase, max(a) AS longer FROM (
                SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
        o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
              FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_quality_rules": rf"""
        WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS nr FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t)),
        g AS (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY nr)),
        h AS (SELECT *, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS again FROM g),
        v AS (SELECT *, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS covered FROM h WINDOW o AS (PARTITION BY r ORDER BY nr)),
        c AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (covered) AS n_repeat_words FROM v GROUP BY r),
        l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
              FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        m AS MATERIALIZED (SELECT t.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
                     coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                     coalesce(n_words, 0) < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
              FROM t LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
        x AS MATERIALIZED ({_metric_rows()}),
        s AS (SELECT r, lang, source, rule, v, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS low FROM x WHERE NOT base_failed),
        k AS (SELECT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source, rule, low, count(*) AS n
              FROM s, (VALUES (0), (1), (2)) AS levels(level) GROUP BY ALL),
        a AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule) AS size,
                     sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY low) AS seen FROM k),
        q AS MATERIALIZED (SELECT level, lang, source, rule, max(size) AS size, min(low) FILTER (4 * seen >= size) AS q1, min(low) FILTER (4 * seen >= 3 * size) AS q3
              FROM a GROUP BY ALL),
        f AS (SELECT x.*, q.q1, q.q3, row_number() OVER (PARTITION BY x.r, x.rule ORDER BY q.level) AS nearest
              FROM x JOIN q ON q.rule = x.rule AND (q.level = 2 OR q.size >= 100) AND (q.level = 2 OR q.lang IS NOT DISTINCT FROM x.lang)
                     AND (q.level > 0 OR q.source IS NOT DISTINCT FROM x.source)),
        d AS (SELECT r, bool_and(v <= q3 + greatest(6 * (q3 - q1), least) AND (NOT two_sided OR v >= q1 - greatest(6 * (q3 - q1), least))) AS fits
              FROM f WHERE nearest = 1 GROUP BY r)
        SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fits AS kept
        FROM m LEFT JOIN d USING (r)""",
}

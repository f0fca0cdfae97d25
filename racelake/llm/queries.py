"""The operators bound to the test tables: each query applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from racelake.llm import (
    chat,
    interactions,
    interpolation,
    jaccard,
    language,
    lines,
    mixing,
    neighbours,
    pieces,
    quality,
    repair,
    repeats,
    streams,
    toxicity,
)
from racelake.llm.workers import library_on_path
from racelake.sources.scratch import stable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            library_on_path(spark)
            return function(spark, folder)

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(parts: int) -> Column:
    """Whether crc32 of the id as text leaves 2; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 2, F.lit(False))




_WORDS = r"'[^\x20\x09-\x0D]+'"
_STOP = rf"'(?i)[^\p{{L}}\p{{N}}]*(?:{'|'.join(sorted(set(quality.STOP_WORDS)))})[^\p{{L}}\p{{N}}]*'"


def _broken_sql() -> str:
    """The rule table as a SQL list of the names of broken rules."""
    parts = []
    for rule in quality.RULES:
        value = f"(CASE WHEN {rule.per} > 0 THEN {rule.of}::DOUBLE / {rule.per} ELSE 0 END)" if rule.per else rule.of
        checks = [f"{value} < {rule.least}"] if rule.least is not None else []
        checks += [f"{value} > {rule.most}"] if rule.most is not None else []
        parts.append(f"CASE WHEN {' OR '.join(checks) or 'false'} THEN '{rule.name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


@query(
    rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
grams AS (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS gram,
           unnest(range(1, len(w) - 6)) AS pos
    FROM w WHERE len(w) >= 8),
twice AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams),
spans AS (
    SELECT doc_id, least(8, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 8)) AS part
    FROM twice WHERE n >= 2),
repeats AS (SELECT doc_id, sum(part)::BIGINT AS n FROM spans GROUP BY doc_id),
l AS (
    SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS l
    FROM documents),
m AS (
    SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
           len(list_filter(l, lambda x: regexp_matches(x, '^[ \t-\r]*[-*•|]')))::BIGINT AS n_list_lines,
           len(list_filter(w, lambda x: regexp_full_match(x, {_STOP})))::BIGINT AS n_stop_words,
           len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x))::BIGINT AS n_shouted,
           coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM w JOIN l USING (doc_id) LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, {_broken_sql()} AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, broken
FROM b
"""
)
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.apply_rules(documents(spark, folder)).withColumn("broken", F.array_join("broken", ","))
    return judged.select(
        *"doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept broken".split()
    )


@query()
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, folder)).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        "positions",
    )


@query(
    r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, pos, line, (keeper IS NOT NULL AND keeper <> k.doc_id) AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
)
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, folder)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query()
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", held_out(4))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.identify_languages(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query(
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
    SELECT doc_id, unnest(range(1, len(w) - 33)) AS pos,
           unnest(list_transform(range(1, len(w) - 33), lambda k: md5(array_to_string(w[k:k + 34], ' ')))) AS gram
    FROM w WHERE len(w) >= 35),
t AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY gram) AS n FROM g),

x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
last AS (
    SELECT x.doc_id, x.pos, word, max(t.pos) OVER (PARTITION BY x.doc_id ORDER BY x.pos) AS begun
    FROM x LEFT JOIN (SELECT * FROM t WHERE n >= 2) t USING (doc_id, pos)),
m AS (SELECT *, coalesce(begun > pos - 35, false) AS gone FROM last)
SELECT w.doc_id, count(m.pos)::BIGINT AS n_words, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY m.pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN m USING (doc_id) GROUP BY w.doc_id
"""
)
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query()
def op7_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    # Of the training texts, those that leave 3 set the mixture weights.
    scored = interpolation.score_texts(documents(spark, folder), F.coalesce(part != 2, F.lit(True)), part == 3)
    return scored.select("doc_id", held_out(7).alias("held_out"), *scored.columns[1:])


@query()
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(documents(spark, folder))


@query()
def op5_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    encoded = pieces.encode_texts(documents(spark, folder).select("doc_id", "text"))
    whole = pieces.decode_pieces(encoded)
    return whole.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.fit_chain(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


@query()
def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.near_duplicate_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def text_faults(text: Column) -> dict[str, Column]:
    """Conditions A to D of the audit, over whole texts."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    tokens = F.split(trimmed, r"[ \t-\r]+")
    n_words = F.when(trimmed == "", 0).otherwise(F.size(tokens))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(tokens)) < 50 * n_words,
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


@query(
    r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
      FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
           + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
           + 8 * regexp_matches(text, '[#$%&*|]')::INT
           + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
    FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS docs, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
      FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
b AS (SELECT o, step::INT AS step, o[step] AS letter, (1 << (ascii(o[step]) - 65)) AS bit,
             list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(o[k]) - 65)))::INT AS earlier
      FROM s),
r AS (
    SELECT part, o AS filter_order, step, letter AS filter,
           sum(CASE WHEN mask & (coalesce(earlier, 0) | bit) = 0 THEN docs ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0 THEN docs ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mask & coalesce(earlier, 0) <> 0 AND mask & bit <> 0 THEN docs ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = bit THEN docs ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM c, b GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM r
"""
)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    text = F.coalesce("text", F.lit(""))
    # Texts are read once: what goes on is an id, the part, a hash of the text and five flags.
    faults = {f"fails_{letter}": condition for letter, condition in text_faults(text).items()}
    narrow = stable(docs.select("doc_id", "source", *interactions.text_hash(text), *[c.alias(n) for n, c in faults.items()]))
    marked = interactions.with_copies(narrow, "doc_id", "fails_E")
    known = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good_lost"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic_lost"),
    )
    audited = interactions.audit_filters(
        marked.join(known, "doc_id", "left"),
        {letter: F.col(f"fails_{letter}") for letter in "ABCDE"},
        F.col("source"),
        {name: F.col(name) for name in ("good_lost", "toxic_lost")},
    )
    return audited.drop("filter")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/conversations.parquet")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut off, repeated or retitled by a hash of their id and turn; nulls are one space."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    hit = turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )
    return hit.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


@query()
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversations(spark, folder)
    report, repaired = repair.repair_conversations(damaged(turns))
    hashed = streams.digests(repaired, "conv_id", F.concat("role", F.lit(":"), "text"))
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    known = every.join(report, streams.same("id", "conv_id"), "left").drop("conv_id")
    known = known.join(hashed, streams.same("id", "conv_id"), "left")
    return known.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in "gaps blank duplicate truncated illegal cost".split()],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


_TAILS = "|".join(c[1:].replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROLS)
_SAID = "</s>[INST] ok [/INST]"
_AROUND = {name: sum(map(len, pair)) for name, pair in chat.AROUND.items()}


@query(
    rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')),
e AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:{_TAILS})')) AS n,
           length(role) + len(regexp_extract_all(role, '[<\[]\\*(?:{_TAILS})')) AS r
    FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE role WHEN 'user' THEN {_AROUND["user"]} WHEN 'assistant' THEN {_AROUND["assistant"]}
                         ELSE r + {sum(len(c) for c in (chat.ROLE, chat.AFTER_ROLE, chat.END))} END)::BIGINT AS formatted_chars,
       0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id
"""
)
def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(-7, i, role, _SAID) for i, role in enumerate(("user", "assistant"))]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = conversations(spark, folder).select("conv_id", "turn", "role", "text").unionByName(odd)
    typed = turns.withColumn("parts", chat.text_part(F.col("text")))
    return chat.digests(chat.format_conversations(typed), ordered=True)

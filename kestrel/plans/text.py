"""Text function queries (F1–F27) over whole documents, conversations and messages.

The oracle SQL deliberately uses a different formulation from the Spark side (token lists
and list lambdas instead of single regular-expression counts) so the check is independent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.folding import fold_table
from ..functions import text as T
from ..sources.tables import messages, read_table, with_views
from . import register

WS = lx.WS_CLASS


def _sql_list(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{WS}]+'), lambda w: w <> '')"


def _sum_contains(expr: str, words) -> str:
    return " + ".join(f"(CASE WHEN contains({expr}, '{w}') THEN 1 ELSE 0 END)" for w in words)


# Runs of >= 3 equal characters (newline excluded): positions that start such a run.
_CHAR_REP = ("len(list_filter(range(1, len(cs) - 1), lambda i: cs[i] = cs[i+1] AND cs[i] = cs[i+2] "
             "AND cs[i] <> chr(10) AND (i = 1 OR cs[i-1] <> cs[i])))")

_FEATURES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, lower(t) AS lt, {_tokens('t')} AS toks, {_tokens('lower(t)')} AS ltoks,
             string_split(lower(t), '') AS cs FROM d)
SELECT doc_id,
       CAST(length(t) AS BIGINT) AS msg_len,
       CAST(len(toks) AS BIGINT) AS word_count,
       CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / length(t) ELSE 0.0 END AS caps_ratio,
       CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS exclamation_count,
       CAST(length(t) - length(replace(t, '?', '')) AS BIGINT) AS question_count,
       CAST((length(t) - length(replace(t, '...', ''))) // 3 AS BIGINT) AS ellipsis_count,
       CAST(len(list_filter(ltoks, lambda w: w IN ({_sql_list(lx.PERSONAL_PRONOUNS)}))) AS BIGINT) AS personal_pronoun_count,
       CAST({_CHAR_REP} AS BIGINT) AS char_repetition,
       CAST(len(list_filter(toks, lambda w: length(w) > 1 AND upper(w) = w AND lower(w) <> w)) AS BIGINT) AS all_caps_words,
       CAST({_sum_contains('lt', lx.BAD_WORDS)} AS BIGINT) AS slur_count
FROM x"""


@register("f_text_features", _FEATURES_SQL)
def f_text_features(spark, sf_dir):
    """F1–F10 on every document's whole text in one projection."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return T.text_features(d, "text").drop("text")


def _tok_contains_any(terms) -> str:
    cond = " OR ".join(f"contains(w, '{t}')" for t in terms)
    return f"CAST(len(list_filter(ltoks, lambda w: {cond})) AS BIGINT)"


_ALT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, {_tokens('t')} AS toks, {_tokens('lower(t)')} AS ltoks FROM d)
SELECT doc_id,
       CAST(length(t) AS BIGINT) AS msg_len,
       CAST(len(toks) AS BIGINT) AS word_count,
       CASE WHEN len(ltoks) > 0 THEN list_sum(list_transform(ltoks, lambda w: length(w))) / len(ltoks) ELSE 0.0 END AS avg_word_len,
       CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / length(t) ELSE 0.0 END AS caps_ratio,
       CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^!?.,;:]', '', 'g')) / length(t) ELSE 0.0 END AS punctuation_ratio,
       CAST(len(list_filter(string_split(t, ''), lambda c: unicode(c) > 127000)) AS BIGINT) AS emoji_count,
       CAST(len(list_filter(ltoks, lambda w: w IN ({_sql_list(lx.ALT_PRONOUNS)}))) AS BIGINT) AS personal_pronoun_count,
       CAST(length(t) - length(replace(t, '?', '')) AS BIGINT) AS question_mark_count,
       CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS exclamation_count,
       CAST(len(list_filter(toks, lambda w: length(w) > 1 AND upper(w) = w AND lower(w) <> w)) AS BIGINT) AS all_caps_words,
       {_tok_contains_any(lx.KEYWORD_CATEGORIES['slurs'])} AS slur_count,
       {_tok_contains_any(lx.KEYWORD_CATEGORIES['threats'])} AS threat_count,
       {_tok_contains_any(lx.KEYWORD_CATEGORIES['harassment'])} AS harassment_count
FROM x"""


@register("f_alt_features", _ALT_SQL)
def f_alt_features(spark, sf_dir):
    """The labelling tool's feature set on every document."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", *[c.alias(n) for n, c in T.alt_feature_columns("text").items()])


_FOLD_MAP = "MAP {" + ", ".join(f"'{c}': '{f.replace(chr(39), chr(39) * 2)}'" for c, f in fold_table().items()) + "}"


def _clean_sql(expr: str) -> str:
    src, dst = "".join(lx.LEET_MAP), "".join(lx.LEET_MAP.values())
    folded = (f"array_to_string(list_transform(string_split(coalesce({expr}, ''), ''), "
              f"lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE coalesce(m[c], c) END), '')")
    signs = f"regexp_replace({folded}, '[^\\x{{00}}-\\x{{7F}}\\p{{L}}\\p{{N}}{WS}]', '', 'g')"
    return f"lower(trim(translate(regexp_replace({signs}, '[{WS}]+', '', 'g'), '{src}', '{dst}')))"


@register("f16_clean_text", f"""
WITH fold AS (SELECT {_FOLD_MAP} AS m)
SELECT conv_id, turn, md5({_clean_sql('text')}) AS clean_hash,
       CAST(length({_clean_sql('text')}) AS BIGINT) AS clean_len
FROM conversations, fold""")
def f16_clean_text(spark, sf_dir):
    """F16: evasion-normalising cleaner on every conversation turn (hash + length of the result)."""
    c = read_table(spark, sf_dir, "conversations")
    cleaned = T.clean_text("text")
    return c.select("conv_id", "turn", F.md5(cleaned).alias("clean_hash"),
                    F.length(cleaned).cast("bigint").alias("clean_len"))


def _hard_terms_sql():
    cond = " OR ".join(f"contains(x, '{t}')" for t in lx.load_hard_terms())
    return (f"WITH fold AS (SELECT {_FOLD_MAP} AS m), d AS (SELECT doc_id, text, {_clean_sql('text')} AS x FROM documents, fold) "
            f"SELECT doc_id, ({cond}) AS has_hard_term, md5(text) AS text_hash FROM d")


@register("f17_f18_hard_terms_hash", _hard_terms_sql())
def f17_f18_hard_terms_hash(spark, sf_dir):
    """F17 hard-term containment on the cleaned text; F18 md5 text hash."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.has_hard_term("text").alias("has_hard_term"),
                    T.text_hash("text").alias("text_hash"))


@register("f19_f21_descriptors", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[\\p{{L}}{WS}]', '', 'g')) * 100.0 / length(t) ELSE 0.0 END AS non_letter_pct,
       len(list_intersect({_tokens('lower(t)')}, [{_sql_list(lx.TRIGGER_WORDS)}])) > 0 AS has_trigger_word,
       regexp_matches(t, '[!?]{{2,}}') AS emphasis
FROM d""")
def f19_f21_descriptors(spark, sf_dir):
    """F19 non-letter percentage, F20 trigger-word presence, F21 emphasis."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.non_letter_pct("text").alias("non_letter_pct"),
                    T.has_trigger_word("text").alias("has_trigger_word"),
                    T.emphasis("text").alias("emphasis"))


@register("f24_f27_time_json", with_views("""
SELECT msg_id,
       CAST(hour(ts) AS BIGINT) AS hour_of_day,
       CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
       CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
       CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 86400000000) AS BIGINT) AS account_age_days,
       CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) = ts AS ts_roundtrip,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(json_object('k', CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS props_json,
       CASE WHEN length(props) > 5 THEN concat(substring(props, 1, 5), '...') ELSE props END AS props_short
FROM messages""", "messages"))
def f24_f27_time_json(spark, sf_dir):
    """F24 time parts, F25 age in days, F26 ISO text → timestamp, F27 JSON decode/encode, P10 truncate."""
    m = messages(spark, sf_dir)
    parts = T.time_parts("ts")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return m.select(
        "msg_id", parts["hour_of_day"].alias("hour_of_day"), parts["day_of_week"].alias("day_of_week"),
        parts["is_weekend"].alias("is_weekend"),
        T.age_days(F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("account_age_days"),
        (T.parse_ts(F.col("ts").cast("string")) == F.col("ts")).alias("ts_roundtrip"),
        k.alias("k"),
        F.to_json(F.create_map(F.lit("k"), k)).alias("props_json"),
        T.truncate_text("props", 5).alias("props_short"))

"""Text, hash, time and JSON scalar functions as native Spark column expressions.

Everything here returns a ``Column`` built from built-in functions, so it runs inside
whole-stage codegen with no Python on the executors.  No feature makes an array of tokens or
matches: a count is the difference of the text's length before and after a replacement, so a row
never holds more than a few copies of its text, however long.

Tokenisation follows Python's ``str.split()``: maximal runs of non-whitespace, where
whitespace is the ``str.isspace`` set (``WS_CLASS``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .folding import one_to_many, one_to_one

WS = f"[{lx.WS_CLASS_JAVA}]"
TOKEN = f"[^{lx.WS_CLASS_JAVA}]"
# A token boundary: start of text or whitespace before, end of text or whitespace after.
_TOK_START = f"(?<!{TOKEN})"
_TOK_END = f"(?!{TOKEN})"

_RX_META = set("\\.^$|?*+()[]{}")


def _rx_quote(word: str) -> str:
    return "".join("\\" + ch if ch in _RX_META else ch for ch in word)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_text(c: str | Column) -> Column:
    """null text behaves as the empty string, which makes every count zero."""
    return F.coalesce(_col(c), F.lit(""))


# --- counting without arrays ---------------------------------------------------------------

def _left(t: Column, rx: str) -> Column:
    """Number of characters of ``t`` outside all matches of ``rx``."""
    return F.length(F.regexp_replace(t, F.lit(rx), F.lit("")))


def _matches(t: Column, rx: str) -> Column:
    """Number of matches of ``rx``, for rare ones: every match is kept and followed by one more character."""
    return F.length(F.regexp_replace(t, F.lit(rx), F.lit("$0."))) - F.length(t)


def words_line(t: Column) -> Column:
    """The tokens of a text with a single space between them."""
    return F.trim(F.regexp_replace(t, F.lit(f"{WS}+"), F.lit(" ")))


def _with_value(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


# --- F1–F9: message features -------------------------------------------------------------

def msg_len(c) -> Column:
    """number of code points."""
    return F.length(safe_text(c)).cast("bigint")


def word_count(c) -> Column:
    """number of whitespace-separated tokens."""
    def spaces(line: Column) -> Column:
        return F.when(line == "", F.lit(0)).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    return _with_value(words_line(safe_text(c)), spaces).cast("bigint")


def upper_count(c) -> Column:
    t = safe_text(c)
    return (F.length(t) - _left(t, r"\p{IsUppercase}+")).cast("bigint")


def caps_ratio(c) -> Column:
    """upper-case code points / length, 0.0 for empty text."""
    n = F.length(safe_text(c))
    return F.when(n > 0, upper_count(c) / n).otherwise(F.lit(0.0))


def char_count(c, ch: str) -> Column:
    """occurrences of one literal character (or substring, non-overlapping)."""
    t = safe_text(c)
    return ((F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))) / F.lit(len(ch))).cast("bigint")


def ellipsis_count(c) -> Column:
    """non-overlapping ``...`` occurrences."""
    return char_count(c, "...")


def _token_of(words: Sequence[str]) -> str:
    alt = "|".join(_rx_quote(w) for w in sorted(words, key=len, reverse=True))
    # Cheap first-character guard before the look-behind: most positions fail on it at once.
    firsts = "".join(sorted({_rx_quote(w[0]) for w in words if w}))
    return f"(?=[{firsts}]){_TOK_START}(?:{alt}){_TOK_END}"


def token_in_list_count(c, words: Sequence[str], lower: bool = True) -> Column:
    """tokens (lower-cased) equal to one of ``words``."""
    t = F.lower(safe_text(c)) if lower else safe_text(c)
    return _matches(t, _token_of(words)).cast("bigint")


def personal_pronoun_count(c, words: Sequence[str] = lx.PERSONAL_PRONOUNS) -> Column:
    return token_in_list_count(c, words)


def char_repetition(c) -> Column:
    """runs of three or more equal characters in the lower-cased text (newline excluded)."""
    return _matches(F.lower(safe_text(c)), r"(?d)(.)\1{2,}").cast("bigint")


def all_caps_words(c) -> Column:
    """F8: tokens of length > 1 with an upper-case letter and no lower/title-case letter."""
    no_lower = rf"[^{lx.WS_CLASS_JAVA}\p{{IsLowercase}}\p{{IsTitlecase}}]"
    no_case = rf"[^{lx.WS_CLASS_JAVA}\p{{IsLowercase}}\p{{IsTitlecase}}\p{{IsUppercase}}]"
    rx = rf"(?!\p{{IsLowercase}}){_TOK_START}(?={TOKEN}{{2}}){no_case}*+\p{{IsUppercase}}{no_lower}*+{_TOK_END}"
    return _matches(safe_text(c), rx).cast("bigint")


def substring_hits(c, lexicon: Sequence[str] = lx.BAD_WORDS) -> Column:
    """number of distinct lexicon terms contained anywhere in the lower-cased text."""
    t = F.lower(safe_text(c))
    hits = [F.when(F.contains(t, F.lit(w)), 1).otherwise(0) for w in lexicon]
    out = hits[0]
    for h in hits[1:]:
        out = out + h
    return out.cast("bigint")


def slur_count(c, lexicon: Sequence[str] = lx.BAD_WORDS) -> Column:
    return substring_hits(c, lexicon)


FEATURE_NAMES = ["msg_len", "word_count", "caps_ratio", "exclamation_count", "question_count",
                 "ellipsis_count", "personal_pronoun_count", "char_repetition", "all_caps_words",
                 "slur_count"]


def feature_columns(c="text", bad_words=lx.BAD_WORDS, pronouns=lx.PERSONAL_PRONOUNS) -> dict[str, Column]:
    """F1–F10 as a name → Column mapping, ready for ``withColumns``."""
    return {
        "msg_len": msg_len(c),
        "word_count": word_count(c),
        "caps_ratio": caps_ratio(c),
        "exclamation_count": char_count(c, "!"),
        "question_count": char_count(c, "?"),
        "ellipsis_count": ellipsis_count(c),
        "personal_pronoun_count": personal_pronoun_count(c, pronouns),
        "char_repetition": char_repetition(c),
        "all_caps_words": all_caps_words(c),
        "slur_count": slur_count(c, bad_words),
    }


def text_features(df, text_col: str = "text", **kw):
    """Append F1–F10 to ``df`` in one projection."""
    return df.withColumns(feature_columns(text_col, **kw))


# --- F11–F15: alternate feature set -------------------------------------------------------

def avg_word_len(c) -> Column:
    """mean token length (lower-cased tokens), 0.0 when there are none."""
    def mean(line: Column) -> Column:
        chars = F.length(F.replace(line, F.lit(" "), F.lit("")))
        return F.when(line == "", F.lit(0.0)).otherwise(chars / (F.length(line) - chars + 1))
    return _with_value(F.lower(words_line(safe_text(c))), mean)


def punctuation_ratio(c, chars: str = lx.PUNCTUATION_CHARS) -> Column:
    """share of code points that are one of ``chars``."""
    t = safe_text(c)
    without = t
    for ch in chars:
        without = F.replace(without, F.lit(ch), F.lit(""))
    n = F.length(t)
    return F.when(n > 0, (n - F.length(without)) / n).otherwise(F.lit(0.0))


def emoji_count(c, min_cp: int = lx.EMOJI_MIN_CODEPOINT) -> Column:
    """code points at or above ``min_cp``."""
    return _matches(safe_text(c), f"[\\x{{{min_cp:X}}}-\\x{{10FFFF}}]").cast("bigint")


def keyword_token_count(c, terms: Sequence[str]) -> Column:
    """lower-cased tokens that contain any of ``terms`` as a substring."""
    alt = "|".join(_rx_quote(w) for w in terms)
    rx = f"{_TOK_START}{TOKEN}*?(?:{alt}){TOKEN}*+"
    # A plain search decides first whether the text holds a term at all.
    return _with_value(F.lower(safe_text(c)), lambda t: F.when(contains_any(t, terms), _matches(t, rx)).otherwise(F.lit(0))).cast("bigint")


def alt_feature_columns(c="text", categories=lx.KEYWORD_CATEGORIES,
                        pronouns=lx.ALT_PRONOUNS) -> dict[str, Column]:
    """F11–F15 plus the shared counts of the labelling tool's feature set.

    ``all_caps_words`` is computed on raw tokens (Q17): on lower-cased tokens it is always 0.
    """
    t = safe_text(c)
    return {
        "msg_len": msg_len(c),
        "word_count": word_count(c),
        "avg_word_len": avg_word_len(c),
        "caps_ratio": caps_ratio(c),
        "punctuation_ratio": punctuation_ratio(c),
        "emoji_count": emoji_count(c),
        "personal_pronoun_count": token_in_list_count(c, pronouns),
        "question_mark_count": char_count(t, "?"),
        "exclamation_count": char_count(t, "!"),
        "all_caps_words": all_caps_words(c),
        "slur_count": keyword_token_count(c, categories["slurs"]),
        "threat_count": keyword_token_count(c, categories["threats"]),
        "harassment_count": keyword_token_count(c, categories["harassment"]),
    }


# --- F16–F18: cleaning, hard terms, hashing ----------------------------------------------

def ascii_fold(c) -> Column:
    """Fold compatibility forms, accents, ligatures, Cyrillic and Greek letters to ASCII (``folding``).

    An ASCII text stays as it is.  In others, characters that become several are replaced one after
    another, each that the text holds once; those that fold to one, or to none, go through one
    ``translate``.  What is neither ASCII, letter, digit nor white space then goes.
    """
    src, dst = one_to_one()
    signs = F.lit(rf"[^\x{{00}}-\x{{7F}}\p{{L}}\p{{N}}{lx.WS_CLASS_JAVA}]")
    return _with_value(_col(c), lambda x: F.when(F.length(x) == F.octet_length(x), x).otherwise(
        F.regexp_replace(F.translate(_expanded(x), src, dst), signs, F.lit(""))))


def _expanded(x: Column) -> Column:
    """``x`` with every character that folds to several replaced by them."""
    into = {ch: to for to, chars in one_to_many().items() for ch in chars}
    every = "".join(into)

    def nth(ch: Column, n: int) -> Column:
        # translate drops the characters that have no counterpart: those with fewer than n + 1.
        held = sorted(into, key=lambda k: len(into[k]) <= n)
        return F.translate(ch, "".join(held), "".join(into[k][n] for k in held if len(into[k]) > n))
    # The large class is tried on the few characters beyond ASCII only.
    other = F.regexp_replace(x, F.lit(r"[\x{00}-\x{7F}]++"), F.lit(""))
    found = F.array_distinct(F.split(F.regexp_replace(other, F.lit(f"[^{every}]++"), F.lit("")), ""))
    longest = max(map(len, into.values()))
    return F.aggregate(found, x, lambda t, ch: F.replace(t, ch, F.concat(*[nth(ch, n) for n in range(longest)])))


def clean_text(c, leet: dict[str, str] = lx.LEET_MAP) -> Column:
    """F16: fold → remove all whitespace and leet map (one ``translate``) → lower → trim."""
    kept = {k: v for k, v in leet.items() if k not in lx.WS_CHARS}
    return F.trim(F.lower(F.translate(ascii_fold(safe_text(c)), "".join(kept) + lx.WS_CHARS, "".join(kept.values()))))


def contains_any(c, terms: Iterable[str]) -> Column:
    """true when any term is a substring of ``c``."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    out = F.contains(_col(c), F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.contains(_col(c), F.lit(t))
    return out


def has_hard_term(c, terms: Iterable[str] | None = None) -> Column:
    if terms is None:
        terms = lx.load_hard_terms()
    terms = list(terms)
    if not terms:
        return F.lit(False)
    # One alternation over the cleaned text, which is made once; most positions fail on its first letters.
    firsts = "".join(sorted({_rx_quote(t[0]) for t in terms}))
    return clean_text(c).rlike(f"(?=[{firsts}])(?:" + "|".join(_rx_quote(t) for t in terms) + ")")


def text_hash(c) -> Column:
    """md5 of the UTF-8 text, hex."""
    return F.md5(_col(c))


# --- F19–F21: text descriptors -----------------------------------------------------------

def non_letter_pct(c) -> Column:
    """percentage of code points that are neither letters nor whitespace."""
    t = safe_text(c)
    n = F.length(t)
    return F.when(n > 0, _left(t, rf"[\p{{L}}{lx.WS_CLASS_JAVA}]++") * 100.0 / n).otherwise(F.lit(0.0))


def has_trigger_word(c, words: Sequence[str] = lx.TRIGGER_WORDS) -> Column:
    """any lower-cased token equal to a trigger word."""
    return F.lower(safe_text(c)).rlike(_token_of(words))


def emphasis(c) -> Column:
    """a run of two or more ``!``/``?``."""
    return safe_text(c).rlike(r"[!?]{2}")


# --- F24–F27: time and JSON --------------------------------------------------------------

def time_parts(ts) -> dict[str, Column]:
    """hour, weekday with Monday = 0, weekend flag."""
    t = _col(ts)
    dow = F.weekday(t)
    return {"hour_of_day": F.hour(t).cast("bigint"), "day_of_week": dow.cast("bigint"),
            "is_weekend": (dow >= 5).cast("int")}


def micros(ts) -> Column:
    """Microseconds since the epoch of a (naive) timestamp, read as UTC."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def age_days(created, as_of) -> Column:
    """whole days from ``created`` to ``as_of``."""
    return F.floor((micros(as_of) - micros(created)) / F.lit(86_400_000_000)).cast("bigint")


def parse_ts(c) -> Column:
    """ISO text → timestamp_ntz; unparseable text gives null."""
    return F.try_to_timestamp(_col(c)).cast("timestamp_ntz")


def truncate_text(c, n: int = 250, suffix: str = "...") -> Column:
    """P10: keep the first ``n`` characters and mark the cut."""
    t = _col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(suffix))).otherwise(t)

"""Operator 5: language identification by hierarchical discrimination.

Method.  Features are hashed byte 1- to 3-grams of the lower-cased words with their borders.
One-versus-rest linear support vector machines choose the language family; within it,
one-versus-one machines separate each pair of its languages and vote.  The functions are linear
in a text's relative n-gram frequencies, so a whole text's score is the sum of its distinct
words' scores, computed once per word of a slice.

The machines are fitted on a bounded sample of at most ``SAMPLE_DOCS`` labelled documents, in
equal parts by language, those of smallest hashed id.  ``families`` maps language codes to
families; a code that it does not hold is a family of its own.

Defined results: ``und`` with score 0 for a null text, one without a letter, or when there is
nothing to learn from; rows that repeat get the same answer; an empty table gives an empty
result.  Only id, text and (for training rows) lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import byte_view, mix64, text_slices, words_of

SAMPLE_DOCS = 2000
BITS = 13
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "is", "af", "lb"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
UND = "und"


def word_grams(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of each distinct word with a space at either end, and their starts."""
    raw, at = byte_view(vocab)
    n = np.diff(at)
    starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + 2, out=starts[1:])
    text = np.full(int(starts[-1]) + 2, 32, np.uint64)
    inner = np.ones(int(starts[-1]), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    text[:-2][inner] = raw
    left = np.repeat(starts[1:], n + 2) - np.arange(starts[-1])     # bytes from here to the word's end
    one = text[:-2]
    two = (one << np.uint64(8)) | text[1:-1]
    three = (two << np.uint64(8)) | text[2:]
    mask = np.uint64((1 << BITS) - 1)
    grams = np.stack([mix64(x + (np.uint64(k) << np.uint64(40))) & mask for k, x in ((1, one), (2, two), (3, three))], axis=1).astype(np.int32)
    fits = np.stack([inner, left >= 2, left >= 3], axis=1)
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.add.reduceat(fits.sum(axis=1), starts[:-1]) if len(n) else [], out=out[1:])
    return grams[fits], out


@dataclass
class Hierarchy:
    """Weights of all linear functions, one column each, and what the columns are."""

    weights: np.ndarray                 # (features, functions)
    bias: np.ndarray
    families: list[str]                 # column of each family's one-versus-rest function
    languages: dict[str, list[str]]     # of each family
    pairs: dict[tuple[str, str], int]   # column of each one-versus-one function; positive: the first

    def decide(self, margin: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of function values."""
        n = len(margin)
        if len(self.families) > 1:
            head = np.exp(np.clip(4 * margin[:, : len(self.families)], -60, 60))
            head /= head.sum(axis=1, keepdims=True)
        else:
            head = np.ones((n, 1))
        family = head.argmax(axis=1)
        names, score = np.empty(n, object), head.max(axis=1)
        for k, f in enumerate(self.families):
            rows, langs = np.nonzero(family == k)[0], self.languages[f]
            votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for (a, b), column in self.pairs.items():
                if a in langs:
                    m, i, j = margin[rows, column], langs.index(a), langs.index(b)
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    sums[:, i] += m
                    sums[:, j] -= m
            best = (votes + 0.5 * np.tanh(sums)).argmax(axis=1) if len(langs) > 1 else np.zeros(len(rows), int)
            names[rows] = np.array(langs, object)[best]
            if len(langs) > 1:
                mean = sums[np.arange(len(rows)), best] / (len(langs) - 1)
                score[rows] *= 1 / (1 + np.exp(-np.clip(4 * mean, -60, 60)))
        return list(names), score


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine on rows ``x`` and signs ``y``, classes weighted alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * y * weight
        gw, gb = x.T @ slack - 1e-4 * w, float(slack.sum())
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = (1 - 0.99 ** step) ** 0.5 / (1 - 0.9 ** step) * 0.05
        w += fix * mw / (np.sqrt(vw) + 1e-7)
        b += np.float32(fix * mb / (vb ** 0.5 + 1e-7))
    return w, float(b)


def _frequencies(texts: pa.Array) -> np.ndarray:
    codes, vocab, starts = words_of(texts, "utf8")
    out = np.zeros((len(starts) - 1, 1 << BITS), np.float32)
    if len(vocab):
        grams, at = word_grams(vocab)
        for i in range(len(out)):
            own, times = np.unique(codes[starts[i]: starts[i + 1]], return_counts=True)
            for w, k in zip(own, times):
                np.add.at(out[i], grams[at[w]: at[w + 1]], k)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def fit_hierarchy(texts: pa.Array, langs: list[str], families: dict | None = None) -> Hierarchy | None:
    """All machines from sampled texts and their languages; None without rows."""
    if not langs:
        return None
    family_of = {code: f for f, codes in (families or FAMILIES).items() for code in codes}
    lang = np.array(langs, object)
    groups: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        groups.setdefault(family_of.get(code, code), []).append(code)
    x = _frequencies(texts)
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-5)).astype(np.float32)
    x *= scale
    names = sorted(groups)
    functions = []
    if len(names) > 1:
        for f in names:
            functions.append(fit_svm(x, np.where(np.isin(lang, groups[f]), 1, -1).astype(np.float32)))
    else:
        functions.append((np.zeros(x.shape[1], np.float32), 0.0))
    pairs = {}
    for f in names:
        for a, b in combinations(groups[f], 2):
            rows = (lang == a) | (lang == b)
            pairs[(a, b)] = len(functions)
            functions.append(fit_svm(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32)))
    weights = np.stack([w * scale for w, _ in functions], axis=1).astype(np.float32)
    return Hierarchy(weights, np.array([b for _, b in functions]), names, groups, pairs)


def train(docs: DataFrame, learn_from: Column, families: dict | None = None) -> Hierarchy | None:
    """Fit on a bounded sample of the documents with a language for which ``learn_from`` (over doc_id) holds."""
    known = docs.select("doc_id", "lang", "text").where("doc_id IS NOT NULL AND lang IS NOT NULL AND lang <> 'und'").where(learn_from)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    each = max(1, SAMPLE_DOCS // len(counts))
    # Ids are cut at the share of the hash range that should hold ``each`` rows of the language.
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.2 * each / n))))
    place = (F.xxhash64(F.col("doc_id").cast("string")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    sample = known.withColumn("place", place).where(F.col("place") <= share[F.col("lang")]).toArrow()
    order = pc.sort_indices(sample, [("lang", "ascending"), ("place", "ascending"), ("doc_id", "ascending")])
    taken: dict[str, int] = {}
    rows = []
    names = sample.column("lang").to_pylist()
    for i in order.to_pylist():
        if taken.get(names[i], 0) < each:
            taken[names[i]] = taken.get(names[i], 0) + 1
            rows.append(i)
    texts = sample.column("text").take(pa.array(rows, pa.int64()))
    texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    return fit_hierarchy(texts, [names[i] for i in rows], families)


def predict(model: Hierarchy | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text."""
    texts = pc.fill_null(texts, "")
    letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
    names, score = [UND] * len(texts), np.zeros(len(texts))
    codes, vocab, starts = words_of(texts, "utf8")
    if model is not None and len(codes):
        grams, at = word_grams(vocab)
        by_word = np.stack([np.add.reduceat(model.weights[:, k][grams], at[:-1]) for k in range(model.weights.shape[1])], axis=1)
        size = np.diff(at)
        some = np.nonzero(np.diff(starts) > 0)[0]
        first = starts[:-1][some]
        total = np.add.reduceat(size[codes], first)
        margin = np.stack([np.add.reduceat(by_word[:, k].astype(np.float64)[codes], first) for k in range(by_word.shape[1])], axis=1)
        found, certain = model.decide(margin / total[:, None] + model.bias)
        for i, name, s in zip(some, found, certain):
            if letters[i]:
                names[i], score[i] = name, s
    return names, np.clip(score, 0, 1)


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                names, score = predict(model, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Hierarchy | None, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is one of ``allowed`` (None: any but ``und``)."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                names, _ = predict(model, part.column("text"))
                yield part.filter(pa.array([n != UND if allowed is None else n in allowed for n in names], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def identify_language(docs: DataFrame, learn_from: Column, families: dict | None = None) -> DataFrame:
    """Train on the rows that ``learn_from`` admits and identify every document."""
    return identify(docs, train(docs, learn_from, families))

"""Job-title standardization without a shuffle.

Exact matching stays in the JVM: the words of a title form n-grams, and each
n-gram is probed against the taxonomy's hash set.  Titles without a hit go to a
vectorized UDF that scores every *distinct* title of an Arrow batch once, so
popular titles cost one dictionary lookup and no key ever has to be shuffled.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.text import strip
from jobmarket.rules.taxonomy import DEFAULT_TAXONOMY, UNCATEGORIZED, Taxonomy

# executors receive the scorer inside the task and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: smallest fuzzy score that counts as a match.
SCORE_CUTOFF = 84

# Seniority words carry no information about the occupation.
SENIORITY = r"\b(?:jr\.?|junior|sr\.?|senior|lead|principal|entry[-\s]?level)\b"


def clean_title(c: Column | str) -> Column:
    """Lower-case words of ``[a-z0-9]`` separated by single spaces."""
    text = F.lower(strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    text = F.regexp_replace(text, "(?U)" + SENIORITY, " ")
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def exact_rank(words: str, tokens: str, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """Priority of the first category whose phrase occurs in column ``words``, or null.

    ``tokens`` is the column of its single words.  N-grams beginning with the first
    word of some phrase are probed against one hash set.  The phrase list is stated
    as SQL text: one call instead of one per phrase.
    """
    known = ", ".join(map(_sql_text, taxonomy.exact))
    ranks = ", ".join(f"{_sql_text(p)}, {rank}" for p, rank in taxonomy.exact.items())
    openers = ", ".join(_sql_text(w) for w in sorted({p.split()[0] for p in taxonomy.exact}))
    starts = f"filter(sequence(1, size({tokens})), i -> element_at({tokens}, i) IN ({openers}))"
    grams = (
        f"flatten(transform({starts}, i -> transform("
        f"sequence(1, least({taxonomy.longest}, size({tokens}) - i + 1)), "
        f"n -> array_join(slice({tokens}, i, n), ' '))))"
    )
    hits = f"filter({grams}, g -> g IN ({known}))"
    rank = F.expr(f"array_min(transform({hits}, g -> element_at(map({ranks}), g)))")
    by_prefix = [
        F.when(F.col(words).rlike(r"\b" + re.escape(prefix)), F.lit(r))
        for prefix, r in taxonomy.prefixes
    ]
    return F.least(rank, *by_prefix) if by_prefix else rank


def taxonomy_match(df: DataFrame, column: str, rules: list[tuple[str, list[str]]]) -> Column:
    """Generic form for regular-expression rules: first ``(label, patterns)`` that hits."""
    return F.coalesce(
        *[F.when(df[column].rlike("(?i)" + "|".join(pats)), F.lit(name)) for name, pats in rules]
    )


# ---------------------------------------------------------------- fuzzy score


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        matched = row & positions.get(ch, 0)
        row = ((row + matched) | (row - matched)) & full
    return len(a) - row.bit_count()


def token_set_score(a: frozenset, b: frozenset, cutoff: float = 0.0) -> float:
    """Token-set similarity of two word sets, 0..100; below ``cutoff`` may be 0."""
    if not a or not b:
        return 0.0
    both = a & b
    only_a, only_b = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and not (only_a and only_b):
        return 100.0
    shared = sum(map(len, both)) + len(both) - 1 if both else 0
    gap = 1 if both else 0
    len_a, len_b = len(only_a), len(only_b)
    total = 2 * (shared + gap) + len_a + len_b
    best = 0.0
    if both:
        best = max(
            100.0 - 100.0 * (gap + n) / (2 * shared + gap + n) for n in (len_a, len_b)
        )
    # the subsequence is at most the shorter side: skip pairs that cannot qualify
    if 100.0 - 100.0 * abs(len_a - len_b) / total >= max(cutoff, best):
        distance = len_a + len_b - 2 * common_subsequence(only_a, only_b)
        best = max(best, 100.0 - 100.0 * distance / total)
    return best if best >= cutoff else 0.0


class Vocabulary:
    """Fuzzy phrases indexed so that a title meets only phrases that can qualify.

    A phrase without a common word can reach the cutoff only through its letters,
    and the letters two texts share bound their longest common subsequence.
    """

    letters = "abcdefghijklmnopqrstuvwxyz0123456789 "

    def __init__(self, taxonomy: Taxonomy, cutoff: float = SCORE_CUTOFF):
        self.cutoff = cutoff
        self.categories = taxonomy.categories
        self.ranks = [rank for _, rank in taxonomy.fuzzy]
        self.words = [frozenset(phrase.split()) for phrase, _ in taxonomy.fuzzy]
        joined = [" ".join(sorted(w)) for w in self.words]
        self.lengths = np.array([len(j) for j in joined])
        self.bags = np.array([self._bag(j) for j in joined])
        self.by_word: dict[str, list[int]] = {}
        for i, words in enumerate(self.words):
            for word in words:
                self.by_word.setdefault(word, []).append(i)

    def _bag(self, text: str) -> list[int]:
        return [text.count(ch) for ch in self.letters]

    def best(self, title: str):
        """(category, score) of the first phrase with the highest score, or nulls."""
        words = frozenset(title.split())
        joined = " ".join(sorted(words))
        common = np.minimum(self.bags, self._bag(joined)).sum(axis=1)
        near = 200.0 * common >= (self.cutoff - 1e-9) * (self.lengths + len(joined))
        candidates = set(np.flatnonzero(near).tolist())
        for word in words:
            candidates.update(self.by_word.get(word, ()))
        found, top = None, self.cutoff
        for i in sorted(candidates):
            score = token_set_score(words, self.words[i], top)
            if score >= top and (found is None or score > top):
                found, top = i, score
        return (None, None) if found is None else (self.categories[self.ranks[found]], int(top))


def fuzzy_matcher(taxonomy: Taxonomy, cutoff: float = SCORE_CUTOFF):
    """Vectorized UDF ``cleaned title -> (category, score)``, null where nothing fits."""
    vocabulary = Vocabulary(taxonomy, cutoff)

    @F.pandas_udf("category string, score int")
    def match(titles: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(titles)  # nulls get code -1
        results = [vocabulary.best(t) for t in distinct] + [(None, None)]
        rows = [results[c] for c in codes]
        return pd.DataFrame(rows, columns=["category", "score"]).astype({"score": "Int32"})

    return match.asNondeterministic()  # keeps filters from duplicating or splitting the scoring


def standardize_titles(
    df: DataFrame, column: str = "job_title", taxonomy: Taxonomy = DEFAULT_TAXONOMY
) -> DataFrame:
    """Replace ``column`` by its stripped text; add career_category, title_match_method."""
    df = df.withColumn(column, strip(F.coalesce(F.col(column), F.lit(""))))
    df = df.withColumn("_words", clean_title(column))
    df = df.withColumn("_tokens", F.split("_words", " "))
    df = df.withColumn("_rank", exact_rank("_words", "_tokens", taxonomy))
    open_title = F.when(F.col("_rank").isNull() & (F.col("_words") != ""), F.col("_words"))
    df = df.withColumn("_fuzzy", fuzzy_matcher(taxonomy)(open_title))
    names = F.array(*[F.lit(c) for c in taxonomy.categories])
    return df.withColumns(
        {
            "career_category": F.coalesce(
                F.get(names, F.col("_rank")), F.col("_fuzzy.category"), F.lit(UNCATEGORIZED)
            ),
            "title_match_method": F.when(F.col("_rank").isNotNull(), "exact").when(
                F.col("_fuzzy.category").isNotNull(),
                F.concat(F.lit("fuzzy("), F.col("_fuzzy.score").cast("string"), F.lit(")")),
            ),
        }
    ).drop("_words", "_tokens", "_rank", "_fuzzy")


def uncategorized_titles(clean: DataFrame) -> DataFrame:
    """Titles without a category, most frequent first."""
    return (
        clean.where(F.col("career_category") == UNCATEGORIZED)
        .groupBy("job_title")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "job_title")
    )

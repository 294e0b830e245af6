"""Spelling variants: words one edit apart, met through pivotal bigrams.

All bigrams have a global order, rarest first. A word's prefix is its three
first bigrams (and any that equal the third), which one edit cannot destroy all;
two disjoint ones of them, chosen by dynamic programming for least frequency,
are its pivots, of which one edit destroys one at most. Of two words one edit
apart, take the one whose prefix ends earlier: its surviving pivot comes no later
in the order than the other's prefix ends, hence lies in that prefix. The edit
comes before or after it, so all on its other side is the same, and of what lies
on the edit's side the first half or the last. Places alone would let the pairs
that meet grow with the square of the words; hence pivots join prefixes on the
bigram with these parts, and an edit distance decides each pair that meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, spread, store

#: The letters of a run, A-Z lowered.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"
#: Letters of a bigram, edits of a near pair, bigrams of a prefix.
GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1


def pivots(grams: list[tuple[int, int]], count: int = EDITS + 1, width: int = GRAM) -> list[tuple[int, int]]:
    """The `count` disjoint grams with the least sum of weights, of (place, weight) in order of place.

    best[k][i] is the least sum of k disjoint ones among the first i; ties go to
    the earlier places.
    """
    n = len(grams)
    before = [0] * n  # how many grams end where each begins
    for i, (place, _) in enumerate(grams):
        before[i] = before[i - 1] if i else 0
        while before[i] < i and grams[before[i]][0] + width <= place:
            before[i] += 1
    none = float("inf")
    best = [[0.0] * (n + 1)] + [[none] * (n + 1) for _ in range(count)]
    for k in range(1, count + 1):
        for i in range(1, n + 1):
            best[k][i] = min(best[k][i - 1], best[k - 1][before[i - 1]] + grams[i - 1][1])
    chosen, i = [], n
    for k in range(count, 0, -1):
        while i and best[k][i] == best[k][i - 1]:
            i -= 1
        if not i or best[k][i] == none:
            raise ValueError("a prefix has too few disjoint grams")
        chosen.append(grams[i - 1])
        i = before[i - 1]
    return chosen[::-1]


def keys_of(word: str, rank: dict[str, int], weight: dict[str, int]) -> Iterator[tuple[bool, str]]:
    """(whether of a pivot, key) for the parts of a word that one edit leaves whole around each bigram of its prefix.

    rank: the global order of bigrams; weight: their frequency. An edit after a
    bigram leaves all up to its end, and of the rest, `least` letters in the
    shorter word, the first half or the last. An edit before it does the same
    the other way round. A word has `least` letters there if it is the shorter one,
    one less if it is the longer.
    """
    grams = sorted((rank[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = grams[min(PREFIX, len(grams)) - 1][0]
    prefix = sorted(i for r, i in grams if r <= last)
    chosen = {i for i, _ in pivots([(i, weight[word[i : i + GRAM]]) for i in prefix])}
    for i in prefix:
        for after, open_ in ((True, word[i + GRAM :]), (False, word[:i])):
            whole = word[: i + GRAM] if after else word[i:]
            for least in (len(open_), len(open_) - EDITS):
                if least >= 0:
                    half = least // 2
                    yield i in chosen, f"{int(after)}{whole},{least},<{open_[:half]}"
                    yield i in chosen, f"{int(after)}{whole},{least},>{open_[len(open_) - least + half :]}"


def spelled_words(docs: DataFrame, shortest: int = 5, least: int = 3, slip: int = 97) -> DataFrame:
    """word, n: runs of letters over all texts; where `slip` divides the crc32 of `<doc_id>:<run>`, the run lacks one letter."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    # shorter runs cannot become words
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    hashed = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """word, other: both directions of each pair of words one edit apart, each once. words: column word, distinct, three letters at least."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("gram"))
    # a row for each two letters of the alphabet at most: 8,100
    weight = dict(grams.groupBy("gram").count().collect())
    rank = {g: i for i, g in enumerate(sorted(weight, key=lambda g: (weight[g], g)))}

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, pivot, xxhash.xxh64_intdigest(key) - (1 << 63)) for w in pdf["word"] for pivot, key in keys_of(w, rank, weight)]
            yield pd.DataFrame(rows, columns=["word", "pivot", "key"])

    keys = store(spread(words).select("word").mapInPandas(keyed, "word string, pivot boolean, key long"), "spelling-keys")
    left, right = keys.filter("pivot").select(F.col("word").alias("a"), "key"), keys.select(F.col("word").alias("b"), "key")
    met = left.join(right, "key").filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", EDITS) == EDITS))
    one = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = store(one.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*"), "spelling-near")
    drop_stored(keys)
    return near


def roots(forms: DataFrame, name: str = "spelling-roots") -> DataFrame:
    """word, root: the last word that forms (columns word, form; no cycles) lead to, by joins that double the steps."""
    now = store(forms.select("word", F.col("form").alias("root")), name)
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = store(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), name)
        drop_stored(now)
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that comes three times or more.

    A form is the near word of largest n (ties: the smallest in code-point order)
    if it comes at least twice as often; roots follow forms to the last one. Null
    and empty texts have no words, a null doc_id counts as an empty one; a very
    long text is cut into its runs by one task; repeated rows count each time. No
    group is gathered: a word's near words are counted by partial aggregates. An
    empty table gives an empty result; further columns are ignored.
    """
    words = store(spelled_words(docs), "spelling-words")
    near = near_words(words)
    count = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    found = near.join(count, "other").groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    fits = F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False))
    known = store(known.withColumns({"form": F.when(fits, F.col("form")), "form_n": F.when(fits, F.col("form_n"))}), "spelling-forms")
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

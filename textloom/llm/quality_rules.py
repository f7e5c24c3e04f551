"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gives exact counts (words, word characters, symbols, repeated lines, words in repeated 8-word windows), a histogram of
the character classes of its words and a histogram of its language's common words (all others in one bin).

1. A language's common words are the COMMON words found in most of its documents, over the whole table.
2. A document's language is its own ``lang`` where that is known. A document without one takes the language most of whose
   common words it holds.
3. All documents that pass the base rule give one reference pair of histograms for each language, however many those are.
4. A text is kept if the Jensen-Shannon distances (base 2, 0 to 1) of both histograms from its language's reference are within
   limits that widen for short texts. A histogram of too few characters or words decides nothing.

Repeated windows are found inside each row: a 64-bit hash of every window, sorted only where a text has any that repeat.
Shuffled are the counts of words by language, combined before, and the references' sums; never texts. Tables of one row a
language are joined by the language, so that Spark broadcasts them where their files are small and shuffles them otherwise.

Defined cases: null text has no words (all counts 0, base_failed, not kept); texts are read whole however long they are; words
tie by code point, languages too; a document whose language has no reference is judged by the base rule alone, as is one
without ``lang`` that holds no common word; rows come one for one, repeated rows and null ids too; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._common import materialise

WINDOW, LEAST_WORDS, REPEAT_SHARE = 8, 20, 30
#: Common words of a language, and the most characters of one.
COMMON, LONGEST = 16, 12
#: Least word characters and words for the two histograms to decide.
LEAST_CHARS, LEAST_COMMON = 100, 80
#: The largest distances of kept texts: a limit, and what is added to it over the square root of the histogram's size.
CHAR_LIMIT, CHAR_NOISE = 0.20, 1.8
COMMON_LIMIT, COMMON_NOISE = 0.20, 0.6
#: Character classes of the words' characters that are not a-z; a-z and all others are two more.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": r"[#*$%&|<>]", "bang": "!", "stop": "[.?]", "comma": "[,;:]", "wide": r"[^\x00-\x7F]"}


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words of an array stand in windows that occur twice or more in it."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        def marked(s: Column) -> Column:
            twice = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
            flags = F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), F.coalesce(twice(x, k), x["h"] == F.get(s, k - 1)["h"], x["h"] == F.get(s, k + 1)["h"], F.lit(False)).alias("d")))
            return F.sort_array(F.transform(F.filter(flags, lambda x: x["d"]), lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        s = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(s, marked), total)).otherwise(F.lit(0).cast("long"))

    one = F.transform(words, lambda w: F.xxhash64(w))
    rolled = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
    return F.when(n > window, let(let(one, rolled), covered)).otherwise(F.lit(0).cast("long"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def common_words(docs: DataFrame) -> DataFrame:
    """lang, words: the COMMON words of at most LONGEST characters in most documents of each language, sorted."""
    own = docs.where("lang is not null").select("lang", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    n = own.where(F.length("word") <= LONGEST).groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # limited before the shuffle
    top = n.withColumn("place", place).where(F.col("place") <= COMMON)
    return top.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("known"))


def guessed(docs: DataFrame, common: DataFrame) -> DataFrame:
    """h, lang: for the texts without a language, by hash, the one most of whose common words they hold."""
    texts = docs.where("lang is null").select(F.xxhash64("text").alias("h"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    hits = texts.join(common.select("lang", F.explode("known").alias("word")), "word").groupBy("h", "lang").agg(F.count_distinct("word").alias("n"))
    return hits.groupBy("h").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang (as given), ref (the language held against), the base counts, and the histograms as arrays of long."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    common = materialise(common_words(d), "rule-words")
    guess = materialise(guessed(d, common), "rule-guesses").select("h", F.col("lang").alias("guess"))
    key = F.when(F.col("lang").isNull(), F.xxhash64("text"))  # null for rows of a known language, which the join leaves alone
    d = d.withColumn("h", key).join(guess, "h", "left").withColumn("ref", F.coalesce("lang", "guess")) if not guess.isEmpty() else d.withColumn("ref", F.col("lang"))
    d = d.join(common.withColumnRenamed("lang", "ref"), "ref", "left")
    d = d.select("doc_id", "lang", "ref", "known", "text", words_of(F.col("text")).alias("words"), F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "").alias("rest"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", "ref", "known", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length("rest").cast("long").alias("rest_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.filter("words", lambda w: F.array_contains(F.col("known"), w)).alias("found"),
        *[F.regexp_count("rest", F.lit(p)).cast("long").alias(f"c_{k}") for k, p in CLASSES.items()],
    )
    other = reduce(lambda a, b: a + b, [F.col(f"c_{k}") for k in CLASSES])
    classes = F.array(F.col("word_chars") - F.col("rest_chars"), *[F.col(f"c_{k}") for k in CLASSES], F.col("rest_chars") - other)
    each = let(F.col("found"), lambda f: F.transform("known", lambda w: F.size(F.filter(f, lambda x: x == w)).cast("long")))
    common = F.concat(each, F.array(F.col("n_words") - F.size("found")))
    return d.select("doc_id", "lang", "ref", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", classes.alias("classes"), common.alias("common"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_SHARE)


def references(c: DataFrame) -> DataFrame:
    """ref, ref_classes and ref_common: each language's two distributions, from its documents that pass the base rule."""
    k = len(CLASSES) + 2
    sums = [F.sum(F.get("classes", F.lit(i))).cast("double").alias(f"k{i}") for i in range(k)] + [F.sum(F.get("common", F.lit(i))).cast("double").alias(f"w{i}") for i in range(COMMON + 1)]
    per = c.where(~base_failed() & F.col("lang").isNotNull()).groupBy("ref").agg(*sums)
    shares = lambda p, n: let(F.filter(F.array(*[F.col(f"{p}{i}") for i in range(n)]), lambda x: x.isNotNull()), lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))
    return per.select("ref", shares("k", k).alias("ref_classes"), shares("w", COMMON + 1).alias("ref_common"))


def js_distance(hist: Column, total: Column, ref: Column) -> Column:
    """The Jensen-Shannon distance, base 2, of a histogram (total above 0) and a reference distribution."""

    def part(x: Column, q: Column) -> Column:
        p = x / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(hist, ref, part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each document: the counts, both distances (null without a reference), base_failed and kept."""
    c = materialise(counts(docs), "rule-counts")
    c = c.join(materialise(references(c), "rule-references"), "ref", "left").withColumn("base_failed", base_failed())
    apart = lambda h, n, r: F.when(F.col(r).isNotNull(), F.when(F.col(n) > 0, js_distance(F.col(h), F.col(n), F.col(r))).otherwise(1.0))
    c = c.withColumn("char_distance", apart("classes", "word_chars", "ref_classes")).withColumn("common_distance", apart("common", "n_words", "ref_common"))
    far = ((F.col("word_chars") >= LEAST_CHARS) & (F.col("char_distance") > CHAR_LIMIT + CHAR_NOISE / F.sqrt("word_chars"))) | ((F.col("n_words") >= LEAST_COMMON) & (F.col("common_distance") > COMMON_LIMIT + COMMON_NOISE / F.sqrt("n_words")))
    return c.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "common_distance")

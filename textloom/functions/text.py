"""Text rules as Column expressions: words, lines, sentences, rejects, ratios, normalisation and repetition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Phrases that mark page furniture, the ends of valid lines, and the patterns of citations.
BOILERPLATE = ("terms of use", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies", "terms and conditions", "all rights reserved", "see ap.org")
LINE_ENDS = (".", "!", "?", '"', "'")
CITATION = r"(?i)\[\d+\]|\[citation needed\]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: White space of any script, and the four separators below it.
SPACE = r"[\s\x1C-\x1F]"


def strip(text) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(text), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def words(text, unicode_space: bool = True, first: int | None = None) -> Column:
    """Runs of anything but white space; Unicode spaces part words too unless told otherwise.

    first: the text is split only so far that its first words are whole; what follows them is one more entry at least.
    """
    limit = -1 if first is None else first + 2  # an empty piece can come before them, and the rest after them
    return F.filter(F.split(_col(text), rf"(?U){SPACE}+" if unicode_space else r"\s+", limit), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text)).cast("long")


def estimated_tokens(text, per_word: float = 1.3) -> Column:
    """Tokens estimated from words."""
    return F.size(words(text)) * F.lit(per_word)


def sentences(text) -> Column:
    """A deterministic splitter: a sentence ends after . ! or ? (and closing quotes or brackets) before white space."""
    marked = F.regexp_replace(_col(text), r"([.!?]+[\"')\]]*)\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def _windows(items: Column, n: int, count: Column, each) -> Column:
    """each(array, i) for the 1-based starts of count windows. The array is bound once, not computed for each window."""
    return let(items, lambda x: F.when(count(x) >= 1, F.transform(F.sequence(F.lit(1), count(x)), lambda i: each(x, i))))


def ngrams(items: Column, n: int, include_last: bool = True) -> Column:
    """All windows of n items of an array; without include_last the last one is left out."""
    grams = _windows(items, n, lambda x: F.size(x) - n + (1 if include_last else 0), lambda x, i: F.slice(x, i, n))
    return F.coalesce(grams, F.array().cast("array<array<string>>"))


def joined_ngrams(items: Column, n: int) -> Column:
    grams = _windows(items, n, lambda x: F.size(x) - n + 1, lambda x, i: F.array_join(F.slice(x, i, n), " "))
    return F.coalesce(grams, F.array().cast("array<string>"))


def shingles(text, n: int) -> Column:
    """The distinct word n-grams; a shorter text's whole sequence is its one shingle, and a wordless one has none."""
    few = lambda w: F.when(F.size(w) >= n, joined_ngrams(w, n)).when(F.size(w) > 0, F.array(F.array_join(w, " ")))
    return F.array_distinct(F.coalesce(let(words(text), few), F.array().cast("array<string>")))


def sentence_trigram_hashes(text) -> Column:
    """md5 of each window of three consecutive sentences."""
    return F.transform(joined_ngrams(sentences(text), 3), lambda g: F.md5(g))


def line_is_valid(line: Column, min_words: int = 5) -> Column:
    """A trimmed line that does not start with the copyright sign, has enough words and ends a sentence."""
    s = strip(line)
    return ~s.startswith("©") & (F.size(words(s)) >= min_words) & F.right(s, F.lit(1)).isin(*LINE_ENDS)


def has_script_notice(line: Column) -> Column:
    return F.lower(line).contains("javascript")


def has_boilerplate(line: Column) -> Column:
    low = F.lower(line)
    out = F.lit(False)
    for p in BOILERPLATE:
        out = out | low.contains(p)
    return out


def strip_citations(line: Column) -> Column:
    return F.regexp_replace(line, CITATION, "")


def clean_lines(text) -> Column:
    """The text's valid lines as they are, but for their citations; each is judged before those are stripped."""
    kept = F.filter(F.split(_col(text), "\n"), lambda x: line_is_valid(x) & ~has_script_notice(x) & ~has_boilerplate(x))
    return F.array_join(F.transform(kept, strip_citations), "\n")


def has_brace(text) -> Column:
    return _col(text).contains("{")


def has_placeholder(text) -> Column:
    return _col(text).rlike("(?i)lorem ipsum")


def has_bad_word(text, bad: list[str]) -> Column:
    """Any listed word at word boundaries of the lower-cased text; for short lists."""
    if not bad:
        return F.lit(False)
    special = set(r"\.^$|?*+()[]{}")
    esc = "|".join("".join("\\" + c if c in special else c for c in w) for w in bad)
    return F.lower(_col(text)).rlike(rf"\b(?:{esc})\b")


def alpha_ratio(text) -> Column:
    t = _col(text)
    return F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1))


def caps_ratio(text) -> Column:
    """Words in capitals of more than two characters over all words."""
    caps = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}") & (F.length(x) > 2)
    return let(words(text), lambda w: F.size(F.filter(w, caps)) / F.greatest(F.size(w), F.lit(1)))


def repeat_ratio(text, n: int = 3) -> Column:
    """1 less the share of distinct word n-grams; 0 below n words."""
    g = joined_ngrams(words(text), n)
    return let(g, lambda x: F.when(F.size(x) > 0, 1 - F.size(F.array_distinct(x)) / F.size(x)).otherwise(F.lit(0.0)))


def figures(text) -> Column:
    """struct(n_words, alpha, caps, repeated): the words are split once."""
    t = _col(text)
    caps = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}") & (F.length(x) > 2)
    grams = lambda w: _windows(w, 3, lambda x: F.size(x) - 2, lambda x, i: F.array_join(F.slice(x, i, 3), " "))
    repeated = lambda w: F.coalesce(let(grams(w), lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)), F.lit(0.0))
    one = lambda w: F.struct(F.size(w).alias("n_words"), alpha_ratio(t).alias("alpha"), (F.size(F.filter(w, caps)) / F.greatest(F.size(w), F.lit(1))).alias("caps"), repeated(w).alias("repeated"))
    return let(words(t), one)


def passes_figures(f: Column, min_alpha: float = 0.4, max_caps: float = 0.4, max_repeat: float = 0.25) -> Column:
    return (f["n_words"] > 0) & (f["alpha"] >= min_alpha) & (f["caps"] <= max_caps) & (f["repeated"] <= max_repeat)


def passes_quality(text, min_alpha: float = 0.4, max_caps: float = 0.4, max_repeat: float = 0.25) -> Column:
    return let(figures(text), lambda f: passes_figures(f, min_alpha, max_caps, max_repeat))


def passes_length(text, least: int = 20, most: int = 8000) -> Column:
    return F.size(words(text)).between(least, most)


def score_passes(score, min_score: float) -> Column:
    """A missing score passes; a floor of 0 is no floor."""
    return F.lit(True) if not min_score else F.coalesce(_col(score), F.lit(float("inf"))) >= F.lit(float(min_score))


def not_blank(text) -> Column:
    return _col(text).isNotNull() & (strip(text) != "")


def normalise_space(text) -> Column:
    """Runs of spaces to one, four newlines or more to two, stripped; tabs, carriage returns and newlines stay."""
    t = F.regexp_replace(_col(text), rf"(?U)[{SPACE}&&[^\n\t\r]]+", " ")
    return strip(F.regexp_replace(t, r"\n{4,}", "\n\n"))


def normalise(text) -> Column:
    """ASCII letters for accented ones, everything else beyond ASCII left out, then normalised spaces."""
    return normalise_space(fold_ascii(_col(text)))


@F.pandas_udf(StringType())
def fold_ascii(text: pd.Series) -> pd.Series:
    """NFKD, then ASCII only. Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ends_in_cycle(text, window: int = 400, gram: int = 40, min_chars: int = 0) -> Column:
    """The last gram characters occur before, inside the last window characters."""
    w = F.right(_col(text), F.lit(window))
    before = F.substring(w, F.lit(1), F.length(w) - gram)
    found = (F.length(w) > gram) & (F.call_function("locate", F.right(_col(text), F.lit(gram)), before) > 0)
    return found & (F.length(_col(text)) >= min_chars)


def word_from_token(token) -> Column:
    """A token without its word-boundary marker."""
    return F.regexp_replace(_col(token), "^(Ġ|▁|##)", "")


def json_domain(reply) -> Column:
    """The domain field of a JSON object inside a reply, else the trimmed reply."""
    return F.coalesce(F.get_json_object(F.nullif(F.regexp_extract(_col(reply), r"(?s)\{.*\}", 0), F.lit("")), "$.domain"), F.trim(_col(reply)))


def is_meaningful_token(token, stopwords: tuple[str, ...] = (), markers: str = "Ġ▁ ") -> Column:
    """A word-initial token of letters only, longer than one character, not in capitals, not a stop word."""
    t = _col(token)
    bare = F.regexp_replace(t, f"^[{markers}]", "")
    rules = t.isNotNull() & t.rlike(f"^[{markers}]") & (F.length(bare) > 1) & bare.rlike(r"^\p{L}+$") & ~bare.rlike(r"^\p{Lu}{2,}$")
    return F.coalesce(rules & ~F.lower(bare).isin(*stopwords) if stopwords else rules, F.lit(False))

"""Token counts of whole texts by overlap resynchronisation.

A text is cut into chunks of CHUNK characters that overlap; a text of one chunk has nothing to splice. The ends of two
neighbouring chunks are encoded with offsets, each with CONTEXT characters of its own beside the overlap, and spliced at a
boundary inside the overlap that is proven stable: both have a token that starts there, they agree on the RUN tokens from
there on (ids and offsets), and the characters around it (white space, then an ASCII letter or digit) are ones across which the
tokenizer neither normalises nor merges. Where no boundary is found the overlap is widened, twice as far each time, up to the
text's end. Memory is bounded by a chunk, not by a document, unless a text has no such boundary at all.

Between two boundaries the tokens are those of the words that white space parts; a worker remembers the counts of up to MEMO
words, and the library counts new ones. The sum is the library's count for the whole text.

Defined cases: null text counts as empty (0 bytes, 0 tokens); very long texts go by chunks, as above; rows are returned one for
one, repeated ones and those with null ids too; of several proven boundaries the last one is taken; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import claim, holds, ship, slices

CHUNK, OVERLAP, CONTEXT, RUN = 8192, 128, 32, 4
MEMO = 400_000
#: White space, then an ASCII letter or digit.
STABLE = re.compile(r"(?<=[ \n])[A-Za-z0-9]")

_OPEN: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a file; one a worker."""
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = _OPEN[path] = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
    return _OPEN[path]


def _boundary(text: str, at: int, hi: int, begin: int, left, right) -> int | None:
    """The last proven boundary in text[at:hi], from the encodings left of text[begin:hi] and right of text from at on."""
    left_ids, right_ids = left.ids, right.ids
    for m in reversed(list(STABLE.finditer(text, at + 1, hi))):
        p = m.start()
        k, j = left.char_to_token(p - begin), right.char_to_token(p - at)
        if k is None or j is None or k + RUN > len(left_ids) or left_ids[k : k + RUN] != right_ids[j : j + RUN]:
            continue
        spans = [([a + begin for a in left.token_to_chars(k + r)], [a + at for a in right.token_to_chars(j + r)]) for r in range(RUN)]
        if spans[0][0][0] == p and all(a == b for a, b in spans):
            return p
    return None


def spliced(text: str, encode: Callable, chunk: int = CHUNK, overlap: int = OVERLAP, context: int = CONTEXT) -> Iterator[str]:
    """The text in pieces that begin at proven boundaries. encode gives the library's encoding (ids and offsets) of a string."""
    lo, wide = 0, overlap
    hi = min(len(text), chunk + wide)
    while hi < len(text):
        at = max(lo, hi - wide)
        begin, end = max(lo, at - context), min(len(text), hi + context)
        cut = _boundary(text, at, hi, begin, encode(text[begin:hi]), encode(text[at:end]))
        if cut:
            yield text[lo:cut]
            lo, wide = cut, overlap
            hi = min(len(text), hi - overlap + chunk + wide)
        else:  # a longer left side, and a wider overlap with what follows it
            wide *= 2
            hi = min(len(text), hi + wide)
    yield text[lo:]


class _Counts(dict):
    """Tokens by word; missing words are counted by the library."""

    def __init__(self, tok):
        self.tok = tok

    def __missing__(self, word: bytes) -> int:
        n = len(self.tok.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(self) < MEMO:
            self[word] = n
        return n


_MEMO: dict[str, _Counts] = {}
holds("token_count", _MEMO.clear)


def count_tokens(path: str, text: str) -> int:
    """The library's token count of a text."""
    tok = tokenizer(path)
    memo = _MEMO.get(path)
    if memo is None or len(memo) >= MEMO:
        memo = _MEMO[path] = _Counts(tok)
    pieces = spliced(text, lambda s: tok.encode(s, add_special_tokens=False))
    return sum(sum(map(memo.__getitem__, p.encode("utf-8", "surrogatepass").split())) for p in pieces)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_count")
        for b in slices(batches):
            n_bytes, n = [], []
            for x in b.column(1):
                t = x.as_py() or ""
                n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                n.append(count_tokens(path, t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens and over_limit. path: a tokenizers file that drops white space."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_counter(path), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (lower case, runs of ASCII non-alphanumerics as one space). An item of m characters has
an error budget of RATE * m edits and is cut into budget + 1 pieces: a passage within the budget holds at least one piece
unchanged. One Aho-Corasick automaton finds all pieces' exact hits in a text; around each hit Myers' bit-parallel algorithm
finds the least edit distance of the whole item, and those within the budget are leaks.

An item without a budget (under 1 / RATE characters) is found only as whole words.

The items are read in blocks of at most BLOCK_BYTES, which bounds the automaton; a worker builds a block's automaton once and
keeps it for its other tasks. Each block is held against all documents, whole texts, with no join and no shuffle: one scan of
the documents a block, since several automata at once would not fit a worker. With several blocks each one's result is written
and its broadcast released before the next.

Defined cases: null or empty texts and items have no leaks; very long texts are searched whole, a batch's texts one at a time;
items that are equal after normalisation each match; of equally near passages of one item the first is reported; repeated rows
and null ids are reported as they are; an empty table of documents gives no rows, one of items finds nothing and drops nothing;
other columns are ignored by find_leaks and kept by drop_leaks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import claim, holds, materialise, release, ship, slices

RATE = 0.08
BLOCK_BYTES = 4 << 20
#: ASCII other than letters and digits becomes a space; bytes of longer characters stay.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LEAK = "doc_id long, item_id long, distance long, budget long, start long, end long"


def normalise(text: str | None) -> str:
    """The normalised text, a character for each UTF-8 byte."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()).decode("latin-1")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def bits(item: str) -> dict[str, int]:
    """For each character the places where the item has it, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of a pattern to any substring of text (anchored: to any prefix), and that substring's end."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ((ph << 1) | anchored) & mask, (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """All items of a block: their pieces in one automaton, and what verification needs."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items, at = [], {}
        for item_id, text in items:
            s = normalise(text)
            if s:
                budget = int(rate * len(s))
                for off, p in pieces(s, budget):
                    at.setdefault(p, []).append((len(self.items), off))
                self.items.append((item_id, s, budget))
        self.machine = ahocorasick.Automaton()
        for p, found in at.items():
            self.machine.add_word(p, (len(p), found))
        if at:
            self.machine.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of the best match of each item within its budget."""
        s = normalise(text)
        if not s or not self.items:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (n, found) in self.machine.iter(s):
            p = last + 1 - n
            for i, off in found:
                _, item, budget = self.items[i]
                if not budget and (s[p - 1 : p].strip() or s[last + 1 : last + 2].strip()):
                    continue  # inside a word
                lo, hi = max(0, p - off - budget), min(len(s), p - off + len(item) + budget)
                own = spans.setdefault(i, [])
                if own and own[-1][0] <= lo <= own[-1][1]:
                    own[-1] = (own[-1][0], max(own[-1][1], hi))
                else:
                    own.append((lo, hi))
        out = []
        for i, own in sorted(spans.items()):
            item_id, item, budget = self.items[i]
            best, peq = None, None
            for lo, hi in own:
                if hi - lo < len(item) - budget:
                    continue
                k = s.find(item, lo, hi)
                if k >= 0:
                    best = (0, k, k + len(item))
                    break
                peq = peq or bits(item)
                d, end = myers(peq, len(item), s[lo:hi])
                if d <= budget and (best is None or d < best[0]):
                    back = myers(bits(item[::-1]), len(item), s[lo : lo + end][::-1], anchored=True)[1]
                    best = (d, lo + end - back, lo + end)
            if best:
                out.append((item_id, best[0], budget, best[1], best[2]))
        return out


_MATCHERS: dict[str, Matcher] = {}
holds("decontaminate", _MATCHERS.clear)


def _matcher(sent, rate: float) -> Matcher:
    """The worker's automaton of a block; only the last block's is kept."""
    name, items = sent.value
    if (name, rate) not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name, rate] = Matcher(items, rate)
    return _MATCHERS[name, rate]


def _texts(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")


def _count(items: DataFrame, id_col: str, text_col: str) -> int:
    total = _texts(items, id_col, text_col).agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return max(1, -(-total // BLOCK_BYTES))


def _block(items: DataFrame, id_col: str, text_col: str, k: int, n: int) -> list[tuple[int, str]]:
    """Block k of n: by a hash, so of BLOCK_BYTES on average."""
    return [tuple(r) for r in _texts(items, id_col, text_col).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def _by_block(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, step):
    """step(result so far, broadcast block) for each block of items; with several, each result is written first."""
    out, blocks = None, list(range(_count(items, id_col, text_col)))
    for k in blocks:
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, _block(items, id_col, text_col, k, len(blocks))))
        now = step(out, sent)
        if len(blocks) > 1:
            now, before = materialise(now, "leaks"), out
            sent.destroy()
            if before is not None:
                release(before)
        out = now
    return out


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, distance, budget, and where in the normalised text."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def step(before, sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("decontaminate")
            m = _matcher(sent, rate)
            for b in slices(batches):
                rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for x in m.leaks(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "distance", "budget", "start", "end"])

        found = d.mapInArrow(run, LEAK)
        return found if before is None else before.unionByName(found)

    return _by_block(docs, items, item_id_col, item_text_col, step)


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item."""
    ship(docs.sparkSession)

    def step(before, sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("decontaminate")
            m = _matcher(sent, rate)
            for b in slices(batches):
                clean = [not m.leaks(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))]
                yield b.filter(pa.array(clean, pa.bool_()))

        return (docs if before is None else before).mapInArrow(run, docs.schema)

    return _by_block(docs, items, item_id_col, item_text_col, step)

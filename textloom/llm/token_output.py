"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of their id and sorted, so that the files in name order hold ascending ids. A row has the
document's id, its tokens with the end id, and its offset in its file; the stripes are read in parallel, and a lookup by id
skips files, stripes and row groups by minimum, maximum and Bloom filter. Offsets over all files come from one row a file.

Where the tokenizer's file says that it cuts by the byte-level pattern and normalises nothing, texts are cut by that pattern,
pieces are encoded by the tokenizers library's merges, and a worker remembers up to MEMO pieces. A text with characters or
control strings for which the cuts aren't proven, and every text of a tokenizer of another kind, goes to the library as a
whole; both ways give the same ids.

Defined cases: null text is empty (the end id alone); a very long text is cut and encoded SEGMENT characters at a time, at
places where the pattern always cuts (the library, where it takes a text, takes it whole); documents with equal ids keep all
their rows, in the order in which the table is read, and can fill several ranges; null ids sort first; an empty table gives no
rows; other columns are ignored. An id array holds a document, so a document has under 2^31 tokens.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._common import claim, holds, new_path, ship
from textloom.llm.token_count import tokenizer

MEMO = 1_000_000
#: Characters in one batch of output, and in one piece of a text that is cut at once: they bound a worker's memory.
SLAB, SEGMENT = 2_000_000, 1_000_000
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts of these characters only are cut into pieces; for them the pattern below cuts as the tokenizer's does.
PROVEN = re.compile(f"[ -~\n{_L}¡¿«»–—‘’“”…]*")
PIECE = re.compile(rf" ?[{_L}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^ \n{_L}0-9]+|[ \n]+(?![^ \n])|[ \n]+")
#: A place where the pattern always cuts: before a space that follows something else and precedes a letter.
CUT = re.compile("(?<=[^ \n]) (?=[A-Za-z])")
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others
    for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


class _Numbers(dict):
    """Piece numbers; a missing piece gets the next one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def cuts_by_pattern(tok) -> bool:
    """Whether the tokenizer is a byte-level one that normalises nothing and cuts by the pattern that PIECE repeats."""
    t = json.loads(tok.to_str())
    pre, model = t["pre_tokenizer"] or {}, t["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    return t["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space") and model["type"] == "BPE" and plain


class Pieces:
    """The ids of pieces, remembered: piece number by string, and all numbers' ids in one array."""

    def __init__(self, tok):
        self.tok, self.at = tok, _Numbers()
        self.known = cuts_by_pattern(tok)
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.lens, self.starts, self.ids = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)

    def one(self, piece: str) -> list[int]:
        """The library's merges for a piece that its pattern doesn't cut."""
        plain = piece.isascii() and "\n" not in piece
        return [t.id for t in self.tok.model.tokenize(piece.replace(" ", "Ġ") if plain else piece.encode().decode("latin-1").translate(LETTERS))]

    def _learn(self) -> None:
        gc.disable()  # millions of short lists and no cycles
        got = [self.one(p) for p in self.at.new]
        gc.enable()
        self.at.new.clear()
        self.lens = np.concatenate([self.lens, np.array([len(g) for g in got], np.int32)])
        self.ids = np.concatenate([self.ids, np.array([x for g in got for x in g], np.int32)])
        self.starts = np.cumsum(self.lens, dtype=np.int32) - self.lens

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Long ones are encoded in segments, for which the same pieces are cut."""
        if any(len(t) > SEGMENT for t in texts):
            return [np.concatenate([x for part in self._segments(t) for x in self._encode([part])]) for t in texts]
        return self._encode(texts)

    def _segments(self, text: str) -> Iterator[str]:
        lo, cut = 0, self.known and self._proven(text)
        while cut and len(text) - lo > SEGMENT:
            cut = CUT.search(text, lo + SEGMENT)
            if cut:
                yield text[lo : cut.start()]
                lo = cut.start()
        yield text[lo:]

    def _proven(self, text: str) -> bool:
        return bool(PROVEN.fullmatch(text)) and not any(s in text for s in self.special)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) >= MEMO:
            self.__init__(self.tok)
        number, cuts = self.at.__getitem__, []
        for t in texts:
            if self.known and self._proven(t):
                c = PIECE.findall(t)
                cuts.append(np.fromiter(map(number, c), np.int32, len(c)))
            else:
                cuts.append(None)
        if self.at.new:
            self._learn()
        out = []
        for t, n in zip(texts, cuts):
            if n is None:
                out.append(np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int32))
            elif not len(n):
                out.append(np.empty(0, np.int32))
            else:
                lens = self.lens[n]
                ends = np.cumsum(lens, dtype=np.int32)
                at = np.repeat(self.starts[n] - (ends - lens), lens)
                at += np.arange(ends[-1], dtype=np.int32)
                out.append(self.ids[at])
        return out


_MEMO: dict[str, Pieces] = {}
holds("token_output", _MEMO.clear)


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_output")
        pieces = _MEMO.get(path) or _MEMO.setdefault(path, Pieces(tokenizer(path)))
        part, at = TaskContext.get().partitionId(), 0

        def rows(ids, toks):
            nonlocal at
            n = np.array([len(t) + 1 for t in toks], np.int64)
            off = np.concatenate([[0], np.cumsum(n)])
            flat = np.empty(off[-1], np.int32)
            for o, t in zip(off, toks):
                flat[o : o + len(t)] = t
            flat[off[1:] - 1] = end_id
            out = pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(n), part, np.int32)), pa.array(at + off[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            at += int(off[-1])
            return out

        for b in batches:
            lo, size, texts = 0, 0, []
            for i, x in enumerate(b.column(1)):
                texts.append(x.as_py() or "")
                size += len(texts[-1]) + 1
                if size >= SLAB or i == b.num_rows - 1:
                    yield rows(b.column(0).slice(lo, i + 1 - lo), pieces.encode(texts))
                    lo, size, texts = i + 1, 0, []

    return run


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents' ids as ORC files below out, in ascending order of the ids. path: the tokenizer's file."""
    ship(docs.sparkSession)
    # the row's number parts rows of one id, so that an id of many rows fills several ranges
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    d = d.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    d.mapInArrow(_encoder(path, end_id), SCHEMA).write.options(**ORC).orc(out)


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows: doc_id, part, part_start, n_tokens, ids."""
    return spark.read.schema(SCHEMA).orc(out)


def lookup(spark: SparkSession, out: str, ids: list[int]) -> DataFrame:
    """The rows of some documents. The filter reaches the reader, which skips files, stripes and row groups without them."""
    return read_tokens(spark, out).where(F.col("doc_id").isin(*ids))


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """One row a file: part, n_docs, n_tokens and start (the tokens of all files before it)."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    per = read_tokens(spark, out).groupBy("part").agg(F.count("*").alias("n_docs"), F.max(F.col("part_start") + F.col("n_tokens")).alias("n_tokens"))
    return per.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).cast("long"))


def digests(spark: SparkSession, out: str) -> DataFrame:
    """Read back from the files: doc_id, start, n_tokens and ids_crc32."""
    ship(spark)
    rows = read_tokens(spark, out).select("doc_id", "part", "part_start", "ids").mapInArrow(_crcs, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(manifest(spark, out).select("part", F.col("start").alias("base")), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write docs to a new folder in the shared storage and read the digests back."""
    out = new_path(docs.sparkSession, "tokens-orc")
    write_tokens(docs, out, path, end_id)
    return digests(docs.sparkSession, out)

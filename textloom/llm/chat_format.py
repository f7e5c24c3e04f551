"""Chat formatting by columnar byte assembly.

Each turn becomes ``<|role|>ROLE<|text|>TEXT<|end|>\\n``; a conversation is its turns in order. In roles and texts each of
``<``, ``[`` and ``\\`` is followed by an inserted ``\\``, so that no control string of this template or of another
(``<|end|>``, ``</s>``, ``[INST]``) is left in them; leaving out the character after each of the three gives the content back.

A batch is assembled in numpy: segment lengths, cumulative offsets and scatter indices come from the Arrow offsets, and
headers and contents are copied into one preallocated buffer that becomes the Arrow string column. The loss mask is a list
of code point ranges, one for each assistant text.

Texts are copied in pieces of STEP bytes, so index arrays never grow with a text; rows are assembled once they have PART_BYTES,
and a batch's memory is a few times that (or its longest text). Offsets are 64-bit until the Arrow column, whose 32 bits a
part beyond 2 GiB would not fit: that raises an error.

Defined cases: null roles and texts count as empty; rows with a null id form one conversation; turns tie by role, then text;
repeated rows are repeated turns; an empty table gives no rows; other columns are ignored. A conversation longer than
PART_BYTES comes in several rows, by part, next to one another. All of a conversation is in one task, as streams, because a
digest over it must read it in order; its memory is that of a part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import ship, slices

ROLE, TEXT, END = b"<|role|>", b"<|text|>", b"<|end|>\n"
ESCAPED = np.zeros(256, bool)
ESCAPED[list(b"<[\\")] = True
PART_BYTES, STEP = 8 << 20, 1 << 20
SCHEMA = "conv_id long, part int, n_turns long, formatted string, loss_start array<int>, loss_end array<int>"


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and data of a string array, nulls as empty."""
    a = pc.fill_null(a, "").cast(pa.large_string())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.empty(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def escape(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hit = np.flatnonzero(ESCAPED[data])
    out = np.empty(len(data) + len(hit), np.uint8)
    for lo in range(0, len(data), STEP):
        piece = data[lo : lo + STEP]
        i, j = np.searchsorted(hit, (lo, lo + len(piece)))
        wide = ESCAPED[piece]
        at = lo + i + np.arange(len(piece)) + np.cumsum(wide) - wide
        out[at] = piece
        out[at[wide] + 1] = ord("\\")
    return off + np.searchsorted(hit, off), out


def unescape(s: str) -> str:
    return re.sub(r"([<\[\\])\\", r"\1", s)


def _scatter(out: np.ndarray, at: np.ndarray, off: np.ndarray, data: np.ndarray) -> None:
    """Copy the i-th piece of data, off[i] to off[i + 1], to out from at[i] on."""
    for lo in range(0, len(data), STEP):
        hi = min(lo + STEP, len(data))
        i, j = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, hi)
        edges = np.clip(off[i : j + 1], lo, hi)
        out[np.repeat(at[i:j] - off[i:j], np.diff(edges)) + np.arange(lo, hi)] = data[lo:hi]


def _characters(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of code points of UTF-8 bytes before each place."""
    total, before = 0, np.empty(len(at), np.int64)
    order = np.argsort(at, kind="stable")
    places, k = at[order], 0
    for lo in range(0, len(out) + 1, STEP):
        upto = np.concatenate([[0], np.cumsum((out[lo : lo + STEP] & 0xC0) != 0x80)])
        j = np.searchsorted(places, lo + STEP)
        before[order[k:j]] = total + upto[places[k:j] - lo]
        total, k = total + int(upto[-1]), j
    return before


def assemble(conv: list, first: np.ndarray, roles: pa.Array, texts: pa.Array, part: int) -> pa.RecordBatch:
    """One row for each conversation; first: the row at which each begins."""
    n = len(roles)
    ro, rd = escape(*_bytes(roles))
    to, td = escape(*_bytes(texts))
    role_at = len(ROLE)
    text_at = role_at + np.diff(ro) + len(TEXT)
    end_at = text_at + np.diff(to)
    starts = np.concatenate([[0], np.cumsum(end_at + len(END))])
    out = np.empty(starts[-1], np.uint8)
    base = starts[:-1]
    for head, at in ((ROLE, base), (TEXT, base + text_at - len(TEXT)), (END, base + end_at)):
        out[at[:, None] + np.arange(len(head))] = np.frombuffer(head, np.uint8)
    _scatter(out, base + role_at, ro, rd)
    _scatter(out, base + text_at, to, td)
    if starts[-1] >= 1 << 31:
        raise ValueError("a part of a conversation is over 2 GiB")
    heads = np.append(first, n)
    which = np.repeat(np.arange(len(first)), np.diff(heads))
    loss = pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False)
    chars = _characters(out, np.concatenate([starts[first], (base + text_at)[loss], (base + end_at)[loss]]))
    zero, lo, hi = np.split(chars, [len(first), len(first) + loss.sum()])
    lo, hi = lo - zero[which[loss]], hi - zero[which[loss]]
    loss_off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(which[loss], minlength=len(first)))]).astype(np.int32))
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(starts[heads].astype(np.int32)), pa.py_buffer(out))
    parts = np.zeros(len(first), np.int32)
    parts[0] = part
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.int64()), pa.array(parts), pa.array(np.diff(heads), pa.int64()), text, pa.ListArray.from_arrays(loss_off, pa.array(lo.astype(np.int32))), pa.ListArray.from_arrays(loss_off, pa.array(hi.astype(np.int32)))],
        names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"],
    )


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # rows of a conversation that can go on in the next batch
    part = 0

    def rows(t: pa.Table, part: int) -> pa.RecordBatch:
        ids = t.column("conv_id").to_pylist()
        first = np.array([i for i, x in enumerate(ids) if not i or x != ids[i - 1]], np.int64)
        return assemble([ids[i] for i in first], first, t.column("role").combine_chunks(), t.column("text").combine_chunks(), part)

    def cut_by_bytes(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum(np.diff(_bytes(b.column(1))[0]) + np.diff(_bytes(b.column(2))[0]) + 32)
        lo = 0
        while lo < b.num_rows:  # rows of PART_BYTES in all, one row at least
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PART_BYTES, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi

    for now in (x for b in batches for x in cut_by_bytes(b)):
        if held and held[0].column(0)[0].as_py() != now.column(0)[0].as_py():
            yield rows(pa.Table.from_batches(held), part)
            held, part = [], 0
        ids = now.column(0).to_pylist()
        cut = next((i + 1 for i in range(len(ids) - 2, -1, -1) if ids[i] != ids[-1]), 0)
        if cut:
            yield rows(pa.Table.from_batches([*held, now.slice(0, cut)]), part)
            held, part = [], 0
        held.append(now.slice(cut))
        if sum(x.nbytes for x in held) >= PART_BYTES:
            yield rows(pa.Table.from_batches(held), part)
            held, part = [], part + 1
    if held:
        yield rows(pa.Table.from_batches(held), part)


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows conv_id, part, n_turns, formatted, loss_start and loss_end (code point ranges of the assistant texts)."""
    ship(turns.sparkSession)
    t = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.select("conv_id", "role", "text").mapInArrow(_format, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    turns = formatted.split(END.decode())[:-1]
    return [tuple(unescape(x) for x in t.removeprefix(ROLE.decode()).split(TEXT.decode(), 1)) for t in turns]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, now = None, None

    def row(x):
        return {"conv_id": x[0], "n_turns": x[1], "turns_sha256": x[2].hexdigest(), "loss_chars": x[3], "loss_sha256": x[4].hexdigest(), "formatted_chars": x[5]}

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for b in batches:
        done = []
        for r in (x for one in slices(iter([b]), 64) for x in one.to_pylist()):
            if now is None or not r["part"]:
                if now:
                    done.append(row(now))
                now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            s = r["formatted"]
            for role, text in parse(s):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for lo, hi in zip(r["loss_start"], r["loss_end"]):
                text = unescape(s[lo:hi])
                now[3] += len(text)
                now[4].update(text.encode("utf-8", "surrogatepass"))
            now[5] += len(s)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if now:
        yield pa.RecordBatch.from_pylist([row(now)], schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """A digest row for each conversation, parsed from chat_format's rows in the order in which it gives them."""
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

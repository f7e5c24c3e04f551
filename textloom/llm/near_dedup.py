"""MinHash near-dedup: fast similarity sketches, banding, exact verification, connected components.

A document's set holds its distinct 5-word shingles (words are runs of anything but ASCII white space, A-Z lower-cased);
with fewer words the whole sequence is the one shingle. Shingles are 64-bit hashes. Two documents are linked when the
Jaccard similarity of their full sets reaches the threshold.

1. Each document is read once: its set's size, a 128-bit key of the set, and a sketch of T coordinates, filled by rounds
   of hashed bin placement. Round i < T throws each element into a random bin, round T + j puts all elements into bin j;
   a bin keeps the least (round, hash), and a document stops after the round that fills its last bin.
2. Documents with equal sets collapse to the smallest id before anything is paired.
3. Band hashes give buckets. Each representative is compared with one bucket leader, exactly, and connected components
   are formed, so that a group of near copies costs one comparison a document and not one a pair.
4. In the buckets that still hold several components, the pairs across components are compared inside blocks: by sketch
   (8-bit coordinates rule out pairs that are over five standard deviations below the threshold), then by full sets.
   A block emits the links that join components, never pairs.
A bucket of n documents that no link joins takes n / BLOCK copies of each and n * n / 2 comparisons of sketches, in blocks of
bounded size; pairs are neither dropped nor written.

Defined cases: null or wordless text has no shingles and links with nothing; texts are read whole, however long; rows with a
null id link with nothing, have a null component and are kept; the rows of one id are one node, whatever their texts, so
repeated rows share a component and an id with several texts joins theirs; ties go to the smaller id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import claim, holds, materialise, release, ship, slices

T, ROWS = 200, 5
BANDS = T // ROWS
SHINGLE = 5
#: Of T 8-bit coordinates, so many agree for pairs worth an exact comparison: 0.75 * T less 5.2 standard deviations.
LEAST_AGREE = 118
#: Documents in one side of a block when a bucket's pairs are compared.
BLOCK = 512
#: Up to so many ids are broadcast to select documents for verification (16 bytes each); beyond, a shuffled join selects them.
BROADCAST_IDS = 2_000_000
#: Words whose hashes a worker remembers before it starts anew.
MEMO = 400_000
#: Shingles hashed at once, which bounds a worker's memory.
SLAB = 1_000_000
K = np.uint64(0x9E3779B97F4A7C15)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        v = xxhash.xxh3_64_intdigest(word, 7)
        if len(self) < MEMO:
            self[word] = v
        return v


_HASH = _WordHash()
holds("near_dedup", _HASH.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_HASH) >= MEMO:
        _HASH.clear()
    w = np.array(list(map(_HASH.__getitem__, words)), np.uint64)
    with np.errstate(over="ignore"):
        if len(w) < k:
            h = np.array([len(w)], np.uint64)
            for x in w:
                h = mix(h * K + x)
            return h
        n = len(w) - k + 1
        h = w[:n].copy()
        for i in range(1, k):
            h *= K
            h += w[i : i + n]
    return np.unique(mix(h))


def sketch(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t coordinates for each non-empty set, by fast similarity sketching."""
    out = np.full((len(sets), t), FULL, np.uint64)
    lens = np.array([len(s) for s in sets])
    elems, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lens)
    active = np.arange(len(sets))
    s = out.copy()
    for i in range(2 * t):
        h = mix(elems + np.uint64((i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        b = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(s.reshape(-1), owner * t + b, (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32))
        done = (s != FULL).all(axis=1)
        if done.any():
            out[active[done]] = s[done]
            left = ~done
            stay = left[owner]
            elems, owner = elems[stay], (np.cumsum(left) - 1)[owner[stay]]
            active, s = active[left], s[left]
            if not len(active):
                break
    return out


def bands_of(s: np.ndarray) -> np.ndarray:
    """The 64-bit bucket of each band."""
    rows = s.reshape(len(s), -1, ROWS)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64), rows.shape[:2]) * K
        for i in range(ROWS):
            h = mix(h * K + rows[:, :, i])
    return h.view(np.int64)


_FEATURES = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(ids, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        key = np.zeros((len(sets), 2), np.int64)
        bands, sigs = [None] * len(sets), [None] * len(sets)
        if full:
            sk = sketch([sets[i] for i in full])
            bs, sg = bands_of(sk), (mix(sk) & np.uint64(0xFF)).astype(np.uint8)
            for j, i in enumerate(full):
                key[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.int64)
                bands[i], sigs[i] = bs[j], sg[j].tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["doc_id", "n_shingles", "k1", "k2", "bands", "sig"],
        )

    claim("near_dedup")
    for b in slices(batches, 2000):
        ids, sets, n = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            s = shingle_set(t.as_py())
            ids.append(i)
            sets.append(s)
            n += len(s) + T
            if n >= SLAB:
                yield flush(ids, sets)
                ids, sets, n = [], [], 0
        if ids:
            yield flush(ids, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, k1 (the first half of the set's key) and the set."""
    claim("near_dedup")
    for part in slices(batches):
        sets = [shingle_set(t.as_py()) for t in part.column(1)]
        key = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)[0] for x in sets], np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "k1", "shingles"])


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) with the smallest reachable node as root, for edges (u, v); by alternating large and small stars.

    Each round is two aggregations of minima over the edges, which are never more than given. Rounds end when a round
    changes nothing; the driver sees two numbers a round.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        old, e = e, materialise(small, name)
        release(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        last = now


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of rows (u, uk, v, vk) whose full sets meet the threshold num / den."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("k1").alias("uk"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("k1").alias("vk"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("long")
    near = (F.least(F.size("a"), F.size("b")) * den >= F.greatest(F.size("a"), F.size("b")) * num)
    x = pairs.join(a, ["u", "uk"]).join(b, ["v", "vk"]).where(near).select("u", "v", both.alias("i"), (F.size("a").cast("long") + F.size("b")).alias("s"))
    return x.where(F.col("i") * den >= (F.col("s") - F.col("i")) * num).select("u", "v")


_LINKS = "u long, v long"


def _block_links(num: int, den: int):
    """Links across components, from rows (bucket, i, j, side, doc_id, comp, sig, bands, shingles) sorted by (bucket, i, j).

    Pairs go from the most alike by sketch to the least, and components that a link has joined are not compared again, so
    a block gives fewer links than it has components. A pair is compared in the first of its common buckets only.
    """

    def links(bucket: int, rows: list[tuple]) -> list[tuple[int, int]]:
        side, ids, comp = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sig = np.stack([r[3] for r in rows])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        agree, pairs = [np.empty(0, np.uint8)], [np.empty((0, 2), np.int32)]
        for i in left:
            cand = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (side[right] == 1))]
            if len(cand):
                n = (sig[cand] == sig[i]).sum(axis=1)
                cand, n = cand[n >= LEAST_AGREE], n[n >= LEAST_AGREE]
                agree.append(n.astype(np.uint8))
                pairs.append(np.stack([np.full(len(cand), i), cand], axis=1).astype(np.int32))
        agree, pairs = np.concatenate(agree), np.concatenate(pairs)
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        out = []
        for k in np.argsort(255 - agree, kind="stable"):
            i, j = pairs[k]
            a, b = top(comp[i]), top(comp[j])
            if a == b or np.flatnonzero(rows[i][4] == rows[j][4])[0] != np.flatnonzero(rows[i][4] == bucket)[0]:
                continue
            x, y = rows[i][5], rows[j][5]
            if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
                continue
            at = np.searchsorted(x, y)
            both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
            if both * den >= (len(x) + len(y) - both) * num:
                out.append((int(ids[i]), int(ids[j])))
                root[max(a, b)] = min(a, b)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out():
            pairs = links(key[0], rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(7)]
            lists = []
            for k in (7, 8):
                off, flat = b.column(k).offsets.to_numpy(), b.column(k).values.to_numpy(zero_copy_only=False)
                lists.append([flat[lo:hi].copy() for lo, hi in zip(off, off[1:])])
            for bucket, i, j, side, doc, comp, sig, bands, shingles in zip(*cols, *lists):
                if (bucket, i, j) != key:
                    if rows:
                        yield out()
                    key, rows = (bucket, i, j), []
                rows.append((side, doc, comp, np.frombuffer(sig, np.uint8), bands, shingles.view(np.uint64)))
        if rows:
            yield out()

    return run


def _cross_links(buckets: DataFrame, comps: DataFrame, sketches: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) across components, from the buckets with several; a large bucket is dealt in block pairs."""
    m = buckets.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).select("bucket", "doc_id", "k1", "comp")
    m = m.join(sketches.select("doc_id", "k1", "n_shingles"), ["doc_id", "k1"])
    mixed = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("lo <> hi")
    rows = m.select("bucket", "doc_id", "k1", "comp").join(mixed.select("bucket", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") / SLAB)).cast("int").alias("nb")), "bucket")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "k1"), F.col("nb")).cast("int"))
    # side 2: within one block; 0 and 1: between two blocks
    at = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least(k, F.col("g")).alias("i"), F.greatest(k, F.col("g")).alias("j"), F.when(k == F.col("g"), 2).when(F.col("g") < k, 0).otherwise(1).alias("side")))
    dealt = rows.withColumn("x", F.explode(at)).select("bucket", "x.i", "x.j", "x.side", "doc_id", "k1", "comp")
    dealt = dealt.join(sketches.select("doc_id", "k1", "sig", "bands"), ["doc_id", "k1"]).join(sets, ["doc_id", "k1"])
    dealt = dealt.select("bucket", "i", "j", "side", "doc_id", "comp", "sig", "bands", "shingles").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(_block_links(num, den), _LINKS).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id and kept (the smallest id of each component)."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = materialise(base.mapInArrow(_features, _FEATURES), "near-features")
    some = feats.where("n_shingles > 0 and doc_id is not null")
    # stored, so that both sides of the joins are shuffled and a key of many copies can be split
    classes = materialise(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "near-classes")
    repeated = not some.groupBy("doc_id").count().where("count > 1").isEmpty()
    # one row for each id and set; only where ids repeat is there anything to drop
    once = lambda df: df.dropDuplicates(["doc_id", "k1"]) if repeated else df
    reps = once(some.join(classes, ["k1", "k2"]).where("doc_id = rep").select("doc_id", "k1", "bands"))
    flat = reps.select("doc_id", "k1", F.explode("bands").alias("bucket"))
    multi = flat.groupBy("bucket").agg(F.min(F.struct("doc_id", "k1")).alias("lead"), F.max("doc_id").alias("most")).where("lead.doc_id <> most").select("bucket", F.col("lead.doc_id").alias("lead"), F.col("lead.k1").alias("lead_k1"))
    buckets = materialise(flat.join(multi, "bucket"), "near-buckets")
    members = materialise(buckets.select("doc_id", "k1").distinct(), "near-members")
    small = members.count() <= BROADCAST_IDS
    pick = lambda df: F.broadcast(df) if small else df
    texts = base.join(pick(members.select("doc_id").distinct() if repeated else members.select("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "doc_id long, k1 long, shingles array<long>")
    if repeated:
        sets = once(sets.join(pick(members), ["doc_id", "k1"], "left_semi"))
    sets = materialise(sets, "near-sets")
    sketches = once(feats.join(pick(members), ["doc_id", "k1"], "left_semi").select("doc_id", "k1", "n_shingles", "sig", "bands"))
    # one leader for each document: the one it meets in most buckets
    stars = buckets.where("doc_id <> lead").groupBy("doc_id", "k1", "lead", "lead_k1").count()
    best = stars.groupBy("doc_id", "k1").agg(F.max_by(F.struct("lead", "lead_k1"), F.struct("count", -F.col("lead"), "lead_k1")).alias("b"))
    edges = _verified(best.select(F.col("doc_id").alias("u"), F.col("k1").alias("uk"), F.col("b.lead").alias("v"), F.col("b.lead_k1").alias("vk")), sets, num, den)
    own = some.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "rep")
    if repeated:  # the classes that one id's texts are in belong together
        several = own.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
        edges = edges.unionByName(own.join(several, "doc_id").where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct())
    edges = materialise(edges, "near-links")
    comps = connected_components(edges)
    more = materialise(_cross_links(buckets, comps, sketches, sets, num, den), "near-links")
    first, comps = comps, connected_components(edges.unionByName(more))
    for done in (first, buckets, members, sets, edges, more):
        release(done)
    members_of = own.join(comps.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = feats.select("doc_id", "n_shingles").join(members_of, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

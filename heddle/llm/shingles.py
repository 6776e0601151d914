"""Pairs of texts of whose five-word shingles 0.8 or more agree (the shared part of both sets together), and their components.

Exact: under one order of all shingles, two sets as alike as that share one of their first n - ceil(0.8 n) + 1 elements.
Rare shingles come first, so few texts meet. Which are common is told by a sample; that bears on cost alone, since any
order serves. At first texts that share a frequent key meet a few others only, besides SimHash links, so that a large
group of near copies is mostly one component when, in the second round, all of its pairs between different components
are formed. Every link is verified by its two sets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import decontaminate, simhash
from heddle.llm.common import discard, materialise, path_of, sweep
from heddle.llm.components import connected_components
from heddle.llm.tokens import forget_encoders, slices

WORDS = 5
#: Texts that tell which shingles are common, and how many of those are told to all tasks (3 MB).
SAMPLE, MOST_COMMON = 4000, 200_000
#: Groups of this size or less form all pairs in the first round; in larger ones each text meets so many others there.
SMALL_GROUP, MEET_FIRST = 16, 3
#: Parities of a sketch: the fewest, and the most that travel with each key.
LEAST_BITS, KEY_BITS = 512, 4096
#: Pairs, or keys with their sketches, that a task puts into one batch.
PAIRS_AT_ONCE, KEYS_AT_ONCE = 1 << 17, 1 << 14
#: Links that the driver takes at most to tell their components without rounds (4 MB).
LINKS_AT_ONCE = 1 << 18


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    found = simhash.WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(line, simhash.SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-WORDS] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(line[a:b], simhash.SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)], np.uint64))


def _node(s: np.ndarray) -> int:
    import xxhash

    return simhash._signed(xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED))


def _sketch(s: np.ndarray) -> bytes:
    """Parities of counts, as many as elements or more. Where two sketches differ, the sets differ in an element at least."""
    bits = 1 << max(LEAST_BITS.bit_length() - 1, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _folded(sketches: Sequence[bytes], width: int) -> np.ndarray:
    """A row of words for each sketch, the larger ones folded to `width` bytes: parities of places that fall together add up."""
    out = np.empty((len(sketches), width // 8), np.uint64)
    size = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), n // 8)
        while x.shape[1] > width // 8:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        out[at] = x
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))  # both / (a + b - both) >= 0.8


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that more than one text of a sample holds, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    yield pa.record_batch([pa.array(shingle_set(t or b"").view(np.int64))], ["h"])

    of = max(1, docs.count() // SAMPLE)
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(of)) == 0).distinct()
    t = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = np.asarray(t.column("h")).astype(np.int64).view(np.uint64), np.asarray(t.column("n")).astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _described(docs: DataFrame, distance_words: int) -> DataFrame:
    """doc_id, node (a hash of the set), fp, n (its size), keys (the first of its elements, rare ones before), sketch, small (it, folded to the fewest parities)."""
    held = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        common, count = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, fps, sizes, keys, sketches = [], [], [], [], []
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    s = shingle_set(t or b"")
                    n = len(s)
                    seen = np.zeros(n, np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        seen = np.where(common[at] == s, count[at], 0)
                    first = np.lexsort((s, seen))[: n - (4 * n + 4) // 5 + 1]
                    nodes.append(_node(s))
                    fps.append(simhash.fingerprint(t or b"", distance_words))
                    sizes.append(n)
                    keys.append(s[first].view(np.int64))
                    sketches.append(_sketch(s))
                ends = np.cumsum([0, *map(len, keys)])
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(sketches, pa.binary()), pa.array([x.tobytes() for x in _folded(sketches, LEAST_BITS // 8)], pa.binary())],
                    ["doc_id", "node", "fp", "n", "keys", "sketch", "small"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, node bigint, fp bigint, n bigint, keys array<bigint>, sketch binary, small binary")


def _may_be_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, n (both sizes), long, x, y (their sketches): a, b, long of those whose sketches differ by no more than alike sets can."""
    for batch in batches:
        x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
        n, width = np.asarray(batch.column("n")), np.fromiter((min(len(u), len(v)) for u, v in zip(x, y, strict=True)), np.int64, len(x))
        ok = np.zeros(len(n), bool)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            # The sets' difference, of which a ninth of both sizes is allowed, is as much as the sketches' or more.
            ok[at] = 9 * np.bitwise_count(_folded([x[i] for i in at], w) ^ _folded([y[i] for i in at], w)).sum(axis=1, dtype=np.int64) <= n[at]
        yield batch.select(["a", "b", "long"]).filter(pa.array(ok))


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs a, b of nodes, each once, whose sizes and sketches allow them to be alike; no alike pair is lost.

    sketches: node, n, sketch, small. Longer texts, of which a small sketch tells little, are held against each other by
    their whole sketches too, if the small ones leave a pair.
    """
    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c, v, n, sketch: sketches.select(F.col("node").alias(c), F.col(sketch).alias(v), F.col("n").alias(n))
    fits = "5 * least(n1, n2) >= 4 * greatest(n1, n2)"
    size = [(F.col("n1") + F.col("n2")).alias("n"), (F.least("n1", "n2") > LEAST_BITS).alias("long")]
    both = pairs.join(side("a", "x", "n1", "small"), "a").join(side("b", "y", "n2", "small"), "b").where(fits)
    near = materialise(both.select("a", "b", *size, "x", "y").mapInArrow(_may_be_alike, "a bigint, b bigint, long boolean"), "shingle-near")
    wide = sketches.where(F.col("n") > LEAST_BITS)
    side = lambda c, v, n, sketch: wide.select(F.col("node").alias(c), F.col(sketch).alias(v), F.col("n").alias(n))
    both = near.where("long").select("a", "b").join(side("a", "x", "n1", "sketch"), "a").join(side("b", "y", "n2", "sketch"), "b")
    again = both.select("a", "b", *size, "x", "y").mapInArrow(_may_be_alike, "a bigint, b bigint, long boolean")
    return materialise(near.where("not long").select("a", "b").unionByName(again.select("a", "b")), "shingle-pairs")


def set_table(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, s: the sets that the pairs name, and a few that pass their filter by chance."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    held = docs.sparkSession.sparkContext.broadcast(decontaminate.bloom(wanted))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                s = [shingle_set(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
                h = np.array([_node(x) for x in s], np.int64).view(np.uint64)
                ok = np.ones(len(h), bool)
                for p in decontaminate._probes(h, 64 * len(bits)):
                    ok &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                at = np.flatnonzero(ok)
                yield pa.record_batch([pa.array(h[at].view(np.int64)), pa.array([s[i].tobytes() for i in at], pa.binary())], ["node", "s"])

    return materialise(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(sets, "node bigint, s binary").dropDuplicates(["node"]), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets are alike."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "x")):
            ok = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return materialise(both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "shingle-links")


def linked(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """node, root of the components that the alike ones among the pairs, and `roots` if given, make.

    A pair between texts that are connected already tells nothing new. So each text's first pair is verified, then each
    component's first pair with another one, and then all pairs that still are between different components.
    """
    left = plausible(pairs, sketches)
    sets = set_table(docs, left)
    sweep(docs.sparkSession)
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")) if roots is not None else None
    for last in (False, False, True):
        some = left if roots is None else _between(left, roots)
        if not last:
            ends = some.select(F.coalesce("ra", "a").alias("v"), "a", "b").unionByName(some.select(F.coalesce("rb", "b").alias("v"), "a", "b")) if roots is not None else some.select(F.col("a").alias("v"), "a", "b").unionByName(some.select(F.col("b").alias("v"), "a", "b"))
            some = ends.groupBy("v").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b").distinct()
        some = materialise(some.select("a", "b"), "shingle-try")
        good = verified(some, sets)
        links = good if links is None else links.unionByName(good)
        roots = materialise(connected_components(links, LINKS_AT_ONCE), "shingle-roots")
        left = left.join(some, ["a", "b"], "left_anti")
        sweep(docs.sparkSession)
    discard(docs.sparkSession, [path_of(sets)])
    return roots


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, ra, rb of the pairs between different components."""
    side = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
    return pairs.join(side("a", "ra"), "a", "left").join(side("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))


def _meet(every: bool):
    """key, node, n, at (and root and sketch, if `every`), sorted by key and n, to pairs a, b of different roots that can be alike if key is the
    first they share. Unless `every`, larger groups give a part of their pairs, and their key as `more`."""

    def may(n1, n2, p1, p2, r1, r2):
        left = 1 + np.minimum(n1 - 1 - p1, n2 - 1 - p2)
        return (r1 != r2) & (5 * n1 >= 4 * n2) & (9 * left >= 4 * (n1 + n2))  # n1 <= n2

    def told(a: list, b: list) -> pa.RecordBatch:
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "more"])

    def all_pairs(node, n, at, root, sketch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width, held, bits = np.fromiter(map(len, sketch), np.int64, len(sketch)), 0, None  # n and width don't fall
        for i in range(len(n) - 1):
            if width[i] != held:  # the rows of this width, and those of the next that are not too long for its longest
                held, start, last = width[i], i, int(np.searchsorted(width, width[i], "right")) - 1
                bits = _folded(sketch[i : int(np.searchsorted(n, 5 * n[last] // 4, "right"))], int(held))
            e = int(np.searchsorted(n, 5 * n[i] // 4, "right"))
            near = i + 1 + np.flatnonzero(may(n[i], n[i + 1 : e], at[i], at[i + 1 : e], root[i], root[i + 1 : e]))
            # n1 + n2 - 2 x both sets' part, of which a ninth of n1 + n2 is allowed, is as much or more.
            near = near[9 * np.bitwise_count(bits[near - start] ^ bits[i - start]).sum(axis=1, dtype=np.int64) <= n[i] + n[near]]
            yield np.full(len(near), node[i]), node[near]

    def pairs(key, node, n, at, root, sketch=None) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        large = size > SMALL_GROUP
        if every:
            a, b, found = [], [], 0
            for s, m in zip(first[large].tolist(), size[large].tolist(), strict=True):
                for x, y in all_pairs(*(c[s : s + m] for c in (node, n, at, root, sketch))):
                    a.append(x)
                    b.append(y)
                    found += len(x)
                    if found >= PAIRS_AT_ONCE or len(a) >= PAIRS_AT_ONCE:
                        yield told(a, b)
                        a, b, found = [], [], 0
            if found:
                yield told(a, b)
        elif large.any():
            more = pa.array(key[first[large]])
            yield pa.record_batch([pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int64()), more], ["a", "b", "more"])
        for rows, most in ((np.repeat(~large & (size > 1), size), SMALL_GROUP - 1), (np.repeat(large, size), 0 if every else MEET_FIRST)):
            k, v, c, p, r = key[rows], node[rows], n[rows], at[rows], root[rows]
            for step in range(1, most + 1):
                same = k[step:] == k[:-step]
                if not same.any():
                    break
                ok = same & may(c[:-step], c[step:], p[:-step], p[step:], r[:-step], r[step:])
                yield told([v[:-step][ok]], [v[step:][ok]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last group, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(c).astype(np.int64) for c in batch.columns[: 5 if every else 4]]
            if not every:
                now.append(now[1])  # each text is its own root
            else:
                now.append(np.array(batch.column("sketch").to_pylist(), dtype=object))
            if held and now[0][-1] == held[0][0][0]:
                held.append(now)
                continue
            start = int(np.searchsorted(now[0], now[0][-1]))
            held.append([c[:start] for c in now])
            yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [[c[start:] for c in now]]
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _first_met(sets: DataFrame) -> DataFrame:
    """sets: node, n, keys. Pairs of sets that share a key, and the keys of which not all pairs are among them."""
    rows = sets.select("node", "n", F.posexplode("keys").alias("at", "key")).select("key", "node", F.col("n").cast("int").alias("n"), "at")
    # Texts of one length in an order of each key's own, so that the few they meet first differ from key to key.
    return rows.repartition("key").sortWithinPartitions("key", "n", F.xxhash64("key", "node")).mapInArrow(_meet(False), "a bigint, b bigint, more bigint")


def _kept_keys(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each key of each set that is among `keys` (h), or passes their filter by chance."""
    held = sets.sparkSession.sparkContext.broadcast(decontaminate.bloom(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            lists = batch.column("keys")
            size = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            h, ok = flat.view(np.uint64), np.ones(len(flat), bool)
            for p in decontaminate._probes(h, 64 * len(bits)):
                ok &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            kept = np.flatnonzero(ok)
            sketch = [x if len(x) <= KEY_BITS // 8 else _folded([x], KEY_BITS // 8).tobytes() for x in batch.column("sketch").to_pylist()]
            for i in range(0, len(kept), KEYS_AT_ONCE):
                some = kept[i : i + KEYS_AT_ONCE]
                of = pa.array(row[some])
                yield pa.record_batch([pa.array(flat[some]), *(batch.column(c).take(of) for c in ("node", "n")), pa.array(at[some]), batch.column("root").take(of), pa.array([sketch[r] for r in row[some]], pa.binary())], ["key", "node", "n", "at", "root", "sketch"])

    return sets.select("node", "n", "root", "keys", "sketch").mapInArrow(run, "key bigint, node bigint, n bigint, at bigint, root bigint, sketch binary")


def near_copies(docs: DataFrame, words: int, distance: int) -> DataFrame:
    """doc_id, component_id for every row of docs: the smallest doc_id of those that chains of alike texts connect."""
    rows = materialise(_described(docs, words), "shingles")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "shingle-nodes")
    prints = materialise(nodes.groupBy("fp").agg(F.min("node").alias("head")), "shingle-prints")
    links = simhash.link_fingerprints(prints.select("fp"), distance)
    head = lambda c: prints.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}"))
    sets = rows.select("node", "n", "keys", "sketch", "small").dropDuplicates(["node"])
    sketches = materialise(sets.select("node", "n", "sketch", "small"), "shingle-sketches")
    met = materialise(_first_met(sets), "shingle-met")
    sweep(docs.sparkSession)
    first = met.where("a is not null").select("a", "b").unionByName(nodes.join(prints, "fp").select(F.col("node").alias("a"), F.col("head").alias("b")).unionByName(links.join(head("a"), "a").join(head("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))))
    roots = linked(docs, first, sketches)

    frequent = met.where("more is not null").select(F.col("more").alias("h"))
    again = _kept_keys(sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), frequent)
    again = again.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_meet(True), "a bigint, b bigint, more bigint")
    roots = linked(docs, again.select("a", "b"), sketches, roots)

    rooted = materialise(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "shingle-rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "shingle-least")
    named = materialise(rooted.join(least, "root").select("node", "component_id"), "shingle-named")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")

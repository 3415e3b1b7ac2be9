"""SimHash near-duplicates: 64-bit fingerprints, compared through vertical bit planes.

Plan. Fingerprints are made once per document and written (16 bytes a row). Equal ones fall
together in one aggregation with map-side combining, so thousands of copies cost one row from
there on. Distinct fingerprints meet where two of four 16-bit blocks agree, which every pair
within two bits must do; the sorted groups are streamed, and inside a group the fingerprints
are turned into bit planes, whose differences are added up in carry-save counters for 64
fingerprints at a time. A group sends out only a spanning forest of its links. Groups beyond
`group_limit` go to a second key level (six of eight 8-bit blocks), whose groups have 2**16
distinct members at most; no link is lost. Star rounds then join the forests.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other. Repeated
rows keep their rows. Null doc_ids keep a row and a component, but never name one (a component
of null ids only has a null component_id). Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import blank_words, map_rows, utf8
from emberlog.llm.components import connected_components
from emberlog.runtime import materialize

BITS = 64
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_CHUNK = 1 << 16
BROADCAST_ROWS = 500_000  # of a few numbers each: some 20 MB


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The majority bit of XXH64 over all word shingles, repeats included; zero without words."""
    words = blank_words(text)
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    totals = np.zeros(BITS, dtype=np.int64)
    hash64 = xxhash.xxh64_intdigest
    for start in range(0, count, _CHUNK):
        part = words[start : min(start + _CHUNK, count) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter(map(hash64, shingles, repeat(seed)), dtype=np.uint64)
        octets = hashes.view(np.uint8).reshape(-1, 8)
        if len(hashes) < 48:
            totals += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            for k in range(8):
                totals[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS_OF_BYTE
    majority = np.packbits(2 * totals > count, bitorder="little")
    return int(majority.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp): fp holds the 64 bits as a signed long. A narrow pass over whole texts."""

    def rows(batches):
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width, seed) for t in batch.column(1)]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("text"))
    return map_rows(source, rows, f"doc_id {kind}, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(bits, words): bit b of fingerprint i stands at bit i % 64 of word i // 64 in plane b.

    A fingerprint is one 64-bit number, or a row of several.
    """
    n, width = len(values), 1 if values.ndim == 1 else values.shape[1]
    padded = np.zeros((-(-n // 64) * 64, width), dtype=np.uint64)
    padded[:n] = values.reshape(n, width)
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8 * width), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _within(queries: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(which queries are left, (left, words) lanes whose distance is at most radius).

    Counters are vertical: counter[k] holds bit k of every lane's distance. A query whose lanes
    all exceed the radius is abandoned and no longer added to.
    """
    depth = max(1, int(radius).bit_length())
    queries = queries.reshape(len(queries), -1)
    left = np.arange(len(queries))
    counters = [np.zeros((len(queries), planes.shape[1]), dtype=np.uint64) for _ in range(depth)]
    over = np.zeros_like(counters[0])

    def beyond() -> np.ndarray:
        """Lanes above the radius: overflowed, or the counter bits compare larger."""
        more, equal = np.zeros_like(over), np.full_like(over, _ONES)
        for k in reversed(range(depth)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                more |= equal & counters[k]
                equal &= ~counters[k]
        return over | more

    for b in range(len(planes)):
        flip = np.where((queries[left, b // 64] >> np.uint64(b % 64)) & np.uint64(1), _ONES, np.uint64(0))
        carry = planes[b][None, :] ^ flip[:, None]
        for k in range(depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7 and b < len(planes) - 1:
            alive = (beyond() != _ONES).any(axis=1)
            if not alive.all():
                left = left[alive]
                counters, over = [c[alive] for c in counters], over[alive]
                if not len(left):
                    break
    return left, ~beyond()


def near_blocks(values: np.ndarray, radius: int, block: int = 256):
    """Index pairs i < j of fingerprints within radius, through bit planes: the pairs of some queries at a time.

    The first queries come few at a time, so that whoever gathers classes has most of a crowded group in
    one class before the large blocks come.
    """
    planes = bit_planes(values)
    start, width = 0, min(8, block)
    while start < len(values):
        from_word = start // 64  # lanes before this block were compared when they were the queries
        left, lanes = _within(values[start : start + width], planes[:, from_word:], radius)
        if len(left):
            hit = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(hit)
            i, j = left[i] + start, j + from_word * 64
            keep = (i < j) & (j < len(values))
            yield i[keep], j[keep]
        start, width = start + width, min(2 * width, block)


def links_within(values: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of near_blocks at once: for few fingerprints."""
    empty = np.zeros(0, dtype=np.int64)
    made = [(empty, empty), *near_blocks(values, radius, block)]
    return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j, in place; label names each member's smallest index of its class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label[:] = above


def star(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest index of its class), without the centres."""
    members = np.flatnonzero(label != np.arange(len(label)))
    return members, label[members]


def _pairs_of_small(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    firsts, seconds = [], []
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        firsts.append((at[:, None] + i).ravel())
        seconds.append((at[:, None] + j).ravel())
    return np.concatenate(firsts), np.concatenate(seconds)


def _near(differences: np.ndarray, radius: int) -> np.ndarray:
    """Whether each XOR has at most radius bits, counted through its bit planes."""
    _, lanes = _within(np.zeros_like(differences[:1]), bit_planes(differences), radius)
    if not len(lanes):
        return np.zeros(len(differences), dtype=bool)
    return np.unpackbits(lanes[0].view(np.uint8), bitorder="little")[: len(differences)].astype(bool)


SMALL = 12


def group_links(radius: int, group_limit: int | None):
    """For sorted (key, fp) rows: rows (u, v, 0) that span each group's links, or (fp, fp, 1) of groups beyond the limit."""

    def finish(values: np.ndarray):
        label = np.arange(len(values))
        for i, j in near_blocks(values, radius):
            unite(label, i, j)
        members, centres = star(label)
        return values[members], values[centres]

    def rows(batches):
        held_key, held, spilling = None, [], False

        def out(u, v, kind):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(u).view(np.int64)), pa.array(np.asarray(v).view(np.int64)), pa.array(np.full(len(u), kind, dtype=np.int32))], ["u", "v", "kind"])

        def close():
            values = np.concatenate(held)
            if spilling or len(values) < 2:
                return None
            u, v = finish(values)
            return out(u, v, 0) if len(u) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False)])
            fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            starts = np.concatenate([[0], cuts])
            sizes = np.diff(np.concatenate([starts, [len(fps)]]))
            last = len(starts) - 1
            inner = np.ones(len(starts), dtype=bool)
            inner[[0, last]] = False  # these may go on in another batch
            small = inner & (sizes > 1) & (sizes <= SMALL)
            if small.any():
                i, j = _pairs_of_small(sizes[small], starts[small])
                hit = _near(fps[i] ^ fps[j], radius)
                if hit.any():
                    yield out(fps[i[hit]], fps[j[hit]], 0)
            for g in [0, *np.flatnonzero(inner & (sizes > SMALL)), *([last] if last else [])]:
                key = tuple(keys[:, starts[g]])
                part = fps[starts[g] : starts[g] + sizes[g]]
                if key != held_key:
                    if held and (made := close()) is not None:
                        yield made
                    held_key, held, spilling = key, [], False
                held.append(part)
                if spilling or (group_limit and sum(map(len, held)) > group_limit):
                    spilling = True
                    gone = np.concatenate(held)
                    yield out(gone, gone, 1)
                    held = [gone[:0]]
        if held and (made := close()) is not None:
            yield made

    return rows


def _keys(blocks: int, radius: int) -> list[tuple[int, int]]:
    """(number, mask) for each choice of blocks that may agree when radius bits differ."""
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(n, signed(sum(chosen))) for n, chosen in enumerate(combinations(masks, blocks - radius))]


def _sized(small: DataFrame) -> DataFrame:
    """small, broadcast where it has few rows; else Spark joins it as any table (and splits hot keys)."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _linked(distinct: DataFrame, radius: int, blocks: int, group_limit: int | None, name: str) -> DataFrame:
    """(u, v, kind) as of group_links. Groups that are counted beyond the limit are told apart before anything is dealt by key."""
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for n, mask in _keys(blocks, radius)])
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("k.n", "k.key", "fp")
    gone = None
    if group_limit:
        crowded = materialize(dealt.groupBy("n", "key").count().where(F.col("count") > group_limit).select("n", "key"), name + "-keys")
        if crowded.limit(1).count():
            crowded = _sized(crowded)
            gone = dealt.join(crowded, ["n", "key"], "left_semi").select("fp").distinct()
            dealt = dealt.join(crowded, ["n", "key"], "left_anti")
    ordered = dealt.repartition("n", "key").sortWithinPartitions("n", "key")
    found = map_rows(ordered, group_links(radius, group_limit), "u long, v long, kind int")
    if gone is not None:
        found = found.unionAll(gone.select(F.col("fp").alias("u"), F.col("fp").alias("v"), F.lit(1).alias("kind")))
    return materialize(found, name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 2, blocks: int = 4, group_limit: int = 4096) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs."""
    made = materialize(fingerprints(docs, id_col, text_col, width, seed), "simhash")
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    found = _linked(classes.select("fp"), radius, blocks, group_limit, "simhash-links")
    edges = found.where("kind = 0").select("u", "v")
    if found.where("kind = 1").limit(1).count():
        crowded = found.where("kind = 1").select(F.col("u").alias("fp")).distinct()
        edges = edges.unionAll(_linked(crowded, radius, 8, None, "simhash-crowded").select("u", "v"))
    of_class = _components_of(classes, edges)
    return made.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components_of(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id): of classes(fp, least_id), linked by edges(u, v) between fps, the least id of each component."""
    labels = connected_components(edges)
    named = classes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    least = named.where(F.col("label") != F.col("fp")).groupBy("label").agg(F.min("least_id").alias("other_id"))
    # A component's least id: over its root class and all classes that point to the root.
    roots = least.join(classes.select(F.col("fp").alias("label"), "least_id"), "label").select("label", F.least("least_id", "other_id").alias("component_id"))
    return materialize(named.join(roots, "label", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")), "simhash-named")


# Near copies: five-word shingles, similarity of 0.8 or more -------------------------------------

RADIUS = 96
GROUP_SHINGLES = 2_000_000  # of a part of a group: 8 MB
WORDS_WIDE, BANDS, BAND_ROWS = 4, 20, 4  # 256 bits; two texts of similarity 0.8 share a band but for 1 pair in 38,000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)
_PERMUTED = np.random.default_rng(17).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: bytes, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(256-bit SimHash of the distinct shingles as four numbers, a key for each MinHash band, the distinct shingles as 32-bit hashes, sorted)."""
    words = blank_words(text)
    if not words:
        return np.zeros(WORDS_WIDE, dtype=np.uint64), np.zeros(BANDS, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
    count = max(1, len(words) - width + 1)
    every = []
    for start in range(0, count, _CHUNK):
        part = words[start : min(start + _CHUNK, count) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        every.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), dtype=np.uint64)))
    distinct = np.unique(np.concatenate(every))
    totals = np.zeros((WORDS_WIDE, BITS), dtype=np.int64)
    least = np.full(BANDS * BAND_ROWS, _ONES)
    for start in range(0, len(distinct), _CHUNK):
        hashes = distinct[start : start + _CHUNK]
        for lane in range(WORDS_WIDE):
            mixed = (hashes ^ (hashes >> np.uint64(29))) * _MIX[lane]
            octets = (mixed ^ (mixed >> np.uint64(32))).view(np.uint8).reshape(-1, 8)
            if len(hashes) < 48:
                totals[lane] += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            else:
                for k in range(8):
                    totals[lane, 8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS_OF_BYTE
        for begin in range(0, len(hashes), 1024):
            least = np.minimum(least, (hashes[begin : begin + 1024, None] * _PERMUTED).min(axis=0))
    bits = np.packbits(2 * totals > len(distinct), axis=1, bitorder="little").view(np.uint64).ravel()
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = np.bitwise_xor.reduce((rows ^ (rows >> np.uint64(31))) * _MIX, axis=1)
    return bits, keys, np.unique((distinct >> np.uint64(32)).astype(np.uint32))


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """Rows (doc_id, th, fp, w0..w3, keys, shingles); fp is one number for the set of shingles, th one for the text. A narrow pass over whole texts."""

    def rows(batches):
        for batch in batches:
            made = [sketch(t.as_buffer().to_pybytes(), width) for t in batch.column(2)]
            wide = np.array([m[0] for m in made], dtype=np.uint64).reshape(-1, WORDS_WIDE).view(np.int64)
            keys = np.array([m[1] for m in made], dtype=np.uint64).reshape(-1, BANDS).view(np.int64)
            whole = np.array([xxhash.xxh64_intdigest(m[2].tobytes()) if len(m[2]) else 0 for m in made], dtype=np.uint64).view(np.int64)
            shingles = pa.array([m[2].astype("<u4").tobytes() for m in made], pa.binary())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            columns = [batch.column(0), batch.column(1), pa.array(whole), *(pa.array(wide[:, k].copy()) for k in range(WORDS_WIDE)), listed, shingles]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "fp", *_WIDE, "keys", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", _text_hash().alias("th"), utf8("text").alias("text")), rows, f"doc_id {kind}, th long, fp long, {', '.join(f'{w} long' for w in _WIDE)}, keys array<long>, shingles binary")


_WIDE = tuple(f"w{k}" for k in range(WORDS_WIDE))


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets i and j have in common, for each pair."""
    if len(i) <= 4 * len(sets):
        return np.array([len(a) + len(b) - len(np.union1d(a, b)) for a, b in ((sets[x], sets[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True))], dtype=np.int64)
    # Many pairs: the product of the 0/1 table (sets by shingles) with itself, a slice of its columns at a time.
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        at = slice(*np.searchsorted(column, [begin, begin + 1024]))
        table = np.zeros((len(sets), 1024), dtype=np.float32)
        table[owner[at], column[at] - begin] = 1
        total += table @ table.T
    return total[i, j].astype(np.int64)


def _similar(sets: list[np.ndarray], size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets i and j have at least this Jaccard similarity, for each pair."""
    hit = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
    i, j = i[hit], j[hit]
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    shared = shared_counts([sets[k] for k in used.tolist()], place[: len(i)], place[len(i) :])
    hit[hit] = shared >= similarity * (size[i] + size[j] - shared)
    return hit


def verified_links(similarity: float, radius: int):
    """For (mark, cell, side, fp, w0..w3, shingles) rows sorted by mark and cell: (u, v) that span the links of each cell.

    Pairs within the radius come from the bit planes, some queries at a time. Those whose texts are in one class
    already need no look at their shingles; the others are compared, and joined if similar enough. No pair outlives
    its block. A cell of two sides compares only pairs across them.
    """

    def links(side, wide, sets):
        label, size = np.arange(len(sets)), np.array([len(x) for x in sets])
        across = (side != side[0]).any()
        for i, j in near_blocks(wide, radius, 128):
            keep = label[i] != label[j]
            if across:
                keep &= side[i] != side[j]
            i, j = i[keep], j[keep]
            if len(i):
                hit = _similar(sets, size, i, j, similarity)
                unite(label, i[hit], j[hit])
        return star(label)

    def rows(batches):
        held_key, held = None, []

        def close():
            side, fps, wide = (np.concatenate([h[k] for h in held]) for k in range(3))
            if len(fps) < 2:
                return None
            members, centres = links(side, wide, [x for h in held for x in h[3]])
            return (fps[members], fps[centres]) if len(members) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            mark, cell, side, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            wide = np.stack([batch.column(4 + k).to_numpy(zero_copy_only=False) for k in range(WORDS_WIDE)], axis=1).view(np.uint64)
            sets = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in batch.column(4 + WORDS_WIDE)]
            starts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(fps)]
            done = []
            for begin, end in zip(starts, starts[1:], strict=False):
                key = (mark[begin], cell[begin])
                if key != held_key:
                    if held and (made := close()) is not None:
                        done.append(made)
                    held_key, held = key, []
                held.append((side[begin:end], fps[begin:end], wide[begin:end], sets[begin:end]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], ["u", "v"])
        if held and (made := close()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["u", "v"])

    return rows


def _beside(similarity: float):
    """Of rows (mark, fp, pivot, two sets of shingles): mark, fp and pivot where the sets are similar enough."""

    def rows(batches):
        for batch in batches:
            hit = []
            for a, b in zip(batch.column(3), batch.column(4), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype="<u4") for x in (a, b))
                near = min(len(a), len(b)) >= similarity * max(len(a), len(b))
                if near:
                    shared = int(np.isin(a, b, assume_unique=True).sum())
                    near = shared >= similarity * (len(a) + len(b) - shared)
                hit.append(near)
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["mark", "fp", "pivot"]).filter(pa.array(hit, pa.bool_()))

    return rows


def _crowded_cells(crowded: DataFrame, sets: DataFrame, similarity: float, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """Of groups (mark, members, total, fp) too large for one task: (u, v) edges, and (mark, cell, side, fp) cells for the pairs still open.

    Every text is compared with one text of its group, the pivot. Those that link to it are one class and need no look
    at each other. What remains is cut into parts, each of which meets each part of the whole group in a cell:
    the work is the product of the rest and the group, not the group's square.
    """
    pivots = materialize(crowded.groupBy("mark").agg(F.min("fp").alias("pivot")), "near-pivots")
    beside = crowded.select("mark", "fp").join(_sized(pivots), "mark").where("fp <> pivot")
    both = beside.join(sets.select("fp", "shingles"), "fp").join(sets.select(F.col("fp").alias("pivot"), F.col("shingles").alias("others")), "pivot")
    linked = materialize(map_rows(both.select("mark", "fp", "pivot", "shingles", "others"), _beside(similarity), "mark long, fp long, pivot long"), "near-linked")
    rest = beside.select("mark", "fp").join(linked.select("mark", "fp"), ["mark", "fp"], "left_anti").join(sets.select("fp", (F.length("shingles") / 4).alias("size")), "fp")
    rest = materialize(rest, "near-rest")
    parts = lambda n, total: F.greatest(F.ceil(F.col(n) / group_limit), F.ceil(F.col(total) / GROUP_SHINGLES))
    counts = rest.groupBy("mark").agg(F.count("*").alias("left"), F.sum("size").alias("left_total"))
    sizes = crowded.groupBy("mark").agg(F.first("members").alias("members"), F.first("total").alias("total"))
    dims = materialize(counts.join(sizes, "mark").select("mark", parts("left", "left_total").alias("rows"), parts("members", "total").alias("columns")), "near-parts")
    dims = _sized(dims)
    cell = F.col("row") * F.lit(1 << 31) + F.col("column")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("fp", "mark"), n)
    asking = rest.select("mark", "fp").join(dims, "mark").select("mark", part("rows").alias("row"), every("columns").alias("column"), F.lit(1).alias("side"), "fp")
    asked = crowded.select("mark", "fp").join(dims, "mark").select("mark", every("rows").alias("row"), part("columns").alias("column"), F.lit(0).alias("side"), "fp")
    cells = asking.unionByName(asked).select("mark", cell.alias("cell"), "side", "fp")
    return linked.select(F.col("fp").alias("u"), F.col("pivot").alias("v")), cells


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = RADIUS, group_limit: int = 2048) -> DataFrame:
    """Rows (doc_id, th, fingerprint, component_id, first): texts whose sets of shingles have at least this Jaccard similarity are linked.

    th is the XXH64 of the text; component_id is the smallest doc_id of the component; first is the (nameless, doc_id, th) of the row that stands for the component: the one
    of the smallest doc_id, of the smallest th among rows of one id, and one without an id only where none has one.

    Equal sets form a class. Classes meet where a MinHash band agrees; groups of the same members
    are one group. The shingles go along to each group, where pairs whose 256-bit SimHashes lie
    within the radius are verified on them, unless their texts are in one class by then. A similarity of
    0.8 lies at 39 of 256 bits, give or take 6; where texts have few shingles at 48 at most (four against five),
    give or take 6.2. The radius lies more than seven such deviations beyond either.
    Groups beyond the limit (of texts, or of shingles) are counted first and never meet in one task, see _crowded_cells.
    Blank texts are copies of each other. Repeated rows keep their rows. An empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    made = materialize(sketches(docs, width).drop(*_WIDE).withColumn("size", (F.length("shingles") / 4).cast("long")).drop("shingles"), "sketches")
    of_row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")
    classes = materialize(made.groupBy("fp").agg(F.min(of_row).alias("least_id"), F.first("keys").alias("keys"), F.first("size").alias("size")), "sketch-classes")
    dealt = classes.where("fp <> 0").select(F.posexplode("keys").alias("n", "key"), "fp", "size")
    met = dealt.groupBy("n", "key").agg(F.count("*").alias("members"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("fp")).alias("mark")).where("members > 1")
    named = met.select("n", "key", F.xxhash64("mark", "members", "total").alias("mark"), "members", "total")
    groups = materialize(dealt.select("n", "key", "fp").join(named, ["n", "key"]).select("mark", "members", "total", "fp").distinct(), "near-groups")
    asked = materialize(groups.select("fp").distinct(), "near-asked")
    # Only texts that share a band are cut into shingles again: one row for each class.
    mine = classes.join(asked, "fp", "left_semi").select(F.col("least_id.doc_id").alias("__id"), F.col("least_id.th").alias("__th"))
    again = docs.join(_sized(mine), F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_hash() == F.col("__th")), "left_semi")
    sets = materialize(sketches(again, width).select("fp", *_WIDE, "shingles").dropDuplicates(["fp"]), "near-sets")
    large = (F.col("members") > group_limit) | (F.col("total") > GROUP_SHINGLES)
    cells = groups.where(~large).select("mark", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side"), "fp")
    edges = None
    if groups.where(large).limit(1).count():
        edges, more = _crowded_cells(groups.where(large), sets, similarity, group_limit)
        cells = cells.unionAll(more)
    sorted_cells = cells.join(sets, "fp").select("mark", "cell", "side", "fp", *_WIDE, "shingles").repartition("mark", "cell").sortWithinPartitions("mark", "cell")
    verified = materialize(map_rows(sorted_cells, verified_links(similarity, radius), "u long, v long"), "near-links")
    found = _components_of(classes.select("fp", "least_id"), verified if edges is None else verified.unionAll(edges))
    return made.select("doc_id", "th", "fp").join(found, "fp").select("doc_id", "th", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id.doc_id").alias("component_id"), F.col("component_id").alias("first"))


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each component of near_copies, the one that `first` names; of wholly repeated (doc_id, text) rows one.

    Only what goes is looked up: as a table that is broadcast behind a check of its size.
    """
    found = materialize(found.select("doc_id", "th", "first"), "near-found")
    goes = found.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    goes = materialize(goes, "near-goes")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_hash() == F.col("__th"))
    kept = docs.join(_sized(goes), same, "left_anti")
    repeated = materialize(found.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), "near-repeated")
    if not repeated.limit(1).count():
        return kept
    repeated = _sized(repeated)
    once = kept.join(repeated, same, "left_semi").withColumn("__th", _text_hash()).dropDuplicates(["doc_id", "__th"]).drop("__th")
    return kept.join(repeated, same, "left_anti").unionByName(once)

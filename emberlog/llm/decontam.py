"""Benchmark decontamination by a generalised suffix automaton over word tokens.

The normalised test items go into one automaton; a training text's words stream through it and
the longest match ending at every word is tracked. Where the match is long enough, the words of
the window are hit, and the items that own the window are known from the state. A filter on
word pairs in numpy skips stretches that cannot hold a window; all that could is streamed.

An automaton holds at most `words_per_automaton` words (about 100 MB at the default); beyond it the
items are cut into shards, and an item that is longer by itself into parts that share a window less
one word, which loses no window. Shards are built, shipped and used one after another, and what the
documents have gathered is written in between, so neither driver nor workers hold two at a time.

Edge cases: null texts have no words and no hits; an empty benchmark hits nothing; items without
words are ignored; items shorter than the window count as one window; repeated items all count;
null item_ids are named by the empty string. Extra columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import alnum_words, map_rows, utf8
from emberlog.runtime import materialize

WINDOW = 10
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Substrings of all items as states; `windows[state]` and `shorts[state]` name items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        tokens = []
        for name, words in items:
            if words:
                tokens.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        for _, ids in tokens:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.least = min([window, *(len(ids) for _, ids in tokens)])
        self._name(tokens)
        self._pair_filter(tokens)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        made = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = made
            p = link[p]
        link[q] = made
        return made

    def _name(self, tokens: list[tuple[str, list[int]]]) -> None:
        self.names = [name for name, _ in tokens]
        windows: dict[int, set[int]] = {}
        shorts: dict[int, list[tuple[int, int]]] = {}
        for k, (_, ids) in enumerate(tokens):
            state = matched = 0
            for c in ids:
                state, matched = self.next[state][c], matched + 1
                while self.length[self.link[state]] >= self.window:
                    state = self.link[state]
                    matched = self.length[state]
                if len(ids) >= self.window and matched >= self.window:
                    windows.setdefault(state, set()).add(k)
            if len(ids) < self.window:
                shorts.setdefault(state, []).append((len(ids), k))
        self.windows = {s: frozenset(ks) for s, ks in windows.items()}
        #: For each state the short items that end there, at it or at what its suffix links reach.
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        if shorts:
            for s in order:
                above = self.shorts[self.link[s]] if s else ()
                self.shorts[s] = tuple(shorts.get(s, ())) + above
        self.any_short = bool(shorts)

    def _pair_filter(self, tokens: list[tuple[str, list[int]]]) -> None:
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        for _, ids in tokens:
            a = np.array(ids, dtype=np.int64)
            self.bitmap[self._slot(a[:-1], a[1:])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 40_503 + b * 2_654_435) & ((1 << 20) - 1)

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges, a window long at least, in which each word, and each pair, is an item's."""
        if len(ids) < self.least:
            return []
        if self.least == 1:
            good = np.concatenate([[False], ids > 0, [False]])
            edges = np.flatnonzero(good[1:] != good[:-1])
            return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        pair = (ids[:-1] > 0) & (ids[1:] > 0)
        at = np.flatnonzero(pair)
        pair[at] = self.bitmap[self._slot(ids[at], ids[at + 1])]
        good = np.concatenate([[False], pair, [False]])
        edges = np.flatnonzero(good[1:] != good[:-1])
        begin, end = edges[::2], edges[1::2] + 1
        long = end - begin >= self.least
        return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit word ranges, merged and in order, names of the items with a window there)."""
        if not self.vocabulary or len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))
        hits: list[list[int]] = []
        found: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for begin, end in self._stretches(ids):
            state = matched = 0
            for i, c in enumerate(ids[begin:end].tolist(), begin + 1):
                while state and c not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if c in nxt[state]:
                    state, matched = nxt[state][c], matched + 1
                if matched >= window:
                    while length[link[state]] >= window:
                        state = link[state]
                        matched = length[state]
                    if owners := self.windows.get(state):
                        found |= owners
                        self._mark(hits, i - window, i)
                if self.any_short:
                    for size, k in self.shorts[state]:
                        if size <= matched:
                            found.add(k)
                            self._mark(hits, i - size, i)
        return [(a, b) for a, b in hits], {self.names[k] for k in found}

    @staticmethod
    def _mark(hits: list[list[int]], begin: int, end: int) -> None:
        while hits and hits[-1][1] >= begin:
            begin = min(begin, hits.pop()[0])
        hits.append([begin, end])


WORDS_PER_AUTOMATON = 200_000


def automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, words_per_automaton: int = WORDS_PER_AUTOMATON) -> Iterator[SuffixAutomaton]:
    """One automaton after another, at least one; each holds at most words_per_automaton words (or two windows)."""
    shard, size, limit = [], 0, max(words_per_automaton, 2 * window)
    source = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), utf8(F.col(f"`{text_col}`")))
    made = 0
    for name, text in source.toLocalIterator():
        words = alnum_words(bytes(text))
        for begin in range(0, max(1, len(words) - window + 1), limit - window + 1):
            part = words[begin : begin + limit]
            if shard and size + len(part) > limit:
                yield SuffixAutomaton(shard, window)
                shard, size, made = [], 0, made + 1
            shard.append((name, part))
            size += len(part)
    if shard or not made:
        yield SuffixAutomaton(shard, window)


def _gathered(docs: DataFrame, shards: Iterator[SuffixAutomaton], first: SuffixAutomaton, text_col: str) -> DataFrame:
    """docs with __words, __spans and __items over the first automaton and all that follow."""
    sc = docs.sparkSession.sparkContext
    out = docs.withColumn("__utf8", utf8(F.col(f"`{text_col}`"))).withColumn("__spans", F.array().cast("array<struct<begin:int,end:int>>")).withColumn("__items", F.array().cast("array<string>"))
    schema, shard = _with_count(out.schema), first
    while shard is not None:
        shipped = sc.broadcast(shard)
        shard = next(shards, None)

        def rows(batches, shipped=shipped):
            automaton = shipped.value
            for batch in batches:
                columns = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
                spans, items, counts = [], [], []
                for text, old_spans, old_items in zip(columns["__utf8"], columns["__spans"].to_pylist(), columns["__items"].to_pylist(), strict=True):
                    words = alnum_words(text.as_py())
                    hits, names = automaton.scan(words)
                    if old_spans:
                        hits = merged([*((s["begin"], s["end"]) for s in old_spans), *hits])
                    spans.append([{"begin": a, "end": b} for a, b in hits])
                    items.append(sorted({*old_items, *names}))
                    counts.append(len(words))
                columns["__spans"] = pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
                columns["__items"] = pa.array(items, pa.list_(pa.string()))
                columns["__words"] = pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        out = map_rows(out, rows, schema)
        if shard is not None:
            out = materialize(out, "benchmark-shard")
            shipped.destroy()
    return out.drop("__utf8")


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with n_words, spans (array of word ranges, merged) and items (array of ids) set; other columns pass."""
    shards = automata(benchmark, **options)
    names = {"n_words": "__words", "spans": "__spans", "items": "__items"}
    return _gathered(docs.drop(*names), shards, next(shards), text_col).withColumnsRenamed({v: k for k, v in names.items()})


def _with_count(schema):
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField("__words", T.LongType())])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = matches(docs.select("doc_id", "text").withColumn("__text", F.col("text")).drop("text"), benchmark, "__text", **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, done = [], 0
    for begin, end in spans:
        out.append(text[done : at[begin][0]])
        done = at[end - 1][1]
    return b"".join([*out, text[done:]])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, text_col: str = "text", words_per_automaton: int = WORDS_PER_AUTOMATON) -> DataFrame:
    """docs with every hit span cut out of the text; documents hit beyond max_coverage go.

    What closes up after a cut is scanned again until nothing is hit, so no window is left. Clean texts stay byte for
    byte, null ones null. With one automaton that is a narrow pass; with more, each round works on what the last one cut.
    """
    options = {"window": window, "words_per_automaton": words_per_automaton}
    shards = automata(benchmark, **options)
    first = next(shards)
    if (second := next(shards, None)) is None:
        return _cut_by_one(docs, first, max_coverage, text_col)
    done, pending = [], docs.withColumn("__gone", F.lit(0).cast("long")).withColumn("__total", F.lit(None).cast("long"))
    rest: Iterator[SuffixAutomaton] = chain([second], shards)
    while True:
        made = materialize(_cut_found(_gathered(pending, rest, first, text_col), max_coverage, text_col), "benchmark-cut")
        done.append(made.where("not __again").select(*docs.columns))
        pending = made.where("__again").drop("__again")
        if not pending.limit(1).count():
            return reduce(DataFrame.unionAll, done)
        shards = automata(benchmark, **options)
        first, rest = next(shards), shards


def _cut_found(found: DataFrame, max_coverage: float, text_col: str) -> DataFrame:
    """Rows of _gathered with their spans cut out, __gone and __total carried on, and __again where something was cut."""
    from pyspark.sql import types as T

    kept = found.drop("__spans", "__items", "__words")
    schema = T.StructType([*kept.schema.fields, T.StructField("__again", T.BooleanType())])
    names = [*kept.columns, "__again"]
    at, gone_at, total_at = (names.index(c) for c in (text_col, "__gone", "__total"))
    n = len(names) - 1

    def rows(batches):
        for batch in batches:
            texts, gone, total, again = batch.column(at).to_pylist(), batch.column(gone_at).to_pylist(), batch.column(total_at).to_pylist(), []
            for i, (spans, words) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)):
                ranges = [(s["begin"], s["end"]) for s in spans]
                again.append(bool(ranges))
                total[i] = words if total[i] is None else total[i]
                gone[i] += sum(b - a for a, b in ranges)
                if ranges:
                    texts[i] = cut_spans(texts[i].encode(), ranges).decode()
            columns = batch.columns[:n]
            columns[at], columns[gone_at], columns[total_at] = pa.array(texts, batch.schema.field(at).type), pa.array(gone, pa.int64()), pa.array(total, pa.int64())
            keep = [g <= max_coverage * t for g, t in zip(gone, total, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(again, pa.bool_())], names).filter(pa.array(keep, pa.bool_()))

    return map_rows(found.select(*kept.columns, "__spans", "__words"), rows, schema)


def _cut_by_one(docs: DataFrame, automaton: SuffixAutomaton, max_coverage: float, text_col: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(automaton)
    fields = docs.schema
    at = fields.names.index(text_col)

    def rows(batches):
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            changed = False
            for i, text in enumerate(texts):
                keep.append(True)
                if text is None:
                    continue
                raw = text.encode()
                total = len(words := alnum_words(raw))
                gone = 0
                while spans := shipped.value.scan(words)[0]:
                    gone += sum(b - a for a, b in spans)
                    raw = cut_spans(raw, spans)
                    words = alnum_words(raw)
                    if gone > max_coverage * total:
                        keep[-1] = False
                        break
                if gone:
                    texts[i], changed = raw.decode(), True
            if changed:
                batch = batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, rows, fields)


def item_digest(names: set[str]) -> str:
    return sha256(",".join(sorted(names)).encode()).hexdigest()

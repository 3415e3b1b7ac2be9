"""License scans: templates with markup, compiled into token automata.

Template markup: plain words are mandatory; `[[ ... ]]` is optional; `{{a-b}}` is replaceable, any
a to b words. A template becomes an automaton over words (a state set with free moves); it accepts
where all mandatory wording stands in order, word for word. Automata are started only at words
that can begin a match, and only in texts that hold every template's rarest mandatory word, so a
text without license words costs one set test.

Base phrases are templates as well; their places are counted one by one. The longer templates add
labels of their own. The score rises with the mandatory words of the longest match: m / (m + 4).

Edge cases: null texts count as empty and have no words; a text of one unbroken word is one word;
repeated rows stay; extra columns are ignored; labels are distinct and sorted.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import alnum_words, map_rows, utf8

BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[ the software ]] to deal in the software without restriction {{0-60}} subject to the following conditions the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software"),
    ("mit", "[[ released ]] [[ licensed ]] under the [[ terms of the ]] mit license"),
    ("apache-2", "licensed under the apache license version 2 0 [[ the license ]] you may not use this file except in compliance with the license"),
    ("apache-2", "[[ licensed ]] under the apache license version 2"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {{0-80}} neither the name of {{1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {{0-1}} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {{0-1}} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by"),
    ("gpl-3", "[[ licensed under ]] the gnu general public license [[ as published by the free software foundation either ]] version 3"),
    ("gpl-2", "[[ licensed under ]] the gnu general public license [[ as published by the free software foundation either ]] version 2"),
    ("lgpl", "the gnu lesser general public license [[ as published by the free software foundation either ]] version {{1-1}}"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under [[ a ]] [[ the ]] creative commons attribution noncommercial [[ {{1-1}} 0 international ]] license"),
    ("cc-by", "licensed under [[ a ]] [[ the ]] creative commons attribution {{1-1}} 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
)
_PART = re.compile(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+")


class Template:
    """An automaton: `words[state]` moves on a word, `free[state]` without one, `any_word[state]` on every word."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.words: list[dict[bytes, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.any_word: list[int] = [-1]
        parts = _PART.findall(markup)
        end, at = self._sequence(0, parts, 0)
        if at != len(parts):
            raise ValueError(f"unbalanced markup: {markup}")
        self.last = end
        depth, self.mandatory = 0, []
        for p in parts:
            depth += (p == "[[") - (p == "]]")
            if not depth and p not in ("[[", "]]") and not p.startswith("{{"):
                self.mandatory.append(p.encode())
        if not self.mandatory:
            raise ValueError(f"no mandatory word: {markup}")
        self.closed = [self._closure({s}) for s in range(len(self.words))]
        self.firsts = frozenset(w for s in self.closed[0] for w in self.words[s])
        if any(self.any_word[s] >= 0 for s in self.closed[0]):
            raise ValueError(f"begins with a replaceable part: {markup}")

    def _state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.any_word.append(-1)
        return len(self.words) - 1

    def _sequence(self, state: int, parts: list[str], at: int) -> tuple[int, int]:
        while at < len(parts) and parts[at] != "]]":
            p = parts[at]
            if p == "[[":
                inner = self._state()
                self.free[state].append(inner)
                end, at = self._sequence(inner, parts, at + 1)
                after = self._state()
                self.free[end].append(after)
                self.free[state].append(after)
                state = after
            elif p.startswith("{{"):
                least, most = map(int, p[2:-2].split("-"))
                after = self._state()
                for k in range(most):
                    if k >= least:
                        self.free[state].append(after)
                    step = self._state()
                    self.any_word[state] = step
                    state = step
                self.free[state].append(after)
                state = after
            else:
                step = self._state()
                # A state of its own for each word: no two moves share one.
                self.words[state][p.encode()] = step
                state = step
            at += 1
        return state, at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def match(self, words: list[bytes], begin: int) -> int:
        """The end of the shortest match from begin, or -1."""
        states = self.closed[0]
        for i in range(begin, len(words)):
            w = words[i]
            moved: set[int] = set()
            for s in states:
                if (t := self.words[s].get(w)) is not None:
                    moved |= self.closed[t]
                if (t := self.any_word[s]) >= 0:
                    moved |= self.closed[t]
            if self.last in moved:
                return i + 1
            if not moved:
                return -1
            states = moved
        return -1


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES):
        self.base = [Template(label, text) for label, text in base]
        self.more = [Template(label, text) for label, text in templates]
        both = self.base + self.more
        uses: dict[bytes, int] = {}
        for t in both:
            for w in set(t.mandatory):
                uses[w] = uses.get(w, 0) + 1
        # Long words are rare in prose; among equals the one that fewest templates share.
        self.anchor = {id(t): min(t.mandatory, key=lambda w: (-min(len(w), 7), uses[w], w)) for t in both}
        self.anchors = frozenset(self.anchor.values())

    def __getstate__(self):
        return {"base": [(t.label, t) for t in self.base], "more": [(t.label, t) for t in self.more], "anchor": [self.anchor[id(t)] for t in self.base + self.more], "anchors": self.anchors}

    def __setstate__(self, state):
        self.base, self.more = [t for _, t in state["base"]], [t for _, t in state["more"]]
        self.anchor = {id(t): a for t, a in zip(self.base + self.more, state["anchor"], strict=True)}
        self.anchors = state["anchors"]

    def scan(self, words: list[bytes]) -> dict:
        out = {"n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0}
        if self.anchors.isdisjoint(words):
            return out
        there = set(words)
        for templates, is_base in ((self.base, True), (self.more, False)):
            for t in templates:
                if self.anchor[id(t)] not in there:
                    continue
                for first in t.firsts & there:
                    at = -1
                    for _ in range(words.count(first)):
                        at = words.index(first, at + 1)
                        if t.match(words, at) < 0:
                            continue
                        out["labels"].add(t.label)
                        out["score"] = max(out["score"], len(t.mandatory) / (len(t.mandatory) + 4))
                        if not is_base:
                            break
                        out["base"].add(t.label)
                        out["n_base"] += 1
                        out["first_word"] = at if out["first_word"] is None else min(at, out["first_word"])
                        out["last_word"] = at if out["last_word"] is None else max(at, out["last_word"])
        return out


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())

    def rows(batches):
        scan = shipped.value.scan
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                words = alnum_words(text.as_py())
                counts.append(len(words))
                found.append(scan(words))
            join = lambda key: pa.array([",".join(sorted(f[key])) for f in found], pa.string())
            number = lambda key: pa.array([f[key] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), number("n_base"), number("first_word"), number("last_word"), join("base"), join("labels"), pa.array([f["score"] for f in found], pa.float64())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("text"))
    return map_rows(source, rows, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

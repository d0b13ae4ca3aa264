"""License scan: templates with optional and replaceable regions, compiled to automata over words.

A template is plain wording with two kinds of markup: `<<beginOptional>> ... <<endOptional>>` may be missing, `<<var;max=N>>`
stands for up to N arbitrary words. Everything else is mandatory and must match word for word; letters A-Z are lower-cased and
punctuation is no word. A text is accepted wherever some stretch of its words runs an automaton from start to an end state.

The scan is row-local: words are hashed in NumPy, only places where a template's first two words can stand start an automaton, and
each run is at most as long as its template. Whole texts are scanned.

Defined results: null and empty texts have no words and no match; repeated rows are judged row by row; only the id column is
carried along, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codegauge.llm.words import NON_WORD, slices, word_hashes, words

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Wording of public license notices, with markup.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License <<beginOptional>> Version <<endOptional>> 2.0"
                   " <<beginOptional>> (the \"License\"); you may not use this file except in compliance with the License <<endOptional>>"),
    ("MIT", "Released under the <<var;max=3>> MIT License"),
    ("MIT", "Licensed under the <<beginOptional>> terms of the <<endOptional>> MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files (the \"<<var;max=3>>\"), to deal in the <<var;max=3>> without restriction"),
    ("GPL-3.0", "Licensed under the GNU General Public License <<beginOptional>> as published by the Free Software Foundation"
                " <<endOptional>> <<beginOptional>> version <<endOptional>> 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
            " <<beginOptional>> Lesser <<endOptional>> <<beginOptional>> Affero <<endOptional>> General Public License as published"
            " by the Free Software Foundation, either version <<var;max=2>> of the License"
            " <<beginOptional>> , or (at your option) any later version <<endOptional>>"),
    ("CC-BY-4.0", "Licensed under <<beginOptional>> a <<endOptional>> CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under <<beginOptional>> a <<endOptional>> CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under <<beginOptional>> a <<endOptional>> CC BY-NC 4.0"),
    ("CC-BY", "Licensed under a Creative Commons Attribution <<var;max=3>> License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
            " following conditions are met"),
    ("all-rights-reserved", "Copyright <<var;max=8>> All rights reserved"),
]

ANY = -1


def parts(template: str) -> list[str | int]:
    """Words, '(' and ')' around optional regions, and the most words of a replaceable region."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), template.replace("<<beginOptional>>", " \x01 ").replace("<<endOptional>>", " \x02 "))
    out: list[str | int] = []
    for token in re.findall(r"\x01|\x02|<<var;max=\d+>>|[0-9a-z\u0080-\U0010ffff]+", lowered):
        out.append({"\x01": "(", "\x02": ")"}.get(token) or (int(token[10:-2]) if token.startswith("<<") else token))
    return out


@dataclass
class Automaton:
    """States of all templates. `moves[state]` lists (word id or ANY, next state); `ends[state]` the labels accepted there."""

    vocabulary: np.ndarray
    moves: list[list[tuple[int, int]]] = field(default_factory=list)
    ends: list[set[str]] = field(default_factory=list)
    starts: frozenset[int] = frozenset()
    known: dict[tuple[frozenset[int], int], frozenset[int]] = field(default_factory=dict)

    def step(self, states: frozenset[int], word: int) -> frozenset[int]:
        key = (states, word)
        if key not in self.known:
            self.known[key] = frozenset(to for s in states for want, to in self.moves[s] if want in (word, ANY))
        return self.known[key]


def compile_templates(templates: list[tuple[str, str]]) -> Automaton:
    """One automaton for all templates; skips are resolved here, so a step is a plain look-up."""
    all_words = sorted({w for _, t in templates for w in parts(t) if isinstance(w, str) and w not in "()"})
    hashes = [h[0] for h in word_hashes(all_words, NON_WORD)]
    vocabulary = np.sort(np.array(hashes, np.uint64))
    number = {w: int(np.searchsorted(vocabulary, h)) + 1 for w, h in zip(all_words, hashes)}
    auto, skips, starts = Automaton(vocabulary), [], []

    def state() -> int:
        auto.moves.append([])
        auto.ends.append(set())
        skips.append([])
        return len(skips) - 1

    for label, template in templates:
        items = parts(template)
        if not items or not isinstance(items[0], str) or items[0] == "(":
            raise ValueError(f"a template begins with a mandatory word: {template!r}")
        at, opened = state(), []
        starts.append(at)
        for item in items:
            if item == "(":
                opened.append(at)
                inner = state()
                skips[at].append(inner)
                at = inner
            elif item == ")":
                after = state()
                skips[at].append(after)
                skips[opened.pop()].append(after)
                at = after
            elif isinstance(item, int):
                after = state()
                for _ in range(item):
                    skips[at].append(after)
                    another = state()
                    auto.moves[at].append((ANY, another))
                    at = another
                skips[at].append(after)
                at = after
            else:
                another = state()
                auto.moves[at].append((number[item], another))
                at = another
        auto.ends[at].add(label)

    def reach(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    closed = [reach(s) for s in range(len(skips))]
    auto.ends = [set().union(*(auto.ends[t] for t in c)) for c in closed]
    auto.moves = [[m for t in c for m in auto.moves[t]] for c in closed]
    auto.starts = frozenset(starts)
    return auto


def _candidates(ids: np.ndarray, auto: Automaton) -> np.ndarray:
    """Places whose first two words some template can begin with."""
    size = len(auto.vocabulary) + 1
    first, pair = np.zeros(size, bool), np.zeros((size, size), bool)
    for s in auto.starts:
        for word, to in auto.moves[s]:
            first[word] = True
            if auto.ends[to]:
                pair[word] = True
            for then, _ in auto.moves[to]:
                pair[word, slice(None) if then == ANY else then] = True
    following = np.append(ids[1:], 0)
    return np.flatnonzero(first[ids] & pair[ids, following]) if len(ids) else np.zeros(0, np.int64)


def template_matches(number: np.ndarray, ids: np.ndarray, auto: Automaton) -> list[tuple[int, int, str, int]]:
    """(text, first word in the slice, label, words): from every place the longest stretch that each label accepts."""
    out, stop = [], np.searchsorted(number, number, "right") if len(number) else number
    for start in _candidates(ids, auto).tolist():
        states, at, end, longest = auto.starts, start, int(stop[start]), {}
        while at < end and states:
            states = auto.step(states, int(ids[at]))
            at += 1
            for s in states:
                for label in auto.ends[s]:
                    longest[label] = at - start
        out += [(int(number[start]), start, label, n) for label, n in longest.items()]
    return out


def phrase_places(number: np.ndarray, hashes: np.ndarray, phrases: list[tuple[str, str]]) -> list[tuple[int, int, str, int]]:
    """(text, first word in the slice, label, words) of every place where the words of a phrase stand consecutively."""
    out = []
    for (phrase, label), wanted in zip(phrases, word_hashes([p for p, _ in phrases], NON_WORD)):
        n = len(wanted)
        if len(hashes) < n:
            continue
        last = len(hashes) - n + 1
        ok = number[:last] == number[n - 1:]
        for k in range(n):
            ok &= hashes[k:k + last] == wanted[k]
        out += [(int(number[p]), int(p), label, n) for p in np.flatnonzero(ok)]
    return out


SPANS = "array<struct<start:long,n_words:long,label:string>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("label", pa.string())]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, `n_words`, `phrases` and `templates`, both lists of (first word, words, label)."""
    phrases = PHRASES if phrases is None else phrases
    auto = compile_templates(TEMPLATES if templates is None else templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                number, hashes = words(part.column("text"), NON_WORD)
                n_words = np.bincount(number, minlength=part.num_rows)
                first = np.cumsum(n_words) - n_words
                ids = np.zeros(len(hashes), np.int64)
                if len(auto.vocabulary):
                    at = np.minimum(np.searchsorted(auto.vocabulary, hashes), len(auto.vocabulary) - 1)
                    ids = np.where(auto.vocabulary[at] == hashes, at + 1, 0)
                columns = []
                for found in (phrase_places(number, hashes, phrases), template_matches(number, ids, auto)):
                    rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
                    for text, start, label, n in sorted(found):
                        rows[text].append({"start": start - int(first[text]), "n_words": n, "label": label})
                    columns.append(pa.array(rows, _SPANS_ARROW))
                yield pa.record_batch([part.column("id"), pa.array(n_words, pa.int64()), *columns],
                                      names=["id", "n_words", "phrases", "templates"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {kind}, n_words long, phrases {SPANS}, templates {SPANS}") \
        .withColumnRenamed("id", id_col)

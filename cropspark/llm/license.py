"""License statements by template markup: optional and replaceable regions compiled into token automata.

A template is plain wording with three kinds of markup: ``<<optional>> ... <</optional>>`` may be absent (and nest), ``<<any:n>>`` stands for
up to n words, ``<<of:a|b>>`` for one of the listed words. Everything else is mandatory: a text is accepted where it has just these
words, whatever the case, punctuation and line breaks. Words are runs of letters and digits (``folded``).

An automaton begins only at its first words, so documents without one of those are never walked. A missing or empty text has no words,
no label and score 0. Every row is judged by itself; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import steps, tidy
from cropspark.llm.folded import LOWER, raw, word_counts, words

#: Phrases that count at every place where their words stand one after the other.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The verb of a notice and what may stand before the license's name.
_UNDER = "<<of:licensed|licenced|released|distributed|available|published|provided|offered>> under <<optional>>the terms of<</optional>>"

#: The mandatory wording of public license notices.
TEMPLATES = {
    "cc-by": f"<<optional>>this work is<</optional>> {_UNDER} <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons attribution <<optional>>license<</optional>> <<any:4>> license",
    "cc-by-4.0": f"{_UNDER} <<optional>>a<</optional>> <<optional>>the<</optional>> cc by <<optional>>license<</optional>> <<optional>>version<</optional>> 4 0",
    "cc-by-sa-4.0": f"{_UNDER} <<optional>>a<</optional>> <<optional>>the<</optional>> cc by sa <<optional>>license<</optional>> <<optional>>version<</optional>> 4 0",
    "cc-by-nc-4.0": f"{_UNDER} <<optional>>a<</optional>> <<optional>>the<</optional>> cc by nc <<optional>>license<</optional>> <<optional>>version<</optional>> 4 0",
    "cc-by-nd-4.0": f"{_UNDER} <<optional>>a<</optional>> <<optional>>the<</optional>> cc by nd <<optional>>license<</optional>> <<optional>>version<</optional>> 4 0",
    "cc0-1.0": "<<optional>>dedicated to the public domain<</optional>> under <<optional>>the<</optional>> <<optional>>creative commons<</optional>> cc0 <<optional>>license<</optional>> 1 0",
    "apache-2.0": f"{_UNDER} <<optional>>the<</optional>> apache license <<optional>>version<</optional>> 2 0",
    "gpl-2.0": f"<<optional>>this <<any:4>> is<</optional>> {_UNDER} <<optional>>the<</optional>> <<optional>>gnu<</optional>> general public license <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version 2",
    "gpl-3.0": f"<<optional>>this <<any:4>> is<</optional>> {_UNDER} <<optional>>the<</optional>> <<optional>>gnu<</optional>> general public license <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version 3",
    "lgpl": f"{_UNDER} <<optional>>the<</optional>> <<optional>>gnu<</optional>> lesser general public license <<optional>>version <<any:2>><</optional>>",
    "agpl": f"{_UNDER} <<optional>>the<</optional>> <<optional>>gnu<</optional>> affero general public license <<optional>>version <<any:2>><</optional>>",
    "mpl-2.0": "subject to the terms of the mozilla public license <<optional>>v<</optional>> <<optional>>version<</optional>> 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software",
    "mit-notice": f"{_UNDER} <<optional>>an<</optional>> <<optional>>the<</optional>> mit license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "reserved": "<<optional>>copyright <<any:6>><</optional>> all rights reserved",
    "spdx": "spdx license identifier <<any:1>>",
}

_MARK = re.compile(r"<<(/?optional|any:\d+|of:[^>]+)>>")


class Automaton:
    """Token automaton of a template: state i reads one of ``words[i]`` (None: any word) and goes to i + 1; ``skips[i]`` are states that may be
    entered from i without reading. ``need[i]`` counts the mandatory words before state i."""

    def __init__(self, template: str):
        self.words: list[frozenset[bytes] | None] = []
        jumps: dict[int, set[int]] = {}
        optional, opened, mandatory = 0, [], []
        at = 0
        for mark in [*_MARK.finditer(template), None]:
            for w in words(template[at : mark.start() if mark else len(template)].encode()):
                self.words.append(frozenset([w]))
                mandatory.append(not optional)
            if mark is None:
                break
            at, kind = mark.end(), mark[1]
            if kind == "optional":
                opened.append(len(self.words))
                optional += 1
            elif kind == "/optional":
                jumps.setdefault(opened.pop(), set()).add(len(self.words))
                optional -= 1
            elif kind.startswith("of:"):
                self.words.append(frozenset(words(kind[3:].encode())))
                mandatory.append(not optional)
            else:
                n, first = int(kind[4:]), len(self.words)
                for k in range(n):
                    jumps.setdefault(first + k, set()).add(first + n)
                self.words += [None] * n
                mandatory += [False] * n
        self.end = len(self.words)
        self.need = np.concatenate([[0], np.cumsum(mandatory)]).tolist()
        self.skips = [self._closure(i, jumps) for i in range(self.end + 1)]
        self.first = set().union(*(self.words[i] or () for i in self.skips[0] if i < self.end))

    @staticmethod
    def _closure(state: int, jumps: dict[int, set[int]]) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for nxt in jumps.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def match(self, text: list[bytes], start: int) -> tuple[int, float]:
        """Words read until the template is complete (0: never), and the share of its mandatory words reached."""
        states, most = self.skips[0], 0
        for k in range(start, len(text)):
            read = [i for i in states if i < self.end and (self.words[i] is None or text[k] in self.words[i])]
            if not read:
                break
            states = frozenset().union(*(self.skips[i + 1] for i in read))
            most = max(most, *(self.need[i + 1] for i in read if self.words[i] is not None), 0)
            if self.end in states:
                return k + 1 - start, 1.0
        return 0, most / max(1, self.need[-1])


def _places(text: list[bytes], phrase: list[bytes]) -> list[int]:
    return [i for i in range(len(text) - len(phrase) + 1) if text[i] == phrase[0] and text[i : i + len(phrase)] == phrase]


def judge(text: list[bytes], phrases: dict[str, list[bytes]], automata: dict[str, Automaton]) -> tuple[list[int], list[str], list[str], float]:
    """Places of phrases, their labels, all labels, and the greatest share of a template's mandatory words."""
    places, base = [], set()
    for label, phrase in phrases.items():
        if found := _places(text, phrase):
            places += found
            base.add(label)
    labels, best = set(base), 1.0 if base else 0.0
    at: dict[bytes, list[int]] = {}
    firsts = set().union(*(a.first for a in automata.values())) if automata else set()
    for i, w in enumerate(text):
        if w in firsts:
            at.setdefault(w, []).append(i)
    for label, automaton in automata.items():
        for w in automaton.first:
            for i in at.get(w, ()):
                n, share = automaton.match(text, i)
                best = max(best, share)
                if n:
                    labels.add(label)
    return places, sorted(base), sorted(labels), best


def _rare(automaton: Automaton) -> frozenset[bytes]:
    """The longest mandatory word, or all of a listed choice where there is no other: a text without any of them can't be accepted."""
    mandatory = [w for i, w in enumerate(automaton.words) if w is not None and automaton.need[i + 1] > automaton.need[i]]
    return max(mandatory, key=lambda choice: (len(choice) == 1, min(map(len, choice))))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the smallest and largest of them (words from 0).
    ``labels`` has the phrases' and the accepted templates' labels. ``score`` is 1 with a label, else the greatest share of a
    template's mandatory words that stands in the text in order.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    compiled = {label: Automaton(t) for label, t in templates.items()}
    spelled = {label: words(p.encode()) for p, label in phrases.items()}
    anchors = sorted({max(p, key=len) for p in spelled.values()} | set().union(*map(_rare, compiled.values())))
    anchors = [a for a in anchors if not any(b != a and b in a for b in anchors)]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                data, bounds = raw(part.column("text"))
                lowered = data.tobytes().translate(LOWER)
                hit = np.zeros(part.num_rows, bool)
                for anchor in anchors:
                    at = lowered.find(anchor)
                    while at >= 0:
                        row = int(np.searchsorted(bounds, at, side="right")) - 1
                        hit[row] = True
                        at = lowered.find(anchor, int(bounds[row + 1]))
                n = part.num_rows
                count, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
                base, labels, score = [""] * n, [""] * n, np.zeros(n)
                for i in np.flatnonzero(hit):
                    places, own, every, score[i] = judge(words(lowered[bounds[i] : bounds[i + 1]]), spelled, compiled)
                    base[i], labels[i], count[i] = ",".join(own), ",".join(every), len(places)
                    if places:
                        first[i], last[i] = min(places), max(places)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(word_counts(data, bounds)), pa.array(count), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)

"""Licence scan by templates with markup, compiled to automata over words.

A template is the wording of a licence or of its notice. Its words are mandatory,
in their order and without others between, except where the markup says so:

    <<beginOptional>> ... <<endOptional>>   may be missing
    <<var;words="1-12">>                    any words, that many
    <<var;match="its|the names of its">>    one of these wordings

Templates become one automaton over word numbers. In the tasks words are hashed
over the bytes of many texts at once; where two words can begin a template the
automaton is followed, its sets of states being worked out when they are first met.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from eventledger.llm import byte_words
from eventledger.llm.common import arrow_map, share, text_or_empty

# Phrases that name a licence, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_GIVEN = (
    '<<beginOptional>><<var;match="this|the">> <<var;words="1-3">> is<<endOptional>> '
    '<<var;match="licensed|released|distributed|made available|available">> under '
    '<<beginOptional>><<var;match="the terms of|terms of|the|a|an">><<endOptional>> '
    "<<beginOptional>>the<<endOptional>> "
)
_VERSION = '<<beginOptional>><<var;match="version|v">><<endOptional>> '
_FREE = (
    '<<var;match="this|the">> <<var;words="1-3">> is free software you can redistribute it and or modify it '
    "under the terms of the "
)
_PUBLISHED = " as published by the free software foundation "
_LATER = '<<beginOptional>>of the license<<endOptional>> or at your option any later version'
_CC = {
    "cc-by": ("by", "attribution"),
    "cc-by-sa": ("by sa", "attribution sharealike"),
    "cc-by-nc": ("by nc", "attribution noncommercial"),
    "cc-by-nd": ("by nd", "attribution noderivatives"),
    "cc-by-nc-sa": ("by nc sa", "attribution noncommercial sharealike"),
    "cc-by-nc-nd": ("by nc nd", "attribution noncommercial noderivatives"),
}

# The wordings of public licences and notices, as their stewards publish them.
TEMPLATES = [
    ("mit", _GIVEN + "mit license"),
    (
        "mit",
        'permission is hereby granted free of charge to any person obtaining a copy of '
        '<<var;match="this software and associated documentation files|this software">> '
        "<<beginOptional>>the software<<endOptional>> to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the following "
        "conditions the above copyright notice and this permission notice "
        "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or "
        "substantial portions of the software",
    ),
    (
        "isc",
        'permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any '
        "purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies",
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer "
        "<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided "
        "with the distribution",
    ),
    (
        "bsd-3-clause",
        'neither the name of <<var;words="1-12">> nor the names of <<var;match="its|the|their">> '
        "<<beginOptional>>copyright holders and<<endOptional>> contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ),
    ("apache-2.0", _GIVEN + "apache license " + _VERSION + "2 <<beginOptional>>0<<endOptional>>"),
    ("gpl-2.0", _GIVEN + "gnu general public license " + _VERSION + "2 <<beginOptional>>0<<endOptional>>"),
    ("gpl-3.0", _GIVEN + "gnu general public license " + _VERSION + "3 <<beginOptional>>0<<endOptional>>"),
    ("gpl-2.0-or-later", _FREE + "gnu general public license" + _PUBLISHED + "either version 2 " + _LATER),
    ("gpl-3.0-or-later", _FREE + "gnu general public license" + _PUBLISHED + "either version 3 " + _LATER),
    ("lgpl-2.1-or-later", _FREE + "gnu lesser general public license" + _PUBLISHED + "either version 2 1 " + _LATER),
    ("lgpl-3.0-or-later", _FREE + "gnu lesser general public license" + _PUBLISHED + "either version 3 " + _LATER),
    ("agpl-3.0-or-later", _FREE + "gnu affero general public license" + _PUBLISHED + "either version 3 " + _LATER),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    *[
        (f"{label}-{version}", _GIVEN + wording + version.replace(".", " "))
        for label, (short, long) in _CC.items()
        for version in ("3.0", "4.0")
        for wording in (
            f"<<beginOptional>>creative commons<<endOptional>> cc {short} ",
            f"creative commons {long} ",
        )
    ],
    *[
        (name, f"spdx license identifier {name.replace('-', ' ').replace('.', ' ')}")
        for name in ("mit", "isc", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "mpl-2.0", "gpl-2.0-or-later", "gpl-3.0-or-later")
    ],
    ("all-rights-reserved", '<<beginOptional>>copyright <<var;words="1-12">><<endOptional>> all rights reserved'),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;(words|match)=\"([^\"]*)\")>>")

ANY = -1
# Worked-out steps of an automaton kept per task.
REMEMBERED = 1 << 16


# --- markup


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class Optional_(NamedTuple):
    inside: list


class Free(NamedTuple):
    least: int
    most: int


class OneOf(NamedTuple):
    wordings: list[list[str]]


def parse(markup: str) -> list:
    """Words, Optional_, Free and OneOf in their order."""
    stack, start = [[]], 0
    for mark in _MARK.finditer(markup):
        stack[-1].extend(words_of(markup[start : mark.start()]))
        start = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inside = stack.pop()
            stack[-1].append(Optional_(inside))
        elif mark[2] == "words":
            least, most = map(int, mark[3].split("-"))
            if not 0 <= least <= most:
                raise ValueError(f"not a range of words: {mark[3]}")
            stack[-1].append(Free(least, most))
        else:
            stack[-1].append(OneOf([words_of(w) for w in mark[3].split("|")]))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    rest = markup[start:]
    if "<<" in rest or ">>" in _MARK.sub("", markup):
        raise ValueError("unknown markup")
    return stack[0] + words_of(rest)


# --- automaton


class Automaton:
    """All templates side by side; sets of states are bits of a number."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.numbers: dict[str, int] = {}
        self.edges: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        starts = []
        for which, (label, markup) in enumerate(templates):
            start = self._state()
            end = self._sequence(start, parse(markup))
            self.accepts[end] = which
            if which in self._accepted(self._closure({start})):
                raise ValueError(f"template {label} accepts no words at all")
            starts.append(start)
        self.closures = [self._bits(self._closure({s})) for s in range(len(self.edges))]
        self.start = 0
        for s in starts:
            self.start |= self.closures[s]
        self.accept_bits = self._bits(set(self.accepts))
        self.steps: dict[tuple[int, int], int] = {}

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _word(self, at: int, word: str) -> int:
        number, to = self.numbers.setdefault(word, len(self.numbers) + 1), self._state()
        self.edges[at].append((number, to))
        return to

    def _sequence(self, at: int, parts: list) -> int:
        for part in parts:
            if isinstance(part, str):
                at = self._word(at, part)
            elif isinstance(part, Optional_):
                end = self._sequence(at, part.inside)
                self.free[at].append(end)
                at = end
            elif isinstance(part, OneOf):
                ends = [self._sequence(at, wording) for wording in part.wordings]
                at = self._state()
                for end in ends:
                    self.free[end].append(at)
            else:
                inside = []
                for k in range(part.most):
                    if k >= part.least:
                        inside.append(at)
                    to = self._state()
                    self.edges[at].append((ANY, to))
                    at = to
                for state in inside:
                    self.free[state].append(at)
        return at

    def _closure(self, states: set[int]) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    def _accepted(self, states) -> list[int]:
        return [self.accepts[s] for s in states if s in self.accepts]

    @staticmethod
    def _bits(states) -> int:
        bits = 0
        for s in states:
            bits |= 1 << s
        return bits

    @staticmethod
    def _each(bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low

    def step(self, states: int, word: int) -> int:
        """``word`` is a number of the vocabulary, 0 for all others."""
        known = self.steps.get((states, word))
        if known is None:
            known = 0
            for s in self._each(states):
                for on, to in self.edges[s]:
                    if on == word or on == ANY:
                        known |= self.closures[to]
            if len(self.steps) >= REMEMBERED:
                self.steps.clear()
            self.steps[states, word] = known
        return known

    def beginnings(self) -> np.ndarray:
        """Which two word numbers in a row may begin a template; one word may be all of it."""
        size = len(self.numbers) + 1
        allowed = np.zeros((size, size), bool)
        for first in range(size):
            after = self.step(self.start, first)
            if not after:
                continue
            if after & self.accept_bits:
                allowed[first] = True
            for s in self._each(after):
                for on, _ in self.edges[s]:
                    allowed[first, slice(None) if on == ANY else on] = True
        return allowed

    def longest(self, words: list[int], at: int, end: int) -> dict[int, int]:
        """Per template that accepts from ``at`` on, where its longest wording ends."""
        states, found = self.start, {}
        while at < end and states:
            states = self.step(states, words[at])
            at += 1
            if states & self.accept_bits:
                for which in self._accepted(self._each(states & self.accept_bits)):
                    found[which] = at
        return found


class Scanner:
    """Finds phrases and templates in many texts at a time."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.automaton = Automaton(templates)
        numbers = self.automaton.numbers
        for phrase in phrases:
            for word in words_of(phrase):
                numbers.setdefault(word, len(numbers) + 1)
        self.phrases = [([numbers[w] for w in words_of(p)], label) for p, label in phrases.items()]
        self.table = byte_words.letters_and_digits()
        data, _ = byte_words.joined_bytes(list(numbers))
        hashes, _, _ = byte_words.word_hashes(data, self.table)
        order = np.argsort(hashes)
        self.hashes, self.by_hash = hashes[order], np.array(list(numbers.values()))[order]
        # the phrases may have added words that no template has
        grown = len(numbers) + 1
        self.pairs = np.zeros((grown, grown), bool)
        allowed = self.automaton.beginnings()
        self.pairs[: len(allowed), : len(allowed)] = allowed

    def scan(self, texts: list) -> Iterator[tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]]:
        """Per text: words, (place, label) of phrases, (start, end, label) of templates; words count from 0."""
        data, edges = byte_words.joined_bytes(texts)
        found, starts, _ = byte_words.word_hashes(data, self.table)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        words = np.where(self.hashes[at] == found, self.by_hash[at], 0)
        cuts = np.searchsorted(starts, edges)
        # a word that no template knows stands between texts and behind the last one
        text_of = np.repeat(np.arange(len(texts)), np.diff(cuts))
        last = np.zeros(len(words), bool)
        last[cuts[1:][np.diff(cuts) > 0] - 1] = True
        follow = np.append(words[1:], 0)
        follow[last] = 0
        begins = np.flatnonzero(self.pairs[words, follow]) if len(words) else np.zeros(0, np.int64)
        places = [[] for _ in texts]
        for phrase, label in self.phrases:
            hit = np.ones(max(len(words) - len(phrase) + 1, 0), bool)
            for k, number in enumerate(phrase):
                hit &= words[k : k + len(hit)] == number
            hit = np.flatnonzero(hit)
            hit = hit[text_of[hit] == text_of[hit + len(phrase) - 1]]
            for place in hit.tolist():
                text = int(text_of[place])
                places[text].append((place - int(cuts[text]), label))
        spans = [[] for _ in texts]
        free_from: dict[tuple[int, int], int] = {}
        for place in begins.tolist():
            text = int(text_of[place])
            first, end = int(cuts[text]), int(cuts[text + 1])
            for which, stop in self._from(words, place, end):
                if place >= free_from.get((text, which), 0):
                    free_from[text, which] = stop
                    spans[text].append((place - first, stop - first, self.automaton.labels[which]))
        for text, n in enumerate(np.diff(cuts).tolist()):
            yield n, places[text], spans[text]

    def _from(self, words: np.ndarray, place: int, end: int) -> list[tuple[int, int]]:
        # templates rarely go on for long: a short stretch first, then the rest
        for reach in (64, end - place):
            stretch = words[place : min(place + reach, end)].tolist()
            found = self.automaton.longest(stretch, 0, len(stretch))
            if place + len(stretch) == end or not self._alive(stretch):
                return [(which, place + stop) for which, stop in found.items()]
        return []

    def _alive(self, stretch: list[int]) -> bool:
        states = self.automaton.start
        for word in stretch:
            states = self.automaton.step(states, word)
            if not states:
                return False
        return True


# --- the operator


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Licences that each text names or states.

    One row per row of ``docs``: doc_id, n_words, n_base (places of phrases),
    first_word and last_word (the first and the last of them, null without any),
    base_labels, labels (those of accepted templates too), score, spans
    (``label:start:end`` of accepted templates in words, end exclusive, by start).
    The score is 1 where a template accepts, half where a licence is only named, else 0.

    Per template the leftmost accepted place counts, as long as it can be, and no two
    of one template overlap. A null or empty text has no words; other columns of
    ``docs`` are not read.
    """
    shared = share(docs.sparkSession, (templates, phrases))

    def rows():
        scanner = Scanner(*shared())

        def handle(ids, texts):
            for part in byte_words.chunks(texts):
                for doc_id, (n, places, spans) in zip(ids[part], scanner.scan(texts[part])):
                    at = [place for place, _ in places]
                    base = {label for _, label in places}
                    stated = {label for _, _, label in spans}
                    yield (
                        doc_id,
                        n,
                        len(at),
                        min(at, default=None),
                        max(at, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | stated)),
                        1.0 if stated else 0.5 if base else 0.0,
                        ",".join(f"{label}:{start}:{end}" for start, end, label in sorted(spans)),
                    )

        return handle

    return arrow_map(
        docs.select(F.col("doc_id").cast("bigint"), text_or_empty()),
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double, spans string",
        rows,
    )


def as_regex(markup: str) -> str:
    """The same wording as a regular expression over words with one space behind each."""

    def part(p) -> str:
        if isinstance(p, str):
            return f"{p} "
        if isinstance(p, Optional_):
            return f"(?:{sequence(p.inside)})?"
        if isinstance(p, OneOf):
            return f"(?:{'|'.join(sequence(w) for w in p.wordings)})"
        return f"(?:[^ ]+ ){{{p.least},{p.most}}}"

    def sequence(parts) -> str:
        return "".join(map(part, parts))

    return sequence(parse(markup))

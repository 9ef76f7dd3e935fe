"""License scans by templates with markup, compiled to token automata.

A template is wording with marked regions: ``<<beginOptional>> ... <<endOptional>>`` may be there
or not (regions nest), and ``<<var;name=...;words=0-8>>`` stands for so many words of any kind. All
other words are mandatory and must be there exactly, in their order, compared as the scan reads
words: ASCII letters lower-cased, everything else in ASCII a separator.

A template becomes an automaton over words: a state for every word, steps without a word past
optional regions, and counted loops for replaceable ones. It is run from every place of a
document where its first mandatory words stand, and accepts if it comes to its end. What a run
holds at once is bounded by the template, whatever the text.

The plain phrases of the contract are templates without regions and go the same way.
"""

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.tables import runs

# Phrases whose places are counted, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
SEED_WORDS = 4  # of the first mandatory words, so many are looked for before a run begins

# Well-known notices; regions mark what is left out or replaced in practice.
TEMPLATES = {
    "mit": [
        "under the <<beginOptional>>terms of the<<endOptional>> mit <<beginOptional>>x11<<endOptional>> license",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "<<var;name=work;words=1-6>> and associated documentation files <<beginOptional>>the software"
        "<<endOptional>> to deal in the <<var;name=work;words=1-3>> without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
        "spdx license identifier mit",
    ],
    "apache-2": [
        "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>",
        "you may not use this file except in compliance with the license <<beginOptional>>you may obtain a "
        "copy of the license at<<endOptional>> <<var;name=place;words=0-8>> unless required by applicable law",
        "spdx license identifier apache 2 0",
    ],
    "cc-by-nc": [
        "creative commons attribution <<beginOptional>>non<<endOptional>> <<beginOptional>>noncommercial"
        "<<endOptional>> <<beginOptional>>commercial<<endOptional>> <<var;name=version;words=0-3>> license",
        "licensed under cc by nc <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> 4",
    ],
    "gpl": [
        "under the <<beginOptional>>terms of the<<endOptional>> gnu <<beginOptional>>lesser<<endOptional>> "
        "<<beginOptional>>affero<<endOptional>> general public license",
        "this program is free software you can redistribute it and or modify it under the terms of",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted "
        "<<beginOptional>>provided that the following conditions are met<<endOptional>>",
        "under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> "
        "<<var;name=clauses;words=0-3>> bsd <<beginOptional>>style<<endOptional>> license",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted <<beginOptional>>provided that the above copyright notice<<endOptional>>",
    ],
    "all-rights-reserved": [
        "copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;words=1-12>> all rights reserved",
    ],
}

# What is a word, as a map of bytes; bytes from 128 on are parts of other letters.
_READ = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_READ).split()


@dataclass
class State:
    """``word`` leads to the next state; ``free`` names those reached without a word; in a
    state with ``loop`` any word leads on to the next."""

    word: bytes | None = None
    free: list[int] = field(default_factory=list)
    loop: bool = False


_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_VAR = re.compile(r"var;(?:[a-z]+=[^;>]*;)*words=([0-9]+)-([0-9]+)")


class Template:
    """A compiled template: states 0 to n, of which n accepts."""

    def __init__(self, markup: str):
        self.states = [State()]
        self.fixed = 0
        opened: list[int] = []
        cut = _MARKUP.split(markup)
        for text, mark in zip(cut[::2], [*cut[1::2], ""], strict=True):
            for word in words(text.encode()):
                self._step(State(word=word))
                self.fixed += 1
            if mark == "beginOptional":
                opened.append(len(self.states) - 1)
            elif mark == "endOptional":
                if not opened:
                    raise ValueError(f"no region is open at {mark} in {markup!r}")
                self.states[opened.pop()].free.append(len(self.states) - 1)
            elif mark:
                self._replaceable(mark)
        if opened:
            raise ValueError(f"a region stays open in {markup!r}")
        self.seed = self._first_words()
        if not self.seed:
            raise ValueError(f"a template begins with a mandatory word: {markup!r}")

    def _step(self, state: State) -> None:
        """Let the last state lead to a new one as ``state`` says."""
        last = self.states[-1]
        if last.word is not None or last.loop:
            raise AssertionError("the last state has its step already")
        last.word, last.loop = state.word, state.loop
        self.states.append(State())

    def _replaceable(self, mark: str) -> None:
        found = _VAR.fullmatch(mark)
        if not found:
            raise ValueError(f"a replaceable region needs words=least-most: {mark!r}")
        least, most = int(found[1]), int(found[2])
        start = len(self.states) - 1
        for _ in range(most):
            self._step(State(loop=True))
        for i in range(start + least, start + most):
            self.states[i].free.append(start + most)

    def _first_words(self) -> list[bytes]:
        seed = []
        for state in self.states:
            if state.word is None or state.free:
                break
            seed.append(state.word)
        return seed

    def _reach(self, at: int, held: int, best: dict[int, int]) -> None:
        """Add to ``best`` a state and those reached from it without a word, with the fixed words
        read so far; of several ways the one with most."""
        todo = [at]
        while todo:
            state = todo.pop()
            if best.get(state, -1) < held:
                best[state] = held
                todo += self.states[state].free

    def match(self, text: list[bytes], start: int) -> int | None:
        """Fixed words read by the best run from ``start``, or None if none is accepted.

        Of several ends the one with the most of the template's wording counts.
        """
        now: dict[int, int] = {}
        self._reach(0, 0, now)
        end, found = len(self.states) - 1, None
        for word in text[start : start + len(self.states)]:
            found = max((x for x in (found, now.get(end)) if x is not None), default=None)
            then: dict[int, int] = {}
            for state, held in now.items():
                own = self.states[state]
                if own.loop:
                    self._reach(state + 1, held, then)
                elif own.word == word:
                    self._reach(state + 1, held + 1, then)
            now = then
            if not now:
                break
        return max((x for x in (found, now.get(end)) if x is not None), default=None)


class Scanner:
    """All templates; ``scan`` reads a whole text."""

    def __init__(self, base: dict[str, str], templates: dict[str, list[str]]):
        plain = [(label, Template(phrase), True) for phrase, label in base.items()]
        marked = [(label, Template(t), False) for label, all_ in templates.items() for t in all_]
        # templates that begin alike are looked for once
        self.by_seed: dict[bytes, list[tuple[str, Template, bool]]] = {}
        for label, template, is_base in [*plain, *marked]:
            seed = b" " + b" ".join(template.seed[:SEED_WORDS]) + b" "
            self.by_seed.setdefault(seed, []).append((label, template, is_base))

    def scan(self, text: bytes | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        read = words(text)
        joined = b" " + b" ".join(read) + b" "
        places: list[int] = []
        base, labels, score = set(), set(), 0.0
        for seed, own in self.by_seed.items():
            at, counted, start = joined.find(seed), 0, 0
            while at >= 0:
                start += joined.count(b" ", counted, at)  # the number of the word after this space
                counted = at
                for label, template, is_base in own:
                    held = template.match(read, start)
                    if held is None:
                        continue
                    labels.add(label)
                    score = max(score, held / template.fixed)
                    if is_base:
                        base.add(label)
                        places.append(start)
                at = joined.find(seed, at + 1)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(read), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
]
_DDL = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)


def _scan_batches(base: dict[str, str], templates: dict[str, list[str]]):
    def scan(batches):
        scanner = Scanner(base, templates)
        for batch in batches:
            texts, rows = batch.column("text").cast(pa.binary()), []
            for start, n in runs(batch, "text"):  # some texts at a time are made Python's
                rows += [scanner.scan(t) for t in texts.slice(start, n).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
            found = [pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *found], ["doc_id", *(n for n, _ in _FIELDS)]
            )

    return scan


def scan_licenses(
    docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None
) -> DataFrame:
    """What every whole text of (doc_id, text) says of its license.

    n_words; n_base, first_word and last_word: places of the ``base`` phrases, all counted, and
    the smallest and largest number of their first words (from 0; null without one); base_labels
    and labels: those of the phrases, and of ``templates`` as well, distinct, sorted and joined by
    commas; score: the largest share of a template's wording (words of its own, optional ones
    included) that an accepted place has, 0 without one, 1 for every base phrase.

    A null or empty text has no words and no labels. Rows stay as they are, equal ones too, in
    one pass without a shuffle; an empty table gives an empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    scan = _scan_batches(BASE if base is None else base, TEMPLATES if templates is None else templates)
    return narrow.mapInArrow(scan, _DDL)

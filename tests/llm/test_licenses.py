import itertools
import random
import re

import pytest

from tallow.llm import licenses
from tallow.llm.licenses import Scanner, Template, words
from tests.llm.cases import documents, none

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def read(text):
    """Words as the contract says, on text instead of bytes."""
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def wordings(markup):
    """Every text a template accepts, a replaced word as None, with its fixed words."""
    tree, stack = [[]], []
    cut = re.split(r"<<(.*?)>>", markup)
    for text, mark in itertools.zip_longest(cut[::2], cut[1::2], fillvalue=""):
        own = text.split()
        tree = [t + own for t in tree]
        if mark == "beginOptional":
            stack.append(tree)
        elif mark == "endOptional":
            tree = stack.pop() + tree
        elif mark:
            least, most = map(int, re.search(r"words=(\d+)-(\d+)", mark).groups())
            tree = [t + [None] * n for t in tree for n in range(least, most + 1)]
    return tree


def brute(base, templates, text):
    """All wordings tried at all places."""
    own, places, plain, labels, score = read(text), [], set(), set(), 0.0
    every = [(label, phrase, True) for phrase, label in base.items()]
    every += [(label, t, False) for label, many in templates.items() for t in many]
    for label, markup, is_base in every:
        fixed = len(re.sub("<<.*?>>", " ", markup).split())
        for start in range(len(own)):
            held = [
                sum(w is not None for w in wording) for wording in wordings(markup)
                if len(own) - start >= len(wording)
                and all(w is None or w == x for w, x in zip(wording, own[start:], strict=False))
            ]
            if held:
                labels.add(label)
                score = max(score, max(held) / fixed)
                if is_base:
                    places.append(start)
                    plain.add(label)
    first, last = (min(places), max(places)) if places else (None, None)
    return len(own), len(places), first, last, ",".join(sorted(plain)), ",".join(sorted(labels)), score


SMALL = {
    "one": ["a <<beginOptional>>b<<endOptional>> c", "a b <<var;name=x;words=0-2>> d"],
    "two": ["b <<beginOptional>>a <<beginOptional>>c<<endOptional>> d<<endOptional>> <<var;words=1-3>> a"],
    "three": ["c <<var;words=2-2>> b <<beginOptional>>a<<endOptional>>", "a a <<beginOptional>>a<<endOptional>>"],
}
SMALL_BASE = {"a b": "ab", "b a b": "bab", "d": "one"}


def test_automata_against_every_wording():
    rng, scanner = random.Random(13), Scanner(SMALL_BASE, SMALL)
    seen = set()
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b", "c", "d"]) + rng.choice([" ", "\n", "-", ", "]) for _ in range(rng.randrange(12)))
        got = scanner.scan(text.encode())
        assert got == brute(SMALL_BASE, SMALL, text), text
        seen.add(got[5])
    assert len(seen) > 15


@pytest.mark.parametrize("label", licenses.TEMPLATES)
def test_every_wording_of_the_templates_is_accepted_and_others_not(label):
    rng, scanner = random.Random(label), Scanner({}, {label: licenses.TEMPLATES[label]})
    for markup in licenses.TEMPLATES[label]:
        for wording in wordings(markup):
            for _ in range(3):
                text = [w or f"x{rng.randrange(9)}" for w in wording]
                n, *_, labels, score = scanner.scan(" ".join(["intro", *text, "end"]).title().encode())
                assert labels == label and 0 < score <= 1
            fixed = [i for i, w in enumerate(wording) if w is not None]
            broken = [w or "x" for w in wording]
            broken[rng.choice(fixed[: len(Template(markup).seed)])] = "other"
            if not any(t in " ".join(broken) for t in ("under the", "license")):
                assert scanner.scan(" ".join(broken).encode())[5] == ""


def test_documents_against_every_wording(spark):
    rng = random.Random(5)
    pieces = [*licenses.BASE, "under the terms of the MIT license", "Apache-License\tversion 2.0", "CC-BY-NC 4.0",
              "under the GNU general public license", "Copyright (c) 2024 Jané Doe. All rights reserved",
              "Copyright all rights reserved", "some words", "under", "the", "mit", "MİT license", "cc by nc cc by nc"]
    texts = [(100 + i, " ".join(rng.choices(pieces, k=rng.randrange(1, 9))), "en", "a") for i in range(80)]
    docs = documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    few = {k: v for k, v in licenses.TEMPLATES.items() if k in ("mit", "gpl", "all-rights-reserved")}
    few = {k: [t for t in v if len(t) < 200] for k, v in few.items()}
    got = [tuple(r) for r in licenses.scan_licenses(docs, templates=few).collect()]
    wanted = [(name, *brute(licenses.BASE, few, text if len(text or "") < 9000 else "")) for name, text in rows]
    long = [i for i, (_, text) in enumerate(rows) if len(text or "") >= 9000]
    assert [g for i, g in enumerate(got) if i not in long] == [w for i, w in enumerate(wanted) if i not in long]
    assert [got[i][1] for i in long] == [len(read(rows[i][1])) for i in long]
    assert {r[5] for r in got} >= {"", "mit", "apache-2,mit"} and {r[2] for r in got} >= {0, 1, 2}


def test_words_are_those_of_the_pattern():
    every = "".join(map(chr, range(0, 0x300))) + "é x y z 漢字"
    assert words(every.encode()) == [w.encode() for w in read(every)]
    assert words(None) == words(b"") == []


def test_faults_in_a_template_are_told():
    for markup in ("<<beginOptional>>a<<endOptional>> b", "a <<beginOptional>>b", "a b<<endOptional>>", "a <<var;name=x>> b", ""):
        with pytest.raises(ValueError):
            Template(markup)


def test_a_long_replaceable_region_is_bounded():
    template = Template("a <<var;words=0-50>> z")
    text = [b"a"] * 5000 + [b"z"]
    assert template.match(text, 0) is None
    assert template.match(text, 4949) == 2 and template.match(text, 4948) is None


def test_empty_table(spark):
    empty = licenses.scan_licenses(none(documents(spark)))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"

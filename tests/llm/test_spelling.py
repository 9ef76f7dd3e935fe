import random
import zlib
from collections import Counter

import pytest

from tallow.llm import spelling
from tests.llm.cases import documents, none


def is_near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, factor=10):
    near = {w: [v for v in words if v != w and is_near(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= factor * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), words[form[w]] if w in form else -1) for w, n in words.items())


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint")


def some_words():
    """Few letters, many repeats, so that every kind of neighbour is there more than once."""
    rng, words = random.Random(12), {}
    for _ in range(500):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 8)))
        words[word] = rng.choice([1, 2, 3, 9, 10, 11, 30, 99, 100, 101, 1000, 10_000])
    words |= {"aaaaaaaa": 5, "aaaaaaaaa": 50, "aaaaaaaaaa": 500, "aaaaaaaaaab": 5000}
    return words


def test_neighbours_forms_and_roots(spark):
    words = some_words()
    wanted = brute(words)
    assert max(r[4] for r in wanted) > 8 and sum(r[1] != "" and r[1] != r[2] for r in wanted) > 5
    assert found(spelling.group_variants(frame(spark, words))) == wanted
    assert found(spelling.group_variants(frame(spark, words), 2)) == brute(words, 2)


def test_long_chains_end(spark):
    words = {"a" * (i + 1): 10**i for i in range(17)}
    got = found(spelling.group_variants(frame(spark, words)))
    assert got == brute(words) and {r[2] for r in got} == {"a" * 17}


@pytest.mark.parametrize("length", [253, 254, 255, 256, 257, 258, 259, 300])
def test_hashed_keys_meet_as_their_texts_would(length):
    """Both kinds of keys, and words on either side of the border between them."""
    rng = random.Random(length)
    word = "".join(rng.choice("ab") for _ in range(length))
    at = rng.randrange(length)
    others = [word[:at] + "c" + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + "a" + word[at:]]
    others += ["c" + word, word + "c", word[1:], word[:-1], word[::-1], word[1:] + word[0], word]

    def meets(a, b):
        """Keys that both have, by the rule of the groups."""
        ka, kb = spelling.rotation_keys(a), spelling.rotation_keys(b)
        replaced = {k for k, skips, _ in ka if skips} & {k for k, skips, _ in kb if skips}
        longer = {k for k, skips, begins in ka if skips and begins} & {k for k, skips, _ in kb if not skips}
        shorter = {k for k, skips, _ in ka if not skips} & {k for k, skips, begins in kb if skips and begins}
        return len(replaced), len(longer) + len(shorter)

    for other in others:
        if other != word:
            same = len(other) == len(word)
            assert meets(word, other) == ((int(is_near(word, other)), 0) if same else (0, int(is_near(word, other))))


def test_very_long_words_take_little_space(spark):
    word = "ab" * 30_000
    words = {word: 2, word[:-1]: 20, word[:7] + "c" + word[8:]: 200, word + "ab": 7}
    assert found(spelling.group_variants(frame(spark, words))) == brute(words)


def count(rows):
    """Words of documents, one letter at a time."""
    counts = Counter()
    for name, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 2}


def test_documents_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 5)
    rng = random.Random(3)
    vocabulary = ["Sentence", "sentence", "sentense", "ÉCOLEs×÷", "Éécolesé", "straßen", "neighbour", "neighbor", "İstanbul", "tiny"]
    texts = [(100 + i, " ".join(rng.choices(vocabulary, k=40)) + "1Sentence-sentenceİx", "en", "a") for i in range(60)]
    docs = documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = count(rows)
    assert len(wanted) > 15
    assert found(spelling.spelling_variants(docs)) == brute(wanted)
    assert dict(spelling.spelling_variants(docs).dtypes) == {
        "word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"
    }


def test_odd_words(spark):
    rows = [("wordsof", 2), ("wordsof", 3), (None, 5), ("wordsoff", None), ("wordsoff", 60), ("", 4), ("w", 90)]
    df = spark.createDataFrame(rows, "word string, n bigint")
    assert found(spelling.group_variants(df)) == brute({"wordsof": 5, "wordsoff": 60, "": 4, "w": 90})
    assert spelling.spelling_variants(none(documents(spark))).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(df, 1)

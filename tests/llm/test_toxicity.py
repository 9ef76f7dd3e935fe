import functools
import itertools
import random
import re

import numpy as np

from tallow.llm import toxicity
from tests.llm.cases import documents, none


@functools.cache
def brute_terms(u):
    """All triples of places within the gaps."""
    u, out = f"\x01{u}\x01", {}
    for i, j, k in itertools.combinations(range(len(u)), 3):
        if j - i <= toxicity.GAP and k - j <= toxicity.GAP:
            codes = tuple(toxicity._letter(u[x]) for x in (i, j, k))
            if all(codes):
                out[codes] = out.get(codes, 0) + toxicity.DECAY ** (k - i)
    return out


def dot(x, y, inner=False):
    return sum(v * y.get(key, 0) for key, v in x.items() if not (inner and 63 in key))


def brute_kernel(s, t):
    a, b = brute_terms(s), brute_terms(t)
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if a and b else 0.0


def brute_score(model, text):
    """From landmarks to score, one unit at a time; for units of at most 40 characters."""
    marks = model.landmarks.units
    floored = lambda u: np.array([k if k >= toxicity.FLOOR else 0 for k in (brute_kernel(u, m) for m in marks)])
    margins, sentence = [model.bias], np.zeros(len(marks))
    for word in [*text.split(), None]:
        if word is not None:
            unit = toxicity.unit_of(word)
            pieces = {unit}
            for m in marks:
                own = brute_terms(m)
                if dot(brute_terms(unit), own, True) >= toxicity.HOLD * dot(own, own, True) > 0:
                    for n in (len(m), len(m) + 1):
                        pieces |= {unit[i : i + n] for i in range(len(unit) - n + 1)}
                    pieces |= {p for p in re.split(r"[\W_]+", unit) if len(p) >= 3}
            for run in re.findall(r"[^\W_](?:[\W_][^\W_]){2,}", unit):
                for n in {2 * len(m) + d for m in marks for d in (-1, 1)}:
                    pieces |= {run[i : i + n] for i in range(0, max(1, len(run) - n + 1), 2)}
            sentence = np.maximum(sentence, np.max([floored(p) for p in pieces], axis=0))
        if word is None or word[-1] in ".!?":
            margins += [sentence @ model.weights + model.bias] if sentence.any() else []
            sentence = np.zeros(len(marks))
    return 1 / (1 + np.exp(-(model.slope * max(margins) + model.shift)))


def test_kernel_and_its_bound():
    random.seed(4)
    marks = ["idiot", "worthless", "clown", "loweiä", "aaa"]
    units = marks + ["", "i", "id", "i.d.i.o.t", "idxiot", "clo-wn", "worthles", "the"]
    units += ["".join(random.choices("idotclwnaé.-", k=random.randint(1, 20))) for _ in range(300)]
    got = toxicity.Landmarks(marks).kernels(units)
    want = np.array([[brute_kernel(u, m) for m in marks] for u in units])
    want[want < toxicity.FLOOR] = 0
    assert np.allclose(got, want, atol=1e-5)


def corpus(spark, n=400):
    random.seed(5)
    rows, labels = [], []
    insults = ["idiot", "worthless", "moron", "clown"]
    for i in range(n):
        words = ["".join(random.choices(["the", "er", "in", "at", "on"], k=random.randint(1, 4))) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            words[random.randrange(60)] = random.choice(insults)
            words[random.randrange(60)] = random.choice(insults)
        words[30] += "."
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    schema = "doc_id bigint, text string, lang string, source string"
    return (
        spark.createDataFrame(rows, schema),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_held_out_accuracy_spellings_and_odd_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.predict_toxicity(docs, model).collect() if r.held_out]
    assert held and all(r.predicted == known[r.doc_id] for r in held)
    reader = toxicity.Reader(model.landmarks)
    score = lambda t: model.score(reader.sentences([t])[0])
    assert score("the in at on.") < 0.5 < score("on IDIOT! at the")
    assert score("you i d i o t there") > score("you t o i d i there")
    assert score("what a wor-thless thing") > 0.5 and score("a worth.less one") > 0.5
    assert score("in the " + "at" * 5000) < 0.5
    rows = toxicity.predict_toxicity(documents(spark), model).collect()
    assert len(rows) == documents(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    kept = toxicity.keep_civil(documents(spark, [(9, "a worthless idiot", "en", None)]), model)
    assert kept.columns == documents(spark).columns and kept.where("doc_id = 9").count() == 0


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark, 8)
    for marks in (none(labels), labels.where("toxic = 0")):
        model = toxicity.fit(docs, marks)
        assert {r.score for r in toxicity.predict_toxicity(docs, model).collect()} == {0.0}
    assert toxicity.predict_toxicity(none(docs), None).collect() == []


def test_insults_in_long_units_and_beside_single_letters_are_not_diluted():
    reader = toxicity.Reader(toxicity.Landmarks(["idiot", "worthless"]))
    for text, least in (
        ("you-are-a-complete-idiot-and-everyone-knows-it", 0.99),
        ("youareacompleteidiotandeveryoneknowsitverywell", 0.99),
        ("y o u a r e a n i d i o t", 0.76),
        ("y o u i d i o t", 0.76),
    ):
        found = reader.sentences([text])[0]
        assert found.shape[0] == 1 and found[0, 0] >= least, text
    assert reader.sentences(["well-known-things-that-everyone-has-heard-of-before"])[0].max(initial=0) < 0.5


def test_glued_insults_count_in_units_of_every_length():
    random.seed(6)
    for insult in ("idiot", "worthless", "moron"):
        reader = toxicity.Reader(toxicity.Landmarks(["clown", insult]))
        for length in (*range(len(insult), 24), 30, 38, 39, 40, 41, 42, 43, 60):
            before = random.randint(0, length - len(insult))
            filler = "".join(random.choices("baek", k=length - len(insult)))
            for broken in (insult, f"{insult[:3]}x{insult[3:]}", f"{insult[:2]}-{insult[2:]}", ".".join(insult)):
                found = reader.sentences([filler[:before] + broken + filler[before:]])[0]
                least = 0.99 if broken == insult else 1.2 * toxicity.FLOOR
                assert found.max(initial=0) >= least, (length, before, broken)
        assert reader.sentences(["".join(random.choices("baek", k=30))])[0].max(initial=0) == 0


def test_scores_against_one_unit_at_a_time(spark):
    docs, labels = corpus(spark, 200)
    model = toxicity.fit(docs, labels)
    texts = ["", "the in at on.", "on IDIOT! at the", "a theworthlesser thing. in", "wor-thless, ermoxronin at"]
    texts += ["the you-are-a-clown-and-an-idiot there", "ininid io tat.idiot? clo.wn", "atati.d.i.o.tatin on", "at c-l-o-x-w-nin", "atat" * 9]
    texts += [r.text for r in docs.orderBy("doc_id").limit(12).collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.predict_toxicity(frame, model).collect()}
    want = [brute_score(model, t) for t in texts]
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-4)
    assert min(want) < 0.5 < max(want)

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallow.llm import pii
from tests.llm.cases import documents, none


def brute(text):
    """The base patterns as they are written, one after another."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(k, *m.span()) for k, r, ok in rules for m in re.finditer(r, text) if ok(m[0])]


TEXTS = [
    f"{word} mail ab.{i}@mail{i}.example.com or 10.0.{i}.7 call +1 (255) 555-80{i + 10} pay 4401478003071227 {word}"
    for i, word in enumerate(["so", "then", "und", "les", "que"] * 12)
] + [f'token = "0641917ea4e9feb9cda83477b57ac2654884f4{i}" and 17 or 1234567890123456' for i in range(10, 60)]


@settings(max_examples=400, deadline=None)
@given(st.text("ab1290.@+- ()\nxé", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_field_adds_other_spellings_and_keeps_base_spans():
    field = pii.train(TEXTS)
    kinds = lambda t: [k for k, _, _ in pii.all_spans(t, field)]
    assert kinds("write to ab.12 at mail3 dot example dot com please") == ["email"]
    assert kinds("host 10 . 0 . 0 . 7 is up") == ["ip"]
    assert kinds("ring (255) 555-8013 now") == ["phone"]
    assert kinds("in 2024 there were 17 of 300 at home") == []
    for text in TEXTS:
        assert set(brute(text)) <= set(pii.all_spans(text, field))
    assert pii.masked("a ab@x.com, 10.0.0.1!", field) == "a [EMAIL], [IP]!"


def test_field_finds_every_spelling_of_an_address_without_digits():
    field = pii.train(TEXTS)
    spellings = [pii._respelled("email", "jane.doe@example.com", turn) for turn in range(4)]
    spellings += ["jane.doe[at]example.com", "Jane ( AT ) Example.com", "jane at example.com"]
    spellings += ["jane at example[.]com", "jane at example . com"]
    for spelling in spellings:
        text = f"please write to {spelling} soon"
        assert [(k, text[a:b]) for k, a, b in pii.all_spans(text, field)] == [("email", spelling)]
        assert pii._marked(text, [("email", 16, 16 + len(spelling))])[1], spelling
        # far from any other trigger in a long text, too
        long = f"{'some words ' * 50}{text}{' other words' * 50}"
        assert pii.masked(long, field) == long.replace(spelling, "[EMAIL]")
    assert pii.all_spans("they met at home. Then they looked at me. So what", field) == []


def test_best_segmentation_is_the_best_of_all():
    field = pii.train(TEXTS)
    region = pii.lattice("+1 (255) 555-8013 10.0.0.7 ab@c.de")
    scores = dict(zip(region.segments, field._scores(region), strict=True))

    def best(at):
        if at == len(region.atoms):
            return 0.0
        ways = [best(at + 1)]
        ways += [s + best(j) for (i, j, _), s in scores.items() if i == at]
        return max(ways)

    assert abs(sum(scores[s] for s in field.best(region)) - best(0)) < 1e-9


def test_query_columns_on_odd_rows(spark):
    docs = documents(spark, [(9, "mail a@b.example.com", "en", None)])
    field = pii.fit(docs)
    rows = pii.find_personal_data(docs, field).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    for r in rows:
        if r.doc_id is not None:
            base = brute(texts[r.doc_id])
            line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
            assert r.n_email == sum(k == "email" for k, _, _ in base)
    masked = pii.mask_personal_data(docs, field)
    assert masked.columns == docs.columns
    assert masked.where("doc_id = 9").first().text == "mail [EMAIL]"
    assert masked.where("text is null").count() == docs.where("text is null").count()


def test_empty_table(spark):
    empty = none(documents(spark))
    assert pii.find_personal_data(empty, pii.fit(empty)).collect() == []

"""Personal data by anchors against the plain patterns."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelens_spark.llm.personal import BASE, luhn, personal_digests, personal_spans, redacted, spans_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(a, BASE[k], b) for a, k, b in sorted(out)]


texts = st.one_of(*[st.text(alphabet=a, max_size=60) for a in ("a1@.", "a1@.- ", "01.", "0123 -", "+0123 ().-", "ab@.+19 -(ü", "+1 (0)-.2@a", "４1.@")])


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_base_kinds_are_those_of_the_patterns(text):
    assert [s for s in spans_of(text) if s[1] in BASE] == brute(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail jürgen@exämple.de now", "mailbox", "jürgen@exämple.de"),
        ("see https://bob:pw@host.com:80/x", "address", "https://bob:pw@host.com:80"),
        ("http://10.0.0.1/a", "address", "http://10.0.0.1"),
        ("IBAN: DE89 3704 0044 0532 0130 00 AND SO", "iban", "DE89 3704 0044 0532 0130 00"),
        ("IBAN: DE88 3704 0044 0532 0130 00", "iban", None),
        ("Account number: 12-3456789 is new", "account", "12-3456789"),
        ("my account is big and 12", "account", None),
        ("discount 123456", "account", None),
        ("http://example.com/a and http://300.1.1.1/", "address", None),
    ],
)
def test_kinds_that_the_anchors_add(text, kind, found):
    assert [text[a:b] for a, k, b in spans_of(text) if k == kind] == ([found] if found else [])


def test_long_runs_take_linear_time():
    start = time.time()
    for text in ("1" * 2_000_000, "a" * 2_000_000 + "@", "a@" * 300_000, "1." * 300_000, "+1" * 300_000, "iban " * 100_000, "://" * 300_000):
        spans_of(text)
    assert time.time() - start < 30


def test_rows(spark, documents):
    odd = [(1, "x 4111 1111 1111 1111 a@b.co +1 (132) 555-1352 1.2.3.4"), (1, "x 4111 1111 1111 1111 a@b.co +1 (132) 555-1352 1.2.3.4"), (2, None), (None, "a@b.co"), (3, ""), (4, "w " * 300_000 + "ü a@b.co")]
    out = sorted((tuple(r) for r in personal_digests(documents(odd).repartition(3)).collect()), key=repr)
    expected = []
    for doc, text in odd:
        base = brute(text or "")
        flat = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        expected.append((doc, *(sum(k == kind for _, k, _ in base) for kind in BASE), hashlib.sha256(flat.encode()).hexdigest(), flat))
    assert out == sorted(expected, key=repr)
    assert personal_spans(documents([])).collect() == []
    assert {r["text"] for r in redacted(documents(odd[1:5])).collect()} == {"x <card> <email> <phone>", None, "<email>", ""}

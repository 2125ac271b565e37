import hashlib
import random
import re

import pytest

from huddle.llm import pii


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


AWKWARD = ["a@b.cd-x_y@z.w q", "a@b@c.d", "x@y..z", "é@b.c and éa@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.3.255", "1.2.3.4@x.yz",
           "4111 1111 1111 1111", "4111-1111-1111-1111-0 4111111111111111", "+1 (706) 555-3138", "++49 30 1234567 8", "+1+2+3 4567890123",
           "\x01a@b.c\x01 5", "\x02", "😀 a@b.c 😀 +49 (30) 123-4567", "4111  1111 1111 1111", "0" * 40, "1" * 5000, "a" * 5000 + "@", "+" * 500,
           "4111 1111 1111 1111 1.2.3.4", "%@-.-", "a.@b.c.", "1.2.3.4444444444444444444"]


@pytest.fixture(scope="module")
def texts(docs_rows):
    r = random.Random(9)
    al = list("ab1290.@+- ()-%_") + ["é", "\n", "4111111111111111", "a@b.co", "+4930123456", "10.0.0.1"]
    return AWKWARD + ["".join(r.choice(al) for _ in range(r.randint(0, 40))) for _ in range(1500)] + [t for _, t, *_ in docs_rows]


def test_findings_match_the_patterns(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), t[:80]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert got[i].spans.startswith(listed(want))


@pytest.fixture(scope="module")
def revealing(spark):
    """Zorvath stands beside one address in many texts and nowhere else; other words are common."""
    r = random.Random(2)
    common = [f"word{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(30)]
    say = lambda n: " ".join(r.choice(common) for _ in range(n))
    rows = [(i, f"{say(20)} Zorvath z@home.org {say(20)}", 1) for i in range(8)]
    rows += [(20 + i, say(60), 1) for i in range(200)]
    rows += [(300 + i, f"Quibble {say(3)} q{i}@x.com", 1) for i in range(6)]           # another entity each
    rows += [(400 + i, "Lonely once@only.net here", 1) for i in range(50)]            # copies of one text
    rows += [(8, rows[0][1], 1), (None, rows[0][1], 1), (None, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int")


def test_disclosing_terms(revealing):
    got = [(r.doc_id, r.spans) for r in pii.spans(revealing).collect()]
    assert len(got) == revealing.count()
    text = {r.doc_id: r.text for r in revealing.collect() if r.doc_id is not None}
    for d, s in got:
        if d is not None and "@" in text[d]:
            added = [text[d][int(a):int(b)] for k, a, b in (x.split(":") for x in s.split(",")) if k in ("removed", "generalised")]
            assert added == (["Zorvath"] if "Zorvath" in text[d] else []), (d, s)
        elif d is not None:
            assert s == ""


def test_sanitised(revealing):
    got = pii.sanitised(revealing)
    assert got.columns == revealing.columns and got.count() == revealing.count()
    before = {r.doc_id: r.text for r in revealing.collect()}
    for r in got.collect():
        if r.doc_id is not None and r.doc_id < 9:
            assert "[EMAIL]" in r.text and "Zorvath" not in r.text and "z@home.org" not in r.text
        elif r.doc_id is not None and r.doc_id < 300:
            assert r.text == before[r.doc_id]
    assert sum(r.text is None for r in got.collect()) == 1


def test_overlaps_are_replaced_once(spark):
    df = spark.createDataFrame([(1, "x +4111111111111111 y 1.2.3.4@a.bc z")], "doc_id long, text string")
    t = pii.sanitised(df).first().text
    assert not re.search("[0-9]", t) and t.startswith("x ") and t.endswith(" z")


def test_empty(none, docs):
    assert pii.spans(none).count() == 0
    assert pii.sanitised(none).columns == none.columns and pii.sanitised(none).count() == 0
    assert pii.sanitised(docs).count() == docs.count()

import hashlib
import random
import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seriesmill.llm import pii

from .conftest import frame


def brute(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return ",".join("%s:%d:%d" % x for x in out)


CASES = [
    "a@b.c%d@e.f x@y", "@a.b a@@b.c 1.2.3.4.5 001.002.255.0256 999.1.1.1", "\U0001f600é +1 (559) 555-3893 x@y.zz. +12345678901234567 +1 2",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "", None, "1.2.3.4 1.2.3.4a@b.cc--", "a@b.c@d.e 5 5 5 5", "+" * 50 + "1 23456789",
    "1" * 3000 + " " + "1 " * 9000 + "." * 50 + "a.a@" + "b." * 9000 + "c", "x@a.b.c..d 1.2.3.4.1.2.3.4",
]


def check(spark, texts):
    got = {r.doc_id: r for r in pii.detect(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [len(re.findall(k + ":", want)) for k in pii.BASE_KINDS]
        assert got[i].spans.startswith(want) and len(got[i].scores.split(",")) == len(got[i].spans.split(","))


def test_against_brute_force(spark):
    check(spark, CASES)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab@.%+-0123456789 ()é", max_size=60), min_size=60, max_size=60))
def test_against_brute_force_random(spark, texts):
    check(spark, texts)


def test_account_numbers_and_context(spark):
    r = pii.detect(frame(spark, [(1, "iban GB82 WEST 1234 5698 7654 32"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "call +1 555 555 0100"), (4, "xx +1 555 555 0100")])).orderBy("doc_id").collect()
    assert r[0].n_iban == 1 and r[1].n_iban == 0
    assert (r[2].scores, r[3].scores) == ("0.6", "0.5")


def test_redaction_keeps_rows_and_columns(spark):
    df = frame(spark, [(1, "mail a@b.cc now"), (2, None), (3, "clean"), (3, "clean"), (4, "1.2.3.4a@b.cc")])
    out = pii.redact(df)
    rows = out.orderBy("doc_id").collect()
    assert out.columns == df.columns and len(rows) == 5
    assert rows[0].text == "mail [EMAIL] now" and rows[0].n_chars == len(rows[0].text)
    assert rows[1].text is None and rows[2].text == "clean" and rows[4].text == "[EMAIL]"
    assert pii.redact(df.where("false")).count() == 0


def test_redaction_keeps_columns_of_its_own_names(spark):
    df = frame(spark, [(1, "mail a@b.cc now")]).selectExpr("*", "doc_id as pii_spans", "7 as PII_spans__email", "8 as pii_spans_1")
    out = pii.redact(df)
    assert out.columns == df.columns and [tuple(r)[8:] for r in out.collect()] == [(1, 7, 8)]


def redacted(t):
    spans = sorted(((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute(t).split(",") if x)), key=lambda s: (s[0], -s[1]))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += t[at:a] + "[" + k.upper() + "]"
        at = max(at, b)
    return out + t[at:]


def test_many_spans(spark):
    """More spans than a piece has, over more text than a block has, with overlaps of kinds."""
    rng = random.Random(4)
    parts = ["a@b.cc", "1.2.3.4", "1.2.3.4a@b.cc", "+1 559 555 3893", "é\U0001f600 word", "4111 1111 1111 1111", "x" * 300, "y " * 200]
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (1, 255, 256, 257, 700, 3000)]
    check(spark, texts)
    got = {r.doc_id: r.text for r in pii.redact(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == [redacted(t) for t in texts]


def test_time_follows_the_number_of_spans(spark):
    took = {}
    for n in (4_000, 16_000):
        df = frame(spark, [(1, "a@b.cc " * n)]).coalesce(1)
        best = []
        for _ in range(2):
            began = time.time()
            assert pii.detect(df).first().n_email == n and pii.redact(df).first().text == "[EMAIL] " * n
            best.append(time.time() - began)
        took[n] = min(best)
    assert took[16_000] < 9 * took[4_000] + 1


def test_main_path_has_no_python(spark, docs):
    for df in (pii.detect(docs), pii.redact(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

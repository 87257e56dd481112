import time
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import pii, registry
from colloquy.llm.spans import matches

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ROWS = [
    (1, None), (2, ""), (3, "mail a.b@c.de and x@y.z+q@r.st, a@b, @c.d, é\U0001f600 tom@mail5.example.com."), (4, "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 001.2.3.255 12345678901.1.1.1"),
    (5, "4441958802365443 4441 9588 0236 5443 4441-9588-0236-5444 0000000000000 1 2 3 4 5"), (6, "+1 (569) 555-4877, +49.89.1234567; +1 2 +(1) +12345678901234567890"),
    (7, 'token = "ca66aed31166840e05a33b5fd7e3392164164ca2" password=64c43f68a3449845b4 the token is'), (8, "SSN 123-45-6789, iban DE89 3704 0044 0532 0130 00"),
    (9, "1" * 12000), (10, "a" * 12000 + "@b.c"), (11, "1.2" * 20000), (12, "x@" + "a." * 9000 + "b"), (13, "+1" + " 2" * 20000), (14, "a.b@c.de" * 400), (3, "mail"),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".") if len(p) < 4000) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as spans").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["op6_pii_weak_supervision"](spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    want = []
    for d, text in ROWS:
        spans = brute(text)
        n = [sum(k == kind for k, _, _ in spans) for kind in PATTERNS]
        want.append((d, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert got == sorted(want)
    by = {r.doc_id: r.spans for r in rows}
    assert by[7].count("secret:") == 2 and "ssn:4:15" in by[8] and "iban:" in by[8]


def test_redaction_takes_effect(spark):
    docs = spark.createDataFrame([(1, "write to a@b.com or +1 (569) 555-4877 now", "s"), (2, None, "s"), (3, "clean \U0001f600", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert got == {1: "write to [EMAIL] or [PHONE] now", 2: None, 3: "clean \U0001f600"}


def test_reliabilities():
    # a labeler that the others contradict half the time is trusted less
    rows = [(0, 1, 1, 1, 0, 400), (0, 1, 1, -1, 0, 400), (0, -1, -1, 1, 0, 100), (0, -1, -1, -1, 0, 100)]
    model = pii.fitted(rows)
    assert model.reliability[0] > 0.9 and model.reliability[2] < 0.7
    assert pii.fitted([]).prior == 0.5


def test_gates_are_necessary(spark):
    """Each text holds one span alone: what a gate lets by is what the pattern finds without it."""
    token = "eyJhbGciOiJIUzI1NiJ9." + "a1B2_-" * 330
    texts = [
        "a@b.c", "1.2.3.4", "4441958802365443", "4441 9588 0236 5443", "+49.89.1234567", "123-45-6789", "DE89 3704 0044 0532 0130 00", "(569) 555-4877", "tom [at] mail [dot] org",
        *(f"x {k}{rest}" for k in ("password", "Passwd", "pwd", "token", "SECRET", "api_key", "access-key", "privatekey") for rest in (" = hunter2hunter2", ": ca66aed311", "=64c43f68a3449845b4")),
        "password'   =   '/hunter2hunter2'", 'passwd"   :   "_a1b2c3d4e5', "secret=+a1b2c3d4", "pwd=.a1b2c3d4", f"token: {token}", f"password={token} y",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ungated = F.array_sort(F.concat(*(F.transform(matches(F.col("text"), s.pattern), lambda m, k=k: F.struct(F.lit(k).alias("k"), m["start"], m["stop"])) for k, s in pii.SOURCES.items() if k == "secret")))
    rows = docs.select("doc_id", pii.candidates(F.col("text")).alias("got"), ungated.alias("want")).collect()
    for r in rows:
        assert r.got, texts[r.doc_id]
        assert [(s.start, s.stop) for s in r.got if pii.KINDS[s.kind] == "secret"] == [(w[1], w[2]) for w in r.want], texts[r.doc_id]
    assert sum(bool(r.want) for r in rows) == len(texts) - 9
    passwords = [(1, "my password = hunter2hunter2 ok"), (2, "passwd: hunter2hunter2"), (3, f"auth token: {token} ok")]
    got = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(passwords, "doc_id long, text string")).collect()}
    assert got == {1: "my [SECRET] ok", 2: "[SECRET]", 3: "auth [SECRET] ok"}


def test_shapes_tell_where_votes_do_not(spark):
    """Spans on which all labelers abstain or split are judged by what spans of their shape mostly are."""
    secret = pii.KINDS.index("secret")
    rows = [(secret, 1, 1, 1, 7, 5000), (secret, -1, -1, -1, 300, 5000), (secret, -1, 1, 0, 7, 5), (secret, -1, 1, 0, 300, 5)]
    model = pii.fitted(rows)
    spans = spark.sql(f"SELECT array(named_struct('kind', {secret}, 'start', 0, 'stop', 9, 'strict', -1, 'known', 1, 'context', 0, 'shape', 7), named_struct('kind', {secret}, 'start', 0, 'stop', 9, 'strict', -1, 'known', 1, 'context', 0, 'shape', 300)) AS s")
    a, b = spans.select(F.transform("s", model.probability)).first()[0]
    assert a > b + 0.05
    x = pii._inputs(np.array([secret]), np.array([[-1, 1, 0]]), np.array([300]))
    assert abs(1 / (1 + np.exp(-(x @ np.array(model.weights))[0])) - b) < 1e-9  # the expression is the fitted function


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(3)
    spans = []
    for kind in range(len(pii.KINDS)):
        at = 0
        for _ in range(300):
            at += rng.randint(1, 90)
            spans.append((kind, at, at + rng.randint(1, 12), 1, 1, 1, 0))
            at = spans[-1][2]
    model = pii.Classifier((9.0, *[0.0] * (3 + len(pii.KINDS) + sum(pii.SHAPE.values()))), (0.7,) * 3, 0.5)
    got = spark.createDataFrame([(spans,)], f"s {pii.SPAN}").select(pii.accepted(F.col("s"), model)).first()[0]
    base = [s for s in spans if s[0] < len(pii.BASE)]
    assert [tuple(s) for s in got] == [s for s in spans if s[0] < len(pii.BASE) or not any(b[1] < s[2] and s[1] < b[2] for b in base)]


def test_empty_table_and_clashing_names(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    assert pii.found(empty).count() == 0 and pii.redacted(empty).count() == 0
    names = ["_spans", "spans", "_placed", "shape", "kind", "s", "_spans1"]
    docs = spark.createDataFrame([(1, "write to a@b.com", 16), (2, None, None)], "doc_id long, text string, n_chars int").selectExpr("*", *(f"n_chars as {n}" for n in names))
    got = pii.redacted(docs)
    assert got.schema == docs.schema
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "write to [EMAIL]" and all(rows[1][n] == 16 for n in names if n != "text") and rows[1].n_chars == 16 and rows[2].text is None


def test_gazetteers(spark):
    want = {"email": [("a@b.com", 1), ("a@b.png", -1), ("a@b.zz", 0)], "ip": [("8.8.8.8", 1), ("10.1.1.1", -1), ("192.168.0.1", -1)], "card": [("4441958802365443", 1), ("9999", 0), ("0444", -1)],
            "phone": [("+49 891", 1), ("+380 44 1", 1), ("+0 1", -1)], "iban": [("DE89 3704 0044 0532 0130 00", 1), ("XX89 3704", -1), ("DE89 3704", 0)], "secret": [("api_key = abc12345", 1), ("token: changeme", -1)], "ssn": [("123-45-6789", 1), ("900-45-6789", -1)]}
    for kind, cases in want.items():
        rows = spark.createDataFrame(cases, "v string, w int").select(pii._known(kind, F.col("v")).alias("g"), "w").collect()
        assert [r.g for r in rows] == [r.w for r in rows], kind


def test_many_spans_in_one_text_cost_in_proportion(spark):
    def seconds(n):
        text = "".join(f"write to me{i}@mail{i}.com or " for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        got = pii.redacted(docs).first().text
        assert got == "write to [EMAIL] or " * n
        return time.perf_counter() - began

    seconds(1)
    assert seconds(64_000) < 30 * max(seconds(4_000), 0.5)

"""Personal data: fixed patterns against plain regular expressions, and labelled sentences that the model never saw."""

import hashlib
import re
import time

import numpy as np
import pytest

from vistalog.llm import personal

PLAIN = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fine = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0, 8 <= len(digits) <= 15][kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_fixed_patterns_equal_plain_expressions():
    rng = np.random.default_rng(4)
    parts = ["@", ".", "-", "+", "(", ")", " ", "a", "Z9", "%", "a.b", "x@y.zz", "1.2.3.4", "256.1.1.1", "007.8.9.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (555) 010-9999", "+49", "٣", "é", "\n", "12", "3", "0000", "日本"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(3000)]
    texts += ["", "@", "a@b", "a@b.c@d.e", "a@b.cd%x@e.f", "1.2.3.4.5.6.7.8", "+1", "+1 2", "4" * 16, "4111 1111 1111 1111 4111 1111 1111 1111", "1." * 50]
    for t in texts:
        assert personal.base_spans(t) == plain(t), t


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "+1" + " " * 400_000, "a@" * 200_000, "1 " * 200_000, "1.2." * 100_000, "a at b.cc " * 20_000, "(" * 300_000, "ab:" * 100_000, "555-123-4567 " * 5_000])
def test_time_is_linear(text):
    model, thresholds = personal.trained()
    start = time.time()
    personal.more_spans(text, personal.base_spans(text), model, thresholds)
    assert time.time() - start < 30


#: What each sentence holds besides the fixed patterns.
SENTENCES = [
    ("Please call our office at (212) 555-0188 before Friday.", [("phone", "(212) 555-0188")]),
    ("Ruf mich an, Telefon 0171 2345678, ab acht.", [("phone", "0171 2345678")]),
    ("Mon téléphone : 06 12 34 56 78 merci", [("phone", "06 12 34 56 78")]),
    ("Write an email to maria.lopez at uni-mail dot es please", [("email", "maria.lopez at uni-mail dot es")]),
    ("email bob(at)example.org today", [("email", "bob(at)example.org")]),
    ("She was born on 12.03.1984 in Kiel.", [("birth_date", "12.03.1984")]),
    ("My SSN 536-22-8714 is on the form", [("national_id", "536-22-8714")]),
    ("Transfer it to IBAN DE89 3704 0044 0532 0130 00 soon", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("The host 2001:db8:85a3:0:0:8a2e:370:7334 was down", [("ip", "2001:db8:85a3:0:0:8a2e:370:7334")]),
    ("Charged to credit card 378282246310005 last week", [("card", "378282246310005")]),
    ("card 4111111111111111 4111111111111111 twice", [("card", "4111111111111111"), ("card", "4111111111111111")]),
    ("Order 555-1234 was sent on 12.03.2021.", []),
    ("It sold 12 345 678 copies between 2001 and 2010.", []),
    ("ISBN 978-3-16-148410-0 is out of print", []),
    ("Version 10.4.11 fixes it; see pages 120-134.", []),
    ("We meet at 10:30 at example.com headquarters, room 12:15:30.", []),
    ("The checksum 4539578763621486 has no meaning here", []),
    ("Published 2020-05-17, updated 2021-06-18", []),
    ("invoice 2023-555-0199 is due", []),
    ("std::vector::at and GB99 NORTH WIND 2020 EAST", []),
    ("The ratio 1234567/89 holds; pi is 3.14159265", []),
]


def test_labelled_sentences():
    model, thresholds = personal.trained()
    hits = wrong = lost = 0
    for text, want in SENTENCES:
        got = [(personal.KINDS[k], text[s:e]) for k, s, e in sorted(personal.more_spans(text, personal.base_spans(text), model, thresholds), key=lambda c: c[1])]
        hits += len([g for g in got if g in want])
        wrong += len([g for g in got if g not in want])
        lost += len([w for w in want if w not in got])
    assert hits >= 10 and wrong == 0 and lost <= 2, (hits, wrong, lost)


def test_calibration_on_examples_of_another_seed():
    model, _ = personal.trained()
    x, y, _ = personal._labelled(np.random.default_rng(77), 2000)
    p = model(x)
    assert np.mean((p >= 0.5) == (y > 0.5)) > 0.97
    for low, high in ((0.0, 0.1), (0.9, 1.01)):
        part = (p >= low) & (p < high)
        assert abs(p[part].mean() - y[part].mean()) < 0.03


def test_rows_edges_and_hash(spark):
    text = "mail a.b@c.org or +1 (555) 010-9999, 1.2.3.4, 4111 1111 1111 1111; Tel. (212) 555-0188"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "x"), (4, "日本語 \U0001f600 a@b.cc " + "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as found", "1 as kind", "2 as spans")
    out = personal.summary(personal.scan(df)).collect()
    assert len(out) == len(rows) and len({tuple(r) for r in out if r["doc_id"] == 1}) == 1
    by = {r["doc_id"]: r for r in out}
    r = by[1]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["n_more"]) == (1, 1, 1, 1, 1)
    base = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for k, s, e in plain(text))
    assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base.rsplit(",", 1)[0])
    none = hashlib.sha256(b"").hexdigest()
    assert all(by[k]["spans"] == "" and by[k]["base_sha256"] == none for k in (2, 3, None))
    assert by[4]["spans"] == "email:6:12"
    assert personal.summary(personal.scan(df.limit(0))).collect() == []


def test_redact(spark):
    df = spark.createDataFrame([(1, "to a@b.cc, Tel. (212) 555-0188!", 5), (2, None, 0), (3, "clean 12 345", 12)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in personal.redact(df).collect()}
    assert rows == {1: ("to <email>, Tel. <phone>!", 25), 2: (None, None), 3: ("clean 12 345", 12)}

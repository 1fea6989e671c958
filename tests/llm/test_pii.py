import hashlib
import random
import re

import pytest

from crowdtally.llm import pii as P

DOC = "doc_id long, text string, spans long, n_email string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    """The contract's patterns as they stand, leftmost and non-overlapping."""
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        odd = [int(c) for c in d[-1::-2]]
        even = [sum(divmod(2 * int(c), 10)) for c in d[-2::-2]]
        if 12 <= len(d) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_base_spans_against_the_plain_patterns(seed):
    rnd = random.Random(seed)
    parts = ["a@b.c", "@", ".", "x@y", "+1 (22) 333-4444", "+", "4111 1111 1111 1111", "-", " ",
             "1.2.3.4", "256.1.1.1", "0", "12", "é", "(", "1.2.3.4.5.6.7.8", "a.b@c-d.e.f", "007.0.0.1",
             "4242424242424242", "\n", "٣", "９", "%_"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "@" * 100_000,
                "1 " * 150_000, "a@" * 100_000, "(" * 100_000, "a.b@c." * 50_000):
        base = P.base_spans(run)
        P.candidates(run, base)


TEXTS = ["", None, "nothing here", "mail a.b@mail.example.com now", "call +1 (988) 555-2485 or 42.144.35.254",
         "card 4111 1111 1111 1111 é 1.2.3.999", "write to jo [at] mail [dot] example.com please",
         'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" x', "z " * 60_000 + "x@y.org"]


def expected_base(text):
    base = brute(text)
    names = ["email", "ip", "card", "phone"]
    digest = hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    return (*[sum(k == n for _, k, _ in base) for n in range(4)], digest), base


def check(got, texts_by_row):
    assert len(got) == len(texts_by_row)
    pool = [(i, t, *expected_base(t)) for i, t in texts_by_row]
    for r in got:
        mine = (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
        row = next(p for p in pool if p[0] == r.doc_id and p[2] == mine)
        pool.remove(row)
        spans = [s.split(":") for s in r.spans.split(",") if s]
        whole = [(int(a), P.KINDS.index(k), int(b)) for k, a, b in spans]
        assert whole == sorted(whole) and set(row[3]) <= set(whole)
        assert all(0 <= a < b <= len(row[1]) for a, _, b in whole)
    assert not pool


def test_small_table_with_odd_rows(rows):
    data = list(enumerate(TEXTS)) + [(None, TEXTS[3]), (3, TEXTS[3])]
    docs = rows(DOC, *[(i, t, 5, "clash") for i, t in data])
    check(P.find(docs).collect(), data)
    assert P.find(docs.limit(0)).collect() == []


def test_added_spans_and_redaction(rows):
    docs = rows(DOC, *[(i, t, i, "clash") for i, t in enumerate(TEXTS * 5)])
    out = {r.doc_id: r for r in P.redact(docs).collect()}
    assert len(out) == 5 * len(TEXTS) and out[2].n_email == "clash" and out[2].spans == 2
    assert out[1].text is None and out[0].text == "" and out[2].text == TEXTS[2]
    assert out[3].text == "mail <EMAIL> now"
    assert out[4].text == "call <PHONE> or <IP>"
    assert out[5].text == "card <CARD> é 1.2.3.999"
    assert "1eb9c654" not in out[7].text
    assert out[8].text == "z " * 60_000 + "<EMAIL>"


def test_long_values_stay_whole(rows):
    rnd = random.Random(4)
    key = "eyJ" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789_") for _ in range(600))
    local = "jo." * 80 + "é"
    text, mail = f"token = {key} end", f"mail {local}@mail.example.com now"
    assert P.candidates(text, P.base_spans(text)) == [(8, 4, 8 + len(key))]
    assert (5, 0, len(mail) - 4) in P.candidates(mail, P.base_spans(mail))
    docs = rows(DOC, *[(i, text, i, "clash") for i in range(20)])
    assert {r.text for r in P.redact(docs).collect()} == {"token = <SECRET> end"}


def test_long_values_take_linear_time():
    for run in ("token=" * 50_000, "token = " * 40_000, "é" * 300_000 + "@b.cc", "é[at]" * 60_000,
                "token=" + "é@b.cc" * 50_000):
        base = P.base_spans(run)
        P.chosen(base, [(*s, "x") for s in P.candidates(run, base)], {"x"})


def test_credential_around_a_base_span():
    text = "token = " + "Ab3_" * 60 + ",jo@mail.example.com;" + "Cd4_" * 60 + " end"
    base = P.base_spans(text)
    (a, k, b), = [s for s in P.candidates(text, base) if s[1] == 4]
    got = P.chosen(base, [(a, k, b, "x")], {"x"})
    assert [s for s in got if s[1] == 0] == base and len(got) == 3
    assert got[0][0] == 8 and got[-1][2] == len(text) - 4
    assert all(x[2] <= y[0] for x, y in zip(got, got[1:]))


def test_em_finds_the_unreliable_labeler():
    rnd = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rnd.random() < 0.4
        marks = "".join("-+"[truth if rnd.random() < right else not truth]
                        for right in (0.95, 0.9, 0.9, 0.55, 0.85, 0.9))
        counts[f"2{marks}40"] = counts.get(f"2{marks}40", 0) + 1
    rel = P.Model(counts).reliability
    right = {k: (v[0][0] + v[1][2]) / 2 for k, v in rel.items()}
    assert min(right, key=right.get) == "cue" and right["pattern"] > 0.85


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(P.query(spark, sf).collect(), docs)


def could_be(text):
    return {(P.KINDS[k], text[a:b]) for a, k, b in P.numbers(text)}


@pytest.mark.parametrize("text, want", [
    ("0049 170 1234567", {("phone", "0049 170 1234567"), ("card", "0049 170 1234567")}),
    ("call 555-123-4567 2024", {("phone", "555-123-4567"), ("card", "555-123-4567 2024")}),
    ("555-123-4567 555-987-6543", {("phone", "555-123-4567"), ("phone", "555-987-6543")}),
    ("(555) 123-4567", {("phone", "(555) 123-4567")}), ("1234567", set()), ("10.20.30.40", set()),
    ("4111 1111 1111 1111", {("card", "4111 1111 1111 1111")}), ("id12-345-6789", {("phone", "345-6789")}), ("12-345-6789x", set()),
    ("555-123-4567 12a", {("phone", "555-123-4567")}), ("x1 555-123-4567", {("phone", "555-123-4567")})])
def test_numbers_are_candidates_of_every_kind_they_could_be(text, want):
    assert could_be(text) == want


def test_runs_of_digits_take_linear_time():
    import time
    started = time.time()
    for junk in ("1-" * 300_000 + "x", "1 " * 300_000, "12345678-" * 50_000, "1" * 600_000 + "x", "(1" * 200_000):
        list(P.numbers(junk))
    assert time.time() - started < 5

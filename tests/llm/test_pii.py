import hashlib
import random

from cohortscope.llm import pii as P
from tests.llm import helpers as H


def test_base_spans_equal_the_patterns():
    rnd = random.Random(0)
    for _ in range(20000):
        t = "".join(rnd.choice("a1@.-+ 2(5)0") for _ in range(rnd.randint(0, 40)))
        assert [s[:3] for s in P.in_order(P.base_spans(t))] == H.base_spans(t)


def test_checksums_and_context():
    assert P.mod97("DE89370400440532013000") and not P.mod97("DE89370400440532013001")
    found = {s[2] for s in P.added_spans("IBAN DE89 3704 0044 0532 0130 00 now")}
    assert found == {"iban"}
    assert not P.added_spans("IBAN DE89 3704 0044 0532 0130 01 now")
    assert {s[2] for s in P.added_spans("social security 123-45-6789")} == {"ssn"}
    assert not P.added_spans("order 123-45-6789")
    assert {s[2] for s in P.added_spans("call me: 555-123-4567")} == {"tel"}
    assert not P.added_spans("555-123-4567") and not P.added_spans("phone order 555-123-4567")


def test_context_is_read_on_both_sides_and_scores_all_kinds():
    assert {s[2] for s in P.added_spans("my number is 123-45-6789, that is my SSN")} == {"ssn"}
    assert {s[2] for s in P.added_spans("555-123-4567 is where you can call me")} == {"tel"}
    assert not P.added_spans("123-45-6789 " + "word " * 12 + "social security")
    assert not P.added_spans("call 555-123-4567 about the invoice")
    card = "4111 1111 1111 1111"
    scores = {t: P.base_spans(t)[0][3] for t in (
        f"{card}", f"my visa {card}", f"{card} (Kreditkarte)", f"order {card}", f"{card} invoice")}
    assert list(scores.values()) == [0.7, 1.0, 1.0, 0.4, 0.4]
    for text in ("+49 30 1234567890", "10.0.0.1", "ann@example.org"):
        alone = P.base_spans(text)[0][3]
        assert 0 < P.base_spans(f"serial {text}")[0][3] < alone <= P.base_spans(
            f"phone mail server {text}")[0][3]
    assert P.SIZES["DE"] == 22 and P.SIZES["MT"] == 31 and len(P.SIZES) > 80


def test_long_runs_stay_linear():
    for t in ("a" * 200_000, "1" * 200_000, "+1" + "(" * 200_000, "a@" * 50_000, "300." * 50_000):
        assert [s[:3] for s in P.in_order(P.base_spans(t))] == []


def test_find_and_redact(spark):
    t = "write é to ann@example.org or 10.0.0.255, card 4111 1111 1111 1111"
    docs = [(0, t), (1, None), (2, ""), (0, t), (3, "x " * 50_000 + t)]
    got = P.find(H.clashing(H.table(spark, docs))).collect()
    assert len(got) == 5
    for r in got:
        if r.doc_id == 0:
            base = ",".join(f"{k}:{a}:{b}" for a, b, k in H.base_spans(t))
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 0)
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base
    df = H.clashing(H.table(spark, docs))
    clean = P.redact(df)
    assert clean.columns == df.columns
    rows = {r.doc_id: r for r in clean.collect()}
    assert rows[0].text == "write é to <EMAIL> or <IP>, card <CARD>"
    assert rows[0].n_chars == len(rows[0].text) and rows[1].text is None
    assert P.find(H.table(spark, [])).count() == P.redact(H.table(spark, [])).count() == 0


def test_accounts_end_before_the_text_behind_them():
    es, be, de = "ES9121000418450200051332", "BE71 0961 2345 6769", "DE89 3704 0044 0532 0130 00"
    cases = [(f"{es} BIC CAIXESBB", [es]), (f"{be} EUR", [be]), (f"{be} 2024", [be]),
             (f"{es} PAYMENT DUE", [es]), (f"{be} {de} EUR", [be, de]), (f"{de} EUR", [de]),
             (f"AB12 3456 7890 {de}", [de]), (be, [be]), (f"{be[:-1]}8 EUR", [])]
    odd = next(a for n in range(100) if P.mod97(a := f"ZZ{n:02}096123456769"))
    cases.append((f"{odd} EUR 2024", [odd]))
    for text, accounts in cases:
        assert [text[a:b] for a, b, k, _ in P.added_spans(text) if k == "iban"] == accounts, text
    assert P.replace(f"pay {be} EUR", P.added_spans(f"pay {be} EUR")) == "pay <IBAN> EUR"


def test_account_runs_stay_linear():
    for t in ("AB12 " * 40_000, "AB12" * 50_000, "DE89 3704 0044 0532 0130 01 " * 8_000):
        assert P.added_spans(t) == []

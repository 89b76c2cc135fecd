import datetime
import random
import re
import string

import pytest

from seqloom.llm.pii import Permuter, _iban_number, luhn_digit, mask, pseudonymise, restore

P = Permuter(b"k")


def luhn(s):
    return luhn_digit(s[:-1]) == s[-1]


def test_small_domains_are_permuted():
    for size in (1, 2, 7, 97, 1000):
        assert sorted(P.walk(x, size, "t") for x in range(size)) == list(range(size))
        assert all(P.walk(P.walk(x, size, "t"), size, "t", back=True) == x for x in range(size))


VALUES = {
    "card": "4539 1488 0343 6467", "ssn": "536-22-8726", "phone": "+1 (487) 555-7209", "ipv4": "97.51.17.173", "date": "1987-03-05",
    "email": "Jane.Doe99@mail9.example.com", "iban": "DE89 3704 0044 0532 0130 00",
}


@pytest.mark.parametrize("kind", VALUES)
def test_format_links_and_reverse(kind):
    text = f"See {VALUES[kind]}, and again {VALUES[kind]}."
    out, kinds = pseudonymise(P, text)
    assert kinds == [kind, kind] and VALUES[kind] not in out
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
    if kind != "ipv4":
        assert shape(out) == shape(text)
    one, two = re.fullmatch(r"See (.*), and again (.*)\.", out).groups()
    assert one == two
    assert pseudonymise(P, out, back=True)[0] == text
    assert pseudonymise(Permuter(b"other"), text)[0] != out


def test_validation():
    assert luhn("4539148803436467")
    for text in ("4539148803436468", "1234567890123456789012", "2023-02-30", "999.1.1.1", "000-12-3456", "token f3ef", "version 1.2.3", "page 12", "0.5", "123-555-1234", "DE88370400440532013000"):
        assert pseudonymise(P, f"x {text} y") == (f"x {text} y", []), text
    assert pseudonymise(P, "call (123) 555-1234")[1] == pseudonymise(P, "call +1 (017) 555-7713")[1] == ["phone"]
    one, two = (pseudonymise(P, t)[0][-8:] for t in ("+1 (123) 555-1234", "(123) 555-1234"))
    assert one == two
    out = pseudonymise(P, "card 4539148803436467 iban DE89370400440532013000 on 31.12.1999 or 12/31/1999 or 31/12/1999")[0].split()
    assert luhn(out[1]) and _iban_number(out[3]) % 97 == 1
    day = datetime.datetime.strptime(out[5], "%d.%m.%Y").date()
    assert day == datetime.datetime.strptime(out[7], "%m/%d/%Y").date()
    hexed = 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and sha f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda'
    out, kinds = pseudonymise(P, hexed)
    assert kinds == ["secret"] and out.endswith("sha f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda")


def test_dates_come_back():
    rng = random.Random(5)
    for _ in range(300):
        d = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))
        for f in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y", "%m.%d.%Y"):
            text = f"on {d.strftime(f)}"
            assert pseudonymise(P, pseudonymise(P, text)[0], back=True)[0] == text


def test_tables(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "clean text é\x00", 0), (4, "a@b.example " * 20_000, 20_000), (5, VALUES["ssn"], 1), (5, VALUES["ssn"], 1), (None, "1" * 100_000 + "@" * 9, 0)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, kinds string")
    got = mask(df, b"k").collect()
    assert sorted((repr(r.doc_id), r.n_found) for r in got) == sorted((repr(i), n) for i, _, n in rows)
    assert {r.doc_id: r.text for r in got}[3] == "clean text é\x00" and {r.doc_id: r.text for r in got}[1] is None
    back = restore(mask(df, b"k").select("doc_id", "text"), b"k").collect()
    assert {r.doc_id: r.text for r in back} == {i: t for i, t, _ in rows}
    assert mask(df.limit(0), b"k").count() == 0


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    masked = mask(docs, b"k")
    assert masked.filter("n_found > 0").count() > 10
    want = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in restore(masked.select("doc_id", "text"), b"k").collect()} == want
    clean = {r.doc_id: r.text for r in masked.filter("n_found = 0").collect()}
    assert all(want[i] == t for i, t in clean.items())


CARD, IBAN, AT_IBAN = "4111 1111 1111 1111", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201"


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (f"{CARD} 12/27", [CARD]), (f"{CARD} 123", [CARD]), (f"{IBAN} EUR", [IBAN]), ("BE68539007547034 BIC", ["BE68539007547034"]), (f"{AT_IBAN} BIC", [AT_IBAN]),
        (f"{CARD} 2024-05-06", [CARD, "2024-05-06"]), (f"{CARD} 536-22-8726", [CARD, "536-22-8726"]), ("+49 30 12 34 56 78", ["+49 30 12 34 56 78"]),
        ("token=" + "a1b2" * 8, ["a1b2" * 8]), ("token=" + "abcdefab" * 4, ["abcdefab" * 4]),
    ],
)
def test_neighbours_do_not_hide_values(text, values):
    """A value is found whatever group follows it, and whatever the prefilter looks for."""
    out, kinds = pseudonymise(P, f"{text}")
    assert len(kinds) == len(values) and not any(v in out for v in values), out
    assert pseudonymise(P, out, back=True)[0] == text


def test_values_before_other_groups_come_back():
    rng = random.Random(9)
    for _ in range(400):
        body = "".join(rng.choice(string.digits) for _ in range(15))
        card = re.sub(r"(\d{4})(?=\d)", r"\1 ", body + luhn_digit(body))
        text = f"{card} {rng.randrange(1000):03d} {rng.choice(('', '12/27', '+49 30 12 34 56 78 90 12 34'))}"
        out, kinds = pseudonymise(P, text)
        assert kinds and card not in out
        assert pseudonymise(P, out, back=True) == (text, kinds)

"""Feistel pseudonyms: permutations, formats, validation, links, round trips, odd inputs."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import pii
from lodestone.llm.pii import Feistel, Pseudonyms, luhn_digit

KEY = b"test key"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4099])
def test_is_a_permutation(n):
    f = Feistel(KEY, "d", n)
    image = [f.apply(i) for i in range(n)]
    assert sorted(image) == list(range(n))
    assert [f.undo(x) for x in image] == list(range(n))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60), st.integers(0, 10**15 - 1), st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)), st.ip_addresses(v=4))
def test_round_trip(noise, number, day, ip):
    card = f"{number:015d}" + luhn_digit(f"{number:015d}")
    text = f"{noise} {card} am {day:%d.%m.%Y} on {day:%Y-%m-%d} or {day:%m/%d/%Y} at {ip} by jo.Doe7@mail.example.com {noise}"
    there, spans = Pseudonyms(KEY).rewrite(text)
    assert Pseudonyms(KEY, undo=True).rewrite(there)[0] == text
    assert len(there) == len(text) or spans  # only addresses change their length
    assert f" {card} " not in there or len(set(card)) == 1


def test_formats_and_validation():
    p = Pseudonyms(KEY)
    card = "1219538112535" + "71"
    card += luhn_digit(card)
    bad = card[:-1] + str((int(card[-1]) + 1) % 10)
    text = f"a {card}. b {bad}, c +1 (476) 555-6291### d 31.02.2020 e 256.1.1.1 f 078-05-1120 g GB29 NWBK 6016 1331 9268 19 THE h {card}"
    out, spans = p.rewrite(text)
    assert [k for k, _, _ in spans] == ["card", "phone", "ssn", "iban", "card"]
    assert bad in out and "31.02.2020" in out and "256.1.1.1" in out and card not in out and "555-6291" not in out
    first, last = out.split()[1].rstrip("."), out.split()[-1]
    assert first == last and luhn_digit(first[:-1]) == first[-1]
    assert text[spans[1][1] : spans[1][2]] == "+1 (476) 555-6291"


PHONES = ["+49 30 12345678", "+33.6.12.34.56.78", "+493012345678", "+33 6 12 34 56 78", "+34 612 345 678", "+1 555 123 4567", "+1-555-123-4567", "555 123 4567", "+49 (0)30 1234567", "+49 (30) 1234-5678", "+44 20 7946 0958", "+15551234567", "06 12 34 56 78", "030 12345678", "(030) 1234567", "0171/1234567", "0171 123 4567", "030 123 4567", "+9 (999) 999-9999"]
DATES = ["3.5.2024", "1/2/2024", "13.5.2024", "3.12.2024", "03.5.2024", "3.05.2024", "2/28/2024", "2024-5-6", "2024/5/16", "03-05-2024", "2024-05-06", "06.05.2024"]


@pytest.mark.parametrize("kind, value", [*(("phone", v) for v in PHONES), *(("date", v) for v in DATES)])
@pytest.mark.parametrize("around", ["{}", "call {}, now", "({})", "{}. So", "am {} 7 x"])
def test_every_form_moves_and_comes_back(kind, value, around):
    for key in (KEY, b"a", b"b", b"c"):
        text = around.format(value)
        out, spans = Pseudonyms(key).rewrite(text)
        at = text.index(value)
        if around.startswith("am") and value[0] == "+":  # a group after a blank may belong to the number
            assert [(k, s) for k, s, _ in spans] == [(kind, at)]
        else:
            assert spans == [(kind, at, at + len(value))]
        assert out != text and len(out) == len(text) and Pseudonyms(key, undo=True).rewrite(out)[0] == text


def test_timestamps_and_linked_phones():
    p = Pseudonyms(KEY)
    out, spans = p.rewrite("at 2024-05-06T10:00:00Z and 2024-05-06")
    assert spans == [("date", 3, 13), ("date", 28, 38)] and out[13:23] == "T10:00:00Z" and out[3:13] == out[-10:] != "2024-05-06"
    a, b, c = (p.rewrite(x)[0] for x in ("+33 6 12 34 56 78", "+33612345678", "06 12 34 56 78"))
    assert a.replace(" ", "") == b and c.replace(" ", "")[1:] == b[3:]


@pytest.mark.parametrize("text", ["9 +73.4.2.62)879", "+1.555.123.4567", "+49 30 12345678 3.5.2024"])
def test_neighbours_of_a_plus_come_back(text):
    assert Pseudonyms(KEY, undo=True).rewrite(Pseudonyms(KEY).rewrite(text)[0])[0] == text != Pseudonyms(KEY).rewrite(text)[0]


def test_round_trip_of_every_unpadded_day():
    day, there, back = datetime.date(2023, 12, 25), Pseudonyms(KEY), Pseudonyms(KEY, undo=True)
    for i in range(400):
        d = day + datetime.timedelta(i)
        for text in (f"{d.day}.{d.month}.{d.year}", f"{d.month}/{d.day}/{d.year}", f"{d.year}-{d.month}-{d.day}", f"{d.day:02}/{d.month}/{d.year}"):
            out = there.rewrite(text)[0]
            assert back.rewrite(out)[0] == text


def test_equal_numbers_stay_linked_across_formats():
    p = Pseudonyms(KEY)
    a, b = (p.rewrite(x)[0] for x in ("4111 1111 1111 1111", "4111-1111-1111-1111"))
    assert a.replace(" ", "") == b.replace("-", "") != "4111111111111111"
    a, b = (p.rewrite(x)[0] for x in ("Jo.Doe@x.example.com", "jo.doe@x.example.com"))
    assert a.lower() == b and a != b


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail me: a.b12@mail.example.com", "y"), (3, "mail me: a.b12@mail.example.com", "y"), (None, "no data " * 20000 + "10.0.0.1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, findings string")
    got = pii.pseudonymise(df, KEY).collect()
    assert [len(r["findings"]) for r in got] == [0, 0, 1, 1, 1]
    assert got[0]["text"] is None and got[1]["text"] == ""
    assert got[2] == got[3] and "a.b12@" not in got[2]["text"] and not got[4]["text"].endswith("10.0.0.1")
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


@pytest.mark.parametrize("n", [128, 129, 218, 219, 300, 1000, 20_000])
def test_local_parts_of_any_length(n):
    local = ("aB3.x-" * n)[:n]
    for text in (f"to {local}@mail.example.com, now", f"{'z' * n}@mail.example.com"):
        out, spans = Pseudonyms(KEY).rewrite(text)
        assert [k for k, _, _ in spans] == ["email"] and out != text and len(out) == len(text)
        assert Pseudonyms(KEY, undo=True).rewrite(out)[0] == text
    a, b, c = (Pseudonyms(KEY).rewrite(f"{x}@mail.example.com")[0] for x in (local, "c" + local[1:], local.swapcase()))
    assert a != b and a.lower() == c.lower()


def test_wide_domains_are_permuted():
    n = 26**400
    f = Feistel(KEY, "wide", n)
    for x in (0, 1, n // 2, n - 1):
        assert 0 <= (y := f.apply(x)) < n and f.undo(y) == x != y


def test_all_bytes_of_a_key_count():
    a, b = (Pseudonyms(b"k" * 64 + x).rewrite("4111 1111 1111 1111")[0] for x in (b"1", b"2"))
    assert a != b


def test_memos_hold_no_long_values():
    p = Pseudonyms(KEY)
    p.rewrite("x" * 500 + "@mail.example.com and jo@mail.example.com")
    assert list(p.memo) == [("email", "jo@mail.example.com")] and all(len(d) <= 512 for d, _ in p.networks)


def test_dates_outside_of_the_range_stay():
    text = "1899-12-31 and 2100-01-01 and 31.12.1899"
    assert Pseudonyms(KEY).rewrite(text) == (text, [])

"""Cards among other numbers, dates of one digit, country codes without a separator, valid social security numbers."""

import random
import re

from test_pii import luhn, run

from veilspark.llm import queries

DATA = "/root/testdata/sf0.01"
CARD = "4111 1111 1111 1111"


def only(spark, texts):
    return [(r[3], r[4]) for r in run(spark, texts)]


def plain_cards(run_of_digits):
    """The cards of a run of digit groups, by going from group to group."""
    groups = re.findall("[0-9]+", run_of_digits)
    out, i = [], 0
    while i < len(groups):
        lengths = [len(g) for g in groups[i : i + 4]]
        n = 0
        if 13 <= lengths[0] <= 19 and luhn(groups[i]):
            n = 1
        elif len(lengths) == 4 and lengths[:3] == [4, 4, 4] and lengths[3] <= 7 and luhn("".join(groups[i : i + 4])):
            n = 4
        elif lengths[:2] == [4, 6] and lengths[2:] and lengths[2] in (4, 5) and luhn("".join(groups[i : i + 3])):
            n = 3
        if n:
            out.append((i, n))
        i += max(n, 1)
    total = "".join(groups)
    if not out and 13 <= len(total) <= 19 and luhn(total):
        out.append((0, len(groups)))
    return out


def test_cards_beside_numbers(spark):
    (alone, _), = only(spark, [CARD])
    around = ["ref 12 {}", "{} 12", "1-{}", "7 {} 8", "no. 2024-{}", "{} {}", "a {}, 123-45-6789", "{}-5"]
    for form, (new, n) in zip(around, only(spark, [f.replace("{}", CARD) for f in around]), strict=True):
        assert alone in new, form
        if form.count("{}") > 1:
            assert (new, n) == (form.replace("{}", alone), 2)
        elif "-45-" not in form:
            assert (new, n) == (form.replace("{}", alone), 1)
    assert luhn(re.sub(r"\D", "", alone))


def test_other_kinds_in_a_run(spark):
    phone, card = only(spark, ["415-555-0123", CARD])
    got = only(spark, [f"1234 415-555-0123 {CARD}", f"{CARD} 415-555-0123", "12345 4111 1111 1111 1112"])
    assert got[0] == (f"1234 {phone[0]} {card[0]}", 2) and got[1] == (f"{card[0]} {phone[0]}", 2)
    assert got[2] == ("12345 4111 1111 1111 1112", 0)
    (mail, n), = only(spark, ["1234 5678 9012 77@x.org"])
    assert n == 1 and mail.startswith("1234 5678 9012 ") and mail.endswith("@x.org") and " 77@" not in mail


def test_runs_as_a_plain_scan(spark):
    r = random.Random(5)
    texts = []
    for _ in range(300):
        groups = ["".join(r.choice("0123456789") for _ in range(r.choice((1, 2, 4, 4, 4, 4, 5, 6, 13, 16)))) for _ in range(r.randrange(3, 14))]
        texts.append(groups[0] + "".join(r.choice(" -") + g for g in groups[1:]))
    # no other kind, and long enough to be a run
    other = r"(?<![0-9-])[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,4}|[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}"
    texts = [t for t in texts if len(re.sub(r"\D", "", t)) >= 13 and not re.search(other, t)]
    assert len(texts) > 100 and sum(bool(plain_cards(t)) for t in texts) > 20
    for text, (new, n) in zip(texts, only(spark, texts), strict=True):
        old, now = re.findall("[0-9]+", text), re.findall("[0-9]+", new)
        cards = plain_cards(text)
        assert n == len(cards) and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", text)
        within = {i for a, m in cards for i in range(a, a + m)}
        assert all(old[i] == now[i] for i in range(len(old)) if i not in within), text
        assert all(luhn("".join(now[a : a + m])) and old[a][0] == now[a][0] for a, m in cards)


def test_country_codes(spark):
    forms = ["+14155550123", "+1 415 555 0123", "+1-415-555-0123", "+1 (415) 555 0123"]
    new = [x for x, n in only(spark, forms) if n == 1]
    assert len({re.sub(r"\D", "", x) for x in new}) == 1 and len(new) == 4 and all(x.startswith("+1") for x in new)
    (national, _), = only(spark, ["(415) 555-0123"])
    assert re.sub(r"\D", "", new[0]) == "1" + re.sub(r"\D", "", national)
    for a, b, code in (("+442079460958", "+44 20 7946 0958", "44"), ("+493012345678", "+49 30 1234 5678", "49"), ("+35315550123", "+353 1555 0123", "353")):
        (x, _), (y, _) = only(spark, [a, b])
        assert re.sub(r"\D", "", x) == re.sub(r"\D", "", y) != re.sub(r"\D", "", a) and x.startswith("+" + code)
        assert [t for t, _ in [(r[3], 0) for r in run(spark, [x, y], back=True)]] == [a, b]


def test_dates_of_one_digit(spark):
    texts = ["1/2/1980", "01/02/1980", "1980-1-2", "1980-01-02", "2.1.1980", "13/1/1980", "1/13/1980", "31/2/1980", "0/1/1980"]
    got = only(spark, texts)
    assert [n for _, n in got] == [1, 1, 1, 1, 1, 1, 1, 0, 0]

    def day(t, order):
        parts = dict(zip(order, map(int, re.findall("[0-9]+", t)), strict=True))
        return parts["y"], parts["m"], parts["d"]

    assert len({day(t, o) for (t, _), o in zip(got, ("mdy", "mdy", "ymd", "ymd", "dmy"))}) == 1
    assert day(got[5][0], "dmy") == day(got[6][0], "mdy") or int(got[5][0].split("/")[0]) <= 12
    for i in (0, 2, 4, 5, 6):
        assert not re.search("(?<![0-9])0", got[i][0])
    back = [r[3] for r in run(spark, [t for t, _ in got[:5]], back=True)]
    assert [re.sub("(?<![0-9])0", "", t) for t in back] == [re.sub("(?<![0-9])0", "", t) for t in texts[:5]]


def test_valid_social_security_numbers(spark):
    bad = ["000-12-3456", "666-12-3456", "123-00-4567", "123-45-0000"]
    assert only(spark, bad) == [(t, 0) for t in bad]
    texts = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899, 900, 999) for g in (1, 50, 99) for s in (1, 5000, 9999)]
    got = [t for t, _ in only(spark, texts)]
    assert len(set(got)) == len(texts)
    assert all(re.fullmatch(r"(?!000|666)\d{3}-(?!00)\d\d-(?!0000)\d{4}", t) for t in got)
    assert [r[3] for r in run(spark, got, back=True)] == texts


def test_long_runs_and_clashing_names(spark):
    long = " ".join(["1234"] * 40_000) + " x " + " ".join(["0000"] * 40_000)
    (new, n), = only(spark, [long])
    assert len(new) == len(long) and n >= 10_000
    df = spark.createDataFrame([(1, "10.9.8.7", 3, "z")], "doc_id long, text string, _pii int, pseudonymised string")
    from veilspark.llm.pii import pseudonymise

    row = pseudonymise(df, "k").first()
    assert row._pii == 3 and row.pseudonymised not in ("z", "10.9.8.7") and row.pseudonymised_count == 1


def test_query_leaves_no_planted_value(spark):
    """Values found with expressions of this test, in the given table."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = 0
    for r in queries.op10_pseudonyms(spark, DATA).collect():
        old = texts[r.doc_id]
        values = re.findall(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}", old, re.A)
        values += re.findall(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", old)
        values += re.findall(r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}", old)
        values += re.findall(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])", old)
        values += [v for v in re.findall(r"(?<![\d -])\d{4} \d{4} \d{4} \d{4}(?![\d -])", old) if luhn(v.replace(" ", ""))]
        for v in values:
            # a short local part may be its own pseudonym
            assert v not in (r.text or "") or len(v.split("@")[0]) < 4, (r.doc_id, v)
            found += 1
    assert found > 20

"""Format-preserving pseudonyms for personal data, in Spark expressions only.

Card numbers, telephone numbers, social security numbers, IPv4 addresses and dates are found
by pattern, validated, and permuted within the set of valid values of their format by a
keyed Feistel network: a value is split into two coordinates, and in every round one of them
is shifted by a keyed hash of the other, modulo its range.  The result is a bijection, so
equal values keep equal pseudonyms in all documents and different ones stay different.
Mail addresses are treated alike: the halves of the local part shift each other's letters
and digits within their alphabet; the domain stays.

=========  =======================================  =====================================
kind       validated                                kept
=========  =======================================  =====================================
card       13 to 19 digits, check digit (Luhn)      length, separators, first digit, a
                                                    right check digit
phone      country code or area code form           country code, separators, whether the
                                                    area code is below 200
ssn        3-2-4 digits; area not 000 or 666, no    separators, validity
           other part all zeros
ipv4       four numbers up to 255                   dotted form
date       a day of 1901 to 2096; year first, or    order and separators, a valid day
           month first, or else day first
mail       local part, domain                       classes of characters, domain
=========  =======================================  =====================================

What does not pass validation stays as it is.  Values are normalised to their digits first,
so ``4111 1111...`` and ``41111111...`` stay linked, as do ``+14155550123``,
``+1 415 555 0123`` and ``(415) 555-0123``, and ``1/2/1980`` and ``01/02/1980``.  A date with a
one-digit day or month is written without leading zeros.

A card may stand among other numbers, by one blank or hyphen: of a run of digit groups, those
windows are looked at that have a card's grouping (4-4-4 and one to seven digits, 4-6-4, 4-6-5,
or one group), from the left; a window without a right check digit is passed over by one
group.  If there is none, the run as a whole may be a card.  What the cards leave of the run
is searched for the other kinds.

Not looked for: telephone numbers without code and separators, or with a trunk prefix instead of
the country code as the same number; years of two digits, months by name; IBAN; IPv6.  Local
parts of mail addresses that differ in case are different values.  ``back`` gives the value,
but not the zeros in front of a day or month where both forms meet, and may take another window
where the pseudonym's neighbours happen to make up a card with it.

Defined cases: a null text stays null, with no replacement counted; empty texts stay empty;
texts of any length are scanned in linear time; repeated rows are treated alike; an empty
table gives no rows; other columns are kept, but those called like ``out`` and ``out_count`` are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

ROUNDS = 8

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# a domain ends with its last label of two letters or more; labels that begin otherwise may lie between
MAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
    r"(?:(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2,}+(?:[A-Za-z0-9-]++(?=\.))?+)++"
)
IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
DATE = (
    r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"
    r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})"
    r"(?![0-9/-]|\.[0-9])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
)
# groups of digits by one blank or hyphen, 13 digits or more: where cards are
RUN = r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?:[ -][0-9]++(?!@))*+"
NUMBERS = "|".join((DATE, SSN, IPV4, PHONE))
ANY = "|".join((MAIL, NUMBERS, RUN))
# The country codes of one and two digits; all others have three.
COUNTRY = (
    r"^\+(?:[17]|2[^0-9]*[07]|3[^0-9]*[0-469]|4[^0-9]*[013-9]|5[^0-9]*[1-8]|6[^0-9]*[0-6]"
    r"|8[^0-9]*[1246]|9[^0-9]*[0-58]|[0-9](?:[^0-9]*[0-9]){2})"
)
# of a run whose groups are marked: S a card, C and D the first of a card's four or three groups
MARKED = r"S[0-9]++|C[0-9]++(?:[ -][A-Z][0-9]++){3}|D[0-9]++(?:[ -][A-Z][0-9]++){2}"
# every match has an at sign or two digits around at most one other character
GATE = r"@|[0-9][^0-9]?[0-9]"

FIRST_DAY, BLOCKS, BLOCK_DAYS = "1901-01-01", 49, 1461  # four years each


def keyed(key: str, tweak: Column, i: int, value: Column) -> Column:
    """60 bits of a keyed hash, as a long."""
    text = F.concat_ws("|", F.lit(key), tweak, F.lit(i), value.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permute(key: str, tweak: Column, a: Column, b: Column, size_a: Column, size_b: Column, back: bool = False):
    """A keyed permutation of the pairs (a, b) with a < size_a and b < size_b, as a struct."""
    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    sign = -1 if back else 1

    def one(i: int, s: Column) -> Column:
        if i % 2:
            shift = F.pmod(keyed(key, tweak, i, s["a"]), size_b)
            return F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * shift, size_b).alias("b"))
        shift = F.pmod(keyed(key, tweak, i, s["b"]), size_a)
        return F.struct(F.pmod(s["a"] + sign * shift, size_a).alias("a"), s["b"].alias("b"))

    return _rounds(state, one, ROUNDS, back)


def _rounds(state: Column, one: Callable[[int, Column], Column], n: int, back: bool) -> Column:
    for i in reversed(range(n)) if back else range(n):
        state = let(state, (lambda k: lambda s: one(k, s))(i))
    return state


def _ten(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n + 1)


def permute_digits(key: str, tweak: Column, digits: Column, back: bool = False) -> Column:
    """A string of 2 to 36 digits as another of the same length."""
    n = F.length(digits)
    left = F.shiftright(n, 1)
    a = F.substring(digits, F.lit(1), left).cast("long")
    b = F.substring(digits, left + 1, n - left).cast("long")
    done = permute(key, F.concat_ws(":", tweak, n), a, b, _ten(left), _ten(n - left), back)
    return let(
        done,
        lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), n - left, "0")),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right; those at odd (1) or even (0) places are doubled."""
    each = F.transform(
        F.split(F.reverse(digits), "(?<=.)(?=.)"),
        lambda c, i: F.when(i % 2 != doubled, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))
        ),
    )
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def _into(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in turn by ``digits``."""
    chars = F.split(form, "(?<=.)(?=.)")
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                c.rlike("[0-9]"),
                F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i + 1))), F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )


def _card(key: str, value: Column, back: bool) -> Column:
    def put(d: Column) -> Column:
        n = F.length(d)
        inner = permute_digits(key, F.lit("card"), F.substring(d, F.lit(2), n - 2), back)
        head = F.concat(F.substring(d, 1, 1), inner)
        return let(
            head,
            lambda h: F.concat(h, F.pmod(-_luhn_sum(h, 0), F.lit(10)).cast("string")),
        )

    def checked(d: Column) -> Column:
        return F.when(luhn_valid(d), _into(value, put(d))).otherwise(value)

    return let(_digits(value), checked)


def _phone(key: str, value: Column, back: bool) -> Column:
    code = F.regexp_extract(value, COUNTRY, 0)

    def of(rest: Column) -> Column:
        d = _digits(rest)

        def ten(x: Column) -> Column:
            area = F.substring(x, 1, 3).cast("long")
            low = F.when(area < 200, F.lit(0)).otherwise(F.lit(200))
            size = F.when(area < 200, F.lit(200)).otherwise(F.lit(800))
            done = permute(
                key, F.lit("phone"), area - low, F.substring(x, 4, 7).cast("long"), size, F.lit(10**7), back
            )
            return let(
                done,
                lambda p: F.concat(
                    F.lpad((p["a"] + low).cast("string"), 3, "0"), F.lpad(p["b"].cast("string"), 7, "0")
                ),
            )

        new = let(d, lambda x: F.when(F.length(x) == 10, ten(x)).otherwise(permute_digits(key, F.lit("phone"), x, back)))
        return let(new, lambda x: F.concat(code, _into(rest, x)))

    return let(F.substring(value, F.length(code) + 1, F.length(value)), of)


def _ssn(key: str, value: Column, back: bool) -> Column:
    def of(d: Column) -> Column:
        area, group, serial = (F.substring(d, *at).cast("long") for at in ((1, 3), (4, 2), (6, 4)))
        place = F.when(area < 666, area - 1).otherwise(area - 2)
        size = F.lit(998), F.lit(99 * 9999)
        done = permute(key, F.lit("ssn"), place, (group - 1) * 9999 + serial - 1, *size, back)

        def shown(p: Column) -> Column:
            parts = (
                (F.when(p["a"] < 665, p["a"] + 1).otherwise(p["a"] + 2), 3),
                (F.floor(p["b"] / 9999) + 1, 2),
                (p["b"] % 9999 + 1, 4),
            )
            return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

        valid = (area > 0) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(valid, let(done, shown)).otherwise(value)

    return let(_digits(value), of)


def _ipv4(key: str, value: Column, back: bool) -> Column:
    def of(p: Column) -> Column:
        o = [p[i].cast("long") for i in range(4)]
        size = F.lit(65536)
        done = permute(key, F.lit("ipv4"), o[0] * 256 + o[1], o[2] * 256 + o[3], size, size, back)
        return let(
            done,
            lambda s: F.concat_ws(
                ".",
                *[x.cast("string") for h in (s["a"], s["b"]) for x in (F.shiftright(h, 8), h.bitwiseAND(255))],
            ),
        )

    return let(F.split(value, r"\."), of)


def _date(key: str, value: Column, back: bool) -> Column:
    sep = F.regexp_extract(value, "[^0-9]", 0)

    def of(p: Column) -> Column:
        def day(y: int, m: int, d: int) -> Column:
            text = F.concat_ws("-", p[y], F.lpad(p[m], 2, "0"), F.lpad(p[d], 2, "0"))
            return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")

        year_first = F.length(p[0]) == 4
        short = F.exists(p, lambda x: F.length(x) == 1)
        month_first = ~year_first & (sep != ".") & day(2, 0, 1).isNotNull()
        parsed = F.when(year_first, day(0, 1, 2)).otherwise(
            F.when(month_first, day(2, 0, 1)).otherwise(day(2, 1, 0))
        )

        def shown(number: Column) -> Column:
            moved = permute(
                key, F.lit("date"),
                F.floor(number / BLOCK_DAYS), number % BLOCK_DAYS,
                F.lit(BLOCKS), F.lit(BLOCK_DAYS), back,
            )
            new = let(
                moved,
                lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * BLOCK_DAYS + s["b"]).cast("int")),
            )

            def parts(x: Column, *f: str) -> Column:
                a, b, c = (F.date_format(x, k) for k in f)
                return F.concat(a, sep, b, sep, c)

            padded = let(
                new,
                lambda x: F.when(year_first, parts(x, "yyyy", "MM", "dd"))
                .when(month_first, parts(x, "MM", "dd", "yyyy"))
                .otherwise(parts(x, "dd", "MM", "yyyy")),
            )
            return let(padded, lambda x: F.when(short, F.regexp_replace(x, "(?<![0-9])0", "")).otherwise(x))

        number = F.datediff(parsed, F.lit(FIRST_DAY).cast("date"))
        return let(
            number,
            lambda k: F.when((k >= 0) & (k < BLOCKS * BLOCK_DAYS), shown(k)).otherwise(value),
        )

    return let(F.split(value, r"[^0-9]"), of)


def _mail(key: str, value: Column, back: bool) -> Column:
    local = F.substring_index(value, "@", 1)
    rest = F.substring(value, F.length(local) + 1, F.length(value))
    alphabets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def shifted(text: Column, other: Column, i: int) -> Column:
        sign = -1 if back else 1

        def one(c: Column, at: Column) -> Column:
            step = keyed(key, F.concat_ws(":", F.lit("mail"), F.length(text), at), i, other)
            out = F.when(F.lit(False), c)
            for alphabet in alphabets:
                n = len(alphabet)
                place = F.instr(F.lit(alphabet), c)
                out = out.when(
                    place > 0, F.substring(F.lit(alphabet), F.pmod(place - 1 + sign * F.pmod(step, F.lit(n)), F.lit(n)).cast("int") + 1, F.lit(1))
                )
            return out.otherwise(c)

        chars = F.filter(F.split(text, "(?<=.)(?=.)"), lambda c: c != "")
        return F.array_join(F.transform(chars, one), "")

    left = F.shiftright(F.length(local) + 1, 1)
    state = F.struct(
        F.substring(local, F.lit(1), left).alias("a"),
        F.substring(local, left + 1, F.length(local)).alias("b"),
    )

    def half(i: int, s: Column) -> Column:
        if i % 2:
            return F.struct(s["a"].alias("a"), shifted(s["b"], s["a"], i).alias("b"))
        return F.struct(shifted(s["a"], s["b"], i).alias("a"), s["b"].alias("b"))

    return let(_rounds(state, half, 4, back), lambda s: F.concat(s["a"], s["b"], rest))


def _pieces(text: Column, pattern: str) -> Column:
    """The text as gaps, each with the match behind it; the last has none."""
    return F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")),
    )


def _piece(gap: Column, value: Column) -> Column:
    return F.array(F.struct(gap.alias("gap"), value.alias("value")))


def _cards(run: Column) -> Column:
    """A run of digit groups as pieces whose values are valid cards."""
    nothing = F.lit(None).cast("string")

    def marked(groups: Column) -> Column:
        def mark(group: Column, i: Column) -> Column:
            part = [_digits(group), *[_digits(F.get(groups, i + k)) for k in (1, 2, 3)]]
            long = [F.coalesce(F.length(x), F.lit(0)) for x in part]
            four = (long[0] == 4) & (long[1] == 4) & (long[2] == 4) & long[3].between(1, 7)
            three = (long[0] == 4) & (long[1] == 6) & long[2].between(4, 5)
            return F.concat(
                F.when(long[0].between(13, 19) & luhn_valid(part[0]), "S")
                .when(four & luhn_valid(F.concat(*part)), "C")
                .when(three & luhn_valid(F.concat(*part[:3])), "D")
                .otherwise("X"),
                group,
            )

        return F.array_join(F.transform(groups, mark), "")

    def bare(text: Column) -> Column:
        return F.regexp_replace(text, "[A-Z]", "")

    def whole(digits: Column) -> Column:
        card = F.when(F.length(digits) <= 19, luhn_valid(digits))
        return F.when(card, F.concat(_piece(F.lit(""), run), _piece(F.lit(""), nothing))).otherwise(_piece(run, nothing))

    return let(
        let(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0)), marked),
        lambda text: F.when(
            text.rlike(MARKED),
            F.transform(
                _pieces(text, MARKED), lambda p: F.struct(bare(p["gap"]).alias("gap"), bare(p["value"]).alias("value"))
            ),
        ).otherwise(let(_digits(run), whole)),
    )


def find_values(text: Column) -> Column:
    """The text as gaps, each with the value behind it that ``pseudonym`` takes; the last has none."""
    nothing = F.lit(None).cast("string")

    def between(p: Column) -> Column:
        return F.concat(_pieces(p["gap"], NUMBERS), _piece(F.lit(""), p["value"]))

    def opened(p: Column) -> Column:
        return F.concat(_piece(p["gap"], nothing), F.flatten(F.transform(_cards(p["value"]), between)))

    run = rf"\A(?:{RUN})\z"
    return F.flatten(
        F.transform(
            _pieces(text, ANY), lambda p: F.when(p["value"].rlike(run), opened(p)).otherwise(_piece(p["gap"], p["value"]))
        )
    )


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one value of ``find_values``, or with ``back`` the value of a pseudonym."""
    whole = lambda pattern: value.rlike(rf"\A(?:{pattern})\z")
    return (
        F.when(F.contains(value, F.lit("@")), _mail(key, value, back))
        .when(whole(DATE), _date(key, value, back))
        .when(whole(SSN), _ssn(key, value, back))
        .when(whole(IPV4), _ipv4(key, value, back))
        .when(whole(PHONE), _phone(key, value, back))
        .otherwise(_card(key, value, back))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "pseudonymised", back: bool = False) -> DataFrame:
    """All columns, ``out`` with the text under pseudonyms, ``out_count`` with how many changed.

    ``key`` is the secret of the permutations; ``back`` undoes them.
    """
    body = F.col(text).cast("string")

    def replaced(pieces: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(p["new"], F.lit("")))), "").alias("text"),
            F.size(F.filter(pieces, lambda p: p["value"] != p["new"])).alias("n"),
        )

    renamed = F.transform(
        find_values(body),
        lambda p: F.struct(
            p["gap"].alias("gap"), p["value"].alias("value"),
            F.when(p["value"].isNotNull(), pseudonym(p["value"], key, back)).alias("new"),
        ),
    )
    done = F.when(body.rlike(GATE) & body.rlike(ANY), let(renamed, replaced))
    held = "_pii"
    while held in docs.columns:
        held += "_"
    wide = docs.withColumn(held, done)
    return wide.withColumns({
        out: F.coalesce(F.col(f"{held}.text"), body),
        f"{out}_count": F.coalesce(F.col(f"{held}.n"), F.lit(0)).cast("long"),
    }).drop(held)

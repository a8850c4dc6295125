"""Personal data replaced by format-preserving pseudonyms, in built-in expressions only.

A value is found by pattern, validated (Luhn sum, octets, calendar, remainder 97, area
rules) and moved by a keyed Feistel network over its own format: halves of a string shift
each other letter by letter within digits, lower and upper case letters, and numbers that
must stay valid are permuted over the exact set of valid ones. So a pseudonym has the
format of its value, equal values get equal pseudonyms in all documents, different values
of a kind get different ones, and values that fail validation stay.

==========  ==========================================================================
email       local part and domain without its last label
phone       digits after the country code, layout kept
card        digits between the first and the check digit, which is computed anew
iban        account part; country kept, check digits computed anew
ssn         the set of valid numbers (area 1-899 without 666, group, serial not 0)
ip          the 32 bits of an IPv4 address
date        days of the 400-year block that starts in 1400 or 1800, layout kept
secret      access keys and quoted tokens, by letter classes
==========  ==========================================================================

Day and month: year last means day first where that is a date, else month first.

Defined results: null stays null; a text without matches stays as it is; a text of any
length is scanned whole, once for what every pattern needs one of (`HINT`) and, if it
has one, for all patterns together. The number of values replaced is 0 for null. Columns named like the results are
replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.naming import free

ROUNDS = 4

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\d)"
    r"|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"
)
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
DATE = r"(?<![\d./\-])(?:\d{4}([./\-])\d{1,2}\1\d{1,2}|\d{1,2}([./\-])\d{1,2}\2\d{4})(?![\d/]|[.\-]\d)"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
SECRET = (
    r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?:gh[oprsu]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,})"
    r"|(?<=(?i:password|passwd|token|secret|api[_\-]?key)[\"']?\s?[=:]\s?[\"']?)[A-Za-z0-9_+/.\-]{15,}[A-Za-z0-9_+/\-]=?=?"
    r"|(?<=(?i:bearer)\s)[A-Za-z0-9_+/.\-]{15,}[A-Za-z0-9_+/\-]=?=?"
)

#: A digit, `@` or the start of a secret: no pattern matches a text without.
HINT = r"[0-9@]|AKIA|gh[oprsu]_|sk-|(?i:password|passwd|token|secret|api[_\-]?key|bearer)"
ALL = "|".join((EMAIL, SECRET, SSN, CARD, PHONE, IBAN, IP, DATE))

#: Days of 400 years are 189 times 773.
ERA_DAYS, ERA_A, ERA_B = 146097, 189, 773


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 512)


def _shift(text: Column, digest: Column) -> Column:
    """Each digit and ASCII letter moved within its class by a byte of the digest."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, 1 + 2 * (i % 64), 2), 16, 10).cast("int")

        def inside(first: str, size: int) -> Column:
            return F.char(F.lit(ord(first)) + (F.ascii(c) - ord(first) + by) % size)

        return (
            F.when(c.between("0", "9"), inside("0", 10))
            .when(c.between("a", "z"), inside("a", 26))
            .when(c.between("A", "Z"), inside("A", 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), move), "")


def feistel_text(value: Column, key: str, kind: str) -> Column:
    """Permutation of the strings with the classes of `value`."""
    n = F.length(value)
    start = F.struct(F.substring(value, F.lit(1), (n / 2).cast("int")).alias("a"), F.substring(value, (n / 2).cast("int") + 1, n).alias("b"))
    turned = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, turn: F.struct(s.b.alias("a"), _shift(s.a, _digest(key, kind, turn, s.b)).alias("b")),
    )
    return F.concat(turned.a, turned.b)


def feistel_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Permutation of the numbers 0 to a * b - 1."""

    def turn_once(s: Column, turn: Column) -> Column:
        by = F.conv(F.substring(_digest(key, kind, turn, s.b), 1, 12), 16, 10).cast("long")
        size = F.when(turn % 2 == 1, F.lit(a)).otherwise(F.lit(b)).cast("long")
        return F.struct(s.b.alias("a"), ((s.a + by) % size).alias("b"))

    start = F.struct(F.floor(value / b).cast("long").alias("a"), (value % b).cast("long").alias("b"))
    turned = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn_once)
    return turned.a * b + turned.b


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _refill(layout: Column, letters: Column, letter: str) -> Column:
    """`layout` with its letters of class `letter` replaced by those of `letters`, in order."""
    return F.array_join(
        F.transform(
            F.split(layout, ""),
            lambda c, i: F.when(
                c.rlike(f"^[{letter}]$"),
                F.substring(letters, F.length(F.regexp_replace(F.substring(layout, F.lit(1), i + 1), f"[^{letter}]", "")), F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )


def luhn_sum(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(c == "", 0)
        .when(i % 2 == 1, F.ascii(c) * 2 - 96 - F.when(c >= "5", 9).otherwise(0))
        .otherwise(F.ascii(c) - 48),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _card(x: Column, key: str) -> Column:
    digits = F.regexp_replace(x, "[ -]", "")

    def moved(d: Column) -> Column:
        inner = F.concat(F.substring(d, 1, 1), feistel_text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _let(inner, lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))

    return _let(digits, lambda d: F.when(luhn_sum(d) % 10 == 0, _refill(x, moved(d), "0-9")).otherwise(x))


def _mod97(text: Column) -> Column:
    def add(s: Column, c: Column) -> Column:
        return (
            F.when(c == "", s)
            .when(c <= "9", (s * 10 + F.ascii(c) - 48) % 97)
            .otherwise((s * 100 + F.ascii(c) - 55) % 97)
        )

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(x: Column, key: str) -> Column:
    def moved(v: Column) -> Column:
        country = F.substring(v, 1, 2)

        def with_check(account: Column) -> Column:
            check = 98 - _mod97(F.concat(account, country, F.lit("00")))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)

        valid = _mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1
        account = feistel_text(F.substring(v, F.lit(5), F.length(v)), key, "iban")
        return F.when(valid, _refill(x, _let(account, with_check), "0-9A-Z")).otherwise(x)

    return _let(F.regexp_replace(x, " ", ""), moved)


def _phone(x: Column, key: str) -> Column:
    country = F.regexp_extract(x, r"^\+\d{1,3}(?=[ .\-(])|^\+\d", 0)
    rest = F.substring(x, F.length(country) + 1, F.length(x))
    digits = feistel_text(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")
    return F.concat(country, _refill(rest, digits, "0-9"))


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substring(x, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def written(n: Column) -> Column:
        place = F.floor(n / (99 * 9999)).cast("long")
        return F.format_string(
            "%03d-%02d-%04d", place + F.when(place >= 665, 2).otherwise(1), F.floor(n / 9999).cast("long") % 99 + 1, n % 9999 + 1
        )

    return F.when(valid, _let(feistel_number(index, 898, 99 * 9999, key, "ssn"), written)).otherwise(x)


def _ip(x: Column, key: str) -> Column:
    def moved(p: Column) -> Column:
        octet = [F.element_at(p, i).cast("long") for i in (1, 2, 3, 4)]
        valid = octet[0].between(0, 255) & octet[1].between(0, 255) & octet[2].between(0, 255) & octet[3].between(0, 255)
        number = feistel_number(((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3], 65536, 65536, key, "ip")
        written = _let(
            number,
            lambda n: F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)]),
        )
        return F.when(valid, written).otherwise(x)

    return _let(F.split(x, r"\."), moved)


def _date(x: Column, key: str) -> Column:
    """Day number within its 400-year block, permuted and written in the layout of `x`."""

    def moved(p: Column) -> Column:
        one, two, three = (F.element_at(p, i).cast("int") for i in (1, 2, 3))
        first = F.length(F.element_at(p, 1)) == 4
        year = F.when(first, one).otherwise(three)
        swapped = ~first & (two > 12)
        month = F.when(first | ~swapped, two).otherwise(one)
        day = F.when(first, three).when(swapped, two).otherwise(one)
        date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
        era = F.when(year >= 1800, F.to_date(F.lit("1800-01-01"))).otherwise(F.to_date(F.lit("1400-01-01")))
        index = feistel_number(F.date_diff(date, era).cast("long"), ERA_A, ERA_B, key, "date")

        def written(d: Column) -> Column:
            part = F.date_format
            parts = F.when(first, F.array(part(d, "yyyy"), part(d, "MM"), part(d, "dd"))).when(
                swapped, F.array(part(d, "MM"), part(d, "dd"), part(d, "yyyy"))
            ).otherwise(F.array(part(d, "dd"), part(d, "MM"), part(d, "yyyy")))
            return F.array_join(parts, "\x00")

        new = _let(F.date_add(era, index.cast("int")), written)
        mark = F.regexp_extract(x, r"[./\-]", 0)
        return F.when(date.isNotNull() & year.between(1400, 2199), F.replace(new, F.lit("\x00"), mark)).otherwise(x)

    return _let(F.split(x, r"[./\-]"), moved)


def _email(x: Column, key: str) -> Column:
    # Addresses that differ in case only are one.
    last = F.regexp_extract(x, r"\.[A-Za-z]+$", 0)
    return F.concat(feistel_text(F.lower(F.substring(x, F.lit(1), F.length(x) - F.length(last))), key, "email"), F.lower(last))


def _marked(x: Column, key: str) -> Column:
    """A secret that keeps the mark of its kind."""
    mark = F.regexp_extract(x, "^(gh[oprsu]_|sk-)", 0)
    return F.concat(mark, feistel_text(F.substring(x, F.length(mark) + 1, F.length(x)), key, "secret"))


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one matched value, or the value if it is not valid."""
    return (
        F.when(x.contains("@"), _email(x, key))
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(x, key))
        .when(x.rlike(r"^\d{4}[./\-]\d{1,2}[./\-]\d{1,2}$|^\d{1,2}[./\-]\d{1,2}[./\-]\d{4}$"), _date(x, key))
        .when(x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _ip(x, key))
        .when(x.rlike(r"^(\d{13,19}|\d{4}[ \-].{8,})$"), _card(x, key))
        .when(x.startswith("+") | x.rlike(r"^[(]?\d{3}[) .\-]"), _phone(x, key))
        .when(x.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), _iban(x, key))
        .when(x.startswith("AKIA"), F.concat(F.lit("AKIA"), feistel_text(F.substring(x, F.lit(5), F.length(x)), key, "secret")))
        .when(x.rlike("^(gh[oprsu]_|sk-)"), _marked(x, key))
        .otherwise(feistel_text(x, key, "secret"))
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", found: str = "n_replaced") -> DataFrame:
    """`df` with personal data in its text column replaced, and the number of values replaced."""
    t = F.col(text)

    def rebuilt(values: Column) -> Column:
        moved = F.transform(values, lambda x: pseudonym(x, key))
        return _let(
            moved,
            lambda new: F.struct(
                F.array_join(
                    F.zip_with(F.split(t, ALL, -1), new, lambda kept, x: F.concat(kept, F.coalesce(x, F.lit("")))), ""
                ).alias("text"),
                F.size(F.filter(F.arrays_zip(values.alias("old"), new.alias("new")), lambda p: p["old"] != p["new"])).cast("long").alias("n"),
            ),
        )

    made = F.when(t.rlike(HINT), _let(F.regexp_extract_all(t, F.lit(ALL), 0), rebuilt)).otherwise(
        F.struct(t.alias("text"), F.lit(0).cast("long").alias("n"))
    )
    (name,) = free(df, "_pii")
    return df.withColumn(name, made).withColumns({text: F.col(name)["text"], found: F.col(name)["n"]}).drop(name)

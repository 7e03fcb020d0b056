"""PII: keyed, format-preserving pseudonyms by Feistel networks, in DataFrame functions only.

Found and replaced: e-mail addresses, phone numbers, payment cards (Luhn), IBANs
(mod 97), social security numbers, IPv4 addresses, dates, and secrets (access keys,
and hexadecimal values behind ``password=`` and ``token =``). Numbers and dates are
replaced only when they validate; anything else that merely looks alike stays. A value
ends where another begins, so that values in a row are all found.

A value is permuted within its format: digits stay digits and letters stay letters
of their case at their places, a card gets a right check digit, an IBAN right check
digits, a date becomes a date of the same notation, an IPv4 address another. The
permutation depends on the key and the kind only, so equal values get equal
pseudonyms in all documents and different ones stay different.

* Strings: the characters are halved; in each of ``ROUNDS`` rounds one half is shifted,
  each character within its class (0-9, a-z, A-Z; a-f for hexadecimal), by a stream of
  SHA-512 over key, kind, round and the other half.
* Dates: the day's number within the 400 Gregorian years 1800-2199 (146,097 = 189 x 773
  days) goes through a Feistel network over Z189 x Z773.
* IPv4: a Feistel network over two 16-bit halves.
* Social security numbers: a Feistel network over the valid ones, Z898 x Z989901.

Each text is cut once by one pattern; the matches are rewritten and put back between
the pieces. No shuffle, no join, no Python; a text without a digit or ``@`` is passed on
at once.

Defined results: null stays null and empty stays empty, with 0 replacements; equal
matches are replaced alike. Extra columns are kept by :func:`pseudonymise`.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For tests and for the registered queries over synthetic tables, where ``spark.pii.key`` is not set.
DEMO_KEY = "change-me"
ROUNDS = 4

_IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z])"
_DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_CARD = "(?:[0-9]{13,19}|" + "|".join(f"[0-9]{{4}}{x}[0-9]{{4}}{x}[0-9]{{4}}{x}[0-9]{{4}}|[0-9]{{4}}{x}[0-9]{{6}}{x}[0-9]{{4,5}}" for x in " -") + ")(?![0-9A-Za-z])"
#: Where a value that has spaces ends: before another one.
_NEXT = rf"(?! (?:{_IPV4}|{_DATE}|{_SSN}))"
_NEXT_CARD = rf"(?! (?:{_IPV4}|{_DATE}|{_SSN}|{_CARD}))"

#: Java patterns of the kinds, tried in this order at each place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:password|passwd|pwd|secret|token|api_key)\s?[=:]\s?\"?[0-9A-Fa-f]{16,}",
    "access": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": rf"[A-Z]{{2}}[0-9]{{2}}(?:{_NEXT} ?[A-Z0-9]{{4}}){{2,7}}(?:{_NEXT} ?[A-Z0-9]{{1,3}})?(?![0-9A-Za-z])",
    "date": _DATE,
    "ssn": _SSN,
    "ipv4": _IPV4,
    "card": _CARD,
    "phone": rf"(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:{_NEXT}[ .-]?[0-9]{{2,4}}){{2}}(?:{_NEXT_CARD}[ .-]?[0-9]{{2,4}}){{0,2}}|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}})(?![0-9A-Za-z])",
}
#: What must not stand before a value; before a secret's word anything may.
BEFORE = {
    "email": r"(?<![A-Za-z0-9._%+-])", "secret": "", "date": r"(?<![A-Za-z0-9])(?<![0-9][-./])", "ssn": r"(?<![A-Za-z0-9])(?<![0-9]-)",
    "ipv4": r"(?<![A-Za-z0-9])(?<![0-9]\.)", "phone": r"(?<![A-Za-z0-9])(?<![0-9][.-])",
}
ANY = "(?:" + "|".join(BEFORE.get(k, r"(?<![A-Za-z0-9])") + p for k, p in PATTERNS.items()) + ")"
MAY_HAVE = r"[0-9@]"

DIGITS, LOW, HIGH = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DATE_FORMATS = {"yyyy-MM-dd": r"^[0-9]{4}-", "MM/dd/yyyy": r"/", "dd.MM.yyyy": r"^[0-9]{2}\."}
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def is_kind(kind: str, c: Column) -> Column:
    return c.rlike("^(?:" + PATTERNS[kind] + ")$")


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """Check digit of a string of digits: every other one from the right doubled, digits summed."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(payload), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return ((10 - total % 10) % 10).cast("string")


def luhn_valid(digits: Column) -> Column:
    return F.right(digits, F.lit(1)) == luhn_digit(F.left(digits, F.length(digits) - 1))


def mod97(code: Column) -> Column:
    """Remainder of the number that letters (A = 10 ... Z = 35) and digits spell."""
    digit = lambda c: (F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)).cast("int")
    return F.aggregate(F.filter(F.split(code, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97)


def _stream(key: str, kind: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), other), 512)


def _shift(c: Column, k: Column, hexadecimal: bool) -> Column:
    """Character ``c`` moved by ``k`` within its class; others stay."""
    out = c
    for letters in (HIGH[:6], LOW[:6]) if hexadecimal else (HIGH, LOW):
        at = F.instr(F.lit(letters), c)
        out = F.when(at > 0, F.substr(F.lit(letters), ((at - 1 + k) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
    at = F.instr(F.lit(DIGITS), c)
    return F.when(at > 0, F.substr(F.lit(DIGITS), ((at - 1 + k) % 10 + 1).cast("int"), F.lit(1))).otherwise(out)


def permute(s: Column, kind: str, key: str, hexadecimal: bool = False) -> Column:
    """Keyed permutation of all strings with the same character classes at the same places."""

    def moved(half: Column, stream: Column) -> Column:
        at = lambda i: F.substr(stream, (i * 5 % 120 + 1).cast("int"), F.lit(5))
        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), lambda c, i: _shift(c, F.conv(at(i), 16, 10).cast("long"), hexadecimal)), "")

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.left(s, half).alias("l"), F.substr(s, half + 1).alias("r"))
    rounds = F.array(*(F.lit(i) for i in range(ROUNDS)))
    step = lambda acc, i: F.struct(
        F.when(i % 2 == 0, moved(acc["l"], _stream(key, kind, i, acc["r"]))).otherwise(acc["l"]).alias("l"),
        F.when(i % 2 == 1, moved(acc["r"], _stream(key, kind, i, acc["l"]))).otherwise(acc["r"]).alias("r"),
    )
    return F.aggregate(rounds, start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def permute_pair(left: Column, right: Column, a: int, b: int, kind: str, key: str) -> Column:
    """Keyed permutation of Z_a x Z_b as struct(l, r)."""
    number = lambda i, x: F.conv(F.left(_stream(key, kind, i, x.cast("string")), F.lit(14)), 16, 10).cast("long")
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    step = lambda acc, i: F.struct(
        F.when(i % 2 == 0, (acc["l"] + number(i, acc["r"])) % a).otherwise(acc["l"]).alias("l"),
        F.when(i % 2 == 1, (acc["r"] + number(i, acc["l"])) % b).otherwise(acc["r"]).alias("r"),
    )
    return F.aggregate(F.array(*(F.lit(i) for i in range(2 * ROUNDS))), start, step)


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn by those of ``digits``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    put = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substr(digits, acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(
        F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n"))
    )
    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), put, lambda acc: acc["s"])


def _date(m: Column, key: str) -> Column:
    out = m
    for form, looks in DATE_FORMATS.items():
        day = F.to_date(F.try_to_timestamp(m, F.lit(form)))
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        pair = permute_pair(F.floor(n / DAYS_B), n % DAYS_B, DAYS_A, DAYS_B, "date", key)
        moved = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["l"] * DAYS_B + pair["r"]).cast("int")), form)
        out = F.when(m.rlike(looks), F.when(day.isNotNull() & n.between(0, DAYS_A * DAYS_B - 1), moved).otherwise(m)).otherwise(out)
    return out


def _ipv4(m: Column, key: str) -> Column:
    o = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    pair = permute_pair(o(1) * 256 + o(2), o(3) * 256 + o(4), 65536, 65536, "ipv4", key)
    octets = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), (x % 256).cast("string"))
    return F.concat(octets(pair["l"]), F.lit("."), octets(pair["r"]))


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    payload = permute(F.left(d, F.length(d) - 1), "card", key)
    return F.when(luhn_valid(d), refill(m, F.concat(payload, luhn_digit(payload)))).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    """Country and spaces stay; the account part is permuted and the check digits made right. Of
    a match that is not valid as a whole, the longest valid part up to a space is taken."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    turned = lambda c: F.concat(F.substr(c, F.lit(5)), F.left(c, F.lit(4)))
    groups = F.split(m, " ")
    upto = lambda i: F.array_join(F.slice(groups, 1, i), " ")
    valid = F.filter(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda i: (F.length(bare(upto(i))) >= 15) & (mod97(turned(bare(upto(i)))) == 1))
    own = F.when(F.size(valid) > 0, upto(F.get(valid, F.lit(0))))
    code = bare(own)
    country = F.left(code, F.lit(2))
    new = permute(F.substr(code, F.lit(5)), "iban", key)
    check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(country, check, new)
    put = lambda acc, c: F.when(c == " ", F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n"))).otherwise(
        F.struct(F.concat(acc["s"], F.substr(whole, acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))
    )
    chars = F.filter(F.split(own, ""), lambda c: c != "")
    filled = F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), put, lambda acc: acc["s"])
    return F.when(own.isNotNull(), F.concat(filled, F.substr(m, F.length(own) + 1))).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Valid are areas but 000, 666 and 900 upwards, groups but 00 and serials but 0000: the
    numbers of Z898 x Z989901, which is 99 x 9999."""
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    pair = permute_pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)
    parts = (pair["l"] + 1 + F.when(pair["l"] >= 665, 1).otherwise(0), 3), (F.floor(pair["r"] / 9999) + 1, 2), (pair["r"] % 9999 + 1, 4)
    new = F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in parts))
    return F.when(ok, new).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code stays. Valid are 8 to 15 digits with it, or 10 without; of more, the
    longest valid part that ends with a group is taken."""
    own = F.when(F.length(digits_of(m)) <= 15, m).otherwise(F.regexp_extract(m, r"^[+(]?(?:[ .()-]{0,2}[0-9]){8,15}(?![0-9])", 0))
    code = F.regexp_extract(own, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(own, F.length(code) + 1)
    new = F.concat(code, refill(rest, permute(digits_of(rest), "phone", key)), F.substr(m, F.length(own) + 1))
    return F.when(F.length(digits_of(own)) >= 8, new).otherwise(m)


def _behind(m: Column, head: str, kind: str, key: str, hexadecimal: bool = False) -> Column:
    """What ``head`` matches stays, the rest is permuted."""
    first = F.regexp_extract(m, head, 0)
    return F.concat(first, permute(F.substr(m, F.length(first) + 1), kind, key, hexadecimal))


def pseudonym(m: Column, key: str) -> Column:
    """Pseudonym of one match, or the match itself where no kind validates."""
    at = F.instr(m, "@")
    email = F.concat(permute(F.left(m, at - 1), "email", key), F.lit("@"), permute(F.substring_index(F.substr(m, at + 1), ".", 1), "host", key), F.substr(F.substr(m, at + 1), F.instr(F.substr(m, at + 1), ".")))
    values = {
        "email": email, "secret": _behind(m, r"^.*?[=:]\s?\"?", "secret", key, True), "access": _behind(m, r"^.{4}", "access", key), "iban": _iban(m, key), "date": _date(m, key),
        "ssn": _ssn(m, key), "ipv4": _ipv4(m, key), "card": _card(m, key), "phone": _phone(m, key),
    }
    out = F.when(is_kind("email", m), values["email"])
    for kind, value in list(values.items())[1:]:
        out = out.when(is_kind(kind, m), value)
    return out.otherwise(m)


def key_of(spark: SparkSession) -> str:
    """The session's secret key, ``spark.pii.key``; the public one, with a warning, where it is not set."""
    key = spark.conf.get("spark.pii.key", None)
    if not key:
        warnings.warn("spark.pii.key is not set: these pseudonyms can be undone by anyone", stacklevel=2)
    return key or DEMO_KEY


def pseudonymise(docs: DataFrame, key: str, counted: str = "n_replaced") -> DataFrame:
    """All columns of ``docs``, with ``text`` rewritten, and the number of replacements behind them.

    A column of ``docs`` that is named like the count (``counted``) gives way to it.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col("text")
    may = F.coalesce(text.rlike(MAY_HAVE), F.lit(False))
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = found.withColumn("found", F.when(may, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))))
    found = found.withColumn("put", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))))
    between = F.split(text, ANY, -1)
    whole = F.array_join(F.zip_with(between, F.col("put"), lambda t, p: F.concat(t, F.coalesce(p, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("found", "put", lambda a, b: a != b), lambda x: x))
    out = [F.when(F.size("put") > 0, whole).otherwise(text).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != counted]
    return found.select(*out, F.when(F.size("put") > 0, changed).otherwise(0).cast("long").alias(counted))

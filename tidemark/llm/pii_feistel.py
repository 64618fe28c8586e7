"""Personal numbers, dates and addresses replaced by keyed pseudonyms of the same format.

Each value is validated (check digits, ranges, calendar), mapped into a product of two ranges and permuted there by a
Feistel network whose round function is a keyed hash; check digits are made anew. As that is a permutation of the
format's valid values, equal values get equal pseudonyms in every document and different values different ones. All of
it is DataFrame expressions: texts are split at the matches, the matches transformed as arrays, and all joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

ROUNDS = 8
#: What may be personal, in order of precedence, and the kinds' names.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|(?<![0-9])[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: How a card's number is grouped if other digits stand beside it in a match.
CARD_GROUPS = (r"[0-9]{13,19}", r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,4}", r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}\2[0-9]{1,3}", r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")
DAYS, DAY_A, DAY_B = 146097, 189, 773  # the days of 400 years from 1800-01-01, and two factors of their number


def _round(key: str, kind: str, r: Column, other: Column, places: str = "") -> Column:
    """A keyed number of 60 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind + places), r.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, range_a: Column, range_b: Column) -> Column:
    """A keyed permutation of the pairs (a, b), 0 <= a < range_a and 0 <= b < range_b: a struct of both."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + _round(key, kind, r, s["b"]) % range_a) % range_a).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + _round(key, kind, r, s["a"]) % range_b) % range_b).alias("b"),
        )

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, step)


def _pow10(n: Column) -> Column:
    return F.get(F.array(*[F.lit(10**k) for k in range(17)]).cast("array<bigint>"), n)


def _digits(key: str, kind: str, digits: Column) -> Column:
    """A string of up to 32 digits permuted; a single digit goes by its keyed place alone."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    part = lambda x: F.coalesce(F.when(x != "", x), F.lit("0")).cast("long")
    pair = feistel(key, kind, part(F.substr(digits, F.lit(1), u)), part(F.substr(digits, u + 1, n - u)), _pow10(u), _pow10(n - u))
    # one array of one element, so that the pair is made once
    return F.get(F.transform(F.array(pair), lambda p: F.concat(F.when(u > 0, F.lpad(p["a"].cast("string"), u, "0")).otherwise(""), F.lpad(p["b"].cast("string"), n - u, "0"))), 0)


def _chars(text: Column) -> Column:
    return F.split(text, "(?s)(?<=.)(?=.)")


def _strip(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """The format of m with its digits replaced in order."""
    chars = _chars(m)
    return F.get(
        F.transform(
            F.array(F.struct(chars.alias("c"), digits.alias("d"))),
            lambda s: F.array_join(F.transform(s["c"], lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(s["d"], F.length(_strip(F.array_join(F.slice(s["c"], 1, i + 1), ""))), F.lit(1))).otherwise(c)), ""),
        ),
        0,
    )


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after these digits."""
    back = _chars(F.reverse(digits))
    value = lambda c, i: F.when(i % 2 == 0, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int"))
    return (10 - F.aggregate(F.transform(back, value), F.lit(0), lambda s, x: s + x) % 10) % 10


def _mod97(chars: Column) -> Column:
    """Of a string of digits and capitals, a capital being two digits."""
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(chars), F.lit(0), step)


def _is_card(digits: Column) -> Column:
    return (_luhn(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1).cast("int")) & digits.rlike("[1-9]")


def _card(key: str, m: Column) -> tuple[Column, Column]:
    """The whole match, or else the first number in it that is grouped as on cards and has a valid check digit."""
    parts = F.concat(*[F.regexp_extract_all(m, F.lit(rf"(?<![0-9])(?=({p})(?![0-9]))"), F.lit(1)) for p in CARD_GROUPS])
    found = F.get(F.filter(F.concat(F.array(m), parts), lambda c: _is_card(_strip(c))), 0)

    def replaced(c: Column) -> Column:
        digits = _strip(c)
        new = F.get(F.transform(F.array(_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))), lambda d: F.concat(d, _luhn(d).cast("string"))), 0)
        return F.replace(m, c, _refill(c, new))

    new = F.get(F.transform(F.filter(F.array(found), lambda c: c.isNotNull()), replaced), 0)
    return new.isNotNull(), new


def _phone(key: str, m: Column) -> tuple[Column, Column]:
    """The country code stays if a separator or bracket follows it, else its first digit."""
    head = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9])?", 0)
    tail = F.substr(m, F.length(head) + 1)
    return F.lit(True), F.concat(head, _refill(tail, _digits(key, "phone", _strip(tail))))


def _ssn(key: str, m: Column) -> tuple[Column, Column]:
    area, group, serial = (F.get(F.split(m, "-"), k).cast("int") for k in range(3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    pair = feistel(key, "ssn", F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    to = lambda p: F.concat_ws("-", F.lpad((p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"))
    return valid, F.get(F.transform(F.array(pair), to), 0)


def _ip(key: str, m: Column) -> tuple[Column, Column]:
    o = [F.get(F.split(m, r"\."), k).cast("int") for k in range(4)]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    pair = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    octets = lambda p: F.concat_ws(".", *[x.cast("int").cast("string") for s in "ab" for x in (F.floor(p[s] / 256), p[s] % 256)])
    return valid, F.get(F.transform(F.array(pair), octets), 0)


def _date(key: str, m: Column) -> tuple[Column, Column]:
    """Day before month, unless the year leads or that order isn't valid. Valid days of 1800 to 2199 are permuted among themselves.

    What can be read with the month first only goes to another such day: the permutation is repeated until it meets one,
    so that no two dates get one pseudonym.
    """
    one, two, year = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    lead = m.rlike("^[0-9]{4}")
    swapped = ~lead & (two.cast("int") > 12)
    iso = F.when(lead, m).when(swapped, F.concat_ws("-", year, one, two)).otherwise(F.concat_ws("-", year, two, one))
    day = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1800-01-01").cast("date"))
    valid = F.coalesce((day >= 0) & (day < DAYS), F.lit(False))
    safe = F.when(valid, day).otherwise(0)
    moved = lambda a, b: feistel(key, "date", a, b, F.lit(DAY_A), F.lit(DAY_B))
    day_of = lambda p: F.date_add(F.lit("1800-01-01").cast("date"), (p["a"] * DAY_B + p["b"]).cast("int"))
    again = F.array_repeat(F.lit(0), F.when(swapped, 60).otherwise(0))  # two of five days don't do: 60 times in a row never happens
    pair = F.aggregate(again, moved(F.floor(safe / DAY_B), safe % DAY_B), lambda p, _: F.when(F.dayofmonth(day_of(p)) <= 12, moved(p["a"], p["b"])).otherwise(p))

    def to(p: Column) -> Column:
        new = F.date_format(day_of(p), "yyyy-MM-dd")
        mark, month, day = F.substring(m, 3, 1), F.substring(new, 6, 2), F.substring(new, 9, 2)
        return F.when(lead, new).otherwise(F.concat(F.when(swapped, month).otherwise(day), mark, F.when(swapped, day).otherwise(month), mark, F.substring(new, 1, 4)))

    return valid, F.get(F.transform(F.array(pair), to), 0)


def _iban(key: str, m: Column) -> tuple[Column, Column]:
    """Digits of the account are permuted, the check digits made anew; letters stay."""
    flat = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(flat, 1, 2), F.substr(flat, F.lit(5))
    valid = _mod97(F.concat(account, F.substring(flat, 1, 4))) == 1
    digits = _strip(account)
    new = F.when(digits == "", account).otherwise(_refill(account, _digits(key, "iban", F.when(digits == "", "0").otherwise(digits))))
    check = lambda a: F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
    made = F.get(F.transform(F.array(new), lambda a: F.concat(country, check(a), a)), 0)
    # spaces go back to their places
    chars = _chars(m)
    back = F.get(F.transform(F.array(F.struct(chars.alias("c"), made.alias("d"))), lambda s: F.array_join(F.transform(s["c"], lambda c, i: F.when(c == " ", c).otherwise(F.substr(s["d"], F.length(F.replace(F.array_join(F.slice(s["c"], 1, i + 1), ""), F.lit(" "), F.lit(""))), F.lit(1)))), "")), 0)
    return valid, back


def _email(key: str, m: Column) -> tuple[Column, Column]:
    """Each letter and digit before the @ moves within its class by a keyed hash of the other half; the rest stays."""
    local = F.substring_index(m, "@", 1)
    chars = _chars(local)
    half = F.floor(F.size(chars) / 2).cast("int")

    def moved(part: Column, other: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), r.cast("string"), F.array_join(other, "")), 256)

        def one(c: Column, i: Column) -> Column:
            off = F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            low = F.when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65).when(c.rlike("^[0-9]$"), 48)
            wide = F.when(low == 48, 10).otherwise(26)
            return F.when(low.isNull(), c).otherwise(F.char((low + (F.ascii(c) - low + off) % wide).cast("long")))

        return F.transform(part, one)

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, moved(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], r)).alias("b"))

    start = F.struct(F.slice(chars, 1, half).alias("a"), F.slice(chars, half + 1, F.size(chars) - half).alias("b"))
    new = F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, step, lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))
    return F.lit(True), F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def _judged(key: str, m: Column) -> Column:
    """Of a match: its kind, and the pseudonym; the match itself and no kind if it isn't valid."""
    out = None
    for kind, pattern in PATTERNS.items():
        valid, new = _MAKERS[kind](key, m)
        whole = m.rlike("^(?:" + pattern + ")$")
        made = F.when(F.coalesce(valid, F.lit(False)), F.struct(F.lit(kind).alias("kind"), new.alias("text"))).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text")))
        out = F.when(whole, made) if out is None else out.when(whole, made)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text")))


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with the column text pseudonymised, and pii_kinds: the kinds of what was replaced, in order.

    A null text stays null, an empty one empty; texts without a valid value are returned as they are. A value that
    matches a pattern but isn't valid (a wrong check digit, a day that doesn't exist) stays. Rows are independent:
    repeated rows get equal texts, an empty table stays empty; other columns pass through, a column pii_kinds is
    replaced. The key must be kept secret; who has it can undo the permutation.
    """
    pattern = "|".join(f"(?:{p})" for p in PATTERNS.values())
    t = F.col(text)
    some = F.coalesce(t.rlike("[0-9@]"), F.lit(False))
    found, new, pieces = fresh(df, "found", "new", "pieces")
    out = df.withColumn(found, F.when(some, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(new, F.transform(found, lambda m: _judged(key, m)))
    out = out.withColumn(pieces, F.when(F.size(found) > 0, F.split(t, pattern)))
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(new), i)["text"], F.lit("")))), "")
    out = out.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(t))
    out = out.withColumn("pii_kinds", F.filter(F.transform(new, lambda x: x["kind"]), lambda k: k.isNotNull()))
    return out.drop(found, new, pieces)

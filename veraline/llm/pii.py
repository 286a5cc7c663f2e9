"""Format-preserving Feistel pseudonyms, in DataFrame functions only.

Found in a text, from left to right: e-mail addresses, IBANs, IPv4 addresses, ISO
and day/month/year dates, telephone numbers, social-security numbers and payment
cards.  A candidate counts only when it validates (Luhn, mod 97, calendar, octet
and area ranges).  It's then seen as a row of digits in mixed radices, so that
every value of the radices is a valid one again, and a keyed alternating Feistel
network permutes the row.  Check digits are computed anew.  Length, punctuation
and letter classes stay; equal values get equal pseudonyms in any document, and
the permutation is one to one within its format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraline.plans.store import fresh

# The forms of the candidates, in order of precedence.
_NO_LETTER_BEFORE = r"(?<![0-9A-Za-z])"
# A digit and a point go before decimals; a comma parts the values of a list, but for a card's plain digits after "0,".
_NO_WORD_BEFORE = r"(?<![0-9A-Za-z]|[0-9]\.)"
_NO_ZERO_BEFORE = r"(?<!(?<![0-9A-Za-z.,])0,)"
_NO_WORD_AFTER = r"(?![0-9A-Za-z])"
#: Lengths of IBANs by country: a printed one ends there, whatever capitals or digits follow it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _printed(n: int, lands: str) -> str:
    rest = f" [A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}"


FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?=[A-Z]{2}[0-9]{2})" + _NO_LETTER_BEFORE + r"(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|" + "|".join(_printed(*x) for x in IBAN_LENGTHS.items()) + ")",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.[0-9])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"(?:[0-9]{4}(?<sep>[ -])[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4}|[0-9]{4}(?<gap>[ -])[0-9]{6}\k<gap>[0-9]{5}|" + _NO_ZERO_BEFORE + "[0-9]{13,19})",
    "phone": r"(?:\+1[ .-]?|(?<![0-9A-Za-z]))(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}",
}
# A look at one character comes before any look behind it: most characters of a text begin nothing.
_NUMBERS = r"(?=[0-9])" + _NO_WORD_BEFORE + "(?:" + "|".join(FORMS[x] + _NO_WORD_AFTER for x in ("ip", "date", "ssn", "card")) + ")"
ANY = "|".join((FORMS["email"] + _NO_WORD_AFTER, FORMS["iban"] + _NO_WORD_AFTER, _NUMBERS, r"(?=[0-9+(])" + FORMS["phone"] + _NO_WORD_AFTER))
#: Days of a whole Gregorian cycle, 1700-01-01 to 2099-12-31: 146,097 = 189 x 773.
FIRST_DAY, DAY_RADICES = -98615, (189, 773)
ROUNDS = 8


def _ints(text: Column) -> Column:
    """The decimal digits of a string as an array of int."""
    return F.transform(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), lambda c: c.cast("int"))


def _feistel(values: Column, radices: Column, tweak: str, key: str) -> Column:
    """The array permuted within its radices; both halves change in turn, ROUNDS times each way in all."""
    h = (F.size(values) / 2).cast("int")
    n = F.size(values)
    left, right = F.slice(values, 1, h), F.slice(values, h + 1, n - h)
    left_r, right_r = F.slice(radices, 1, h), F.slice(radices, h + 1, n - h)

    def shifted(half: Column, mods: Column, other: Column, r: Column) -> Column:
        def draw(i: Column) -> Column:
            said = F.concat_ws("|", F.lit(key), F.lit(tweak), F.array_join(radices, ","), r, i, F.array_join(other, ","))
            return F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("long")

        return F.transform(half, lambda x, i: ((x + draw(i)) % F.element_at(mods, i + 1)).cast("int"))

    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(left.alias("l"), right.alias("r")),
        lambda s, i: F.when(i % 2 == 1, F.struct(shifted(s["l"], left_r, s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), shifted(s["r"], right_r, s["l"], i).alias("r"))
        ),
        lambda s: F.concat(s["l"], s["r"]),
    )
    return state


def _same(values: Column, radix: int) -> Column:
    return F.transform(values, lambda _: F.lit(radix))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """The decimal digits of form replaced, in order, by those of the array digits."""
    chars = F.filter(F.split(form, ""), lambda c: F.length(c) > 0)
    filled = F.aggregate(
        chars,
        F.struct(F.lit("").alias("t"), F.lit(0).alias("k")),
        lambda s, c: F.when(c.between("0", "9") & (F.length(c) == 1), F.struct(F.concat(s["t"], F.element_at(digits, s["k"] + 1).cast("string")).alias("t"), (s["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k"))
        ),
        lambda s: s["t"],
    )
    return filled


def _luhn_sum(values: Column, odd_from_right: int) -> Column:
    """Sum in which every second digit counts double; odd_from_right: 1 if the last digit does."""
    n = F.size(values)
    parts = F.transform(values, lambda d, i: F.when((n - 1 - i + odd_from_right) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d)


def _card(m: Column, key: str) -> Column:
    d = _ints(_digits(m))
    body = F.slice(d, 1, F.size(d) - 1)
    new = _feistel(body, _same(body, 10), "card", key)

    def closed(x: Column) -> Column:
        return _refill(m, F.concat(x, F.array(((10 - _luhn_sum(x, 1) % 10) % 10).cast("int"))))

    # `transform` over one element names the new body once, else it would be computed for each use
    return F.when(_luhn_sum(d, 0) % 10 == 0, F.element_at(F.transform(F.array(new), closed), 1))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    low = F.transform(octets, lambda x: F.when(x < 10, 0).when(x < 100, 10).otherwise(100))
    radix = F.transform(octets, lambda x: F.when(x < 10, 10).when(x < 100, 90).otherwise(156))
    plain = ~m.rlike(r"(?:^|\.)0[0-9]")
    new = F.zip_with(_feistel(F.zip_with(octets, low, lambda x, a: x - a), radix, "ip", key), low, lambda x, a: (x + a).cast("string"))
    return F.when(plain & F.forall(octets, lambda x: x <= 255), F.array_join(new, "."))


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4)).cast("int")
    a, b = F.when(iso, F.substring(m, 6, 2)).otherwise(F.substring(m, 1, 2)).cast("int"), F.when(iso, F.substring(m, 9, 2)).otherwise(F.substring(m, 4, 2)).cast("int")
    # slashes are month/day where that is a date, dots are day.month
    month_first = iso | (m.contains("/") & (a <= 12))
    month, day = F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a)
    real = year.between(1700, 2099) & month.between(1, 12) & (day >= 1)
    days = F.when(F.when(real, day <= F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))).otherwise(False), F.unix_date(F.make_date(year, month, day)) - FIRST_DAY)
    pair = F.array((days / DAY_RADICES[1]).cast("int"), (days % DAY_RADICES[1]).cast("int"))
    new = _feistel(pair, F.array(*map(F.lit, DAY_RADICES)), "date", key)

    def told(x: Column) -> Column:
        d = F.date_from_unix_date((F.element_at(x, 1) * DAY_RADICES[1] + F.element_at(x, 2) + FIRST_DAY).cast("int"))
        y, mm, dd = (F.lpad(f(d).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.dayofmonth, 2)))
        sep = F.substring(m, 3, 1)
        return F.when(iso, F.concat(y, F.lit("-"), mm, F.lit("-"), dd)).when(month_first, F.concat(mm, sep, dd, sep, y)).otherwise(F.concat(dd, sep, mm, sep, y))

    return F.when(days.isNotNull(), F.element_at(F.transform(F.array(new), told), 1))


def _phone(m: Column, key: str) -> Column:
    d = _ints(F.regexp_replace(F.regexp_replace(m, r"^\+1", ""), "[^0-9]", ""))
    # area and exchange codes that begin with 2 to 9 stay so, the rest stay below 2
    low = F.transform(d, lambda x, i: F.when(((i == 0) | (i == 3)) & (x >= 2), 2).otherwise(0))
    radix = F.transform(d, lambda x, i: F.when((i == 0) | (i == 3), F.when(x >= 2, 8).otherwise(2)).otherwise(10))
    new = F.zip_with(_feistel(F.zip_with(d, low, lambda x, a: x - a), radix, "phone", key), low, lambda x, a: (x + a).cast("int"))
    lead = F.when(m.startswith("+1"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return _refill(m, F.concat(lead, new))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, *x).cast("int") for x in ((1, 3), (5, 2), (8, 4)))
    fine = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = _feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key)

    def told(x: Column) -> Column:
        a = F.element_at(x, 1)
        a = F.when(a > 664, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.element_at(x, 2) + 1).cast("string"), 2, "0"), F.lpad((F.element_at(x, 3) + 1).cast("string"), 4, "0"))

    return F.when(fine, F.element_at(F.transform(F.array(new), told), 1))


def _mod97(text: Column) -> Column:
    """A string of digits and capital letters (A = 10) modulo 97."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: F.length(c) > 0),
        F.lit(0),
        lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97),
    )


def _letters(text: Column, key: str, tweak: str) -> Column:
    """Letters and digits of a string permuted within their class, the rest as it is."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c))
    low = F.transform(codes, lambda c: F.when(c.between(48, 57), 48).when(c.between(65, 90), 65).when(c.between(97, 122), 97).otherwise(c))
    radix = F.transform(codes, lambda c: F.when(c.between(48, 57), 10).when(c.between(65, 90) | c.between(97, 122), 26).otherwise(1))
    new = _feistel(F.zip_with(codes, low, lambda c, a: c - a), radix, tweak, key)
    return F.array_join(F.zip_with(new, low, lambda c, a: F.char((c + a).cast("long"))), "")


def _iban(m: Column, key: str) -> Column:
    """Unspaced or printed in groups of four: equal values get equal pseudonyms in both forms."""
    land, plain = F.substring(m, 1, 2), F.regexp_replace(m, " ", "")
    fine = _mod97(F.concat(F.substring(plain, 5, 40), F.substring(m, 1, 4))) == 1

    def told(body: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(land, check, body)
        return F.when(m.contains(" "), F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")).otherwise(whole)

    return F.when(fine, F.element_at(F.transform(F.array(_letters(F.substring(plain, 5, 40), key, "iban")), told), 1))


def _email(m: Column, key: str) -> Column:
    """All before the last dot; the case of letters is kept, what they become doesn't depend on it."""
    end = F.concat(F.lit("."), F.element_at(F.split(m, r"\."), -1))
    name = F.substring(m, F.lit(1), F.length(m) - F.length(end))
    new = _letters(F.lower(name), key, "email")
    upper = F.zip_with(F.split(name, ""), F.split(new, ""), lambda a, b: F.when(a.between("A", "Z"), F.upper(b)).otherwise(b))
    return F.concat(F.when(name == F.lower(name), new).otherwise(F.array_join(upper, "")), end)


_BY_KIND = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike("^[A-Z]"), "iban").when(m.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"), "ip")
        .when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), "date").when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), "card").otherwise("phone")
    )


def _pseudonym(m: Column, key: str) -> Column:
    """struct(kind, text): kind is null if the candidate doesn't validate, and its text stays."""

    def of(kind: Column) -> Column:
        new = F.coalesce(*(F.when(kind == k, f(m, key)) for k, f in _BY_KIND.items()))
        return F.element_at(F.transform(F.array(new), lambda t: F.struct(F.when(t.isNotNull(), kind).alias("kind"), F.coalesce(t, m).alias("text"))), 1)

    return F.element_at(F.transform(F.array(_kind(m)), of), 1)


def pseudonymize(df: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """df with the personal values in its text column replaced; other columns as they are.

    key: the secret; who has it can invert the pseudonyms, so it's the caller's to keep.
    What stays readable by design is the format: how many digits an octet of an address
    has, an e-mail address's top domain, a separator.

    found: the name of an added column (with underscores, if df has it already, in any
    case of its letters), array<struct<kind, text>> of the values put in, in order.  A null text stays null (found: empty), an empty one empty.
    Equal rows give equal rows.  Texts of any length are read whole.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    parts, new = fresh(df, "parts"), fresh(df, "new")
    has = F.col(text).rlike("[0-9@]")
    split = df.withColumn(parts, F.when(has, F.split(F.col(text), ANY, -1))).withColumn(
        new, F.when(has, F.transform(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), lambda m: _pseudonym(m, key)))
    )
    told = F.concat(F.col(new)["text"], F.array(F.lit("")))
    joined = F.array_join(F.flatten(F.zip_with(F.col(parts), told, lambda a, b: F.array(a, b))), "")
    out = split.withColumn(text, F.when(F.col(new).isNotNull(), joined).otherwise(F.col(text)))
    if found:
        while found.lower() in {c.lower() for c in df.columns}:
            found += "_"
        out = out.withColumn(found, F.filter(F.coalesce(F.col(new), F.array().cast("array<struct<kind:string,text:string>>")), lambda x: x["kind"].isNotNull()))
    return out.drop(parts, new)

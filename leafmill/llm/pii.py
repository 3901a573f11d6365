"""Format-preserving pseudonyms for personal values in texts, in DataFrame functions only.

Found and checked are: mail addresses; bank account numbers (IBAN, remainder 97); IPv4 addresses (parts up to 255);
dates from 1900-01-01 to 2079-06-06 written as year-month-day, or with a four-digit year last (day first unless only
month first makes a date); social security numbers (ranges in use); telephone numbers (+1 and ten digits, another
code with 8 to 15 digits in all, or ten digits in groups); card numbers (13 to 19 digits, check digit right); and keys and passwords in assignments.
What does not pass its check stays as it is.

A value is reduced to its letters and digits, and a keyed Feistel network permutes these within their form: digits
stay digits, letters letters, separators and case stay where they are, check digits are made anew, dates move among the
dates, addresses among the addresses. So equal values get equal pseudonyms in every document, however they are
punctuated, and different ones different pseudonyms. The country code of a telephone number stays. Addresses and dates without leading zeros may change their
number of digits, everything else keeps its length. The key is the caller's secret.

A null text stays null; an empty text or one without a value stays as it is; other columns are passed on; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_LEFT, _RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Countries by the length of their account numbers.
_COUNTRIES = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|CR|HR|LI|LV",
              22: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "AO|CV|GW|LY|MZ|PT|ST",
              26: "DZ|IR|IS|TR", 27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD",
              28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
#: Accounts of known length end there; others may take words after them along, which the check leaves out.
_ACCOUNTS = [f"(?:{names})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + _RIGHT
             for n, names in _COUNTRIES.items()]
#: What a value looks like, by kind, in the order in which they are tried at a place.
FORMS = {
    "mail": r"[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<=(?i:password|passwd|secret|token|api_key|apikey)\s?[=:]\s?[\"']?)[A-Za-z0-9]{8,}|(?:AKIA|ASIA)[A-Z0-9]{16}",
    "account": "|".join(_ACCOUNTS) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "address": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}",
    "social": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9](?:[ .()/-]{0,2}[0-9]){7,14}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}([-. ])[0-9]{3}\3[0-9]{4}",
    "card": r"[0-9]{13,19}|[0-9]{4}([ -])(?:[0-9]{4}\4){2}[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\5[0-9]{5}",
}


def _pattern() -> str:
    # signs before a mail address are taken along and stay: a search that began at each letter after one would be quadratic
    left = {"mail": r"(?<![A-Za-z0-9._%+-])(?:(?<!@)|(?=[._%+-]))", "address": r"(?<![\p{L}\p{N}.])", "phone": r"(?<![\p{L}\p{N}+(])", "secret": ""}
    return "|".join(left.get(k, _LEFT) + f"(?:{form})" + _RIGHT for k, form in FORMS.items())


def _hash(key: Column, *parts: Column) -> Column:
    """64 hex digits that depend on the key."""
    return F.sha2(F.concat_ws("|", key, *parts, key).cast("binary"), 256)


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def _at(text: Column, place: Column, n: int = 1) -> Column:
    return F.substr(text, place.cast("int"), F.lit(n))


def _letters(text: Column, change) -> Column:
    """``text`` with every character replaced by change(character, place)."""
    made = F.transform(F.sequence(F.lit(1), F.length(text)), lambda j: change(_at(text, j), j))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(made, ""))


def _moved(c: Column, by: Column) -> Column:
    """A digit or lower-case letter moved within its kind."""
    code = F.ascii(c)
    return F.when(code < 58, F.char((code - 48 + by) % 10 + 48)).otherwise(F.char((code - 97 + by) % 26 + 97))


def _permuted(key: Column, kind: str, text: Column) -> Column:
    """A permutation of all strings of digits and lower-case letters with digits and letters at the same places."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))

    def turn(state: Column, i: Column) -> Column:
        # the other half is hashed once a turn: a one-element array binds the hash to a name
        pad = F.array(_hash(key, F.lit(kind), i.cast("string"), F.length(text).cast("string"), state["r"]))
        left = F.transform(pad, lambda p: _letters(state["l"], lambda c, j: _moved(c, _number(_at(p, (j - 1) % 32 * 2 + 1, 2)))))
        return F.struct(state["r"].alias("l"), left[0].alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _permuted_number(key: Column, kind: str, value: Column, half: int) -> Column:
    """A permutation of 0 .. half * half - 1."""
    start = F.struct(F.floor(value / half).cast("bigint").alias("l"), (value % half).cast("bigint").alias("r"))

    def turn(state: Column, i: Column) -> Column:
        add = _number(F.substring(_hash(key, F.lit(kind), i.cast("string"), state["r"].cast("string")), 1, 12))
        return F.struct(state["r"].alias("l"), ((state["l"] + add) % half).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * half + s["r"])


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def _dressed(value: Column, bare: Column) -> Column:
    """The characters of ``bare`` at the places of the letters and digits of ``value``, in their case."""

    def place(c: Column, j: Column) -> Column:
        new = _at(bare, F.length(_bare(F.substr(value, F.lit(1), j))))
        return F.when(c.rlike("[A-Z]"), F.upper(new)).when(c.rlike("[a-z0-9]"), new).otherwise(c)

    return _letters(value, place)


def _bound(value: Column, use) -> Column:
    """use(value) with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled, modulo 10; the last digit counts once."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, j: Column) -> Column:
        d = _at(digits, j).cast("int")
        twice = (F.length(digits) - j) % 2 == 1
        return (total + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)) % 10

    return F.aggregate(places, F.lit(0), add)


def _remainder97(text: Column) -> Column:
    """Remainder of an account number read as digits, letters as 10 to 35."""

    def add(total: Column, j: Column) -> Column:
        code = F.ascii(_at(text, j))
        return F.when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 87) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _card(key: Column, value: Column) -> Column:
    def checked(digits: Column) -> Column:
        body = _permuted(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
        new = _bound(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
        return F.when(_luhn(digits) == 0, _bound(new, lambda n: _dressed(value, n))).otherwise(value)

    return _bound(_bare(value), checked)


def _account(key: Column, value: Column) -> Column:
    def right(bare: Column) -> Column:
        return F.length(bare).between(15, 34) & (_remainder97(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))) == 1)

    def made(bare: Column) -> Column:
        country = F.substring(bare, 1, 2)
        return _bound(_permuted(key, "account", F.substr(bare, F.lit(5))), lambda b: F.concat(
            country, F.lpad((98 - _remainder97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

    def changed(head: Column) -> Column:
        new = _bound(made(_bare(head)), lambda n: F.concat(_dressed(head, n), F.substr(value, F.length(head) + 1)))
        return F.when(head.isNull(), value).otherwise(new)

    # the longest run of words from the first on that passes; what follows stays
    parts = F.split(value, " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), " "))
    good = F.filter(heads, lambda h: _bound(_bare(h), right))
    return _bound(F.try_element_at(good, F.lit(-1)), changed)


def _address(key: Column, value: Column) -> Column:
    def checked(parts: Column) -> Column:
        whole = F.aggregate(parts, F.lit(0).cast("bigint"), lambda t, p: t * 256 + p)
        new = _bound(_permuted_number(key, "address", whole, 1 << 16), lambda n: F.concat_ws(
            ".", *[(F.floor(n / (1 << s)) % 256).cast("bigint").cast("string") for s in (24, 16, 8, 0)]))
        return F.when(F.forall(parts, lambda p: p < 256), new).otherwise(value)

    return _bound(F.transform(F.split(value, r"\."), lambda p: p.cast("bigint")), checked)


def _date(key: Column, value: Column) -> Column:
    first = F.lit("1900-01-01").cast("date")

    def checked(p: Column) -> Column:
        mark = F.regexp_extract(value, "[-/.]", 0)
        year_first = F.length(p[0]) == 4
        orders = {"ymd": (0, 1, 2), "dmy": (2, 1, 0), "mdy": (2, 0, 1)}
        read = {o: F.try_to_date(F.concat_ws("-", *[F.lpad(p[i], 4 if k == 0 else 2, "0") for k, i in enumerate(at)]), "yyyy-MM-dd")
                for o, at in orders.items()}
        day = F.when(year_first, read["ymd"]).otherwise(F.coalesce(read["dmy"], read["mdy"]))
        number = F.datediff(day, first)

        new = _bound(F.date_add(first, _permuted_number(key, "date", number, 256).cast("int")), lambda d: F.when(year_first, _written(d, p, mark, "ymd"))
                     .when(read["dmy"].isNotNull(), _written(d, p, mark, "dmy")).otherwise(_written(d, p, mark, "mdy")))
        return F.when(number.between(0, 65535), new).otherwise(value)

    return _bound(F.split(value, "[-/.]"), checked)


def _written(day: Column, given: Column, mark: Column, order: str) -> Column:
    """A date in the order and with the number of digits of the given one, as far as two digits allow."""
    part = {"y": F.year(day), "m": F.month(day), "d": F.dayofmonth(day)}
    texts = [F.when(F.length(given[i]) == 1, part[c].cast("string")).otherwise(F.lpad(part[c].cast("string"), 4 if c == "y" else 2, "0"))
             for i, c in enumerate(order)]
    return F.concat(texts[0], mark, texts[1], mark, texts[2])


def _social(key: Column, value: Column) -> Column:
    # numbers in use: not 000, 666 or 9.. in front, no group of zeros
    good = r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$"
    # going on until a number in use comes is a permutation of those; an eighth is not in use, so 60 turns are always enough
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(60)), _permuted(key, "social", _bare(value)),
                       lambda now, _: F.when(now.rlike(good), now).otherwise(_permuted(key, "social", now)))
    return F.when(_bare(value).rlike(good), _bound(walk, lambda n: _dressed(value, n))).otherwise(value)


#: Country codes of telephone numbers: one digit, two, or else three.
_CODE = r"^\+(?:[17]|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}|[0-9])"


def _phone(key: Column, value: Column) -> Column:
    """The country code stays, so the pseudonym is a number of the same country and form."""
    code = F.regexp_extract(value, _CODE, 0)
    rest = F.substr(value, F.length(code) + 1)
    return F.concat(code, _dressed(rest, _permuted(key, "phone", _bare(rest))))


def _plain(kind: str, keep: str | None = None):
    def change(key: Column, value: Column) -> Column:
        fixed = F.lit("") if keep is None else F.regexp_extract(value, keep, 0)
        rest = F.substr(value, F.lit(1), F.length(value) - F.length(fixed))
        return F.concat(_dressed(rest, _permuted(key, kind, _bare(rest))), fixed)

    return change


_CHANGES = {"mail": _plain("mail", r"\.[A-Za-z]+$"), "secret": _plain("secret"), "account": _account, "address": _address,
            "date": _date, "social": _social, "phone": _phone, "card": _card}


def _kind(value: Column) -> Column:
    """Which form a found value has; the marks alone tell them apart."""
    out = F.when(value.contains("@"), "mail").when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "address")
    out = out.when(value.rlike(r"^([0-9]{4}([-/.])[0-9]{1,2}\2[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\3[0-9]{4})$"), "date")
    out = out.when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social")
    out = out.when(value.rlike(r"^(\+.*|\([0-9]{3}\).*|[0-9]{3}([-. ])[0-9]{3}\2[0-9]{4})$"), "phone")
    out = out.when(value.rlike(r"^[0-9 -]{13,23}$"), "card")
    return out.when(value.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$") & ~value.rlike(r"^A[KS]IA"), "account").otherwise("secret")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the values in the text replaced. ``count_col`` names a column for the number of values that changed."""
    secret, text, pattern = F.lit(key), F.col(f"`{text_col}`"), F.lit(_pattern())

    def change(value: Column) -> Column:
        kind = _kind(value)
        out = F.when(kind == "mail", _CHANGES["mail"](secret, value))
        for name in list(_CHANGES)[1:]:
            out = out.when(kind == name, _CHANGES[name](secret, value))
        return out.otherwise(value)

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    may = text.rlike("[0-9@]") | text.rlike("(?i)passw|secret|token|api_?key|a[ks]ia")  # nothing else can hold a value
    rows = docs.withColumn("__found", F.when(may, found)).withColumn("__new", F.transform("__found", change))
    # the texts between the values, and the values, in turn
    pieces = F.zip_with(F.split(text, _pattern(), -1), F.col("__new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    out = rows.withColumn(text_col, F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(text))
    if count_col:
        changed = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x))
        out = out.withColumn(count_col, F.when(F.size("__found") > 0, changed).otherwise(0).cast("bigint"))
    return out.drop("__found", "__new")

"""Format-preserving pseudonyms of personal data by keyed Feistel permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import column_or_null

ROUNDS = 8
#: Use a secret of your own: whoever has it can undo the pseudonyms.
KEY = "replace this key"

# Patterns of the values that are looked for, in the order in which they are tried. Every repetition is possessive
# or bounded.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?<![0-9][.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])(?![.-][0-9])",
    "ssn": r"(?<![0-9A-Za-z])(?<![0-9][.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])(?![.-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "abroad": r"(?<![0-9A-Za-z+])\+[2-9][0-9]{1,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z])(?!\.[0-9])",
    "date": r"(?<![0-9A-Za-z])(?<![0-9][./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})"
            r"(?![0-9A-Za-z])(?![./-][0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Letters and digits of an IBAN by country: of several valid ends of a match, that of this length is taken first.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24,
}
# Dates are days from 1900-01-01 on, 280 times 280 of them, up to 2114-08-26: each number below that is a date.
_FIRST_DAY, _SIDE = "1900-01-01", 280


def _number(key: str, *parts: Column) -> Column:
    """60 pseudo-random bits of the key and the parts."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint")


def _feistel(key: str, kind: str, left: Column, right: Column, lefts: Column, rights: Column) -> Column:
    """Keyed permutation of the pairs (left, right), left below lefts and right below rights: each round adds a hash
    of one side to the other, and so can be undone."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def turn(state, i):
        return F.when(i % 2 == 0, F.struct(
            ((state["l"] + _number(key, F.lit(kind), i, lefts, rights, state["r"]) % lefts) % lefts).alias("l"), state["r"].alias("r"))) \
            .otherwise(F.struct(
                state["l"].alias("l"), ((state["r"] + _number(key, F.lit(kind), i, lefts, rights, state["l"]) % rights) % rights).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(digits: Column) -> Column:
    return F.rpad(F.lit("1"), digits + 1, "0").cast("bigint")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit text's permutation among the digit texts of its length, 2 to 30."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    pair = _feistel(key, kind, F.substring(digits, F.lit(1), half).cast("bigint"), F.substring(digits, half + 1, rest).cast("bigint"),
                    _power(half), _power(rest))
    return _once(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.split(value, "", -1)


def refilled(template: Column, digits: Column) -> Column:
    """The template with its digits, from the left, replaced by the given ones."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(_chars(template), start, lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))), lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of digits, every second one from the right doubled and crossed; a valid number's is a multiple of 10."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(key: str, value: Column) -> Column:
    """All digits but the last are permuted, the last is the check digit that fits."""
    def change(digits):
        fresh = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
        return F.when(luhn_sum(digits) % 10 == 0, refilled(value, _once(fresh, lambda p: F.concat(
            p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))))

    return F.coalesce(_once(_digits(value), change), value)


def iban_rest(text: Column) -> Column:
    """Remainder by 97 of the text as a number, letters being 10 to 35."""
    return F.aggregate(_chars(text), F.lit(0).cast("bigint"), lambda s, c: F.when(c == "", s).when(
        c.rlike("^[0-9]$"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _plain(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def _card_fits(value: Column) -> Column:
    return _once(_digits(value), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0))


def _iban_fits(value: Column) -> Column:
    return _once(_plain(value), lambda p: F.length(p).between(15, 34) & (
        iban_rest(F.concat(F.substring(p, F.lit(5), F.length(p) - 4), F.substring(p, 1, 4))) == 1))


def _iban(key: str, value: Column) -> Column:
    """The account part's digits are permuted, its letters and the country stay, the check digits are those that
    fit."""
    def change(plain):
        head, body = F.substring(plain, 1, 4), F.substring(plain, F.lit(5), F.length(plain) - 4)
        country = F.substring(plain, 1, 2)
        fresh = F.when(F.length(_digits(body)) >= 2, refilled(body, permuted_digits(key, "iban", _digits(body)))).otherwise(body)

        def whole(account):
            check = F.lpad((98 - iban_rest(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(check, _digits(account))

        return F.when(iban_rest(F.concat(body, head)) == 1, refilled(value, _once(fresh, whole)))

    return F.coalesce(_once(_plain(value), change), value)


def _ssn(key: str, value: Column) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999 are permuted among themselves."""
    area, group, serial = (F.substring(value, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    pair = _feistel(key, "ssn", left, serial - 1, F.lit(898 * 99), F.lit(9999))

    def text(p):
        a = F.floor(p["l"] / 99).cast("bigint") + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _once(pair, text)).otherwise(value)


def _phone(key: str, value: Column) -> Column:
    """Area codes and exchanges from 200 to 999 and line numbers are permuted together; a leading 1 stays."""
    def change(digits):
        ten = F.substring(digits, -10, 10)
        number = ((F.substring(ten, 1, 3).cast("bigint") - 200) * 800 + F.substring(ten, 4, 3).cast("bigint") - 200) * 10_000 \
            + F.substring(ten, 7, 4).cast("bigint")
        pair = _once(number, lambda x: _feistel(key, "phone", F.floor(x / 80_000), x % 80_000, F.lit(80_000), F.lit(80_000)))

        def text(p):
            x = p["l"] * 80_000 + p["r"]
            return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), (F.floor(x / 8_000_000) + 200).cast("string"),
                            (F.floor(x / 10_000) % 800 + 200).cast("string"), F.lpad((x % 10_000).cast("string"), 4, "0"))

        return refilled(value, _once(pair, text))

    return _once(_digits(value), change)


def _abroad(key: str, value: Column) -> Column:
    """The digits after the first two are permuted."""
    return _once(_digits(value), lambda d: refilled(value, F.concat(
        F.substring(d, 1, 2), permuted_digits(key, "abroad", F.substring(d, F.lit(3), F.length(d) - 2)))))


def _ip(key: str, value: Column) -> Column:
    def change(part):
        pair = _feistel(key, "ip", part[0].cast("bigint") * 256 + part[1].cast("bigint"),
                        part[2].cast("bigint") * 256 + part[3].cast("bigint"), F.lit(65_536), F.lit(65_536))
        return _once(pair, lambda p: F.concat_ws(".", *[x.cast("string") for side in ("l", "r") for x in (
            F.floor(p[side] / 256), p[side] % 256)]))

    return _once(F.split(value, r"\."), change)


def _date(key: str, value: Column) -> Column:
    """A day is permuted among the days of 1900-01-01 to 2114-08-26, and written as it was; other days stay. The
    three ways to write a day share the permutation."""
    def written(form):
        def text(p):
            return F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["l"] * _SIDE + p["r"]).cast("int")), form)

        def change(d):
            return F.when((d >= 0) & (d < _SIDE * _SIDE), _once(
                _feistel(key, "date", F.floor(d / _SIDE), d % _SIDE, F.lit(_SIDE), F.lit(_SIDE)), text))

        day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(_FIRST_DAY).cast("date"))
        return F.coalesce(_once(day, change), value)

    return F.when(F.substring(value, 5, 1) == "-", written("yyyy-MM-dd")).when(
        F.substring(value, 3, 1) == ".", written("dd.MM.yyyy")).otherwise(written("MM/dd/yyyy"))


def _email(key: str, value: Column) -> Column:
    """Letters and digits before the @ are permuted, each among its kind (small, capital, digit); the rest stays."""
    name = F.substring_index(value, "@", 1)

    def moved(chars, other, i):
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), F.array_join(other, "")), 256)

        def step(hashed):
            def one(c, j):
                by = F.conv(F.substring(hashed, (j % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                place = lambda first, n: F.char(F.lit(first) + (F.ascii(c) - first + by) % n)
                return F.when(c.rlike("^[a-z]$"), place(97, 26)).when(c.rlike("^[A-Z]$"), place(65, 26)) \
                    .when(c.rlike("^[0-9]$"), place(48, 10)).otherwise(c)

            return F.transform(chars, one)

        return _once(digest, step)

    def turn(state, i):
        return F.when(i % 2 == 0, F.struct(moved(state["l"], state["r"], i).alias("l"), state["r"].alias("r"))).otherwise(
            F.struct(state["l"].alias("l"), moved(state["r"], state["l"], i).alias("r")))

    def change(chars):
        half = F.floor(F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, F.lit(1), half).alias("l"), F.slice(chars, half + 1, F.size(chars)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.array_join(F.concat(s["l"], s["r"]), ""))

    return F.concat(_once(F.filter(_chars(name), lambda c: c != ""), change), F.substring(value, F.length(name) + 1, F.length(value)))


_CHANGES = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "ip": _ip, "date": _date}


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of a value that matches one of the patterns; a value that isn't valid stays as it is."""
    result = value
    for kind in reversed(PATTERNS):
        result = F.when(value.rlike(rf"^(?:{PATTERNS[kind]})$"), _CHANGES[kind](key, value)).otherwise(result)
    return result


def _runs_of_groups(text: Column, kind: str, least: int) -> Column:
    """What can be a value of ``kind`` within the matches of its pattern from any place on: each begins where the
    match does or after a hyphen in it, and ends with one of its groups of letters and digits."""
    def ends(run):
        return F.transform(F.filter(F.when(F.length(run) >= least, F.sequence(F.length(run), F.lit(least), F.lit(-1))), lambda n: F.substring(
            run, n + 1, F.lit(1)).isin("", " ", "-") & ~F.substring(run, n, F.lit(1)).isin(" ", "-")), lambda n: F.substring(run, F.lit(1), n))

    def runs(match):
        starts = F.filter(F.sequence(F.lit(1), F.length(match)), lambda i: (i == 1) | (F.substring(match, i - 1, F.lit(1)) == "-"))
        return F.flatten(F.filter(F.transform(starts, lambda i: ends(F.substring(match, i, F.length(match)))), lambda x: x.isNotNull()))

    matches = F.regexp_extract_all(text, F.lit(f"(?=({PATTERNS[kind]}))"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(matches), runs)))


def _one_of(values: Column) -> Column:
    """A pattern for these values, the first one that fits; for none, one that never matches. They hold letters,
    digits, blanks and hyphens only."""
    return F.when(F.size(values) > 0, F.concat(
        F.lit("(?<![0-9A-Za-z])(?:"), F.array_join(values, "|"), F.lit(")(?![0-9A-Za-z])"))).otherwise(F.lit("(?!)"))


def _pattern(text: Column) -> Column:
    """The pattern of the text's values: ``ANY``, unless check digits show that a match of it runs too far.

    The longest match of an IBAN or a card can hold more than the value: a word in capitals, a security code, another
    number, and its check digits can be right by chance. In a text with a match whose check digits are wrong, or that is
    longer than usual (an IBAN of its country, a card of 16 digits), all valid runs of groups are looked for, and they are
    what the pattern has in place of IBANs and cards: those of usual length first, then the longest."""
    lengths = F.create_map(*[F.lit(x) for pair in _IBAN_LENGTHS.items() for x in pair])

    def rank(value):
        return F.length(value) + F.when(F.length(_plain(value)) == F.try_element_at(lengths, F.substring(value, 1, 2)), 100).otherwise(0)

    def card_rank(value):
        return _once(F.length(_digits(value)), lambda n: n + F.when(n <= 16, 100).otherwise(0))

    def wrong(value):
        usual = F.try_element_at(lengths, F.substring(value, 1, 2))
        return F.when(value.rlike(f"^(?:{PATTERNS['iban']})$"), ~_iban_fits(value) | (F.coalesce(usual, F.lit(0)) != F.length(_plain(value)))).when(
            value.rlike(f"^(?:{PATTERNS['card']})$"), ~_card_fits(value) | (F.length(_digits(value)) > 16)).otherwise(False)

    ibans = F.array_sort(F.filter(_runs_of_groups(text, "iban", 15), _iban_fits), lambda a, b: rank(b) - rank(a))
    cards = F.array_sort(F.filter(_runs_of_groups(text, "card", 13), _card_fits), lambda a, b: card_rank(b) - card_rank(a))
    others = "|".join(p for kind, p in PATTERNS.items() if kind not in ("email", "iban", "card"))
    own = F.concat_ws("|", F.lit(PATTERNS["email"]), _once(ibans, _one_of), _once(cards, _one_of), F.lit(others))
    return F.when(F.exists(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), wrong), own).otherwise(F.lit(ANY))


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """``text`` with every value replaced by its pseudonym, all else as it was. Null stays null."""
    def joined(pattern):
        between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
        return F.array_join(F.zip_with(between, F.transform(found, lambda v: pseudonym(v, key)),
                                       lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")

    return F.when(text.rlike(ANY), _once(_pattern(text), joined)).otherwise(text)


def _count(text: Column) -> Column:
    """How many values the text has: those that are replaced, and matches with wrong check digits beside them."""
    matches = lambda t, pattern: F.size(F.regexp_extract_all(t, pattern, F.lit(0)))

    def all_of(pattern):
        beside = F.aggregate(F.split(text, pattern, -1), F.lit(0), lambda n, t: n + matches(t, F.lit(ANY)))
        return matches(text, pattern) + F.when(pattern != ANY, beside).otherwise(0)

    return F.when(text.rlike(ANY), _once(_pattern(text), all_of)).otherwise(0)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with personal data in a text column replaced: e-mail names, IBANs and payment cards with right check
    digits, social security and telephone numbers, IPv4 addresses and dates.

    Where a match runs beyond an IBAN or a card (into a word in capitals, a security code, another number), its valid part
    of usual length (an IBAN's in its country, 13 to 16 digits of a card) is the value, else the longest valid part. A
    value's pseudonym has its format and its validity, and depends on the value and the key alone: equal values
    stay equal in all documents, different values of a kind stay different. One narrow pass without a shuffle; whole
    texts of any length. Null stays null, '' stays ''; other columns, repeated rows and empty tables are left as
    they are."""
    return docs.withColumn(text, pseudonymised(F.col(f"`{text}`").cast("string"), key))


def pseudonymised_documents(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (with pseudonyms) and values (how many values the text has, valid or not) of every document."""
    # The input has a name of its own: inside lambdas, "text" would be the result's column of that name.
    rows = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("given"))
    return rows.select("doc_id", pseudonymised(F.col("given"), key).alias("text"), _count(F.col("given")).alias("values"))

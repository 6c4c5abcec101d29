import hashlib
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from loreloom.llm.pseudonyms import ANY, KEY, ROUNDS, pseudonym, pseudonymise, pseudonymised_documents

PYTHON_ANY = re.compile(ANY)


def number(*parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:15], 16)


def feistel(kind, left, right, lefts, rights):
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = (left + number(kind, i, lefts, rights, right) % lefts) % lefts
        else:
            right = (right + number(kind, i, lefts, rights, left) % rights) % rights
    return left, right


def digits_changed(kind, digits):
    h = len(digits) // 2
    l, r = feistel(kind, int(digits[:h]), int(digits[h:]), 10**h, 10 ** (len(digits) - h))
    return str(l).zfill(h) + str(r).zfill(len(digits) - h)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def refill(template, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def rest97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def plain(value):
    d = re.sub("[^0-9]", "", value)
    if "@" in value:
        name, _, domain = value.partition("@")
        sides = [list(name[:len(name) // 2]), list(name[len(name) // 2:])]
        for i in range(ROUNDS):
            own, other = sides[i % 2], sides[1 - i % 2]
            digest = hashlib.sha256("|".join((KEY, "email", str(i), "".join(other))).encode()).hexdigest()
            for j, c in enumerate(own):
                by = int(digest[j % 32 * 2:j % 32 * 2 + 2], 16)
                for first, n in ((97, 26), (65, 26), (48, 10)):
                    if first <= ord(c) < first + n:
                        own[j] = chr(first + (ord(c) - first + by) % n)
                        break
        return "".join(sides[0] + sides[1]) + "@" + domain
    if re.match("[A-Z]{2}[0-9]{2}", value):
        s = value.replace(" ", "")
        if rest97(s[4:] + s[:4]) != 1:
            return value
        body = refill(s[4:], digits_changed("iban", re.sub("[^0-9]", "", s[4:])))
        return refill(value, f"{98 - rest97(body + s[:2] + '00'):02d}" + re.sub("[^0-9]", "", body))
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", value):
        a, g, s = map(int, value.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return value
        l, r = feistel("ssn", (a - 1 - (a > 666)) * 99 + g - 1, s - 1, 898 * 99, 9999)
        a = l // 99 + 1
        return f"{a + (a >= 666):03d}-{l % 99 + 1:02d}-{r + 1:04d}"
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value) and len(value) <= 15:
        o = list(map(int, value.split(".")))
        l, r = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return ".".join(map(str, (l // 256, l % 256, r // 256, r % 256)))
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"):
        from datetime import datetime

        try:
            n = (datetime.strptime(value, form).date() - date(1900, 1, 1)).days
        except ValueError:
            continue
        if not 0 <= n < 78400:
            return value
        l, r = feistel("date", n // 280, n % 280, 280, 280)
        return (date(1900, 1, 1) + timedelta(l * 280 + r)).strftime(form)
    if value.startswith("+") and value[1] != "1":
        return refill(value, d[:2] + digits_changed("abroad", d[2:]))
    if 10 <= len(d) <= 11:
        t = d[-10:]
        x = ((int(t[:3]) - 200) * 800 + int(t[3:6]) - 200) * 10000 + int(t[6:])
        l, r = feistel("phone", x // 80000, x % 80000, 80000, 80000)
        x = l * 80000 + r
        return refill(value, d[:-10] + f"{x // 8000000 + 200}{x // 10000 % 800 + 200}{x % 10000:04d}")
    if 13 <= len(d) <= 19 and luhn(d):
        p = digits_changed("card", d[:-1])
        return refill(value, p + next(c for c in "0123456789" if luhn(p + c)))
    return value


VALUES = ["4944339490429605", "4944 3394 9042 9605", "4944-3394-9042-9605", "4944339490429604", "378282246310005", "6011000990139424",
          "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE88370400440532013000", "FR1420041010050500013M02606",
          "123-45-6789", "666-12-3456", "900-12-3456", "899-99-9999", "000-11-2222", "+1 (366) 555-9807", "366-555-9807",
          "1-366-555-9807", "(366) 555-9807", "+49 30 1234567", "+44 (0)20 7946", "61.131.143.218", "255.255.255.255", "0.0.0.0",
          "2024-02-29", "2023-02-29", "29.02.2024", "02/29/2024", "2114-08-27", "1899-12-31", "1900-01-01", "2024-13-01",
          "hoccrcif.96@mail8.example.com", "a@b.c", "X_y-9+Z%q.long.name.of.more.than.64.letters.and.some.digits.0123456789.end@h-1.org"]


def test_values_are_those_of_a_plain_loop(spark):
    matched = [v for v in VALUES if PYTHON_ANY.fullmatch(v)]
    assert len(matched) >= len(VALUES) - 2
    frame = spark.createDataFrame([(v,) for v in matched], "v string").select("v", pseudonym(F.col("v")).alias("p"))
    got = {r.v: r.p for r in frame.collect()}
    assert got == {v: plain(v) for v in matched}
    for v, p in got.items():
        assert re.sub("[0-9]", "0", v) == re.sub("[0-9]", "0", p) or "@" in v or v.count(".") == 3


def test_texts(spark):
    text = "Card 4944339490429605, mail tnf.01@mail0.example.com. Call +1 (366) 555-9807! From 61.131.143.218. On 2024-02-29, é\n"
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing 12 here", "x"), (5, text * 3, "x"), (None, "a" * 300_000 + " " + "1" * 5000, "x"),
            (1, text, "x"), (6, "id-61.131.143.218.7 1.2.3 v4944339490429605 44.1.2.3x", "x"), (7, "61.131.143.218", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, values string")
    got = pseudonymise(frame)
    assert got.columns == frame.columns
    wanted = [(i, t if t is None else PYTHON_ANY.sub(lambda m: plain(m[0]), t), x) for i, t, x in rows]
    assert [tuple(r) for r in got.collect()] == wanted
    assert not any(v in wanted[0][1] for v in ("4944339490429605", "tnf.01@", "(366) 555-9807", "61.131.143.218", "2024-02-29"))
    counts = [r["values"] for r in pseudonymised_documents(frame).collect()]
    assert counts == [len(PYTHON_ANY.findall(t or "")) for _, t, _ in rows]


DE, GB, CARD, AMEX = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111", "3782 822463 10005"
#: Values between texts that their patterns would take in, too.
CROWDED = [(DE, " BIC COBADEFF"), (GB, " OR"), (CARD, " 123 end"), (CARD, " 12/25"), ("4111-1111-1111-1111", "-123 end"), ("12 ", CARD, ", 7"),
           ("123-", "4111-1111-1111-1111", " x"), (AMEX, " ", CARD, " 77."), ("366-555-9807", " ", CARD, " 123"), ("AB12 ", CARD, " end"),
           (DE, " ", GB, " OR ", CARD, " 99"), ("4944339490429604", " 1 ", "61.131.143.218"), ("DE88 3704 0044 0532 0130 00", " IN ", "2024-02-29")]


def test_values_beside_capitals_and_numbers(spark):
    rows = [(i, "".join(parts)) for i, parts in enumerate(CROWDED)]
    got = {r.doc_id: r for r in pseudonymised_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, parts in enumerate(CROWDED):
        assert got[i].text == "".join(plain(x) if PYTHON_ANY.fullmatch(x) else x for x in parts)
        assert got[i]["values"] == sum(bool(PYTHON_ANY.fullmatch(x)) for x in parts)
    assert not any(v in got[i].text for i in got for v in (DE, GB, CARD, AMEX, "4111-1111-1111-1111", "366-555-9807"))


@pytest.mark.parametrize("kind", ["date", "digits"])
def test_permutation(spark, kind):
    if kind == "date":
        days = spark.range(78400).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    else:
        days = spark.range(10_000).select(F.concat(F.lit("+999 "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("v"))
    got = days.select(pseudonym(F.col("v")).alias("p"))
    assert got.distinct().count() == days.count()


def test_empty_table(spark):
    assert pseudonymised_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_values_stay_linked_whatever_follows(spark):
    """Every suffix, also those with which a longer run passes its check digits by chance."""
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    tails = [(card, f" {i}") for i in range(100, 1000)] + [(iban, f" {a}{b}") for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    rows = spark.createDataFrame([(i, v + t) for i, (v, t) in enumerate(tails)], "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.text for r in pseudonymise(rows).collect()}
    alone = {v: plain(v) for v in (card, iban)}
    assert [got[i] for i in range(len(tails))] == [alone[v] + t for v, t in tails]

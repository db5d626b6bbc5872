"""Pseudonyms against a plain version, and their validity."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from stormglass.llm import pii

KEY = "stormglass"
BLANK = "[ \\t\\xA0\\u1680\\u180e\\u2000-\\u200a\\u202f\\u205f\\u3000]"
FIRST_DAY = datetime.date(1800, 1, 1)


def digest(kind, i, other):
    return hashlib.sha512(f"{KEY}|{kind}|{i}|{other}".encode()).hexdigest()


def move(half, hexes):
    out = ""
    for p, c in enumerate(half, 1):
        at = (p - 1) % 32 * 4
        by = int(hexes[at:at + 4], 16) + p
        for first, size in (("0", 10), ("A", 26), ("a", 26)):
            if 0 <= ord(c) - ord(first) < size:
                c = chr(ord(first) + (ord(c) - ord(first) + by) % size)
                break
        out += c
    return out


def text(s, kind):
    halves = [s[:(len(s) + 1) // 2], s[(len(s) + 1) // 2:]]
    for i in range(8):
        halves[i % 2] = move(halves[i % 2], digest(kind, i, halves[1 - i % 2]))
    return "".join(halves)


def number(x, sizes, kind):
    halves = list(divmod(x, sizes[1]))
    for i in range(8):
        by = int(digest(kind, i, halves[1 - i % 2])[:12], 16)
        halves[i % 2] = (halves[i % 2] + by) % sizes[i % 2]
    return halves[0] * sizes[1] + halves[1]


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10


def refill(m, digits):
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in m)


def a_date(m):
    """(day, form) of the first reading that is a date, or None."""
    parts = re.split("[-./]", m)
    orders = ("ymd",) if "-" in m else ("dmy",) if "." in m else ("dmy", "mdy")
    for order in orders:
        got = dict(zip(order, map(int, parts)))
        try:
            day = datetime.date(got["y"], got["m"], got["d"])
        except ValueError:
            continue
        if 1800 <= day.year <= 2199:
            return day, order
    return None


def written(m, day, order):
    sign = re.search("[-./]", m)[0]
    two = all(len(p) >= 2 for p in re.split("[-./]", m))
    values = {"y": f"{day.year:04d}", "m": f"{day.month:02d}" if two else str(day.month),
              "d": f"{day.day:02d}" if two else str(day.day)}
    return sign.join(values[c] for c in order)


def plain_kind(m):
    digits = re.sub("[^0-9]", "", m)
    for kind, pattern in pii.KINDS:
        if not re.fullmatch(pattern.replace(r"\h", BLANK), m, re.ASCII):
            continue
        if (kind == "ip" and any(int(p) > 255 for p in m.split(".")) or kind == "date" and not a_date(m)
                or kind == "ssn" and re.search("^(?:000|666|9)|-00-|-0000$", m)
                or kind == "card" and (not 13 <= len(digits) <= 19 or luhn(digits))
                or kind == "phone" and not 8 <= len(digits) <= 15):
            continue
        return kind


def plain(m):
    kind = plain_kind(m)
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        at = m.index("@")
        return text(m[:at], kind) + m[at:]
    if kind == "secret":
        head = re.match(pii.SECRET_HEAD.replace(r"\h", BLANK) + "[\"']*", m, re.ASCII)[0]
        tail = re.search("[\"']*$", m)[0]
        return head + text(m[len(head):len(m) - len(tail)], kind) + tail
    if kind == "access_key":
        return m[:4] + text(m[4:], kind)
    if kind == "ip":
        y = number(int.from_bytes(map(int, m.split("."))), (65536, 65536), kind)
        return ".".join(map(str, y.to_bytes(4)))
    if kind == "date":
        day, order = a_date(m)
        moved = FIRST_DAY + datetime.timedelta(number((day - FIRST_DAY).days, (189, 773), kind))
        return written(m, moved, order)
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        area, group, serial = map(int, m.split("-"))
        rest = 99 * 9_999
        a, r = divmod(number(areas.index(area) * rest + (group - 1) * 9_999 + serial - 1, (898, rest), kind), rest)
        return f"{areas[a]:03d}-{r // 9_999 + 1:02d}-{r % 9_999 + 1:04d}"
    if kind == "card":
        head = text(digits[:-1], kind)
        return refill(m, head + next(c for c in "0123456789" if luhn(head + c) == 0))
    if kind == "phone":
        code = (re.match(r"\+[0-9]{1,3}(?=[ .(-])", m) or [""])[0]
        return code + refill(m[len(code):], text(re.sub("[^0-9]", "", m[len(code):]), kind))
    return m


def test_documents_equal_a_plain_version(spark):
    rng = random.Random(8)
    made = ["{:03d}-{:02d}-{:04d}".format(rng.randrange(1000), rng.randrange(100), rng.randrange(10_000)) for _ in range(300)]
    made += ["665-99-9999 667-01-0001 899-99-9999 001-01-0001 666-01-0001", "3.4.1999 13/12/2001 12/13/2001 03/04/2001 29.02.1900",
             "1.2.3.4 256.1.1.1 0.0.0.0, token = \"Ab 9\"; pwd:'q7'", "", None, "4041894974608795 " * 40]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 1_000, "text").toDF("doc_id", "text"))
    any_kind = re.compile(pii.ANY.replace(r"\h", BLANK), re.ASCII)
    new = {r.doc_id: r.text for r in pii.apply(table, n_chars=None).collect()}
    changed = 0
    for r in table.collect():
        want = r.text and any_kind.sub(lambda m: plain(m[0]), r.text)
        assert new[r.doc_id] == want, r.doc_id
        changed += want != r.text
    assert len(new) == table.count() and changed > 250  # a tenth of the made numbers is not valid


def test_social_security_numbers_stay_valid_and_distinct(spark):
    made = [divmod(x, 99 * 9_999) for x in range(0, 898 * 99 * 9_999, 400_009)]
    given = [f"{a + 1 + (a >= 665):03d}-{r // 9_999 + 1:02d}-{r % 9_999 + 1:04d}" for a, r in made]
    out = [r.text for r in pii.apply(spark.createDataFrame([(g,) for g in given], "text string")).collect()]
    assert {plain_kind(m) for m in given + out} == {"ssn"} and len(set(out)) == len(set(given)) > 2_000

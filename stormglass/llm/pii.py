"""Format-preserving pseudonyms for personal data, as SQL expressions only.

Numbers and dates that pass a validity check are replaced by a keyed permutation inside their
format, so that equal values stay equal in all documents, different values of one format stay
different, and the result passes the same check:

* card numbers (13 to 19 digits, Luhn): all digits but the last are permuted, the last is the
  new check digit; separators stay;
* dates (ISO, or day and month in either order with a four-digit year, 1800 to 2199): the
  day number is permuted among the 146,097 days of the 400 years;
* IPv4 addresses: permuted among all addresses;
* social security numbers: the area permuted among the 898 assigned ones and the rest among the
  989,901 pairs of a group and a serial number that are not zero, so the result is valid too;
* phone numbers (8 to 15 digits; a country code after + stays);
* the local part of mail addresses, access keys, and values after `password=` and the like, with
  or without blanks round the sign; quotes at the ends of a value stay: permuted character by
  character inside the classes 0-9, A-Z and a-z.

The permutations are Feistel networks of eight rounds with SHA-2 of key, kind, round and the
other half as round function. Strings are cut in two halves whose characters are shifted inside
their class; dates, addresses and social security numbers are two numbers that are shifted modulo
their ranges, so no cycle has to be walked to stay inside.

Defined cases: a null text stays null and has no finds; an empty text stays empty. A match that
fails its check stays as it is. Other columns pass through; rows are handled one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import keeps_columns

ROUNDS = 8
DEFAULT_KEY = "stormglass"

_NUMBER_END = r"(?![0-9A-Za-z])"
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET_HEAD = r"(?i:password|passwd|pwd|secret|api[_-]?key|token)[\"']?\h*+[=:]++>?\h*+"
# A closed quote may hold blanks; other values end at white space, a comma or a semicolon.
SECRET = (SECRET_HEAD + r"(?:\"[^\"\\\r\n]++\"|'[^'\\\r\n]++'" + _NUMBER_END
          + r"|[\"']*+[^\s,;\"'][^\s,;]*+)")
ACCESS_KEY = r"AKIA[0-9A-Z]{16}" + _NUMBER_END
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
DATE = (r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
        r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})" + _NUMBER_END)
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _NUMBER_END
CARD = r"(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})" + _NUMBER_END
PHONE = (r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
         r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + _NUMBER_END)
ANY = r"(?<![A-Za-z0-9])(?:" + "|".join((EMAIL, SECRET, ACCESS_KEY, IP, DATE, SSN, CARD, PHONE)) + ")"
KINDS = (("email", EMAIL), ("secret", SECRET), ("access_key", ACCESS_KEY), ("ip", IP),
         ("date", DATE), ("ssn", SSN), ("card", CARD), ("phone", PHONE))

_DAYS, _DAY_HALVES = 146_097, (189, 773)  # 189 * 773 = 146,097
_SSN_HALVES = (898, 99 * 9_999)  # areas 001 to 899 without 666; groups 01 to 99 with serials 0001 to 9999


def _number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def _digest(key: str, kind: str, round_no: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_no.cast("string"),
                              other.cast("string")), 512)


def _shifted(half: Column, digest: Column) -> Column:
    """Each character moved inside its class by its own part of the digest."""
    def one(p: Column) -> Column:
        c = F.substring(half, p, F.lit(1))
        by = _number(F.substring(digest, F.pmod(p - 1, F.lit(32)) * 4 + 1, F.lit(4))) + p
        def inside(first: str, size: int) -> Column:
            return F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + by, F.lit(size)))
        return (F.when(c.between("0", "9"), inside("0", 10))
                .when(c.between("A", "Z"), inside("A", 26))
                .when(c.between("a", "z"), inside("a", 26)).otherwise(c))
    return F.when(F.length(half) == 0, half).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), ""))


def permute_text(s: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with the same character classes."""
    h = F.floor((F.length(s) + 1) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), h).alias("l"),
                     F.substring(s, h + 1, F.length(s)).alias("r"))
    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        l, r = acc["l"], acc["r"]
        return F.struct(
            F.when(even, _shifted(l, _digest(key, kind, i, r))).otherwise(l).alias("l"),
            F.when(even, r).otherwise(_shifted(r, _digest(key, kind, i, l))).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step,
                       lambda a: F.concat(a["l"], a["r"]))


def permute_number(x: Column, halves: tuple[int, int], key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    a, b = halves
    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        l, r = acc["l"], acc["r"]
        by = lambda other: _number(F.substring(_digest(key, kind, i, other), 1, 12))
        return F.struct(
            F.when(even, F.pmod(l + by(r), F.lit(a))).otherwise(l).cast("bigint").alias("l"),
            F.when(even, r).otherwise(F.pmod(r + by(l), F.lit(b))).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step,
                       lambda s: s["l"] * b + s["r"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum from the right; `doubled_last`: doubling starts with the last digit."""
    def add(acc: Column, p: Column) -> Column:
        d = F.substring(digits, F.length(digits) - p + 1, F.lit(1)).cast("int")
        twice = (p % 2 == (1 if doubled_last else 0))
        return acc + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in turn, so separators do not take part in the permutation."""
    def one(p: Column) -> Column:
        c = F.substring(m, p, F.lit(1))
        at = F.length(_digits(F.substring(m, F.lit(1), p)))
        return F.when(c.between("0", "9"), F.substring(digits, at, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    head = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(head, True) % 10, F.lit(10)).cast("string")
    return _refill(m, F.concat(head, check))


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.cast("bigint"))
    out = permute_number(value, (65536, 65536), key, "ip")
    return F.array_join(F.transform(F.sequence(F.lit(3), F.lit(0), F.lit(-1)), lambda k: F.pmod(
        F.floor(out / F.pow(F.lit(256), k)), F.lit(256)).cast("bigint").cast("string")), ".")


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, size).cast("bigint") for at, size in ((1, 3), (5, 2), (8, 4)))
    rest = _SSN_HALVES[1]
    x = (area - F.when(area > 666, 2).otherwise(1)) * rest + (group - 1) * 9_999 + serial - 1
    def text(y: Column) -> Column:
        a, r = F.floor(y / rest).cast("bigint") + 1, F.pmod(y, F.lit(rest))
        return F.format_string("%03d-%02d-%04d", a + F.when(a > 665, 1).otherwise(0),
                               F.floor(r / 9_999).cast("bigint") + 1, F.pmod(r, F.lit(9_999)) + 1)
    # Through an array of one element, so that the permutation is worked out once.
    return F.transform(F.array(permute_number(x, _SSN_HALVES, key, "ssn")), text)[0]


def _read_date(m: Column, form: str) -> Column:
    d = F.try_to_date(m, form)
    return F.when(F.year(d).between(1800, 2199), d)


def _date(m: Column, key: str) -> Column:
    forms = (("yyyy-MM-dd", r"^[0-9]{4}-"), ("dd.MM.yyyy", r"^[0-9]{2}\.[0-9]{2}\."), ("d.M.yyyy", r"\."),
             ("dd/MM/yyyy", "^[0-9]{2}/[0-9]{2}/"), ("d/M/yyyy", "/"),
             ("MM/dd/yyyy", "^[0-9]{2}/[0-9]{2}/"), ("M/d/yyyy", "/"))
    first = F.lit("1800-01-01").cast("date")
    tries = []
    for form, shape in forms:
        d = F.when(m.rlike(shape), _read_date(m, form))
        x = permute_number(F.datediff(d, first).cast("bigint"), _DAY_HALVES, key, "date")
        tries.append(F.when(d.isNotNull(), F.date_format(F.date_add(first, x.cast("int")), form)))
    return F.coalesce(*tries, m)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _refill(rest, permute_text(_digits(rest), key, "phone")))


def kind_of(m: Column) -> Column:
    """The kind of a match, or null if it fails its check."""
    digits = _digits(m)
    checks = {
        "ip": F.forall(F.split(m, r"\."), lambda p: p.cast("int") <= 255),
        "date": F.coalesce(*[_read_date(m, f) for f in ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy")]).isNotNull(),
        "ssn": ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "card": F.length(digits).between(13, 19) & (luhn_sum(digits, False) % 10 == 0),
        "phone": F.length(digits).between(8, 15)}
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        ok = F.when(checks[kind], F.lit(kind)) if kind in checks else F.lit(kind)
        # A match that fails the check of one kind may still be of a later kind.
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.coalesce(ok, out)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    at = F.instr(m, "@")
    sign = F.length(F.regexp_extract(m, f"^{SECRET_HEAD}[\"']*", 0))
    end = F.length(F.regexp_extract(m, "[\"']*$", 0))
    inner = F.substring(m, sign + 1, F.length(m) - sign - end)
    tail = lambda n: F.substring(m, n + 1, F.length(m))
    return (F.when(kind == "email", F.concat(permute_text(F.substring(m, F.lit(1), at - 1), key, "email"),
                                             F.substring(m, at, F.length(m))))
            .when(kind == "secret", F.concat(F.substring(m, F.lit(1), sign), permute_text(inner, key, "secret"),
                                               F.substring(m, F.length(m) - end + 1, end)))
            .when(kind == "access_key", F.concat(F.substring(m, 1, 4), permute_text(tail(F.lit(4)), key, "access_key")))
            .when(kind == "ip", _ip(m, key))
            .when(kind == "date", _date(m, key))
            .when(kind == "ssn", _ssn(m, key))
            .when(kind == "card", _card(m, key))
            .when(kind == "phone", _phone(m, key))
            .otherwise(m))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with `_found`: array of (value, kind) of the valid and invalid matches."""
    hits = F.when(F.col(text).rlike("[0-9@=:]"), F.regexp_extract_all(text, F.lit(ANY), 0))
    return docs.withColumn("_found", F.transform(
        hits, lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind"))))


@keeps_columns("_found")
def apply(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY,
          n_chars: str | None = "n_chars", counts: bool = False) -> DataFrame:
    """The documents with pseudonyms; `counts` adds `n_<kind>` columns."""
    found = find(docs, text)
    new = F.transform("_found", lambda f: pseudonym(f["value"], f["kind"], key))
    parts = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(
        parts, new, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    out = found.withColumn(text, F.when(F.size("_found") > 0, joined).otherwise(F.col(text)))
    if n_chars and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.size("_found") > 0, F.length(text).cast(kind))
                             .otherwise(F.col(n_chars)))
    if counts:
        def number_of(kind: str) -> Column:
            return F.coalesce(F.size(F.filter("_found", lambda f: f["kind"] == kind)), F.lit(0))
        out = out.withColumns({f"n_{kind}": number_of(kind).cast("long") for kind, _ in KINDS})
    return out.drop("_found")

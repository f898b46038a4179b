"""Format-preserving pseudonyms of personal numbers, dates and addresses (DataFrame functions only).

Values that validate are permuted within their own format by a keyed Feistel network,
so equal values become equal pseudonyms in every document and no table of them is
kept. The round function is SHA-256 of key, kind, round and the other half.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

ROUNDS = 6
#: Where a cluster's configuration names the key.
KEY_SETTING = "spark.framelake.pii.key"
#: The query's own key where none is configured, so that its result is the same everywhere. No secret: real data needs one.
TEST_KEY = "the key of the query op2_pii, for tests alone"
#: Kinds in the order in which they are tried at a place in the text. ``card`` is a run of digits that may hold a card. Its repetition
#: has no bound, so it is possessive (it never has to give back): Java's matcher calls itself for each turn of any other.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9])",
    "day_first": r"(?<![0-9./])[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}(?![0-9])",
    "slashed": r"(?<![0-9./])[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}(?![0-9/])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,5}){1,4}(?![0-9])",
    "local_phone": r"(?<![0-9+\-.])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9]|[.\-][0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,}+(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Lengths of card numbers, the commonest first.
CARD_DIGITS = (16, 15, 14, 13, 19, 18, 17)
#: Country codes by their first digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Dates are permuted within the 270 * 271 days from this one on (to 2100-05-02).
FIRST_DAY, DAY_A, DAY_B = "1900-01-01", 270, 271
#: Area numbers of social security numbers are 1 to 899 but for this one.
NO_AREA = 666


@functools.cache
def _own_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key of ``KEY_SETTING``; where that is unset a random one, so that pseudonyms of two sessions have nothing in common."""
    return spark.conf.get(KEY_SETTING, None) or _own_key()


def _secret(key: str, kind: str) -> str:
    """The key of one kind. Plans hold only such keys, from which the key itself does not follow."""
    if not key:
        raise ValueError("a key is needed")
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _shift(half: Column, digest: Column, sign: int) -> Column:
    """Each digit or letter moved within its class by a digit of the digest; others stay."""
    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, F.pmod(i * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int") * sign
        digit = F.pmod(F.ascii(c) - 48 + by, F.lit(10)).cast("string")
        letter = lambda a, base: F.substring(F.lit(a), F.pmod(F.ascii(c) - base + by, F.lit(26)) + 1, F.lit(1))
        return F.when(c.between("0", "9"), digit).when(c.between("a", "z"), letter(_LETTERS, 97)).when(c.between("A", "Z"), letter(_LETTERS.upper(), 65)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), one), "")


def _singles(secret: str) -> str:
    """Letters and digits, each class in a keyed order."""
    return "".join("".join(sorted(c, key=lambda x: hashlib.sha256(f"{secret}{x}".encode()).digest())) for c in (_LETTERS, _LETTERS.upper(), "0123456789"))


def feistel_text(value: Column, secret: Column, singles: Column, inverse: bool = False) -> Column:
    """Permutes strings of equal shape: letters and digits change within their class and place.

    A single character, of which a network would have an empty half, becomes the next in the keyed order ``singles``.
    """
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        digest = F.sha2(F.concat(secret, F.lit("|"), i.cast("string"), F.lit("|"), F.when(even, acc["r"]).otherwise(acc["l"])), 256)
        moved = _shift(F.when(even, acc["l"]).otherwise(acc["r"]), digest, -1 if inverse else 1)
        return F.struct(F.when(even, moved).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(moved).alias("r"))

    rounds = list(range(ROUNDS))
    end = F.aggregate(F.array(*[F.lit(i) for i in (rounds[::-1] if inverse else rounds)]), start, step, lambda acc: F.concat(acc["l"], acc["r"]))
    turned = F.concat(*[F.concat(F.substring(singles, at + 1, n - 1), F.substring(singles, at, 1)) for at, n in ((1, 26), (27, 26), (53, 10))])
    single = F.call_function("translate", value, turned, singles) if inverse else F.call_function("translate", value, singles, turned)
    return F.when(F.length(value) == 1, single).otherwise(end)


def feistel_number(value: Column, a: Column, b: Column, secret: Column, inverse: bool = False) -> Column:
    """Permutes 0 .. a*b-1: the two parts are moved in turn by a keyed function of the other."""
    sign = -1 if inverse else 1

    def step(acc: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        digest = F.sha2(F.concat(secret, F.lit("|"), i.cast("string"), F.lit("|"), F.when(even, acc["r"]).otherwise(acc["l"]).cast("string")), 256)
        by = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") * sign
        return F.struct(F.when(even, F.pmod(acc["l"] + by, a)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + by, b)).alias("r"))

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))
    rounds = list(range(ROUNDS))
    return F.aggregate(F.array(*[F.lit(i) for i in (rounds[::-1] if inverse else rounds)]), start, step, lambda acc: acc["l"] * b + acc["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum; the last digit counts once."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _card(run: Column) -> Column:
    """The card number in a run of digits: the first part, by ``CARD_DIGITS`` and place, that starts and ends at a
    group's edge and has a right Luhn sum; null without one."""
    parts = F.concat(*[F.regexp_extract_all(run, F.lit(rf"(?=(?<![0-9])([0-9](?:[ \-]?[0-9]){{{n - 1}}})(?![0-9]))"), F.lit(1)) for n in CARD_DIGITS])
    return F.get(F.filter(parts, lambda c: F.pmod(luhn_sum(_digits(c)), F.lit(10)) == 0), F.lit(0))


def _mod97(iban: Column) -> Column:
    """The number of an IBAN, country and check digits last, modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    digit = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + digit(c), F.lit(97)))


def _day(date: Column) -> Column:
    return F.datediff(date, F.to_date(F.lit(FIRST_DAY)))


def _date(kind: str, value: Column) -> Column:
    """The date of a value; one with slashes is month/day/year if that is a date."""
    if kind == "date":
        return F.try_to_date(value, "yyyy-MM-dd")
    if kind == "day_first":
        return F.try_to_date(value, "d.M.yyyy")
    return F.coalesce(F.try_to_date(value, "M/d/yyyy"), F.try_to_date(value, "d/M/yyyy"))


def valid(kind: str, value: Column) -> Column:
    if kind == "card":
        return _card(value).isNotNull()
    if kind == "ipv4":
        return F.forall(F.split(value, r"\."), lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))
    if kind in ("date", "day_first", "slashed"):
        return F.coalesce(_day(_date(kind, value)).between(0, DAY_A * DAY_B - 1), F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(7, 15)
    if kind == "ssn":
        area, group, serial = (F.substring(value, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
        return area.between(1, 899) & (area != NO_AREA) & (group > 0) & (serial > 0)
    if kind == "iban":
        return _mod97(value) == 1
    return F.lit(True)


#: Kinds that are permuted as numbers below a * b, by the kind whose key they share, and as text.
NUMBERS = {"date": ("date", DAY_A, DAY_B), "day_first": ("date", DAY_A, DAY_B), "slashed": ("date", DAY_A, DAY_B), "ipv4": ("ipv4", 1 << 16, 1 << 16), "ssn": ("ssn", 898 * 99, 9999)}
TEXTS = ("email", "iban", "phone", "local_phone", "card")


def _number(kind: str, value: Column) -> Column:
    """A value of a kind of ``NUMBERS`` as a number."""
    if kind == "ipv4":
        return F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    if kind == "ssn":
        area, group, serial = (F.substring(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
        return ((area - 1 - (area > NO_AREA).cast("int")) * 99 + group - 1) * 9999 + serial - 1
    return _day(_date(kind, value)).cast("long")


def _written(kind: str, value: Column, n: Column) -> Column:
    """A number in the format of ``value``."""
    if kind == "ipv4":
        return F.concat_ws(".", *[F.pmod(F.shiftrightunsigned(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    if kind == "ssn":
        high = F.floor(n / (99 * 9999)) + 1
        return F.format_string("%03d-%02d-%04d", (high + (high >= NO_AREA).cast("int")).cast("int"), (F.pmod(F.floor(n / 9999), F.lit(99)) + 1).cast("int"), (F.pmod(n, F.lit(9999)) + 1).cast("int"))
    date = F.date_add(F.to_date(F.lit(FIRST_DAY)), n.cast("int"))
    if kind == "date":
        return F.date_format(date, "yyyy-MM-dd")
    if kind == "day_first":
        return F.date_format(date, "dd.MM.yyyy")
    return F.when(F.try_to_date(value, "M/d/yyyy").isNotNull(), F.date_format(date, "MM/dd/yyyy")).otherwise(F.date_format(date, "dd/MM/yyyy"))


def _body(kind: str, value: Column) -> Column:
    """The characters of a value of a kind of ``TEXTS`` that are permuted."""
    if kind == "email":
        return F.substring_index(value, "@", 1)
    if kind == "iban":
        return F.substring(F.replace(value, F.lit(" "), F.lit("")), F.lit(5), F.length(value))
    if kind == "phone":
        return _digits(F.regexp_replace(value, COUNTRY, ""))
    if kind == "card":
        return F.regexp_replace(_digits(_card(value)), ".$", "")
    return _digits(value)


def _assembled(kind: str, value: Column, body: Column) -> Column:
    """``value`` with its permuted characters; check digits are made right again and separators stay in their places."""
    if kind == "email":
        return F.concat(body, F.lit("@"), F.substring_index(value, "@", -1))
    if kind == "iban":
        check = F.lit(98) - _mod97(F.concat(F.left(value, F.lit(2)), F.lit("00"), body))
        return _refill(value, F.concat(F.left(value, F.lit(2)), F.lpad(check.cast("string"), 2, "0"), body), "[A-Z0-9]")
    if kind == "phone":
        # the country code stays, and equal numbers written differently stay equal
        country = F.regexp_extract(value, COUNTRY, 0)
        return F.concat(country, _refill(F.substring(value, F.length(country) + 1, F.length(value)), body))
    if kind == "card":
        check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        return let(_card(value), lambda card: F.overlay(value, _refill(card, F.concat(body, check)), F.call_function("instr", value, card), F.length(card)))
    return _refill(value, body)


def _chosen(kind: Column, made: dict[str, Column]) -> Column:
    out = None
    for k, c in made.items():
        out = F.when(kind == k, c) if out is None else out.when(kind == k, c)
    return out


def pseudonym(kind: Column, value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a value of the given kind, valid in the same format; ``inverse`` gives the value back.

    Dates of all formats move alike, so that one date stays linked however it is written; days and months
    get two digits. A date that can only be day/month/year may get a pseudonym that reads as month/day/year, which
    ``inverse`` takes for that. Mail domains and country codes stay.
    """
    secret = {k: _secret(key, k) for k in (*TEXTS, *(s for s, _, _ in NUMBERS.values()))}
    of = lambda f: _chosen(kind, {k: f(k) for k in NUMBERS})
    limit = lambda i: of(lambda k: F.lit(NUMBERS[k][i]).cast("long"))
    number = let(of(lambda k: _number(k, value)), lambda x: let(feistel_number(x, limit(1), limit(2), of(lambda k: F.lit(secret[NUMBERS[k][0]])), inverse), lambda n: of(lambda k: _written(k, value, n))))
    by = lambda f: _chosen(kind, {k: f(k) for k in TEXTS})
    permuted = lambda x: feistel_text(x, by(lambda k: F.lit(secret[k])), by(lambda k: F.lit(_singles(secret[k]))), inverse)
    text = let(by(lambda k: _body(k, value)), lambda x: let(permuted(x), lambda body: by(lambda k: _assembled(k, value, body))))
    return F.when(kind.isin(*NUMBERS), number).when(kind.isin(*TEXTS), text).otherwise(value)


def _refill(shape: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """``digits`` in the places of the digits, or of other characters of one kind, of ``shape``."""
    def step(acc: Column, c: Column) -> Column:
        fits = c.rlike(kind) if kind != "[0-9]" else c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(fits, F.substring(digits, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["n"] + fits.cast("int")).alias("n"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step)["out"]


def kind_of(value: Column) -> Column:
    """The first kind whose pattern the whole value fits and that validates; null without one."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.when(valid(kind, value), F.lit(kind))).otherwise(out)
    return out


def replaced(value: Column, key: str) -> Column:
    """The pseudonym of a value of any kind; other values as they are."""
    return let(kind_of(value), lambda kind: pseudonym(kind, value, key))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and their number in the column ``count``, which replaces one of that name.

    The text is split at the matches and joined again around their pseudonyms; what
    does not validate stays as it is. Null text stays null with 0 replaced; empty and
    very long texts, repeated rows and an empty table are no special cases. All other
    columns stay. The table is read once and not shuffled.
    """
    none = F.array().cast("array<string>")
    # only texts with a digit or an @ before them are searched
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)

    def joined(found: Column) -> Column:
        def around(made: Column) -> Column:
            pairs = F.zip_with(F.split(text, ANY, -1), made, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            changed = F.size(F.filter(F.zip_with(found, made, lambda a, b: a != b), lambda x: x))
            return F.struct(F.array_join(pairs, "").alias("text"), changed.cast("long").alias("n"))

        kept = F.struct(F.col(text).alias("text"), F.lit(0).cast("long").alias("n"))
        return F.when(F.size(found) > 0, let(F.transform(found, lambda v: replaced(v, key)), around)).otherwise(kept)

    rest = [c for c in docs.columns if c not in (text, count)]
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row") if rest else F.lit(None).alias("row"), let(F.coalesce(found, none), joined).alias("made"))
    return made.select(*[F.col("made.text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != count], F.col("made.n").alias(count))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal numbers, dates and addresses replaced, under the configured key or else ``TEST_KEY``."""
    docs = read_table(spark, sf_dir, "documents")
    return pseudonymised(docs, spark.conf.get(KEY_SETTING, TEST_KEY)).select("doc_id", "text", "n_replaced")


QUERIES = {"op2_pii": op2_pii}
ORACLE_SQL: dict[str, str] = {}

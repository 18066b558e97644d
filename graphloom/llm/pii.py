"""Format-preserving pseudonyms for personal data, by DataFrame functions only.

One pattern finds candidates of all kinds; a text is split at its matches, each
match is validated (Luhn, octets, calendar, number plan) and replaced, and the
pieces are joined again. Numbers and dates go through a keyed Feistel network
over the exact domain of their format: a value is a pair (x mod a, y mod b), and
eight rounds add SHA-256 of key, format, round and one half to the other. The
network is a permutation of the domain, so equal values get equal pseudonyms in
every document, different values of a format different ones, and formats stay
valid:

* payment card: 13 to 19 digits with a correct check digit; so is the pseudonym's.
  Where a match with its neighbouring numbers fails the check, a run of its digit
  groups that passes is the card
* IPv4 address: four octets
* phone number: North American with area and exchange from 200, others by digits
* social security number: nine digits as 3-2-4
* date: ISO, dd.mm.yyyy or mm/dd/yyyy, from 1800 to 2199, the 146,097 days of a
  Gregorian cycle; a date in slashes that only reads as dd/mm/yyyy has a day above
  12, and is permuted among these 88,497 dates, so its pseudonym reads so too

The key comes from the caller; whoever has it can invert the permutations. An
e-mail address has no numeric format; it gets a keyed hash as local part in a
reserved domain. Candidates that fail validation stay as they are. A null text
stays null, an empty one empty, an empty table gives an empty result. Repeated
rows get the same text each. All steps are linear in the text; patterns only
start at token starts and don't backtrack over long runs. Where patterns match
equally the first of ``KINDS`` counts. Extra columns of any name pass through
``pseudonymize_documents`` and aren't read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting of the session that holds the key.
KEY_SETTING = "spark.graphloom.pii.key"
ROUNDS = 8
FIRST_DAY, MONTHS = "1800-01-01", 400 * 12
#: All days of a Gregorian cycle, 189 * 773, and those after the 12th of a month, 9 * 9833.
ALL_DAYS, LATE_DAYS = (189, 773), (9, 9833)
KINDS = ("email", "ip", "date", "ssn", "phone", "card")

# Java matches repeated groups by recursion unless they are possessive, so each turn takes the labels up to the next one that may end the domain
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.(?:(?![A-Za-z]{2})[A-Za-z0-9-]++\.)*+(?=[A-Za-z]{2}))++[A-Za-z]{2,}"
IP = r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])"
DATE = r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?![\w/-]|\.[0-9])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
PHONE = r"(?<![\w+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)"
CARD = r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"
ANY = "|".join((EMAIL, IP, DATE, SSN, PHONE, CARD))


def key_of(spark: SparkSession) -> str:
    """The key of the session's settings; there is no default."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"{KEY_SETTING} must hold the key of the pseudonyms")
    return key


def _keyed(key: str, *parts: Column) -> Column:
    """Keyed hash as 60 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: Column, x: Column, y: Column, a: Column, b: Column) -> Column:
    """struct(l, r): the pair (x mod a, y mod b) permuted under the key."""
    half = lambda v: v.cast("long")

    def round_(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, half(a)).otherwise(half(b))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(_keyed(key, kind, i, s["r"]), size), size).alias("r"))

    start = F.struct(half(x).alias("l"), half(y).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 18 digits permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    halves = feistel(
        key, F.concat(F.lit(kind), n.cast("string")),
        F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, n).cast("long"), _power(u), _power(n - u),
    )
    pad = lambda v, m: F.lpad(v.cast("string"), m.cast("int"), F.lit("0"))
    return F.transform(F.array(halves), lambda h: F.concat(pad(h["l"], u), pad(h["r"], n - u)))[0]


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in turn."""
    place = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i + 1)))
    fill = F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c))
    return F.array_join(fill, "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def card(key: str, m: Column) -> Column:
    def checked(body: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(body, c.cast("string")))
        return F.filter(tries, lambda t: F.call_function("luhn_check", t))[0]

    def permuted(s: Column, d: Column) -> Column:
        return _let(permute_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1)), lambda body: _refill(s, checked(body)))

    def whole(s: Column) -> Column:
        return _let(_digits(s), lambda d: F.when(F.call_function("luhn_check", d), permuted(s, d)))

    def part(groups: Column) -> Column:
        """The first run of whole groups that is a card, by its start and then the longest, with the rest of the match around it."""
        n = F.size(groups)
        text = lambda i, k: F.array_join(F.slice(groups, i, k), "")
        runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(n - i + 1, F.lit(1), F.lit(-1)), lambda k: F.struct(i.alias("i"), k.alias("k")))))
        valid = lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d)
        found = F.filter(runs, lambda r: valid(_digits(text(r["i"], r["k"]))))
        around = lambda r: F.concat(text(F.lit(1), r["i"] - 1), whole(text(r["i"], r["k"])), text(r["i"] + r["k"], n))
        return F.get(F.transform(F.slice(found, 1, 1), around), F.lit(0))

    return F.coalesce(whole(m), F.when(m.rlike("[ -]"), _let(F.split(m, "(?=[ -])"), part)))


def ip(key: str, m: Column) -> Column:
    def permuted(o: Column) -> Column:
        n = F.transform(o, lambda v: v.cast("long"))
        pair = feistel(key, F.lit("ip"), n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536))
        octets = lambda h: F.concat_ws(".", *[F.floor(v / 256).cast("string") if k == 0 else (v % 256).cast("string") for v in (h["l"], h["r"]) for k in (0, 1)])
        return F.when(F.forall(n, lambda v: v < 256), _let(pair, octets))

    return _let(F.split(m, r"\."), permuted)


def date(key: str, m: Column) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    number = lambda fmt: F.datediff(F.try_to_timestamp(m, F.lit(fmt)).cast("date"), first)
    month_start = lambda k: F.datediff(F.add_months(first, k.cast("int")), first)

    def permuted(n: Column, kind: str, size: tuple[int, int]) -> Column:
        """``n`` permuted among ``size[0] * size[1]`` numbers."""
        pair = feistel(key, F.lit(kind), F.floor(n / size[1]), n % size[1], F.lit(size[0]), F.lit(size[1]))
        return _let(pair, lambda h: h["l"] * size[1] + h["r"])

    def in_format(fmt: str) -> Column:
        def of(n: Column) -> Column:
            back = F.date_format(F.date_add(first, permuted(n, "date", ALL_DAYS).cast("int")), fmt)
            return F.when((n >= 0) & (n < ALL_DAYS[0] * ALL_DAYS[1]), back)

        return _let(number(fmt), of)

    def late_in_format(fmt: str) -> Column:
        """Dates after the 12th are numbered without the first twelve days of each month."""

        def back(rank: Column) -> Column:
            # months have 16 to 19 late days, on average 18.44; the guess is less than two months off
            guess = F.floor(rank * MONTHS / (LATE_DAYS[0] * LATE_DAYS[1]))
            months = F.filter(F.sequence(F.greatest(guess - 2, F.lit(0)), F.least(guess + 2, F.lit(MONTHS - 1))), lambda k: month_start(k) - 12 * k <= rank)
            return _let(F.array_max(months), lambda k: F.date_format(F.date_add(first, (rank + 12 * (k + 1)).cast("int")), fmt))

        def of(n: Column) -> Column:
            day = F.date_add(first, n)
            months = (F.year(day) - 1800) * 12 + F.month(day)
            rank = permuted(n - 12 * months, "late-date", LATE_DAYS)
            return F.when((n >= 0) & (n < ALL_DAYS[0] * ALL_DAYS[1]), _let(rank, back))

        return _let(number(fmt), of)

    slashed = F.coalesce(in_format("MM/dd/yyyy"), late_in_format("dd/MM/yyyy"))
    return F.when(m.contains("-"), in_format("yyyy-MM-dd")).when(m.contains("."), in_format("dd.MM.yyyy")).when(m.contains("/"), slashed)


def phone(key: str, m: Column) -> Column:
    """North American numbers keep leading digits from 2; the country code stays."""

    def north_american(d: Column) -> Column:
        n = F.substring(d, -10, 10)
        area, local = F.substring(n, 1, 3).cast("long"), F.substring(n, 4, 7).cast("long")
        pair = feistel(key, F.lit("nanp"), area - 200, local - 2_000_000, F.lit(800), F.lit(8_000_000))
        text = lambda h: _refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), (h["l"] + 200).cast("string"), (h["r"] + 2_000_000).cast("string")))
        return _let(pair, text)

    def other(d: Column) -> Column:
        keep = F.length(_digits(F.regexp_extract(m, r"^(\+[0-9]{1,3})[^0-9]", 1)))
        return _refill(m, F.concat(F.substring(d, F.lit(1), keep), permute_digits(key, "phone", F.substring(d, keep + 1, F.length(d)))))

    plan = lambda d: d.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$")
    return _let(_digits(m), lambda d: F.when(plan(d), north_american(d)).when(F.length(d).between(8, 15), other(d)))


def ssn(key: str, m: Column) -> Column:
    return _refill(m, permute_digits(key, "ssn", _digits(m)))


def email(key: str, m: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def replace_match(key: str, m: Column) -> Column:
    """struct(kind, value) for a match; both are null if it fails validation."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    found = F.lit(None)
    for kind, test, make in reversed(
        [("email", m.contains("@"), email), ("ip", whole(IP), ip), ("date", whole(DATE), date), ("ssn", whole(SSN), ssn), ("phone", whole(PHONE), phone), ("card", F.lit(True), card)]
    ):
        found = F.when(test, F.struct(F.lit(kind).alias("kind"), make(key, m).alias("value"))).otherwise(found)
    return found


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``new_text`` and ``found`` (array of kind and value for each match)."""
    text = F.col("row.text")
    candidates = F.when(text.contains("@") | text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    df = docs.select(F.struct("*").alias("row")).withColumn("matches", candidates)
    some = F.size("matches") > 0
    df = df.withColumn("found", F.when(some, F.transform("matches", lambda m: replace_match(key, m))))
    values = F.zip_with("matches", "found", lambda m, f: F.coalesce(f["value"], m))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    return df.select("row", F.when(some, joined).otherwise(text).alias("new_text"), "found")


def pii_digest(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text`` with pseudonyms, and the number of each kind."""
    df = pseudonymize(docs.select("doc_id", "text"), key)
    of = lambda kind: F.coalesce(F.size(F.filter("found", lambda f: (f["kind"] == kind) & f["value"].isNotNull())), F.lit(0))
    counts = [F.when(F.col("found").isNull(), 0).otherwise(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("row.doc_id", F.col("new_text").alias("text"), *counts)


def pseudonymize_documents(docs: DataFrame, key: str) -> DataFrame:
    """The documents with pseudonyms in ``text`` and its length in ``n_chars``."""
    row = F.col("row").withField("text", F.col("new_text"))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("found") > 0, F.length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", changed)
    return pseudonymize(docs, key).select(row.alias("row")).select("row.*")

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import pii

KEY = "k"

TEXT = "Mail a.b@x.example.com or 4785380592391139, 4785 3805 9239 1139, 1234567890123456 ip 10.0.0.1 999.1.1.1 on 2024-02-29, 31.12.1999, 02/30/2020. +1 (988) 555-2485 ssn 123-45-6789 v4.0.1 end"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_values_are_linked_and_formats_stay(make_docs):
    a, b, c, d = (r.text for r in pii.pii_digest(make_docs([TEXT, "x " + TEXT, None, ""]), KEY).orderBy("doc_id").collect())
    assert b == "x " + a and c is None and d == ""
    for gone in ("a.b@x.example.com", "4785380592391139", "4785 3805 9239 1139", "10.0.0.1", "2024-02-29", "31.12.1999", "(988) 555-2485", "123-45-6789"):
        assert gone in TEXT and gone not in a
    for stays in ("1234567890123456", "999.1.1.1", "02/30/2020", "v4.0.1 end", "+1 ("):
        assert stays in a
    words = a.split()
    assert luhn(words[3].strip(",")) and words[3].strip(",") == "".join(words[4:8]).strip(",")


def test_feistel_is_a_permutation_and_keyed(spark):
    a, b = 13, 17
    df = spark.range(a * b).select(F.floor(F.col("id") / b).alias("x"), (F.col("id") % b).alias("y"))
    images = lambda key: [tuple(r.p) for r in df.select("x", "y", pii.feistel(key, F.lit("t"), F.col("x"), F.col("y"), F.lit(a), F.lit(b)).alias("p")).orderBy("x", "y").collect()]
    one = images("k1")
    assert len(set(one)) == a * b and all(0 <= l < a and 0 <= r < b for l, r in one)
    assert one != images("k2")


def test_clean_texts_columns_and_empty_tables(make_docs):
    docs = make_docs(["no data at all", "version 4.0. and 12 eggs", "x" * 200_000]).withColumns({"matches": F.lit(1), "row": F.lit(2), "found": F.lit(3)})
    out = pii.pseudonymize_documents(docs, KEY)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()}
    assert pii.pii_digest(docs.limit(0), KEY).count() == 0


def test_long_runs(make_docs):
    texts = ["x@" + "a." * 100_000, "1" * 200_000, "1." * 100_000, "1-" * 100_000, "+" * 100_000, "a@" * 50_000, "(" * 100_000]
    assert pii.pii_digest(make_docs(texts), KEY).count() == len(texts)
    assert pii.pii_digest(make_docs(texts), KEY).agg({"n_card": "sum", "text": "max"}).count() == 1


def test_cards_beside_numbers(make_docs):
    card = "4111 1111 1111 1111"
    texts = [card, f"{card} 123", f"{card} 12/27", f"{card.replace(' ', '-')} 12/27", f"12 {card} x", "4111111111111111 123", "1234567890123456 12"]
    rows = pii.pii_digest(make_docs(texts), KEY).orderBy("doc_id").collect()
    new = rows[0].text
    assert new != card and luhn(new)
    dashed, plain = new.replace(" ", "-"), new.replace(" ", "")
    assert [r.text for r in rows] == [new, f"{new} 123", f"{new} 12/27", f"{dashed} 12/27", f"12 {new} x", f"{plain} 123", "1234567890123456 12"]
    assert [r.n_card for r in rows] == [1] * 6 + [0]


def test_domains_of_any_length(make_docs):
    texts = ["u@a.b.c.d.e.f.g.h.i.j.k.l.example.com", "u@" + "ab." * 50_000 + "com", "u@b.com.123 x", "u@b.com9", "u@b..com", "u@x.1.2.3.org.", "u@b.c0m"]
    out = [r.text for r in pii.pii_digest(make_docs(texts), KEY).orderBy("doc_id").collect()]
    user = r"user-[0-9a-f]{16}@mail\.invalid"
    for text, want in zip(out, (user, user, user + r"\.123 x", user + "9", r"u@b\.\.com", user + r"\.", r"u@b\.c0m"), strict=True):
        assert re.fullmatch(want, text)


def slow_feistel(kind, x, y, a, b):
    """The network by hashlib."""
    for i in range(8):
        size = b if i % 2 else a
        x, y = y, (x + int(hashlib.sha256(f"{KEY}|{kind}|{i}|{y}".encode()).hexdigest()[:15], 16)) % size
    return x, y


FIRST = datetime.date(1800, 1, 1)


def slow_date(text):
    """The pseudonym of a date in slashes or ISO format."""
    for fmt in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y"):
        try:
            day = datetime.datetime.strptime(text, fmt).date()
        except ValueError:
            continue
        break
    if fmt != "%d/%m/%Y":
        x, y = slow_feistel("date", *divmod((day - FIRST).days, 773), 189, 773)
        return (FIRST + datetime.timedelta(773 * x + y)).strftime(fmt)
    late = [FIRST + datetime.timedelta(n) for n in range(146_097) if (FIRST + datetime.timedelta(n)).day > 12] if not LATE else LATE
    LATE[:] = late
    x, y = slow_feistel("late-date", *divmod(late.index(day), 9833), 9, 9833)
    return late[9833 * x + y].strftime(fmt)


LATE = []


def test_values_against_brute_force(make_docs):
    """Networks written with hashlib."""
    dates = ["1800-01-01", "2199-12-31", "2199-11-05", "02/29/2024", "12/31/1999", "01/02/2003", "13/01/1800", "31/12/2199", "29/02/2024", "25/12/1950", "13/02/1999"]
    out = [r.text for r in pii.pii_digest(make_docs(dates), KEY).orderBy("doc_id").collect()]
    assert out == [slow_date(d) for d in dates]
    a, b = slow_feistel("ip", 10 * 256 + 1, 2 * 256 + 3, 65536, 65536)
    x, y = slow_feistel("ssn9", 1234, 56789, 10**4, 10**5)
    area, local = slow_feistel("nanp", 988 - 200, 5552485 - 2_000_000, 800, 8_000_000)
    digits = f"{x:04}{y:05}"
    texts = ["10.1.2.3", "123-45-6789"]
    out = [r.text for r in pii.pii_digest(make_docs(texts), KEY).orderBy("doc_id").collect()]
    assert out == [f"{a // 256}.{a % 256}.{b // 256}.{b % 256}", f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"]
    phone = pii.pii_digest(make_docs(["(988) 555-2485"]), KEY).first().text
    local += 2_000_000
    assert phone == f"({area + 200}) {local // 10_000}-{local % 10_000:04}"


@pytest.mark.parametrize("shape", ["yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"])
def test_dates_are_permuted(spark, shape):
    """All days from 1800 to 2199: different dates get different ones, and slashed ones of both readings don't meet."""
    day = F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int"))
    dates = spark.range(146_097).select(F.date_format(day, shape).alias("text"))
    if shape == "dd/MM/yyyy":
        dates = dates.filter("text > '13'").unionAll(spark.range(146_097).select(F.date_format(day, "MM/dd/yyyy")))
    out = dates.select("text", pii.date(KEY, F.col("text")).alias("new"))
    n, distinct, same, nulls = out.agg(F.count("new"), F.count_distinct("new"), F.count(F.when(F.col("new") == F.col("text"), 1)), F.count(F.when(F.col("new").isNull(), 1))).first()
    assert n == distinct == dates.count() and same < 10 and not nulls
    assert not out.select("new").exceptAll(dates).count()


def test_the_key_has_no_default(spark, make_docs):
    with pytest.raises(ValueError, match="key"):
        pii.key_of(spark)
    docs = make_docs(["on 2024-02-29", "on 2024-02-29"], ids=[1, 1])
    one, two = ([r.text for r in pii.pii_digest(docs, k).collect()] for k in "ab")
    assert len(set(one)) == 1 and one != two


def slow_digits(kind, digits):
    u = len(digits) // 2
    x, y = slow_feistel(f"{kind}{len(digits)}", int(digits[:u]), int(digits[u:]), 10**u, 10 ** (len(digits) - u))
    return f"{x:0{u}}{y:0{len(digits) - u}}"


def refill(shape, digits):
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def slow_card(m):
    pieces = re.split("(?=[ -])", m)
    for runs in ([(0, len(pieces))], [(i, k) for i in range(len(pieces)) for k in range(len(pieces), i, -1)]):
        for i, k in runs:
            part = "".join(pieces[i:k])
            digits = re.sub("[^0-9]", "", part)
            if 13 <= len(digits) <= 19 and luhn(digits):
                body = slow_digits("card", digits[:-1])
                return "".join(pieces[:i]) + refill(part, body + next(c for c in "0123456789" if luhn(body + c))) + "".join(pieces[k:])
    return m


def slow_phone(m):
    d = re.sub("[^0-9]", "", m)
    if re.fullmatch("1?[2-9][0-9]{2}[2-9][0-9]{6}", d):
        x, y = slow_feistel("nanp", int(d[-10:-7]) - 200, int(d[-7:]) - 2_000_000, 800, 8_000_000)
        return refill(m, d[:-10] + str(x + 200) + str(y + 2_000_000))
    if not 8 <= len(d) <= 15:
        return m
    code = re.match(r"\+[0-9]{1,3}(?=[^0-9])", m)
    keep = len(code[0]) - 1 if code else 0
    return refill(m, d[:keep] + slow_digits("phone", d[keep:]))


def slow_replace(m):
    m = m[0]
    is_ = lambda p: re.search(f"^(?:{p})$", m, re.A)
    if "@" in m:
        return f"user-{hashlib.sha256((KEY + '|email|' + m.lower()).encode()).hexdigest()[:16]}@mail.invalid"
    if is_(pii.IP):
        o = [int(x) for x in m.split(".")]
        x, y = slow_feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}" if max(o) < 256 else m
    if is_(pii.DATE):
        try:
            return slow_date(m) if "." not in m else datetime.datetime.strptime(slow_date("-".join(m.split(".")[::-1])), "%Y-%m-%d").strftime("%d.%m.%Y")
        except (ValueError, UnboundLocalError, IndexError):
            return m
    if is_(pii.SSN):
        return refill(m, slow_digits("ssn", re.sub("-", "", m)))
    return slow_phone(m) if is_(pii.PHONE) else slow_card(m)


def slow_pii(text):
    return None if text is None else re.sub(pii.ANY, slow_replace, text, flags=re.A)


def test_documents_against_brute_force(spark):
    from graphloom.sources import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in pii.pii_digest(docs, KEY).collect()}
    assert {i: r.text for i, r in rows.items()} == {i: slow_pii(t) for i, t in texts.items()}
    assert all(sum(getattr(r, f"n_{k}") for r in rows.values()) for k in ("email", "phone"))
    twice = pii.pii_digest(docs.unionAll(docs), KEY).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("text").alias("k")).filter("n <> 2 or k > 1")
    assert twice.isEmpty()

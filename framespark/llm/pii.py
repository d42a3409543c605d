"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame functions only.

One regular expression finds candidates; each is validated (check digits, calendar, ranges) and written as a vector of
numbers with a modulus each: digits, octets, a year and the day in it. The vector is cut in halves and in eight rounds
each half in turn is shifted, element by element, by one keyed hash of the other. That is a permutation of all vectors of
the shape, so the pseudonym has the same format, check digits are set anew, equal values get equal pseudonyms in every
document and different values different ones. Separators and everything that doesn't validate stay as they are.

Every repetition in the patterns is bounded or possessive and no candidate can begin inside another run of its marks, so
the search is linear in the text and needs no deep stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of the query on the test tables; every other use names its own.
QUERY_KEY = "key of the test query"
ROUNDS = 8
#: Hex digits of a hash for an element; 32 elements of a half are the most (an e-mail address), those take half as many.
HEX = 8

#: Candidates, tried in this order at each place (fixed values).
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@[A-Za-z0-9\-]{1,63}+(?:\.[A-Za-z0-9\-]{1,63}+){1,8}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?!\.\d)",
    "date": r"\d{4}-\d{2}-\d{2}|\d{2}([./])\d{2}\2\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}",
    "card": r"\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5}",
}
#: No letter, digit or mark of the same value may stand before or after.
CANDIDATE = r"(?<![A-Za-z0-9._%+\-])(" + "|".join(PATTERNS.values()) + r")(?![A-Za-z0-9])"
#: Years of dates, and the leap years among them (every fourth from 1904 to 2096).
FIRST_YEAR, YEARS, FIRST_LEAP, LEAPS = 1900, 200, 1904, 49
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)

Vec = Column


def _ints(*values: Column) -> Column:
    return F.array(*[v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long") for v in values])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def chars(s: Column) -> Column:
    """The characters of a string; none of an empty one."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def keyed(key: str, kind: str | Column, round_: Column, other: Column, n: Column) -> Column:
    """n numbers from one hash of the key, the kind of value, the round and the other half."""
    text = F.concat_ws("|", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), round_.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
    width = F.when(n > 128 // HEX, HEX // 2).otherwise(HEX)
    return let(F.sha2(text, 512), lambda h: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(h, i * width + 1, width), 16, 10).cast("long")))


def feistel(vector: Column, moduli: Column, kind: str | Column, key: str) -> Column:
    """The permuted vector: element i stays in [0, moduli[i])."""
    half = (F.size(vector) / 2).cast("int")
    left = lambda a: F.slice(a, F.lit(1), half)
    right = lambda a: F.slice(a, half + 1, F.size(a) - half)

    def turn(s: Column, r: Column) -> Column:
        shifts = F.zip_with(keyed(key, kind, r, s["r"], F.size(s["l"])), s["ml"], lambda f, m: f % m)
        moved = F.zip_with(F.zip_with(s["l"], shifts, lambda x, f: x + f), s["ml"], lambda x, m: x % m)
        return F.struct(s["r"].alias("l"), F.when(F.size(s["l"]) == 0, s["l"]).otherwise(moved).alias("r"), s["mr"].alias("ml"), s["ml"].alias("mr"))

    start = F.struct(left(vector).alias("l"), right(vector).alias("r"), left(moduli).alias("ml"), right(moduli).alias("mr"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(done["l"], done["r"])


def _refill(template: Column, wanted: str, values: Column) -> Column:
    """template with its characters that match ``wanted`` replaced in turn by the strings of ``values``."""
    step = lambda s, c: F.struct(
        F.concat(s["t"], F.when(c.rlike(wanted), F.get(values, s["k"])).otherwise(c)).alias("t"), (s["k"] + c.rlike(wanted).cast("int")).alias("k")
    )
    return F.aggregate(chars(template), F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), step)["t"]


def _digits(s: Column) -> Column:
    return F.transform(chars(F.regexp_replace(s, r"[^0-9]", "")), lambda c: c.cast("long"))


def _strings(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("string"))


def _times(n: Column, value: int) -> Column:
    return F.array_repeat(F.lit(value).cast("long"), n)


def luhn_sum(digits: Column) -> Column:
    """Sum of digits, every second from the right but one doubled (and less 9 above 9)."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x)


def mod97(s: Column) -> Column:
    """The remainder that account numbers are checked by: letters count 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55).cast("long")
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(chars(s), F.lit(0).cast("long"), step)


def _card(m: Column, key: str) -> Column:
    """Luhn-valid numbers of 13 to 19 digits: the first digit stays, the last is set anew."""

    def new(d: Column) -> Column:
        n = F.size(d)
        front = F.concat(F.slice(d, F.lit(1), F.lit(1)), feistel(F.slice(d, F.lit(2), n - 2), _times(n - 2, 10), "card", key))
        whole = let(front, lambda f: F.concat(f, F.array((10 - luhn_sum(F.concat(f, _ints(0))) % 10) % 10)))
        return F.when((luhn_sum(d) % 10 == 0) & (F.array_max(d) > 0), _refill(m, "[0-9]", _strings(whole)))

    return let(_digits(m), new)


def _phone(m: Column, key: str) -> Column:
    """The last ten digits (all but the first of shorter numbers); area and exchange don't begin with 0 or 1 if they didn't."""

    def moved(s: Column) -> Column:
        """The tail t of the digits, of which k are moved; base is what can't be less."""
        k = F.size(s["t"])
        base = F.when(s["formed"], _ints(2, 0, 0, 2, 0, 0, 0, 0, 0, 0)).otherwise(_times(k, 0))
        moduli = F.when(s["formed"], _ints(8, 10, 10, 8, 10, 10, 10, 10, 10, 10)).otherwise(_times(k, 10))
        kind = F.when(s["formed"], F.lit("phone")).otherwise(F.lit("number"))
        v = feistel(F.zip_with(s["t"], base, lambda a, b: a - b), moduli, kind, key)
        return F.concat(s["head"], F.zip_with(v, base, lambda a, b: a + b))

    def new(d: Column) -> Column:
        n = F.size(d)
        k = F.least(n - F.when(n < 10, 1).otherwise(0), F.lit(10))
        tail = let(
            F.struct(F.slice(d, F.lit(1), n - k).alias("head"), F.slice(d, n - k + 1, k).alias("t")),
            lambda s: F.struct(s["head"].alias("head"), s["t"].alias("t"), ((F.size(s["t"]) == 10) & (F.get(s["t"], F.lit(0)) > 1) & (F.get(s["t"], F.lit(3)) > 1)).alias("formed")),
        )
        return F.when((n >= 7) & (n <= 15), _refill(m, "[0-9]", _strings(let(tail, moved))))

    return let(_digits(m), new)


def _ip(m: Column, key: str) -> Column:
    """Four octets up to 255 without leading zeros; 127.0.0.1 and 0.0.0.0 are nobody's address, stay, and are never given."""
    nobody = ("127.0.0.1", "0.0.0.0")
    v = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    good = (F.array_max(v) <= 255) & ~m.rlike(r"(^|\.)0\d") & ~m.isin(*nobody)
    seldom = F.array(*[_ints(*map(int, x.split("."))) for x in nobody])
    # moved on from the addresses that are not given: at most two steps more, since there are two
    steps = F.sequence(F.lit(0), F.lit(len(nobody)))
    moved = F.aggregate(steps, v, lambda x, i: F.when((i == 0) | F.array_contains(seldom, x), feistel(x, _times(F.lit(4), 256), "ip", key)).otherwise(x))
    return F.when(good, F.array_join(_strings(moved), "."))


def _date(m: Column, key: str) -> Column:
    """Calendar dates of 1900 to 2099: year-month-day, day month year, else month day year.

    The year and the day in the year are permuted, 29 February among the leap years. A month-first date is one whose day
    is above 12, else it reads as day-first; such dates are permuted among themselves, so they stay month-first.
    """

    def table(first: int) -> Column:
        """Days before each month that are at least ``first``, and at last all of them."""
        return _ints(*[sum(d - first + 1 for d in MONTH_DAYS[:i]) for i in range(13)])

    def parts(n: Column) -> Column:
        iso = m.rlike(r"^\d{4}-")
        swap = ~iso & (n[1] > 12)
        return F.struct(
            F.when(iso, n[0]).otherwise(n[2]).alias("year"), F.when(swap, n[0]).otherwise(n[1]).alias("month"), F.when(iso, n[2]).when(swap, n[1]).otherwise(n[0]).alias("day"),
            iso.alias("iso"), swap.alias("swap"), F.when(swap, 13).otherwise(1).alias("first"), F.when(swap, table(13)).otherwise(table(1)).alias("before"),
        )

    def moved(d: Column) -> Column:
        leap = (d["month"] == 2) & (d["day"] == 29) & (d["year"] % 4 == 0) & (d["year"] > FIRST_YEAR)
        place = F.get(d["before"], (d["month"] - 1).cast("int")) + d["day"] - d["first"]
        # one element for 29 February: its year alone moves
        v = F.when(leap, _ints((d["year"] - FIRST_LEAP) / 4)).otherwise(_ints(d["year"] - FIRST_YEAR, place))
        moduli = F.when(leap, _ints(LEAPS)).otherwise(_ints(F.lit(YEARS), F.get(d["before"], F.lit(12))))
        kind = F.when(d["swap"], F.lit("month first")).otherwise(F.lit("date"))
        return F.when(leap | (d["day"] <= F.get(_ints(*MONTH_DAYS), (d["month"] - 1).cast("int"))), feistel(v, moduli, kind, key))

    def written(d: Column, w: Column) -> Column:
        leap = F.size(w) == 1
        month = F.when(leap, 2).otherwise(F.size(F.filter(F.slice(d["before"], 1, 12), lambda c: c <= F.get(w, F.lit(1)))))
        day = lambda at: F.when(leap, 29).otherwise(F.get(w, F.lit(1)) - F.get(d["before"], at - 1) + d["first"])
        y = F.when(leap, F.get(w, F.lit(0)) * 4 + FIRST_LEAP).otherwise(F.get(w, F.lit(0)) + FIRST_YEAR).cast("string")
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        mark = F.substring(m, 3, 1)
        return let(
            month,
            lambda at: F.when(d["iso"], F.concat_ws("-", y, two(at), two(day(at)))).when(d["swap"], F.concat(two(at), mark, two(day(at)), mark, y)).otherwise(F.concat(two(day(at)), mark, two(at), mark, y)),
        )

    def pseudonym_of(d: Column) -> Column:
        good = (d["year"] >= FIRST_YEAR) & (d["year"] < FIRST_YEAR + YEARS) & (d["month"] >= 1) & (d["month"] <= 12) & (d["day"] >= 1)
        return F.when(good, let(moved(d), lambda w: F.when(w.isNotNull(), written(d, w))))

    return let(F.transform(F.split(m, r"[-./]"), lambda p: p.cast("long")), lambda n: let(parts(n), pseudonym_of))


def _ssn(m: Column, key: str) -> Column:
    """Social security numbers: area 001 to 899 but 666, group from 01, serial from 0001."""
    p = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
    good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    v = _ints(area - 1 - (area > 666).cast("long"), group - 1, serial - 1)
    w = feistel(v, _ints(898, 99, 9999), "ssn", key)
    a = F.get(w, F.lit(0)) + 1
    new = F.format_string("%03d-%02d-%04d", a + (a >= 666).cast("long"), F.get(w, F.lit(1)) + 1, F.get(w, F.lit(2)) + 1)
    return F.when(good, new)


def _letters_and_digits(s: Column, kind: str, key: str) -> Column:
    """Letters and digits of a string permuted, each within its own alphabet."""
    flat = F.regexp_replace(s, r"[^A-Za-z0-9]", "")
    base = F.transform(chars(flat), lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97).cast("long"))
    v = F.zip_with(chars(flat), base, lambda c, b: F.ascii(c).cast("long") - b)
    moved = feistel(v, F.transform(base, lambda b: F.when(b == 48, 10).otherwise(26).cast("long")), kind, key)
    return _refill(s, "[A-Za-z0-9]", F.zip_with(moved, base, lambda x, b: F.char(x + b)))


def _email(m: Column, key: str) -> Column:
    """The local part; the domain stays."""
    return F.concat(_letters_and_digits(F.substring_index(m, "@", 1), "email", key), F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m: Column, key: str) -> Column:
    """Account numbers with a right remainder of 97: country stays, check digits are set anew."""
    flat = F.replace(m, F.lit(" "))
    country, body = F.substring(flat, 1, 2), F.substring(flat, 5, 40)
    new = _letters_and_digits(body, "iban", key)
    check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    good = mod97(F.concat(body, F.substring(flat, 1, 4))) == 1
    return F.when(good, _refill(m, "[A-Z0-9]", chars(F.concat(country, check, new))))


RULES: dict[str, Callable[[Column, str], Column]] = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value) of a candidate: its kind and pseudonym; kind null and the value unchanged if it isn't valid."""
    kind, value = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, rule in RULES.items():
        alone = PATTERNS[name].replace(r"\2", r"\1")
        kind, value = kind.when(m.rlike(f"^(?:{alone})$"), name), value.when(m.rlike(f"^(?:{alone})$"), rule(m, key))
    return let(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), F.coalesce(v, m).alias("value")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced and two columns more: pii_kinds (array of the kinds found, in order) and n_pii.

    Null texts stay null with no kinds. Repeated rows get equal results, extra columns are kept (columns named
    pii_kinds or n_pii are replaced), and an empty table stays empty. There is no shuffle; each row stands alone. Whoever
    has the key can undo the permutations, so it must be secret and must not be empty.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    # columns are numbered meanwhile, so none can clash with a helper
    c = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    t = F.col(c["text"])
    some = docs.toDF(*c.values()).withColumn("_m", F.when(t.rlike(r"[0-9@]"), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(1))).otherwise(F.array().cast("array<string>")))
    some = some.withColumn("_new", F.when(F.size("_m") > 0, F.transform("_m", lambda m: pseudonym(m, key))))
    # as many pieces as candidates, and the rest
    pieces = F.split(t, CANDIDATE, -1)
    joined = F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size("_m")), "_new", lambda p, x: F.concat(p, x["value"])), "")
    text = F.when(F.size("_m") > 0, F.concat(joined, F.element_at(pieces, -1))).otherwise(t)
    kinds = F.coalesce(F.filter(F.transform("_new", lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    new = {"pii_kinds": F.col("_kinds"), "n_pii": F.size("_kinds").cast("long")}
    rest = [(text if name == "text" else F.col(at)).alias(name) for name, at in c.items() if name not in new]
    return some.withColumn("_kinds", kinds).select(*rest, *[v.alias(k) for k, v in new.items()])


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pii, pii_kinds (joined by commas), text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, QUERY_KEY).select("doc_id", "n_pii", F.array_join("pii_kinds", ",").alias("pii_kinds"), "text")

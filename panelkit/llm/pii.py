"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern, validated, and permuted within their format by a
keyed Feistel network: a card number becomes another one with a right check
digit, a date another date, an address another address. The permutation depends
on the key and the kind only, so equal values stay equal across documents, and
without separators: one number written in two ways stays one number.

Kinds: e-mail (the part before the @), card (13 to 19 digits, Luhn), IBAN (mod
97), IPv4, phone (international, the country code stays; local, with the area
code in brackets), US social security number, date (years 1800 to 2199; y-m-d, d.m.y, d/m/y), and keyed secrets (access
keys, and values behind password or key names in any case, up to white space or a
quote; their letters and digits change, other characters keep their places). What fails its
check stays, but cards and IBANs are looked for from each start and in each length.

Defined cases: null texts stay null; texts without such values are unchanged;
repeated rows are treated alike; an empty table gives an empty result; a
column named ``pii_kinds`` is replaced, all other columns pass through.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
HALF = 12  # characters on one side of a Feistel network: 26 ** 12 fits a long
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The name of a secret in any case and what stands before its value, which ends at white space or a quote.
NAME = r"""(?i:password|passwd|secret|token|api[_-]?key)["']? {0,2}[=:] {0,2}["']?"""
#: Kind, pattern. The first that matches at a place takes it; quantifiers are bounded or over one class, so a scan is linear.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,255})(?![A-Za-z0-9])"),
    ("named_secret", NAME + r"""[^\s"']{8,}"""),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", r"(?<![0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"),
    ("local_phone", r"(?<![0-9+])\([2-9][0-9]{2}\)[ -]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"),
]
#: Cards and IBANs among other digits and capitals: where one may start, and the runs of groups in which it is looked for.
STARTS = {"card": r"(?<![0-9+])(?<!(?:^|[^0-9])-)", "iban": "(?<![A-Za-z0-9])"}
ENDS = {"card": "(?![0-9])", "iban": "(?![A-Za-z0-9])"}
RUNS = {
    "card": r"[0-9]{1,19}(?:[ -][0-9]{1,19}){0,18}",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{0,30}(?: [A-Z0-9]{1,30}){0,9}",
}
NONE = "(?!)"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL",
    29: "BR PS QA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
LENGTH_OF = {c: n for n, cs in IBAN_LENGTHS.items() for c in cs.split()}


def _long(c: Column) -> Column:
    return c.cast("long")


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _digits_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def feistel(a: Column, b: Column, u: Column, v: Column, key: str, tweak: Column) -> Column:
    """(a, b) permuted within range(u) x range(v): each side in turn gets a keyed digest of the other added."""

    def noise(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["a"] + F.pmod(noise(i, s["b"]), u), u)).otherwise(s["a"]).alias("a"),
            F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(noise(i, s["a"]), v), v)).alias("b"),
        )

    start = F.struct(_long(a).alias("a"), _long(b).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _alphabet(c: Column) -> Column:
    return F.when(F.contains(F.lit(DIGITS), c), F.lit(DIGITS)).when(F.contains(F.lit(LOWER), c), F.lit(LOWER)).otherwise(F.lit(UPPER))


def _value(chars: Column) -> Column:
    """Number of a string in the mixed radix of its characters' classes, and the size of that range."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("size"))
    step = lambda s, c: F.struct(
        (s["n"] * F.length(_alphabet(c)) + F.instr(_alphabet(c), c) - 1).alias("n"), (s["size"] * F.length(_alphabet(c))).alias("size")
    )
    return F.aggregate(chars, start, step)


def _spelled(chars: Column, n: Column) -> Column:
    """The string of the same classes with number n."""
    start = F.struct(n.alias("n"), F.lit("").alias("s"))

    def step(s: Column, c: Column) -> Column:
        at = F.pmod(s["n"], F.length(_alphabet(c)))
        return F.struct(
            F.floor((s["n"] - at) / F.length(_alphabet(c))).cast("long").alias("n"),
            F.concat(F.substring(_alphabet(c), at.cast("int") + 1, F.lit(1)), s["s"]).alias("s"),
        )

    return F.aggregate(F.reverse(chars), start, step)["s"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _permuted_plain(s: Column, key: str, kind: str) -> Column:
    """Letters and digits to others of the same class; blocks of two halves, the number of the block in the tweak."""

    def block(i: Column) -> Column:
        part = F.substring(s, i * 2 * HALF + 1, F.lit(2 * HALF))
        return _let(part, lambda p: F.when(F.length(p) < 2, _single(p, i)).otherwise(_double(p, i)))

    def shape(p: Column) -> Column:
        return F.translate(F.translate(F.translate(p, DIGITS, "0" * 10), LOWER, "a" * 26), UPPER, "A" * 26)

    def _single(p: Column, i: Column) -> Column:
        turn = lambda x: feistel(x["n"], F.lit(0), x["size"], F.lit(1).cast("long"), key, F.concat_ws("|", F.lit(kind), i.cast("string"), shape(p)))
        return F.when(F.length(p) == 0, p).otherwise(_let(_value(_chars(p)), lambda x: _spelled(_chars(p), turn(x)["a"])))

    def _double(p: Column, i: Column) -> Column:
        cut = F.floor(F.length(p) / 2).cast("int")
        left, right = _chars(F.substring(p, F.lit(1), cut)), _chars(F.substring(p, cut + 1, F.lit(2 * HALF)))
        tweak = F.concat_ws("|", F.lit(kind), i.cast("string"), shape(p))
        return _let(
            F.struct(_value(left).alias("l"), _value(right).alias("r")),
            lambda x: _let(
                feistel(x["l"]["n"], x["r"]["n"], x["l"]["size"], x["r"]["size"], key, tweak),
                lambda y: F.concat(_spelled(left, y["a"]), _spelled(right, y["b"])),
            ),
        )

    blocks = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / (2 * HALF)).cast("int"))
    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(blocks, block), ""))


def permuted(s: Column, key: str, kind: str) -> Column:
    """All ASCII letters and digits of s permuted within their classes; other characters keep their places."""

    def fill(new: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))

        def step(x: Column, c: Column) -> Column:
            free = c.rlike("[A-Za-z0-9]")
            return F.struct(
                F.when(free, x["k"] + 1).otherwise(x["k"]).alias("k"),
                F.concat(x["s"], F.when(free, F.substring(new, x["k"] + 1, F.lit(1))).otherwise(c)).alias("s"),
            )

        return F.aggregate(_chars(s), start, step)["s"]

    return F.when(F.length(s) == 0, s).otherwise(_let(_permuted_plain(F.regexp_replace(s, "[^A-Za-z0-9]", ""), key, kind), fill))


def luhn_sum(digits: Column) -> Column:
    """Sum over a digit string, doubling every second digit from the last but one."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((s["k"] + 1).alias("k"), (s["sum"] + F.when(s["k"] % 2 == 1, twice).otherwise(d)).alias("sum"))

    return F.aggregate(F.reverse(_chars(digits)), start, step)["sum"]


def _card(m: Column, key: str) -> Column:
    body = F.substring(m, F.lit(1), F.length(m) - 1)
    check = lambda p: F.pmod(-luhn_sum(F.concat(_digits_only(p), F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn_right(m), _let(permuted(body, key, "card"), lambda p: F.concat(p, check(p))))


def _mod97(s: Column) -> Column:
    """A string of digits and capitals (A = 10) as a number, modulo 97."""
    step = lambda x, c: F.when(
        F.contains(F.lit(DIGITS), c), (x * 10 + F.instr(F.lit(DIGITS), c) - 1) % 97
    ).otherwise((x * 100 + F.instr(F.lit(UPPER), c) + 9) % 97)
    return F.aggregate(_chars(s), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    country = F.substring(m, 1, 2)

    def whole(rest: Column) -> Column:
        check = 98 - _mod97(F.concat(F.regexp_replace(rest, " ", ""), country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)

    return F.when(_iban_right(m), _let(permuted(F.substring(m, F.lit(5), F.length(m)), key, "iban"), whole))


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    a, b = (F.get(o, k) * 256 + F.get(o, k + 1) for k in (0, 2))
    full = F.lit(65536).cast("long")
    parts = lambda x: F.concat_ws(".", F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)
    return F.when(F.forall(o, lambda x: x <= 255), _let(feistel(a, b, full, full, key, F.lit("ip")), parts))


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, "^\\+(?:1|[0-9]{1,3}(?=[^0-9])|[0-9]{2})", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.when(F.length(_digits_only(m)).between(8, 15), F.concat(code, permuted(rest, key, "phone")))


def _local_phone(m: Column, key: str) -> Column:
    return permuted(m, key, "phone")


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    right = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    n = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1

    def whole(x: Column) -> Column:
        k = F.floor(x["a"] / 99)
        part = lambda v, width: F.lpad(v.cast("string"), width, "0")
        return F.concat_ws("-", part(F.when(k >= 665, k + 2).otherwise(k + 1), 3), part(x["a"] % 99 + 1, 2), part(x["b"] + 1, 4))

    return F.when(right, _let(feistel(n, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn")), whole))


def _date(m: Column, key: str) -> Column:
    iso = m.contains("-")
    p = F.split(m, "[-./]")
    num = lambda k: F.get(p, k).cast("int")
    swapped = ~iso & (num(0) <= 12) & (num(1) > 12)  # month first
    y, mo, d = F.when(iso, num(0)).otherwise(num(2)), F.when(iso | swapped, F.when(iso, num(1)).otherwise(num(0))).otherwise(num(1)), F.when(iso, num(2)).when(swapped, num(1)).otherwise(num(0))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    right = y.between(1800, 2199) & mo.between(1, 12) & (d >= 1) & (d <= last)
    first = F.lit("1800-01-01").cast("date")
    n = F.date_diff(F.make_date(y, mo, d), first)  # 0 to 146096 = 189 * 773 - 1: the 400 years of the calendar's cycle

    def whole(new: Column) -> Column:
        sep = F.substring(F.regexp_extract(m, "[-./]", 0), 1, 1)
        wide = lambda v, k: F.when(F.length(F.get(p, k)) > 1, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
        day, month = F.dayofmonth(new), F.month(new)
        other = F.when(swapped, F.concat_ws("/", wide(month, 0), wide(day, 1), F.year(new).cast("string")))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(
            F.coalesce(other, F.concat(wide(day, 0), sep, wide(month, 1), sep, F.year(new).cast("string")))
        )

    def moved(n: Column) -> Column:
        turned = feistel(F.floor(n / 773), n % 773, F.lit(189).cast("long"), F.lit(773).cast("long"), key, F.lit("date"))
        return _let(turned, lambda x: _let(F.date_add(first, (x["a"] * 773 + x["b"]).cast("int")), whole))

    return F.when(right, _let(n, moved))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permuted(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 4), permuted(F.substring(m, F.lit(5), F.length(m)), key, "secret"))


def _named_secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, f"^{NAME}", 0)
    return F.concat(name, permuted(F.substring(m, F.length(name) + 1, F.length(m)), key, "secret"))


MAKERS = {
    "email": _email, "secret": _secret, "named_secret": _named_secret, "iban": _iban, "date": _date, "ip": _ip,
    "phone": _phone, "local_phone": _local_phone, "ssn": _ssn, "card": _card,
}


def _luhn_right(m: Column) -> Column:
    return luhn_sum(_digits_only(m)) % 10 == 0


def _iban_right(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1


def _cards(run: Column) -> Column:
    """Card numbers at the start of a run of groups, the longest first."""
    tries = [F.regexp_extract(run, f"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(19, 12, -1)]
    return F.filter(F.array(*tries), lambda m: (m != "") & _luhn_right(m))


def _ibans(run: Column) -> Column:
    """IBANs at the start of a run of groups: the length of the country first, then the longest."""
    groups = F.split(run, " ")
    tries = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, 1, k), " "))
    form = dict(PATTERNS)["iban"]
    right = F.filter(tries, lambda m: m.rlike(f"^{form}$") & _iban_right(m))
    length = F.create_map(*[F.lit(x) for pair in LENGTH_OF.items() for x in pair])
    own = lambda m: F.length(F.regexp_replace(m, " ", "")) == F.coalesce(F.try_element_at(length, F.substring(m, 1, 2)), F.lit(0))
    return F.concat(F.filter(right, own), right)


def _pattern(t: Column) -> Column:
    """The pattern for one text: all kinds, with the cards and IBANs that pass their check listed as values.

    Runs are looked at from every start, so a value is found whatever stands
    beside it, and no match that fails its check covers another value.
    """

    def listed(kind: str, first) -> Column:
        runs = F.array_distinct(F.regexp_extract_all(t, F.lit(f"{STARTS[kind]}(?=({RUNS[kind]}){ENDS[kind]})"), F.lit(1)))
        best = F.filter(F.transform(runs, lambda run: F.get(first(run), 0)), lambda m: m.isNotNull())
        # of values with the same start the longest goes first
        best = F.reverse(F.array_sort(F.array_distinct(best)))
        values = F.concat(F.lit(f"{STARTS[kind]}(?:"), F.array_join(best, "|"), F.lit(f"){ENDS[kind]}"))
        return F.when(F.size(best) > 0, values).otherwise(F.lit(NONE))

    # the date pattern has the only group, so \\1 stays right
    lists = {"card": listed("card", _cards), "iban": listed("iban", _ibans)}
    parts = [F.concat(F.lit("(?:"), lists.get(k, F.lit(p)), F.lit(")")) for k, p in PATTERNS]
    return F.concat_ws("|", *parts)


def _named(kind: str, new: Column) -> Column:
    return F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("new")))


def _found(m: Column, key: str) -> Column:
    """Kind and pseudonym of a match; both null where no kind's check is passed."""
    tries = []
    for kind, pattern in PATTERNS:
        named = partial(_named, kind)
        tries.append(F.when(m.rlike(f"^(?:{pattern})$"), _let(MAKERS[kind](m, key), lambda x: named(x))))  # noqa: B023, PLW0108
    return F.coalesce(*tries)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The table with ``text_col`` replaced, and ``pii_kinds``: the kind of each value replaced, in order."""
    found, between, pattern = "_found", "_between", "_pattern"
    while {found, between, pattern} & set(docs.columns):
        found, between, pattern = found + "_", between + "_", pattern + "_"
    t = F.col(text_col)
    # texts without a digit, an @ or the name of a secret go through untouched
    some = t.rlike(f"[0-9@]|AKIA|gh[opsu]_|{NAME}")
    docs = docs.withColumn(pattern, F.when(some, _pattern(t)))
    matches = F.transform(F.regexp_extract_all(t, F.col(pattern), F.lit(0)), lambda m: F.struct(m.alias("old"), _found(m, key).alias("f")))
    out = docs.withColumns({found: F.when(F.col(pattern).isNotNull(), matches), between: F.when(F.col(pattern).isNotNull(), F.split(t, F.col(pattern), -1))})
    new = F.zip_with(F.col(between), F.col(found), lambda b, f: F.concat(b, F.coalesce(f["f"]["new"], f["old"], F.lit(""))))
    kinds = F.filter(F.transform(F.col(found), lambda x: x["f"]["kind"]), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    return out.withColumns({text_col: F.coalesce(F.array_join(new, ""), t), "pii_kinds": F.coalesce(kinds, empty)}).drop(found, between, pattern)

"""Format-preserving pseudonyms of personal data, in DataFrame functions only.

E-mail addresses, IPv4 and IPv6 addresses, bank accounts (IBAN), dates, social security numbers, telephone numbers
and payment card numbers are found by one pattern and validated: card and account numbers by
their check digits and an account's length by its country, dates by the calendar, social security numbers by the areas in use,
IPv4 addresses by their octets, IPv6 ones by their groups and a first group in use, international telephone numbers by their length.  A valid value is replaced by its image under a keyed Feistel
permutation of the values of its format, so equal values get equal pseudonyms in all
documents, different ones different, and a pseudonym is valid again.

Characters are permuted within their class (digit, small or capital letter) by rounds in
which one half of the text shifts the other; dates, IPv4 and IPv6 addresses and social security
numbers are numbered, and the number is permuted as a pair of parts, each shifted by
the other.  Separators, an e-mail address's domain, the first group of an IPv6 address, a card's first digit and the country of an account or a telephone number
stay; check digits are computed anew.  However an IPv6 address is abbreviated, its pseudonym is the same, with all eight groups.

The key is a secret of whoever runs this: `session_key` reads it from the session's setting KEY_SETTING, and its lack is an error.  KEY
is for tests and for queries whose results others repeat; what is made with it can be undone by anyone.

Defined cases: a null text stays null; a text without values stays as it is; numbers
that fail validation stay, but a card number among other numbers is found by its
groups; nn/nn/yyyy is day/month, or month/day where that is no date, and a date past the 12th becomes one past a 12th in
every layout; values that overlap are taken from the left, the longest kind first
in the order above; repeated rows are treated alike; an empty table stays
empty; texts of any length are searched whole.  Columns named __pattern, __values, __marked, __named and __gaps are lost.  Everything is row-local.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEY_SETTING = "spark.voxtrail.pseudonym.key"
ROUNDS = 8
WALK = 100  # a walk past as many days of the other sort has a probability of 1e-21
KEY = "voxtrail"
_EPOCH, _DAYS, _LAST = "1800-01-01", 146_097, "2199-12-31"  # one Gregorian cycle of 400 years

# The formats that are looked for.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"
_NETWORK = "(?:[23][0-9A-Fa-f]{3}|[fF](?:[eE][89ABab][0-9A-Fa-f]|[CDcd][0-9A-Fa-f]{2}))"  # global, link-local, unique local
IPV6 = rf"(?<![\w:.]){_NETWORK}(?:(?::{_GROUP}){{7}}|(?::{_GROUP}){{0,5}}::{_GROUP}(?::{_GROUP}){{0,5}})(?![\w:])"
DATE = r"(?<![\d./\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/\-]|\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d(+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])"
CARD = r"(?<![\d.,\-])\d(?:[ \-]?\d){12,18}(?![\d\-])"
FOREIGN = r"(?<![\d+(])\+\d{1,3}(?:[ .\-]?(?:\(\d{1,4}\)|\d{1,5})){2,6}(?![\d\-])"
#: Lengths of account numbers by country.
ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in ACCOUNTS.items()) + ")(?![A-Za-z0-9])"
OTHERS = "|".join((EMAIL, IP, IPV6, IBAN, DATE, SSN, PHONE, FOREIGN))
PATTERN = f"{OTHERS}|{CARD}"
#: Layouts of cards that may have other numbers beside them, which CARD takes along.
_START, _END = r"(?<![\d.,\-])", r"(?!\d|-\d{4})"
LAYOUTS = (r"\d{4}(?:(?: \d{4}){3}|(?:-\d{4}){3})", r"\d{4}(?: \d{6} \d{5}|-\d{6}-\d{5})", r"\d{4}(?: \d{6} \d{4}|-\d{6}-\d{4})", r"\d{13,19}")


def session_key(spark: SparkSession, default: str | None = None) -> str:
    """The key that the session is set to, else `default`; without either there are no pseudonyms."""
    key = spark.conf.get(KEY_SETTING, "") or default
    if not key:
        raise ValueError(f"set {KEY_SETTING}: pseudonyms made with a known key can be undone")
    return key


def _digest(key: str, *parts: Column) -> Column:
    """A number of 60 bits that depends on the key and all parts."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def permute_pair(key: str, what: str, a: Column, b: Column, m: int, n: int) -> Column:
    """struct(a, b): a keyed permutation of the pairs with 0 <= a < m and 0 <= b < n."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["a"] + _digest(key, F.lit(what), i, s["b"]) % m, F.lit(m))).otherwise(s["a"])
        right = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _digest(key, F.lit(what), i, s["a"]) % n, F.lit(n)))
        return F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), turn)


def permute_text(key: str, what: str, text: Column) -> Column:
    """A keyed permutation of the texts with the same length and, at each place, the same class of character."""

    def shift(half: Column, other: Column, i: Column) -> Column:
        def one(c: Column, by: Column) -> Column:
            code = F.ascii(c)

            def within(first: int, size: int) -> Column:
                return F.char(F.pmod(code - first + by, F.lit(size)) + first)

            return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(c)

        def shifted(digest: Column) -> Column:
            by = lambda j: F.conv(F.substring(digest, j * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.array_join(F.transform(F.split(half, ""), lambda c, j: one(c, by(j))), "")

        # One digest for 32 characters, of which each takes four hexadecimal digits.
        runs = F.sequence(F.lit(0), F.floor((F.length(half) - 1) / 32).cast("int"))
        digest = F.array_join(F.transform(runs, lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), i.cast("string"), k.cast("string"), other), 512)), "")
        return F.when(F.length(half) == 0, half).otherwise(F.transform(F.array(digest), shifted)[0])

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shift(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(shift(s["b"], s["a"], i)).alias("b"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(done["a"], done["b"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refit(text: Column, signs: Column, kept: str = r"\D") -> Column:
    """`text` with its signs other than `kept` replaced by `signs`, in order."""
    place = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), kept, ""))
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(kept), c).otherwise(F.substring(signs, place(i), F.lit(1)))), "")


def _remainder(account: Column) -> Column:
    """The remainder by 97 of an account number without blanks: country and check digits behind the rest, letters as 10 to 35."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike(r"\d"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _luhn(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, every second one doubled, from the first if `doubled` is 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == doubled, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _calendar(text: Column) -> Column:
    """The date of any of the three layouts, null if the calendar has none or it is out of range."""
    iso = F.when(text.rlike(r"^\d{4}[-/]"), F.translate(text, "/", "-")).otherwise(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)))
    found = F.try_to_date(iso, "yyyy-MM-dd")
    found = F.coalesce(found, F.try_to_date(F.when(_month_first(text), F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2))), "yyyy-MM-dd"))
    return F.when(found.between(F.lit(_EPOCH).cast("date"), F.lit(_LAST).cast("date")), found)


def _month_first(text: Column) -> Column:
    """Whether a date can only be month/day/year."""
    return text.rlike(r"^\d{2}/(?:1[3-9]|[23]\d)/")


def _dated(text: Column) -> Callable[[Column], Column]:
    """A date in the layout of `text`."""
    sign = lambda at: F.substring(text, at, 1)
    layouts = ((_month_first(text), "MM/dd/yyyy"), (sign(3) == "/", "dd/MM/yyyy"), (sign(3) == ".", "dd.MM.yyyy"), (sign(5) == "/", "yyyy/MM/dd"))

    def format_(date: Column) -> Column:
        out = F.date_format(date, "yyyy-MM-dd")
        for holds, layout in reversed(layouts):
            out = F.when(holds, F.date_format(date, layout)).otherwise(out)
        return out

    return format_


def _walk(key: str, day: Column) -> Column:
    """A keyed permutation of the days from _EPOCH that keeps apart those past the 12th of a month.

    These may stand as month/day/year, the others may not, so a pair's permutation is repeated until it is back among
    days of the same sort; a date has one image then, whatever its layout.
    """
    past = lambda d: F.dayofmonth(F.date_add(F.lit(_EPOCH).cast("date"), d)) > 12
    start = F.struct(day.cast("int").alias("day"), past(day).alias("late"), F.lit(False).alias("done"))

    def turn(s: Column, i: Column) -> Column:
        moved = _number(permute_pair(key, "date", F.floor(s["day"] / 773), s["day"] % 773, 189, 773), 773)
        moved = F.transform(F.array(moved), lambda d: F.struct(d.alias("day"), s["late"].alias("late"), (past(d) == s["late"]).alias("done")))[0]
        return F.when(s["done"], s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, turn)["day"]


def kind(text: Column) -> Column:
    """email, ip, ipv6, date, ssn, iban, phone or card for a valid value that the pattern found, else null."""
    whole = lambda p: text.rlike(rf"^(?:{p})$")
    area, group, serial = (F.substring(text, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    return (
        F.when(F.contains(text, F.lit("@")), "email")
        .when(whole(IP), "ip")
        .when(whole(IPV6), F.when(F.size(_groups(text)) == 8, "ipv6"))
        .when(whole(DATE), F.when(_calendar(text).isNotNull(), "date"))
        .when(whole(SSN), F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), "ssn"))
        .when(whole(IBAN), F.when(_remainder(F.replace(text, F.lit(" "), F.lit(""))) == 1, "iban"))
        .when(whole(PHONE), "phone")
        .when(F.startswith(text, F.lit("+")), F.when(F.length(_digits(text)).between(8, 15), "phone"))
        .when(_luhn(_digits(text), 1) % 10 == 0, "card")
    )


def pseudonym(text: Column, kind: Column, key: str = KEY) -> Column:
    """The value's image among the values of its kind and format; the value itself if `kind` is null."""
    local = F.substring_index(text, "@", 1)
    email = F.concat(permute_text(key, "email", local), F.substring(text, F.length(local) + 1, F.length(text)))

    octet = [F.substring_index(F.substring_index(text, ".", i), ".", -1).cast("int") for i in range(1, 5)]
    moved = permute_pair(key, "ip", octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 1 << 16, 1 << 16)
    ip = F.concat_ws(".", *[x.cast("string") for x in _bytes(moved)])

    # After the first group there are 28 digits, two parts of 56 bits.
    rest = F.substring(F.array_join(F.transform(_groups(text), lambda g: F.lpad(g, 4, "0")), ""), 5, 28)
    halves = [F.conv(F.substring(rest, at, 14), 16, 10).cast("bigint") for at in (1, 15)]
    moved = F.transform(F.array(permute_pair(key, "ipv6", *halves, 1 << 56, 1 << 56)), lambda p: F.concat(_hex(p["a"]), _hex(p["b"])))[0]
    cut = F.transform(F.array(moved), lambda h: F.concat_ws(":", *[F.regexp_replace(F.substring(h, at, 4), "^0{1,3}", "") for at in range(1, 29, 4)]))[0]
    ipv6 = F.concat(F.lower(F.substring(text, 1, 4)), F.lit(":"), cut)

    day = F.datediff(_calendar(text), F.lit(_EPOCH).cast("date"))
    date = F.transform(F.array(F.date_add(F.lit(_EPOCH).cast("date"), _walk(key, day))), _dated(text))[0]

    area = F.substring(text, 1, 3).cast("int")
    rest = (F.substring(text, 5, 2).cast("int") - 1) * 9999 + F.substring(text, 8, 4).cast("int") - 1
    ssn = F.transform(F.array(permute_pair(key, "ssn", area - 1 - F.when(area > 666, 1).otherwise(0), rest, 898, 99 * 9999)), _social)[0]

    digits = _digits(text)
    foreign = ~text.rlike(rf"^(?:{PHONE})$")
    country = F.when(foreign, F.when(F.substring(digits, 1, 1).isin("1", "7"), 1).otherwise(2)).otherwise(F.length(digits) - 10)
    phone = _refit(text, F.concat(F.substring(digits, F.lit(1), country), permute_text(key, "phone", F.substring(digits, country + 1, F.length(digits)))))

    body = F.concat(F.substring(digits, 1, 1), permute_text(key, "card", F.substring(digits, F.lit(2), F.length(digits) - 2)))
    card = F.transform(F.array(body), lambda d: F.concat(d, F.pmod(-_luhn(d, 0), F.lit(10)).cast("string")))[0]
    card = _refit(text, card)

    plain = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 1, 2), F.lit("00"), permute_text(key, "iban", F.substring(plain, F.lit(5), F.length(plain))))
    account = F.transform(F.array(moved), lambda a: F.concat(F.substring(a, 1, 2), F.lpad((98 - _remainder(a)).cast("string"), 2, "0"), F.substring(a, F.lit(5), F.length(a))))[0]
    account = _refit(text, account, " ")

    out = text
    for name, value in (("email", email), ("ip", ip), ("ipv6", ipv6), ("iban", account), ("date", date), ("ssn", ssn), ("phone", phone), ("card", card)):
        out = F.when(kind == name, value).otherwise(out)
    return out


def _bytes(pair: Column) -> list[Column]:
    return [F.floor(pair["a"] / 256), pair["a"] % 256, F.floor(pair["b"] / 256), pair["b"] % 256]


def _groups(text: Column) -> Column:
    """The groups of an IPv6 address in small letters, those that `::` stands for as 0, at least one."""
    small = F.lower(text)
    first, last = F.split(F.substring_index(small, "::", 1), ":"), F.split(F.substring_index(small, "::", -1), ":")
    return F.when(F.contains(small, F.lit("::")), F.concat(first, F.array_repeat(F.lit("0"), F.greatest(F.lit(1), 8 - F.size(first) - F.size(last))), last)).otherwise(first)


def _hex(part: Column) -> Column:
    return F.lpad(F.lower(F.hex(part)), 14, "0")


def _number(pair: Column, n: int) -> Column:
    return F.transform(F.array(pair), lambda p: p["a"] * n + p["b"])[0].cast("int")


def _social(pair: Column) -> Column:
    area = pair["a"] + 1 + F.when(pair["a"] + 1 > 665, 1).otherwise(0)
    group, serial = F.floor(pair["b"] / 9999) + 1, pair["b"] % 9999 + 1
    return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lit("-"), F.lpad(group.cast("string"), 2, "0"), F.lit("-"), F.lpad(serial.cast("string"), 4, "0"))


def _pattern(text: Column) -> Column:
    """PATTERN; where a valid card in one of LAYOUTS is not what CARD would take, that card comes before what CARD takes around it."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?={_START}({x}){_END})"), F.lit(1)) for x in LAYOUTS]))
    taken = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    cards = F.array_except(F.filter(found, lambda c: _luhn(_digits(c), 1) % 10 == 0), taken)

    def with_cards(cards: Column) -> Column:
        exact = F.concat(F.lit(f"{_START}(?:"), F.array_join(cards, "|"), F.lit(f"){_END}"))
        around = F.concat(F.lit(r"(?<![\d.,\-])\d(?:[ \-]?(?!"), exact, F.lit(r")\d){12,18}(?![\d\-])"))
        return F.concat(F.lit(OTHERS + "|"), exact, F.lit("|"), around)

    chosen = F.transform(F.array(cards), lambda c: F.when(F.size(c) > 0, with_cards(c)).otherwise(F.lit(PATTERN)))[0]
    return F.when(text.rlike(CARD), chosen).otherwise(F.lit(PATTERN))


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, found: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in column `text`; `found` names a column for (kind, start, original's length, pseudonym) of each value."""
    key = session_key(docs.sparkSession) if key is None else key
    t = F.col(text)
    has = t.rlike(r"\d|@|::|:[A-Fa-f]{1,4}:")
    docs = docs.withColumn("__pattern", F.when(has, _pattern(t)))
    pattern = F.col("__pattern")
    values = F.when(has, F.regexp_extract_all(t, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn("__values", values)
    some = F.size("__values") > 0
    marked = F.when(some, F.transform("__values", lambda v: F.struct(v.alias("value"), kind(v).alias("kind"))))
    docs = docs.withColumn("__marked", marked)
    named = F.transform("__marked", lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("value"), pseudonym(m["value"], m["kind"], key).alias("pseudonym")))
    docs = docs.withColumn("__named", named)
    gaps = F.split(t, pattern, -1)
    docs = docs.withColumn("__gaps", F.when(some, gaps))
    pieces = F.zip_with("__gaps", "__named", lambda g, m: F.concat(g, F.coalesce(m["pseudonym"], F.lit(""))))
    if found:
        sizes = F.zip_with(F.slice("__gaps", 1, F.size("__named")), "__named", lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["value"]).alias("length")))
        starts = F.aggregate(
            sizes,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda s, x: F.struct((s["at"] + x["gap"] + x["length"]).alias("at"), F.array_append(s["starts"], s["at"] + x["gap"]).alias("starts")),
        )["starts"]
        spans = F.zip_with("__named", starts, lambda m, at: F.struct(m["kind"].alias("kind"), at.alias("start"), F.length(m["value"]).alias("length"), m["pseudonym"].alias("pseudonym")))
        spans = F.filter(spans, lambda m: m["kind"].isNotNull())
        docs = docs.withColumn(found, F.coalesce(F.when(some, spans), F.array().cast("array<struct<kind:string,start:int,length:int,pseudonym:string>>")))
    changed = F.when(some, F.array_join(pieces, "")).otherwise(t)
    return docs.withColumn(text, changed).drop("__pattern", "__values", "__marked", "__named", "__gaps")


def pseudonymise_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the text with pseudonyms, the number of values replaced and their kinds."""
    rows = pseudonymise(docs.select("doc_id", "text"), "text", key, "found")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["kind"]))), ",")
    return rows.select("doc_id", "text", F.size("found").alias("n_found"), kinds.alias("kinds"))

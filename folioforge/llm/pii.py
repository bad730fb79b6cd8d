"""PII: format-preserving Feistel pseudonyms, with DataFrame functions only.

Personal values are found, validated, and permuted within their format by a keyed Feistel network, so that a value
has the same pseudonym in every document and the key holder can invert it:

* card numbers (13 to 19 digits, also in groups joined by single spaces or hyphens, Luhn-valid): all digits but the last
  are permuted, the last is the new Luhn digit;
* account numbers (IBAN, valid by mod 97): the digits of the account are permuted, the check digits computed anew;
* phone numbers: the ten national digits of North American ones (``+1 (ddd) ddd-dddd``, ``(ddd) ddd-dddd``, ``ddd-ddd-dddd`` and
  alike), all digits after the country code of international ones (``+49 30 1234567``, 8 to 15 digits), and all but the leading
  zero of area codes before a slash or hyphen (``030/1234567``);
* social security numbers (``ddd-dd-dddd``, in the ranges that are given out), within these ranges;
* IPv4 addresses (octets up to 255): the 32 bits;
* dates (yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy, real calendar days of 1800 to 2199): the day number among the
  146,097 days of those years;
* mail addresses: a 40-bit keyed digest of the address is permuted and written as the local part, the
  domain stays. (There is no fixed format to permute within; the link between equal values holds.)

Cards come first. In a run of digit groups every window of up to ``WINDOW_GROUPS`` whole groups is tried, so that numbers beside a
card (dates, expiry, other cards) hide none: windows in the usual card shapes first, then others that begin like a card and
overlap none of those, from left to right. All else is searched in what is left of the text, by one pattern.

Values that fail validation stay as they are, as do all other characters. A network over Z_a x Z_b adds
keyed round values to the halves in turn modulo a and b, which is a permutation for any a and b, so no
cycle walking is needed. Round values are SHA-256 of key, kind, round and the other half. Whoever has the key can invert
the pseudonyms, so it has no default. Inverting gives the text back unless a number beside a card makes another window valid by chance.

Edge cases: null stays null with zero counts; texts of any length are read whole; equal rows get equal
results; an empty table gives an empty table. Columns named like the counts (``n_mail`` ...) are replaced, all others come through.
The main path has no Python on the executors and no shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: One alternative for each kind but cards, in order of precedence. Possessive runs keep the search linear.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE_US = r"(?<![\d.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[. -]\d{4}(?![\d-]|\.\d)|(?<!\d)\+1[ .-]\d{3}[. -]\d{3}[. -]\d{4}(?!\d)"
PHONE_ABROAD = r"(?<![\d+])\+[1-9]\d{0,2}[ ./-]?\(?\d{1,5}\)?(?:[ ./-]?\d{2,9}){1,4}(?!\d)"
PHONE_LOCAL = r"(?<![\d/.-])0\d{1,4}[/-]\d{4,9}(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
ANY = "|".join((MAIL, DATE, IBAN, PHONE_US, PHONE_ABROAD, PHONE_LOCAL, SSN, IP))
KINDS = ("mail", "date", "iban", "phone", "ssn", "ip", "card")
#: Runs of digits, spaces and hyphens that may hold a card, and the shapes and beginnings of cards.
RUN = r"(?<![\d.])\d[\d -]{11,}\d(?!\d|\.\d)"
SHAPES = r"^(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}(?: \d{1,3})?|\d{4}-\d{4}-\d{4}-\d{4}(?:-\d{1,3})?|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})$"
ISSUERS = r"^(?:4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3(?:0[0-59]|[4-9])|6)"
WINDOW_GROUPS = 7
FIRST_DAY = "1800-01-01"
DAYS = (189, 773)  # whose product is the 146,097 days of 400 years


def let(value: Column, body) -> Column:
    """body of a value that is computed once: lambdas compute anew whatever is no variable of theirs."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(x) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def feistel_halves(left: Column, right: Column, a: int | Column, b: int | Column, key: str, tweak: str, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """The struct (l, r) that a keyed permutation of Z_a x Z_b (or its inverse) makes of two halves."""
    a, b = _long(a), _long(b)
    sign = -1 if inverse else 1
    order = F.array(*map(F.lit, reversed(range(rounds)) if inverse else range(rounds)))

    def value(i: Column, half: Column, size: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)

    def step(s: Column, i: Column) -> Column:
        one = F.struct(F.pmod(s["l"] + sign * value(i, s["r"], a), a).alias("l"), s["r"].alias("r"))
        two = F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * value(i, s["l"], b), b).alias("r"))
        return F.when(i % 2 == 0, one).otherwise(two)

    return F.aggregate(order, F.struct(_long(left).alias("l"), _long(right).alias("r")), step)


def feistel(x: Column, a: int | Column, b: int | Column, key: str, tweak: str, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the integers from 0 below a * b (or its inverse)."""
    a, b, x = _long(a), _long(b), _long(x)
    return let(feistel_halves(F.call_function("div", x, b), F.pmod(x, b), a, b, key, tweak, inverse, rounds), lambda s: s["l"] * b + s["r"])


def permuted(digits: Column, key: str, tweak: str, inverse: bool) -> Column:
    """A digit string (of up to 36 digits) permuted among those of its length."""

    def put(x: Column) -> Column:
        half, rest = x["half"], F.length(digits) - x["half"]
        left, right = F.when(half > 0, F.substr(digits, F.lit(1), half)).otherwise("0"), F.substr(digits, half + 1, rest)
        text = lambda s: F.concat(F.when(half > 0, F.lpad(s["l"].cast("string"), half, F.lit("0"))).otherwise(""), F.lpad(s["r"].cast("string"), rest, F.lit("0")))
        return let(feistel_halves(left, right, x["a"], x["b"], key, tweak, inverse), text)

    n = F.length(digits)
    half = F.floor(n / 2)
    return let(F.struct(half.alias("half"), F.pow(F.lit(10), half).cast("long").alias("a"), F.pow(F.lit(10), n - half).cast("long").alias("b")), put)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def refill(shape: Column, digits: Column, keep: str = r"\D") -> Column:
    """``shape`` with its digits (all but what ``keep`` matches) replaced, in order, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        fixed = c.rlike(keep)
        return F.struct(F.concat(s["out"], F.when(fixed, c).otherwise(F.substr(digits, s["at"], F.lit(1)))).alias("out"), F.when(fixed, s["at"]).otherwise(s["at"] + 1).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits, those at 0-based places from the right of parity ``doubled`` being doubled."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return luhn_sum(digits, 1) % 10 == 0


def _card(v: Column, key: str, inverse: bool) -> Column:
    def put(body: Column) -> Column:
        return refill(v, F.concat(body, F.pmod(10 - luhn_sum(body, 0) % 10, F.lit(10)).cast("string")))

    return let(digits_of(v), lambda d: let(permuted(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", inverse), put))


def mod97(text: Column) -> Column:
    """The remainder of an account number's characters, letters counting as 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.pmod(acc * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _beginnings(v: Column) -> Column:
    """v, and v without its last, its last two and its last three blank-separated parts."""
    parts = F.split(v, " ")
    return F.filter(F.transform(F.array(*map(F.lit, range(4))), lambda k: F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - k, F.lit(0))), " ")), lambda x: x != "")


def _iban(v: Column, key: str, inverse: bool) -> Column:
    def bare(x: Column) -> Column:
        return F.replace(x, F.lit(" "), F.lit(""))

    def valid(x: Column) -> Column:
        return let(bare(x), lambda n: F.length(n).between(15, 34) & (mod97(F.concat(F.substr(n, F.lit(5)), F.substr(n, F.lit(1), F.lit(4)))) == 1))

    def put(own: Column, n: Column) -> Column:
        account, country = F.substr(n, F.lit(5)), F.substr(n, F.lit(1), F.lit(2))

        def whole(new: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(refill(own, F.concat(country, check, new), " "), F.substr(v, F.length(own) + 1))

        return let(refill(account, let(digits_of(account), lambda d: permuted(d, key, "iban", inverse))), whole)

    own = F.get(F.filter(_beginnings(v), valid), F.lit(0))
    return let(own, lambda own: F.when(own.isNotNull(), let(bare(own), lambda n: put(own, n))))


def _phone(v: Column, key: str, inverse: bool) -> Column:
    def national(d: Column) -> Column:
        return refill(v, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), permuted(F.right(d, F.lit(10)), key, "phone", inverse)))

    def other(fits: Column) -> Column:
        kept = F.when(v.startswith("0"), 1).otherwise(F.coalesce(F.nullif(F.length(F.regexp_extract(v, r"^\+(\d{1,3})(?=\D)", 1)), F.lit(0)), F.lit(2)))
        parts = F.struct(digits_of(fits).alias("d"), kept.alias("kept"))
        new = let(parts, lambda x: F.concat(F.substr(x["d"], F.lit(1), x["kept"]), let(F.substr(x["d"], x["kept"] + 1), lambda d: permuted(d, key, "phone", inverse))))
        return F.when(fits.isNotNull(), F.concat(refill(fits, new), F.substr(v, F.length(fits) + 1)))

    fits = F.get(F.filter(_beginnings(v), lambda x: F.length(digits_of(x)).between(8, 15)), F.lit(0))
    return F.when(v.rlike(f"^(?:{PHONE_US})$"), let(digits_of(v), national)).otherwise(let(fits, other))


def _ssn(v: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.substring(v, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    rank = F.when(area > 666, area - 2).otherwise(area - 1)  # among the 898 areas 001 to 665 and 667 to 899

    def put(s: Column) -> Column:
        back = F.call_function("div", s["l"], F.lit(99).cast("long"))
        return F.format_string("%03d-%02d-%04d", F.when(back >= 665, back + 2).otherwise(back + 1), F.pmod(s["l"], F.lit(99)) + 1, s["r"] + 1)

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(feistel_halves(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", inverse), put))


def _ip(v: Column, key: str, inverse: bool) -> Column:
    def put(octets: Column) -> Column:
        number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        shifts = F.array(*map(F.lit, (24, 16, 8, 0)))
        text = lambda new: F.array_join(F.transform(shifts, lambda s: F.pmod(F.call_function("div", new, F.pow(F.lit(2), s).cast("long")), F.lit(256)).cast("string")), ".")
        return F.when(F.array_max(octets) <= 255, let(feistel(number, 65_536, 65_536, key, "ip", inverse), text))

    return let(F.transform(F.split(v, r"\."), lambda x: x.cast("long")), put)


def _date(v: Column, key: str, inverse: bool) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    day = F.coalesce(*[F.when(v.rlike(f"^{p}$"), F.try_to_timestamp(v, F.lit(f)).cast("date")) for p, f in ((r"\d{4}-.*", "yyyy-MM-dd"), (r"\d{2}\..*", "dd.MM.yyyy"), (r"\d{2}/.*", "MM/dd/yyyy"))])

    def put(new: Column) -> Column:
        y, m, d = (F.date_format(new, f) for f in ("yyyy", "MM", "dd"))
        return refill(v, F.when(v.contains("-"), F.concat(y, m, d)).when(v.contains("."), F.concat(d, m, y)).otherwise(F.concat(m, d, y)))

    return let(F.datediff(day, first), lambda at: F.when(at.between(0, DAYS[0] * DAYS[1] - 1), let(F.date_add(first, feistel(at, *DAYS, key, "date", inverse).cast("int")), put)))


def _mail(v: Column, key: str, inverse: bool) -> Column:
    if inverse:
        return F.lit(None).cast("string")  # a digest: not invertible
    mark = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(v)), 256), 1, 10), 16, 10).cast("long")
    local = F.lower(F.lpad(F.hex(feistel(mark, 1 << 20, 1 << 20, key, "mail")), 10, "0"))
    return F.concat(F.lit("user-"), local, F.lit("@"), F.substring_index(v, "@", -1))


def kind_of(v: Column) -> Column:
    """The kind of a value that ``ANY`` found."""
    return (
        F.when(v.contains("@"), "mail")
        .when(v.rlike(r"^[A-Z]"), "iban")
        .when(v.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})$"), "date")
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(v.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .otherwise("phone")
    )


def pseudonym(v: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a found value; null if it is not valid for its kind."""
    makers = dict(zip(KINDS, (_mail, _date, _iban, _phone, _ssn, _ip), strict=False))

    def by_kind(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, make in makers.items():
            out = F.when(k == name, make(v, key, inverse)).otherwise(out)
        return out

    return let(kind_of(v), by_kind)


PIECE = "struct<text:string,card:boolean>"


def _piece(text: Column, card: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(card).alias("card"))


def cards_in(run: Column) -> Column:
    """The run in pieces: cards, and what lies between them."""

    def with_tokens(groups: Column) -> Column:
        """``groups``: the digit groups (empty between doubled separators); ``tokens``: each with the separator after it."""
        seps = F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0))
        return F.struct(groups.alias("groups"), F.zip_with(groups, seps, lambda g, sep: F.concat(g, F.coalesce(sep, F.lit("")))).alias("tokens"))

    return let(let(F.split(run, "[ -]"), with_tokens), lambda x: _card_pieces(x["groups"], x["tokens"]))


def _card_pieces(groups: Column, tokens: Column) -> Column:
    n = F.size(groups)

    def raw(i: Column, k: Column) -> Column:
        return F.concat(F.array_join(F.slice(tokens, i + 1, k - 1), ""), F.get(groups, i + k - 1))

    def valid(w: Column) -> Column:
        d = digits_of(w)
        return F.when(F.length(d).between(13, 19), luhn_valid(d)).otherwise(False)

    def window(i: Column, k: Column) -> Column:
        """(k, kind): 2 for a window in a card's shape that begins like one; 1 for another in a card's shape, or one that begins so in groups of two and more digits.

        Groups joined by spaces amid groups joined by hyphens are not of the first kind.
        """

        def judged(w: Column) -> Column:
            shaped, begins = w.rlike(SHAPES), w.rlike(ISSUERS)
            before = F.when(i > 0, F.endswith(F.get(tokens, i - 1), F.lit("-"))).otherwise(False)
            apart = ~((before | F.endswith(F.get(tokens, i + k - 1), F.lit("-"))) & w.contains(" "))
            kind = F.when(shaped & begins & apart, 2).when(shaped | (begins & w.rlike(r"^\d{2,}(?:[ -]\d{2,})*$")), 1).otherwise(0)
            return F.struct(k.alias("k"), F.when((kind > 0) & valid(w), kind).otherwise(0).alias("kind"))

        return let(raw(i, k), judged)

    def mark(i: Column) -> Column:
        """(i, s, w): groups of the shortest window of the first kind, and of the longest of any, that start at i; 0 if there is none."""
        some = F.when(F.get(groups, i) != "", F.sequence(F.lit(1), F.least(F.lit(WINDOW_GROUPS), n - i))).otherwise(F.array().cast("array<int>"))
        best = lambda ws: F.struct(
            i.alias("i"),
            F.coalesce(F.array_min(F.transform(F.filter(ws, lambda x: x["kind"] == 2), lambda x: x["k"])), F.lit(0)).alias("s"),
            F.coalesce(F.array_max(F.transform(F.filter(ws, lambda x: x["kind"] > 0), lambda x: x["k"])), F.lit(0)).alias("w"),
        )
        return let(F.transform(some, lambda k: window(i, k)), best)

    def chosen(marks: Column) -> Column:
        sized = F.transform(F.filter(marks, lambda m: (m["s"] > 0) | (m["w"] > 0)), lambda m: F.struct(m["i"].alias("i"), F.when(m["s"] > 0, m["s"]).when(F.exists(F.slice(marks, m["i"] + 2, m["w"] - 1), lambda x: x["s"] > 0), F.lit(0)).otherwise(m["w"]).alias("k")))
        start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<i:int,k:int>>").alias("got"))
        take = lambda s, m: F.when((m["k"] > 0) & (m["i"] >= s["free"]), F.struct((m["i"] + m["k"]).alias("free"), F.concat(s["got"], F.array(m)).alias("got"))).otherwise(s)
        return F.aggregate(sized, start, take)["got"]

    def pieces(got: Column, ends: Column) -> Column:
        def after(j: Column, upto: Column) -> Column:
            """The text between the end of card j (0: the run's start) and the group ``upto``: first what follows the card's last group."""
            at = F.get(ends, j)
            tail = F.when(j > 0, F.substr(F.get(tokens, at - 1), F.length(F.get(groups, at - 1)) + 1)).otherwise("")
            return F.concat(tail, F.array_join(F.slice(tokens, at + 1, upto - at), ""))

        each = F.transform(got, lambda x, j: F.array(_piece(after(j, x["i"]), False), _piece(raw(x["i"], x["k"]), True)))
        return F.concat(F.flatten(each), F.array(_piece(after(F.size(got), n), False)))

    def with_ends(got: Column) -> Column:
        return let(F.concat(F.array(F.lit(0)), F.transform(got, lambda x: x["i"] + x["k"])), lambda ends: pieces(got, ends))

    return let(F.transform(F.sequence(F.lit(0), n - 1), mark), lambda marks: let(chosen(marks), with_ends))


def pseudonymise(docs: DataFrame, text_col: str = "text", *, key: str, inverse: bool = False) -> DataFrame:
    """docs with personal values replaced, and ``n_mail``, ``n_date``, ``n_iban``, ``n_phone``, ``n_ssn``, ``n_ip``, ``n_card`` (valid values)."""
    text = F.col(f"`{text_col}`")
    counts = [f"n_{k}" for k in KINDS]
    kept = [c for c in docs.columns if c not in counts]
    name = f"done_{uuid.uuid4().hex}"  # no column of docs is called so

    def others(text: Column) -> Column:
        """(text, kinds): a piece without cards, and the kinds of the values replaced."""
        new = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: F.struct(v.alias("was"), kind_of(v).alias("kind"), pseudonym(v, key, inverse).alias("value")))

        def put(found: Column) -> Column:
            joined = F.array_join(F.zip_with(F.split(text, ANY, -1), found, lambda part, v: F.concat(part, F.coalesce(v["value"], v["was"], F.lit("")))), "")
            return F.struct(joined.alias("text"), F.transform(F.filter(found, lambda v: v["value"].isNotNull()), lambda v: v["kind"]).alias("kinds"))

        return let(new, put)

    def whole(p: Column) -> Column:
        plain = F.struct(p["text"].alias("text"), F.array().cast("array<string>").alias("kinds"))
        card = F.struct(_card(p["text"], key, inverse).alias("text"), F.array(F.lit("card")).alias("kinds"))
        return F.when(p["card"], card).when(p["text"].rlike("[0-9@]"), others(p["text"])).otherwise(plain)

    runs = F.zip_with(F.split(text, RUN, -1), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda part, run: F.concat(F.array(_piece(part, False)), F.when(run.isNotNull(), cards_in(run)).otherwise(F.array().cast(f"array<{PIECE}>"))))
    pieces = F.when(text.rlike(RUN), F.flatten(runs)).otherwise(F.array(_piece(text, False)))
    done = docs.select(*[F.col(f"`{c}`") for c in kept], F.when(text.rlike("[0-9@]"), F.transform(_glued(pieces), whole)).alias(name))
    out = F.when(F.col(name).isNotNull(), F.array_join(F.transform(name, lambda p: p["text"]), "")).otherwise(text)
    kinds = F.coalesce(F.flatten(F.transform(name, lambda p: p["kinds"])), F.array().cast("array<string>"))
    tally = [F.size(F.filter(kinds, _is(k))).cast("long").alias(n) for k, n in zip(KINDS, counts, strict=True)]
    return done.select(*[out.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], *tally)


def _is(kind: str):
    return lambda x: x == kind


def _glued(pieces: Column) -> Column:
    """Pieces with those that are not cards joined up to the next card, so that no other value is cut in two."""

    def glue(ps: Column) -> Column:
        cards = F.filter(F.transform(ps, lambda p, i: F.struct(i.alias("i"), p["card"].alias("card"))), lambda x: x["card"])

        def join(at: Column) -> Column:
            plain = lambda j: _piece(F.array_join(F.transform(F.slice(ps, F.get(at, j) + 2, F.get(at, j + 1) - F.get(at, j) - 1), lambda p: p["text"]), ""), False)
            each = F.transform(F.slice(at, 2, F.size(at) - 2), lambda i, j: F.array(plain(j), F.get(ps, i)))
            return F.concat(F.flatten(each), F.array(plain(F.size(at) - 2)))

        return let(F.concat(F.array(F.lit(-1)), F.transform(cards, lambda x: x["i"]), F.array(F.size(ps))), join)

    return let(pieces, glue)


def op10(spark, sf_dir: str) -> DataFrame:
    """The key comes from the session (``spark.folioforge.pii.key``); where none is set, as in checks on invented data, a stated one is taken."""
    from .common import table

    key = spark.conf.get("spark.folioforge.pii.key", None) or "a key for invented data only"
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)

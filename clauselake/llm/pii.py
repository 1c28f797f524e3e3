"""Keyed, format-preserving pseudonyms of personal numbers and dates, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Days of 400 years, 1800 to 2199, and two factors of their number.
FIRST_DAY, DAYS, DAY_LEFT, DAY_RIGHT = "1800-01-01", 146097, 189, 773

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ISO_DATE = r"(?<![0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
DATE = "|".join(rf"(?<![0-9./-])[0-9]{{2}}{s}[0-9]{{2}}{s}[0-9]{{4}}(?![0-9]|[./-][0-9])" for s in (r"\.", "/", "-"))
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
#: Countries by the length of their IBANs; other codes are taken at any length.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?<![A-Za-z0-9])(?:{}|(?!{})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])".format(
    "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
             for n, c in IBANS.items()), "|".join(IBANS.values()).replace(" ", "|"))
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = (r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
         r"|(?<![0-9A-Za-z+])\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])")
#: A whole run of digits, up to where another kind begins; the cards in it are found by their check digits.
CARD_RUN = r"[0-9](?:[ -]?[0-9]){12,}+"
CARD = rf"(?<![0-9])[0-9](?:(?:[ -](?!{'|'.join((ISO_DATE, DATE, IP, SSN, PHONE))}))?[0-9]){{12,}}+"
LEAST_CARD, MOST_CARD, WALK = 13, 19, 100
#: All but e-mails, behind a look at the first characters; e-mails are searched where a text has an @.
NUMBERS = rf"(?=[0-9+(]|[A-Z]{{2}}[0-9])(?:{'|'.join((ISO_DATE, DATE, IP, IBAN, SSN, PHONE, CARD))})"
ALL = f"{EMAIL}|{NUMBERS}"


def _whole(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def _noise(key: Column, kind: Column, turn: Column, half: Column) -> Column:
    """48 keyed bits of one half."""
    mixed = F.concat_ws("|", key, kind, turn.cast("string"), half.cast("string"), key)
    return F.conv(F.substring(F.sha2(mixed, 256), 1, 12), 16, 10).cast("long")


def feistel(left: Column, right: Column, lefts: Column, rights: Column, key: Column, kind: Column, back: bool) -> Column:
    """Struct ``(l, r)``: a keyed permutation of ``[0, lefts) x [0, rights)``; ``back`` undoes it.

    Each round adds a hash of one half to the other, in turn, modulo that half's size.
    """
    sign = -1 if back else 1
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(
        turns, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda s, i: F.struct(
            F.when(i % 2 == 0, F.pmod(s["l"] + sign * F.pmod(_noise(key, kind, i, s["r"]), lefts), lefts)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, F.pmod(s["r"] + sign * F.pmod(_noise(key, kind, i, s["l"]), rights), rights)).otherwise(s["r"]).alias("r")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def _in_pieces(text: Column, size: int, change) -> Column:
    """``text`` in pieces of ``size``, each changed by ``change(piece, number)`` and joined again."""
    pieces = F.regexp_extract_all(text, F.lit(f".{{1,{size}}}"), F.lit(0))
    return F.array_join(F.transform(pieces, change), "")


def _permuted(digits: Column, key: Column, kind: Column, back: bool) -> Column:
    """As many digits, permuted by a Feistel network over two halves; more than 30 in pieces of 30."""
    def change(piece: Column, number: Column) -> Column:
        n = F.length(piece)
        half = F.floor(n / 2).cast("int")
        rest = n - half
        value = lambda start, size: F.concat(F.lit("0"), F.substring(piece, start, size)).cast("long")
        put = lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0"))
        return F.element_at(F.transform(F.array(feistel(
            value(F.lit(1), half), value(half + 1, rest), _power(half), _power(rest), key,
            F.concat_ws("-", kind, n.cast("string"), number.cast("string")), back)), put), 1)

    return _in_pieces(digits, 30, change)


def _letters(letters: Column, key: Column, back: bool) -> Column:
    """As many small letters, permuted like digits; more than 20 in pieces of 20."""
    def change(piece: Column, number: Column) -> Column:
        n = F.length(piece)
        half = F.floor(n / 2).cast("int")
        rest = n - half
        value = lambda t: F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), F.lit(0).cast("long"),
                                      lambda a, c: a * 26 + F.ascii(c) - 97)
        power = lambda k: F.pow(F.lit(26.0), k).cast("long")
        spelled = lambda v, k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.transform(
            F.sequence(k - 1, F.lit(0), F.lit(-1)), lambda i: F.char(F.floor(v / power(i)) % 26 + 97)), ""))
        return F.element_at(F.transform(F.array(feistel(
            value(F.substring(piece, F.lit(1), half)), value(F.substring(piece, half + 1, rest)), power(half), power(rest), key,
            F.concat_ws("-", F.lit("mail"), n.cast("string"), number.cast("string")), back)),
            lambda s: F.concat(spelled(s["l"], half), spelled(s["r"], rest))), 1)

    return _in_pieces(letters, 20, change)


def _laid(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn."""
    done = F.aggregate(
        F.split(value, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(
            F.concat(s["t"], F.substring(digits, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k"))))
    return done["t"]


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    return F.pmod(F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10)), F.lit(0), lambda a, b: a + b), F.lit(10))


def _mod97(text: Column) -> Column:
    """Remainder of a text of digits and capital letters (A is 10) read as one number."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _card_groups(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0))


def _is_card(groups: Column, at: Column, many: Column) -> Column:
    return F.element_at(F.transform(F.array(F.array_join(F.slice(groups, at + 1, many), "")), lambda d: F.length(d).between(
        LEAST_CARD, MOST_CARD) & (_luhn(d) == 0)), 1)


def _card_marks(groups: Column) -> Column:
    """Per group of digits of a run: the groups of the card that begins there, 0 if none does, -1 inside a card.

    From left to right the longest valid card at each group; cards begin and end with a group.
    """
    n = F.size(groups)
    most = lambda i: F.coalesce(F.array_max(F.filter(
        F.sequence(F.lit(1), F.least(F.lit(MOST_CARD), n - i)), lambda m: _is_card(groups, i, m))), F.lit(0))
    put = lambda s, i, k: F.struct(
        F.greatest(s["next"], i + k).alias("next"), F.concat(s["marks"], F.array(k)).alias("marks"))
    return F.aggregate(
        F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("marks")),
        lambda s, i: F.when(i < s["next"], put(s, i, F.lit(-1))).otherwise(
            F.element_at(F.transform(F.array(most(i)), lambda k: put(s, i, k)), 1)))["marks"]


def _sealed_card(digits: Column, key: Column, back: bool) -> Column:
    body = _permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"), back)
    return F.element_at(F.transform(F.array(body), lambda b: F.concat(
        b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))), 1)


def _card(run: Column, key: Column, back: bool) -> Column:
    """All cards of a run of digits.

    Each goes on from number to number until the same cards are found in the run again, so that the
    way back finds them too; it takes them in the opposite order.
    """
    def changed(groups: Column, marks: Column) -> Column:
        n = F.size(groups)

        def swapped(g: Column, at: Column, many: Column) -> Column:
            part = F.array_join(F.slice(g, at + 1, many), " ")
            new = F.split(_laid(part, _sealed_card(_digits(part), key, back)), " ")
            return F.concat(F.slice(g, F.lit(1), at), new, F.slice(g, at + many + 1, n))

        def others(g: Column, at: Column) -> Column:
            """True if the run would now be cut in another way before the end of the card."""
            return F.exists(F.sequence(F.greatest(F.lit(0), at - MOST_CARD + 1), at), lambda i: F.element_at(marks, i + 1).between(
                0, MOST_CARD) & F.exists(F.sequence(F.lit(1), F.lit(MOST_CARD)), lambda m: (m > F.element_at(marks, i + 1)) & (
                    i + m <= n) & (i + m > at) & _is_card(g, i, m)))

        order = F.sequence(F.lit(0), n - 1)
        return F.aggregate(F.reverse(order) if back else order, groups, lambda g, at: F.when(
            F.element_at(marks, at + 1) > 0, F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), g, lambda s, t: F.when(
                (t == 0) | others(s, at), swapped(s, at, F.element_at(marks, at + 1))).otherwise(s))).otherwise(g))

    marked = F.transform(F.array(_card_groups(run)), lambda g: F.struct(g.alias("g"), _card_marks(g).alias("marks")))
    new = F.element_at(F.transform(marked, lambda r: F.when(
        F.exists(r["marks"], lambda k: k > 0), changed(r["g"], r["marks"])).otherwise(r["g"])), 1)
    between = F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0))
    return F.array_join(F.zip_with(new, between, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")


def _iban(value: Column, key: Column, back: bool) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    tail = F.substring(plain, F.lit(5), F.length(plain) - 4)
    new = _laid(tail, _permuted(_digits(tail), key, F.lit("iban"), back))
    head = F.substring(plain, 1, 2)
    sealed = F.element_at(F.transform(F.array(new), lambda b: F.concat(
        head, F.lpad((98 - _mod97(F.concat(b, head, F.lit("00")))).cast("string"), 2, "0"), b)), 1)
    valid = _mod97(F.concat(tail, head, F.substring(plain, 3, 2))) == 1
    return F.when(valid & (F.length(_digits(tail)) > 1), _laid(value, _digits(sealed))).otherwise(value)


def _ssn(value: Column, key: Column, back: bool) -> Column:
    """Goes on from number to number until one is valid, so that valid ones are permuted among themselves."""
    valid = lambda v: ~v.rlike("^(000|666|9)|-00-|0000$")
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(40)), value, lambda v, i: F.when(
        (i == 0) | ~valid(v), _laid(v, _permuted(_digits(v), key, F.lit("ssn"), back))).otherwise(v))
    return F.when(valid(value), walked).otherwise(value)


def _ip(value: Column, key: Column, back: bool) -> Column:
    part = F.transform(F.split(value, r"\."), lambda p: p.cast("int"))
    mixed = F.transform(F.array(feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, F.lit("ip"), back)),
                        lambda s: F.concat_ws(".", *[(F.floor(h / d) % 256).cast("string") for h in (s["l"], s["r"]) for d in (256, 1)]))
    valid = ~F.exists(part, lambda p: p > 255) & ~value.rlike(r"(^|\.)0[0-9]")
    return F.when(valid, F.element_at(mixed, 1)).otherwise(value)


def _date(value: Column, form: str, key: Column, back: bool, walk: bool = False) -> Column:
    """The date as another date of the same form; ``walk`` goes on until its day is over 12."""
    day = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(form))), F.to_date(F.lit(FIRST_DAY)))
    written = lambda n: F.date_add(F.to_date(F.lit(FIRST_DAY)), n.cast("int"))
    turned = lambda n: F.element_at(F.transform(F.array(feistel(
        F.floor(n / DAY_RIGHT), F.pmod(n, F.lit(DAY_RIGHT)), F.lit(DAY_LEFT), F.lit(DAY_RIGHT), key, F.lit("date"), back)),
        lambda s: s["l"] * DAY_RIGHT + s["r"]), 1)
    new = F.aggregate(F.sequence(F.lit(0), F.lit(40 if walk else 0)), day.cast("long"), lambda n, i: F.when(
        (i == 0) | (F.dayofmonth(written(n)) <= 12), turned(n)).otherwise(n))
    return F.when((day >= 0) & (day < DAYS), F.date_format(written(new), form))


def _any_date(value: Column, key: Column, back: bool) -> Column:
    """Day first where that is a date, else month first among the dates that read in this way only."""
    return F.coalesce(*[F.when(value.contains(sep), F.coalesce(
        _date(value, f"dd{sep}MM{sep}yyyy", key, back), _date(value, f"MM{sep}dd{sep}yyyy", key, back, walk=True)))
        for sep in ("/", ".", "-")], value)


def _email(value: Column, key: Column, back: bool) -> Column:
    """Letters and digits of the local part, each kind permuted among itself as one number."""
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    low = F.lower(local)
    new_letters = _letters(F.regexp_replace(low, "[^a-z]", ""), key, back)
    with_digits = _laid(low, _permuted(_digits(low), key, F.lit("mail-digits"), back))
    done = F.aggregate(
        F.split(with_digits, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike("[a-z]"), F.struct(
            F.concat(s["t"], F.substring(new_letters, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k"))))
    return F.concat(done["t"], F.lit("@"), host)


def pseudonym(value: Column, key: Column, back: bool = False) -> Column:
    """The pseudonym of one found value; a value that fails its validation comes back as it is."""
    prefix = F.regexp_extract(value, r"^(\+[0-9]{1,3})(?=[ .(-])", 1)
    rest = F.substring(value, F.length(prefix) + 1, F.length(value) - F.length(prefix))
    return (
        F.when(value.contains("@"), _email(value, key, back))
        .when(_whole(value, ISO_DATE), F.coalesce(_date(value, "yyyy-MM-dd", key, back), value))
        .when(_whole(value, DATE), _any_date(value, key, back))
        .when(_whole(value, IP), _ip(value, key, back))
        .when(_whole(value, IBAN), _iban(value, key, back))
        .when(_whole(value, SSN), _ssn(value, key, back))
        .when(_whole(value, PHONE), F.concat(prefix, _laid(rest, _permuted(_digits(rest), key, F.lit("phone"), back))))
        .when(_whole(value, CARD_RUN), _card(value, key, back))
        .otherwise(value))


def pseudonymised(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``docs (text, ...)`` with values in ``text`` replaced by keyed pseudonyms, and ``values_replaced``.

    Found: payment cards (Luhn), IBANs (remainder 97), IPv4 addresses, US social security numbers, phone
    numbers, dates of 1800 to 2199 and e-mail local parts. Each is permuted among the values of its own
    format by a Feistel network keyed with ``key``, check digits are set anew, separators stay; so equal
    values get equal pseudonyms in all documents, different ones differ, and ``back=True`` undoes it
    (but for capitals of e-mails, and cards in long rows of one-digit numbers). A card beside other
    digits is found by its check digits and may, so that the way back finds it too, get another
    pseudonym than alone. Values that fail validation stay. Each row is worked out by itself,
    without a shuffle. Null and empty texts stay; other columns pass through, except that one named
    ``values_replaced`` is replaced; an empty table gives an empty one.
    """
    secret = F.lit(key)
    mail = F.col("text").contains("@")
    found = F.when(mail, F.regexp_extract_all("text", F.lit(ALL), 0)) \
        .when(F.col("text").rlike("[0-9]"), F.regexp_extract_all("text", F.lit(NUMBERS), 0))
    searched = docs.drop("values_replaced").select("*", F.inline(F.array(F.struct(found.alias("__pii_old")))))
    new = F.transform("__pii_old", lambda v: pseudonym(v, secret, back))
    made = searched.select("*", F.inline(F.array(F.struct(F.when(F.size("__pii_old") > 0, new).alias("__pii_new")))))
    between = F.when(mail, F.split("text", ALL, -1)).otherwise(F.split("text", NUMBERS, -1))
    text = F.when(F.col("__pii_new").isNull(), F.col("text")).otherwise(
        F.array_join(F.zip_with(between, "__pii_new", lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), ""))
    changed = F.aggregate(
        F.filter(F.arrays_zip("__pii_old", "__pii_new"), lambda p: p["__pii_old"] != p["__pii_new"]), F.lit(0),
        lambda n, p: n + F.when(_whole(p["__pii_old"], CARD_RUN), F.size(F.filter(
            _card_marks(_card_groups(p["__pii_old"])), lambda k: k > 0))).otherwise(1))
    return made.withColumn("text", text).withColumn("values_replaced", F.coalesce(F.when(F.col("__pii_new").isNotNull(), changed), F.lit(0))) \
        .drop("__pii_old", "__pii_new")

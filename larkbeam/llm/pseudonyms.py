"""Pseudonyms for personal data by a keyed Feistel permutation within its format.

What looks like personal data is checked (a card's check digit, the ranges of an
address, a day in the calendar) and its characters are permuted: digits become
digits, separators stay, and what was valid stays valid. The permutation depends
on the key alone, so equal values have equal pseudonyms in all documents, and
with the key it can be undone. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

_EMAIL = r"[A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}"
_IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
_PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_DAY = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?=T\d{2}:?\d{2}|(?!\w|[./-]\d))"
_CLOUD_KEY = r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)"
_HEX_KEY = r"(?<!\w)[0-9A-Fa-f]{40}(?!\w)"
# after a blank, letters alone are a word of prose or code unless they are quoted
_GIVEN = r"""["']?[ \t]*+[=:][ \t]*+"""
_PASSWORD = (
    r"(?<!\w)(?i:password|passwd|secret|token|api_key)"
    rf"""(?:[=:]|{_GIVEN}(?:["']|(?=[A-Za-z]*+\d)))[A-Za-z0-9]{{6,}}(?!\w)"""
)
#: Numbers with a blank or hyphen between them, 13 digits or more together, in which cards are looked for. Ends before
#: what has digits of its own but cannot be told from its first numbers: days with slashes or a time, phones, addresses.
_NUMBER = r"\d++(?!\w|\.\d|[\w.%+-]{0,64}@)"
_OTHER = r"\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2}T|\d{3}-\d{2}-\d{4}\.\d|\d{3}[ -]\d{3}(?:\.\d{4}|[ -]\d{4}\.\d)"
_NUMBERS = rf"(?<![\w.])(?=\d(?:[ -]?\d){{12}}){_NUMBER}(?:[ -](?!{_OTHER}){_NUMBER})*+"

#: Earlier kinds come first where several begin at the same place.
PATTERN = "|".join([_EMAIL, _PASSWORD, _CLOUD_KEY, _HEX_KEY, _DAY, _SSN, _PHONE, _IPV4, _NUMBERS])
_IN_NUMBERS = "|".join([_HEX_KEY, _DAY, _SSN, _PHONE])

_FIRST_DAY, _DAYS = "1900-01-01", 73049  # to 2099-12-31


def _power(radix: int, n: Column) -> Column:
    return F.pow(F.lit(radix), n).cast("decimal(20,0)")


def feistel(text: Column, radix: int, key: str, tweak: str) -> Column:
    """A permutation of the strings of a length, of digits below ``radix``.

    Two halves take turns in adding a keyed hash of the other. Takes strings of
    up to 24 digits for radix 36, 30 for 16 and 36 for 10.
    """
    n = F.length(text)
    left, right = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")

    def number(part: Column) -> Column:
        return F.coalesce(F.conv(part, radix, 10).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))

    def keyed(i: Column, part: Column) -> Column:
        hashed = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), n, i, part), 256)
        return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("decimal(20,0)")

    def turn(halves: Column, i: Column) -> Column:
        a, b = halves["a"], halves["b"]
        even = i % 2 == 0
        size = F.when(even, left).otherwise(right)
        changed = F.when(even, a).otherwise(b) + keyed(i, F.when(even, b).otherwise(a))
        new = F.pmod(changed, _power(radix, size)).cast("decimal(20,0)")
        return F.struct(F.when(even, new).otherwise(a).alias("a"), F.when(even, b).otherwise(new).alias("b"))

    def written(part: Column, size: Column) -> Column:
        return F.lpad(F.conv(part.cast("string"), 10, radix), size, F.lit("0"))

    start = F.struct(number(F.substr(text, F.lit(1), left)).alias("a"), number(F.substr(text, left + 1, right)).alias("b"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn,
        lambda end: F.concat(written(end["a"], left), written(end["b"], right)),
    )


def walked(text: Column, radix: int, key: str, tweak: str, valid: Callable[[Column], Column]) -> Column:
    """The permutation among the valid strings: it is repeated until it gives one.

    Where 64 turns find none, the text stays, which is next to impossible if half
    of the strings are valid.
    """
    turns = F.sequence(F.lit(1), F.lit(64))
    first = F.struct(text.alias("at"), F.lit(False).alias("done"))

    def turn(state: Column, _: Column) -> Column:
        # an array of one, so that the permutation is worked out once a turn
        def judged(new: Column) -> Column:
            return F.struct(new.alias("at"), valid(new).alias("done"))

        once = F.transform(F.array(feistel(state["at"], radix, key, tweak)), judged)[0]
        return F.when(state["done"], state).otherwise(once)

    return F.aggregate(turns, first, turn, lambda end: F.when(end["done"], end["at"]).otherwise(text))


def _only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def _laid_out(original: Column, characters: Column, kept: str) -> Column:
    """``original`` with its characters among ``kept`` replaced by ``characters``, in order."""

    def at(c: Column, i: Column) -> Column:
        before = F.length(_only(F.substr(original, F.lit(1), i + 1), kept))
        return F.when(c.rlike(f"^[{kept}]$"), F.substr(characters, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(original, ""), at), "")


def _luhn(digits: Column) -> Column:
    """The sum that is divisible by ten if the last digit is right."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    places = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(places, F.lit(0), lambda a, b: a + b)


def _card(text: Column, key: str) -> Column:
    digits = _only(text, "0-9")
    inner = F.substr(digits, F.lit(2), F.length(digits) - 2)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel(inner, 10, key, "card"))
    last = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(digits) % 10 == 0, _laid_out(text, F.concat(body, last), "0-9")).otherwise(text)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _cards(numbers: Column) -> Column:
    """Where cards lie in numbers: for each number how many from it on are a card, or 0.

    A number alone and the usual groups come first, in any place; else the most
    numbers that have 13 to 19 digits and a right check digit.
    """

    def valid(i: Column, n: Column) -> Column:
        digits = F.array_join(F.slice(numbers, i, n), "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits) % 10 == 0).otherwise(False)

    def usual(_: Column, i: Column) -> Column:
        sizes = F.array_join(F.transform(F.slice(numbers, i + 1, F.lit(5)), F.length), " ")
        out = F.when(valid(i + 1, F.lit(1)), 1)
        for shape, n in (("^4 4 4 4( |$)", 4), ("^4 6 [45]( |$)", 3), ("^4 4 4 4 3$", 5)):
            out = out.when(sizes.rlike(shape) & valid(i + 1, F.lit(n)), n)
        return out.otherwise(0)

    def longest(firsts: Column) -> Column:
        def at(first: Column, i: Column) -> Column:
            def free(n: Column) -> Column:
                return valid(i + 1, n) & ~F.exists(F.slice(firsts, i + 1, n), lambda x: x > 0)

            most = F.sequence(F.lit(1), F.least(F.lit(19), F.size(numbers) - i))
            return F.when(first > 0, first).otherwise(F.coalesce(F.array_max(F.filter(most, free)), F.lit(0)))

        return F.transform(firsts, at)

    return _let(F.transform(numbers, usual), longest)


def _cuts(numbers: Column) -> Column:
    """``at`` and ``n``: where each card begins in the text of the numbers, and its length. None overlap."""

    def taken(cards: Column) -> Column:
        start = F.struct(
            F.lit(1).alias("next"), F.lit(1).alias("at"), F.expr("cast(array() as array<struct<at: int, n: int>>)").alias("cuts")
        )

        def turn(state: Column, i: Column) -> Column:
            n = F.get(cards, i - 1)
            take = (i >= state["next"]) & (n > 0)
            size = F.length(F.array_join(F.slice(numbers, i, n), " "))
            one = F.array(F.struct(state["at"].alias("at"), size.alias("n")))
            return F.struct(
                F.when(take, i + n).otherwise(state["next"]).alias("next"),
                (state["at"] + F.length(F.get(numbers, i - 1)) + 1).alias("at"),
                F.when(take, F.concat(state["cuts"], one)).otherwise(state["cuts"]).alias("cuts"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.size(numbers)), start, turn, lambda end: end["cuts"])

    return _let(_cards(numbers), taken)


def _piece(text: Column, found: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(found).alias("found"))


def _around(text: Column, pattern: str) -> Column:
    """Pieces of the text: what the pattern finds, and what lies between."""
    both = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda a, b: F.when(b.isNull(), F.array(_piece(a, False))).otherwise(F.array(_piece(a, False), _piece(b, True))),
    )
    return F.flatten(both)


def _number_pieces(text: Column, before: Column, after: Column) -> Column:
    """Pieces of a match of ``_NUMBERS``: cards, other personal data between them, and the rest.

    ``before`` and ``after`` are what stands around it, as far as other kinds look at that.
    """

    def pieces(cuts: Column) -> Column:
        def at(i: Column) -> Column:
            last = F.get(cuts, i - 1)
            begin = F.when(i > 0, last["at"] + last["n"]).otherwise(1)
            own = F.get(cuts, i)
            stop = F.when(i < F.size(cuts), own["at"]).otherwise(F.length(text) + 1)
            left = F.when(i == 0, before).otherwise("")
            right = F.when(i == F.size(cuts), after).otherwise("")
            plain = _around(F.concat(left, F.substr(text, begin, stop - begin), right), _IN_NUMBERS)

            def bare(all_: Column) -> Column:
                def cut(p: Column, k: Column) -> Column:
                    skip = F.when(k == 0, F.length(left)).otherwise(0)
                    size = F.length(p["text"]) - skip - F.when(k == F.size(all_) - 1, F.length(right)).otherwise(0)
                    return F.struct(F.substr(p["text"], skip + 1, size).alias("text"), p["found"].alias("found"))

                return F.transform(all_, cut)

            card = F.when(i < F.size(cuts), F.array(_piece(F.substr(text, own["at"], own["n"]), True)))
            return F.concat(_let(plain, bare), F.coalesce(card, F.slice(F.array(_piece(F.lit(""), False)), 1, 0)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), at))

    return _let(_let(F.split(text, "[ -]"), _cuts), pieces)


def _phone(text: Column, key: str) -> Column:
    digits = _only(text, "0-9")
    country = F.substr(digits, F.lit(1), F.length(digits) - 10)
    own = F.right(digits, F.lit(10))

    def usual(d: Column) -> Column:
        return d.rlike("^[2-9]..[2-9]")

    new = F.when(usual(own), walked(own, 10, key, "phone", usual)).otherwise(
        walked(own, 10, key, "phone", lambda d: ~usual(d))
    )
    return _laid_out(text, F.concat(country, new), "0-9")


def _ssn(text: Column, key: str) -> Column:
    def given(d: Column) -> Column:
        return ~d.rlike("^(000|666|9)|^...00|0000$")

    digits = _only(text, "0-9")
    return F.when(given(digits), _laid_out(text, walked(digits, 10, key, "ssn", given), "0-9")).otherwise(text)


def _ipv4(text: Column, key: str) -> Column:
    parts = F.split(text, r"\.")
    valid = F.forall(parts, lambda p: p.cast("int") <= 255)
    as_hex = F.array_join(F.transform(parts, lambda p: F.lpad(F.hex(p.cast("long")), 2, "0")), "")
    new = feistel(as_hex, 16, key, "ipv4")
    octets = F.transform(F.array(*[F.lit(i) for i in (1, 3, 5, 7)]), lambda i: F.conv(F.substr(new, i, F.lit(2)), 16, 10))
    return F.when(valid, F.array_join(octets, ".")).otherwise(text)


def _day(text: Column, key: str) -> Column:
    forms = ["yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy"]
    pattern = [r"^\d{4}-", r"^..\.", r"^../", r"^../"]
    first = F.to_date(F.lit(_FIRST_DAY))
    out = text
    for form, shape in reversed(list(zip(forms, pattern))):
        day = F.try_to_timestamp(text, F.lit(form)).cast("date")
        number = F.lpad(F.datediff(day, first).cast("string"), 5, "0")
        new = walked(number, 10, key, "day", lambda d: d.cast("int") < _DAYS)
        known = text.rlike(shape) & day.between(first, F.date_add(first, _DAYS - 1))
        moved = F.date_format(F.date_add(first, new.cast("int")), form)
        out = F.when(F.coalesce(known, F.lit(False)), moved).otherwise(out)
    return out


def _blocks(plain: Column, radix: int, size: int, key: str, tweak: str) -> Column:
    """Strings of any length, in blocks that the permutation takes."""
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(plain) - 1) / size)),
        lambda i: F.lower(feistel(F.substr(plain, (i * size + 1).cast("int"), F.lit(size)), radix, key, tweak)),
    )
    return F.when(F.length(plain) > 0, F.array_join(cut, "")).otherwise("")


def _key_text(text: Column, key: str, tweak: str, radix: int = 36) -> Column:
    """The same for upper and lower case, but laid out in the case of the text."""
    plain = F.lower(_only(text, "A-Za-z0-9"))
    new = _laid_out(text, _blocks(plain, radix, 24 if radix == 36 else 30, key, tweak), "A-Za-z0-9")
    mixed = F.zip_with(F.split(text, ""), F.split(new, ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b))
    return (
        F.when(~text.rlike("[A-Z]"), new).when(~text.rlike("[a-z]"), F.upper(new)).otherwise(F.array_join(mixed, ""))
    )


def _name(text: Column, key: str) -> Column:
    """Letters become letters, and digits digits. 26 letters are digits of radix 26 meanwhile."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
    as_digits = F.translate(F.lower(_only(text, "A-Za-z")), letters, digits)
    moved = F.translate(_blocks(as_digits, 26, 26, key, "mail"), digits, letters)
    lettered = _laid_out(text, moved, "A-Za-z")
    return _laid_out(lettered, _blocks(_only(text, "0-9"), 10, 30, key, "mail"), "0-9")


def pseudonym(found: Column, key: str) -> Column:
    """What takes the place of one match of ``PATTERN``; the match itself if it is not valid."""
    name, at = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    given = F.regexp_extract(found, f"""^[A-Za-z_]+{_GIVEN}["']?""", 0)
    value = F.substr(found, F.length(given) + 1, F.length(found))

    def is_(pattern: str) -> Column:
        return found.rlike(f"^(?:{pattern})$")

    def cloud(text: Column) -> Column:
        return F.concat(F.lit("AKIA"), F.upper(_key_text(F.substr(text, F.lit(5), F.lit(16)), key, "cloud")))

    # a key with a name before it is still the same key
    secret = (
        F.when(value.rlike(f"^{_CLOUD_KEY}$"), cloud(value))
        .when(value.rlike(f"^{_HEX_KEY}$"), _key_text(value, key, "hex", 16))
        .otherwise(_key_text(value, key, "secret"))
    )
    return (
        F.when(is_(_EMAIL), F.concat(_name(name, key), F.lit("@"), at))
        .when(is_(_PASSWORD), F.concat(given, secret))
        .when(is_(_CLOUD_KEY), cloud(found))
        .when(is_(_HEX_KEY), _key_text(found, key, "hex", 16))
        .when(is_(_DAY), _day(found, key))
        .when(is_(_SSN), _ssn(found, key))
        .when(is_(_PHONE), _phone(found, key))
        .when(is_(_IPV4), _ipv4(found, key))
        .otherwise(_card(found, key))
    )


def pseudonymised(df: DataFrame, text: str = "text", key: str = "larkbeam", count: str | None = None) -> DataFrame:
    """``df`` with personal data in the whole of ``text`` replaced, and all other columns as they are.

    ``count`` names a new column for how many values were replaced; it takes the
    place of one of that name. Null texts stay null with a count of 0, and empty
    ones empty. Equal values are replaced alike in all rows. Values keep their
    length, except that numbers of an IP address may get more or fewer digits.
    Lower and upper case of mail names and of secrets is not told apart, but secrets keep theirs.
    """
    row = df.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    found = row.withColumn("_found", F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0)))
    found = found.withColumn("_between", F.when(F.size("_found") > 0, F.split("_text", PATTERN, -1)))
    numbers, other = rf"^(?:{_NUMBERS})$", rf"^(?:{_IN_NUMBERS})$"

    def pieces(m: Column, i: Column) -> Column:
        plain = F.get("_between", i)
        before = F.regexp_extract(plain, "[-/+]$", 0)
        after = F.regexp_extract(F.coalesce(F.get("_between", i + 1), F.lit("")), "^[-/].?", 0)
        inside = F.when(m.rlike(numbers) & ~m.rlike(other), _number_pieces(m, before, after)).otherwise(F.array(_piece(m, True)))
        return F.concat(F.array(_piece(plain, False)), inside)

    last = F.array(_piece(F.element_at("_between", -1), False))
    cut = found.withColumn("_pieces", F.when(F.size("_found") > 0, F.concat(F.flatten(F.transform("_found", pieces)), last)))
    made = cut.withColumn("_new", F.transform("_pieces", lambda p: F.when(p["found"], pseudonym(p["text"], key)).otherwise(p["text"])))
    changed = F.size(F.filter(F.zip_with("_pieces", "_new", lambda p, new: p["text"] != new), lambda x: x))
    done = made.select(
        "_row", F.when(F.size("_found") > 0, F.array_join("_new", "")).otherwise(F.col("_text")).alias("_text"),
        F.greatest(F.coalesce(changed, F.lit(0)), F.lit(0)).alias("_changed"),
    )
    columns = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in df.columns if c != count]
    return done.select(*columns, *([F.col("_changed").alias(count)] if count else []))

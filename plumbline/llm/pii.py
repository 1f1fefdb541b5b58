"""Format-preserving pseudonyms: personal data replaced by a keyed permutation of its own format.

Column expressions only. Every value is read as a list of numbers, each with its
own base (digits, octets, the parts of a day number), and permuted by a Feistel
network over that list, so that equal values stay equal in all documents and the
key's owner can turn them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Brackets around found values while a text is in pieces; texts that hold them are escaped first.
OPEN, ESCAPE = "\x01", "\x02"

# The shapes of personal data, tried in this order at each place.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-][0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{8,15}(?![0-9])",
}
# Valid cards and accounts are marked before, so that those which fail their check hide nothing.
ANY = "|".join(shape for kind, shape in SHAPES.items() if kind not in ("iban", "card"))
# Runs of digits and of capitals in which cards and accounts stand between neighbours; no end is fixed yet.
CARD_RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+(?![0-9])"
IBAN_RUN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![A-Za-z0-9])(?: [A-Z0-9]++(?![A-Za-z0-9]))*+"
# How cards are written in groups; such a span comes before all others of several groups.
GROUPED = r"^(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
DAYS = (189, 773)  # 400 years have 189 * 773 days
FIRST_DAY = "1700-01-01"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(values: Column, bases: Column, key: str, kind: str, back: bool = False) -> Column:
    """Permutes a list of numbers, each below its base; ``back`` undoes it.

    The front half and the back half take turns: each number of one half moves by
    a hash of the key, the kind, the round and the other half, modulo its base.
    A single number has no other half; it moves by the hash of the key alone.
    """
    size = F.size(values)

    def turn(state: Column, at: Column) -> Column:
        front = (F.size(state) + F.lit(1)).cast("int") / F.lit(2)
        split = F.floor(front).cast("int")

        def inside(i: Column) -> Column:
            return (i < split) == (at % 2 == 0)

        other = F.array_join(F.filter(state, lambda v, i: ~inside(i)).cast("array<string>"), ",")
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.size(state).cast("string"), at.cast("string"), other), 256)

        def move(seeded: Column) -> Column:
            def shift(v: Column, i: Column) -> Column:
                drawn = F.conv(F.substring(F.sha2(F.concat(seeded, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
                base = F.get(bases, i)
                by = drawn % base
                moved = F.pmod(v - by, base) if back else (v + by) % base
                return F.when(inside(i), moved).otherwise(v)

            return F.transform(state, shift)

        return let(seed, move)

    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    return F.when(size == 0, values).otherwise(F.aggregate(rounds, values, turn))


def digits_of(text: Column) -> Column:
    """The digits of a text as numbers."""
    return F.split(F.regexp_replace(text, "[^0-9]", ""), "").cast("array<bigint>")


def refill(text: Column, digits: Column) -> Column:
    """Puts new digits in the places of the old; all other characters stay."""
    chars = F.split(text, "")
    # Walks once over the characters with the number of digits used so far.
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def place(state: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, F.get(digits, state["used"]).cast("string")).otherwise(c)).alias("out"),
            (state["used"] + is_digit.cast("int")).alias("used"),
        )

    return F.aggregate(chars, start, place, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last of which is the check digit."""
    def weigh(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when((F.size(digits) - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(digits, weigh), F.lit(0).cast("long"), lambda a, x: a + x)


def tens(digits: Column) -> Column:
    return F.transform(digits, lambda _: F.lit(10).cast("long"))


def card(text: Column, key: str, back: bool) -> Column:
    """A number that passes the Luhn check: the payload is permuted, the check digit follows."""
    def renew(digits: Column) -> Column:
        payload = F.slice(digits, 1, F.size(digits) - 1)
        moved = feistel(payload, tens(payload), key, "card", back)
        return let(moved, lambda m: let(F.concat(m, F.array(F.lit(0).cast("long"))), lambda z: refill(text, F.concat(m, F.array((10 - luhn_sum(z) % 10) % 10)))))

    return let(digits_of(text), lambda d: F.when(luhn_sum(d) % 10 == 0, renew(d)))


def plain_digits(kind: str, valid: Callable[[Column], Column] | None = None):
    def make(text: Column, key: str, back: bool) -> Column:
        moved = let(digits_of(text), lambda d: let(feistel(d, tens(d), key, kind, back), lambda m: refill(text, m)))
        return F.when(valid(text), moved) if valid else moved

    return make


def phone(text: Column, key: str, back: bool) -> Column:
    """The country code and all punctuation stay; the other digits are permuted."""
    code = F.regexp_extract(text, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9])?", 0)

    def renew(c: Column) -> Column:
        rest = F.substring(text, F.length(c) + 1, F.length(text))
        return F.concat(c, let(digits_of(rest), lambda d: let(feistel(d, tens(d), key, "phone", back), lambda m: refill(rest, m))))

    return let(code, renew)


def ip(text: Column, key: str, back: bool) -> Column:
    """Four octets, each permuted as a whole number below 256."""
    octets = F.split(text, r"\.").cast("array<bigint>")
    fine = F.forall(octets, lambda o: o < 256)
    bases = F.array_repeat(F.lit(256).cast("long"), 4)
    return F.when(fine, F.array_join(feistel(octets, bases, key, "ip", back).cast("array<string>"), "."))


def ssn(text: Column, key: str, back: bool) -> Column:
    """Area (not 000, 666 or from 900), group and serial (not zero), each permuted among the valid ones."""
    parts = F.split(text, "-").cast("array<bigint>")

    def renew(p: Column) -> Column:
        area, group, serial = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
        rank = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
        bases = F.array(F.lit(898).cast("long"), F.lit(99).cast("long"), F.lit(9999).cast("long"))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)

        def write(m: Column) -> Column:
            a = F.get(m, F.lit(0)) + 1
            a = F.when(a >= 666, a + 1).otherwise(a)
            pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
            return F.concat_ws("-", pad(a, 3), pad(F.get(m, F.lit(1)) + 1, 2), pad(F.get(m, F.lit(2)) + 1, 4))

        return F.when(valid, let(feistel(rank, bases, key, "ssn", back), write))

    return let(parts, renew)


def date(text: Column, key: str, back: bool) -> Column:
    """A day of the years 1700 to 2099, moved among all such days; the order and marks of its parts stay."""
    mark = F.when(text.rlike("^[0-9]{4}"), F.lit("-")).otherwise(F.substring(text, 3, 1))
    iso = F.when(text.rlike("^[0-9]{4}"), text).otherwise(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)))
    number = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    low, high = DAYS
    bases = F.array(F.lit(low).cast("long"), F.lit(high).cast("long"))

    def renew(n: Column) -> Column:
        values = F.array(F.floor(n / high).cast("long"), n % high)
        moved = feistel(values, bases, key, "date", back)
        day = let(moved, lambda m: F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(m, F.lit(0)) * high + F.get(m, F.lit(1))).cast("int")))
        written = let(day, lambda d: F.when(mark == "-", F.date_format(d, "yyyy-MM-dd")).when(mark == "/", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy")))
        return F.when((n >= 0) & (n < low * high), written)

    return let(number, renew)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def characters(text: Column, key: str, kind: str, back: bool) -> Column:
    """ASCII letters and digits permuted within their kind (small, capital, digit); the rest stays."""
    chars = F.split(text, "")
    base = lambda c: F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1).cast("long")
    rank = lambda c: F.when(base(c) == 1, 0).when(base(c) == 10, F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97).cast("long")

    def write(moved: Column) -> Column:
        def one(c: Column, m: Column) -> Column:
            small = F.substring(F.lit(LETTERS), (m + 1).cast("int"), F.lit(1))
            return F.when(base(c) == 1, c).when(base(c) == 10, m.cast("string")).when(c.rlike("^[A-Z]$"), F.upper(small)).otherwise(small)

        return F.array_join(F.zip_with(chars, moved, one), "")

    return let(feistel(F.transform(chars, rank), F.transform(chars, base), key, kind, back), write)


def email(text: Column, key: str, back: bool) -> Column:
    """Name and domain are permuted within their kinds of characters; the last label (such as com) stays."""
    top = F.regexp_extract(text, r"\.[A-Za-z]+$", 0)
    rest = F.substring(text, F.lit(1), F.length(text) - F.length(top))
    return F.concat(characters(rest, key, "email", back), top)


def remainder(chars: Column) -> Column:
    """Capitals and digits modulo 97, letters read as 10 to 35."""
    number = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55).cast("long")
    step = lambda a, c: F.when(number(c) > 9, (a * 100 + number(c)) % 97).otherwise((a * 10 + number(c)) % 97)
    return F.aggregate(F.split(chars, ""), F.lit(0).cast("long"), step)


def iban(text: Column, key: str, back: bool) -> Column:
    """An account number that passes the mod-97 check: the account is permuted, the check digits follow."""
    packed = F.regexp_replace(text, " ", "")
    country, account = F.substring(packed, 1, 2), F.substring(packed, F.lit(5), F.length(packed))

    def renew(account_: Column) -> Column:
        check = F.lpad((98 - remainder(F.concat(account_, country, F.lit("00")))).cast("string"), 2, "0")
        fresh = F.concat(country, check, account_)
        # Blanks go where they were.
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("used"))

        def place(f: Column) -> Column:
            walk = lambda s, c: F.struct(
                F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(f, s["used"], F.lit(1)))).alias("out"),
                (s["used"] + (c != " ").cast("int")).alias("used"),
            )
            return F.aggregate(F.split(text, ""), start, walk, lambda s: s["out"])

        return let(fresh, place)

    valid = remainder(F.concat(account, F.substring(packed, 1, 4))) == 1
    return F.when(valid, let(characters(account, key, "iban", back), renew))


MAKERS = {"email": email, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "card": card, "phone": phone}


def card_fits(text: Column) -> Column:
    """Whether a text is a number of 13 to 19 digits that passes the Luhn check."""
    return text.rlike(f"^{SHAPES['card']}$") & let(digits_of(text), lambda d: luhn_sum(d) % 10 == 0)


def iban_fits(text: Column) -> Column:
    packed = F.regexp_replace(text, " ", "")
    return text.rlike(f"^{SHAPES['iban']}$") & (remainder(F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))) == 1)


def mark_spans(run: Column, token: str, reach: int, fits: Callable[[Column, Column], Column]) -> Column:
    """``run`` with marks around the spans from token to token that fit, the first and of these the longest first.

    A span has at most ``reach`` tokens and separators. Marked spans of an earlier pass are single tokens and stay.
    """
    tokens = F.regexp_extract_all(run, F.lit(f"({OPEN}[^{OPEN}]*{OPEN}|{token}|[^0-9A-Z{OPEN}])"), F.lit(1))

    def walk(parts: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
        size = F.size(parts)

        def step(state: Column, at: Column) -> Column:
            ends = F.reverse(F.sequence(at, F.least(at + F.lit(reach - 1), size)))
            span = lambda end: F.array_join(F.slice(parts, at, end - at + 1), "")
            own = F.get(parts, at - 1)
            # The first end that fits, 0 if there is none.
            found = F.when(own.rlike("^[0-9A-Z]"), F.coalesce(F.get(F.filter(ends, lambda e: fits(span(e), run)), F.lit(0)), F.lit(0))).otherwise(F.lit(0))

            def take(end: Column) -> Column:
                hit = F.struct(F.concat(state["out"], F.lit(OPEN), span(end), F.lit(OPEN)).alias("out"), (end + 1).cast("int").alias("next"))
                miss = F.struct(F.concat(state["out"], own).alias("out"), (at + 1).cast("int").alias("next"))
                return F.when(end > 0, hit).otherwise(miss)

            return F.when(at < state["next"], state).otherwise(let(found, take))

        return F.aggregate(F.sequence(F.lit(1), size), start, step, lambda state: state["out"])

    return let(tokens, walk)


def mark_cards(run: Column) -> Column:
    """Marks the cards in a run of digits: unbroken ones, then those in the usual groups, then all other spans.

    A span of the last kind that is not the whole run holds no date, social
    security or telephone number.
    """
    other = "|".join(SHAPES[kind] for kind in ("date", "ssn", "phone"))
    whole = mark_spans(run, "[0-9]+", 1, lambda span, _: card_fits(span))
    grouped = let(whole, lambda r: mark_spans(r, "[0-9]+", 7, lambda span, _: span.rlike(GROUPED) & card_fits(span)))
    return let(grouped, lambda r: mark_spans(r, "[0-9]+", 37, lambda span, all_: card_fits(span) & ((span == all_) | ~span.rlike(other))))


def mark_ibans(run: Column) -> Column:
    """Marks the accounts in a run of capitals and digits."""
    return mark_spans(run, "[0-9A-Z]+", 19, lambda span, _: iban_fits(span))


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one found value, or null if it is not valid; the first shape that fits decides."""
    first, *others = SHAPES
    fits = lambda kind: value.rlike(rf"^(?:{SHAPES[kind]})$")
    out = F.when(fits(first), MAKERS[first](value, key, back))
    for kind in others:
        out = out.when(fits(kind), MAKERS[kind](value, key, back))
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and ``pii_found``: how many values were replaced.

    E-mail addresses, IP addresses, telephone numbers, social security numbers,
    payment cards (Luhn), bank accounts (mod 97) and dates (in the calendar, 1700
    to 2099) are replaced wherever they stand in the whole text, in these formats:
    telephone numbers as ``555-123-4567``, ``555.123 4567`` or ``555-1234567`` with
    a separator after the area (two to four digits if in brackets, else three),
    after ``+`` and a country code or not, or as ``+`` and 8 to 15 unbroken digits;
    dates as ``2023-12-25``, ``25/12/2023`` or ``25.12.2023``. Not covered are
    ``(555)123-4567``, ``+44 20 7946 0958``, ``5551234567``, ``2023/12/25`` and
    month-first ``12/25/2023``. What fails its
    check stays. Cards and accounts are looked for from token to token in whole
    runs of digits or capitals, so a number or word beside one does not hide it. The same value has the same pseudonym in every row, and ``back``
    with the same key restores the texts. No shuffle: each row is mapped alone, by
    column expressions.

    Null texts stay null with 0 found, empty ones stay empty; repeated rows, null
    ids and ties do not matter, other columns pass through (one called
    ``pii_found`` is replaced), and an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    # Marks that occur in a text are told apart from ours by an escape, undone at the end.
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(OPEN), F.lit(ESCAPE + "a"))

    def within(whole: Column, shapes: list[str], run: str, mark: Callable[[Column], Column]) -> Column:
        """Marks what ``mark`` finds in the runs of a text; the other shapes are passed over, marks stay."""
        found = F.regexp_replace(whole, f"{OPEN}([^{OPEN}]*){OPEN}|({'|'.join([*shapes, run])})", f"{OPEN}$1$2{OPEN}")

        def spans(pieces: Column) -> Column:
            inside = lambda p: F.when(iban_fits(p), F.concat(F.lit(OPEN), p, F.lit(OPEN))).when(p.rlike(f"^(?:{run})$"), mark(p)).otherwise(p)
            return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, inside(p)).otherwise(p)), "")

        return F.when(whole.rlike(run), let(F.split(found, OPEN, -1), spans)).otherwise(whole)

    accounts = lambda t: within(t, [SHAPES["email"]], IBAN_RUN, mark_ibans)
    cards = lambda t: within(t, [SHAPES[kind] for kind in ("email", "date", "ip", "ssn")], CARD_RUN, mark_cards)
    bounded = let(accounts(safe), cards)
    # Marked spans stay as they are, all other shapes are found around them.
    marked = F.regexp_replace(bounded, f"{OPEN}([^{OPEN}]*){OPEN}|({ANY})", f"{OPEN}$1$2{OPEN}")

    def rebuild(pieces: Column) -> Column:
        # Found values stand at the odd places.
        renewed = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, pseudonym(p, key, back)))
        joined = lambda r: F.array_join(F.zip_with(pieces, r, lambda p, n: F.coalesce(n, p)), "")
        unescape = lambda t: F.replace(F.replace(t, F.lit(ESCAPE + "a"), F.lit(OPEN)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))
        return let(
            renewed,
            lambda r: F.struct(unescape(joined(r)).alias("text"), F.size(F.filter(r, lambda n: n.isNotNull())).alias("found")),
        )

    done = docs.withColumn("pii_found", F.when(text.isNotNull(), let(F.split(marked, OPEN, -1), rebuild)))
    return done.withColumn(text_col, F.col("pii_found.text")).withColumn("pii_found", F.coalesce(F.col("pii_found.found"), F.lit(0)))

"""Personal data replaced by format-preserving pseudonyms, with built-in functions only.

A value is found by a pattern and validated (check digits, calendar, ranges); what does not
validate stays. Its letters and digits are replaced under a key by a Feistel permutation of
all values of the same format: signs, case of letters in fixed places, country code and lengths
stay, check digits are made anew, dates become dates. The same value gets the same pseudonym
in all documents and no two values of a format share one.

| kind | validated by | permuted |
|---|---|---|
| email | shape | letters and digits of the part before the @ |
| secret | ``password``, ``token`` ... with 12 hexadecimal digits or more | hexadecimal digits |
| ip | four numbers up to 255 | each number among those of its length |
| date | calendar, 1900 to 2099 | the day |
| iban | remainder modulo 97 | account digits and letters, then check digits |
| phone | shape | digits but those after the + |
| ssn | assignable ranges | all digits |
| card | Luhn sum | digits but the first and the last, then the last |

Result for odd input: a null text stays null; an empty text and one without values stay as they
are; repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import free_name

from corpuslens.functions.durable import computed_once, let

KEY = "change this key"
KINDS = ("email", "secret", "ip", "date", "iban", "phone", "ssn", "card")
_NOT_AFTER, _NOT_BEFORE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?:[Pp]assword|PASSWORD|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API_KEY)[ \t]{0,2}[=:][ \t]{0,2}[\"']?[0-9a-f]{12,128}" + _NOT_BEFORE,
    "ip": r"(?<![A-Za-z0-9_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[A-Za-z0-9_])",
    "date": _NOT_AFTER + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:" + _NOT_BEFORE + r"|(?=[Tt][0-9]{2}|Z" + _NOT_BEFORE + "))",
    "iban": _NOT_AFTER + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _NOT_BEFORE,
    "phone": r"(?<![A-Za-z0-9_+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}" + _NOT_BEFORE + r"|(?<![A-Za-z0-9_)])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}" + _NOT_BEFORE + "|" + _NOT_AFTER + r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}" + _NOT_BEFORE,
    "ssn": r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])",
    "card": r"(?<![A-Za-z0-9_])[0-9](?:[ -]?[0-9]){12,18}" + _NOT_BEFORE,
}
PATTERN = "|".join(f"(?:{_SHAPES[k]})" for k in KINDS)
#: Cheap test that a text may have a value at all.
HINT = r"[0-9]|@|[=:][ \t]{0,2}[\"']?[a-f]{12}"
ROUNDS = 12
#: Days from 1900 to 2099: 73,049 = 17 * 4,297.
FIRST_DAY, DAY_SIDES = "1900-01-01", (17, 4297)
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: Longest run that is permuted as one number; all its values fit in 60 bits.
_RUN = {DIGITS: 18, LETTERS: 12, HEX: 14}


def _feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column) -> Column:
    """Struct (a, b): a keyed permutation of pairs below the sizes, for any sizes.

    Each round adds a keyed hash of one side to the other, modulo its size.
    """

    def part(i: Column, side: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", tweak, i.cast("string"), side.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(left.alias("a"), right.alias("b")),
        lambda s, i: F.when(i % 2 == 1, F.struct(F.pmod(s["a"] + part(i, s["b"]), left_size).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), F.pmod(s["b"] + part(i, s["a"]), right_size).alias("b"))
        ),
    )


def _number(word: Column, alphabet: str) -> Column:
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda n, c: n * len(alphabet) + F.instr(F.lit(alphabet), c) - 1)


def _spelled(number: Column, size: Column, alphabet: str) -> Column:
    """``number`` in ``size`` digits of the alphabet."""
    base = len(alphabet)
    powers = F.transform(F.sequence(F.lit(1), size), lambda k: F.pow(F.lit(float(base)), size - k).cast("bigint"))
    place = lambda p: (F.call_function("div", number, p) % base + 1).cast("int")
    digits = F.transform(powers, lambda p: F.substring(F.lit(alphabet), place(p), F.lit(1)))
    return F.when(size > 0, F.array_join(digits, "")).otherwise(F.lit(""))


def permuted(word: Column, alphabet: str, tweak: Column) -> Column:
    """A permutation of all words of the same length over ``alphabet``; long ones run by run."""
    run, base = _RUN[alphabet], float(len(alphabet))

    def one(part: Column, tweak: Column) -> Column:
        low = F.floor(F.length(part) / 2).cast("int")
        high = (F.length(part) - low).cast("int")
        size = lambda n: F.pow(F.lit(base), n).cast("bigint")
        pair = _feistel(_number(F.substring(part, F.lit(1), low), alphabet), _number(F.substring(part, low + 1, high), alphabet), size(low), size(high), tweak)
        return let(pair, lambda p: F.concat(_spelled(p["a"], low, alphabet), _spelled(p["b"], high, alphabet)))

    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(word) / F.lit(run)) - 1, F.lit(0)).cast("int"))
    named = lambda k: F.concat_ws("|", tweak, F.length(word).cast("string"), k.cast("string"))
    pieces = F.transform(starts, lambda k: let(F.substring(word, k * run + 1, F.lit(run)), lambda p: one(p, named(k))))
    return F.when(F.length(word) > 0, F.array_join(pieces, "")).otherwise(word)


def _refilled(shape: Column, pattern: str, fill: Column) -> Column:
    """``shape`` with its characters of ``pattern`` replaced by those of ``fill``, in order."""
    before = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), f"[^{pattern}]", ""))
    return let(fill, lambda fill: F.array_join(
        F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike(f"[{pattern}]"), F.substring(fill, before(i) + 1, F.lit(1))).otherwise(c)), "")
    )


def _of(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, f"[^{pattern}]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of all digits, the last one counted as it is."""
    backwards = F.split(F.reverse(digits), "")
    weighed = F.transform(backwards, lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x)


def _card(value: Column, tweak: Column) -> Column:
    digits = _of(value, "0-9")

    def made(d: Column) -> Column:
        inner = F.substring(d, F.lit(2), F.length(d) - 2)
        body = F.concat(F.substring(d, 1, 1), permuted(inner, DIGITS, F.concat_ws("|", tweak, F.substring(d, 1, 1))))
        return let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return let(digits, lambda d: F.when(_luhn_sum(d) % 10 == 0, _refilled(value, "0-9", made(d))).otherwise(value))


def _email(value: Column, tweak: Column) -> Column:
    local = F.lower(F.substring_index(value, "@", 1))
    digits, letters = permuted(_of(local, "0-9"), DIGITS, tweak), permuted(_of(local, "a-z"), LETTERS, tweak)
    return F.concat(_refilled(_refilled(local, "0-9", digits), "a-z", letters), F.lit("@"), F.substring_index(value, "@", -1))


def _ip(value: Column, tweak: Column) -> Column:
    """Numbers of one, two and three digits are permuted among 10, 90 and 156 of their length."""
    parts = F.split(value, r"\.")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & ((F.length(p) == 1) | ~p.startswith("0")))
    low = lambda p: F.when(F.length(p) == 1, 0).when(F.length(p) == 2, 10).otherwise(100).cast("bigint")
    size = lambda p: F.when(F.length(p) == 1, 10).when(F.length(p) == 2, 90).otherwise(156).cast("bigint")
    p = [F.get(parts, F.lit(k)) for k in range(4)]
    rank = [x.cast("bigint") - low(x) for x in p]
    named = F.concat_ws("|", tweak, *(F.length(x).cast("string") for x in p))
    pair = _feistel(rank[0] * size(p[1]) + rank[1], rank[2] * size(p[3]) + rank[3], size(p[0]) * size(p[1]), size(p[2]) * size(p[3]), named)
    whole = lambda n, by: F.call_function("div", n, by)
    made = let(pair, lambda q: F.concat_ws(
        ".",
        *((x + n).cast("string") for x, n in (
            (low(p[0]), whole(q["a"], size(p[1]))), (low(p[1]), q["a"] % size(p[1])), (low(p[2]), whole(q["b"], size(p[3]))), (low(p[3]), q["b"] % size(p[3])),
        ))))
    return F.when(valid, made).otherwise(value)


def _date(value: Column, tweak: Column) -> Column:
    """ISO dates; others have the day first, or the month where only that is a date."""

    def in_form(form: str) -> tuple[Column, Column]:
        day = F.try_to_timestamp(value, F.lit(form)).cast("date")
        rank = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
        sides = [F.lit(n).cast("bigint") for n in DAY_SIDES]
        pair = _feistel(F.call_function("div", rank, sides[1]), rank % sides[1], *sides, F.concat_ws("|", tweak, F.lit(form)))
        new = let(pair, lambda q: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (q["a"] * sides[1] + q["b"]).cast("int")), form))
        return day.isNotNull() & (rank >= 0) & (rank < DAY_SIDES[0] * DAY_SIDES[1]), new

    iso, dots, slashes, months = map(in_form, ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy"))
    return (
        F.when(value.contains("-"), F.when(*iso).otherwise(value))
        .when(value.contains("."), F.when(*dots).otherwise(value))
        .otherwise(F.when(*slashes).when(*months).otherwise(value))
    )


def _mod97(text: Column) -> Column:
    """Remainder modulo 97; A counts as 10, B as 11 and so on."""
    rank = lambda c: F.instr(F.lit(DIGITS + LETTERS.upper()), c) - 1
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda n, c: let(rank(c), lambda r: (n * F.when(r > 9, 100).otherwise(10) + r) % 97))


def _iban(value: Column, tweak: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")

    def made(v: Column) -> Column:
        body = F.substring(v, F.lit(5), F.length(v) - 4)
        country = F.substring(v, 1, 2)
        named = F.concat_ws("|", tweak, country)
        new = _refilled(_refilled(body, "0-9", permuted(_of(body, "0-9"), DIGITS, named)), "A-Z", F.upper(permuted(F.lower(_of(body, "A-Z")), LETTERS, named)))
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        return let(new, lambda b: F.concat(country, check(b), b))

    valid = lambda v: _mod97(F.concat(F.substring(v, F.lit(5), F.length(v) - 4), F.substring(v, 1, 4))) == 1
    return let(plain, lambda v: F.when(valid(v), _refilled(value, "A-Z0-9", made(v))).otherwise(value))


def _phone(value: Column, tweak: Column) -> Column:
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .-])|^\+[0-9]", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _refilled(rest, "0-9", permuted(_of(rest, "0-9"), DIGITS, F.concat_ws("|", tweak, code))))


def _ssn(value: Column, tweak: Column) -> Column:
    valid = ~value.rlike(r"^(000|666|9..)|-00-|-0000$")
    return F.when(valid, _refilled(value, "0-9", permuted(_of(value, "0-9"), DIGITS, tweak))).otherwise(value)


def _secret(value: Column, tweak: Column) -> Column:
    tail = F.regexp_extract(value, r"[0-9a-f]+$", 0)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(tail)), permuted(tail, HEX, tweak))


_MAKERS = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "iban": _iban, "phone": _phone, "ssn": _ssn, "card": _card}


def kind_of(value: Column) -> Column:
    """The kind of a found value: the first whose shape is all of it."""
    chosen = F.when(value.contains("@"), F.lit("email"))
    for kind in KINDS[1:]:
        chosen = chosen.when(value.rlike(f"^(?:{_SHAPES[kind]})$"), F.lit(kind))
    return chosen


def pseudonym(value: Column, kind: Column, key: str = KEY) -> Column:
    """What stands for ``value``; the value itself if it does not validate."""
    chosen = None
    for name, maker in _MAKERS.items():
        made = maker(value, F.lit(f"{key}|{name}"))
        chosen = F.when(kind == name, made) if chosen is None else chosen.when(kind == name, made)
    return chosen.otherwise(value)


def found_values(text: Column, key: str = KEY) -> Column:
    """Array of (kind, value, pseudonym) of a text, in order."""
    each = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    one = lambda v: let(kind_of(v), lambda k: F.struct(k.alias("kind"), v.alias("value"), pseudonym(v, k, key).alias("pseudonym")))
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    return F.when(text.rlike(HINT) & text.rlike(PATTERN), F.transform(each, one)).otherwise(none)


def _rebuilt(text: Column, found: Column) -> Column:
    """``text`` with its values replaced: what lies between them, and the pseudonyms, in turn."""
    between = F.split(text, PATTERN, -1)
    pairs = F.arrays_zip(between.alias("between"), F.transform(found, lambda x: x["pseudonym"]).alias("pseudonym"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["between"], F.coalesce(p["pseudonym"], F.lit("")))), "")


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY, found_as: str = "pii") -> DataFrame:
    """``docs`` with values in ``text`` replaced, and ``found_as``: (kind, value, pseudonym) of those replaced.

    A column of ``docs`` named ``found_as`` is replaced by the findings; pass a name that
    ``docs`` does not have (see ``common.free_name``) to keep all of its columns.
    """
    inner = free_name(docs, "__found")
    found = computed_once(docs, **{inner: found_values(F.col(text), key)})
    new = F.when(F.size(inner) > 0, _rebuilt(F.col(text), F.col(inner))).otherwise(F.col(text))
    others = [new.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != found_as]
    return found.select(*others, F.filter(inner, lambda x: x["value"] != x["pseudonym"]).alias(found_as))

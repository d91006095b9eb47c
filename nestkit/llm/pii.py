"""PII: format-preserving pseudonyms by a keyed Feistel permutation, with SQL expressions only.

Validated numbers (payment cards, phone numbers, social security numbers, IPv4 and full IPv6 addresses, IBANs), calendar
dates and the local parts of e-mail addresses become other values of the same format. Phone numbers are those of North
America with a separator or +1, and international ones with + and 8 to 15 digits, whose country code stays; dates are
those from FIRST_DAY to LAST_DAY. The permutation depends on the key, the
kind and the format alone, so equal values stay linked across documents and different values stay different. Numbers
that fail their check (Luhn, mod 97, ranges, calendar) stay as they are; a card or an IBAN is also found where the match
takes in numbers or words beside it. Everything happens within a row: no shuffle.

A value is a list of symbols, each with its radix. A round adds a keyed hash of one half of the list to the other half,
symbol by symbol and modulo the radix; ROUNDS rounds alternate between the halves. Where only some lists are valid
values, the permutation is repeated until it meets one (cycle walking).
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Repeats of the permutation until a valid value is met. The rarest kind is valid with probability 0.6 a time.
WALK = 48
#: Dates move within these days.
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS, SIDE = 73_049, 271  # days in that range; SIDE squared is the next square above it
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
#: Longer than a card: others can stand beside it.
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,45}(?![0-9A-Za-z])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
#: Ten digits alone are no phone number.
PHONE = r"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-])?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}|\+1(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4})(?![0-9A-Za-z])"
E164 = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{1,4}){2,7}(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"
#: The country codes of two digits. 1 and 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
KINDS = {"email": EMAIL, "iban": IBAN, "date": DATE, "ipv4": IPV4, "ipv6": IPV6, "ssn": SSN, "phone": PHONE, "e164": E164, "card": CARD}
PATTERN = "|".join(KINDS.values())


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(symbols: str, radices: str, tweak: str, key: str) -> str:
    """SQL of the permuted symbols; symbols, radices and tweak are SQL."""
    half = f"size({symbols}) div 2"
    other = f"if(i % 2 = 1, slice(acc, {half} + 1, size(acc)), slice(acc, 1, {half}))"
    message = f"concat_ws('|', {tweak}, i, j, array_join({other}, ','))"
    keyed = f"sha2(concat({_q(key)}, sha2(concat({_q(key)}, {message}), 256)), 256)"
    moved = f"cast(pmod(v + cast(conv(substr({keyed}, 1, 12), 16, 10) as bigint), get({radices}, j)) as int)"
    return f"aggregate(sequence(1, {ROUNDS}), {symbols}, (acc, i) -> transform(acc, (v, j) -> if((j < {half}) = (i % 2 = 1), {moved}, v)))"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _refill(shape: str, chars: str) -> str:
    """shape with its letters and digits replaced, in order, by those of chars."""
    step = f"if(c rlike '[0-9A-Za-z]', struct(concat(a.o, substr({chars}, a.k, 1)) as o, a.k + 1 as k), struct(concat(a.o, c) as o, a.k as k))"
    return f"aggregate(filter(split({shape}, ''), c -> c != ''), struct('' as o, 1 as k), (a, c) -> {step}, a -> a.o)"


def _plain(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9A-Za-z]', '')"


def _chars(plain: str, tweak: str, key: str) -> str:
    """Letters and digits permuted in place: digits to digits, letters to letters of the same case."""
    # 0 is not a letter's position, so instr() - 1 is the value of either class.
    value = f"if(c rlike '[0-9]', cast(c as int), instr({_q(LETTERS)}, lower(c)) - 1)"
    symbols = f"transform(filter(split({plain}, ''), c -> c != ''), c -> {value})"
    radices = f"transform(filter(split({plain}, ''), c -> c != ''), c -> if(c rlike '[0-9]', 10, 26))"
    back = f"if(substr({plain}, p + 1, 1) rlike '[0-9]', cast(s as string), if(substr({plain}, p + 1, 1) rlike '[A-Z]', upper(substr({_q(LETTERS)}, s + 1, 1)), substr({_q(LETTERS)}, s + 1, 1)))"
    return _let("sy", symbols, _let("ra", radices, f"array_join(transform({_feistel('sy', 'ra', tweak, key)}, (s, p) -> {back}), '')"))


def _luhn_sum(digits: str) -> str:
    """Luhn's sum of a number whose last digit is not doubled."""
    double = "cast((cast(c as int) * 2) div 10 + (cast(c as int) * 2) % 10 as int)"
    return f"aggregate(transform(filter(split(reverse({digits}), ''), c -> c != ''), (c, p) -> if(p % 2 = 1, {double}, cast(c as int))), 0, (a, x) -> a + x)"


def _mod97(plain: str) -> str:
    """ISO 7064 mod 97 of an IBAN's letters and digits, country and check digits moved to the end."""
    value = f"if(c rlike '[0-9]', cast(c as int), instr({_q(LETTERS)}, lower(c)) + 9)"
    return f"aggregate(filter(split(concat(substr({plain}, 5), substr({plain}, 1, 4)), ''), c -> c != ''), 0, (a, c) -> (a * if({value} > 9, 100, 10) + {value}) % 97)"


def _walk(start: str, step: str, valid: str) -> str:
    """x from start: permuted by step once, and again until valid."""
    return f"aggregate(sequence(1, {WALK}), {start}, (x, n) -> if(n > 1 and {valid}, x, {step}))"


def _edges(m: str) -> tuple[str, str]:
    """SQL of the places in m at which a part between separators starts, and of those at which one stops."""
    edge = lambda at, there: f"filter(sequence(1, length({m})), p -> p = {at} or substr({m}, {there}, 1) in (' ', '-'))"
    return edge("1", "p - 1"), edge(f"length({m})", "p + 1")


def _within(m: str, least: int, valid: str, make) -> str:
    """m with the parts between separators that are valid made anew, from left to right, the longest from each start.
    valid is SQL about d, a part's letters and digits; make gives the SQL of a part w."""
    starts, stops = _edges(m)
    fits = _let("d", _plain(f"substr({m}, b, e - b + 1)"), valid)
    put = f"struct(concat(a.o, substr({m}, a.k, b - a.k), {_let('w', f'substr({m}, b, z - b + 1)', make('w'))}) as o, z + 1 as k)"
    step = f"if(b < a.k, a, {_let('z', f'array_max(filter({stops}, e -> e - b >= {least - 1} and {fits}))', f'if(z is null, a, {put})')})"
    return f"aggregate({starts}, struct('' as o, 1 as k), (a, b) -> {step}, a -> concat(a.o, substr({m}, a.k)))"


def _card(m: str, key: str) -> str:
    """A card; where the whole match is none, the parts that are one, if they start as payment cards do."""
    within = _within(m, 13, f"length(d) between 13 and 19 and d rlike '^[2-6]' and {_luhn_sum('d')} % 10 = 0", lambda w: _whole_card(w, key))
    return _let("cd", _plain(m), f"if(length(cd) <= 19 and {_luhn_sum('cd')} % 10 = 0, {_whole_card(m, key)}, {within})")


def _whole_card(m: str, key: str) -> str:
    check = f"(10 - {_luhn_sum('concat(nu, chr(48))')} % 10) % 10"
    # The first digit, which names the issuer, stays; the last one is the check digit.
    new = _let("nu", f"concat(substr(d, 1, 1), {_chars('substr(d, 2, length(d) - 2)', _q('card'), key)})", f"concat(nu, {check})")
    return _let("d", _plain(m), f"if({_luhn_sum('d')} % 10 = 0 and d rlike '[1-9]', {_let('nd', new, _refill(m, 'nd'))}, {m})")


def _phone(m: str, key: str) -> str:
    area = "substr(d, length(d) - 9)"
    symbols = f"transform(sequence(1, 10), p -> cast(substr({area}, p, 1) as int) - if(p in (1, 4), 2, 0))"
    moved = _feistel("sy", "ra", _q("phone"), key)
    new = _let("sy", symbols, _let("ra", "array(8, 10, 10, 8, 10, 10, 10, 10, 10, 10)", f"array_join(transform({moved}, (s, p) -> cast(s + if(p in (0, 3), 2, 0) as string)), '')"))
    return _let("d", _plain(m), _let("nd", f"concat(substr(d, 1, length(d) - 10), {new})", _refill(m, "nd")))


def _ssn(m: str, key: str) -> str:
    valid = "substr(x, 1, 3) not in ('000', '666') and substr(x, 1, 1) != '9' and substr(x, 4, 2) != '00' and substr(x, 6) != '0000'"
    new = _walk("d", _chars("x", _q("ssn"), key), valid)
    return _let("d", _plain(m), f"if({valid.replace('(x', '(d')}, {_let('nd', new, _refill(m, 'nd'))}, {m})")


def _ipv4(m: str, key: str) -> str:
    symbols = f"transform(split({m}, '[.]'), o -> cast(o as int))"
    # Octets with leading zeros are not in the format.
    valid = f"forall(split({m}, '[.]'), o -> cast(o as int) <= 255 and (length(o) = 1 or o not like '0%'))"
    new = _let("sy", symbols, _let("ra", "array(256, 256, 256, 256)", f"array_join({_feistel('sy', 'ra', _q('ipv4'), key)}, '.')"))
    return f"if({valid}, {new}, {m})"


def _ipv6(m: str, key: str) -> str:
    symbols = f"transform(filter(split({m}, ''), c -> c not in ('', ':')), c -> cast(conv(c, 16, 10) as int))"
    new = f"array_join(transform({_feistel('sy', 'ra', _q('ipv6'), key)}, s -> lower(hex(s))), '')"
    return _let("sy", symbols, _let("ra", "transform(sy, x -> 16)", _let("nd", new, _refill(m, "nd"))))


def _e164(m: str, key: str) -> str:
    """An international number: the digits behind the country code are permuted."""
    code = f"if(d rlike '^[17]', 1, if(substr(d, 1, 2) in ({', '.join(map(_q, TWO_DIGITS))}), 2, 3))"
    new = _let("nd", f"concat(substr(d, 1, cl), {_chars('substr(d, cl + 1)', _q('e164') + ' || substr(d, 1, cl)', key)})", _refill(m, "nd"))
    return _let("d", _plain(m), f"if(length(d) between 8 and 15, {_let('cl', code, new)}, {m})")


def _iban(m: str, key: str) -> str:
    """An IBAN; where the whole match is none, the parts that are one."""
    within = _within(m, 15, f"length(d) between 15 and 34 and d rlike '^[A-Z]{{2}}[0-9]{{2}}' and {_mod97('d')} = 1", lambda w: _whole_iban(w, key))
    return f"if({_mod97(_plain(m))} = 1, {_whole_iban(m, key)}, {within})"


def _whole_iban(m: str, key: str) -> str:
    body = _chars("substr(d, 5)", "concat('iban', substr(d, 1, 2))", key)
    whole = "concat(substr(d, 1, 2), lpad(cast(98 - " + _mod97("concat(substr(d, 1, 2), '00', nb)") + " as string), 2, '0'), nb)"
    return _let("d", _plain(m), f"if({_mod97('d')} = 1, {_let('nd', _let('nb', body, whole), _refill(m, 'nd'))}, {m})")


def _date(m: str, key: str) -> str:
    first = f"date '{FIRST_DAY}'"

    def one(pattern: str, tweak: str, valid: str) -> str:
        number = f"datediff(try_to_date({m}, {_q(pattern)}), {first})"
        step = _let("sy", f"array(cast(x div {SIDE} as int), cast(x % {SIDE} as int))", _let("ra", f"array({SIDE}, {SIDE})", _let("f", _feistel("sy", "ra", _q(tweak), key), f"f[0] * {SIDE} + f[1]")))
        new = _walk("x0", step, f"x < {DAYS} and {valid}")
        return _let("x0", number, f"if(x0 between 0 and {DAYS - 1}, date_format(date_add({first}, {new}), {_q(pattern)}), {m})")

    # A date with slashes is month/day/year where that is a date, else day/month/year, whose days then are over 12.
    european = one("dd/MM/yyyy", "dmy", f"day(date_add({first}, x)) > 12")
    american = one("MM/dd/yyyy", "mdy", "true")
    slash = f"if(try_to_date({m}, 'MM/dd/yyyy') is null, {european}, {american})"
    return f"case when {m} like '%-%' then {one('yyyy-MM-dd', 'ymd', 'true')} when {m} like '%/%' then {slash} else {one('dd.MM.yyyy', 'd.m.y', 'true')} end"


def _email(m: str, key: str) -> str:
    name = f"substring_index({m}, '@', 1)"
    return _let("d", _plain(name), f"if(d = '', {m}, concat({_let('nd', _chars('d', _q('email'), key), _refill(name, 'nd'))}, '@', substring_index({m}, '@', -1)))")


MAKERS = {"email": _email, "iban": _iban, "date": _date, "ipv4": _ipv4, "ipv6": _ipv6, "ssn": _ssn, "phone": _phone, "e164": _e164, "card": _card}


def pseudonym_sql(m: str, key: str) -> str:
    """SQL of the pseudonym of a match m. The kind is the first one whose whole pattern fits; a phone number that is
    also a card number by its check is a phone number."""
    cases = " ".join(f"when {m} rlike {_q('^(?:' + KINDS[k] + ')$')} then {make(m, key)}" for k, make in MAKERS.items())
    return f"case {cases} else {m} end"


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: str) -> DataFrame:
    """One row per row of docs: id, text with pseudonyms, found (values of a known format), changed (those replaced).

    A null text stays null with 0 found; texts without a match pass through, long texts are read whole. Equal values get
    equal pseudonyms under one key, in repeated rows too. Other columns are not read. The key is a secret of the caller and
    is not stored in the result, but it stands in the query's plan.
    """
    hit = F.col("text").rlike(PATTERN)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("old", F.when(hit, F.expr(f"regexp_extract_all(text, {_q(PATTERN)}, 0)")).otherwise(F.expr("cast(array() as array<string>)")))
    rows = rows.withColumn("new", F.expr(f"transform(old, m -> {pseudonym_sql('m', key)})"))
    rows = rows.withColumn("gaps", F.when(F.size("old") > 0, F.expr(f"split(text, {_q(PATTERN)}, -1)")))
    joined = F.expr("array_join(transform(gaps, (g, i) -> concat(g, coalesce(get(new, i), ''))), '')")
    changed = F.expr("size(filter(zip_with(old, new, (a, b) -> a != b), c -> c))")
    return rows.select(F.col("id").alias(id_col), F.when(F.size("old") > 0, joined).otherwise(F.col("text")).alias("text"), F.size("old").alias("found"), changed.alias("changed"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Under the key in spark.nestkit.pii.key. Without that setting a random key links values within this one result."""
    key = spark.conf.get("spark.nestkit.pii.key", None) or secrets.token_hex(32)
    return pseudonymise(table(spark, sf_dir, "documents"), key=key)

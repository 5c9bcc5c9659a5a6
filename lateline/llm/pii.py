"""Personal data as format-preserving pseudonyms, in DataFrame functions only.

Finds e-mail addresses, IBANs, payment cards, social security numbers, dates, IPv4 addresses, phone numbers and secrets.
Numbers and dates are first validated (Luhn, mod 97, ranges, calendar) and then permuted by a keyed Feistel network over
their own domain, so a card becomes another valid card of the same length and punctuation, a date another date in the
same notation. The permutation depends on key and kind alone: equal values stay equal across documents, however they are
punctuated, and different ones stay different. Names in e-mail addresses and secrets, which have no numeric domain,
become keyed digests of the same shape.

Nulls and edge cases: a null text stays null, an empty one empty, both with n_found 0; text without a find is unchanged,
character by character; all other columns pass through, whatever they are called; rows that repeat are treated alike. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A number after a blank that is no further group of a phone number: a date, an address, a card or a social security number.
_OTHER = (r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9])|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
          r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}")
_NEXT = rf"(?:(?: (?!{_OTHER})|[.-])?[0-9])"
# International numbers: 8 to 15 digits in all, in any groups, with an area code in brackets or without.
_PLUS = (r"\+(?:" + "|".join(rf"[0-9]{{{c}}}[ .-]?\([0-9]{{{a}}}\){_NEXT}{{{8 - c - a},{15 - c - a}}}" for c in (1, 2, 3) for a in (1, 2, 3, 4))
         + rf"|[0-9]{_NEXT}{{7,14}})")

# Shapes searched for, in order of preference.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\x22\x27]?[A-Za-z0-9+/_.~$!@#%^&*-]{6,256}"
              r"|(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9]))",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?![0-9A-Za-z/])|(?=[Tt][0-9]{2}))|[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9A-Za-z/]))",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
             r"|" + _PLUS +
             r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])",
}
ROUNDS = 12
FIRST = "date'1700-01-01'"       # 400 years from here are 146097 = 189 * 773 days
MARK, ESCAPE, OWN = "\u0002\u0004", "\u0002\u0003", "\u0002"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(kind: str, a: str, b: str, A: str, B: str) -> str:
    """Permutation of [0, A) x [0, B) as an expression of type struct<a, b>: each half is shifted by a keyed function of
    the other, in turn."""
    def shift(x: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws('|', key, '{kind}', {A}, {B}, i, {x}), 256), 1, 15), 16, 10) as bigint)"
    return (f"aggregate(sequence(0, {ROUNDS - 1}), struct(cast({a} as bigint) as a, cast({b} as bigint) as b), (s, i) -> "
            f"if(i % 2 = 0, struct((s.a + {shift('s.b')} % {A}) % {A} as a, s.b as b), "
            f"struct(s.a as a, (s.b + {shift('s.a')} % {B}) % {B} as b)))")


def _ten(n: str) -> str:
    return f"cast(rpad('1', {n} + 1, '0') as bigint)"


def _digits(kind: str, d: str) -> str:
    """Permutation of a digit string of 2 to 34 digits that keeps its length. ``d`` is named once by a one-element lambda."""
    half, rest = "(length(d) div 2)", "(length(d) - length(d) div 2)"
    f = _feistel(kind, f"left(d, {half})", f"right(d, {rest})", _ten(half), _ten(rest))
    return (f"get(transform(array({d}), d -> get(transform(array({f}), r -> concat("
            f"lpad(cast(r.a as string), {half}, '0'), lpad(cast(r.b as string), {rest}, '0'))), 0)), 0)")


def _only(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    return (f"get(transform(array({digits}), z -> aggregate(split({shape}, ''), struct('' as o, 1 as k), (s, c) -> "
            f"if(c rlike '^[0-9]$', struct(concat(s.o, substr(z, s.k, 1)) as o, s.k + 1 as k), "
            f"struct(concat(s.o, c) as o, s.k as k)), s -> s.o)), 0)")


def _luhn(d: str, check: int) -> str:
    """Luhn sum of a digit string; ``check`` is 1 when a check digit will follow."""
    return (f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + get(transform(array(cast(substr({d}, -i, 1) as int)), "
            f"x -> if((i + {check}) % 2 = 1, x, x * 2 - if(x > 4, 9, 0))), 0))")


def _mod97(s: str) -> str:
    """Remainder by 97 of an alphanumeric string, letters as 10 to 35."""
    return (f"aggregate(split({s}, ''), 0, (r, c) -> if(c rlike '^[0-9]$', (r * 10 + cast(c as int)) % 97, "
            f"if(c rlike '^[A-Z]$', (r * 100 + ascii(c) - 55) % 97, r)))")


def _card(p: str) -> str:
    new = f"get(transform(array({_digits('card', f'left({_only(p)}, length({_only(p)}) - 1)')}), y -> concat(y, cast((10 - {_luhn('y', 1)} % 10) % 10 as string))), 0)"
    return f"if({_luhn(_only(p), 0)} % 10 = 0, {_refill(p, new)}, {p})"


def _iban(p: str) -> str:
    plain = f"replace({p}, ' ', '')"
    ok = f"length({plain}) between 15 and 34 and {_mod97(f'concat(substr({plain}, 5), left({plain}, 4))')} = 1"
    body = f"substr({p}, 5)"
    moved = f"if(length({_only(body)}) >= 2, {_refill(body, _digits('iban', _only(body)))}, {body})"
    check = f"lpad(cast(98 - {_mod97('concat(y, left(' + p + ', 2), ' + chr(39) + '00' + chr(39) + ')')} as string), 2, '0')"
    return f"if({ok}, get(transform(array({moved}), y -> concat(left({p}, 2), {check}, y)), 0), {p})"


def _ssn(p: str) -> str:
    d = _only(p)
    area, group, serial = f"cast(substr({d}, 1, 3) as int)", f"cast(substr({d}, 4, 2) as int)", f"cast(substr({d}, 6, 4) as int)"
    ok = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    f = _feistel("ssn", f"{area} - 1 - if({area} > 666, 1, 0)", f"({group} - 1) * 9999 + {serial} - 1", "898", "989901")
    return (f"if({ok}, get(transform(array({f}), r -> concat(lpad(cast(r.a + 1 + if(r.a >= 665, 1, 0) as string), 3, '0'), '-', "
            f"lpad(cast(r.b div 9999 + 1 as string), 2, '0'), '-', lpad(cast(r.b % 9999 + 1 as string), 4, '0'))), 0), {p})")


def _date(p: str) -> str:
    def moved(day: str, show: str) -> str:
        n = f"datediff({day}, {FIRST})"
        f = _feistel("date", f"{n} div 773", f"{n} % 773", "189", "773")
        new = f"get(transform(array({f}), r -> date_format(date_add({FIRST}, cast(r.a * 773 + r.b as int)), {show})), 0)"
        return f"if({day} between {FIRST} and date'2099-12-31', {new}, {p})"
    sep = f"substr({p}, 3, 1)"
    iso = moved(f"try_to_date({p}, 'yyyy-MM-dd')", "'yyyy-MM-dd'")
    # Day first where that is a date, month first otherwise.
    day, month = (f"try_to_date(translate({p}, './', '--'), '{x}-yyyy')" for x in ("dd-MM", "MM-dd"))
    other = f"coalesce({day}, {month})"
    show = f"if({day} is not null, concat('dd', {sep}, 'MM', {sep}, 'yyyy'), concat('MM', {sep}, 'dd', {sep}, 'yyyy'))"
    return f"if({p} rlike '^[0-9]{{4}}-', {iso}, {moved(other, show)})"


def _ip(p: str) -> str:
    part = [f"cast(get(split({p}, '[.]'), {i}) as int)" for i in range(4)]
    f = _feistel("ip", f"{part[0]} * 256 + {part[1]}", f"{part[2]} * 256 + {part[3]}", "65536", "65536")
    ok = " and ".join(f"{x} <= 255" for x in part)
    return f"if({ok}, get(transform(array({f}), r -> concat_ws('.', r.a div 256, r.a % 256, r.b div 256, r.b % 256)), 0), {p})"


def _phone(p: str) -> str:
    code = f"regexp_extract({p}, '^[+][0-9]{{1,3}}(?=[^0-9])', 0)"
    own = f"substr({p}, length({code}) + 1)"
    return (f"if(length({_only(p)}) between 8 and 15 and length({_only(own)}) >= 2, "
            f"concat({code}, {_refill(own, _digits('phone', _only(own)))}), {p})")


def _email(p: str) -> str:
    name = f"lower({p})"
    return f"concat('u', substr(sha2(concat_ws('|', key, 'email', {name}), 256), 1, 16), '@mail.example.com')"


def _secret(p: str) -> str:
    lead = f"regexp_extract({p}, '^((?i:password|passwd|pwd|secret|token|api[_-]?key)[ \\\\t\\\\r\\\\n]{{0,3}}[=:][ \\\\t\\\\r\\\\n]{{0,3}}[\\\\x22\\\\x27]?|AKIA)', 1)"
    value = f"substr({p}, length({lead}) + 1)"
    digest = f"repeat(sha2(concat_ws('|', key, 'secret', {value}), 256), 4)"
    return f"concat({lead}, left(if({lead} = 'AKIA', upper({digest}), {digest}), length({value})))"


def _pseudonym(kind: str, p: str) -> str:
    return {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip,
            "phone": _phone}[kind](p)


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """Replace the values found in ``text``; ``count`` names an added column with the number of changed values."""
    every = "|".join(f"(?:{s})" for s in SHAPES.values())
    case = "case " + " ".join(f"when p rlike {_lit('^(?:' + _bare(s) + ')$')} then {_pseudonym(k, 'p')}"
                              for k, s in SHAPES.items()) + " else p end"
    case = case.replace("key,", f"{_lit(key)},")
    t = f"`{text}`"
    parts = f"split(regexp_replace(replace({t}, '{OWN}', '{ESCAPE}'), {_lit(every)}, '{MARK}$0{MARK}'), '{MARK}', -1)"
    # Every shape has a digit, an @ or a sign of assignment; other texts are not searched.
    todo = F.expr(f"{t} rlike '[0-9@=:]'")
    found = F.when(todo, F.expr(parts))
    taken = {c.lower() for c in docs.columns}
    old_, new_ = (next(n for n in (f"__{x}{i}" for i in range(len(taken) + 1)) if n not in taken) for x in ("parts", "new"))
    new = F.expr(f"transform({old_}, (p, i) -> if(i % 2 = 0, p, {case}))")
    out = docs.withColumn(old_, found).withColumn(new_, new)
    whole = F.expr(f"replace(array_join({new_}, ''), '{ESCAPE}', '{OWN}')")
    columns = [F.when(F.col(new_).isNull(), F.col(text)).otherwise(whole).alias(text) if c == text else F.col(f"`{c}`")
               for c in docs.columns]
    if count:
        n = F.expr(f"aggregate(zip_with({old_}, {new_}, (x, y) -> if(x = y, 0, 1)), 0, (a, x) -> a + x)")
        columns.append(F.coalesce(n, F.lit(0)).alias(count))
    return out.select(*columns)


def _bare(shape: str) -> str:
    """A shape without the conditions on what stands around it."""
    import re

    shape = re.sub(r"^\(\?<![^)]*\)", "", shape)
    return re.sub(r"\(\?!\[[^)]*\)$", "", shape)

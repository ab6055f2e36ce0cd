"""Format-preserving pseudonyms of personal data, with DataFrame functions alone.

Cards (Luhn), IBANs (mod 97), IPv4 addresses, telephone numbers, national numbers, dates, e-mail
addresses and long hexadecimal secrets are found by one pattern, validated, and replaced by a keyed
permutation of their own format: a Feistel network over the value's digits (each of its own radix),
with check digits computed anew.  Equal values get equal pseudonyms in every document, whatever
their separators; without the key they cannot be undone.

Cases: null and empty texts stay; a candidate that fails its check is left as it is, and hides no
shorter or other value that begins in it; dates outside
1900 to 2099 are left; repeated rows are treated alike; an empty table gives no rows; all columns of
docs are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ip", "iban", "secret", "card", "national", "phone", "date")

#: Values that have no check; they are taken first. Runs are possessive, so a scan never goes back over a long run.
_PLAIN = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<!\w)[0-9a-f]{32,}+(?!\w)|(?<!\w)[0-9A-F]{32,}+(?!\w)",
}
PATTERN = "|".join(_PLAIN.values())
#: Characters of an IBAN by country.
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_PHONE = r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"


def _iban_shape() -> str:
    sizes = (f"(?:{names.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in _IBAN.items())
    return rf"(?<!\w)(?:{'|'.join(sizes)})(?!\w)"


def _grouped(*sizes: int) -> str:
    """A card's digits in groups of these sizes with one separator throughout."""
    name = "g" + "x".join(map(str, sizes))
    return rf"(?<![\w+])\d{{{sizes[0]}}}(?<{name}>[ -])" + rf"\k<{name}>".join(rf"\d{{{n}}}" for n in sizes[1:]) + r"(?!\w)"


#: (kind, shape) of values that may fail a check, in order of preference at a place; none is longer than REACH.
_TIGHT = [
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"),
    ("iban", _iban_shape()),
    ("national", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?<sep>[./-])\d{1,2}\k<sep>\d{4})(?![\w/-]|\.\d)"),
    ("phone", _PHONE),
    ("phone", r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w|[./-]\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"),
    ("card", _grouped(4, 4, 4, 4)),
    ("card", _grouped(4, 6, 5)),
    ("card", _grouped(4, 6, 4)),
    ("card", r"(?<![\w+])\d{13,19}(?!\w)"),
    ("card", _grouped(4, 4, 4, 4, 3)),
]
#: Other layouts, taken only where no tight value is.
_LOOSE = [
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("card", r"(?<![\w+])\d(?:[ -]?\d){15}(?!\w)"),
    ("card", r"(?<![\w+])\d(?:[ -]?\d){14}(?!\w)"),
    ("card", r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)"),
]
REACH = 64
#: The places at which one of them may begin.
STARTS = "(?=" + "|".join(shape for _, shape in [*_TIGHT, *_LOOSE]) + ")"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days from 1900-01-01 to 2099-12-31 are 73,049, which is 229 * 319.
_DAYS, _DAY_RADICES = 73049, (229, 319)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(values: str, radices: str, key: str) -> str:
    """SQL: the array values permuted within radices (value i below radix i)."""
    side = "(j < size(acc) div 2) != (k % 2 = 1)"
    other = f"array_join(transform(filter(acc, (y, j) -> {side}), y -> cast(y as string)), ',')"
    seed = f"sha2(concat_ws('|', {_quoted(key)}, k, {other}), 256)"  # of the whole other side, once a round
    drawn = "cast(conv(substr(sha2(concat(s, i), 256), 1, 12), 16, 10) as bigint)"
    turn = f"transform(acc, (x, i) -> if((i < size(acc) div 2) = (k % 2 = 1), pmod(x + {drawn}, b.r[i]), x))"
    rounds = f"aggregate(sequence(1, {ROUNDS}), b.v, (acc, k) -> transform(array({seed}), s -> {turn})[0])"
    return f"transform(array(named_struct('v', {values}, 'r', {radices})), b -> {rounds})[0]"


def _chars(text: str) -> str:
    return f"filter(split({text}, ''), c -> c != '')"


def _in_format(text: str, alphabets: list[str], key: str) -> str:
    """SQL: text with the characters of each alphabet permuted and all others in their place."""
    place = "case " + " ".join(f"when instr('{a}', c) > 0 then instr('{a}', c) - 1" for a in alphabets) + " end"
    radix = "case " + " ".join(f"when instr('{a}', c) > 0 then {len(a)}" for a in alphabets) + " end"
    letter = "case " + " ".join(f"when instr('{a}', c) > 0 then substr('{a}', v + 1, 1)" for a in alphabets) + " end"
    # a character of no alphabet is the one value of its own radix, so it stays
    values = f"transform(w, c -> coalesce(cast({place} as bigint), 0L))"
    radices = f"transform(w, c -> coalesce({radix}, 1))"
    new = f"zip_with(w, {_feistel(values, radices, key)}, (c, v) -> coalesce({letter}, c))"
    return f"transform(array({_chars(text)}), w -> array_join({new}, ''))[0]"


def _filled(text: str, new: str, free: str) -> str:
    """SQL: text whose characters c with the condition free are replaced by those of new, in turn.

    For short values: each character copies what is left.
    """
    return (
        f"aggregate({_chars(text)}, named_struct('out', '', 'left', {new}), (s, c) -> if({free}, "
        "named_struct('out', concat(s.out, s.left[0]), 'left', slice(s.left, 2, size(s.left))), "
        "named_struct('out', concat(s.out, c), 'left', s.left)), s -> s.out)"
    )


def _only(text: str, allowed: str) -> str:
    return f"regexp_replace({text}, '[^{allowed}]', '')"


def _luhn(digits: str, first: int) -> str:
    """SQL: the Luhn sum of a string of digits; first: 0 if its last digit counts once, else 1."""
    weight = f"if(i % 2 = {1 - first}, if(d > 4, 2 * d - 9, 2 * d), d)"
    return f"aggregate(transform(transform(reverse({_chars(digits)}), c -> cast(c as int)), (d, i) -> {weight}), 0, (a, d) -> a + d)"


def _mod97(text: str) -> str:
    """SQL: the number that an IBAN's characters spell, modulo 97."""
    step = "if(instr('0123456789', c) > 0, (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate({_chars(text)}, 0, (a, c) -> {step})"


def _date_parts(m: str) -> str:
    """SQL: year, month, day of a date; day before month, unless only the other order is valid."""
    part = f"regexp_extract({m}, '^(\\\\d+)[./-](\\\\d+)[./-](\\\\d+)$', %d)"
    one, two, three = (part % k for k in (1, 2, 3))
    dmy = f"try_to_date(concat_ws('-', {three}, lpad({two}, 2, '0'), lpad({one}, 2, '0')), 'yyyy-MM-dd')"
    mdy = f"try_to_date(concat_ws('-', {three}, lpad({one}, 2, '0'), lpad({two}, 2, '0')), 'yyyy-MM-dd')"
    return f"if({m} rlike '^\\\\d{{4}}-', try_to_date({m}, 'yyyy-MM-dd'), coalesce({dmy}, {mdy}))"


def _checked(m: str, kind: str) -> str:
    """SQL: whether the candidate m of a kind passes its check."""
    iban = f"replace({m}, ' ', '')"
    day = f"datediff({_date_parts(m)}, date'1900-01-01')"
    return (
        f"case {kind} when 'ip' then forall(split({m}, '[.]'), o -> cast(o as int) < 256) "
        f"when 'iban' then {_mod97(f'concat(substr({iban}, 5), substr({iban}, 1, 4))')} = 1 "
        f"when 'card' then {_luhn(_only(m, '0-9'), 0)} % 10 = 0 "
        f"when 'date' then coalesce({day} between 0 and {_DAYS - 1}, false) else true end"
    )


def _first_valid(near: str, shapes: list[tuple[str, str]]) -> str:
    """SQL: (m, kind) of the first shape that a value has that begins at the second character of
    near and passes its check, or null."""
    found = (f"named_struct('m', regexp_extract({near}, {_quoted('^[\\s\\S](' + shape + ')')}, 1), 'kind', '{kind}')" for kind, shape in shapes)
    return f"get(filter(array({', '.join(found)}), c -> c.m != '' and {_checked('c.m', 'c.kind')}), 0)"


def _taken(places: str, kind: str) -> str:
    """SQL: of places (at, value, loose), in order, the values that begin behind the one taken before."""
    own = f"named_struct('at', x.at, 'm', x.{kind}.m, 'kind', x.{kind}.kind)"
    step = f"if(x.{kind} is null or x.at < s.free, s, named_struct('free', x.at + length(x.{kind}.m), 'out', concat(s.out, array({own}))))"
    none = "cast(array() as array<struct<at:int,m:string,kind:string>>)"
    return f"aggregate({places}, named_struct('free', 0, 'out', {none}), (s, x) -> {step}, s -> s.out)"


def tokens(gap: str) -> str:
    """SQL: a text as an array of (m, kind) that makes it up, kind null for what is no value.

    Every place where a shape may begin is looked at by itself, so a candidate that fails its check
    hides no other. Tight values are taken from left to right, loose ones where they overlap none.
    """
    segments = f"split({gap}, {_quoted(STARTS)}, -1)"
    heads = f"transform(p.segs, x -> substr(x, 1, {REACH}))"
    at = "aggregate(p.segs, named_struct('n', 0, 'out', cast(array() as array<int>)), (s, x) -> named_struct('n', s.n + length(x), 'out', concat(s.out, array(s.n))), s -> s.out)"
    near = f"concat(if(i = 0, ' ', right(get(p.segs, i - 1), 1)), substr(array_join(slice(q.heads, i + 1, {REACH}), ''), 1, {REACH}))"
    valued = f"named_struct('at', get(q.at, i), 'tight', {_first_valid('n', _TIGHT)}, 'loose', {_first_valid('n', _LOOSE)})"
    places = f"filter(transform(q.heads, (h, i) -> transform(array({near}), n -> {valued})[0]), x -> x.tight is not null or x.loose is not null)"
    apart = "forall(t.tight, y -> x.at + length(x.loose.m) <= y.at or y.at + length(y.m) <= x.at)"
    loose = _taken(f"filter(t.places, x -> x.loose is not null and {apart})", "loose")
    hits = f"array_sort(concat(t.tight, {loose}))"
    cut = f"flatten(array(transform(h, (y, j) -> named_struct('before', if(j = 0, 0, get(h, j - 1).at + length(get(h, j - 1).m)), 'hit', y))))"
    parts = f"flatten(transform({cut}, c -> array(named_struct('m', substr(g, c.before + 1, c.hit.at - c.before), 'kind', cast(null as string)), named_struct('m', c.hit.m, 'kind', c.hit.kind))))"
    last = "named_struct('m', substr(g, if(size(h) = 0, 0, element_at(h, -1).at + length(element_at(h, -1).m)) + 1), 'kind', cast(null as string))"
    whole = f"transform(array({hits}), h -> concat({parts}, array({last})))[0]"
    whole = f"transform(array(named_struct('places', places, 'tight', {_taken('places', 'tight')})), t -> {whole})[0]"
    whole = f"transform(array({places}), places -> {whole})[0]"
    whole = f"transform(array(named_struct('heads', {heads}, 'at', {at})), q -> {whole})[0]"
    plain = "array(named_struct('m', g, 'kind', cast(null as string)))"
    return f"transform(array({gap}), g -> if(g rlike {_quoted(STARTS)}, transform(array(named_struct('segs', {segments.replace(gap, 'g', 1)})), p -> {whole})[0], {plain}))[0]"


def pseudonym(m: str, kind: str, key: str) -> str:
    """SQL: the pseudonym of m, a candidate of a kind."""
    digits = _only(m, "0-9")
    body = f"substr({digits}, 1, length({digits}) - 1)"
    new_body = _in_format(body, [_DIGITS], key + "|card")
    card = f"transform(array({new_body}), b -> concat(b, cast((10 - {_luhn('b', 1)} % 10) % 10 as string)))[0]"
    iban = f"replace({m}, ' ', '')"
    inner = _in_format(f"substr({iban}, 5)", [_DIGITS, _UPPER], key + "|iban")
    check = _mod97(f"concat(b, substr({iban}, 1, 2), '00')")
    new_iban = f"transform(array({inner}), b -> concat(substr({iban}, 1, 2), lpad(cast(98 - {check} as string), 2, '0'), b))[0]"
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    ip = f"array_join(transform({_feistel(octets, 'array(256, 256, 256, 256)', key + '|ip')}, o -> cast(o as string)), '.')"
    day = f"cast(datediff({_date_parts(m)}, date'1900-01-01') as bigint)"
    a, b = _DAY_RADICES
    days = _feistel(f"array({day} div {b}, {day} % {b})", f"array({a}, {b})", key + "|date")
    moved = f"transform(array({days}), v -> date_add(date'1900-01-01', cast(v[0] * {b} + v[1] as int)))[0]"
    sep = f"regexp_extract({m}, '([./-])', 1)"
    two = f"{m} rlike '^\\\\d{{2}}[./-]\\\\d{{2}}[./-]'"
    day_first = f"if({two}, concat('dd', {sep}, 'MM', {sep}, 'yyyy'), concat('d', {sep}, 'M', {sep}, 'yyyy'))"
    date = f"if({m} rlike '^\\\\d{{4}}-', date_format({moved}, 'yyyy-MM-dd'), date_format({moved}, {day_first}))"
    tail = f"regexp_extract({m}, '[.][^.@]*$', 0)"
    email = f"concat({_in_format(f'substr({m}, 1, length({m}) - length({tail}))', [_DIGITS, _LOWER, _UPPER], key + '|email')}, {tail})"
    number = _in_format(digits, [_DIGITS], key + "|number")
    is_digit = "c between '0' and '9'"
    secret = f"if({m} rlike '[a-f]', {_in_format(m, [_DIGITS + 'abcdef'], key + '|secret')}, {_in_format(m, [_DIGITS + 'ABCDEF'], key + '|secret')})"
    return (
        f"case {kind} when 'email' then {email} when 'ip' then {ip} "
        f"when 'iban' then {_filled(m, _chars(new_iban), 'c != concat(chr(32))')} "
        f"when 'secret' then {secret} "
        f"when 'card' then {_filled(m, _chars(card), is_digit)} "
        f"when 'date' then {date} when 'national' then {_filled(m, _chars(number), is_digit)} "
        f"when 'phone' then {_filled(m, _chars(number), is_digit)} else {m} end"
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, and a column n_<kind> with the number of values of each kind.

    Texts without a digit or an at sign are passed on; only candidates of the others are looked at.
    """
    wrapped = docs.select(F.struct("*").alias("doc"), docs["text"].cast("string").alias("text"))
    may = F.col("text").rlike(r"[0-9@]|[0-9a-fA-F]{32}")
    found = F.when(may, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    listed = wrapped.select("doc", "text", found.alias("found"), F.when(may, F.split("text", PATTERN, -1)).alias("gaps"))
    plain = "named_struct('m', m, 'kind', if(instr(m, '@') > 0, 'email', 'secret'))"
    own = f"transform(gaps, (piece, i) -> concat({tokens('piece')}, if(i < size(found), transform(slice(found, i + 1, 1), m -> {plain}), array())))"
    named = listed.withColumn("named", F.expr(f"flatten({own})"))
    has = F.exists("named", lambda x: x["kind"].isNotNull())
    new = F.when(has, F.expr(f"array_join(transform(named, hit -> if(hit.kind is null, hit.m, {pseudonym('hit.m', 'hit.kind', key)})), '')"))
    done = named.withColumn("new", new)
    text = F.coalesce("new", "text")
    columns = [text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]

    def count(kind: str) -> Column:
        return F.coalesce(F.expr(f"aggregate(named, 0, (a, x) -> a + if(x.kind <=> '{kind}', 1, 0))"), F.lit(0)).alias(f"n_{kind}")

    return done.select(*columns, *(count(k) for k in KINDS))

"""PII: keyed, type-consistent surrogates.

Entities are found by one pattern per type and replaced in the text on the spot; all of
it is SQL functions, written as SQL text (``sql`` in the signatures below), which the
session parses faster than it builds such large expressions call by call.  A surrogate is a function of a secret key, the entity's type, its
canonical form and an attempt number, so one entity has one surrogate wherever it
stands and however it is written: the canonical surrogate is laid into each mention's
own format (separators, case, country code, the way an address is shortened).  Digits
give digits, letters letters of the same case and script; card numbers keep the issuer's
digit and the Luhn property, account numbers their country and check digits, names their
hyphens, apostrophes and the gender that any title in the corpus tells.  Initials stay.

Distinctness is checked over the corpus: the table of distinct entities, small against
the texts, is searched for surrogates that two entities share or that are a real
entity's form; those alone try again, against all settled ones, until none is left.  From
the attempt ``WIDER_FROM`` on each draws from a wider space than the one before, so a
space smaller than its entities doesn't end the search.  Private IPv4 addresses need no
search: they are permuted within their block by a keyed cycle, which leaves none in place
and gives no two the same.

What a text needs to know of the corpus (later attempts, genders that other titles tell)
is little and travels as a literal map; if there are more than ``MOST_INLINE`` such
entities they are joined by the hash of the text instead.  A name once found after a
title is replaced wherever it stands in that text with a capital, unless the text has it
as a common word too.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from planewise.llm.common import cut

#: The session's setting that holds the secret key.
KEY_SETTING = "planewise.pii.key"
MOST_INLINE = 1000
MOST_ROUNDS = 64
#: Attempts from this one on draw from ever wider spaces.
WIDER_FROM = 4
#: Characters of an e-mail's local part, or of the labels below its domain, that a surrogate has at most.
MOST_LOCAL = 64

# Titles that tell a person's gender, or that a person follows.
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme")
OTHER_TITLES = ("Dr", "Prof")

_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]+|['’]\p{Lu}[\p{L}\p{M}]+)(?:['’\-]\p{L}[\p{L}\p{M}]+){0,4}"
_HEX = "[0-9A-Fa-f]{1,4}"
#: No unbounded repetition of a group: the regex engine would recurse once a repetition, and one text could end an executor.
PATTERNS = {
    "SECRET": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![\p{L}\p{N}])",
    "EMAIL": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]++@[\p{L}\p{N}][\p{L}\p{N}.\-]*\.\p{L}{2,}",
    "IPV4": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])",
    "IPV6": rf"(?<![:\p{{L}}\p{{N}}])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]{{0,30}}[0-9])(?=[0-9A-Fa-f:]{{3,39}}(?![:\p{{L}}\p{{N}}])){_HEX}(?::{_HEX}){{0,5}}::{_HEX}(?::{_HEX}){{0,5}})(?![:\p{{L}}\p{{N}}])",
    "SSN": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "PHONE": r"(?<![\p{L}\p{N}+])(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)|\d{3})[ .\-]\d{3}[ .\-]\d{4}|\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}|\+\d{9,14})(?![\p{L}\p{N}])",
    "CARD": r"(?<![\p{L}\p{N}])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,4}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?![\p{L}\p{N}])",
    "IBAN": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "PERSON": rf"(?<!\p{{L}})(?:{_TITLES})\.? (?:\p{{Lu}}\. ){{0,3}}{_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has; most texts have none of it and go through untouched.
HINT = rf"[0-9@]|(?=[MDPHFS])(?:{_TITLES})[. ]|AKIA|gh[pousr]_|[a-f]{{32}}|[A-F]{{32}}|[A-Fa-f]:[A-Fa-f]{{1,4}}:"
#: What stands before the names of a person: the title and initials.
BEFORE_NAMES = r"^\p{L}+\.? (?:\p{Lu}\. ){0,3}"
#: A name, and a common word, as whole words of a text.
WORD = rf"(?<![\p{{L}}\p{{M}}\p{{N}}'’\-]){_NAME}"
COMMON_WORD = r"(?<![\p{L}\p{M}'’\-])\p{Ll}[\p{L}\p{M}]+"
PRIVATE = r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."

# Letters of scripts, lower case where there are cases.
ALPHABETS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Devanagari": "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Han": "山川田木林森石水火土金王李张陈刘杨黄周吴徐孙马朱胡",
    "Hangul": "가나다라마바사아자차카타파하거너더러머버서어저",
}
_LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Consonants and vowels of made names, and endings of male, female and other names, by script.
SYLLABLES = {"Cyrillic": ("бвгдзклмнпрстф", "аеиоу", "н", "на", "к"), "Greek": ("βγδζκλμνπρστφ", "αεηιο", "ν", "να", "λ")}
LATIN_SYLLABLES = ("bdfgklmnprstvz", "aeiou", "n", "na", "l")
MALE, FEMALE, UNKNOWN = 1, 2, 0


class Key:
    """Pads of a keyed hash (HMAC with SHA-256); plans hold a key derived from the secret, not the secret."""

    def __init__(self, secret: str) -> None:
        block = hmac.new(secret.encode(), b"planewise surrogates", hashlib.sha256).digest().ljust(64, b"\0")
        self.inner, self.outer = (bytes(x ^ pad for x in block) for pad in (0x36, 0x5C))

    def digest(self, message: str) -> str:
        """SQL of the hash as 64 hexadecimal digits."""
        return f"sha2(concat(X'{self.outer.hex()}', unhex(sha2(concat(X'{self.inner.hex()}', CAST({message} AS BINARY)), 256))), 256)"


def key_of(spark: SparkSession, secret: str | None = None) -> Key:
    """The key given or set in the session as ``KEY_SETTING``; there is no default one: who knows the key can undo surrogates."""
    secret = secret or spark.conf.get(KEY_SETTING, None)
    if not secret:
        raise ValueError(f"surrogates need a secret key: pass one or set {KEY_SETTING}")
    return Key(secret)


#: What looks like an entity and is none; it stays.
NUMBER = "NUMBER"
NO_ENTITIES = "CAST(array() AS ARRAY<STRUCT<kind: STRING, canon: STRING, gender: INT>>)"
_names = count()
NO_STRINGS = "CAST(array() AS ARRAY<STRING>)"


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` with a name for ``value``: the plan holds it once, however often the body uses it."""
    v = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def each(array: str, body: Callable[[str, str], str]) -> str:
    """``body`` of every element and its place."""
    n = next(_names)
    return f"transform({array}, (e{n}, i{n}) -> {body(f'e{n}', f'i{n}')})"


def _characters(s: str, body: Callable[[str, str], str]) -> str:
    return f"array_join({each(f'split({s}, {quoted(str())})', body)}, '')"


def kind_of(m: str) -> str:
    """The type of a mention, tried in the order of ``PATTERNS``; ungrouped digits that fail the Luhn check are a number (a time, a key), no card, unless they are sixteen."""
    card = rf"IF({m} RLIKE '[ \\-]' OR length({m}) = 16 OR {luhn_sum(m)} % 10 = 0, 'CARD', '{NUMBER}')"
    return "CASE " + " ".join(f"WHEN {m} RLIKE {quoted(f'^(?:{p})$')} THEN {card if name == 'CARD' else quoted(name)}" for name, p in PATTERNS.items()) + " END"


def digits_of(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def gender_of(m: str) -> str:
    """The gender that a person's title tells."""
    listed = lambda titles: ", ".join(map(quoted, titles))
    return let(rf"regexp_extract({m}, '^(\\p{{L}}+)', 1)", lambda t: f"CASE WHEN {t} IN ({listed(MALE_TITLES)}) THEN {MALE} WHEN {t} IN ({listed(FEMALE_TITLES)}) THEN {FEMALE} ELSE {UNKNOWN} END")


def names_of(m: str) -> str:
    return f"split(regexp_replace({m}, {quoted(BEFORE_NAMES)}, ''), ' ')"


def _groups(side: str) -> str:
    return f"filter(split({side}, ':'), g -> g <> '')"


def groups_of(address: str) -> str:
    """The eight groups of an IPv6 address, shortened or not, each of four digits."""
    right = lambda s: f"CASE WHEN size({s}) > 1 THEN {_groups(f'element_at({s}, -1)')} ELSE {NO_STRINGS} END"
    sides = let(f"split({address}, '::')", lambda s: f"struct({_groups(f'element_at({s}, 1)')} AS a, {right(s)} AS b)")
    return let(sides, lambda x: f"transform(concat({x}.a, array_repeat('0', greatest(0, 8 - size({x}.a) - size({x}.b))), {x}.b), g -> lpad(lower(g), 4, '0'))")


def entities_of(m: str, kind: str) -> str:
    """The mention's entities as an array of (kind, canon, gender): the names of a person, else one."""
    one = lambda k, c, g: f"named_struct('kind', {k}, 'canon', {c}, 'gender', {g})"
    person = let(names_of(m), lambda ns: each(ns, lambda n, i: one(f"IF({i} = size({ns}) - 1, 'SURNAME', 'GIVEN')", f"lower({n})", gender_of(m))))
    canon = f"""CASE WHEN {kind} = 'PHONE' THEN right({digits_of(m)}, 10) WHEN {kind} IN ('CARD', 'SSN') THEN {digits_of(m)} WHEN {kind} = 'IBAN' THEN replace({m}, ' ', '')
        WHEN {kind} = 'EMAIL' THEN lower({m}) WHEN {kind} = 'IPV6' THEN array_join({groups_of(m)}, ':') ELSE {m} END"""
    return f"CASE WHEN {kind} = 'PERSON' THEN {person} WHEN {kind} = '{NUMBER}' THEN {NO_ENTITIES} ELSE array({one(kind, canon, str(UNKNOWN))}) END"


def _number(h: str, i: str | int) -> str:
    """The i-th keyed number, 0 to 255, of a digest of 128 hexadecimal digits."""
    return f"CAST(conv(substr({h}, ({i}) % 64 * 2 + 1, 2), 16, 10) AS INT)"


def _pick(letters: str, n: str) -> str:
    return f"substr('{letters}', {n} % {len(letters)} + 1, 1)"


def _script(c: str, script: str) -> str:
    return rf"{c} RLIKE '\\p{{Is{script}}}'"


def _mapped(s: str, h: str, scripts: bool = False) -> str:
    """Each character by a keyed one of its class: digit or letter of its case and, with ``scripts``, of its script; others stay."""

    def one(c: str, i: str) -> str:
        n = _number(h, i)
        plain = f"WHEN {c} BETWEEN '0' AND '9' THEN {_pick('0123456789', n)} WHEN {c} BETWEEN 'a' AND 'z' THEN {_pick(_LATIN, n)} WHEN {c} BETWEEN 'A' AND 'Z' THEN upper({_pick(_LATIN, n)})"
        if not scripts:
            return f"CASE {plain} ELSE {c} END"
        of = " ".join(f"WHEN {_script(c, script)} THEN {_pick(letters, n)}" for script, letters in ALPHABETS.items())
        return rf"CASE {plain} WHEN {c} RLIKE '\\p{{L}}' THEN {let(f'CASE {of} ELSE {_pick(_LATIN, n)} END', lambda x: rf"IF({c} RLIKE '\\p{{Lu}}', upper({x}), {x})")} ELSE {c} END"

    return _characters(s, one)


def _more(n: str, h: str, letters: tuple[str, ...]) -> str:
    """``n`` further keyed groups, each of one of every of the ``letters``; none for n < 1."""
    group = lambda i: let(f"sha2(concat_ws('|', {h}, CAST({i} AS STRING)), 256)", lambda d: "concat(" + ", ".join(_pick(x, _number(d, j)) for j, x in enumerate(letters)) + ")")
    return f"IF({n} > 0, array_join({each(f'sequence(1, greatest({n}, 1))', lambda i, _: group(i))}, ''), '')"


def luhn_sum(digits: str) -> str:
    """Sum of the Luhn check over a string of digits."""
    double = lambda c: f"CAST({c} AS INT) * 2 - IF(CAST({c} AS INT) > 4, 9, 0)"
    parts = each(f"split({digits}, '')", lambda c, i: f"IF((length({digits}) - {i}) % 2 = 0, {double(c)}, CAST({c} AS INT))")
    return f"aggregate({parts}, 0, (a, b) -> a + b)"


def _card(canon: str, h: str) -> str:
    inner = f"concat(left({canon}, 1), substr({_mapped(canon, h)}, 2, length({canon}) - 2))"
    check = lambda x: f"CAST((10 - {luhn_sum(f'concat({x}, 0)')} % 10) % 10 AS STRING)"
    return let(inner, lambda x: f"concat({x}, IF({luhn_sum(canon)} % 10 = 0, {check(x)}, {_pick('0123456789', _number(h, 31))}))")


def _iban(canon: str, h: str) -> str:
    """Country and mapped number, with the check digits that make the remainder by 97 one where the original's was."""

    def remainder(x: str) -> str:
        """Of the digits that letters (A is 10) and digits of ``x`` stand for."""
        return f"aggregate(split({x}, ''), 0, (r, c) -> IF(c BETWEEN '0' AND '9', r * 10 + CAST(c AS INT), r * 100 + ascii(c) - 55) % 97)"

    right = f"{remainder(f'concat(substr({canon}, 5), left({canon}, 4))')} = 1"
    check = lambda x: f"lpad(CAST(98 - {remainder(f'concat({x}, left({canon}, 2), 0, 0)')} AS STRING), 2, '0')"
    free = f"concat({_pick('0123456789', _number(h, 30))}, {_pick('0123456789', _number(h, 31))})"
    return let(f"substr({_mapped(canon, h)}, 5)", lambda x: f"concat(left({canon}, 2), CASE WHEN {right} THEN {check(x)} ELSE {free} END, {x})")


def _cycled(x: str, size: str, key: Key) -> str:
    """The next of ``x`` on one keyed cycle through 0 to ``size`` squared less 1: a permutation that leaves nothing in place.

    Four Feistel rounds over two digits of base ``size`` (a power of two), one step, and the rounds backwards.
    """
    pair = lambda l, r: f"named_struct('l', {l}, 'r', {r})"
    noise = lambda r, i: f"CAST(conv(left({key.digest(f"concat_ws('|', 'IPV4', {size}, {i}, {r})")}, 6), 16, 10) AS BIGINT) % {size}"

    def forth(p: str, i: int) -> str:
        return let(p, lambda q: pair(f"{q}.r", f"({q}.l ^ {noise(f'{q}.r', i)})"))

    def back(p: str, i: int) -> str:
        return let(p, lambda q: pair(f"({q}.r ^ {noise(f'{q}.l', i)})", f"{q}.l"))

    state = pair(f"{x} div {size}", f"{x} % {size}")
    for i in range(4):
        state = forth(state, i)
    state = let(state, lambda p: let(f"({p}.l * {size} + {p}.r + 1) % ({size} * {size})", lambda y: pair(f"{y} div {size}", f"{y} % {size}")))
    for i in reversed(range(4)):
        state = back(state, i)
    return let(state, lambda p: f"{p}.l * {size} + {p}.r")


def _private(canon: str, key: Key) -> str:
    """A private address by another of its block: the lower 24, 20 or 16 bits are permuted."""

    def of(o: str) -> str:
        wide, middle, low = f"{o}[0] IN (10, 127)", f"{o}[0] = 172", f"{o}[2] * 256 + {o}[3]"
        inner = f"named_struct('x', CASE WHEN {wide} THEN {o}[1] * 65536 + {low} WHEN {middle} THEN ({o}[1] - 16) * 65536 + {low} ELSE {low} END, 'size', CAST(CASE WHEN {wide} THEN 4096 WHEN {middle} THEN 1024 ELSE 256 END AS BIGINT))"
        second = lambda y: f"CASE WHEN {wide} THEN {y} div 65536 WHEN {middle} THEN {y} div 65536 + 16 ELSE {o}[1] END"
        return let(inner, lambda p: let(_cycled(f"{p}.x", f"{p}.size", key), lambda y: f"concat_ws('.', {o}[0], {second(y)}, {y} div 256 % 256, {y} % 256)"))

    return let(rf"transform(split({canon}, '\\.'), x -> CAST(x AS BIGINT))", of)


def _public(h: str) -> str:
    firsts = [str(x) for x in range(11, 224) if x not in (127, 169, 172, 192)]
    rest = ", ".join(f"{_number(h, k)} % 254 + 1" for k in (1, 2, 3))
    return f"concat_ws('.', element_at(array({', '.join(firsts)}), {_number(h, 0)} % {len(firsts)} + 1), {rest})"


def _shaped_groups(canon: str, h: str, extra: str) -> str:
    """The groups of an IPv6 address with zeros at the front of a group kept, so that it is shortened the same way.

    ``extra`` of these zeros become digits too, so that later attempts reach ever more
    addresses, all of them in the end.  Link-local and unique-local addresses keep what
    makes them so, and no other becomes one.
    """

    def group(g: str, k: str) -> str:
        digit = lambda z, i: f"CASE WHEN {i} < {z} THEN '0' WHEN {i} = {z} THEN IF({k} = 0 AND {i} = 0, {_pick('123456789abcde', _number(h, f'{k} * 4 + {i}'))}, {_pick('123456789abcdef', _number(h, f'{k} * 4 + {i}'))}) ELSE {_pick('0123456789abcdef', _number(h, f'{k} * 4 + {i}'))} END"
        made = let(f"greatest(0, length(regexp_extract({g}, '^(0*)', 1)) - greatest(0, {extra}))", lambda z: f"concat({', '.join(digit(z, i) for i in range(4))})")
        return let(made, lambda x: f"CASE WHEN {k} = 0 AND {g} RLIKE '^fe[89ab]' THEN {g} WHEN {k} = 0 AND {g} RLIKE '^f[cd]' THEN concat(left({g}, 2), right({x}, 2)) ELSE {x} END")

    return f"array_join({each(f"split({canon}, ':')", group)}, ':')"


_PARTS = quoted(r"(?<=['’\-])|(?=['’\-])")


def _name(canon: str, kind: str, gender: str, h: str, extra: str) -> str:
    """Each part of a name as keyed syllables, ``extra`` more and an ending by gender, in the name's script; hyphens and apostrophes stay."""

    def built(part: str, d: str, letters: tuple[str, str, str, str, str]) -> str:
        consonants, vowels, male, female, family = letters
        syllables = ", ".join(_pick(x, _number(d, 2 * k + j)) for k in range(3) for j, x in enumerate((consonants, vowels)))
        ending = f"CASE WHEN {kind} <> 'GIVEN' THEN '{family}' WHEN {gender} = {MALE} THEN '{male}' WHEN {gender} = {FEMALE} THEN '{female}' ELSE '{family}' END"
        single = rf"IF({part} RLIKE '\\p{{L}}', {_pick(consonants, _number(d, 0))}, {part})"
        return f"IF(length({part}) = 1, {single}, concat({syllables}, {_more(extra, d, (consonants, vowels))}, {ending}))"

    def one(part: str, i: str) -> str:
        made = lambda d: "CASE " + " ".join(f"WHEN {_script(part, x)} THEN {built(part, d, letters)}" for x, letters in SYLLABLES.items()) + f" ELSE {built(part, d, LATIN_SYLLABLES)} END"
        further = let(f"sha2(concat_ws('|', {h}, {i}), 256)", lambda d: f"concat({d}, sha2({d}, 256))")
        return let(f"IF({i} = 0, {h}, {further})", made)

    return f"array_join({each(f'split({canon}, {_PARTS})', one)}, '')"


def surrogate_of(kind: str, canon: str, gender: str, attempt: str, key: Key) -> str:
    """The canonical surrogate of an entity."""
    entity = f"named_struct('k', {kind}, 'c', {canon}, 'g', {gender}, 'a', {attempt})"
    return let(entity, lambda e: let(key.digest(f"concat_ws('|', {e}.k, {e}.c, {e}.a)"), lambda d: let(f"concat({d}, sha2({d}, 256))", lambda h: _surrogate(e, h, key))))


def _surrogate(e: str, h: str, key: Key) -> str:
    kind, canon = f"{e}.k", f"{e}.c"
    extra = f"({e}.a - {WIDER_FROM - 1})"

    def mail(x: str) -> str:
        """The domain becomes a reserved one; labels below it are mapped with the local part."""
        below = f"IF(size({x}) > 2, concat(right(array_join(slice({x}, 1, greatest(size({x}) - 2, 0)), '.'), {MOST_LOCAL}), '.'), '')"
        local = f"left(substring_index({canon}, '@', 1), {MOST_LOCAL})"
        made = lambda m: f"concat({m}[0], {_more(extra, h, (_LATIN,))}, '@', {m}[1], 'example.', right(element_at({x}, -1), {MOST_LOCAL}))"
        return let(f"split({_mapped(f"concat({local}, '@', {below})", h, scripts=True)}, '@')", made)

    upper = f"{canon} RLIKE '[A-F]'"
    hexadecimal = _characters(canon, lambda c, i: f"IF({upper}, {_pick('0123456789ABCDEF', _number(h, i))}, {_pick('0123456789abcdef', _number(h, i))})")
    mapped = _mapped(canon, h)
    ways = {
        f"{kind} = 'EMAIL'": let(rf"split(substring_index({canon}, '@', -1), '\\.')", mail),
        f"{kind} = 'IPV4' AND {canon} RLIKE {quoted(PRIVATE)}": _private(canon, key),
        f"{kind} = 'IPV4'": _public(h),
        f"{kind} = 'IPV6'": _shaped_groups(canon, h, extra),
        f"{kind} = 'SECRET' AND {canon} RLIKE '^(?:[0-9a-f]+|[0-9A-F]+)$'": hexadecimal,
        f"{kind} = 'SECRET'": f"concat(left({canon}, 4), substr({mapped}, 5))",
        f"{kind} = 'CARD'": _card(canon, h),
        f"{kind} = 'PHONE'": f"concat({_pick('23456789', _number(h, 30))}, substr({mapped}, 2), {_more(f'least({extra}, 10 - length({canon}))', h, ('0123456789',))})",
        f"{kind} = 'IBAN'": _iban(canon, h),
        f"{kind} IN ('SURNAME', 'GIVEN')": _name(canon, kind, f"{e}.g", h, extra),
    }
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in ways.items()) + f" ELSE {mapped} END"


def _laid_digits(m: str, s: str) -> str:
    """The digits of ``s`` in the places of the last digits of ``m``; other characters, and digits before those, stay."""
    nth = lambda i: f"length({digits_of(f'left({m}, {i} + 1)')}) - (length({digits_of(m)}) - length({s}))"
    return _characters(m, lambda c, i: f"IF({c} BETWEEN '0' AND '9' AND {nth(i)} > 0, substr({s}, {nth(i)}, 1), {c})")


def _laid_case(m: str, s: str) -> str:
    """``s`` in the case of ``m``, character by character where the lengths agree."""
    same = _characters(s, lambda c, i: rf"IF(substr({m}, {i} + 1, 1) RLIKE '\\p{{Lu}}', upper({c}), {c})")
    return f"CASE WHEN length({m}) = length({s}) THEN {same} ELSE {s} END"


def _laid_spaces(m: str, s: str) -> str:
    return _characters(m, lambda c, i: f"IF({c} = ' ', ' ', substr({s}, length(replace(left({m}, {i} + 1), ' ', '')), 1))")


def _laid_groups(m: str, s: str) -> str:
    """The groups of ``s`` in the places of those of ``m``, as long as those or, if they need it, longer; all eight if ``m`` leaves out one that ``s`` has."""
    shown = lambda g, n: let(g, lambda x: f"right({x}, greatest({n}, length(regexp_replace({x}, '^0+', ''))))")
    laid = lambda side, first: f"array_join({each(_groups(side), lambda g, i: shown(f"element_at(split({s}, ':'), CAST({first} + {i} + 1 AS INT))", f'length({g})'))}, ':')"
    sizes = lambda x: (f"size({_groups(f'{x}[0]')})", f"size({_groups(f'element_at({x}, -1)')})")
    whole = f"array_join({each(f"split({s}, ':')", lambda g, _: shown(g, '1'))}, ':')"

    def of(x: str) -> str:
        before, behind = sizes(x)
        left_out = f"exists(slice(split({s}, ':'), {before} + 1, greatest(0, 8 - {before} - {behind})), g -> g <> '0000')"
        return f"CASE WHEN size({x}) = 1 THEN {laid(f'{x}[0]', 0)} WHEN {left_out} THEN {whole} ELSE concat({laid(f'{x}[0]', 0)}, '::', {laid(f'element_at({x}, -1)', f'8 - {behind}')}) END"

    return let(let(f"split({m}, '::')", of), lambda out: f"IF({m} = upper({m}), upper({out}), {out})")


def _laid_name(was: str, s: str) -> str:
    """``s`` in capitals if ``was`` is, else with a capital at each part that has one in ``was``."""
    part = lambda old: each(f"split({s}, {_PARTS})", lambda p, i: rf"IF(coalesce(try_element_at({old}, {i} + 1), 'A') RLIKE '^\\p{{Lu}}', concat(upper(left({p}, 1)), substr({p}, 2)), {p})")
    return f"IF(length({was}) > 1 AND {was} = upper({was}), upper({s}), array_join({let(f'split({was}, {_PARTS})', part)}, ''))"


def replacement(m: str, known: str | None, key: Key) -> str:
    """(new, was, now): what a mention becomes; for a person also the names, lower-cased, and their surrogates.

    ``known`` is a map from ``kind|canonical form`` to four times an attempt plus a gender (see ``replace``).
    """

    def of(x: str) -> str:
        said = f"try_element_at({known}, concat_ws('|', {x}.kind, {x}.canon))" if known else "CAST(NULL AS INT)"
        return let(said, lambda c: surrogate_of(f"{x}.kind", f"{x}.canon", f"coalesce({c} % 4, {x}.gender)", f"coalesce({c} div 4, 0)", key))

    def laid(kind: str, s: str) -> str:
        own = let(f"length({digits_of(m)})", lambda n: f"IF({kind} = 'PHONE', least({n}, 10), {n})")
        digits = let(own, lambda n: f"concat({_laid_digits(m, f'left({s}, {n})')}, substr({s}, {n} + 1))")
        return f"CASE WHEN {kind} IN ('PHONE', 'CARD', 'SSN') THEN {digits} WHEN {kind} = 'EMAIL' THEN {_laid_case(m, s)} WHEN {kind} = 'IPV6' THEN {_laid_groups(m, s)} WHEN {kind} = 'IBAN' THEN {_laid_spaces(m, s)} ELSE {s} END"

    def row(new: str, was: str, now: str) -> str:
        return f"named_struct('new', {new}, 'was', {was}, 'now', {now})"

    def done(x: str) -> str:
        """From (kind, surrogates of the entities)."""
        named = each(names_of(m), lambda was, i: _laid_name(was, f"{x}.now[{i}]"))
        person = row(f"concat(regexp_extract({m}, {quoted(BEFORE_NAMES)}, 0), array_join({named}, ' '))", f"transform({names_of(m)}, x -> lower(x))", f"{x}.now")
        return f"CASE WHEN {x}.kind = 'PERSON' THEN {person} WHEN {x}.kind = '{NUMBER}' THEN {row(m, NO_STRINGS, NO_STRINGS)} ELSE {row(laid(f'{x}.kind', f'{x}.now[0]'), NO_STRINGS, NO_STRINGS)} END"

    return let(kind_of(m), lambda k: let(f"named_struct('kind', {k}, 'now', {each(entities_of(m, k), lambda x, _: of(x))})", done))


def mentions(text: str) -> str:
    """All mentions in a text, in order; an empty array for null."""
    return f"CASE WHEN {text} RLIKE {quoted(HINT)} THEN regexp_extract_all({text}, {quoted(PATTERN)}, 0) ELSE {NO_STRINGS} END"


def rewritten(text: str, found: str, changed: str) -> str:
    """The text with ``changed`` in the place of its mentions, and with the same surrogates for names that stand again without a title."""

    def bare(piece: str, names: str) -> str:
        swapped = lambda w: f"IF(array_contains({names}.free, lower({w})), {_laid_name(w, f'try_element_at({names}.now, CAST(array_position({names}.was, lower({w})) AS INT))')}, {w})"
        words = each(f"regexp_extract_all({piece}, {quoted(WORD)}, 0)", lambda w, _: swapped(w))
        joined = let(words, lambda ws: f"array_join({each(f'split({piece}, {quoted(WORD)})', lambda r, j: f"concat({r}, coalesce(try_element_at({ws}, {j} + 1), ''))")}, '')")
        return f"CASE WHEN size({names}.free) > 0 THEN {joined} ELSE {piece} END"

    def joined(names: str) -> str:
        return f"array_join({each(f'split({text}, {quoted(PATTERN)})', lambda p, i: f"concat({bare(p, names)}, coalesce(try_element_at({changed}, {i} + 1).new, ''))")}, '')"

    # A word that the text also has in lower case is no name.
    free = lambda was: f"CASE WHEN size({was}) > 0 THEN array_except({was}, regexp_extract_all({text}, {quoted(COMMON_WORD)}, 0)) ELSE {NO_STRINGS} END"
    names = let(f"flatten(transform({changed}, c -> c.was))", lambda was: f"named_struct('was', {was}, 'now', flatten(transform({changed}, c -> c.now)), 'free', {free(was)})")
    return f"CASE WHEN size({found}) > 0 THEN {let(names, joined)} ELSE {text} END"


def entity_table(docs: DataFrame) -> DataFrame:
    """(kind, canon, gender, mixed) of all entities, once each.

    ``gender`` is what the titles of the corpus tell of a name, none if they disagree;
    ``mixed`` says that some mention's own title tells something else.
    """
    m = docs.selectExpr(f"explode(array_distinct({mentions('text')})) AS m").distinct()
    each_one = m.selectExpr("m", f"{kind_of('m')} AS k").selectExpr(f"explode({entities_of('m', 'k')}) AS e").select("e.*")
    male, female, untold = (F.max((F.col("kind") == "GIVEN") & (F.col("gender") == g)) for g in (MALE, FEMALE, UNKNOWN))
    told = each_one.groupBy("kind", "canon").agg(male.alias("m"), female.alias("f"), untold.alias("u"))
    return told.selectExpr("kind", "canon", f"CASE WHEN m AND NOT f THEN {MALE} WHEN f AND NOT m THEN {FEMALE} ELSE {UNKNOWN} END AS gender", "CAST(m AS INT) + CAST(f AS INT) + CAST(u AS INT) > 1 AS mixed")


def assign(entities: DataFrame, key: Key) -> DataFrame:
    """(kind, canon, gender, mixed, attempt, surrogate), no surrogate twice in a kind and none that is an entity's own form.

    Only private addresses, which are permuted, may take the form of another entity.
    """
    known = cut(entities)
    real = known.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
    order = Window.partitionBy("kind", "surrogate").orderBy("canon")
    waiting, settled = known.withColumn("attempt", F.lit(0)), None
    for _ in range(MOST_ROUNDS):
        drawn = waiting.withColumn("surrogate", F.expr(surrogate_of("kind", "canon", "gender", "attempt", key)))
        judged = drawn.withColumn("nth", F.row_number().over(order)).join(real, ["kind", "surrogate"], "left")
        clash = (F.col("nth") > 1) | F.coalesce("real", F.lit(False))
        if settled is not None:
            judged = judged.join(settled.select("kind", "surrogate", F.lit(True).alias("taken")), ["kind", "surrogate"], "left")
            clash = clash | F.coalesce("taken", F.lit(False))
        permuted = (F.col("kind") == "IPV4") & F.col("canon").rlike(PRIVATE)
        judged = cut(judged.select("kind", "canon", "gender", "mixed", "attempt", "surrogate", (clash & ~permuted).alias("clash")))
        good = judged.where("not clash").drop("clash")
        settled = good if settled is None else settled.unionByName(good)
        waiting = judged.where("clash").select("kind", "canon", "gender", "mixed", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return settled
    raise RuntimeError("surrogates keep clashing")


def replace(docs: DataFrame, key: Key, most_inline: int = MOST_INLINE) -> DataFrame:
    """(row, text, found): each row of ``docs`` as a struct, its new text and the mentions found.

    Null and empty texts stay; repeated rows get equal rows; an empty table gives none;
    a text may be as long as a value can be.  Further columns may have any name: they
    stay inside the struct.
    """
    told = assign(entity_table(docs), key).where("attempt > 0 or mixed").select(F.concat_ws("|", "kind", "canon").alias("k"), (F.col("attempt") * 4 + F.col("gender")).alias("code"))
    few = {r["k"]: r["code"] for r in told.limit(most_inline + 1).collect()}
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"), F.expr(mentions("text")).alias("found"))
    known = None
    if len(few) > most_inline:
        one = found.where(F.size("found") > 0).select(F.sha2("text", 256).alias("hash"), F.explode("found").alias("m")).distinct()
        pairs = one.selectExpr("hash", "m", f"{kind_of('m')} AS kind").selectExpr("hash", f"explode({entities_of('m', 'kind')}) AS e").select("hash", F.concat_ws("|", "e.kind", "e.canon").alias("k")).distinct()
        of_text = pairs.join(told, "k").groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("k", "code"))).alias("known"))
        # Texts without mentions match nothing and meet under many keys, so that they aren't one hot key.
        hashed = F.when(F.size("found") > 0, F.sha2("text", 256)).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64("text"), F.lit(4096)).cast("string")))
        found = found.withColumn("hash", hashed).join(of_text, "hash", "left").drop("hash")
        known = "coalesce(known, CAST(map() AS MAP<STRING, INT>))"
    elif few:
        known = "known"
        found = found.withColumn("known", F.create_map(*(F.lit(x) for pair in few.items() for x in pair)))
    changed = f"CASE WHEN size(found) > 0 THEN {each('found', lambda m, _: replacement(m, known, key))} END"
    return found.selectExpr("row", "text", "found", f"{changed} AS changed").selectExpr("row", f"{rewritten('text', 'found', 'changed')} AS text", "found")


def surrogates(docs: DataFrame, key: str | None = None, **settings: int) -> DataFrame:
    """doc_id, text with surrogates, n_mentions and the mentions' kinds of every row; further columns aren't read."""
    out = replace(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key_of(docs.sparkSession, key), **settings)
    kinds = F.expr(f"filter(transform(found, m -> {kind_of('m')}), k -> k <> '{NUMBER}')")
    return out.select("row.doc_id", "text", kinds.alias("kinds")).select("doc_id", "text", F.size("kinds").cast("long").alias("n_mentions"), "kinds")


def replaced(docs: DataFrame, key: str | None = None, **settings: int) -> DataFrame:
    """``docs`` with exactly its own columns, the text rewritten and n_chars, if there and a whole number, counted anew where it was."""
    out = replace(docs, key_of(docs.sparkSession, key), **settings)
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own and isinstance(docs.schema["n_chars"].dataType, IntegralType):
        own["n_chars"] = F.when(F.size("found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return out.select(*(c.alias(n) for n, c in own.items()))

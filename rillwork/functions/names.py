"""Place-name folding: one form for the spellings that romanisation of Indian names gives rise to."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order: doubled vowels, v/w, j/z, aspirates, sh/s, doubled consonants, final a.
FOLDS = (
    (r"aa+", "a"),
    (r"ee+", "i"),
    (r"ii+", "i"),
    (r"oo+", "u"),
    (r"uu+", "u"),
    (r"w", "v"),
    (r"z", "j"),
    (r"([kgcjtdpb])h+", r"\1"),
    (r"sh+", "s"),
    (r"([bcdfghjklmnpqrstvy])\1+", r"\1"),
    (r"a$", ""),
)
_VIRAMA, _NUKTA = "्", "़"
#: Base letters whose sound a nukta changes.
_WITH_NUKTA = {"d": "r", "dh": "rh", "ph": "f"}


@lru_cache(None)
def _letter(ch: str) -> tuple[str, str]:
    """(kind, sound) of a Devanagari character, from its Unicode name; kinds: consonant, vowel, sign, other."""
    name = unicodedata.name(ch, "")
    m = re.fullmatch(r"DEVANAGARI (LETTER|VOWEL SIGN|SIGN) (?:VOCALIC (R)|([A-Z]+))", name)
    if not m:
        return "other", ""
    kind, sound = m[1], "ri" if m[2] else m[3].lower()
    if kind == "SIGN":
        return ("sign", {"anusvara": "n", "candrabindu": "n", "visarga": "h", "nukta": ""}[sound]) if sound in ("anusvara", "candrabindu", "visarga", "nukta") else ("other", "")
    if kind == "VOWEL SIGN":
        return "sign", sound
    if m[2] or not re.fullmatch(r"[bcdghjklmnprstvy]+h?a", sound):
        return ("vowel", sound) if m[2] or sound in ("a", "aa", "i", "ii", "u", "uu", "e", "ai", "o", "au") else ("other", "")
    sound = re.sub(r"^([bdlnt])\1", r"\1", sound[:-1])
    return "consonant", {"c": "ch", "ch": "chh", "ss": "sh"}.get(sound, sound)


def syllables(text: str) -> list[list]:
    """F-03: [sound, vowel, inherent] units; the vowel a that a consonant has unless another sign follows is inherent."""
    out: list[list] = []
    chars, i = unicodedata.normalize("NFC", text), 0
    while i < len(chars):
        ch = chars[i]
        i += 1
        kind, sound = _letter(ch)
        if kind == "consonant":
            if i < len(chars) and chars[i] == _NUKTA:
                sound, i = _WITH_NUKTA.get(sound, sound), i + 1
            nxt = chars[i] if i < len(chars) else ""
            if nxt == _VIRAMA:
                out.append([sound, "", False])
                i += 1
            elif nxt and _letter(nxt)[0] == "sign":
                out.append([sound, _letter(nxt)[1], False])
                i += 1
            else:
                out.append([sound, "a", True])
        elif kind in ("vowel", "sign"):
            out.append(["", sound, False])
        elif not "ऀ" <= ch <= "ॿ":
            out.append([ch, "", False])
    return out


def devanagari_to_latin(text: str) -> str:
    """F-02: with silent inherent vowels left out: at the end, and (but for the first unit) before a unit whose vowel is written."""
    units = syllables(text)
    for i in range(len(units) - 1, -1, -1):
        last = i == len(units) - 1
        if units[i][2] and (last or (i > 0 and units[i + 1][1] and not units[i + 1][2])):
            units[i][1], units[i][2] = "", False
    return "".join(c + v for c, v, _ in units)


def strip_marks(text: str) -> str:
    """F-04."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def fold(text: str | None) -> str:
    """F-01: the search form of a name; empty if it has no letter or digit."""
    text = (text or "").strip()
    if any("ऀ" <= c <= "ॿ" for c in text):
        text = devanagari_to_latin(text)
    text = re.sub(r"[^a-z0-9]+", "", strip_marks(text).lower())
    for pattern, repl in FOLDS:
        text = re.sub(pattern, repl, text)
    return text


def _mapped(f) -> Callable[[Column], Column]:  # noqa: ANN001
    """A Column function by Arrow batches; made when used, as that needs a session."""
    return F.pandas_udf(lambda s: s.map(f), "string")


def folded(name: Column) -> Column:
    """F-01 for any script: plain Latin letters are folded in the JVM, only the other names go to Python."""
    plain = name.isNull() | ~name.rlike(r"[^\x00-\x7F]")
    return F.when(plain, folded_latin(name)).otherwise(_mapped(lambda x: None if x is None else fold(x))(F.when(~plain, name)))


def without_marks(name: Column) -> Column:
    """F-04 as a Column."""
    return _mapped(lambda x: None if x is None else strip_marks(x))(name)


def transliterated(name: Column) -> Column:
    """F-02 as a Column."""
    return _mapped(lambda x: None if x is None else devanagari_to_latin(x))(name)


def folded_latin(name: Column) -> Column:
    """F-01 for names in plain Latin letters, in the JVM."""
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")
    for pattern, repl in FOLDS:
        out = F.regexp_replace(out, pattern, repl.replace("\\1", "$1"))
    return out


def has_devanagari(name: Column) -> Column:
    """F-05."""
    return name.rlike("[\\u0900-\\u097F]")


def trigrams(name: Column) -> Column:
    """F-06: distinct trigrams of a folded (one-word) name: two blanks before it and one after."""
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    got = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(name) > 0, F.array_distinct(got)).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """F-06: shared trigrams over all trigrams."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def first_number(text: Column) -> Column:
    """F-07."""
    return F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")


def titled(name: Column) -> Column:
    """F-09: without marks, each word's first letter large; only names with marks go to Python."""
    plain = name.isNull() | ~name.rlike(r"[^\x00-\x7F]")
    return F.initcap(F.trim(F.when(plain, name).otherwise(without_marks(F.when(~plain, name)))))


def display_hierarchy(parts: Column) -> Column:
    """F-08: title-cased parts, without blanks and repeats of the one before, joined by commas."""
    clean = F.filter(F.transform(parts, lambda p: F.initcap(F.trim(p))), lambda p: p.isNotNull() & (p != ""))
    kept = F.filter(clean, lambda p, i: (i == 0) | (p != F.try_element_at(clean, i)))
    return F.array_join(kept, ", ")


def rupees(amount: Column) -> Column:
    """F-10: Indian digit groups, ₹12,34,567."""
    digits = F.format_string("%.0f", F.abs(amount).cast("double"))
    # groups of two before the last three
    grouped = F.when(F.length(digits) > 3, F.concat(F.regexp_replace(digits.substr(F.lit(1), F.length(digits) - 3), r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","), F.right(digits, F.lit(3)))).otherwise(digits)
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), grouped)


def census_code(shrid: Column) -> Column:
    """F-11: the last part."""
    return F.element_at(F.split(shrid, "-"), -1)


def unquoted(text: Column) -> Column:
    """F-12: without blanks and quotes at either end."""
    return F.trim(F.regexp_replace(F.trim(text), '^"+|"+$', ""))


def squashed(text: Column) -> Column:
    """F-13: letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")

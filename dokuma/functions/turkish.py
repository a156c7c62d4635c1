"""Turkish letters, case and suffix phonology: column expressions, and plain functions for use inside UDFs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet, its vowels and consonant classes, and the suffix inventory in its order.
UPPER = "ABCDEFGHIİJKLMNOPQRSTUVWXYZÇĞÖŞÜ"
LOWER = "abcdefghıijklmnopqrstuvwxyzçğöşü"
LETTERS = "[A-Za-zıİçÇöÖüÜğĞşŞ]"
VOWELS = "aeıioöuü"
BACK = "aıou"
ROUNDED = "oöuü"
VOICELESS = "fstkçşhp"
SOFTENS = {"p": "b", "ç": "c", "t": "d", "k": "ğ"}
NOUN, DERIVED, VERB = "noun", "derivational", "verb"


@dataclass(frozen=True)
class Suffix:
    template: str
    gloss: str
    buffer: str
    softening: bool
    drop_vowel: bool
    kind: str
    slot: int


SUFFIXES = (
    Suffix("lAr", "cogul", "", False, False, NOUN, 1),
    Suffix("Im", "iyelik-1tekil", "", True, True, NOUN, 2),
    Suffix("In", "iyelik-2tekil", "", True, True, NOUN, 2),
    Suffix("I", "iyelik-3tekil", "s", True, False, NOUN, 2),
    Suffix("ImIz", "iyelik-1cogul", "", True, True, NOUN, 2),
    Suffix("InIz", "iyelik-2cogul", "", True, True, NOUN, 2),
    Suffix("lArI", "iyelik-3cogul", "", False, False, NOUN, 2),
    Suffix("I", "belirtme-hali(akuzatif)", "y", True, False, NOUN, 3),
    Suffix("A", "yonelme-hali(datif)", "y", True, False, NOUN, 3),
    Suffix("DA", "bulunma-hali(lokatif)", "", False, False, NOUN, 3),
    Suffix("DAn", "ayrilma-hali(ablatif)", "", False, False, NOUN, 3),
    Suffix("In", "tamlayan-hali(genitif)", "n", True, False, NOUN, 3),
    Suffix("lIk", "isimlestirme(-lık)", "", False, False, DERIVED, 0),
    Suffix("sIz", "yoksunluk(-sız)", "", False, False, DERIVED, 0),
    Suffix("lI", "sahiplik(-lı)", "", False, False, DERIVED, 0),
    Suffix("CI", "meslek/ugras(-cı)", "", False, False, DERIVED, 0),
    Suffix("lAr", "cogul-3sahis(fiil)", "", False, False, VERB, 0),
    Suffix("mAk", "mastar(infinitif)", "", False, False, VERB, 0),
    Suffix("mA", "olumsuzluk", "", False, False, VERB, 0),
    Suffix("Iyor", "simdiki-zaman", "", True, True, VERB, 0),
    Suffix("DI", "digecmis-zaman", "", False, False, VERB, 0),
    Suffix("Abil", "yeterlilik(-ebil)", "y", True, False, VERB, 0),
)

HARDENS = {soft: hard for hard, soft in SOFTENS.items()}
_TO_LOWER = str.maketrans(UPPER, LOWER)
_VOWEL = re.compile(f"[{VOWELS}]")


def lower(text: str) -> str:
    return text.translate(_TO_LOWER)


def lower_col(text: Column) -> Column:
    """Turkish lower case; letters outside the alphabet stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of Turkish letters."""
    return F.regexp_extract_all(text, F.lit(f"({LETTERS}+)"), F.lit(1))


def has_letter(text: Column) -> Column:
    return text.rlike(LETTERS)


def harmony(stem: str) -> tuple[str, str]:
    """The vowels that A and I stand for after a stem: by its last vowel; without any, a and i."""
    found = _VOWEL.findall(lower(stem))
    if not found:
        return "a", "i"
    back, rounded = found[-1] in BACK, found[-1] in ROUNDED
    return "a" if back else "e", ("u" if rounded else "ı") if back else ("ü" if rounded else "i")


def resolve(stem: str, suffix: Suffix) -> tuple[str, str]:
    """Stem and surface of the suffix as they appear together: ("kitap", -I) gives ("kitab", "ı")."""
    a, i = harmony(stem)
    last = lower(stem[-1:])
    after_vowel = last in VOWELS and last != ""
    hard = last in VOICELESS and last != ""
    template = suffix.template
    lead = ""
    if template[0] in "AI":
        if after_vowel:
            template, lead = (template[1:], "") if suffix.drop_vowel else (template, suffix.buffer)
        elif suffix.softening and last in SOFTENS:
            stem = stem[:-1] + SOFTENS[last]
    surface = template.translate({65: a, 73: i, 68: "t" if hard else "d", 67: "ç" if hard else "c"})
    return stem, lead + surface


def attach(stem: str, suffix: Suffix) -> str:
    return "".join(resolve(stem, suffix))


def resolve_col(stem: Column, template: Column, buffer: Column, softening: Column, drop_vowel: Column) -> Column:
    """The inflected word as one column expression; stems in lower case."""
    vowel = F.regexp_extract(stem, f".*([{VOWELS}])", 1)
    last = F.right(stem, F.lit(1))
    after_vowel, hard = last.rlike(f"[{VOWELS}]"), last.rlike(f"[{VOICELESS}]")
    a = F.when((vowel == "") | vowel.rlike(f"[{BACK}]"), "a").otherwise("e")
    i = F.when(vowel == "", "i").when(vowel.isin("a", "ı"), "ı").when(vowel.isin("o", "u"), "u").when(vowel.isin("ö", "ü"), "ü").otherwise("i")
    opens = template.rlike("^[AI]")
    body = F.when(opens & after_vowel & drop_vowel, F.substring(template, 2, 99)).when(opens & after_vowel, F.concat(buffer, template)).otherwise(template)
    soft = F.when(opens & ~after_vowel & softening, F.concat(stem.substr(F.lit(1), F.length(stem) - 1), F.translate(last, "pçtk", "bcdğ"))).otherwise(stem)
    body = F.replace(F.replace(body, F.lit("A"), a), F.lit("I"), i)
    body = F.replace(F.replace(body, F.lit("D"), F.when(hard, "t").otherwise("d")), F.lit("C"), F.when(hard, "ç").otherwise("c"))
    return F.concat(soft, body)


def bare_verb(word: Column) -> Column:
    """The root of an infinitive (-mek, -mak) of four bytes or more, else null."""
    return F.when(word.rlike("m[ae]k$") & (F.octet_length(word) >= 4), word.substr(F.lit(1), F.length(word) - 3))

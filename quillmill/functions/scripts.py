"""Letters of other scripts in Latin letters, by ranges of code points; no Python workers.

A range is an array that is read at the place of the letter; Hangul syllables are taken apart by
arithmetic. Each letter is spelt alone, whatever stands beside it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import patterns as P
from quillmill.functions.binding import bind

# Letters and their spelling (fixed values), small letters; capitals follow from them.
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l",
    "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph",
    "χ": "kh", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh",
    "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
    "ѐ": "ie", "ё": "io", "ђ": "dj", "ѓ": "gj", "є": "ie", "ѕ": "dz", "і": "i", "ї": "yi", "ј": "j", "љ": "lj",
    "њ": "nj", "ћ": "tsh", "ќ": "kj", "ѝ": "i", "ў": "u", "џ": "dzh", "ґ": "g",
}
# The rows of the kana table, each in its five vowels (fixed values).
KANA = [
    ("あいうえお", "a i u e o"), ("かきくけこ", "ka ki ku ke ko"), ("がぎぐげご", "ga gi gu ge go"),
    ("さしすせそ", "sa shi su se so"), ("ざじずぜぞ", "za zi zu ze zo"), ("たちつてと", "ta chi tsu te to"),
    ("だぢづでど", "da di du de do"), ("なにぬねの", "na ni nu ne no"), ("はひふへほ", "ha hi hu he ho"),
    ("ばびぶべぼ", "ba bi bu be bo"), ("ぱぴぷぺぽ", "pa pi pu pe po"), ("まみむめも", "ma mi mu me mo"),
    ("やゆよ", "ya yu yo"), ("らりるれろ", "ra ri ru re ro"), ("わゐゑをん", "wa wi we wo n"),
    ("ぁぃぅぇぉ", "a i u e o"), ("ゃゅょっゎ", "ya yu yo tsu wa"), ("ゔ", "vu"),
]
# katakana stand this far behind hiragana
KATAKANA = 0x60
# The parts of a Hangul syllable in the order of its code (fixed values).
INITIALS = ["g", "gg", "n", "d", "dd", "r", "m", "b", "bb", "s", "ss", "", "j", "jj", "c", "k", "t", "p", "h"]
VOWELS = [
    "a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "weo", "we", "wi", "yu", "eu",
    "yi", "i",
]
FINALS = [
    "", "g", "gg", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss",
    "ng", "j", "c", "k", "t", "p", "h",
]
HANGUL, HANGUL_END = 0xAC00, 0xD7A3
# ranges of code points that are spelt by table: Greek, Cyrillic, accented Greek, kana
RANGES = [(0x370, 0x3FF), (0x400, 0x4FF), (0x1F00, 0x1FFF), (0x3041, 0x30FA)]
OTHER_SCRIPT = r"[Ͱ-ӿἀ-῿ぁ-ヺ가-힣]"


def spellings() -> dict[str, str]:
    """Letter to spelling: the lists above, their capitals, katakana, and letters with marks as those without."""
    known = dict(GREEK) | CYRILLIC
    known |= {small.upper(): spelt.capitalize() for small, spelt in known.items() if small.upper() not in known}
    for letters, spelt in KANA:
        for letter, name in zip(letters, spelt.split(" "), strict=True):
            known[letter] = known[chr(ord(letter) + KATAKANA)] = name
    for first, last in RANGES:
        for letter in map(chr, range(first, last + 1)):
            plain = unicodedata.normalize("NFD", letter)[0]
            if letter not in known and plain in known:
                known[letter] = known[plain]
    return known


def range_table(first: int, last: int) -> list[str]:
    """The spelling of each code point of a range; a letter without one stands for itself."""
    known = spellings()
    return [known.get(chr(code), chr(code)) for code in range(first, last + 1)]


def _letter(letter: Column) -> Column:
    def spelt(code: Column) -> Column:
        at = code - HANGUL
        syllable = F.concat(
            F.get(_listed(INITIALS), F.floor(at / (len(VOWELS) * len(FINALS))).cast("int")),
            F.get(_listed(VOWELS), F.floor(at / len(FINALS)).cast("int") % len(VOWELS)),
            F.get(_listed(FINALS), at % len(FINALS)),
        )
        result = F.when(code < RANGES[0][0], letter).when(code.between(HANGUL, HANGUL_END), syllable)
        for first, last in RANGES:
            result = result.when(code.between(first, last), F.get(_listed(range_table(first, last)), code - first))
        return result.otherwise(letter)

    return bind(F.ascii(letter), spelt)


def _listed(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def spell_in_latin(text: Column | str, null_token: str | None = P.NULL_TOKEN) -> Column:
    """Greek, Cyrillic, kana and Hangul in Latin letters, letter by letter; all else stays.

    Capitals are spelt with a capital first letter. Texts without such letters pass untouched. A
    missing text reads as ``null_token``; with None it stays missing.
    """
    column = F.col(text) if isinstance(text, str) else text
    column = column if null_token is None else F.coalesce(column, F.lit(null_token))

    singles = {letter: spelt for letter, spelt in spellings().items() if len(spelt) == 1}

    def taken_apart(text: Column) -> Column:
        parts = F.split(text, f"(?={OTHER_SCRIPT})|(?<={OTHER_SCRIPT})")
        spelt = F.transform(parts, lambda part: F.when(part.rlike(f"^{OTHER_SCRIPT}"), _letter(part)).otherwise(part))
        return F.when(text.rlike(OTHER_SCRIPT), F.array_join(spelt, "")).otherwise(text)

    def spelt(text: Column) -> Column:
        # letters that are one Latin letter go in one pass, only the others are taken apart
        shortened = F.translate(text, "".join(singles), "".join(singles.values()))
        return F.when(text.rlike(OTHER_SCRIPT), bind(shortened, taken_apart)).otherwise(text)

    return bind(column, spelt)

"""Letters of other scripts as ASCII: a table for each block of code points, rules where a script has them.

Indic blocks repeat the order of Devanagari every 128 code points, Katakana that of Hiragana after 96, and Hangul syllables are
composed of an initial, a vowel and a final. A letter or vowel sign that no table has becomes ``u`` and its code point, a word of its own, so that what can't be
spelled is at least told apart. Punctuation and symbols stay as they are.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings in the order of code points, "-" for a letter that has none.
GREEK = "a b g d e z e th i k l m n x o p r s s t u ph kh ps o"  # from U+03B1
CYRILLIC = "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia ie io dj gj ie dz i yi j lj nj tsh kj i u dzh"  # from U+0430
HEBREW = "a b g d h v z h t y k k l m m n n s a p p ts ts q r sh t"  # from U+05D0
ARABIC = "- a a w i y a b h t th j h kh d dh r z s sh s d t z a gh k k y y y - f q k l m n h w a y"  # from U+0621
PERSIAN = {"پ": "p", "چ": "ch", "ژ": "zh", "ک": "k", "گ": "g", "ی": "y", "ґ": "g"}
DEVANAGARI = (
    "n n n h a a aa i ii u uu r l e e e ai o o o au k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n nnn p ph b bh m y r rr l ll lll v sh ss s h - - - - "
    "aa i ii u uu r rr e e e ai o o o au - e aw om - - - - - q khh ghh z dddh rh f yy rr ll l ll - - 0 1 2 3 4 5 6 7 8 9 - - a a a oo aw u u j zh y g j dd b"
)  # from U+0900
HIRAGANA = (
    "a a i i u u e e o o ka ga ki gi ku gu ke ge ko go sa za shi ji su zu se ze so zo ta da chi ji tsu tsu zu te de to do na ni nu ne no "
    "ha ba pa hi bi pi fu bu pu he be pe ho bo po ma mi mu me mo ya ya yu yu yo yo ra ri ru re ro wa wa wi we wo n vu ka ke"
)  # from U+3041
INITIALS = "g kk n d tt r m b pp s ss - j jj c k t p h"
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i"
FINALS = "- g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h"
# Latin letters whose plain form has two letters, or no mark to drop.
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "đ": "d", "ł": "l", "ð": "d", "ı": "i"}


def _folds() -> tuple[str, str]:
    """Letters with marks and compatibility forms, and the one letter that is left of each, for one translate."""
    marked, plain = [], []
    for block in (range(0xC0, 0x250), range(0x386, 0x3CF), range(0x1E00, 0x2000), range(0xFF10, 0xFF5B)):
        for c in map(chr, block):
            base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
            if len(base) == 1 and base != c and base.isalnum():
                marked.append(c)
                plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _folds()


def _table(words: str) -> Column:
    return F.array(*[F.lit(w.replace("-", "")) for w in words.split()])


def _letter(ch: Column) -> Column:
    code = F.ascii(ch)  # of any code point
    block = lambda first, words: (code.between(first, first + len(words.split()) - 1), F.get(_table(words), code - first))
    syllable = code - 0xAC00
    hangul = F.concat(F.get(_table(INITIALS), F.floor(syllable / 588).cast("int")), F.get(_table(VOWELS), F.floor(syllable % 588 / 28).cast("int")), F.get(_table(FINALS), syllable % 28))
    indic = F.get(_table(DEVANAGARI), (code - 0x900) % 128)
    spelled = F.when(code < 128, ch)
    for found, form in (
        block(0x3B1, GREEK), block(0x430, CYRILLIC), block(0x5D0, HEBREW), block(0x621, ARABIC), (code.between(0x900, 0xD7F), indic),
        block(0x3041, HIRAGANA), (code.between(0x30A1, 0x30F6), F.get(_table(HIRAGANA), code - 0x30A1)), (code.between(0xAC00, 0xD7A3), hangul),
    ):
        spelled = spelled.when(found & form.isNotNull(), form)
    for one, form in PERSIAN.items():
        spelled = spelled.when(ch == one, F.lit(form))
    spelled = spelled.when(code.between(0x300, 0x36F), F.lit(""))  # marks on letters that have been folded
    return spelled.when(ch.rlike(r"^[\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]"), ch).otherwise(F.concat(F.lit(" u"), F.lower(F.hex(code)), F.lit(" ")))


def ascii_letters(c: Column) -> Column:
    """c in lower case, with all letters and digits in ASCII. Only texts with letters beyond Latin are taken apart."""
    x = F.translate(F.lower(c), _MARKED, _PLAIN)
    for a, b in LATIN.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(x, ""), _letter), "")).otherwise(x)

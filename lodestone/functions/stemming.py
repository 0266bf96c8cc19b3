"""English stems (the Porter2 algorithm) and stop words, for the text index.

A word is cut in stages; each looks for its longest ending and asks whether the ending lies in region 1 (behind the first
non-vowel that follows a vowel) or region 2 (region 1 of region 1), or what stands before it. Words with digits have no stem
of their own. ``lexemes`` works on arrays of words in Arrow batches: the distinct words of a batch alone become Python's strings, ``PIECE``
of them at a time, and a worker remembers as many of the words with stems that it has met last, whatever the rows and words of its batches.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The stop words of English text search.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words with a stem of their own, words that stay, words that the first stage settles, beginnings that end region 1's search.
OWN = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl".split())
STAY = frozenset("sky news howe atlas cosmos bias andes".split())
SETTLED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
BEGINNINGS = ("gener", "commun", "arsen")
#: Endings of the second and third stage with what takes their place, endings of the fourth, letters before -li, doubled letters.
SECOND = dict(
    x.split(":") for x in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful "
    "ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:".split()
)
THIRD = dict(x.split(":") for x in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
BEFORE_LI, DOUBLED = "cdeghkmnrt", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VOWELS = frozenset("aeiouy")
#: Words that are Python's strings at a time, and words that a worker remembers.
PIECE = 1 << 12


def _behind(word: str, start: int) -> int:
    """The place behind the first non-vowel that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def regions(word: str) -> tuple[int, int]:
    first = next((len(b) for b in BEGINNINGS if word.startswith(b)), None) or _behind(word, 0)
    return first, _behind(word, first)


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _short_syllable(part: str) -> bool:
    """Whether it ends in one: vowel and non-vowel at the start, or non-vowel, vowel, non-vowel other than w, x and a consonant y."""
    if len(part) == 2:
        return part[0] in VOWELS and part[1] not in VOWELS
    return len(part) > 2 and part[-3] not in VOWELS and part[-2] in VOWELS and part[-1] not in VOWELS and part[-1] not in "wxY"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e is None:
        return w
    part = w[: -len(e)]
    if e.startswith("eed"):
        return part + "ee" if len(part) >= r1 else w
    if not _has_vowel(part):
        return w
    if part.endswith(("at", "bl", "iz")) or (_short_syllable(part) and len(part) <= r1):
        return part + "e"
    return part[:-1] if part.endswith(DOUBLED) else part


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()) or word in STAY:
        return word
    return _stem(word)


@functools.lru_cache(maxsize=PIECE)
def _stem(word: str) -> str:
    if word in OWN:
        return OWN[word]
    w = re.sub("^y|([aeiouy])y", lambda m: (m[1] or "") + "Y", word)
    r1, r2 = regions(w)
    w = _plural(w)
    if w in SETTLED:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    if (e := _ending(w, SECOND)) is not None and len(w) - len(e) >= r1:
        before = w[: -len(e)][-1:]
        if (e != "ogi" or before == "l") and (e != "li" or before in BEFORE_LI):
            w = w[: -len(e)] + SECOND[e]
    if (e := _ending(w, THIRD)) is not None and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + THIRD[e]
    if (e := _ending(w, FOURTH)) is not None and len(w) - len(e) >= r2 and (e != "ion" or w[: -len(e)][-1:] in ("s", "t")):
        w = w[: -len(e)]
    if (w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])))) or (w.endswith("ll") and len(w) - 1 >= r2):
        w = w[:-1]
    return w.replace("Y", "y")


def lexeme(word: str) -> str | None:
    """What the index of English text holds for a word; nothing for a stop word."""
    return None if word in STOP_WORDS else stem(word)


def stems_of(words: pa.ListArray) -> pa.ListArray:
    """The stems of arrays of words: each distinct word of the batch is cut once, a piece of them after the other."""
    starts = words.offsets
    flat = words.values.slice(starts[0].as_py(), starts[-1].as_py() - starts[0].as_py()).dictionary_encode()
    pa.default_memory_pool().release_unused()  # what the encoding and the batch before took goes back ahead of the long part
    held = pa.lib.StringBuilder()  # pa.array would load pandas into each worker
    for at in range(0, len(flat.dictionary), PIECE):
        held.append_values([None if w is None else lexeme(w) for w in flat.dictionary.slice(at, PIECE).to_pylist()])
    stems = held.finish()
    ends = pc.subtract(starts, starts[0])
    return pa.ListArray.from_arrays(ends, stems.take(flat.indices), mask=words.is_null())


@F.arrow_udf(ArrayType(StringType()))
def _lexemes(words: pa.Array) -> pa.Array:
    return stems_of(words)


def lexemes(words: Column) -> Column:
    """Stems of an array of words, in order; a stop word keeps its place as null."""
    return _lexemes(words)

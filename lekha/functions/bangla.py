"""Column functions for Bengali text: detection, normalisation, reordering, transcoding.

All are built-in expressions on string columns; null gives null. They work per row, in batch and in
streams alike. Chains are long, so give their results an alias.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekha.functions import scan
from lekha.functions import script as S

_B, _C, _P, _H, _R, _G = S.BANGLA, S.CONSONANTS, S.PRE_KAR, S.HALANT, S.RA, S.GUARD

#: Replacements of `normalize`, in order.
STEPS = (("\u09af\u09bc", "\u09df"), (S.ZWJ, S.ZWNJ), ("\u09cb", "\u09c7\u09be"), ("\u09cc", "\u09c7\u09d7"))

# Patterns for Java's matcher, and the same in plain form for readers without look-around (PLAIN). Loops
# are possessive, so texts of any length need no stack, and a cluster is tried from its begin alone, so
# they need time in proportion.

#: A consonant cluster after ra and halant, and a pre-base sign on its consonant.
REPH = f"([^{_H}\n]){_R}{_H}(?:((?:[{_C}]{_H})*+[^{_C}\n])|((?:[{_C}]{_H}(?=[{_C}]))*+[{_C}])([{_P}]?))"
#: Pre-base vowel signs after what they move in front of: the first goes before all consonants tied to
#: each other by halants, or before one character; each further one before the last character of these.
#: A character that is no guard and no line feed is written as any character that none stands before its end, and
#: whether a sign or a halant comes next is asked first: both are told much faster than by a class of all others.
_ANY = f"(?d:.)(?<!{_G})"
_WHOLE = f"({_ANY}{_H}(?<![^{_G}\n{_P}]{_H}[{_C}]{_H})(?:[{_C}]{_H})*+)([{_C}])"
CLUSTER = f"(?=(?s:.)[{_P}{_H}])(?:{_WHOLE}|({_ANY}))([{_P}])([{_P}]*+)"
#: Inputs that a strict reader of one line rejects: a sign or halant with nothing before it, ra and
#: halant at the start, and a reph whose cluster ends the line. Looked for after normalisation.
ERRORS = (
    f"(?:^|\n)[{_P}]",
    f"(?:^|\n){_H}[^\n]",
    f"(?:^|\n){_R}{_H}[^\n]",
    f"[^{_H}\n]{_R}{_H}(?=[{_C}])(?:[{_C}]{_H})*+[{_C}]?+(?:\n|\\z)",
)
PLAIN = {
    REPH: f"([^{_H}\n]){_R}{_H}(?:((?:[{_C}]{_H})*[^{_C}\n])|((?:[{_C}]{_H})*[{_C}])([{_P}]?))",
    CLUSTER: f"(?:([^{_G}\n]{_H}(?:[{_C}]{_H})*)([{_C}])|([^{_G}\n]))([{_P}])([{_P}]*)",
    ERRORS[3]: f"[^{_H}\n]{_R}{_H}(?:(?:[{_C}]{_H})*[{_C}]|(?:[{_C}]{_H})+)(?:\n|\\z)",
}


def let(value: Column, body) -> Column:
    """body(value), the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def is_bangla(text: Column) -> Column:
    """Some character is of the Bengali block; dandas and joiners are not."""
    return text.rlike(f"[{_B}]")


def normalize(text: Column) -> Column:
    """YYA composed, joiners made one kind, and two-part vowel signs split, in that order."""
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), STEPS, text)


def reorder_reph(text: Column) -> Column:
    """Ra and halant go behind the cluster they stand before, a pre-base sign in front of it; guards stay around."""
    return F.regexp_replace(text, REPH, f"$1{_G}$4$2$3{_R}{_H}{_G}")


def reorder_pre_kar(text: Column) -> Column:
    """Pre-base vowel signs go before their cluster; none crosses a guard."""
    return F.regexp_replace(text, CLUSTER, "$4$1$5$2$3")


def reorder(text: Column) -> Column:
    """Both reorderings of normalised text, as one scan from left to right does them; orders that no spelling has are folded (lekha.functions.scan)."""
    out = reorder_pre_kar(reorder_reph(scan.guarded(text)))
    return F.translate(out, "".join(scan.SAFE.values()) + _G, "".join(scan.SAFE))


#: Stretches that a sequence can match in: every sequence has a halant or one of three vowel signs, and
#: no two consonants of a sequence touch. First is told, fast, whether such a sign is this character or the next.
_JOINED = f"(?=(?s:.)[{S.ZWNJ}{_H}\u09c1-\u09c3]|[{S.ZWNJ}{_H}])(?:[{_C}\u09dc\u09dd]?(?:{S.ZWNJ}?{_H}[{_C}\u09dc\u09dd]?)++[\u09c1-\u09c3]?|[{_C}\u09dc\u09dd][\u09c1-\u09c3])"


def _alphabets() -> tuple[dict[str, str], dict[str, str]]:
    """Characters of the sequences as single bytes, and those of their values as characters for private use."""
    keys = sorted({c for k, _ in S.live_sequences() for c in k})
    values = sorted({c for _, v in S.live_sequences() for c in v})
    return dict(zip(keys, string.ascii_letters, strict=False)), {c: chr(0xE000 + i) for i, c in enumerate(values)}


def transcode(text: Column) -> Column:
    """Characters to the legacy glyph encoding: marks first, then sequences in their order, then single characters.

    Only the stretches that sequences can match in go through the chain of sequences, all of a text as
    one string of lines. There the chain reads single bytes for their characters and writes characters for
    private use, so it passes over few bytes and finds keys by their first.
    """
    narrow, private = _alphabets()
    letters = S.letters()
    one = {k: v for k, v in letters.items() if len(v) == 1}
    final = one | {b: one.get(c, c) for c, b in narrow.items()} | {b: c for c, b in private.items()}
    marks = F.translate(text, "".join(S.MARKS), "".join(S.MARKS.values()))  # some sequences give these marks anew
    put = lambda x, steps: F.translate(x, "".join(steps), "".join(steps.values()))

    def chained(x: Column) -> Column:
        steps = [["".join(m[c] for c in part) for m, part in zip((narrow, private), s)] for s in S.live_sequences()]
        return put(reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, put(x, narrow)), final)

    def of(parts: Column) -> Column:
        """Every second part is such a stretch."""
        lines = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).otherwise(F.lit(""))), "\n")
        return let(F.split(chained(lines), "\n", -1), lambda fixed: F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, fixed[i]).otherwise(x)), ""))

    out = let(F.split(F.regexp_replace(marks, _JOINED, f"{_G}$0{_G}"), _G, -1), of)
    for key, value in letters.items():
        if len(value) > 1:
            out = F.replace(out, F.lit(key), F.lit(value))
    return put(out, one)


def strip_invisible(text: Column) -> Column:
    """Without line feeds and non-joiners."""
    return F.translate(text, f"\n{S.ZWNJ}", "")


def has_error_input(text: Column) -> Column:
    """A strict reader would reject the text (see ERRORS)."""
    return let(normalize(text), lambda t: reduce(lambda a, b: a | b, [t.rlike(e) for e in ERRORS]))


#: What a strict reader's error is called by where it stands: at a line's begin, or a reph whose cluster ends the line.
ERROR_KINDS = ("sign at begin", "halant at begin", "reph at begin", "reph at end")
_END = f"[^{_H}]({_R}{_H}(?=[{_C}])(?:[{_C}]{_H})*+[{_C}]?+)\\z"
PLAIN[_END] = f"[^{_H}]({_R}{_H}(?:(?:[{_C}]{_H})*[{_C}]|(?:[{_C}]{_H})+))\\z"


def error_places(text: Column) -> Column:
    """array<struct<line, kind, at>>: what a strict reader rejects, line by line, and at which character of the normalised line it stands.

    Lines and characters count from 0. A line has at most one error at its begin and one at its end; texts
    without any, and empty texts, have none, null gives null.
    """

    def of(line: Column, n: Column) -> Column:
        begin = F.when(line.rlike(f"^[{_P}]"), ERROR_KINDS[0]).when(line.rlike(f"^{_H}(?s:.)"), ERROR_KINDS[1]).when(line.rlike(f"^{_R}{_H}(?s:.)"), ERROR_KINDS[2])
        reph = F.length(F.regexp_extract(line, _END, 1))
        place = lambda kind, at: F.struct(n.cast("int").alias("line"), kind.alias("kind"), at.cast("int").alias("at"))
        return F.array(F.when(begin.isNotNull(), place(begin, F.lit(0))), F.when(reph > 0, place(F.lit(ERROR_KINDS[3]), F.length(line) - reph)))

    return F.filter(F.flatten(F.transform(F.split(normalize(text), "\n", -1), of)), lambda x: x.isNotNull())


#: Characters of two UTF-16 units.
WIDE = "[\\x{10000}-\\x{10FFFF}]"


def utf16_length(text: Column) -> Column:
    """UTF-16 units of the text, in which some readers count; functions here count characters."""
    return F.length(text) + F.regexp_count(text, F.lit(WIDE))


def splits_pair(text: Column) -> Column:
    """A reader of UTF-16 units would move a sign into the surrogate pair before it, which leaves no valid text; here it goes before the whole character."""
    return normalize(text).rlike(f"{WIDE}[{_P}]")


def encode(text: Column, strict: bool = False) -> Column:
    """The text in the legacy encoding, whatever its script.

    A neighbour that is not there counts as no match; `strict` gives null for texts with such inputs.
    """
    out = strip_invisible(transcode(reorder(normalize(text))))
    return F.when(~has_error_input(text), out) if strict else out


def encode_lines(text: Column) -> Column:
    """`encode` of each line by itself; the line feeds stay."""
    return F.translate(transcode(reorder(normalize(text))), S.ZWNJ, "")


def fix(text: Column, strict: bool = False) -> Column:
    """`encode` for texts with Bengali characters, others as they are."""
    return let(text, lambda t: F.when(is_bangla(t), encode(t, strict)).otherwise(t))


def from_latin(text: Column) -> Column:
    """Bengali-looking text from lower-case ASCII words, the same for everyone, for trying the functions on any table.

    Each word of a-z between single spaces becomes KA, its letters mapped one by one, KA and a space.
    """
    words = F.filter(F.split(text, " "), lambda w: w.rlike("^[a-z]+$"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(KA), F.translate(w, LATIN, LIKE), F.lit(KA + " "))), "")


KA = "\u0995"
LATIN = "abcdefghijklmnopqrstuvwxyz"
LIKE = "\u09be\u09ac\u099a\u09a6\u09c7\u09ab\u0997\u09b9\u09bf\u099c\u0995\u09b2\u09ae\u09a8\u09cb\u09aa\u0996\u09b0\u09b8\u09cd\u09c1\u09ad\u0993\u09b7\u09df\u09af"

"""Reordering of characters in orders that no spelling has, by a fold from left to right.

The patterns of lekha.functions.bangla reorder what people write. A sign under a halant, several signs in a
row, a reph before another or before a vowel, and other such orders depend on what has been moved before. Only
the stretches that hold one (DEGENERATE) are folded. A stretch begins where nothing before can matter: before
any character but a sign or a halant, unless a halant or a coming reph ties it to the one before.

The fold keeps what it has written and where the last cluster in it can begin. A sign goes before that
cluster. A reph waits for the cluster after it, and is written behind that. What was moved lately bounds the
next cluster, up to one character before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekha.functions import script as S

_C, _P, _H, _R = S.CONSONANTS, S.PRE_KAR, S.HALANT, S.RA

#: A stretch; the possessive form is for Java's matcher.
STRETCH = f"(?:{_H}[^{_H}]?|[^{_H}])(?:[{_P}]|{_H}[^{_H}]?|{_R}{_H}[^{_H}]?)*"
DEGENERATE = "|".join([
    f"{_R}[{_P}]+{_H}",  # a sign between ra and halant
    f"{_R}{_H}(?:[{_C}]{_H})*(?:[^{_C}]|$|[{_C}](?:[{_P}]?{_R}{_H}|[{_P}]{{2}}|[{_P}]{_H}))",  # a reph before no consonant, another reph or more than one sign
    f"[{_P}]{_H}(?:[{_C}]{_H})*[{_C}][{_P}]",  # a sign inside a cluster that has another
    f"{_H}[{_P}]+{_R}{_H}",  # a halant that a sign moves up to a reph
])
#: A word: stretches up to a space.
WORD = f"(?:{_H}[^{_H}]?|[^{_H}])(?:{_H}[^{_H}]?|{_R}{_H}[^{_H}]?|[^{_H} ])*"
#: What the fold reads at once: ra and halant with the pairs after them, pairs of consonant and halant, one character.
TOKEN = f"{_R}{_H}(?:[{_C}]{_H})*|(?:[{_C}]{_H})+|(?s:.)"
#: The cluster that ends a string, in the string reversed.
LAST = f"^(?:[{_C}]{_H}(?=(?s:.)))*+(?s:.)"
#: Folded stretches hold these instead, so that no pattern finds anything in them.
SAFE = dict(zip((*_P, _H, _R), "﷑﷒﷓﷔﷕"))
#: After so many tokens what nothing can reach any more is put aside.
_ASIDE = 256


def _possessive(pattern: str) -> str:
    return pattern.replace(")*", ")*+").replace(")+|", ")++|")


def _state(out: Column, low: Column, held: Column, full: Column) -> Column:
    return F.struct(out.alias("out"), low.cast("int").alias("low"), held.cast("string").alias("held"), full.alias("full"))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _written(out: Column, low: Column) -> Column:
    """The state with this written and nothing held."""
    return _state(out, low, F.lit(None), F.lit(False))


def _released(s: Column, sign: Column) -> Column:
    """The held reph written behind its cluster, a sign in front."""
    out = F.concat(s["out"], sign, s["held"], F.lit(_R + _H))
    return _written(out, F.length(out) - 1)


def _plain(s: Column, t: Column) -> Column:
    """The next token, while nothing is held."""
    out, low = s["out"], s["low"]
    n = F.length(out)
    last, before, first = F.substr(out, n, F.lit(1)), F.substr(out, n - 1, F.lit(1)), F.substring(t, 1, 1)
    begin = (n == 0) | (last == "\n")
    ends_in_halant = ~begin & (last == _H)
    tied = ends_in_halant & first.rlike(f"[{_C}]")
    added = _written(F.concat(out, t), F.when(tied, low).otherwise(n))
    size = F.length(F.regexp_extract(F.reverse(F.substr(out, low + 1, n)), LAST, 0))
    moved = F.concat(F.substr(out, F.lit(1), n - size), t, F.substr(out, n - size + 1, size))
    after_ra = (n > 1) & (last == _R) & (before != "\n") & (before != _H)
    return (
        F.when(t.isin(*_P), F.when(begin, _written(F.concat(out, t), n)).otherwise(_written(moved, n)))
        .when(t.startswith(_R + _H), F.when(begin | ends_in_halant, added).otherwise(_state(out, low, F.substring(t, 3, 1 << 30), F.lit(False))))
        .when(t == _H, F.when(after_ra, _state(F.substr(out, F.lit(1), n - 1), low, F.lit(""), F.lit(False))).otherwise(_written(F.concat(out, t), F.when(ends_in_halant, n - 1).otherwise(F.least(low, n)))))
        .when(t == "\n", _written(F.concat(out, t), n + 1))
        .otherwise(added)
    )


def _settled(s: Column) -> Column:
    """What the end of a line makes of a held reph: without any character after it it stays, and a halant that ends its cluster is none of that."""
    cut = F.substr(s["held"], F.lit(1), F.length(s["held"]) - 1)
    kept = F.concat(s["out"], F.lit(_R + _H))
    half = F.concat(s["out"], cut, F.lit(_R + _H + _H))
    return (
        F.when(s["held"].isNull(), s)
        .when(s["full"], _released(s, F.lit("")))
        .when(s["held"] == "", _written(kept, F.length(kept)))
        .otherwise(_written(half, F.length(half)))
    )


def _step(s: Column, t: Column) -> Column:
    sign, pair = t.isin(*_P), (F.length(t) > 1) & t.endswith(_H)

    def more(s: Column) -> Column:
        """The token for a reph that still waits."""
        added = _state(s["out"], s["low"], F.concat(s["held"], t), t.rlike(f"^[{_C}]$"))
        return F.when(s["full"], _released(s, t)).otherwise(_let(added, lambda x: F.when(pair | x["full"], x).otherwise(_released(x, F.lit("")))))

    ready = F.when(s["held"].isNotNull() & (t == "\n"), _settled(s)).when(s["full"] & ~sign, _released(s, F.lit(""))).otherwise(s)
    return _let(ready, lambda x: F.when(x["held"].isNull(), _plain(x, t)).otherwise(more(x)))


def fold(stretch: Column) -> Column:
    """The stretch with signs before and rephs behind their clusters, whatever the order of its characters.

    Tokens are folded in blocks, since every step of a fold copies what it carries.
    """
    begin = _state(F.lit(""), F.lit(0), F.lit(None), F.lit(False))
    tokens = F.regexp_extract_all(stretch, F.lit(_possessive(TOKEN)), F.lit(0))

    def block(tokens: Column, all_: Column, k: Column) -> Column:
        def put(s: Column) -> Column:
            n = F.greatest(F.lit(0), s["low"] - 2)
            rest = _state(F.substr(s["out"], n + 1, F.length(s["out"])), s["low"] - n, s["held"], s["full"])
            return F.struct(F.concat(all_["aside"], F.array(F.substr(s["out"], F.lit(1), n))).alias("aside"), rest.alias("s"))

        return _let(F.aggregate(F.slice(tokens, k * _ASIDE + 1, F.lit(_ASIDE)), all_["s"], _step), put)

    def whole(tokens: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(tokens) / _ASIDE).cast("int"))
        start = F.struct(F.array().cast("array<string>").alias("aside"), begin.alias("s"))
        return F.aggregate(blocks, start, lambda all_, k: block(tokens, all_, k), lambda all_: F.concat(F.array_join(all_["aside"], ""), _settled(all_["s"])["out"]))

    return _let(tokens, whole)


def guarded(text: Column) -> Column:
    """The text with its degenerate stretches folded, and SAFE characters in them; other texts as they are.

    Words part before each space that no halant precedes, and no degenerate stretch crosses that. So one search
    marks the words' ends from their first degenerate stretch on, and what comes before it is the end of
    the part before; all other words are passed over. Texts that hold the mark itself go word by word.
    """
    odd = _possessive(DEGENERATE)
    all_of = lambda x, pattern: F.regexp_extract_all(x, F.lit(_possessive(pattern)), F.lit(0))
    stretch = lambda x: F.when(x.rlike(odd), F.translate(fold(x), "".join(SAFE), "".join(SAFE.values()))).otherwise(x)
    piece = lambda x, of_odd: F.struct(x.alias("x"), of_odd.alias("odd"))
    before = lambda x: F.regexp_extract(x, f"^(?s:.*)(?<!{_H})(?= )", 0)

    def pieces(parts: Column) -> Column:
        """Every second part is a marked one."""
        begun = lambda x: F.substr(x, F.length(before(x)) + 1, F.length(x))
        plain = lambda x, i: F.when(i < F.size(parts) - 1, before(x)).otherwise(x)
        return F.transform(parts, lambda x, i: piece(F.when(i % 2 == 1, F.concat(begun(parts[i - 1]), x)).otherwise(plain(x, i)), i % 2 == 1))

    def of(t: Column) -> Column:
        marked = F.regexp_replace(t, f"(?:{odd})(?:[^ ]|(?<={_H}) )*+", f"{S.GUARD}$0{S.GUARD}")
        singly = F.transform(all_of(t, WORD), lambda x: piece(x, x.rlike(odd)))
        found = F.when(F.contains(t, F.lit(S.GUARD)), singly).otherwise(_let(F.split(marked, S.GUARD, -1), pieces))
        return F.array_join(F.transform(found, lambda p: F.when(p["odd"], F.array_join(F.transform(all_of(p["x"], STRETCH), stretch), "")).otherwise(p["x"])), "")

    return _let(text, of)


# ---- the same in DuckDB's SQL


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_state(out: str, low: str, held: str = "NULL", full: str = "false") -> str:
    return f"struct_pack(o := {out}, w := {low}, h := CAST({held} AS VARCHAR), f := {full})"


def _sql_let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _sql_released(s: str, sign: str) -> str:
    return _sql_let(f"{s}.o || {sign} || {s}.h || {_q(_R + _H)}", "lp", _sql_state("lp", "length(lp) - 1"))


def _sql_settled(s: str) -> str:
    kept, half = f"{s}.o || {_q(_R + _H)}", f"{s}.o || {s}.h[:-2] || {_q(_R + _H + _H)}"
    return f"CASE WHEN {s}.h IS NULL THEN {s} WHEN {s}.f THEN {_sql_released(s, _q(''))} WHEN {s}.h = '' THEN {_sql_state(kept, f'length({kept})')} ELSE {_sql_state(half, f'length({half})')} END"


def _sql_plain(s: str, t: str) -> str:
    out, n = f"{s}.o", f"length({s}.o)"
    last, before = f"right({out}, 1)", f"left(right({out}, 2), 1)"
    begin = f"({n} = 0 OR {last} = chr(10))"
    halant = f"(NOT {begin} AND {last} = {_q(_H)})"
    added = _sql_state(f"{out} || {t}", f"CASE WHEN {halant} AND regexp_matches({t}, {_q(f'^[{_C}]')}) THEN {s}.w ELSE {n} END")
    size = f"length(regexp_extract(substring({out}, {s}.w + 1), {_q(f'(?s:.)(?:{_H}[{_C}])*' + chr(92) + 'z')}))"
    moved = _sql_let(size, "lz", _sql_state(f"left({out}, {n} - lz) || {t} || right({out}, lz)", n))
    after_ra = f"({n} > 1 AND {last} = {_q(_R)} AND {before} <> chr(10) AND {before} <> {_q(_H)})"
    return f"""CASE WHEN regexp_matches({t}, {_q(f'^[{_P}]')}) THEN CASE WHEN {begin} THEN {_sql_state(f'{out} || {t}', n)} ELSE {moved} END
WHEN starts_with({t}, {_q(_R + _H)}) THEN CASE WHEN {begin} OR {halant} THEN {added} ELSE {_sql_state(out, f'{s}.w', f'substring({t}, 3)')} END
WHEN {t} = {_q(_H)} THEN CASE WHEN {after_ra} THEN {_sql_state(f'left({out}, {n} - 1)', f'{s}.w', _q(''))} ELSE {_sql_state(f'{out} || {t}', f'CASE WHEN {halant} THEN {n} - 1 ELSE least({s}.w, {n}) END')} END
WHEN {t} = chr(10) THEN {_sql_state(f'{out} || {t}', f'{n} + 1')} ELSE {added} END"""


def fold_sql(x: str) -> str:
    """`fold` as one list_reduce over the tokens."""
    pair, c_only = "(length(lt.o) > 1 AND right(lt.o, 1) = " + _q(_H) + ")", f"regexp_full_match(lt.o, {_q(f'[{_C}]')})"
    more = _sql_let(_sql_state("lx.o", "lx.w", "lx.h || lt.o", c_only), "lm", f"CASE WHEN {pair} OR lm.f THEN lm ELSE {_sql_released('lm', _q(''))} END")
    sign = f"regexp_matches(lt.o, {_q(f'^[{_P}]')})"
    ready = f"CASE WHEN ls.h IS NOT NULL AND lt.o = chr(10) THEN {_sql_settled('ls')} WHEN ls.f AND NOT {sign} THEN {_sql_released('ls', _q(''))} ELSE ls END"
    step = _sql_let(ready, "lx", f"CASE WHEN lx.h IS NULL THEN {_sql_plain('lx', 'lt.o')} WHEN lx.f THEN {_sql_released('lx', 'lt.o')} ELSE {more} END")
    tokens = f"list_transform(regexp_extract_all({x}, {_q(TOKEN)}), lambda lk: {_sql_state('lk', '0')})"
    return _sql_let(f"list_reduce({tokens}, lambda ls, lt: {step}, {_sql_state(_q(''), '0')})", "le", _sql_let(_sql_settled("le"), "lg", "lg.o"))


def guarded_sql(x: str) -> str:
    """`guarded` for DuckDB."""
    safe = f"translate({fold_sql('lv')}, {_q(''.join(SAFE))}, {_q(''.join(SAFE.values()))})"
    parts = f"list_transform(regexp_extract_all({x}, {_q(STRETCH)}), lambda lv: CASE WHEN regexp_matches(lv, {_q(DEGENERATE)}) THEN {safe} ELSE lv END)"
    return f"CASE WHEN regexp_matches({x}, {_q(DEGENERATE)}) THEN array_to_string({parts}, '') ELSE {x} END"

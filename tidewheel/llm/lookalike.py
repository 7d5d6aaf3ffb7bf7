"""Visually identical text with different characters: brought to one consistent form.

Each letter has a resolved script set: the scripts Unicode gives it (extensions included) and those in which a letter looks
like it. A run whose letters share a script of their own is of that script; where they share none the scripts are mixed, and
of the scripts in the intersection of the resolved sets the consistent one is selected. A run wholly in another script than
the rest of the text, all of whose letters have a double there, is a whole-script confusable if it holds letters that no
language of its script uses, or if the corpus's own words make the other spelling likelier (:func:`word_shapes`); its length
plays no part. What remains
(width, decomposed letters, invisible characters, odd spaces, ligatures, hyphens) is normalised character by character.
Signs with a look of their own, pictographs and garbled sequences are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_distinct, text_of

# Letters of other alphabets and their Latin doubles.
CYRILLIC_AS_LATIN = dict(zip("аеорсухіјѕԁһԛԝӏѵАВЕКМНОРСТУХІЈЅԌԚԜӀҮѴ", "aeopcyxijsdhqwlvABEKMHOPCTYXIJSGQWIYV"))
GREEK_AS_LATIN = dict(zip("οανρυικγχτϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "oavpuikyxtcjABEZHIKMNOPTYXCJ"))
ARMENIAN_AS_LATIN = dict(zip("օոհսցզՕՍԼ", "onhugqOUL"))
RARE_CYRILLIC = frozenset("ѕјһԁԛԝӏѵЅЈԌԚԜҮѴ")
PHONETIC_AS_LATIN = dict(zip("ɑɡɩʏıȷ", "agiyij"))
#: Small capitals, by their names, as the letters that they are the capitals of.
PHONETIC_AS_LATIN |= {c: n[-1].lower() for c in map(chr, [*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), 0xA730, 0xA731]) if re.fullmatch("LATIN LETTER SMALL CAPITAL [A-Z]", n := unicodedata.name(c, ""))}
SMALL_AS_LATIN = dict(zip("кмнтвг", "kmhtBr"))
GREEK_AS_CYRILLIC = dict(zip("οαρκπυχτνφεΑΒΕΗΙΚΜΝΟΡΤΥΧΦΠΓ", "оаркпухтvфеАВЕНІКМNОРТУХФПГ"))

CHEROKEE_AS_LATIN = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏒᏔᏚᏙᏞᏟᏢᏦᏧᏳᎥᏂᏏ", "DRTAJEWMHYGZ4RWSVLCPKdGihb"))
COPTIC_AS_LATIN = dict(zip("ⲟⲞⲣⲢⲤⲥⲬⲭⲦⲔⲎⲘⲚⲂⲈⲒⲨⲌ", "oOpPCcXxTKHMNBEIYZ"))
LISU_AS_LATIN = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))

LATIN, CYRILLIC, GREEK, ARMENIAN = "Latin", "Cyrillic", "Greek", "Armenian"
#: Scripts that are told apart; letters of any other script share one set, "other".
SCRIPTS = (LATIN, CYRILLIC, GREEK, ARMENIAN, "Cherokee", "Coptic", "Lisu", "Georgian", "Hebrew", "Arabic", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")
_TO: dict[tuple[str, str], dict[str, str]] = {
    (CYRILLIC, LATIN): CYRILLIC_AS_LATIN,
    (GREEK, LATIN): GREEK_AS_LATIN,
    (ARMENIAN, LATIN): ARMENIAN_AS_LATIN,
    ("Cherokee", LATIN): CHEROKEE_AS_LATIN,
    ("Coptic", LATIN): COPTIC_AS_LATIN,
    ("Lisu", LATIN): LISU_AS_LATIN,
    (LATIN, CYRILLIC): {v: k for k, v in reversed(CYRILLIC_AS_LATIN.items())} | {v: k for k, v in SMALL_AS_LATIN.items() if v.islower()},
    (LATIN, GREEK): {v: k for k, v in reversed(GREEK_AS_LATIN.items())},
    (GREEK, CYRILLIC): {k: v for k, v in GREEK_AS_CYRILLIC.items() if not v.isascii()},
    (CYRILLIC, GREEK): {v: k for k, v in GREEK_AS_CYRILLIC.items() if not v.isascii()},
}
_TO[(ARMENIAN, CYRILLIC)] = {k: _TO[LATIN, CYRILLIC][v] for k, v in ARMENIAN_AS_LATIN.items() if v in _TO[LATIN, CYRILLIC]}
_TO[(ARMENIAN, GREEK)] = {k: _TO[LATIN, GREEK][v] for k, v in ARMENIAN_AS_LATIN.items() if v in _TO[LATIN, GREEK]}

_LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪-⁯ㅤ︀-️﻿ﾠ"
_SPACES = "   -     　"
_ODD = re.compile(f"[{_INVISIBLE}{_SPACES}‐‑！-￮ﬀ-ﬆ̀-ͯᄀ-ᇿ゙゚℀-ÅⅠ-ⅿ\U0001d400-\U0001d7ffĲĳŉǄ-ǌǱ-ǳſῺ-ͅ豈-﫿]")
_LAT, _GC = "A-Za-zÀ-ɏ", "Ͱ-ԯ"
_DOUBLES = "".join([*CYRILLIC_AS_LATIN, *GREEK_AS_LATIN])
#: A letter with a double: of a script that Latin text seldom holds, beside Latin letters, or in a word of nothing else.
_FOREIGN = re.compile(f"[{''.join([*ARMENIAN_AS_LATIN, *PHONETIC_AS_LATIN, *CHEROKEE_AS_LATIN, *COPTIC_AS_LATIN, *LISU_AS_LATIN])}ѕіјԁһԛԝӏϲϳ]|[{_LAT}][̀-ͯ]*[{_GC}]|[{_GC}][̀-ͯ]*[{_LAT}]|[Ͱ-Ͽ][Ѐ-ԯ]|[Ѐ-ԯ][Ͱ-Ͽ]|(?<![^\\W\\d_])[{_DOUBLES}]+(?![^\\W\\d_])")
_HIDDEN = frozenset(c for c in map(chr, range(0x10000)) if re.match(f"[{_INVISIBLE}]", c))
_JOINING = re.compile(r"[؀-ۿऀ-෿က-႟]")
#: Only texts that match can need work; tested in the JVM.
SUSPECT = r"[^\x00-\x7F]"
#: Compatibility letters with a look of their own.
OWN_LOOK = frozenset("µªº")


_SCX = [(name, regex.compile(rf"\p{{scx={name}}}")) for name in SCRIPTS]


@lru_cache(1 << 16)
def scripts_of(c: str) -> frozenset[str]:
    """The scripts that Unicode gives a letter, extensions included."""
    return frozenset(name for name, p in _SCX if p.match(c)) or frozenset(("other",))


@lru_cache(1 << 16)
def script_of(c: str) -> str:
    own = scripts_of(c)
    return next(name for name in (*SCRIPTS, "other") if name in own)


@lru_cache(1 << 16)
def resolved(c: str) -> frozenset[str]:
    """The scripts in which a letter is at home or has a double."""
    own = script_of(c)
    return scripts_of(c) | {to for (of, to) in _TO if of == own and _double(c, own, to)} | ({LATIN} if c in SMALL_AS_LATIN else set())


def _pictograph(c: str) -> bool:
    o = ord(c)
    return o >= 0x1F000 or 0x2600 <= o < 0x27C0 or 0x2300 <= o < 0x2400 or 0x2B00 <= o < 0x2C00 or c in "©®‼⁉™ℹ↔↕↖↗↘↙↩↪▪▫▶◀◻◼◽◾〰〽㊗㊙⃣#*0123456789"


def _belongs(text: str, i: int) -> bool:
    """Whether the invisible character at ``i`` belongs to a pictograph or joins letters of a script that needs it."""
    before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
    if "︀" <= text[i] <= "️":
        return bool(before) and _pictograph(before)
    if text[i] == "‍":
        if before == "️" and i > 1:
            before = text[i - 2]
        if before and after and _pictograph(before) and _pictograph(after) and not (before.isdigit() and after.isdigit()):
            return True
    return text[i] in "‌‍" and bool(before and after) and bool(_JOINING.match(before)) and bool(_JOINING.match(after))


def _double(c: str, of: str, to: str) -> str | None:
    """The letter of script ``to`` that looks like ``c``; marks are kept."""
    plain = unicodedata.normalize("NFD", c)
    base = _TO.get((of, to), {}).get(plain[0])
    return unicodedata.normalize("NFC", base + plain[1:]) if base else None


def _resolve(run: str, rest: str, shapes: dict[str, float] | None) -> str:
    """``run`` in one script that all its letters can be told as; letters without a double there stay as they are."""
    letters = [c for c in run if c.isalpha()]
    scripts = [script_of(c) if c.isalpha() else "" for c in run]
    if not frozenset.intersection(*(scripts_of(c) for c in letters)):
        common = frozenset.intersection(*(resolved(c) for c in letters)) & {LATIN, CYRILLIC, GREEK}
        if not common and scripts.count(LATIN) * 2 >= len(letters):
            common = {LATIN}  # a letter has no double: the others are told all the same
        if not common:
            return run
        told = {t: "".join(c if not s or s == t else _double(c, s, t) or (SMALL_AS_LATIN.get(c, c) if t == LATIN else c) for c, s in zip(run, scripts)) for t in common}
        # no letters that the script's big languages lack; the script of the rest; that of most letters; then Latin
        target = max(sorted(common), key=lambda t: (not RARE_CYRILLIC.intersection(told[t]), rest == t, scripts.count(t), t == LATIN, t))
        return told[target]
    own = script_of(letters[0])
    # Units and names in Latin letters are at home in any text, so only Latin text is told from its doubles.
    if own != LATIN and rest == LATIN:
        told = [_double(c, own, rest) if s else c for c, s in zip(run, scripts)]
        if all(told) and (own not in (CYRILLIC, GREEK) or RARE_CYRILLIC.intersection(run) or likelihood("".join(told), shapes) > likelihood(run, shapes)):
            return "".join(told)
    return run


def _trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def likelihood(word: str, shapes: dict[str, float] | None) -> float:
    """How usual the rarest three letters of a word are among words of its script; 0 where the corpus holds none."""
    return min((shapes.get(t, 0.0) for t in _trigrams(word)), default=0.0) if shapes else 0.0


def word_shapes(frames: list[DataFrame], text: str = "text") -> dict[str, float]:
    """Shares of letter triples, ends included, among the words of confusable letters only: of Latin ones in texts without
    Cyrillic or Greek letters, of the others in texts without Latin ones. Over all texts; at most 3 x 64^3 numbers.
    """
    latin = "".join(sorted({v for k, m in _TO.items() if k[1] == LATIN and k[0] in (CYRILLIC, GREEK) for v in m.values()}))
    both = None
    for df in frames:
        part = df.select(F.col(text).alias("t")).where(F.col("t").isNotNull())
        both = part if both is None else both.unionByName(part)
    word = lambda letters: F.regexp_extract_all("t", F.lit(rf"(?<!\p{{L}})[{letters}]+(?!\p{{L}})"), F.lit(0))
    words = both.select(F.when(~F.col("t").rlike("[\u0370-\u052f]"), word(latin)).when(~F.col("t").rlike("[A-Za-z]"), word(_DOUBLES)).alias("w"), F.col("t").rlike("[A-Za-z]").alias("latin"))
    each = words.select("latin", F.explode("w").alias("w"))
    triple = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(F.concat(F.lit(" "), F.col("w"), F.lit(" ")), i, F.lit(3)))
    counted = each.select("latin", F.explode(triple).alias("k")).groupBy("latin", "k").count().collect()
    total = {x: sum(r["count"] for r in counted if r["latin"] == x) for x in (True, False)}
    return {r["k"]: r["count"] / total[r["latin"]] for r in counted}


def consistent(text: str, garbled: list[tuple[int, int]] = (), shapes: dict[str, float] | None = None) -> tuple[bool, str]:
    """(whether a stand-in was found, the text in its one form). ``garbled``: spans in which nothing is changed; ``shapes``:
    :func:`word_shapes`, without which whole words are only told by letters that no language uses.

    The empty text and ordinary text come back unchanged; texts of any length are handled whole.
    """
    if not _ODD.search(text) and not _FOREIGN.search(text):
        return False, text
    pieces, at = [], 0
    for a, b in garbled:
        pieces += [(text[at:a], True), (text[a:b], False)]
        at = b
    pieces.append((text[at:], True))
    whole = _rest_scripts(text, garbled)
    if not _ODD.search(text) and not any(ours and _FOREIGN.search(p) for p, ours in pieces):
        return False, text
    found, out = False, []
    for n, (piece, ours) in enumerate(pieces):
        if ours and piece:
            before = pieces[n - 1][0][-1:] if n else ""
            after = pieces[n + 1][0][:1] if n + 1 < len(pieces) else ""
            new = unicodedata.normalize("NFC", _letters(_signs(piece), whole, before, after, shapes))
            found |= new != piece
            piece = new
        out.append(piece)
    return found, "".join(out)


def _signs(text: str) -> str:
    out = []
    for i, c in enumerate(text):
        if not _ODD.match(c):
            out.append(c)
        elif c in _HIDDEN:
            if _belongs(text, i):
                out.append(c)
        elif c.isspace():
            out.append(" ")
        elif c in "‐‑":
            out.append("-")
        elif unicodedata.category(c)[0] == "M":
            out.append(c)
        elif "！" <= c <= "￮":
            out.append(unicodedata.normalize("NFKC", c))
        elif unicodedata.category(c)[0] in "L" or "Ⅰ" <= c <= "ⅿ":
            told = unicodedata.normalize("NFKC", c)
            out.append(told if c not in OWN_LOOK and c != "ϲ" and all(x.isalpha() for x in told) else c)
        else:
            out.append(unicodedata.normalize("NFC", c))
    return unicodedata.normalize("NFC", "".join(out))


def _rest_scripts(text: str, garbled: list[tuple[int, int]]) -> dict[str, int]:
    """Letters of each script outside garbled spans."""
    pieces, at = [], 0
    for a, b in garbled:
        pieces.append(text[at:a])
        at = b
    pieces.append(text[at:])
    counts: dict[str, int] = {}
    for c in _signs(" ".join(pieces)):
        if c.isalpha():
            s = script_of(c)
            counts[s] = counts.get(s, 0) + 1
    return counts


def _letters(text: str, whole: dict[str, int], before: str, after: str, shapes: dict[str, float] | None) -> str:
    def one(m: re.Match) -> str:
        run = m.group()
        if run.isascii() or (m.start() == 0 and before.isalpha()) or (m.end() == len(text) and after.isalpha()):
            return run
        if len(run) > 1 and any(c in PHONETIC_AS_LATIN for c in run):
            run = "".join(PHONETIC_AS_LATIN.get(c, c) for c in run)
        letters = [c for c in run if c.isalpha()]
        if not letters or run.isascii():
            return run
        mixed = not frozenset.intersection(*(scripts_of(c) for c in letters))
        rest = dict(whole)
        for c in letters:
            rest[script_of(c)] = rest.get(script_of(c), 0) - 1
        left = [s for s, n in rest.items() if n > 0]
        major = max(left, key=lambda s: rest[s]) if left else ""
        # A run in one script is only told anew where another script is all the rest.
        return _resolve(run, major if mixed or len(left) == 1 else "", shapes)

    return _LETTERS.sub(one, text)


def unify(df: DataFrame, text: str, keys: list[str], shared=None, shapes=None) -> DataFrame:
    """``keys``, ``changed`` (a stand-in was found) and ``form`` of each non-null ``text``.

    Null texts give no row; empty and blank ones come back as they are. Equal and repeated rows are treated each on its
    own; other columns of ``df`` may have any name. Narrow: pure ASCII rows never leave the JVM, nothing is exchanged.
    ``shared``: broadcast corpus tokens, so that garbled sequences are told from stand-ins; ``shapes``: broadcast
    :func:`word_shapes`.
    """
    named = df.select(*[F.col(f"`{k}`") for k in keys], text_of(df, text).alias("_text")).where(F.col("_text").isNotNull())
    plain = named.where(~F.col("_text").rlike(SUSPECT)).select(*keys, F.lit(False).alias("changed"), F.col("_text").alias("form"))
    return plain.unionByName(unify_suspects(named, keys, shared, shapes=shapes))


def unify_suspects(named: DataFrame, keys: list[str], shared=None, only_changed: bool = False, shapes=None) -> DataFrame:
    """As :func:`unify`, of the rows of (keys, ``_text``) that hold a non-ASCII character."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1])

    def work(batches):
        spans, known = _no_spans, shapes.value if shapes is not None else None
        if shared is not None:
            from tidewheel.llm.mojibake import detector

            spans = detector(shared).spans

        def one(s: str) -> tuple[bool, str]:
            if not _ODD.search(s) and not _FOREIGN.search(s):
                return False, s
            return consistent(s, [(x.start, x.end) for x in spans(s)], known)

        for b in batches:
            done = map_distinct(b.column(len(keys)), one)
            rows = [i for i, x in enumerate(done) if x[0] or not only_changed]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in range(len(keys))] + [pa.array([done[i][0] for i in rows], pa.bool_()), pa.array([done[i][1] for i in rows], pa.string())], names=[*keys, "changed", "form"])

    return named.where(F.col("_text").rlike(SUSPECT)).mapInArrow(work, f"{kinds}, changed boolean, form string")


def _no_spans(_: str) -> list:
    return []

"""Garbled text from a wrong character encoding: found by an automaton of garbled sequences, restored span by span.

The patterns are worked out once for all pairs of encodings:

* ``utf8``: each character of a repertoire, written as UTF-8 and read as each single-byte encoding;
* ``token``: each common non-ASCII token of the corpus, written in one single-byte encoding and read as another;
* ``wide``: each common East Asian character, written in a double-byte encoding and read as a single-byte one;
* ``utf7``: each character of the repertoire in UTF-7 that nobody decoded, also in lower and upper case;
* ``lost``: the replacement character, C1 controls and pieces of frames, which no correct title holds.

Which of two spellings is the garbled one is told by their letters (mixed scripts, signs and capitals inside words, pairs of
letters that the corpus lacks) and by how many distinct texts hold them: copies say nothing.

Corpus tokens and characters come from all rows. A token counts as common from ``min_share`` of the rows on, so there are at
most (tokens a row) / ``min_share`` of them however large the corpus is; that list is what is broadcast. A token that is not
common has no pattern: all pairs of encodings are tried on it, and the letters and letter pairs of the corpus tell whether
another reading is far likelier.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from functools import cache, cached_property, lru_cache
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_distinct, text_of

# Encodings that a text may have been read in, written in, and double-byte encodings.
READ_AS = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "cp1253", "iso8859_15")
WRITTEN_IN = ("cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp1253", "iso8859_5", "iso8859_2", "cp1250")
DOUBLE_BYTE = ("cp932", "euc_jp", "cp949", "gbk", "big5")
WIDE_READ_AS = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman")

SPLIT = r"[\s\-.,:;!?|()\[\]{}/\"'<>=&#%*]+"
_TOKEN = re.compile(r"[^\s\-.,:;!?|()\[\]{}/\"'<>=&#%*]+")
_BREAKS = frozenset(" -.,:;!?|()[]{}/\"'<>=&#%*")
_UTF7 = re.compile(r"\+([A-Za-z0-9+/]{3,})-?")
_ENTITY = re.compile(r"&[A-Za-z]{2,8}\d?;")
_WORD = re.compile(r"[^\W_]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SCRIPT = re.compile(r"^(?:HALFWIDTH |FULLWIDTH )?(\w+)")
_TOGETHER = frozenset(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC"))
#: Difference in mean log likelihood of letter pairs that tells the direction; five times as many texts count as much.
LIKELIER = 1.0
#: A longer token is no word.
RARE_LENGTH = 100
#: Share of the rows from which a token is common: it gets patterns of its own. Others are judged by their letters.
MIN_SHARE = 1e-4
#: Only texts that match can hold a garbled sequence; tested in the JVM.
SUSPECT = r"[^\x00-\x7F]|\+[A-Za-z0-9+/]{2}|&[A-Za-z]{2,8}[0-9]?;"


def _read(raw: bytes, encoding: str) -> str | None:
    """``raw`` read as ``encoding``; bytes that cp125x leave open become C1 controls, as browsers do."""
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        if not encoding.startswith("cp125"):
            return None
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _repertoire(extra: Iterable[str]) -> list[str]:
    """Letters and signs of the scripts that are misread most, and the corpus's own characters."""
    ranges = ((0x80, 0x100), (0x384, 0x3CF), (0x401, 0x402), (0x410, 0x450), (0x451, 0x452), (0x2010, 0x2027), (0x2030, 0x203B), (0x3000, 0x3003), (0x3041, 0x30FF))
    fixed = {chr(c) for a, b in ranges for c in range(a, b)} | set("€№™ŒœŠšŽžŸ")
    return sorted(c for c in fixed.union(extra) if ord(c) >= 0x80 and c != "�" and (unicodedata.category(c) not in ("Cf", "Co", "Cn") or c == "\xad"))


class Span(NamedTuple):
    start: int
    end: int
    fixed: str | None  # None: lost for good
    pair: str = ""  # the encodings that explain it


@cache
def _script(c: str) -> str:
    return "".join(_SCRIPT.findall(unicodedata.name(c, ""))[:1]) if c.isalpha() else ""


@lru_cache(1 << 16)
def _oddness(token: str) -> int:
    """What correct words seldom hold: letters of different scripts side by side, signs and controls inside, capitals after small letters."""
    inner = _EDGES.sub("", token)
    kinds = [_script(c) for c in inner]
    mixed = sum(a != b for a, b in zip(kinds, kinds[1:]) if a and b and not {a, b} <= _TOGETHER)
    signs = sum(not (c.isalnum() or unicodedata.category(c) in ("Mn", "Mc") or c in "'’·‐‑_+@") for c in inner)
    return mixed + signs + sum(a.islower() and b.isupper() for a, b in zip(inner, inner[1:]))


def _disguised(token: str) -> bool:
    """Whether a token is written with other characters rather than read wrongly."""
    from tidewheel.llm.lookalike import consistent

    return any(unicodedata.category(c) == "Cf" for c in token) or consistent(token)[0]


class _Letters:
    """Letters and their pairs in the corpus's tokens, each token as often as distinct texts hold it."""

    def __init__(self, tokens: dict[str, int]):
        self.seen: Counter[str] = Counter()
        for t, n in tokens.items():
            for p in self._of(t):
                self.seen[p] += n
                self.seen[p[0]] += n
        self.total = 1 + sum(n for p, n in self.seen.items() if len(p) == 1)

    @staticmethod
    def _of(token: str) -> list[str]:
        padded = f" {token.lower()} "
        return [padded[i : i + 2] for i in range(len(padded) - 1)]

    def likelihood(self, token: str, texts: int) -> float:
        """Mean log likelihood of a token's pairs, backed by that of their letters; what its own texts add is left out."""
        pairs = self._of(token)
        own = Counter(pairs) + Counter(p[0] for p in pairs)
        n = lambda x: max(0, self.seen[x] - texts * own[x])
        return sum(math.log(n(p) / self.total + 0.1 * (n(p[0]) + 0.5) / self.total * (n(p[1]) + 0.5) / self.total) for p in pairs) / len(pairs)


class _Words:
    """Where the tokens of one text are, and how many plain letters stand before each place; worked out once, when asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def _breaks(self) -> list[int]:
        return [i for i, c in enumerate(self.text) if not _TOKEN.fullmatch(c)]

    @cached_property
    def _plain(self) -> list[int]:
        return [0, *accumulate(c.isascii() and c.isalpha() for c in self.text)]

    def around(self, start: int, end: int) -> tuple[int, int]:
        """The token around a span."""
        i, j = bisect_left(self._breaks, start), bisect_left(self._breaks, end)
        return (self._breaks[i - 1] + 1 if i else 0), (self._breaks[j] if j < len(self._breaks) else len(self.text))

    def plain(self, a: int, b: int) -> int:
        return self._plain[b] - self._plain[a]


class Detector:
    """Finds and restores garbled spans of one text. ``tokens``: of common non-ASCII tokens, how many distinct texts hold each."""

    def __init__(self, tokens: dict[str, int]):
        self.tokens = tokens
        self.longest = max(map(len, tokens), default=0)
        self.folded: dict[str, int] = {}
        for t, n in tokens.items():
            self.folded[t.lower()] = self.folded.get(t.lower(), 0) + n
        chars = {}
        for t, n in tokens.items():
            for c in set(t):
                chars[c] = chars.get(c, 0) + n
        self.auto = ahocorasick.Automaton()
        found: dict[str, list[tuple[str, str, str]]] = {}

        def add(pattern: str, kind: str, fixed: str, pair: str = "") -> None:
            kinds = found.setdefault(pattern, [])
            if (kind, fixed, pair) not in kinds:
                kinds.append((kind, fixed, pair))

        for c in _repertoire(chars):
            raw = c.encode("utf-8")
            for wrong in READ_AS:
                g = _read(raw, wrong)
                if g and not g.isascii() and g != c:
                    add(g, "utf8", c, wrong)
                    for v in {g.lower(), g.upper()} - {g}:
                        if len(v) >= 2:
                            add(v, "utf8", c, wrong + "~")  # case changed later
            g = c.encode("utf-7").decode()
            for v in dict.fromkeys((g, g.lower(), g.upper())):
                add(v, "utf7", c)
        self.letters = _Letters(tokens)
        garbled = set()  # tokens that are a likelier one, garbled: nothing is explained by them
        odd = {t: _oddness(t) for t in tokens}
        for t, n in sorted(tokens.items(), key=lambda x: (odd[x[0]], -x[1], x[0])):
            if t not in garbled and not any(0x80 <= ord(c) < 0xA0 or c == "�" for c in t):
                for right in WRITTEN_IN:
                    try:
                        raw = t.encode(right)
                    except UnicodeEncodeError:
                        continue
                    for wrong in READ_AS:
                        g = _read(raw, wrong) if wrong != right else None
                        if g and g != t and not g.isascii() and any(unicodedata.category(c)[0] not in "ZC" for c in g):
                            for v in dict.fromkeys((g, g.lower(), g.upper())):
                                if v.lower() != t.lower() and self._garbles(v, t, n, odd[t]):
                                    add(v, "token", t, right + wrong)
                                    garbled.add(v)
        wide = sorted((c for c in chars if ord(c) >= 0x2E80), key=lambda c: -chars[c])
        for c in wide:
            for right in DOUBLE_BYTE:
                try:
                    raw = c.encode(right)
                except UnicodeEncodeError:
                    continue
                for wrong in WIDE_READ_AS:
                    g = _read(raw, wrong)
                    if g and not g.isascii():
                        add(g, "wide", c, right + wrong)
        for c in ["�", *map(chr, [*range(0x80, 0xA0), *range(0x2550, 0x2593)]), "└", "┘", "┌", "┐", "├", "┤", "┬", "┴", "┼"]:
            add(c, "lost", "")
        for pattern, kinds in found.items():
            self.auto.add_word(pattern, (len(pattern), [k for k in kinds if k[0] == "token"], [k for k in kinds if k[0] != "token"]))
        self.auto.make_automaton()

    def _garbles(self, v: str, t: str, n: int, odd: int) -> bool:
        """Whether of two spellings ``v`` is the garbled one, and not ``t``, a token of ``n`` texts."""
        m = self.folded.get(v.lower(), 0)
        if any(c.isalpha() for c in t) and len(t) > 1:
            other = _oddness(v)
            if other != odd:
                return other > odd
            if m:
                return self.letters.likelihood(t, n) - self.letters.likelihood(v, m) + math.log(n / m, 5) > LIKELIER
        return m * 5 < n

    def _boundary(self, text: str, start: int, end: int) -> bool:
        return (start == 0 or text[start - 1] in _BREAKS or text[start - 1].isspace()) and (end == len(text) or text[end] in _BREAKS or text[end].isspace())

    def _known(self, token: str) -> bool:
        return token in self.tokens or token.lower() in self.folded

    def _known_in(self, words: _Words, spans: list[Span], a: int, b: int) -> bool:
        """Whether the token from ``a`` to ``b`` is known once its spans are replaced; one longer than all known ones is not."""
        start, end = spans[0].start, spans[-1].end
        fixed = "".join(s.fixed for s in spans)
        return (start - a) + len(fixed) + (b - end) <= self.longest + 2 and self._known(words.text[a:start] + fixed + words.text[end:b].strip())

    @lru_cache(1 << 16)  # noqa: B019
    def _as_utf8(self, token: str) -> tuple[str, str] | None:
        """(what a token was, the encoding it was read in) if all of it is UTF-8 read otherwise: at least two characters of it, with fewer oddities then."""
        if _disguised(token):
            return None
        for wrong in READ_AS:
            try:
                was = token.encode(wrong).decode("utf-8")
            except UnicodeError:
                continue
            if len(was) < len(token) - 1 and _oddness(was) < _oddness(token):
                return was, wrong
        return None

    @lru_cache(1 << 16)  # noqa: B019
    def _rare(self, token: str) -> tuple[str, str] | None:
        """(what a token that is not known was, the pair of encodings) if another reading of it has far likelier letters.

        Every pair of single-byte encodings is tried. A reading with fewer oddities must be likelier by ``LIKELIER``, one
        with as many by three times that; a known one by nothing, if it has fewer.
        """
        if _disguised(token):
            return None
        odd, like, best = _oddness(token), self.letters.likelihood(token, 0), None
        for wrong in READ_AS:
            try:
                raw = token.encode(wrong)
            except UnicodeEncodeError:
                continue
            for right in WRITTEN_IN:
                if right == wrong:
                    continue
                try:
                    was = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if was == token or was.isascii() or not was.strip("'’-").isalpha() or (other := _oddness(was)) > odd:
                    continue
                gain = self.letters.likelihood(was, 0) - like
                need = 0 if other < odd and self._known(was) else LIKELIER if other < odd else 3 * LIKELIER
                if gain > need and (best is None or gain > best[0]):
                    best = gain, was, right + wrong
        return best and best[1:]

    def spans(self, text: str) -> list[Span]:
        """Disjoint garbled spans in order; empty for correct text, an empty text included."""
        by_kind: dict[str, list[Span]] = {"utf8": [], "token": [], "wide": [], "utf7": [], "lost": []}
        hit = False
        for last, (size, words, others) in self.auto.iter(text):
            start, end = last + 1 - size, last + 1
            if words and self._boundary(text, start, end):
                hit = True
                by_kind["token"] += [Span(start, end, fixed, pair) for _, fixed, pair in words]
            for kind, fixed, pair in others:
                hit = True
                by_kind[kind].append(Span(start, end, fixed if kind != "lost" else None, pair))
        rare, all_of_it = [], []
        if not text.isascii():
            for m in _TOKEN.finditer(text):
                if not (t := m.group()).isascii() and len(t) <= RARE_LENGTH and not self._known(t) and sum(map(str.isalpha, t)) > 1:
                    if was := self._as_utf8(t):
                        all_of_it.append(Span(m.start(), m.end(), *was))
                    elif was := self._rare(t):
                        rare.append(Span(m.start(), m.end(), *was))
        if not hit and not rare and not all_of_it and "+" not in text:
            return []
        seen = _Words(text)
        out: list[Span] = all_of_it
        for m in _UTF7.finditer(text):
            try:
                d = m.group().encode().decode("utf-7")
            except (UnicodeDecodeError, ValueError):
                continue
            if d and all(ord(c) > 127 and (c.isalpha() or 0x2010 <= ord(c) <= 0x203A or 0xA0 <= ord(c) < 0xC0) for c in d):
                out.append(Span(m.start(), m.end(), d))
        out += by_kind["utf7"]
        narrow = _by_pair(by_kind["utf8"], lambda found: self._utf8(seen, found))
        wide = _by_pair(by_kind["wide"], lambda found: self._wide(seen, found))
        out += narrow + wide if _most(narrow) >= _most(wide) else wide + narrow
        words = sorted(by_kind["token"], key=lambda s: -self.tokens.get(s.fixed, 0))
        out += _by_pair(words, lambda found: found)
        out += rare
        out += by_kind["lost"]
        kept, taken = [], bytearray(len(text))
        for s in out:  # what was found first explains more
            if not any(taken[s.start : s.end]):
                taken[s.start : s.end] = b"\x01" * (s.end - s.start)
                kept.append(s)
        return sorted(kept, key=lambda s: s.start)

    def _runs(self, spans: list[Span]) -> Iterable[list[Span]]:
        """Adjacent sequences, the longest at each place."""
        spans = sorted(spans, key=lambda s: (s.start, s.start - s.end))
        run: list[Span] = []
        for s in spans:
            if run and s.start < run[-1].end:
                continue
            if run and s.start != run[-1].end:
                yield run
                run = []
            run.append(s)
        if run:
            yield run

    def _utf8(self, words: _Words, spans: list[Span]) -> Iterable[Span]:
        """Spans of one pair of encodings. Where one run is certain, doubtful ones of the same pair are believed."""
        text = words.text
        doubtful, sure = [], []
        for run in self._runs(spans):
            start, end = run[0].start, run[-1].end
            seen = text[start:end]
            blank = seen[-1].isspace() or "\xad" in seen
            certain = len(run) > 1 and not (blank and len(run) == 2)
            if not certain and not run[0].pair.endswith("~"):
                certain = any(not c.isalpha() and not c.isspace() and c != "\xad" for c in seen) and not _ends_a_word(text, start, end)
            if not certain:
                a, b = words.around(start, end)
                certain = self._known_in(words, run, a, b)
            if not certain and blank:
                near = text[max(a, start - self.longest) : start] + "".join(s.fixed for s in run) + text[end : min(b, end + self.longest)]
                certain = any(self._known(x) for x in _TOKEN.findall(near) if not x.isascii())
            if certain:
                sure += run
            elif not blank:
                doubtful += run
        return sure + doubtful if sure else []

    def _wide(self, words: _Words, spans: list[Span]) -> Iterable[Span]:
        text = words.text
        for run in self._runs(spans):
            start, end = run[0].start, run[-1].end
            odd = sum(1 for c in text[start:end] if not c.isascii() and not (c.isalpha() and ord(c) < 0x250 and c.islower() and c != "ƒ"))
            if len(run) > 1 and odd >= 2 and self._boundary_non_latin(words, start, end):
                yield from run

    def _boundary_non_latin(self, words: _Words, start: int, end: int) -> bool:
        """Correct Latin words hold plain letters beside the sequence; garbled ones seldom do."""
        a, b = words.around(start, end)
        return words.plain(a, start) + words.plain(end, b) <= end - start

    def repair(self, text: str) -> tuple[bool, str, bool]:
        """(garbled, text with its garbled spans replaced, whether all of them could be). Correct text comes back as it is.

        A text that was encoded wrongly several times is restored as often, until nothing changes or a text comes back.
        """
        garbled, left, seen = False, False, set()
        while text not in seen:
            seen.add(text)
            plain = html.unescape(text) if _ENTITY.search(text) else text
            spans = self.spans(plain)
            left = bool(spans)
            if not spans:
                break
            garbled = True
            out, at = [], 0
            for s in spans:
                out.append(plain[at : s.start])
                out.append(plain[s.start : s.end] if s.fixed is None else s.fixed)
                at = s.end
            out.append(plain[at:])
            text = "".join(out)
        return garbled, text, not left and not any(c == "�" or 0x80 <= ord(c) < 0xA0 for c in text) if garbled else True


def _ends_a_word(text: str, start: int, end: int) -> bool:
    """Whether letter and sign could be the end of a correct word and what follows it, as in ``MAÇÃ…``: cases agree."""
    letter, before = text[start], text[start - 1 : start]
    return (
        end - start == 2 and text[start + 1] in "…™’”»›–—" and before.isalpha() and letter.isalpha()
        and before.isupper() == letter.isupper() and not text[end : end + 1].isalpha()
    )


def _most(spans: list[Span]) -> int:
    """Characters that the best pair explains."""
    by: dict[str, int] = {}
    for s in spans:
        by[s.pair] = by.get(s.pair, 0) + s.end - s.start
    return max(by.values(), default=0)


def _by_pair(spans: list[Span], keep) -> list[Span]:
    """What ``keep`` leaves of each pair of encodings; pairs that explain more of the text come first."""
    if not spans:
        return []
    pairs: dict[str, list[Span]] = {}
    for s in spans:
        pairs.setdefault(s.pair, []).append(s)
    kept = [list(keep(found)) for found in pairs.values()]
    order = {pair: i for i, pair in enumerate(READ_AS)}
    return [s for found in sorted(kept, key=lambda x: (-sum(s.end - s.start for s in x), order.get(x[0].pair, 99) if x else 0)) for s in found]


def corpus_tokens(columns: list[Column], frames: list[DataFrame], min_share: float = MIN_SHARE) -> dict[str, int]:
    """Of the non-ASCII tokens in at least ``min_share`` of the rows (and in two), how many distinct texts hold each; over all rows.

    One exchange of the distinct non-ASCII texts and one of tokens, both after partial aggregation; the result is bounded
    by (tokens a row) / ``min_share``.
    """
    both = None
    for c, df in zip(columns, frames):
        part = df.select(c.alias("_t"))
        both = part if both is None else both.unionByName(part)
    texts = both.where(F.col("_t").rlike(r"[^\x00-\x7F]")).groupBy("_t").agg(F.count(F.lit(1)).alias("_c"))
    parts = texts.select("_c", F.explode(F.array_distinct(F.split(F.col("_t"), SPLIT))).alias("_k")).where(F.col("_k").rlike(r"[^\x00-\x7F]"))
    rows = max(1, both.count())
    least = max(2, int(rows * min_share))
    counted = parts.groupBy("_k").agg(F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("texts"))
    return {r["_k"]: r["texts"] for r in counted.where(F.col("rows") >= least).collect()}


_DETECTORS: dict[int, Detector] = {}


def detector(shared) -> Detector:
    """One detector a worker process and broadcast."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _DETECTORS:
        _DETECTORS.clear()
        _DETECTORS[key] = Detector(shared.value)
    return _DETECTORS[key]


def mark_garbled(df: DataFrame, text: str, keys: list[str], shared, restored: bool = True) -> DataFrame:
    """``keys`` and, of each garbled ``text``, the text with its garbled spans replaced and whether nothing was lost.

    Rows whose text is null, empty, blank or correct give no row; ties and repeated rows are treated each on its own.
    Columns of ``df`` other than these may have any name. Narrow: no exchange, and only texts that can hold a garbled
    sequence reach Python. ``shared``: broadcast result of :func:`corpus_tokens`.
    """
    picked = df.select(*[F.col(f"`{k}`") for k in keys], text_of(df, text).alias("_text")).where(F.col("_text").rlike(SUSPECT))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def work(batches):
        d = detector(shared)
        for b in batches:
            done = map_distinct(b.column(len(keys)), d.repair)
            rows = [i for i, x in enumerate(done) if x[0]]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(take) for i in range(len(keys))] + [pa.array([done[i][1] for i in rows], pa.string()), pa.array([done[i][2] for i in rows], pa.bool_())],
                names=[*keys, "restored", "whole"],
            )

    return picked.mapInArrow(work, f"{kinds}, restored string, whole boolean")

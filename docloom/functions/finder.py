"""Identifiers of one text by the detector rules: the helper that ``detect`` runs inside Arrow tasks.

Patterns mean here what they mean in SQL: ``\\s`` is space, tab, line feed, form feed and carriage
return, and an edge of words is where the character before is no letter, digit or mark.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, repeat

import pyarrow as pa

from . import checksums as C
from .entities import CODE, ENTITIES, NARROW, SEPARATORS, SOURCES, WIDE, Rule

Parts = Iterable[tuple[int, int]]

MATCH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("text", pa.string()), ("confidence", pa.float32()), ("source", pa.string())])
FOUND = pa.struct([("matches", pa.list_(MATCH)), ("n", pa.int32())])

_EDGE = r"(?U)\b"
_SOLID = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOCAL = _SOLID | frozenset("._%+-")
_SQUEEZE = {**dict.fromkeys(map(ord, SEPARATORS)), **str.maketrans(WIDE, NARROW)}
_GAP = f"[{re.escape(SEPARATORS)}]*"
_RUN = re.compile(f"[0-9０-９](?:{_GAP}+[0-9０-９]){{5,}}+(?:{_GAP}[XxＸｘ])?")
_CODES = "|".join(sorted(ENTITIES, key=len, reverse=True))
_WHOLE = re.compile(rf"(?s)[\t\n\f\r ]*(?:\[(?:{_CODES})_.+\]|(?:{_CODES})_[0-9A-Fa-f]{{8,}})[\t\n\f\r ]*")
_BRACKET = re.compile(rf"(?s)\[(?:{_CODES})_.+\]")
_HEX = re.compile("[0-9A-Fa-f]{8,}")
_ENDS = tuple(f"{c}_" for c in ENTITIES)


def _compiled(pattern: str) -> re.Pattern:
    space = lambda m: "[\\t\\n\\f\\r ]" if m[0] == r"\s" else m[0].replace(r"\s", "\\t\\n\\f\\r ") if m[0][0] == "[" else m[0]
    return re.compile(re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", space, pattern.removeprefix(_EDGE)))


def squeezed(value: str) -> str:
    return value.translate(_SQUEEZE)


_DAY = re.compile("(?:19|20)[0-9]{6}")
_RESIDENT = re.compile("[1-8][0-9]{16}[0-9Xx]")


def _real_date(d: str) -> bool:
    try:
        return _DAY.fullmatch(d) is not None and bool(datetime.date(int(d[:4]), int(d[4:6]), int(d[6:])))
    except ValueError:
        return False


def _resident(q: str) -> str | None:
    if not (_RESIDENT.fullmatch(q) and _real_date(q[6:14])):
        return None
    return "checksum" if C.ID_CHECK[sum(int(c) * w for c, w in zip(q, C.ID_WEIGHTS, strict=False)) % 11] == q[17] else "pattern"


_PLACE = {c: i for i, c in enumerate(C.CODE_ALPHABET)}
_CODE17 = re.compile(f"[{C.CODE_ALPHABET}]{{17}}.")
_CODE_SHAPE = re.compile(f"[{C.CODE_AUTHORITIES}][{C.CODE_ALPHABET}][0-9]{{6}}[{C.CODE_ALPHABET}]{{10}}")
_PLATE = re.compile(f"[{C.PLATE_PROVINCES}][A-Za-z][0-9A-HJ-NP-Za-hj-np-z]{{5,6}}")


def _credit_code(q: str) -> str | None:
    if _resident(q):
        return None
    if _CODE17.fullmatch(q) and C.CODE_ALPHABET[-sum(_PLACE[c] * w for c, w in zip(q, C.CODE_WEIGHTS, strict=False)) % 31] == q[17]:
        return "checksum"
    return "pattern" if _CODE_SHAPE.fullmatch(q) else None


_CARD = re.compile("[2-6][0-9]{12,18}")
_ONCE, _TWICE = (bytes.maketrans(b"0123456789", bytes(d)) for d in (range(10), (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))


def _card(q: str) -> str | None:
    if not _CARD.fullmatch(q):
        return None
    digits = q.encode()
    total = sum(digits[-1::-2].translate(_ONCE)) + sum(digits[-2::-2].translate(_TWICE))
    return "pattern" if total % 10 else "checksum"


def _malaysian(v: str) -> bool:
    d = re.sub("[^0-9]", "", v)
    return len(d) == 12 and (_real_date("19" + d[:6]) or _real_date("20" + d[:6]))


_NUMBERS = {"resident_id": _resident, "credit_code": _credit_code, "card": _card}
_TESTS = {
    "plate": lambda v: _PLATE.fullmatch(v) is not None, "malaysian": _malaysian, "some_digit": lambda v: re.search("[0-9]", v) is not None,
    "account": lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 32,
}


def _evidence(rule: Rule) -> Callable[[str], str | None]:
    """The evidence that a value gives; null drops it."""
    if rule.check in _NUMBERS:
        return lambda v: _NUMBERS[rule.check](squeezed(v))
    keep = _TESTS.get(rule.check)
    return lambda v: rule.source if keep is None or keep(v) else None


#: Characters of a hit before and behind its run of digits (an X counts to the run), and before the first of its needs, at most.
_LEAD, _TAIL, _AHEAD = 2, 3, {"ADDRESS": 120}
_NEAR = 80


#: Han and what is coded behind it: literals that start with it are looked for from its first one on.
_FAR = "⺀-\U0010ffff"
_HAN = re.compile(f"[{_FAR}]")


def _digit_runs(text: str) -> list[tuple[int, int, int]]:
    """Runs of digits with no more than separators between, an X behind them too, and how many digits each has."""
    return [(*m.span(), len(run) if (run := m[0]).isdigit() else len(squeezed(run.rstrip("XxＸｘ")))) for m in _RUN.finditer(text)]


def _around(runs: list[tuple[int, int, int]], digits: int) -> list[tuple[int, int]]:
    """The parts of a text where hits with so many digits lie; near ones are one, which takes less time than two searches."""
    parts, a, b = [], -1, -1
    for start, end, n in runs:
        if n >= digits:
            if a >= 0 and start - b < _NEAR:
                b = end + _TAIL
                continue
            if a >= 0:
                parts.append((a, b))
            a, b = start - _LEAD if start > _LEAD else 0, end + _TAIL
    return [*parts, (a, b)] if a >= 0 else parts


def _addresses(domain: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses from their @ outwards, so that a long word without one is gone through once."""
    least, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        hit = domain.match(text, at + 1) if start < at else None
        if hit:
            yield start, hit.end()
            least = hit.end()
        at = text.find("@", max(least, at + 1))


_DOT = re.compile(r"\.[0-9]")


def _octets(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Network addresses from their first dot."""
    least = 0
    for dot in (m.start() for m in _DOT.finditer(text)):
        start = dot
        while start > max(least, dot - 3) and "0" <= text[start - 1] <= "9":
            start -= 1
        hit = next(filter(None, (pattern.match(text, s) for s in range(start, dot))), None)
        if hit:
            yield hit.span()
            least = hit.end()


_CODE_RUN = re.compile(f"{CODE}(?:{_GAP}+{CODE}){{5,}}+")
_HAN_RUN = re.compile("[一-鿿0-9]{7,}")

#: What a hit starts with, where the pattern hides it from the regular expression's search, and a label without what may stand before.
_FIRST = {"CN_MOBILE": re.compile(f"[1１]{_GAP}[3-9３-９]|[8８]{_GAP}[6６]")}
_LABELS = {r"(?:(?:香港)?入境许可(?:证)?|(?:澳门)?非本地劳工证|劳工证)[:： \t　]*": r"(?:入境许可(?:证)?|劳工证)[:： \t　]*"}


def _from(first: re.Pattern, pattern: re.Pattern, text: str, parts: Parts) -> Iterator[tuple[int, int]]:
    for a, b in parts:
        start = first.search(text, a, b)
        while start:
            hit = pattern.match(text, start.start(), b)
            if hit:
                yield hit.span()
            start = first.search(text, hit.end() if hit else start.start() + 1, b)


def _spans(rule: Rule) -> Callable[[str, Parts], Iterable[tuple[int, int]]]:
    """Where a rule looks, before any test, in the parts of a text that can hold its hits."""
    if rule.code == "EMAIL":
        domain = _compiled(rule.pattern.partition("@")[2])
        return lambda text, _: _addresses(domain, text)
    # no character is both a separator and one of a number, so nothing is found by giving separators back
    pattern = _compiled(rule.pattern.replace("]*", "]*+") if rule.mode == "spaced" else rule.pattern)
    if rule.code == "IP":
        return lambda text, _: _octets(pattern, text)
    if rule.code == "USCC":  # its runs once, not from each of their characters
        return lambda text, _: [m.span() for run in _CODE_RUN.finditer(text) if run.end() - run.start() > 17 for m in pattern.finditer(text, *run.span())]
    if rule.code in _FIRST:
        return lambda text, parts: _from(_FIRST[rule.code], pattern, text, parts)
    if rule.code == "ADDRESS":  # nothing but Han characters and digits
        return lambda text, parts: [m.span() for a, b in parts for run in _HAN_RUN.finditer(text, a, b) if "号" in run[0] and ("市" in run[0] or "自治州" in run[0]) for m in pattern.finditer(text, *run.span())]
    if rule.mode != "label":
        group = 1 if rule.mode == "group" else 0
        return lambda text, parts: [m.span(group) for a, b in parts for m in pattern.finditer(text, a, b)]
    # what may stand before a label's own words does not change where it ends
    label = _compiled(_LABELS.get(rule.label) or re.sub(r"^(?:\(\?:[^()]*\)\?)+", "", rule.label))

    def behind(text: str, parts: Parts) -> Iterator[tuple[int, int]]:
        hit = None
        for m in (m for a, b in parts for m in label.finditer(text, a, b)):
            if hit is None or hit.start() < m.end():  # else the first value behind the label before is this one's too
                hit = pattern.search(text, m.end())
                if hit is None:
                    return
            yield hit.span()

    return behind


def _kept(rule: Rule) -> Callable[[str, int, int], bool]:
    """Whether the characters beside a span let it stand."""
    edge, octets = rule.pattern.startswith(_EDGE), rule.check == "no_more_octets"
    if rule.mode == "group" and rule.check != "both_sides":
        return lambda text, s, e: not ("0" <= text[e : e + 1] <= "9")

    def keep(text: str, s: int, e: int) -> bool:
        before = text[s - 1] if s else ""
        if rule.bounded and (before in _SOLID or text[e : e + 1] in _SOLID):
            return False
        if octets and (before == "." or (text[e : e + 1] == "." and "0" <= text[e + 1 : e + 2] <= "9")):
            return False
        return not (edge and before and (before == "_" or unicodedata.category(before)[0] in "LNM"))

    return keep


def _first_head(text: str) -> int:
    """Where the first code with its low line stands."""
    at = text.find("_")
    while at >= 0:
        if text.endswith(_ENDS, 0, at + 1):
            return min(at + 1 - len(x) for x in _ENDS if text.endswith(x, 0, at + 1))
        at = text.find("_", at + 1)
    return -1


def _in_token(text: str, s: int, e: int) -> bool:
    """Whether a span is part of a token that an earlier run put in."""
    v = text[s:e]
    if _WHOLE.fullmatch(v) or (_HEX.fullmatch(v) and text.endswith(_ENDS, 0, s)):
        return True
    left, right = text.rfind("[", 0, s), text.find("]", e)
    before = text[left:s] if left > text.rfind("]", max(left, 0), s) else ""
    after = text[e : right + 1] if right >= 0 and text.find("[", e, right) < 0 else ""
    return (before or v)[:1] == "[" and _BRACKET.fullmatch(before + v + after) is not None


def values(a: pa.Array) -> list:
    """As ``to_pylist``, which makes an object of Arrow's for each value first."""
    return a.to_pylist() if a.null_count else a.to_numpy(zero_copy_only=False).tolist()


#: Rows of a batch whose matches Python holds at once.
ROWS = 256


def by_rows(f: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """What a function makes of the columns, few rows at a time."""
    return pa.concat_arrays([f(*(c.slice(i, ROWS) for c in columns)) for i in range(0, max(len(columns[0]), 1), ROWS)])


def tuples(matches: pa.Array) -> list[list[tuple] | None]:
    """The structs of each list as tuples; null for null."""
    ends = matches.offsets.to_pylist()
    first = ends[0] if ends else 0
    rows = list(zip(*map(values, matches.values.slice(first, ends[-1] - first if ends else 0).flatten()), strict=True))
    return [rows[a - first : b - first] if there else None for a, b, there in zip(ends, ends[1:], matches.is_valid().to_pylist(), strict=False)]


def lists(of: pa.StructType, rows: list[list[tuple] | None]) -> pa.ListArray:
    """A list of structs for each list of tuples; null for null."""
    ends = [0, *accumulate(len(r or ()) for r in rows)]
    fields = list(zip(*(t for r in rows for t in r or ()), strict=True)) or ((),) * len(of)
    made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(fields, of, strict=True)], fields=list(of))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, mask=pa.array([r is None for r in rows], pa.bool_()))


def outside(found: list[tuple], applied: list[tuple] | None) -> list[tuple]:
    """The matches, by position, that lie in none of the places where the applied tokens are now."""
    starts, ends, shift = [], [], 0
    for s, e, _, _, token, _ in applied or ():
        starts.append(s + shift)
        ends.append(s + shift + len(token))
        shift += len(token) - (e - s)
    # the last token that starts at or before a match is the one that ends last
    return [m for m in found if not (at := bisect_right(starts, m[0])) or ends[at - 1] < m[1]]


def searcher(rules: Iterable[Rule]) -> Callable[..., tuple[list[tuple], int]]:
    """A function from a text, and other matches, to its matches by position, and how many there were.

    Rules run in order, as one marked so skips spans that an earlier one has claimed.  Of matches of
    the same span the preferred source stays, and of those the first.
    """
    steps = [(r, [(x, x[0] >= _FAR[0]) for x in r.needs], _spans(r), _kept(r), _evidence(r)) for r in rules]
    rank = {s: i for i, s in enumerate(SOURCES)}

    def one(text: str, extra: list[tuple] | None = None) -> tuple[list[tuple], int]:
        claimed: dict[tuple[int, int], tuple] = {}
        runs, n = None, 0
        near: dict[int, list[tuple[int, int]]] = {}
        start = _HAN.search(text)
        han = start.start() if start else len(text)
        for rule, needs, spans, keep, evidence in steps:
            parts: Parts = ((0, len(text)),)
            if needs:
                first = min((at for x, far in needs if (at := text.find(x, han if far else 0)) >= 0), default=-1)
                if first < 0:
                    continue
                parts = ((max(first - _AHEAD.get(rule.code, 12), 0), len(text)),)
            if rule.digits:
                if runs is None:
                    runs = _digit_runs(text)
                if rule.digits not in near:
                    near[rule.digits] = _around(runs, rule.digits)
                parts = near[rule.digits]
                if not parts:
                    continue
            earlier = set(claimed) if rule.unclaimed else ()
            for s, e in spans(text, parts):
                if (s, e) in earlier or not keep(text, s, e):
                    continue
                source = evidence(text[s:e])
                if source is not None:
                    n += 1
                    had = claimed.get((s, e))
                    if had is None or rank[source] < rank[had[3]]:
                        claimed[s, e] = rule.code, text[s:e], 1.0 if source == "checksum" else 0.9, source
        for s, e, entity, value, confidence, source in extra or ():
            n += 1
            had = claimed.get((s, e))
            if had is None or rank.get(source, -1) < rank.get(had[3], -1):
                claimed[s, e] = entity, value, confidence, source
        found = [(s, e, *m) for (s, e), m in sorted(claimed.items())]
        head = _first_head(text) if found else -1
        if head >= 0:  # else there is nothing to be part of
            found = [m for m in found if m[1] <= head or not _in_token(text, m[0], m[1])]
        return found, n

    return one


def finder(rules: Iterable[Rule], most: int | None, more: bool = False, own: bool = False) -> Callable[..., pa.Array]:
    """A function from texts (with ``more``, and arrays of other matches; with ``own``, and what was applied to them) to FOUND: matches by position, and how many there were.

    More than ``most``: null.  With ``own``, what lies inside the applied tokens is left out, but counts in that number.
    """
    one = searcher(rules)

    def all_of(texts: pa.Array, extra: pa.Array | None = None, applied: pa.Array | None = None) -> pa.Array:
        rows, count = [], []
        columns = (tuples(a) if a is not None else repeat(None) for a in (extra, applied))
        for text, others, done in zip(values(texts), *columns):
            found, n = (None, None) if text is None else one(text, others)
            if n is not None and most is not None and n > most:
                found = None
            rows.append(outside(found, done) if own and found is not None else found)
            count.append(n)
        return pa.StructArray.from_arrays([lists(MATCH, rows), pa.array(count, pa.int32())], fields=list(FOUND))

    def alone(texts: pa.Array) -> pa.Array:
        return by_rows(all_of, texts)

    def beside(texts: pa.Array, extra: pa.Array) -> pa.Array:
        return by_rows(all_of, texts, extra)

    def after(texts: pa.Array, applied: pa.Array) -> pa.Array:
        return by_rows(lambda t, a: all_of(t, None, a), texts, applied)

    return after if own else beside if more else alone

"""Personal data by offset-preserving deobfuscation.

Base detectors run over the source text. Then transducers rewrite what disguises an identifier - look-alike letters and digits, invisible
signs, spelled digits, at/dot in words or brackets - into a normalised text that keeps, for each run of characters, the source characters it
came from. The same detectors run over the normalised text, and what they find is mapped back to source offsets. Base spans always stay;
a span inside a base span of its kind adds nothing. All scanners are linear in the text, whatever it holds.

Defined results: a null text is empty and has no spans, and stays null when masked; offsets count code points, ends are exclusive; repeated rows are scanned each; overlapping
spans of several kinds are all reported, and masked together; an empty table gives an empty table; other columns go along as they are.
"""

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortline.llm.common import pieces, slim

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(t: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > done and t[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        end = at
        if lo < at and (m := _DOMAIN.match(t, at + 1)):
            end = done = m.end()
            out.append((lo, end))
        at = t.find("@", max(at + 1, end))
    return out


def ips(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _CHAIN.finditer(t):
        if m.end() - m.start() < 7:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):  # a match takes four parts from where the last one ended
            four = parts[i:i + 4]
            n = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in four):
                out.append((at, at + n))
            at += n + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(t: str) -> list[tuple[int, int]]:
    if "+" not in t:
        return []
    return [m.span() for m in _PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("email", *s) for s in emails(t)] + [("ip", *s) for s in ips(t)] + [("card", *s) for s in cards(t)] + [("phone", *s) for s in phones(t)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# --- transducers -----------------------------------------------------------------------------------------------------

#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеіјорсухѕԁɡһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTXYaeijopcyxsdghqwABEZHIKMNOPTYXoav"))
#: Signs without width.
INVISIBLE = "​‌‍⁠﻿­"
#: Signs that stand for the ones detectors know.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "﹢": "+", "－": "-", "‐": "-", "‑": "-", "–": "-", "−": "-", "（": "(", "）": ")", " ": " ", " ": " ", " ": " ", "　": " "}
#: Spelled digits, in four languages.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words for signs between spelled digits.
BETWEEN = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-"}
AT, DOT = r"(?:at|arroba|arobase|ät)", r"(?:dot|punkt|point|punto)"
#: Last labels that make a spaced at/dot disguise anywhere; prose has "at ... dot ..." too, so others need more around them.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|uk|de|fr|es|it|eu|us|ca|at|ch|nl|me|dev|app|test|example|invalid"

_MARKS = "".join(LOOKALIKES) + INVISIBLE + "".join(SIGNS)
_OTHER_DIGITS = {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd" or 0x2460 <= c <= 0x2468 or 0x2070 <= c <= 0x2089 and unicodedata.digit(chr(c), None) is not None}
_WIDE = {chr(c): chr(c - 0xFEE0) for c in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]}
_ONE = {**{c: "" for c in INVISIBLE}, **LOOKALIKES, **_OTHER_DIGITS, **_WIDE, **SIGNS}
_MARK = re.compile("[" + "".join(map(re.escape, _ONE)) + "]")
_WORDS = "|".join(sorted({*DIGITS, *BETWEEN}, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{_WORDS}|[0-9]+)(?:[\s,]+|[ ]?-[ ]?)){{6,}}(?:{'|'.join(sorted(DIGITS, key=len, reverse=True))}|[0-9]+)(?![^\W_])", re.I)
_SPELLED_WORD = re.compile(rf"{_WORDS}|[0-9]+", re.I)
_BRACKET = re.compile(rf"\s*[\[({{<]\s*(?:({AT}|@)|({DOT}|\.))\s*[\])}}>]\s*", re.I)
_SPACED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:(?:\.|\s+{DOT}\s+)[A-Za-z0-9_%+-]+)*\s+{AT}\s+[A-Za-z0-9-]+(?:(?:\.|\s+{DOT}\s+)[A-Za-z0-9-]+)*(?:\.|\s+{DOT}\s+)(?:{ENDINGS})\b", re.I)
_SPACED_ANY = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:(?:\.|\s+{DOT}\s+)[A-Za-z0-9_%+-]+)*\s+{AT}\s+([A-Za-z0-9-]+)(?:(?:\.|\s+{DOT}\s+)[A-Za-z0-9-]+)*(\.|\s+{DOT}\s+)([A-Za-z]{{2,}})(?![A-Za-z0-9-])", re.I)
#: A word for mail shortly before lets any ending count.
_CONTACT = re.compile(r"\b(?:e-?mails?|mailto|mail|contact|write|reach|schreib\w*|kontakt\w*|adresse|correo|escrib\w*|contacto|courriel|écri\w*|contacte\w*)\b", re.I)
#: Without one, an ending of two letters counts after a spelled dot, unless these words make it prose.
_PROSE_LABEL = frozenset("a an the this that these those each every any some one no its his her their our my your der die das den dem ein eine einem le la les un une el los las una".split())
_PROSE_END = frozenset("an as be by do he if in is it my no of on or so to up us we am da du er es im in um wo zu ob et en el la le ne on ou se te tu un al lo mi si su ya yo".split())
_HALF = re.compile(rf"(?<=[A-Za-z0-9._%+-])@[A-Za-z0-9-]+(?:\s+{DOT}\s+[A-Za-z0-9-]+)*\s+{DOT}\s+[A-Za-z]{{2,}}(?![A-Za-z0-9-])|(?<=[A-Za-z0-9._%+-])@[A-Za-z0-9-]+(?:(?:\.|\s+{DOT}\s+)[A-Za-z0-9-]+)*\s+{DOT}\s+(?:{ENDINGS})\b", re.I)
_DOT_SIGN = re.compile(rf"\s+{DOT}\s+", re.I)
_SPACED_SIGN = re.compile(rf"\s+({AT}|{DOT})\s+", re.I)
_MAY_SPACE = re.compile(rf"\s{AT}\s+\S+(?:\s+{DOT}\s|\.[A-Za-z])", re.I)


class Normal:
    """A text with, for each run, where it came from: starts[i] in the text is source[i]; kept runs have equal lengths, rewritten ones have ends."""

    def __init__(self, text: str):
        self.text, self.out, self.source, self.ends = text, [0], [0], [len(text)]

    def back(self, start: int, end: int) -> tuple[int, int]:
        i = bisect.bisect_right(self.out, start) - 1
        j = bisect.bisect_left(self.out, end) - 1
        first = self.source[i] + (start - self.out[i] if self._kept(i) else 0)
        last = self.source[j] + (end - self.out[j]) if self._kept(j) else self.ends[j]
        return first, last

    def _kept(self, i: int) -> bool:
        n = (self.out[i + 1] if i + 1 < len(self.out) else len(self.text)) - self.out[i]
        return n == self.ends[i] - self.source[i]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Normal":
        """A new normal text, edits being (start, end, instead) over this one's text, in order."""
        if not edits:
            return self
        text, new, at = [], Normal(""), 0
        new.out, new.source, new.ends, n = [], [], [], 0

        def add(lo: int, hi: int, instead: str) -> None:
            nonlocal n
            if instead:
                a, b = self.back(lo, hi)
                new.out.append(n), new.source.append(a), new.ends.append(b)
                text.append(instead)
                n += len(instead)

        def keep(lo: int, hi: int) -> None:  # run by run, so that offsets inside each stay exact
            while lo < hi:
                i = bisect.bisect_right(self.out, lo) - 1
                end = min(hi, self.out[i + 1] if i + 1 < len(self.out) else len(self.text))
                add(lo, end, self.text[lo:end])
                lo = end

        for lo, hi, instead in edits:
            keep(at, lo)
            add(lo, hi, instead)
            at = hi
        keep(at, len(self.text))
        new.text = "".join(text)
        return new if new.out else Normal("")


def spaced(s: str) -> list[re.Match]:
    """Spaced at/dot disguises in order: those with a known ending, then others that what is around them makes likely."""
    found = list(_SPACED.finditer(s))
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    for m in _SPACED_ANY.finditer(s):
        i = bisect.bisect_left(starts, m.end())
        if i and ends[i - 1] > m.start():
            continue
        spelled_end = not m[2].startswith(".") and len(m[3]) == 2 and m[3].lower() not in _PROSE_END
        if m[1].lower() not in _PROSE_LABEL and (spelled_end or _CONTACT.search(s, max(0, m.start() - 40), m.start())):
            found.append(m)
    return sorted(found, key=lambda m: m.start())


def normalised(t: str) -> Normal | None:
    """The text without disguises; None if it has none."""
    plain = t.isascii()
    now = Normal(t)
    if not plain:
        now = now.rewrite([(m.start(), m.end(), _ONE[m.group()]) for m in _MARK.finditer(t)])
    s = now.text
    edits = [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKET.finditer(s)] if re.search(r"[\[({<]\s*(?i:at|dot|@|\.|arroba|arobase|ät|punkt|point|punto)\s*[\])}>]", s) else []
    now = now.rewrite(edits)
    s, edits = now.text, []
    if _MAY_SPACE.search(s):
        for m in spaced(s):
            for w in _SPACED_SIGN.finditer(s, m.start(), m.end()):
                edits.append((w.start(), w.end(), "." if re.fullmatch(DOT, w[1], re.I) else "@"))
    now = now.rewrite(edits)
    s = now.text
    now = now.rewrite([(w.start(), w.end(), ".") for m in _HALF.finditer(s) for w in _DOT_SIGN.finditer(s, m.start(), m.end())] if "@" in s else [])
    s, edits = now.text, []
    for m in _SPELLED.finditer(s):
        at = m.start()
        for w in _SPELLED_WORD.finditer(s, m.start(), m.end()):
            if at < w.start() and at > m.start():
                edits.append((at, w.start(), ""))
            word = w.group().lower()
            edits.append((w.start(), w.end(), DIGITS.get(word) or BETWEEN.get(word) or word))
            at = w.end()
    now = now.rewrite(edits)
    return None if now.text == t else now


def spans(t: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans)."""
    base = base_spans(t)
    normal = normalised(t)
    if normal is None:
        return base, base
    taken: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for k, a, b in base:
        taken[k].append((a, b))
    added = set()
    for k, a, b in base_spans(normal.text):
        a, b = normal.back(a, b)
        i = bisect.bisect_right(taken[k], (a, len(t)))
        if a < b and not (i and b <= taken[k][i - 1][1]):
            added.add((k, a, b))
    return base, sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(t: str) -> str:
    """Every span, overlapping ones together, as [KIND] of the first."""
    out, at = [], 0
    for k, a, b in spans(t)[1]:
        if a >= at:
            out += [t[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + t[at:]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""

    def scan(batches):
        for batch in batches:
            for b in pieces(batch):
                rows = []
                for t in b.column(1).to_pylist():
                    base, every = spans(t)
                    rows.append((*(sum(k == x[0] for x in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
                cols = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return slim(docs, text_col).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with spans masked in place; the length column, if there is one of numbers or text, follows."""

    def mask(batches):
        for batch in batches:
            for b in pieces(batch):
                texts = [None if t is None else redact(t) for t in b.column(text_col).to_pylist()]
                names = b.schema.names
                cols = [b.column(i) for i in range(b.num_columns)]
                cols[names.index(text_col)] = pa.array(texts, pa.string())
                if length_col in names:
                    i = names.index(length_col)
                    if pa.types.is_integer(cols[i].type) or pa.types.is_floating(cols[i].type) or pa.types.is_string(cols[i].type):
                        cols[i] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[i].type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(mask, docs.schema)

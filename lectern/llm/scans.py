"""Repair of text recognised from scanned pages.

Lines of a text are the pieces between line feeds and form feeds. The operator
finds running heads and feet, page numbers, words broken over lines and wrongly
recognised words, and rebuilds continuous paragraphs from what remains.

*Words.* A symmetric-delete index over the frequency lexicon (words and weights of
the vocabulary, counts of the corpus) gives the candidates of an unknown token;
a weighted edit distance, in which the usual confusions of recognition cost
little, and the counts of word pairs over the whole corpus pick the repair. Words
broken by a stray blank and words run together are joined and parted by the same
lexicon. A word in capitals in mid-sentence is taken for a name and left alone.

*Pages.* Page numbers are told by their form, by what surrounds them and by the
rows of a table, which they are not part of. Heads are told by a page number on
the line, by capitals, by the record's own title and creators, by being repeated
with small differences within the text, and by standing at a page edge without
being prose or a section heading.

Defined results: null and empty texts have no line and give an empty text; lines
are numbered from 1; a text without damage comes out with its paragraphs
unwrapped; tokens without a candidate (codes, sequences, other languages) stay as
they are; repeated rows of an item are treated alike and reported once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What recognition takes for what, (read, true).
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("j", "i"), ("i", "j"), ("l", "i"), ("i", "l"), ("u", "n"),
    ("n", "u"), ("o", "a"), ("a", "o"), ("a", "e"), ("e", "a"), ("c", "o"), ("o", "c"), ("v", "y"), ("y", "v"), ("ä", "a"), ("ö", "o"), ("ü", "u"),
    ("é", "e"), ("è", "e"), ("ſ", "f"), ("ſ", "s"), ("f", "s"), ("1", "l"), ("1", "i"), ("l", "1"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("0", "o"), ("5", "s"), ("8", "b"),
    ("6", "b"), ("9", "g"), ("q", "g"), ("g", "q"), ("2", "z"), ("3", "e"), ("4", "a"), ("7", "t"), ("$", "s"), ("€", "e"), ("(", "c"), ("rn", "m"),
    ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("m", "in"), ("in", "m"), ("m", "ni"), ("n", "ri"), ("ri", "n"), ("li", "h"), ("h", "li"), ("fi", "h"), ("tl", "d"), ("nn", "m"), ("iu", "m"), ("ii", "u"), ("u", "ii"), ("u", "ll"),
)
# Headings of sections, which are text.
SECTION_HEADINGS = frozenset(
    "abstract summary introduction background methods method materials results discussion conclusion conclusions references bibliography "
    "acknowledgements acknowledgments appendix notes contents preface sources data analysis findings limitations literature".split()
)
#: Marks that break a word at the end of a line.
BREAK = re.compile(r"[^\s]*?([^\W\d_][^\s]*?)([-­¬‐‑])")
_MARKS = frozenset("-­¬‐‑")
_ENDS = frozenset(".!?:\"”’)")
_EDGE = "\"'“”‘’„«»()[]{}.,;:!?…–—*"
_TABLE = re.compile(r"\s*[\d.,%OlI]+(?:\s{2,}[\d.,%OlI]+)+\s*$")
_D = "[0-9OoQDlIi|!SsBZzGgqb]"
_DIGITS = str.maketrans("OoQDlIi|!SsBZzGgqb", "0000111115582269" + "96")
_NUMBER_FORMS = tuple(
    re.compile(p)
    for p in (
        rf"[-–—~]+\s*({_D}{{1,4}})\s*[-–—~]+",
        rf"[\[(]\s*({_D}{{1,4}}|[ivxlc]{{1,9}})\s*[\])]",
        rf"(?:p|pp|pg|s)\s?\.\s*({_D}{{1,4}}|[ivxlc]{{1,9}})",
        rf"[PpFf][a-zäA-Z0-9]{{2,3}}\s+({_D}{{1,4}})\s+[o0ec][ft]\s+{_D}{{1,4}}",
        rf"[Pp][aä]ge\s+({_D}{{1,4}})",
    )
)
_BARE = re.compile(rf"{_D}{{1,4}}")
_ROMAN = re.compile(r"(?=[ivxlcdm1])(?:m{0,3})(?:cm|cd|d?c{0,3})(?:xc|xl|x[l1]|[l1]?x{0,3})(?:ix|iv|v?[i1lj!]{0,3})", re.IGNORECASE)
_GAP_HEAD = re.compile(rf"\s*(?:({_D}{{1,4}}|[ivxlc]{{1,9}})\s{{2,}}(\S.*?)|(\S.*?)\s{{2,}}({_D}{{1,4}}|[ivxlc]{{1,9}}))\s*")
_YEAR = re.compile(r"1[5-9]\d\d|20\d\d")


class Lexicon:
    """A frequency lexicon with its symmetric-delete index and word-pair counts."""

    def __init__(self, weights: dict[str, int], pairs: dict[tuple[str, str], int] | None = None, distance: int = 2):
        self.weights, self.pairs, self.distance = weights, pairs or {}, distance
        self.longest = max(map(len, weights), default=0)
        self.index: dict[str, list[str]] = {}
        for word in weights:
            for d in self._deletes(word):
                self.index.setdefault(d, []).append(word)
        self.confusions: dict[str, list[tuple[str, str]]] = {}
        for read, true in CONFUSIONS:
            self.confusions.setdefault(read[-1] + true[-1], []).append((read, true))
        self._memo: dict[str, tuple[tuple[str, float], ...]] = {}

    def __contains__(self, word: str) -> bool:
        return word in self.weights

    def _deletes(self, word: str) -> set[str]:
        seen = {word}
        layer = {word}
        for _ in range(self.distance):
            layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
            seen |= layer
        return seen

    def cost(self, read: str, true: str) -> float:
        """Weighted edit distance; a usual confusion costs 0.4, any other edit 1, a swap of neighbours 1."""
        n, m = len(read), len(true)
        d = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(n + 1):
            for j in range(m + 1):
                if not i or not j:
                    d[i][j] = float(i + j)
                    continue
                a, b = read[i - 1], true[j - 1]
                best = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a != b))
                for x, y in self.confusions.get(a + b, ()):
                    if read.endswith(x, 0, i) and true.endswith(y, 0, j):
                        best = min(best, d[i - len(x)][j - len(y)] + 0.4)
                if i > 1 and j > 1 and a == true[j - 2] and read[i - 2] == b:
                    best = min(best, d[i - 2][j - 2] + 1)
                d[i][j] = best
        return d[n][m]

    def candidates(self, token: str) -> tuple[tuple[str, float], ...]:
        """(word, cost) of the lexicon words that a lower-case token may have been, best first."""
        found = self._memo.get(token)
        if found is None:
            if len(token) > self.longest + self.distance:
                found = ()
            else:
                words = {w for d in self._deletes(token) for w in self.index.get(d, ())}
                limit = 0.9 if len(token) <= 3 else 1.3 if len(token) <= 5 else 2.0
                scored = [(w, self.cost(token, w)) for w in words]
                found = tuple(sorted(((w, c) for w, c in scored if c <= limit), key=lambda x: (x[1], -self.weights[x[0]], x[0])))
            if len(self._memo) < 500_000:
                self._memo[token] = found
        return found

    def best(self, token: str, before: str = "", after: str = "") -> str | None:
        """The repair of a token between its neighbours: cheapest first, near-ties by word pairs of the corpus."""
        found = self.candidates(token)
        if len(found) < 2 or found[1][1] - found[0][1] > 0.45:
            return found[0][0] if found else None
        near = [x for x in found if x[1] - found[0][1] <= 0.45]
        return min(
            near,
            key=lambda x: (-min(1, self.pairs.get((before, x[0]), 0)) - min(1, self.pairs.get((x[0], after), 0)), x[1], -self.pairs.get((before, x[0]), 0) - self.pairs.get((x[0], after), 0), -self.weights[x[0]], x[0]),
        )[0]


# --- lines ----------------------------------------------------------------------------------------------------


def cut_lines(text: str) -> tuple[list[str], list[str]]:
    """The lines of a text and the separator after each."""
    parts = re.split(r"([\n\f])", text)
    return [x.rstrip("\r") for x in parts[::2]], [*parts[1::2], ""]


def number_value(line: str) -> tuple[int, str] | None:
    """(value, form) of a line that can be a page number; value -1 where it can't be read."""
    s = line.strip()
    if not s:
        return None
    for k, form in enumerate(_NUMBER_FORMS):
        if m := form.fullmatch(s):
            return _value(m.group(1)), f"form{k}"
    if _BARE.fullmatch(s) and (any(c.isdigit() for c in s) or set(s) <= set("lIO|")):
        return _value(s), "bare"
    if len(s) <= 9 and _ROMAN.fullmatch(s):
        return -1, "roman"
    return None


def _value(s: str) -> int:
    t = s.translate(_DIGITS)
    return int(t) if t.isdigit() else -1


def _core(line: str) -> str:
    """A head without its page number, case and punctuation."""
    m = _GAP_HEAD.fullmatch(line)
    s = (m.group(2) or m.group(3)) if m else line
    return re.sub(r"[^\w]+", " ", s).strip().casefold()


def _alike(a: str, b: str, least: float = 0.82) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 0.25 * max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def _own_heads(title: str | None, creators: str | None) -> tuple[str, list[str]]:
    names = []
    for part in (creators or "").split(";"):
        last = part.split(",")[0].strip()
        if len(last) > 2:
            names.append(_core(last))
    return _core(title or ""), names


def _is_heading(line: str) -> bool:
    words = re.findall(r"[^\W\d_][^\W_]*", line)
    core = re.sub(r"^[\s\d.)]+", "", line).strip().casefold()
    if len(words) > 2 or not core:
        return False
    return core in SECTION_HEADINGS or any(_alike(core, h, 0.75) for h in SECTION_HEADINGS if abs(len(h) - len(core)) <= 2)


def find_furniture(lines: list[str], seps: list[str], title: str | None, creators: str | None, lex: Lexicon) -> dict[int, str]:
    """Index of each line that is page furniture: ``header`` or ``page_number``."""
    n = len(lines)
    full = [i for i in range(n) if lines[i].strip()]
    if len(full) < 2:
        return {}
    found: dict[int, str] = {}
    rank = {i: r for r, i in enumerate(full)}
    feeds = [0]  # form feeds before each line
    for sep in seps:
        feeds.append(feeds[-1] + (sep == "\f"))

    def prev(i: int) -> int | None:
        return full[rank[i] - 1] if rank[i] else None

    def next_(i: int) -> int | None:
        return full[rank[i] + 1] if rank[i] + 1 < n_full else None

    n_full = len(full)

    def broken_before(i: int) -> bool:
        r = rank[i]
        return not r or feeds[i] > feeds[full[r - 1]]

    def broken_after(i: int) -> bool:
        r = rank[i] + 1
        return r == n_full or feeds[full[r]] > feeds[i]

    own_title, own_names = _own_heads(title, creators)
    has_feed = "\f" in seps
    numbers = {i: v for i in full if (v := number_value(lines[i]))}
    for i, (value, form) in numbers.items():
        if form.startswith("form"):
            found[i] = "page_number"
    # bare numbers and Roman ones; years that end a table are taken out again below
    plain = {i: v for i, v in numbers.items() if i not in found}
    for i in plain:
        found[i] = "page_number"
    # heads with the page number on the line
    for i in full:
        if i in found:
            continue
        line = lines[i]
        if "  " not in line.strip():
            continue
        if (m := _GAP_HEAD.fullmatch(line)) and not _TABLE.match(line):
            text = m.group(2) or m.group(3)
            number = m.group(1) or m.group(4)
            if sum(c.isalpha() for c in text) >= 3 and (any(c.isdigit() for c in number) or _ROMAN.fullmatch(number) or set(number) <= set("lIO|")):
                found[i] = "header"
    widths = sorted(len(lines[i].rstrip()) for i in full)
    width = widths[int(0.9 * (len(widths) - 1))]
    full_width = max(100, width)  # of the text itself, however wide it was set
    shorts, edge = [], {}
    title_start = own_title[:4]
    for i in full:
        if i in found or lines[i][0].isspace():
            continue
        s = lines[i].strip()
        if len(s) > full_width:
            continue  # a whole line of running text, or a paragraph on one line
        at_edge = broken_before(i) or broken_after(i) or any(x is not None and x in found for x in (prev(i), next_(i)))
        if not at_edge and s.count(" ") > 5 and sum(map(str.isupper, s[:8])) < 4 and s[:4].casefold() != title_start:
            continue  # a line of running text
        letters = [c for c in s if c.isalpha()]
        if len(letters) < 3 or _TABLE.match(lines[i]) or _is_heading(s):
            continue
        capitals = len(letters) >= 4 and sum(map(str.isupper, letters)) >= 0.8 * len(letters)
        edge[i] = at_edge
        shorts.append((i, s, _core(s), capitals))
    cores = [c for i, _, c, _ in shorts if edge[i]] + [_core(lines[i]) for i in found if found[i] == "header"]
    counts = Counter(cores)
    distinct = sorted(counts)

    def is_repeated(core: str) -> bool:
        return counts[core] > 1 or any(o != core and _alike(core, o, 0.85) for o in distinct)

    for i, s, core, capitals in shorts:
        by_title = bool(own_title) and len(core) >= 8 and (own_title.startswith(core) or _alike(core, own_title[: len(core)], 0.85))
        closed = s[-1] in ".,;:?!-­¬" and not _ET_AL_END.search(s) and not (s[-1] == "?" and by_title)
        if capitals:
            found[i] = "header"
            continue
        if len(s) <= 40 and len(core.split()) <= 4:
            bare = re.sub(r" (\S?e\S? \S{1,3}|\S*\d\S*)$", "", core)
            if bare in own_names or _ET_AL.fullmatch(s) or _NAME_YEAR.fullmatch(s) or (len(bare) > 3 and any(_alike(bare, x) for x in own_names)):
                found[i] = "header"
                continue
        if closed:
            continue
        short = len(s) < 0.8 * width
        words = [w.strip(_EDGE).lower() for w in s.split()]
        prose = all(w in lex for w in words)
        apart = i > 0 and not lines[i - 1].strip() or i + 1 < n and not lines[i + 1].strip()
        if by_title and (edge[i] or apart or is_repeated(core)):
            found[i] = "header"
        elif edge[i] and (short or not prose) and is_repeated(core):
            found[i] = "header"
        elif short and not prose and (edge[i] or apart and s[0].isupper()) and _head_like(s):
            found[i] = "header"
        elif short and not prose and not edge[i] and _interrupts(lines[full[rank[i] - 1]], s, lines[full[rank[i] + 1]], lex):
            found[i] = "header"
    # a bare year below the rows of a table is its last row, unless it is next to other page numbers in count
    values = {i: v[0] for i, v in plain.items() if v[1] == "bare"}
    last_rows = set()
    for i, value in values.items():
        r = rank[i] - 1
        while r >= 0 and full[r] in found:
            r -= 1
        if 1500 <= value <= 2099 and r >= 0 and _TABLE.match(lines[full[r]]):
            last_rows.add(i)
    pages = [w for j, w in values.items() if j not in last_rows]
    for i in last_rows:
        if not any(abs(w - values[i]) <= 2 for w in pages):
            del found[i]
    return found


_ET_AL_END = re.compile(r"\be\S?\s*[a1l]\S?\s*\.$", re.IGNORECASE)
_ET_AL = re.compile(r"[^\W\d_][^\s,]*(?:\s[^\s,]+)?\s*\b[ec]\S\s?\S{1,2}\.?")
_NAME_YEAR = re.compile(r"[^\W\d_][^,;]{1,24}:\s*\S?\d\S{2,3}")


def _interrupts(before: str, s: str, after: str, lex: Lexicon) -> bool:
    """Whether a line stands inside a word broken over it, or as a label inside a sentence."""
    if broken_word(before, after, lex) and not broken_word(before, s, lex):
        return True
    return s[0].isupper() and _head_like(s) and before.rstrip()[-1:].isalpha() and after.strip()[:1].islower()


def _head_like(s: str) -> bool:
    """A short label (a series, a copy note, a volume) rather than the end of a sentence."""
    words = s.split()
    return len(words) <= 7 and (bool(re.search(r"\d+\.?$", s)) or bool(re.search(r"[,:]\s*[^\W\d_]\S*$", s)) or bool(re.match(r"[^\W\d_]\S*\s+\S{1,3}\s+[^\W\d_]\S*$", s)))


# --- words ----------------------------------------------------------------------------------------------------


def split_edges(token: str) -> tuple[str, str, str]:
    """Leading marks, word, trailing marks; marks that recognition puts for letters stay in the word."""
    a, b = 0, len(token)
    while a < b and token[a] in _EDGE and not (token[a] == "!" and b - a > 2):
        a += 1
    while b > a and token[b - 1] in _EDGE:
        b -= 1
    return token[:a], token[a:b], token[b:]


def _wordish(word: str) -> bool:
    letters = sum(c.isalpha() for c in word)
    return letters >= 1 and letters * 2 >= len(word)


class LineReader:
    """Token repairs of one line after another; remembers tokens already judged."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.fine: dict[str, bool] = {}

    def known(self, token: str) -> bool:
        ok = self.fine.get(token)
        if ok is None:
            word = split_edges(token)[1]
            low = word.lower()
            ok = not word or low in self.lex or not any(c.isalpha() for c in word)
            if not ok and "-" in word:
                ok = all(p in self.lex for p in low.split("-"))
            if len(self.fine) < 2_000_000:
                self.fine[token] = ok
        return ok

    def repair(self, tokens: list[str], starts: bool, skip_first: bool, skip_last: bool) -> list[tuple[int, int, str]]:
        """(from, to, text): tokens [from, to) that were wrongly recognised and what they should be."""
        fine = self.fine
        odd = [i for i, t in enumerate(tokens) if not (fine[t] if t in fine else self.known(t))]
        if not odd:
            return []
        lex, out = self.lex, []
        low_end, high_end = int(skip_first), len(tokens) - int(skip_last)
        done = low_end
        for i in odd:
            if i < done or i >= high_end:
                continue
            if joined := self._joined(tokens, i, done, high_end):
                out.append(joined)
                done = joined[1]
                continue
            lead, word, trail = split_edges(tokens[i])
            if not _wordish(word):
                continue
            low = word.lower()
            first = starts and not i or bool(i) and tokens[i - 1][-1] in ".!?"
            before = split_edges(tokens[i - 1])[1].lower() if i else ""
            after = split_edges(tokens[i + 1])[1].lower() if i + 1 < len(tokens) else ""
            fixed = None
            if word[0].isupper():
                # a name, unless it is all but a word of the lexicon, by confusions only
                best = lex.candidates(low)
                if best and best[0][1] <= (0.85 if first else 0.45) and (first or len(low) > 3):
                    fixed = lex.best(low, before, after)
            else:
                fixed = lex.best(low, before, after)
            if fixed is None and (first or not word[0].isupper()):
                fixed = self._parted(low)
            if fixed is not None:
                if word[0].isupper() or first and word[0] in "01!":
                    fixed = fixed[:1].upper() + fixed[1:]
                out.append((i, i + 1, lead + fixed + trail))
                done = i + 1
        return out

    def _joined(self, tokens: list[str], i: int, low_end: int, high_end: int) -> tuple[int, int, str] | None:
        """A blank inside a word: two or three fragments around token i that only together are a word."""
        for a, b in ((i, i + 2), (i - 1, i + 1), (i, i + 3), (i - 1, i + 2), (i - 2, i + 1)):
            if a < low_end or b > high_end:
                continue
            parts = [split_edges(t) for t in tokens[a:b]]
            if any(p[0] for p in parts[1:]) or any(p[2] for p in parts[:-1]):
                continue
            whole = "".join(p[1] for p in parts)
            if whole.lower() in self.lex and not whole[1:2].isupper():
                return a, b, parts[0][0] + whole + parts[-1][2]
        return None

    def _parted(self, low: str) -> str | None:
        """Two words run together, with or without a stray mark in place of the blank."""
        for k in range(1, len(low)):
            a = low[:k]
            if a in self.lex and (len(a) > 1 or a == "a"):
                for b in (low[k:], low[k + 1 :]):
                    if len(b) > 1 and b in self.lex and len(a) + len(b) > 4:
                        return f"{a} {b}"
        return None


def broken_word(line: str, following: str, lex: Lexicon) -> tuple[str, str, str] | None:
    """(the part here, the part on the following line, the whole word) if the last word of a line goes on there."""
    if line.rstrip()[-1:] not in _MARKS:
        return None
    m = BREAK.fullmatch(line.split()[-1])
    nxt = following.split(None, 1)
    if not m or not nxt:
        return None
    _, a, _ = split_edges(m.group(1))
    tail = nxt[0]
    _, b, _ = split_edges(tail)
    if not a or not b or not a[-1].isalpha() or not (b[0].isalpha() or b[0] in "0158!"):
        return None
    low_a, low_b = a.lower(), b.lower()
    if low_a + low_b in lex:
        return a, b, a + b
    if f"{low_a}-{low_b}" in lex:
        return a, b, f"{a}-{b}"
    if "-" in low_b and low_a + low_b.split("-")[0] in lex:
        return a, b, a + b
    if b[0].isupper() and not a.isupper():
        return None
    if low_a in lex and low_b in lex:  # two whole words: a mark that recognition added
        return None
    if fixed := lex.best(low_a + low_b):
        return a, b, fixed[:1].upper() + fixed[1:] if a[:1].isupper() else fixed
    if hyphened := lex.best(f"{low_a}-{low_b}"):
        return a, b, hyphened
    return a, b, a + b


def examine(text: str, title: str | None, creators: str | None, reader: LineReader) -> Iterator[tuple[int, str]]:
    """(line_no, defect) of one text."""
    lines, seps = cut_lines(text)
    furniture = find_furniture(lines, seps, title, creators, reader.lex)
    for i in sorted(furniture):
        yield i + 1, furniture[i]
    body = [i for i in range(len(lines)) if i not in furniture and lines[i].strip()]
    carried = False
    starts = True
    for at, i in enumerate(body):
        line = lines[i]
        broken = broken_word(line, lines[body[at + 1]], reader.lex) if at + 1 < len(body) else None
        if broken:
            yield i + 1, "hyphen"
        if not _TABLE.match(line):
            tokens = line.split()
            if reader.repair(tokens, starts, carried, bool(broken)):
                yield i + 1, "misread"
        carried = bool(broken)
        starts = line.rstrip()[-1:] in ".!?" or _is_heading(line) or bool(_TABLE.match(line))


def rebuild(text: str, title: str | None, creators: str | None, reader: LineReader) -> str:
    """The text as continuous paragraphs in its true words."""
    lines, seps = cut_lines(text)
    furniture = find_furniture(lines, seps, title, creators, reader.lex)
    body = [i for i in range(len(lines)) if i not in furniture and lines[i].strip()]
    paragraphs: list[list[str]] = []
    carry, starts = None, True  # carry: (rest of a broken word on this line, whole word)
    last = -1
    # a text whose lines mostly end inside a sentence is wrapped; else every line is a paragraph
    wrapped = len(body) > 1 and sum(lines[i].rstrip()[-1:] not in _ENDS for i in body) * 3 > len(body)
    for at, i in enumerate(body):
        line = lines[i]
        table = bool(_TABLE.match(line))
        tokens = line.split()
        broken = broken_word(line, lines[body[at + 1]], reader.lex) if at + 1 < len(body) else None
        repairs = [] if table else reader.repair(tokens, starts, carry is not None, broken is not None)
        for a, b, fixed in reversed(repairs):
            tokens[a:b] = [fixed]
        if carry is not None:
            lead, _, trail = split_edges(tokens[0])
            tokens[0] = lead + carry + trail.lstrip("-­¬")
        if broken:
            tokens[-1:] = []
            carry_next = split_edges(line.split()[-1])[0] + broken[2]
        else:
            carry_next = None
        gap = last >= 0 and any(not lines[k].strip() for k in range(last + 1, i) if k not in furniture)
        page = last >= 0 and (any(seps[k] == "\f" for k in range(last, i)) or any(k in furniture for k in range(last + 1, i)))
        done = not paragraphs or not paragraphs[-1] or paragraphs[-1][-1][-1:] in ".!?:"
        new = carry is None and (
            not paragraphs or not wrapped or table or _is_heading(line) or line[:1].isspace()
            or (gap and (done or not page)) or (last >= 0 and (_is_heading(lines[last]) or _TABLE.match(lines[last])))
        )
        if new:
            paragraphs.append([])
        paragraphs[-1].extend(tokens)
        carry, last = carry_next, i
        starts = line.rstrip()[-1:] in ".!?" or _is_heading(line) or table
    if carry is not None:
        paragraphs[-1].append(carry)
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


# --- corpus statistics and operator -------------------------------------------------------------------------------


def _count_pairs(words: frozenset[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: Counter[tuple[str, str]] = Counter()
        token = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
        for batch in batches:
            for text in batch["fulltext"]:
                run = [w if w in words else "" for w in token.findall(text.lower())]
                pairs.update(zip(run, run[1:], strict=False))
        rows = [(a, b, n) for (a, b), n in pairs.items() if a and b]
        yield pd.DataFrame(rows, columns=["a", "b", "n"])

    return of


def corpus_lexicon(items: DataFrame, lexicon: DataFrame, most_words: int = 20_000) -> Lexicon:
    """The lexicon with the word-pair counts of all full texts.

    The vocabulary is a given table of a fixed language; above ``most_words`` it is
    refused rather than broadcast. Pair counts are summed per task before they are
    shuffled and are at most the square of the vocabulary.
    """
    rows = (
        lexicon.where("word is not null and length(word) > 0")
        .groupBy(F.lower("word").alias("word"))
        .agg(F.max(F.coalesce("weight", F.lit(1))).alias("weight"))
        .limit(most_words + 1)
        .collect()
    )
    if len(rows) > most_words:
        raise ValueError(f"the lexicon has more than {most_words} words")
    weights = {r["word"]: r["weight"] for r in rows}
    counted = (
        items.where("fulltext is not null").select("fulltext")
        .mapInPandas(_count_pairs(frozenset(weights)), "a string, b string, n bigint")
        .groupBy("a", "b").agg(F.sum("n").alias("n"))
    )
    return Lexicon(weights, {(r["a"], r["b"]): r["n"] for r in counted.collect()})


_READERS: dict[str, LineReader] = {}


def _reader(token: str, shared) -> LineReader:
    """One reader a worker and call, so that judged tokens are remembered between batches."""
    if token not in _READERS:
        _READERS.clear()
        _READERS[token] = LineReader(Lexicon(*shared.value))
    return _READERS[token]


def _spread(items: DataFrame) -> DataFrame:
    columns = items.where("item_id is not null and fulltext is not null and length(fulltext) > 0")
    return columns.select("item_id", "title", "creators", "fulltext")


def damaged_lines(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(item_id, line_no, defect): one row per damaged line and kind of damage."""
    lex = corpus_lexicon(items, lexicon)
    shared, token = items.sparkSession.sparkContext.broadcast((lex.weights, lex.pairs)), uuid4().hex  # bounded by the vocabulary

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(token, shared)
        for batch in batches:
            rows = [
                (item, line, defect)
                for item, title, creators, text in batch.itertuples(index=False)
                for line, defect in examine(text, title, creators, reader)
            ]
            yield pd.DataFrame(rows, columns=["item_id", "line_no", "defect"])

    return _spread(items).mapInPandas(of, "item_id bigint, line_no int, defect string").distinct()


def repaired_texts(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(item_id, text): every full text as continuous paragraphs in its true words."""
    lex = corpus_lexicon(items, lexicon)
    shared, token = items.sparkSession.sparkContext.broadcast((lex.weights, lex.pairs)), uuid4().hex  # bounded by the vocabulary

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(token, shared)
        for batch in batches:
            texts = [rebuild(text, title, creators, reader) for _, title, creators, text in batch.itertuples(index=False)]
            yield pd.DataFrame({"item_id": batch["item_id"], "text": texts})

    return _spread(items).mapInPandas(of, "item_id bigint, text string")

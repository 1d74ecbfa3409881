"""Sentence units of documents in many languages and scripts.

A hidden-event n-gram model stands between the words around each full stop that may end a sentence: the event "boundary"
or "no boundary" is not seen, the words are.  The history of an event is the word before the mark; where that word is a
number, or follows one, the word before it counts too (a trigram), as do all frequent pairs of words before a mark.  The
word after the mark counts by its class (capital, small letter, number, script, ...) and, within the class, as a word; a
number, with its unit, by the word behind it.  All probabilities come from counts over the whole corpus, without labels:

* The last full stop of a paragraph is an event that needs no guess.  A word that ends sentences stands at ends of
  paragraphs in a steady share of its cases; an abbreviation, however frequent, never does.
* Expectation maximisation goes on from there to what follows a mark with and without a boundary: first the classes, then
  the words.  Words after certain boundaries begin sentences; words at all gaps without a mark do not.

Words that hold less than one in ``RARE`` of all marks share the counts of their shape, so the model is bounded whatever
the corpus.  Small corpora rest on beliefs that count as a few events (``_LEFT_PRIOR``).  Forward-backward from one certain
boundary to the next, both included, gives the posteriors that decide; that a unit is a single short word is as unlikely as
the corpus says, which couples neighbours.  At a gap without a mark the event is known to be none.

What the definition fixes is no guess and goes before the model: blank lines, full stops of scripts that use them for
nothing else, spaces in Thai, brackets and quotations inside a sentence, claims, marks inside formulas and numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain, compress, count, islice, pairwise
from math import exp, lgamma, log
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genomespark.llm.leaks import _FORMAT

# Abbreviations that a name, number or further word follows.
BINDING = frozenset(
    """fig figs no nos vol vols ch chs chap sec secs sect p pp l ll col cols para paras pat pats app ser eq eqs eqn ref refs ex
    cf e.g i.e viz vs approx ca c resp al wt  dr mr mrs ms prof st mt rev hon gen col lt capt sgt ed eds tab tabs nr abb bzw z d h u
    vgl evtl ggf sog s b bd kap gew abs anspr mind max tabl env p.ex m mme mlle éd par ex id seq incl excl est dept univ
    см табл рис п пп т е д стр гл ст разд ср напр др. г гг им проф акад сс ул тов долл руб млн млрд тыс सं डॉ श्री पृ قم رقم د أ ص""".split()
)
# Abbreviations that may also be the last word of a sentence.
CLOSING = frozenset("etc usw inc ltd corp co llc gmbh ag plc sa jr sr a.m p.m др пр bros dgl".split())
# Words before an ordinal number, and words before a number that is the name of something.
BEFORE_ORDINAL = frozenset("am im vom zum der die das dem den des beim bis ab seit jeder jedem jeden ein einem einen eine einer le la du au på den det".split())
REFERENCE = frozenset("fig figs no nos vol ch sec p pp l ll nr abb abs tab tabl table tables claim claims formula drawing drawings рис табл п пп ref refs art col eq eqs example examples step steps version nos".split())

_MARKS = ".!?…"
_FULL = "。！？｡．؟۔।॥‼⁇⁈⁉"
_STOPS = _FULL.replace("．", "")
_OPEN, _CLOSE = "([{（［｛「『【〈《“«„‘", ")]}）］｝」』】〉》”»“’"
_PAIR = {")": "(（", "）": "(（", "」": "「", "』": "『", "】": "【", "〉": "〈", "》": "《", "”": "“„", "“": "„", "»": "«"}
# Patterns that begin with one set of letters: the scan for the first letter then runs over the set alone.
_SCAN = re.compile(rf'["()（）「」『』【】〈〉《》“”„«»{_MARKS}{_STOPS}](?:(?<=[{_MARKS}])[{_MARKS}]+|(?<=[{_STOPS}])[{_STOPS}]+)?')
_SIGNS = frozenset('"()（）「」『』【】〈〉《》“”„«»')
_NEWLINE = r"(?>\r\n|[\n\r\x85\u2028\u2029])"
_INLINE = r"[^\S\n\r\x85\u2028\u2029]"
_BLANK = re.compile(rf"[\n\r\x85\u2028\u2029](?:(?<=\r)\n)?+{_INLINE}*(?:{_NEWLINE}{_INLINE}*)+")
_BREAK = re.compile(_NEWLINE)
_CLAIM = re.compile(
    r"[^\S\n\r]*(?:\(?([0-9]{1,3})[  ]?[.)、．:](?=\s|[^\W\d_])|(?:claim|anspruch|patentanspruch|revendication|пункт|청구항|दावा)\s+([0-9]{1,3})\s*[:.)]|【\s*請求項\s*([0-9０-９]{1,3})\s*】|【?청구항\s*([0-9]{1,3})】?|ข้อถือสิทธิที่\s*([0-9]{1,3})(?![0-9]))",
    re.I,
)
_THAI = "ก-ฺ฿-๛"
_THAI_GAP = re.compile(rf"(?<=[{_THAI}”’»)\]\"])[  \t -  　]+(?=[^\s0-9A-Za-zÀ-ɏ๐-๙])|(?<=[^\s0-9A-Za-zÀ-ɏ๐-๙])[  \t -  　]+(?=[{_THAI}“‘«(\[\"])")
_HAS_THAI = re.compile(rf"[{_THAI}]")
_LEFT = re.compile(r"[^\s\"“”„«»()（）「」『』【】\[\]{},;:!?。，；：！？]+\Z")
_WORD_BACK = re.compile(_LEFT.pattern.removesuffix(r"\Z"))  # on the letters before a mark, from the mark back
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]\Z")
_NUMBER = re.compile(r"[0-9٠-٩०-९][0-9٠-٩०-९.,·/–-]*[a-zA-Z]?\Z")
_NEXT = re.compile(r"([\"“„«‘'(（「『【\[*_]*)(\S*)")
_WORD = re.compile(r"\S+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_UNIT = re.compile(r"[^\S\n]*(?:[°%‰µμΩ]|(?:[a-zA-Zµ]{1,4}(?:/[a-zA-Z]{1,4})?|bar|Gew|wt|volt|бар|мм|см|мкм|Гц)\b\.?)", re.I)
_MIXED = re.compile(r"[a-z]{1,3}[A-Z]")
_BEFORE_WORD, _AFTER_WORD = "\"“„«‘'(（「『【[*_", ".,;:!?…)]}\"'”»’*_。，；：！？।؟۔"
_WORD_KINDS = {"cap": 1, "mixed": 2, "small": 3, "hangul": 4, "other": 5, "num": 6, "unit": 7}
_PLAIN_NUMBER = re.compile(r"[0-9][0-9.,]*(?<![.,])\Z")
_FIGURES = re.compile(r"[0-9][0-9.,]*")
_MEASURES = frozenset("min max s h d l m g".split())

# All classes, so that a pair of them is a number.
LEFTS = sorted({f"abbr:{a}" for a in BINDING | {"art"}} | {f"may:{a}" for a in CLOSING} | set("initials ordinal num:free num:ref num letter unit:1 dotted sign short word closed mark start".split()))
RIGHTS = sorted({q + r for r in "unit num cjk cap mixed small hangul other sign".split() for q in ("", "q")} | {"open", "none", "end"})
_LEFT_NO, _RIGHT_NO = {c: i for i, c in enumerate(LEFTS)}, {c: i for i, c in enumerate(RIGHTS)}
SURE = -1
#: Upper ends of the scripts that are told apart: Latin, Greek and Cyrillic, Hebrew and Arabic, Indic, Thai, Han and Kana.
_SCRIPTS = ("\u0370", "\u0530", "\u0900", "\u0e00", "\u0e80", "\uac00")
#: A word has counts of its own if it stands before at least one in ``RARE`` of the marks: at most ``RARE`` words do.
RARE = 100_000


def _right(text: str, at: int, end: int) -> str:
    """The class of what follows at ``at`` (no white space there)."""
    c = text[at] if at < end else ""
    if "a" <= c <= "z":
        return "mixed" if _MIXED.match(text, at, end) else "small"
    if "A" <= c <= "Z":
        return "cap"
    if "0" <= c <= "9":
        return _figures(text, at, end)
    m = _NEXT.match(text, at, end)
    word = m.group(2)
    if not word:
        return "open" if m.group(1) else "none"
    c = word[0]
    tag = "q" if m.group(1) else ""
    if c.isalpha():
        return tag + _letter(c, word)
    if c.isdigit():
        return tag + _figures(text, m.start(2), end)
    return tag + (_letter(c, word) if c.isupper() or c.islower() or _CJK.match(c) else "sign")


def _figures(text: str, at: int, end: int) -> str:
    """The class of a number at ``at``: with a unit or without."""
    n = _FIGURES.match(text, at, end)
    return "unit" if n and (u := _UNIT.match(text, n.end(), end)) and u.end() - n.end() > 1 and not text[n.end() : u.end()].strip() in ("was", "were", "and", "to", "of") else "num"


def _letter(c: str, word: str) -> str:
    """The class of a word that begins with the letter ``c``."""
    if c >= "\u3040" and _CJK.match(c):
        return "cjk"
    if c.isupper() or c.istitle():
        return "cap"
    if c.islower():
        return "mixed" if _MIXED.match(word) else "small"
    return "hangul" if "가" <= c <= "힣" else "other"


@lru_cache(maxsize=1 << 16)
def next_code(token: str, *behind: str) -> int:
    """The number of a word that may follow a mark: 57 bits of a hash and its class (``token & 7``), 0 without a letter.

    A number, with its unit, counts by the sign that ends it, else by the word behind it.  Han and Kana letters have no
    blanks between words and count by their class alone.
    """
    if not token.isascii():
        if _CJK.match(token):
            return 0
        token = _FORMAT.sub("", normalize("NFKC", token))
    word = token.lstrip(_BEFORE_WORD).rstrip(_AFTER_WORD)
    if not word:
        return 0
    if "0" <= word[0] <= "9":
        text = " ".join([token, *behind])
        kind = _right(text, 0, len(text)).removeprefix("q")
        last, *rest = [token, *behind]
        if kind == "unit" and rest:
            last, *rest = rest[1:] if rest[1:2] == ["%"] else rest  # wt. %
        word = "#" + (last[-1] if last[-1] in _AFTER_WORD and last != "wt." else rest[0].rstrip(_AFTER_WORD) if rest else "")
    else:
        kind = _letter(word[0], word) if word[0].isalpha() else ""
    if kind not in _WORD_KINDS:
        return 0
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest()) >> 4 & ~7 | _WORD_KINDS[kind]


def _number(token: str) -> str:
    """A number without its figures."""
    return "0" + (token[-1] if token[-1] in _AFTER_WORD else token.lstrip("0123456789.,"))


def next_at(text: str, at: int, end: int) -> int:
    """The number of the word that begins at ``at``."""
    c = text[at]
    if "A" <= c <= "Z" or "a" <= c <= "z":
        return next_code(_WORD.match(text, at, end).group())
    if c >= "\u3040" and _CJK.match(c):
        return 0
    m = _NEXT.match(text, at, end)
    token = m.group(2)
    if "0" <= token[:1] <= "9":
        return next_code(_number(token), *text[m.end() : min(end, m.end() + 60)].split(None, 3)[:3])
    return next_code(token)


def count_words(texts: list[str | None]) -> Counter[int]:
    """How often each word stands in the texts, their first words left out."""
    tokens, seen = Counter(), Counter()
    for text in texts:
        words = text.split() if text else []
        tokens.update(islice(words, 1, None))
        low = compress(count(), map(":".__gt__, words))
        tokens.update([(_number(w), *words[i + 1 : i + 4]) for i in low if (w := words[i]) >= "0" and i])
    code = next_code.__wrapped__
    for token, n in tokens.items():
        if isinstance(token, tuple):
            seen[code(*token)] += n
        elif not "0" <= token < ":":
            seen[code(token)] += n
    del seen[0]
    return seen


def _left(text: str, start: int, at: int) -> str:
    """The class of what stands before the full stop at ``at``."""
    return _history(*_two_words(text, start, at))[1]


def _two_words(text: str, start: int, at: int) -> tuple[str, str]:
    """The word that ends at ``at``, or an edge sign and the letter there, and the word before it."""
    near = text[max(start, at - 60) : at]
    word = near.rsplit(None, 1)[-1] if near[-1:].isalnum() else ""
    if not word.isalnum():  # letters and figures alone need no pattern
        m = _WORD_BACK.match(near[::-1])
        if not m:
            return "<" + near[-1:], ""
        word = m.group()[::-1]
    return word, _before(text, start, at - len(word))


@lru_cache(maxsize=1 << 16)
def _history(word: str, before: str) -> tuple[str, str, int, int]:
    """What two words are as the history of a mark: the history, the class of the left context, the event's number without
    the right class, and the number of the pair of words, 0 where there is but one.

    The history is ``word``, ``word|#`` after a number, or ``#n:before`` for a number of n figures.
    """
    bare = word.strip("*_'’-–—").lower()
    last = before.lower().strip(".,()*_'’-–—")
    after_number = bool(_NUMBER.match(last))
    if _NUMBER.match(bare):
        name = f"#{min(len(bare), 3)}:{'#' if after_number else last}"
    else:
        name = bare + "|#" if after_number else bare
    left = _left_class(word, before)
    pair = f"{before}\0{word}".encode("utf-8", "replace") if before and word[0] != "<" else b""
    pair_key = int.from_bytes(blake2b(pair, digest_size=8).digest()) >> 4 if pair else 0
    return name, left, _name_code(name) | _LEFT_NO[left] * len(RIGHTS), pair_key


@lru_cache(maxsize=1 << 16)
def _name_code(name: str) -> int:
    """The number of a history: 44 bits of a hash and the script, without the classes."""
    key = int.from_bytes(blake2b(name.encode("utf-8", "replace"), digest_size=8).digest()) >> 20
    return key << 16 | _script(name.partition("|")[0]) << 13


def _left_class(word: str, before: str) -> str:
    if word[0] == "<":
        c = word[1:]
        return "closed" if c and (c in _CLOSE or c == '"') else "mark" if c else "start"
    word = word.strip("*_'’-–—")
    low = word.lower()
    if low.rpartition("'")[2] in BINDING or low.rpartition("’")[2] in BINDING:
        if low in _MEASURES and _PLAIN_NUMBER.match(before):
            return "unit:1"
        return f"abbr:{low.rpartition(chr(39))[2].rpartition('’')[2]}"
    if word in ("Art", "Arts"):
        return "abbr:art"
    if low in CLOSING:
        return f"may:{low}"
    if _INITIALS.match(word):
        return "initials"
    if _NUMBER.match(word):
        prev = before.lower().strip(".,(")
        if prev in BEFORE_ORDINAL and len(word) <= 2:
            return "ordinal"
        if prev in ("of", "value", "von", "de") or not prev:
            return "num:free"
        if prev in REFERENCE or prev in BINDING or prev in ("and", "to", "or", "und", "bis", "et", "à", "и", "до"):
            return "num:ref"
        return "num"
    letters = sum(map(str.isalpha, word))
    if letters == 1 and len(word) == 1:
        return "unit:1" if _PLAIN_NUMBER.match(before) else ("letter" if word.isupper() else "word")
    if not letters:
        return "sign"
    if "." in word and not word.endswith("."):
        return "dotted"
    return "word" if letters > 2 else "short"


def _before(text: str, start: int, at: int) -> str:
    """The word before the one that begins at ``at``."""
    part = text[max(start, at - 40) : at].rsplit(None, 1)
    return part[-1].lstrip("(\"“„«") if part else ""


def _spans(text: str, found: list[re.Match]) -> dict[int, int]:
    """Opening -> closing place of brackets and quotations that are closed within the paragraph."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in found:
        c, at = m.group(), m.start()
        if len(c) != 1 or c in _MARKS or c in _FULL:
            continue
        if c == '"':
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == '"'), -1)
            before = text[at - 1] if at else " "
            after = text[at + 1] if at + 1 < len(text) else " "
            opening = (before.isspace() or before in "([{*_-—–:") and not after.isspace()
            if open_at < 0:
                stack.append((c, at))
            elif opening and before.isspace() and _looks_open(text, at):
                del stack[open_at:]
                stack.append((c, at))
            else:
                pairs[stack[open_at][1]] = at
                del stack[open_at:]
        elif c in _PAIR and any(s[0] in _PAIR[c] for s in stack[-4:]):
            while stack[-1][0] not in _PAIR[c]:
                stack.pop()
            pairs[stack.pop()[1]] = at
        elif c in "(（「『【〈《“„«":
            stack.append((c, at))
    return pairs


def _looks_open(text: str, at: int) -> bool:
    """Whether a straight quote after white space opens, although one is open: a word follows and no mark stood before."""
    return text[at + 1 : at + 2].isalpha() and text[: at].rstrip()[-1:] not in ".!?,;"


def _script(word: str) -> int:
    """The script of the last letter of a word, 0 without one."""
    c = next((c for c in reversed(word) if c.isalpha()), "")
    return next((i for i, top in enumerate(_SCRIPTS, 1) if c < top), len(_SCRIPTS) + 1) if c else 0


def event_code(words: tuple[str, str], right: str) -> int:
    """The number of an event: the history (44 bits of a hash), its script and the pair of classes around the mark."""
    return _history(*words)[2] + _RIGHT_NO[right]


def end_code(words: tuple[str, str]) -> int:
    """The number of the certain boundary after the last full stop of a paragraph, negative and below ``SURE``."""
    return -2 - event_code(words, "none")


def head_of(code: int) -> int:
    """An event without its right class."""
    return code - (code & 0x1FFF) % len(RIGHTS)


def classes_of(code: int) -> tuple[str, str]:
    """The pair of classes of an event."""
    pair = code & 0x1FFF
    return LEFTS[pair // len(RIGHTS)], RIGHTS[pair % len(RIGHTS)]


class Splitter:
    """Cuts texts at every place that is or may be a boundary."""

    def segments(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """(starts, ends, codes) of the parts between all places where a unit ends or may end.

        The code tells what stands after the part: a negative number for a certain boundary (``SURE``, or the event of a
        full stop at the end of a paragraph), or the event of a guess.  Parts begin and end at characters that are not
        white space.
        """
        return self.events(text)[:3]

    def events(self, text: str | None) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
        """As :meth:`segments`, with the word after each part (:func:`next_code`) and the two before (:func:`_history`)."""
        starts, ends, codes, nexts, pairs = [], [], [], [], []
        if not text or text.isspace():
            return starts, ends, codes, nexts, pairs
        thai = not text.isascii() and bool(_HAS_THAI.search(text))
        for start, end in self._paragraphs(text):
            at = start
            cuts = self._cuts(text, start, end, thai)
            if not cuts or cuts[-1][0] != end:
                cuts.append((end, SURE, 0))
            for cut, code, pair in cuts:
                a, b = at, cut
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if a < b:
                    if codes:
                        nexts.append(0 if codes[-1] < 0 and text[a] in "(0123456789" and _CLAIM.match(text, a, b) else next_at(text, a, end))
                    starts.append(a)
                    ends.append(b)
                    codes.append(code)
                    pairs.append(pair)
                elif codes and code < 0 <= codes[-1]:
                    codes[-1], pairs[-1] = SURE, 0
                at = cut
        return starts, ends, codes, [*nexts, 0] if codes else nexts, pairs

    @staticmethod
    def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        for m in _BLANK.finditer(text):
            if m.start() > at:
                yield at, m.start()
            at = m.end()
        if at < len(text):
            yield at, len(text)

    @staticmethod
    def _claims(text: str, start: int, end: int) -> list[int]:
        """Where the claims of a paragraph begin; empty if it holds none."""
        head = _CLAIM.match(text, start, end)
        if not head:
            return []
        number = lambda m: int(next(g for g in m.groups() if g))
        at, last = [start], number(head)
        for b in _BREAK.finditer(text, start, end):
            m = _CLAIM.match(text, b.end(), end)
            if m and (number(m) == last + 1 or text[: b.start()].rstrip()[-1:] in ".!?;:。；：！？।۔" or m.group(3) or m.group(5)):
                at.append(b.end())
                last = number(m)
        return at

    def _cuts(self, text: str, start: int, end: int, thai: bool) -> list[tuple[int, int, int]]:
        whole = end
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        claims = self._claims(text, start, end)
        thai = thai and bool(_HAS_THAI.search(text, start, end))
        if claims and not (thai and text.startswith("ข้อถือสิทธิ", start)):
            return [(at, SURE, 0) for at in claims[1:]]
        body = text[start:end]
        found = list(_SCAN.finditer(body))
        sure: list[int] = claims[1:]
        last, last_pair = SURE, 0
        marks = [m.group() for m in found]
        spans = {} if _SIGNS.isdisjoint(marks) else _spans(body, found)
        if thai:
            inside = sorted(spans.items())
            sure += [start + m.end() for m in _THAI_GAP.finditer(body) if not any(a < m.start() < b for a, b in inside)]
        guesses: list[tuple[int, int, int]] = []
        n, stop, closing = len(body), -1, {b: a for a, b in spans.items()}
        for mark, m in zip(marks, found):
            at, k = m.span()
            if mark in _SIGNS:
                # the outermost span that is open
                stop = max(stop, spans.get(at, -1))
                continue
            if mark == "." and k < n and at and body[k].isdigit() and body[at - 1].isdigit():
                continue
            inside = at < stop
            opened = -1
            # closing quotes and brackets right after the mark belong to it
            while k < n:
                c = body[k]
                if c == " " and body[k + 1 : k + 2] != "»" or c.isalnum():
                    break
                if k in closing or c in "’”»」』】）〉》" or c in ")]" and inside or c in "*_" and body[k - 1] in ".!?":
                    opened = closing.get(k, opened)
                    k += 1
                elif c in "   " and k + 1 < n and body[k + 1] in "»" and (k + 1) in closing:
                    opened = closing[k + 1]
                    k += 2
                else:
                    break
            if inside and k <= stop:
                continue
            if k >= n:
                if mark == "." and body[at - 1 : at].strip():
                    words = _two_words(body, 0, at)
                    last, last_pair = end_code(words), _history(*words)[3]
                continue
            gap = body[k].isspace()
            nxt = k
            while nxt < n and body[nxt].isspace():
                nxt += 1
            right = _right(body, nxt, n)
            if inside:  # a quotation or bracket has just been closed
                alone = opened == 0 or opened > 0 and bool(re.search(r"[.!?。！？।؟”»」)）]\s*\Z", body[max(0, opened - 6) : opened]))
                kind = right.removeprefix("q")
                if kind in ("cap", "unit", "mixed", "open", "num") and gap or kind == "cap" and body[k] not in ".,;:-" and not gap and alone:
                    sure.append(start + k)
                elif alone and body[opened] in "(（[" and kind in ("cjk", "hangul", "other", "small"):
                    sure.append(start + k)
                continue
            prev = body[at - 1] if at else " "
            if mark != ".":
                if mark[0] in _FULL:
                    sure.append(start + k)
                    continue
                if mark[0] == "…" or mark.count(".") == len(mark):
                    if gap and right in ("cap", "mixed", "qcap") and not prev.isspace():
                        sure.append(start + k)
                    continue
                spaced = prev.isspace()
                word = body[:at].rstrip()[-2:] if spaced else prev
                if spaced and not (word.isalpha() or word[-1:] in "»)”\""):
                    continue
                if gap or right in ("cap", "cjk", "hangul", "other", "mixed"):
                    if not (gap and right == "sign" and spaced):
                        sure.append(start + k)
                continue
            if prev.isspace() and not gap:
                continue
            if not gap:
                if prev.isdigit() and body[k].isdigit():
                    continue
                left = _left(body, 0, at)
                if left in ("word", "closed") and (right.removeprefix("q") in ("cap", "mixed") and (len(right) > 3 or body[nxt + 1 : nxt + 2].islower() or not right == "cap") or right == "unit") or left.startswith("unit:") and right == "cap" and body[nxt + 1 : nxt + 2].islower():
                    token = _LEFT.search(body, max(0, at - 60), at)
                    if not token or "." not in token.group():
                        sure.append(start + k)
                elif right in ("hangul", "other", "cjk") and prev.isalpha() and not prev.isascii():
                    sure.append(start + k)
                continue
            _, _, event, pair = _history(*_two_words(body, 0, at))
            guesses.append((start + k, event + _RIGHT_NO[right], pair))
        if not sure:
            return [*guesses, (whole, last, last_pair)]
        known = {at: (code, pair) for at, code, pair in guesses} | dict.fromkeys(sure, (SURE, 0)) | {whole: (last, last_pair)}
        return [(at, *known[at]) for at in sorted(known)]


# What is believed before any text is seen, as log odds of a boundary.
_LEFT_PRIOR = {"abbr": -5.0, "may": -0.4, "initials": -4.0, "ordinal": -4.0, "num:free": -1.5, "num:ref": 2.5, "num": 2.0, "letter": -1.5, "unit": 3.0, "dotted": 2.0, "sign": 1.0, "short": 1.5, "word": 3.0, "closed": 2.0, "mark": 0.0, "start": -4.0}
_RIGHT_PRIOR = {"cap": 1.5, "mixed": 2.0, "small": -4.0, "num": -1.0, "unit": 0.5, "cjk": 1.0, "hangul": 1.0, "other": 1.0, "sign": -2.0, "open": 0.5, "none": 0.0}
#: Events that the beliefs on what follows a mark count for, and events of all words in the distribution after one word.
WEIGHT, SMOOTH = 100.0, 100.0
#: Chances of a boundary that a word may have, and how closely the share of ends at paragraphs holds for each word.
_GRID, PRECISION = (0.002, 0.1, 0.25, 0.5, 0.75, 0.9, 0.998), 20.0
#: What an unseen corpus is believed to say on units of fewer than six letters.
ALONE = 0.05
#: The log odds of a boundary that needs no guess.
CERTAIN = 40.0
#: Rounds of expectation maximisation over the words around the marks.
ROUNDS = 2
#: What sums of expected events belong to.
WORD, PAIR = range(2)


def left_prior(left: str) -> float:
    """What the left class alone says."""
    return _LEFT_PRIOR[left] if left in _LEFT_PRIOR else _LEFT_PRIOR[left.partition(":")[0]]


def prior_odds(left: str, right: str) -> float:
    """The log odds of a boundary between two classes before training."""
    return left_prior(left) + _RIGHT_PRIOR.get(right.removeprefix("q") or right, 0.0)


class Words:
    """What the words around a mark say beyond the word before it and the class of the one after.

    ``begin`` and ``inside`` are the shares of a word among those of its class that begin a sentence and that do not.
    Counts of what follows one history without a boundary would not do: a word that ends one sentence of a template is
    always followed by the beginnings of a few others, which such counts learn as if they went on.  ``pairs`` holds the
    log odds that the two words before a mark add to those of the last.
    """

    def __init__(self) -> None:
        self.begin: dict[int, float] = {}
        self.inside: dict[int, float] = {}
        self.pairs: dict[int, float] = {}

    def of(self, nxt: int, pair: int) -> float:
        """The log odds that the word after the mark and the two before it add."""
        found = self.pairs.get(pair, 0.0)
        x = nxt if nxt in self.begin else nxt & 7
        return found + log(self.begin[x] / self.inside[x]) if x in self.begin else found


class Model:
    """Log odds of a boundary for events, and how unlikely a unit of fewer than six letters is."""

    def __init__(self, odds: dict[int, float] | None = None, alone: float = ALONE, words: Words | None = None) -> None:
        self.odds, self.alone, self.words = odds or {}, alone, words or Words()
        self._known: dict[tuple[int, int, int], float] = {}

    def known(self, codes: list[int], nexts: list[int], pairs: list[int]) -> list[float]:
        """As :meth:`of` for each event, with those met before remembered; ``CERTAIN`` for boundaries that need no guess."""
        met, out = self._known, []
        for event in zip(codes, nexts, pairs):
            found = CERTAIN if event[0] < 0 else met.get(event)
            if found is None:
                if len(met) >= 1 << 18:
                    met.clear()
                found = met[event] = self.of(*event)
            out.append(found)
        return out

    def of(self, code: int, nxt: int = 0, pair: int = 0) -> float:
        """The log odds of an event: of its word, else of its shape, else what is believed, and of the words around."""
        found = self.odds.get(code)
        if found is None:
            code &= 0xFFFF
            found = self.odds.get(code)
            if found is None:
                found = prior_odds(*classes_of(code))
        return found + self.words.of(nxt, pair) if nxt or pair else found


def posteriors(odds: list[float], short: list[bool], alone: float = ALONE) -> list[bool]:
    """Forward-backward over a chain of guesses: whether each is a boundary.

    Two boundaries around a part of fewer than six letters (``short``) weigh ``alone``.
    """
    if not any(short[1:]):  # the guesses are independent, and forward-backward gives each its own odds
        return [v > 0 for v in odds]
    n = len(odds)
    p = [1 / (1 + exp(-v)) for v in odds]
    fwd: list[tuple[float, float]] = []
    for i in range(n):
        if i == 0:
            no, one = 1 - p[0], p[0]
        else:
            a, b = fwd[-1]
            no, one = (1 - p[i]) * (a + b), p[i] * (a + (alone if short[i] else 1.0) * b)
        fwd.append((no / (no + one), one / (no + one)))
    out, (no, one) = [fwd[-1][1] > fwd[-1][0]], (1.0, 1.0)
    for i in range(n - 2, -1, -1):
        q, t = p[i + 1], alone if short[i + 1] else 1.0
        no, one = (1 - q) * no + q * one, (1 - q) * no + t * q * one
        no, one = no / (no + one), one / (no + one)
        out.append(fwd[i][1] * one > fwd[i][0] * no)
    return out[::-1]


def join_segments(starts: list[int], ends: list[int], codes: list[int], model: Model | dict[int, float], nexts: list[int] | None = None, pairs: list[int] | None = None) -> list[tuple[int, int]]:
    """The units of one text from its parts: parts are joined where the guess after them says no boundary.

    Forward-backward runs over the guesses with the certain boundaries on both sides of them, which the start of the text
    is too; beyond a certain boundary nothing depends on them.
    """
    model = model if isinstance(model, Model) else Model(model)
    n, done = len(codes), 0
    odds = model.known(codes, nexts or [0] * n, pairs or [0] * n)
    cut = [v > 0 for v in odds]
    # a part of fewer than six letters holds no more than a word or two; chains without one are left at their own odds
    small = [b - a < 6 for a, b in zip(starts, ends)]
    for k in compress(range(n), small):
        if k < done:
            continue
        i = j = k
        while i > 0 and codes[i - 1] >= 0:
            i -= 1
        while j < n and codes[j] >= 0:
            j += 1
        if i < j:
            short = [False, *small[i : j + 1]]
            cut[i:j] = posteriors([CERTAIN, *odds[i:j], CERTAIN][: len(short)], short, model.alone)[1 : j - i + 1]
        done = j + 1
    # a unit begins at the first part and after each cut
    begins = compress(starts, chain([True], cut))
    return list(zip(begins, compress(ends, cut)))


def _ends_sentences(ends: int, cases: int, share: float, believed: float) -> float:
    """How probable it is that a mark after a word is a boundary, from how many of its cases end a paragraph.

    Each case of a word that ends sentences ends a paragraph with a chance that differs from word to word around
    ``share``.  The chance of a boundary lies on a grid; most words end a sentence nearly always or hardly ever.
    """
    score = {}
    for q in _GRID:
        a = PRECISION * share * q
        b = PRECISION - a
        fit = lgamma(a + ends) - lgamma(a) + lgamma(b + cases - ends) - lgamma(b)
        score[q] = fit + log({_GRID[0]: 0.9 * (1 - believed), _GRID[-1]: 0.9 * believed}.get(q, 0.1 / (len(_GRID) - 2)))
    top = max(score.values())
    weights = {q: exp(v - top) for q, v in score.items()}
    return sum(q * w for q, w in weights.items()) / sum(weights.values())


def train(counts: dict[int, int], rounds: int = 3, smooth: float = SMOOTH) -> dict[int, float]:
    """Log odds of a boundary for each event, from counts of events."""
    return fit_classes(counts, rounds, smooth)[0]


def fit_classes(counts: dict[int, int], rounds: int = 3, smooth: float = SMOOTH) -> tuple[dict[int, float], dict[int, float]]:
    """Log odds of a boundary for each event, and the chance of one after each history, from counts of events.

    ``P(boundary | history) P(no end of a paragraph) P(right | boundary, script)`` stands against
    ``P(no boundary | history) P(right | no boundary, history)``.  The first factor comes from the certain events at ends
    of paragraphs, where the share of sentences that end a paragraph is itself what they say: of all further cases of a
    word that ends one paragraph, how many end one too.  Expectation maximisation finds what follows a mark with and
    without a boundary; ``smooth`` events of the distribution over all words count in those after one word.
    """
    ends: Counter[int] = Counter()  # by history: the code without the right class
    cells: dict[tuple[int, int], int] = {}
    for code, n in counts.items():
        if code >= 0:
            cells[head_of(code), (code & 0x1FFF) % len(RIGHTS)] = n
        elif code < SURE:
            ends[head_of(-2 - code)] += n
    cases = Counter(ends)
    for (h, _), n in cells.items():
        cases[h] += n
    votes = [(k * (k - 1) / (cases[h] - 1), k) for h, k in ends.items() if cases[h] > 1]
    # with few certain ends their plain share of all marks says as much as ten of them
    plain = (sum(ends.values()) + 0.5) / (sum(cases.values()) + 1.0)
    share = (sum(v for v, _ in votes) + 10 * plain) / (sum(k for _, k in votes) + 10)
    believed = lambda h: 1 / (1 + exp(-left_prior(classes_of(h)[0])))
    yes = {h: _ends_sentences(ends[h], cases[h], share, believed(h)) for h, _ in cells}
    post = {(h, r): yes[h] for h, r in cells}
    lean = [exp(_RIGHT_PRIOR.get(r.removeprefix("q") or r, 0.0)) for r in RIGHTS]
    rights = sorted({r for _, r in cells})
    for _ in range(rounds):
        begin, on, begin_of, seen_of, on_of, stay = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
        for (h, r), n in cells.items():
            y = n * post[h, r]
            begin[r] += y
            begin_of[h >> 13 & 7, r] += y
            seen_of[h >> 13 & 7] += y
            on[r] += n - y
            on_of[h, r] += n - y
            stay[h] += n - y
        # beliefs on what follows are a few events more, shared out by the odds that are believed
        more = WEIGHT / len(rights) if rights else 0.0
        for r in rights:
            begin[r] += more * lean[r] / (1 + lean[r])
            on[r] += more / (1 + lean[r])
        total, whole = sum(begin.values()), sum(on.values())
        for h, r in cells:
            begins = (begin_of[h >> 13 & 7, r] + smooth * begin[r] / total) / (seen_of[h >> 13 & 7] + smooth)
            goes_on = (on_of[h, r] + smooth * on[r] / whole) / (stay[h] + smooth)
            a, b = yes[h] * (1 - share) * begins, (1 - yes[h]) * goes_on
            post[h, r] = a / (a + b)
    clip = lambda p: min(max(p, 1e-11), 1 - 1e-11)
    return {h + r: log(clip(p) / (1 - clip(p))) for (h, r), p in post.items()}, yes


def fit_words(sums: dict[tuple[int, int, int], tuple[float, float]], seen: dict[int, int], yes: dict[int, float], smooth: float = SMOOTH) -> Words:
    """One step of maximisation: what the words around the marks say, from the sums of :func:`expected_counts`.

    ``seen`` tells how often a word stands anywhere but first in a text: where no mark stands before it, no sentence begins.
    """
    words = Words()
    begin, every = Counter(), Counter()
    logit = lambda p: log(p / (1 - p))
    for (kind, a, b), (ends, n) in sums.items():
        if kind == WORD:
            begin[a], every[a] = ends, n
        elif 0 < yes.get(a, 0.0) < 1:
            words.pairs[b] = logit((ends + smooth * yes[a]) / (n + smooth)) - logit(yes[a])
    # a discount of one event, as n-grams have it, keeps a few doubtful events from proving each other
    inside = {x: max(seen.get(x, 0) - every[x], 0) + max(every[x] - begin[x] - 1, 0.0) for x in every.keys() | seen.keys()}
    starts, stays, cases = Counter(), Counter(), Counter()
    for x in inside:
        starts[x & 7] += begin[x]
        stays[x & 7] += inside[x]
        cases[x & 7] += every[x] + 1
    for x in inside:
        c = x & 7
        words.begin[x] = (begin[x] + smooth * (every[x] + 1) / cases[c]) / (starts[c] + smooth)
        words.inside[x] = (inside[x] + smooth * words.begin[x]) / (stays[c] + smooth)
    return words


def _to_arrow(lists: list[list[int]], kind: type) -> pa.ListArray:
    """Lists of numbers as an array, all numbers at once."""
    sizes = np.fromiter(map(len, lists), np.int32, len(lists))
    places = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.fromiter(chain.from_iterable(lists), kind, places[-1])))


def _to_lists(column: pa.ListArray) -> list[list[int]]:
    """The other way round."""
    places, values = column.offsets.to_numpy().tolist(), column.values.to_numpy().tolist()
    return [values[a:b] for a, b in pairwise(places)]


def segment_corpus(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, starts, ends, codes, nexts, pairs, words, seen): the parts of every row's text (see :meth:`Splitter.events`).

    The first row of a batch counts in ``seen`` how often each of ``words`` stands in the batch, first words of texts left out.
    """
    whole, long = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    kinds = {"starts": whole, "ends": whole, "codes": long, "nexts": long, "pairs": long, "words": long, "seen": long}
    schema = T.StructType([df.schema[key], *[T.StructField(name, kind) for name, kind in kinds.items()]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [splitter.events(t) for t in texts]
            seen = count_words(texts)
            rest = [None] * (len(texts) - 1)
            lists = [_to_arrow([f[i] for f in found], kind) for i, kind in enumerate((np.int32, np.int32, np.int64, np.int64, np.int64))]
            counts = [pa.array([list(c), *rest][: len(texts)], pa.list_(pa.int64())) for c in (seen.keys(), seen.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *counts], names=[f.name for f in schema])

    return df.select(key, text).mapInArrow(work, schema)


def event_cells(parts: DataFrame, rare: int = RARE) -> DataFrame:
    """(code, nxt, pair, n): how often each event occurs with which words around it in the parts of :func:`segment_corpus`.

    Words before less than one in ``rare`` of the marks come under their shape, so there are at most ``rare`` histories
    besides the shapes, each with a few dozen events, whatever the corpus.  Words after a mark and pairs of words before
    it that are rarer than that come under the class of the word and as 0.
    """
    from genomespark.runtime import cut

    each = parts.select(F.explode(F.arrays_zip("codes", "nexts", "pairs")).alias("e")).select(F.col("e.codes").alias("code"), F.col("e.nexts").alias("nxt"), F.col("e.pairs").alias("pair"))
    cells = cut(each.groupBy("code", "nxt", "pair").agg(F.count("*").alias("n")))
    signed = cells.withColumn("event", F.when(F.col("code") < 0, -2 - F.col("code")).otherwise(F.col("code"))).withColumn("word", F.shiftright("event", 16))
    marks = signed.where(F.col("code") != SURE)
    total = marks.agg(F.sum("n").alias("total"))
    for column, short in (("word", F.col("event")), ("nxt", F.col("nxt").bitwiseAND(F.lit(7))), ("pair", F.lit(0))):
        counts = marks.groupBy(column).agg(F.sum("n").alias("m"))
        frequent = counts.join(F.broadcast(total), F.col("m") * rare >= F.col("total")).select(column, F.lit(True).alias(f"own_{column}"))
        signed = signed.join(F.broadcast(frequent), column, "left")
        if column != "word":
            signed = signed.withColumn(column, F.when(F.col(f"own_{column}"), F.col(column)).otherwise(short))
    event = F.when(F.col("own_word"), F.col("event")).otherwise(F.col("event").bitwiseAND(F.lit(0xFFFF)))
    code = F.when(F.col("code") == SURE, F.col("code")).when(F.col("code") < 0, -2 - event).otherwise(event)
    return signed.groupBy(code.alias("code"), "nxt", "pair").agg(F.sum("n").alias("n"))


def event_counts(parts: DataFrame, rare: int = RARE) -> DataFrame:
    """(code, n): how often each event occurs, whatever the words around it."""
    return _by_code(event_cells(parts, rare))


def _by_code(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("code") != SURE).groupBy("code").agg(F.sum("n").alias("n"))


def expected_counts(cells: DataFrame, model: Model) -> DataFrame:
    """(kind, a, b, ends, n): the expected number of boundaries, and of all cases, that the words around a mark take part in.

    ``WORD``: before the word a; ``PAIR``: after the history a, of the pair of words b.  Certain boundaries count as what
    they are.
    """
    shared = cells.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sums: dict[tuple[int, int, int], list[float]] = {}
            for code, nxt, pair, n in zip(*[c.to_pylist() for c in batch.columns]):
                ends = n if code < 0 else n / (1 + exp(-known.of(code, nxt, pair)))
                head = head_of(-2 - code if code < SURE else code)
                keys = [(WORD, nxt, 0)] if nxt else []
                if pair and code != SURE:
                    keys.append((PAIR, head, pair))
                for k in keys:
                    cell = sums.setdefault(k, [0.0, 0.0])
                    cell[0] += ends
                    cell[1] += n
            rows = [(*k, *v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.float64()) for i in range(5)], names=["kind", "a", "b", "ends", "n"])

    found = cells.select("code", "nxt", "pair", "n").mapInArrow(work, "kind long, a long, b long, ends double, n double")
    return found.groupBy("kind", "a", "b").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))


def seen_words(parts: DataFrame, cells: DataFrame) -> DataFrame:
    """(word, n): how often the words of ``cells`` that follow a mark stand anywhere, all others by class."""
    each = parts.where("words IS NOT NULL").select(F.explode(F.arrays_zip("words", "seen")).alias("e")).select(F.col("e.words").alias("nxt"), F.col("e.seen").alias("n"))
    own = cells.select("nxt").distinct().withColumn("own", F.lit(True))
    word = F.when(F.col("own"), F.col("nxt")).otherwise(F.col("nxt").bitwiseAND(F.lit(7)))
    return each.join(F.broadcast(own), "nxt", "left").groupBy(word.alias("word")).agg(F.sum("n").alias("n"))


def short_units(parts: DataFrame) -> float:
    """How much rarer parts of fewer than six letters are between certain boundaries than among all parts."""
    each = parts.select(F.posexplode("codes").alias("i", "code"), "starts", "ends", "codes")
    short = F.get("ends", F.col("i")) - F.get("starts", F.col("i")) < 6
    certain = (F.col("code") < 0) & ((F.col("i") == 0) | (F.get("codes", F.col("i") - 1) < 0))
    row = each.agg(F.count_if(certain & short).alias("a"), F.count_if(certain).alias("b"), F.count_if(~certain & short).alias("c"), F.count_if(~certain).alias("d")).first()
    return min(1.0, (row.a + 1) / (row.b + 1 / ALONE) * (row.d + 1) / (row.c + 1))


def train_model(parts: DataFrame) -> Model:
    """The model of a corpus from the counts over all its parts.

    The classes around the marks come first, the words after them: each round of expectation maximisation sums what the
    model of the round before expects of all events.
    """
    from genomespark.runtime import cut

    cells = cut(event_cells(parts))
    counts = {r.code: r.n for r in _by_code(cells).collect()}
    odds, yes = fit_classes(counts)
    seen = {r.word: r.n for r in seen_words(parts, cells).collect()}
    model = Model(odds, short_units(parts))
    for _ in range(ROUNDS):
        sums = expected_counts(cells, model).collect()
        model = Model(odds, model.alone, fit_words({(r.kind, r.a, r.b): (r.ends, r.n) for r in sums}, seen, yes))
    return model


def sentence_units(df: DataFrame, key: str, text: str, odds: Model | dict[int, float] | None = None) -> DataFrame:
    """(key, start_char, end_char): a row per sentence unit of each row's text; null and blank texts have none.

    Places are code points, the end exclusive.  Texts are read once: their parts are written to the checkpoint folder,
    the counts of events over all of them train the model unless ``odds`` gives one, and a last narrow pass joins the
    parts.
    """
    from genomespark.runtime import cut

    parts = cut(segment_corpus(df, key, text))
    model = train_model(parts) if odds is None else odds if isinstance(odds, Model) else Model(odds)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[key], T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, (first, last, codes, nexts, pairs) in enumerate(zip(*[_to_lists(batch.column(k)) for k in range(1, 6)])):
                for a, b in join_segments(first, last, codes, known, nexts, pairs):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[f.name for f in schema])

    return parts.drop("words", "seen").mapInArrow(work, schema)

"""Problem 9: sentence boundaries across languages and scripts.

A linear chain runs over the events of a text: the characters at which a sentence could end or a quotation begin or end
(end marks, dashes that break off, quotation marks, turns, cue borders, the text's end and, in scripts without spaces,
gaps and line ends); all other characters are inside by construction. Each event has one of four tags: INSIDE a sentence,
BOUNDARY after it, or inside a QUOTED passage that opened its sentence or one that words led up to (LED). Quotations are
thus hidden states, not features: that a mark in a quotation ends nothing, which of two equal quotation marks closes, and
what becomes of one that never closes, is decided by the learnt transitions (by class of event, previous and next tag)
in one Viterbi pass over the whole text.

Observations of an event are its mark, the break and the kind of character after it, the shape and the letters of the
word before a full stop, whether a short clause with a word that reports follows a closing quotation mark, and how often
the cues of the text end in a mark. Weights, transitions included, are those of an averaged structured perceptron
(`sentence_training.py`, which also tells where labels come from); they lie in `sentence_weights.json`, with the words
that training found to report quotations or to make adverts. No list of words is written down, neither here nor there.

Defined results: null, empty and blank texts have no sentences; text misread in a one-byte encoding is decoded for
tagging and its offsets are those in the text as it stands; a text without times is one cue; each advert cue is one
sentence; what holds no letter or digit is no sentence.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weirstone.llm.subtitles import CUE, NUL, TURN, reread, spoken

INSIDE, BOUNDARY, QUOTED, LED = range(4)
TAGS = (INSIDE, BOUNDARY, QUOTED, LED)
#: Score of a transition that training never saw.
NEVER = -1e6
#: Entries after which a worker's memo of sums is emptied.
MEMO = 200_000
#: Characters of the word before a full stop that are looked at.
WORD = 40

_EVENT = re.compile("[.!?…。！？।؟;\"“”«»„「」『』—–\\-\x1d\x1e]")
_EVENT_GAPS = re.compile("[.!?…。！？।؟;\"“”«»„「」『』—–\\-\x1d\x1e \t　\xa0\r\n]")
_BROKEN_OFF = re.compile(r"[—–-](?=[\s\x00\x1d\x1e]*[\r\n\x1e\x1d]|[\s\x00]*$|[\s\x00]+[^\W\d_a-zа-яё])")
_HYPHEN_LAST = re.compile(r"-[\s\x00]*(?:[\r\n\x1e\x1d]|$)")
_SKIP = re.compile(r"[\s\x00\x1d\x1e]*")
_NOSPACE = re.compile("[฀-๿぀-ヿ一-鿿]")
_STOP = frozenset(" \t\r\n\xa0 　\x00\x1d\x1e(«“\"„‘’'!?,:")
_MARKS = frozenset(".!?…。！？।؟")
_CLASS = {".": ".", "!": "!", "?": "!", "。": "。", "！": "。", "？": "。", "।": "।", "؟": "!", "…": "…"}
_QUOTES = frozenset("\"“”«»„「」『』")
_OPENERS, _CLOSERS = frozenset("«„「『"), frozenset("»”」』")
_INNER = re.compile(r"[^\W\d_]{5,}[.!?।؟][ \r\n]+[^\W\d_a-zа-яёα-ω]")
_QUOTATION = re.compile("[“«„「『\"][^”»“」』\"]*[”»“」』\"]")
_GREEK = re.compile("[Ͱ-Ͽ]")
_ALNUM = re.compile(r"[^\W_]")
_BLANKS = "\x00 \t\r\n　\x1e\x1d\xa0 "
_CLAUSE = re.compile("[^\\W_]+|[.!?…\x1d:\"“«„「『]")
_LEADS = frozenset(":\"“«„「『")
_CLAUSE_ENDS = frozenset(".!?…\x1d")
_WORD = re.compile(r"[^\W_]+")
#: Letters that character recognition takes for one another, brought to one.
_FOLD = str.maketrans("01cI", "olel")


class Event:
    """A character that may end a sentence: the position, where a sentence that ends here ends, its class and observations."""

    __slots__ = ("at", "brk", "case", "cls", "end", "seen", "word")

    def __init__(self, at: int, end: int, cls: str, case: str, brk: str, word: str, seen: tuple) -> None:
        self.at, self.end, self.cls, self.case, self.brk, self.word, self.seen = at, end, cls, case, brk, word, seen


def folded(word: str) -> str:
    return word.translate(_FOLD).lower().replace("rn", "m")


def _case(ch: str) -> str:
    if not ch:
        return "end"
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        return "lower" if ch.islower() else "upper" if ch.isupper() else "nospace" if _NOSPACE.match(ch) else "caseless"
    if ch in "“«„「『\"¿¡(‘":
        return "open"
    if ch in ",،、;:—–-":
        return "comma"
    return "mark" if ch in _MARKS else "other"


_cases: dict[str, str] = {}


def case_of(ch: str) -> str:
    known = _cases.get(ch)
    if known is None:
        known = _cases[ch] = _case(ch)
    return known


def habit(s: str) -> tuple[str, bool]:
    """How the text marks ends, as an observation, and whether its script goes without spaces."""
    cues = [c for c in s.split(CUE) if _ALNUM.search(c)]
    if not cues:
        return "none", False
    dense = not s.isascii() and bool(_NOSPACE.search(s)) and len(_NOSPACE.findall(s)) > 0.3 * len(_ALNUM.findall(s))
    ending = _WIDE_ENDING if dense else _ENDING
    share = sum(c.rstrip(_BLANKS)[-1:] in ending for c in cues) / len(cues)
    if dense:
        return ("dense0" if share < 0.05 else "dense1" if share < 0.25 else "dense2"), True
    if share >= 0.25:
        return "marks", False
    if CUE not in s and _BARE_MARK.search(s):
        return "marks", False
    inner = sum(len(_INNER.findall(_QUOTATION.sub("", c))) for c in cues) / len(cues)
    return f"few{int(share > 0.05)}{int(inner > 0.02) + int(inner > 0.1)}", False


_BARE_MARK = re.compile(r"[^\W_]{2,}[.!?।؟](?:\s|$)")
_ENDING = frozenset(".!?…。！？।؟;")
_WIDE_ENDING = frozenset("。！？")


def word_before(s: str, at: int) -> str:
    """The word that ends at `at`, its inner points included; of one longer than WORD characters the end."""
    k, least = at, max(0, at - WORD)
    while k > least and s[k - 1] not in _STOP:
        k -= 1
    head, dot, tail = s[k:at].rpartition(".")
    return tail if dot and tail and head[-3:].isalpha() and len(head) > 2 else s[k:at]  # a blank is missing before the word


def words_after(s: str, at: int, most: int = 5) -> list[str]:
    """The first words of the clause at `at`; more than `most` mean that it is no short one, none that it leads up to a quotation itself. Blanked characters don't count, however many."""
    out: list[str] = []
    for m in _CLAUSE.finditer(s, at):
        if m[0] in _LEADS:
            return []
        if m[0] in _CLAUSE_ENDS or len(out) > most:
            break
        out.append(m[0])
    return out


def _shape(word: str) -> str:
    if not word:
        return "none"
    if word[-1].isdigit():
        return "figure"
    if "." in word:
        return "dotted"
    return str(min(len(word), 3))


def _stop_seen(word: str, case: str, brk: str, s: str, i: int, j: int, form: str) -> tuple:
    extra = ""
    if case == "upper" and word[-1:].isdigit():
        m = _WORD.match(s, j)
        extra = f"fn={folded(m[0])}" if m else "fn="
    elif case == "lower" and s[j] == "l":
        m = _WORD.match(s, j)
        extra = f"ln={m[0]}" if len(m[0]) < 3 else ""
    if brk == "tight":
        extra = f"t={s[max(0, i - 2) : i].islower()}|{case}|{case_of(s[j + 1 : j + 2])}"
    key = (word, case, brk, form, extra)
    got = _known.get(key)
    if got is None:
        shape, low = _shape(word), folded(word.rstrip("."))
        seen = [f"s={shape}|{case}", f"w={low}", f"w={low}|{case}", f".|{case}|{brk}", f"{form}|.|{case}|{brk if brk in ('turn', 'end', 'cue') else ''}", f".|{case}"]
        got = _keep(key, (*seen, extra) if extra else tuple(seen))
    return got


def _keep(key, seen: tuple) -> tuple:
    """One object for equal observations, so that sums can be remembered by it."""
    if len(_known) > MEMO:
        _known.clear()
    _known[key] = seen
    return seen


_known: dict = {}


def _seen(*key: str) -> tuple:
    got = _known.get(key)
    if got is None:
        form, cls, case, brk, extra = key
        big = brk if brk in ("turn", "end", "cue") else ""
        got = _keep(key, (f"{form}|{cls}|{brk}", f"{form}|{cls}|{case}|{big}|{extra}", f"{cls}|{case}|{extra}", f"{cls}|{brk}", f"{cls}|{big}"))
    return got


def events(s: str, form: str, dense: bool, reports: Collection[str] = ()) -> list[Event]:
    """All events of the spoken text s in order. reports: folded words that report quotations."""
    out: list[Event] = []
    taken = 0  # up to where characters belong to the last event
    greek = ";" in s and bool(_GREEK.search(s))
    replaced = "�" in s
    low_quote = "„" in s
    for m in (_EVENT_GAPS if dense else _EVENT).finditer(s):
        i, c = m.start(), m[0]
        if i < taken:
            continue
        end = i + 1
        if c in (TURN, CUE):
            back = len(s[taken:i].rstrip(_BLANKS)) + taken
            if back <= taken:  # nothing was said since the last event, which has the break as an observation
                continue
            j = _SKIP.match(s, end).end()
            span = s[i:j]
            brk = "turn" if TURN in span else "end" if j == len(s) else "cue"
            case = case_of(s[j : j + 1])
            out.append(Event(i, back, "cue", case, brk, "", _seen(form, "cue", case, brk, "")))
            taken = j
            continue
        if c.isspace():
            j = _SKIP.match(s, i).end()
            prev, nxt, span = s[i - 1 : i], s[j : j + 1], s[i:j]
            taken_by_gap = i == taken and bool(out)
            if taken_by_gap or not prev or prev.isspace() or prev in (NUL, CUE, TURN) or not nxt or CUE in span or TURN in span:
                continue
            brk = "line" if "\n" in span or "\r" in span else "gap"
            figure = "figure" if prev.isdigit() or nxt.isdigit() else ""
            case = case_of(nxt)
            out.append(Event(i, i, "blank", case, brk, "", _seen(form, "blank", case, brk, figure)))
            continue
        word = ""
        if c in _QUOTES:
            last = s[taken:i].rstrip(_BLANKS)
            after = s[end : end + 1]
            if c in _OPENERS or (c == "“" and not low_quote):
                cls = "open"
            elif c in _CLOSERS:
                cls = "close"
            else:
                left, right = s[i - 1 : i] in _BLANKS or s[i - 1 : i] in "(-—–", not after or after in _BLANKS or after in ".,!?;:…"
                cls = f"quote{int(left)}{int(right)}"
            said = "w" if _ALNUM.search(last) else "-"
            marked = "m" if (last[-1:] in _MARKS if last else bool(out) and s[out[-1].end - 1 : out[-1].end] in _MARKS and out[-1].cls != "cue") else "-"
            cls += said + marked
            j = _SKIP.match(s, end).end()
            span = s[end:j]
            brk = "turn" if TURN in span else "end" if j == len(s) else "cue" if CUE in span else "gap" if span else "tight"
            case = case_of(s[j : j + 1])
            if case == "nospace" and s[j] == "と":
                case = "to"
            seen = _seen(form, cls, case, brk, "")
            if marked == "m" and case in ("upper", "caseless") and cls.startswith(("close", "quote0")):
                w = words_after(s, j)
                short = 1 < len(w) <= 5
                told = short and any(folded(x) in reports for x in w)
                key = (seen, short, told, case)
                seen = _known.get(key) or _keep(key, (*seen, f"clause={short}", f"clause={short}|{case}", f"told={told}", f"told={told}|{case}"))
            out.append(Event(i, end, cls, case, brk, marked, seen))
            taken = end
            continue
        if c == ";":
            if not greek or not (s[i - 1 : i].isalnum() or s[i - 1 : i] in ("_", ")")):
                continue
            cls = "!"
        elif c in "—–-":
            cls = "dash"
            if not s[i - 1 : i].isalnum() or not _BROKEN_OFF.match(s, i) or (c == "-" and not _HYPHEN_LAST.match(s, i)):
                continue
        else:
            while s[end : end + 1] in _MARKS and end < len(s):
                end += 1
            tok = s[i:end]
            cls = "…" if "…" in tok or tok.startswith("..") else _CLASS[tok[-1]]
        if replaced and s[end : end + 1] == "�" and not s[end + 1 : end + 2].isalpha():
            end += 1
        j = _SKIP.match(s, end).end()
        span = s[end:j]
        brk = "turn" if TURN in span else "end" if j == len(s) else "cue" if CUE in span else "line" if "\n" in span or "\r" in span else "gap" if span else "tight"
        case = case_of(s[j : j + 1])
        if case in ("open", "other") and s[j] in _QUOTES and (s[j] in _CLOSERS or brk == "tight"):
            case = "closing"
        if cls == ".":
            if brk == "tight" and (case == "digit" or (case in ("lower", "upper", "caseless") and not s[i - 2 : i].isalpha())):
                continue  # inside a figure, an initialism or an address
            word = word_before(s, i)
            seen = _stop_seen(word, case, brk, s, i, j, form)
        else:
            seen = _seen(form, cls, case, brk, "")
        out.append(Event(i, end, cls, case, brk, word, seen))
        taken = end
    last = len(s.rstrip(_BLANKS))
    if last and (not out or out[-1].end < last):
        out.append(Event(last, last, "cue", "end", "end", "", _seen(form, "cue", "end", "end", "")))
    return out


def viterbi(chain: list[Event], model: dict[str, list[float]], memo: dict | None = None) -> list[int]:
    """The best tags of a chain. model: scores of the four tags by observation, and by `>class|tag` of the tags after a tag; memo: sums by observations, while the model stays."""
    if not chain:
        return []
    memo = {} if memo is None else memo
    if len(memo) > MEMO:
        memo.clear()
    best, back = {BOUNDARY: 0.0}, []
    for e in chain:
        got = memo.get(id(e.seen))
        if got is None:
            sums = [0.0] * 4
            for f in e.seen:
                if (w := model.get(f)) is not None:
                    sums = [a + b for a, b in zip(sums, w)]
            moves = [(p, [(t, w + sums[t]) for t, w in enumerate(model.get(f">{e.cls}|{p}", ())) if w > NEVER / 2]) for p in TAGS]
            got = memo[id(e.seen)] = [ts or [(BOUNDARY if p < QUOTED else p, NEVER + sums[p])] for p, ts in moves]
            got.append(e.seen)  # kept, so that its id stays its own
        new: dict[int, float] = {}
        come: dict[int, int] = {}
        for p, score in best.items():
            for t, w in got[p]:
                x = score + w
                if t not in new or x > new[t]:
                    new[t], come[t] = x, p
        best = new
        back.append(come)
    tag = max(best, key=best.get)
    tags = []
    for come in reversed(back):
        tags.append(tag)
        tag = come[tag]
    return tags[::-1]


_WEIGHTS = os.path.join(os.path.dirname(__file__), "sentence_weights.json")
_loaded: dict[str, list[float]] = {}


def weights() -> dict[str, list[float]]:
    if not _loaded:
        with open(_WEIGHTS, encoding="utf-8") as f:
            _loaded.update(json.load(f))
    return _loaded


_lexica: dict[int, tuple[dict, frozenset[str], frozenset[str]]] = {}


def lexica(model: dict[str, list[float]]) -> tuple[frozenset[str], frozenset[str]]:
    """The words by which the model knows an advert, and those that report a quotation; they lie in it as `ad=word` and `report=word`."""
    known = _lexica.get(id(model))
    if known is None or known[0] is not model:
        _lexica.clear()
        known = _lexica[id(model)] = (model, *(frozenset(f[len(k) :] for f in model if f.startswith(k)) for k in ("ad=", "report=")))
    return known[1:]


def sentence_ends(text: str | None, model: dict[str, list[float]] | None = None, memo: dict | None = None) -> list[int]:
    """Offsets just after the last character of each sentence, ascending."""
    if not text or not text.strip():
        return []
    model = weights() if model is None else model
    right = reread(text)
    adverts, reports = lexica(model)
    s, ads = spoken(right[0] if right else text, adverts)
    chain = events(s, *habit(s), reports)
    ends, start = set(ads), 0
    for e, tag in zip(chain, viterbi(chain, model, memo)):
        if tag == BOUNDARY and e.end > start and _ALNUM.search(s, start, e.end):
            ends.add(e.end)
            start = e.end
    last = len(s.rstrip(_BLANKS))
    if last > start and _ALNUM.search(s, start, last):
        ends.add(last)  # a text's end is a sentence's
    out = sorted(e for e in ends if e)
    return [right[1][e - 1] for e in out] if right else out


def boundaries(documents: DataFrame) -> DataFrame:
    """doc_id, end_pos of every sentence."""
    model = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            ids, ends = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                e = sentence_ends(text, model, memo)
                ends += e
                ids += [doc] * len(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "end_pos"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, end_pos bigint")


def p9_found(documents: DataFrame) -> DataFrame:
    return boundaries(documents)

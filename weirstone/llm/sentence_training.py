"""Training of the sentence model: `python -m weirstone.llm.sentence_training DOCUMENTS.parquet WEIGHTS.json`.

There are no labelled sentences, so labels come from where a text itself shows its sentences, and no list of words is
needed (Kiss and Strunk showed the like for abbreviations):

- Sure ends. A turn, the end of a text, and in files without end marks, whose cues hold whole sentences, the end of a cue
  end a sentence whatever stands there. A word whose full stop is frequent but never stands at a sure end, as a title or
  a month, ends none elsewhere either (`Evidence`).
- Collocations. A word that mostly follows a figure with a point is part of a date; a word that mostly stands in the few
  words after a closing quotation mark, or right before an opening one, reports what is quoted; a word often followed by a small letter or a figure after
  its full stop is an abbreviation.
- Adverts. Words that hardly stand anywhere but in cues with a web address or a user's handle are those of adverts.
- Conventions of writing: a small letter or a comma after a mark continues its sentence, and so on (`ends_of`).

Texts with marks are labelled by these on the intact text. From them come the stripped copies: their sentences, without
end marks, some in small letters, are laid out one to a cue (in scripts without spaces also apart by gaps and lines), and
their ends are those known from the unstripped text. Files that have no marks of their own are left out of training,
but for scripts that never have any; on the others the model is tested (tests/llm/test_sentences.py).

The shipped weights: documents of sf0.1 with an even doc_id, at most SAMPLE of them in order of doc_id, SEED, ROUNDS.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable

from weirstone.llm.sentences import BOUNDARY, INSIDE, LED, NEVER, QUOTED, TAGS, Event, _ALNUM, _BLANKS, _MARKS, _WORD, events, folded, habit, viterbi, words_after  # noqa: PLC2701
from weirstone.llm.subtitles import CUE, NUL, TURN, cued, reread, spoken, suspects

#: Most documents that training reads.
SAMPLE = 5000
SEED = 9
ROUNDS = 8
#: Characters beyond which a quotation that isn't closed is taken for a stray mark in labelling.
STRAY = 400
_VOWELS = frozenset("aeiouyáéíóúàèêëïöüœæ’'")
_STYLES = ("“”", '""', "«»", "„“")
#: Observations seen less often get no weight.
LEAST_SEEN = 4
#: Occurrences of each word before a full stop at which training hides it, so that it learns what to make of words it doesn't know.
UNKNOWN = 8


class Text:
    """A text read rightly, its spoken characters and its chain."""

    def __init__(self, s: str, reports: Collection[str] = ()) -> None:
        self.s = s
        self.form, self.dense = habit(s)
        self.look(reports)
        self.bare = self.form in ("dense0", "few00", "few10")  # no end marks in use

    def look(self, reports: Collection[str]) -> None:
        self.chain = events(self.s, self.form, self.dense, reports)


def right_texts(texts: Iterable[str | None]) -> list[str]:
    return [(reread(t) or (t,))[0] for t in texts if t and t.strip()]


def advert_words_of(texts: list[str]) -> set[str]:
    """Words that hardly stand anywhere but in cues with an address or a handle."""
    total, beside = Counter(), Counter()
    for t in texts:
        for suspect, words in suspects(cued(t)):
            total.update(words)
            if suspect:
                beside.update(words)
    return {w for w, n in beside.items() if n >= 20 and n >= 0.9 * total[w]}


def read(texts: Iterable[str | None], adverts: Collection[str] = ()) -> list[Text]:
    return [Text(spoken(t, adverts)[0]) for t in right_texts(texts)]


class Evidence:
    """What a collection of texts tells of its words."""

    def __init__(self, texts: list[Text]) -> None:
        dots, sure, soft = Counter(), Counter(), Counter()
        total, dated, reports = Counter(), Counter(), Counter()
        for t in texts:
            total.update(folded(w) for w in _WORD.findall(t.s))
            if t.bare:
                for cue in t.s.split(CUE):
                    end = cue.rstrip(_BLANKS)
                    if _ALNUM.search(end):
                        sure[folded(re.split(r"[\s\x00]+", end)[-1].strip("\"“”«»„!?,;").rstrip("."))] += 1
                continue
            for e in t.chain:
                if e.cls == ".":
                    kind = "0" if e.word[-1:].isdigit() else folded(e.word.rstrip("."))
                    dots[kind] += 1
                    sure[kind] += e.brk in ("turn", "end")
                    soft[kind] += e.case in ("lower", "digit")
                    if kind == "0" and e.case == "upper" and (m := _WORD.search(t.s, e.end)):
                        dated[folded(m[0])] += 1
                elif e.word == "m" and e.case not in ("open", "nospace") and e.cls.startswith(("close", "quote0")):
                    reports.update({folded(w) for w in words_after(t.s, e.end)[:5]})
                elif e.cls.startswith(("openw", "quote10w", "quote11w")) and t.s[: e.at].rstrip(_BLANKS)[-1:] in ",:":
                    reports.update({folded(w) for w in _WORD.findall(t.s[max(0, e.at - STRAY) : e.at])[-1:]})
        rate = sum(sure[w] for w in dots) / max(1, sum(dots.values()))
        shapes, shaped = Counter(), Counter()
        for w, n in dots.items():
            shapes[self.shape(w)] += n
            shaped[self.shape(w)] += sure[w]
        never = lambda n, k: n * rate >= 3 and k < 0.1 * n * rate
        self.inner_shapes = {f for f, n in shapes.items() if never(n, shaped[f])}
        self.open_words = {w for w, n in dots.items() if never(n, sure[w])}
        self.ending = {w for w, n in sure.items() if n >= 3 and w not in self.open_words}
        self.soft = {w for w, n in dots.items() if soft[w] >= 0.15 * n}
        self.dates = {w for w, n in dated.items() if n >= 5 and n > 0.5 * total[w]}
        self.reports = {w for w, n in reports.items() if n >= 5 and n > 0.5 * total[w]}

    @staticmethod
    def shape(word: str) -> str:
        return "dotted" if "." in word else "letter" if len(word) == 1 else str(min(len(word), 5))

    def inner(self, word: str) -> bool:
        """Whether a word's full stop ends no sentence."""
        return word in self.open_words or (word not in self.ending and self.shape(word) in self.inner_shapes)


def _quotations(chain: list[Event]) -> dict[int, int]:
    """Index of the closing event by that of the opening one; quotations that stay open are left out."""
    out, opened = {}, None
    for n, e in enumerate(chain):
        if opened is not None and (e.at - chain[opened].at > STRAY or chain[n - 1].brk == "turn" and n - 1 > opened):
            opened = None
        if e.cls.startswith("open"):
            opened = n
        elif e.cls.startswith("close") and opened is not None:
            out[opened], opened = n, None
        elif e.cls.startswith("quote"):
            if opened is None:
                opened = n if e.cls[5] == "1" else None
            else:
                out[opened], opened = n, None
    return out


def tagged(t: Text, ends: set[int]) -> list[int]:
    """The tags of a text whose sentence ends are known."""
    close, tags, until, within, start = _quotations(t.chain), [], -1, INSIDE, 0
    for n, e in enumerate(t.chain):
        if n in close and n > until:
            until, within = close[n], LED if _ALNUM.search(t.s, start, e.at) else QUOTED
        if e.end in ends:
            tags.append(BOUNDARY)
            start = e.end
        else:
            tags.append(within if n < until else INSIDE)
    return tags


def ends_of(t: Text, known: Evidence) -> set[int]:
    """Sentence ends of an intact text with marks, by evidence and conventions."""
    close, until, led, start, out = _quotations(t.chain), -1, False, 0, set()
    for n, e in enumerate(t.chain):
        if n in close and n > until:
            until, led = close[n], bool(_ALNUM.search(t.s, start, e.at))
        if (n >= until and _ends(t, e, n == until, led, known)) or e.brk in ("turn", "end") and not e.cls.startswith("open"):
            out.add(e.end)
            start = e.end
    return out


def _ends(t: Text, e: Event, closes: bool, led: bool, known: Evidence) -> bool:
    case = e.case
    if e.cls.startswith(("open", "close", "quote")):
        if not closes or e.word != "m" or case in ("comma", "lower", "to", "mark", "closing"):
            return False
        if led or case == "open":
            return True
        said = words_after(t.s, e.end)
        return case != "nospace" and not (1 < len(said) <= 5 and any(folded(w) in known.reports for w in said))
    if e.cls in ("cue", "blank") or case in ("comma", "closing", "mark"):
        return False
    if e.cls == "dash":
        return case != "lower"
    if e.cls == "…":
        return case in ("upper", "open", "digit")
    if e.cls != ".":
        return True
    if t.dense and e.brk == "tight":
        return False
    word = folded(e.word.rstrip("."))
    after = _WORD.match(t.s, re.compile(r"[\s\x00\x1d\x1e]*").match(t.s, e.end).end())
    if case == "lower" and after and after[0][0] == "l" and after[0][1:2] not in _VOWELS:
        case = "upper"  # a capital I taken for a small l
    if e.word[-1:].isdigit():
        return case in ("upper", "open", "caseless") and not (after and folded(after[0]) in known.dates)
    if known.inner(word):
        return False
    if word in known.soft or known.shape(word) in ("dotted", "letter"):
        return case in ("upper", "open", "caseless")
    return case != "lower" or e.brk == "cue"


def bare_ends(t: Text, known: Evidence) -> set[int]:
    """Sentence ends of a text of a script that uses no end marks: ends of cues, gaps and lines, but for gaps beside figures and after titles."""
    inside, out, close, until = False, set(), _quotations(t.chain), -1
    for n, e in enumerate(t.chain):
        until = close.get(n, until) if n > until else until
        inside = n < until
        if e.brk in ("cue", "turn", "end") and not (e.cls.startswith("open")):
            out.add(e.end)
        elif not inside and t.dense and e.brk in ("gap", "line"):
            figure = e.brk == "gap" and any(c.isdigit() for c in (t.s[e.end - 1 : e.end], t.s[e.end :].lstrip(_BLANKS)[:1]))
            if not figure and (e.cls == "blank" or (e.cls == "." and folded(e.word.rstrip(".")) in known.ending)):
                out.add(e.end)
    return out


def stripped(t: Text, ends: set[int], draw: random.Random, known: Evidence) -> tuple[Text, set[int]]:
    """The sentences of an intact text without their end marks, laid out as files without marks are, and where they end now."""
    small, dashless, out, at, last, new = draw.random() < 0.5, draw.random() < 0.5, [], 0, 0, set()
    size = 0

    def put(x: str) -> None:
        nonlocal size
        out.append(x)
        size += len(x)

    for end in sorted(ends):
        raw, at = t.s[at:end], end
        said = re.sub(f"[{NUL}]+", "", raw.replace(TURN, " ").replace(CUE, "\n")).strip(_BLANKS)
        said = re.sub(r"[ \t]*[\r\n]+\s*", "" if t.dense else "\n", said).rstrip("".join(_MARKS) + ";" + _BLANKS)
        if not _ALNUM.search(said):
            continue
        said = re.sub(r"\s[—–]\s", " ", said) if dashless else said
        said = said.lower() if small else said
        beside = said[0].isdigit() or (out and out[-1][-1:].isdigit())
        if t.dense and last and draw.random() < 0.4:
            put("\n" if beside else draw.choice((" ", "　", "\n")))
        else:
            put(("\n\n" if last else "") + CUE + NUL * 9 + "\n")
        put(said)
        last = size
        new.add(size)
    return Text("".join(out), known.reports), new


def unclosed(t: Text, ends: set[int], draw: random.Random, known: Evidence) -> tuple[Text, set[int]] | None:
    """An intact text with one closing quotation mark blanked; what ended with the mark ends before it."""
    pairs = [n for n in _quotations(t.chain).values() if t.chain[n].cls.startswith("close")]
    if not pairs:
        return None
    at = t.chain[draw.choice(pairs)].at
    last = len(t.s[:at].rstrip(_BLANKS))
    return Text(t.s[:at] + NUL + t.s[at + 1 :], known.reports), {last if e == at + 1 else e for e in ends}


def requoted(t: Text, known: Evidence, draw: random.Random) -> Text | None:
    """An intact text with quotation marks of another style; its sentences end where they did."""
    pairs = _quotations(t.chain)
    if not pairs or t.dense:
        return None
    s, style = list(t.s), draw.choice(_STYLES)
    for a, b in pairs.items():
        s[t.chain[a].at], s[t.chain[b].at] = style
    return Text("".join(s), known.reports)


def examples(texts: list[Text], known: Evidence, seed: int = SEED) -> list[tuple[list[Event], list[int]]]:
    draw, out = random.Random(seed), []
    for t in texts:
        t.look(known.reports)
        if t.form == "dense0":
            out.append((t.chain, tagged(t, bare_ends(t, known))))
        elif not t.bare:
            ends = ends_of(t, known)
            out.append((t.chain, tagged(t, ends)))
            if draw.random() < 0.15 and (copy := unclosed(t, ends, draw, known)):
                out.append((copy[0].chain, tagged(*copy)))
            if draw.random() < 0.2 and (other := requoted(t, known, draw)):
                out.append((other.chain, tagged(other, ends)))
            if draw.random() < 0.25 or t.dense:
                copy, new = stripped(t, ends, draw, known)
                out.append((copy.chain, tagged(copy, new)))
    hidden: Counter = Counter()
    for chain, _ in draw.sample(out, len(out)):
        for e in chain:
            if e.cls == "." and e.brk in ("gap", "line", "cue") and hidden[e.word, e.case] < UNKNOWN:
                hidden[e.word, e.case] += 1
                e.seen = tuple(f for f in e.seen if not f.startswith("w="))
    return out


def train(chains: list[tuple[list[Event], list[int]]], rounds: int = ROUNDS, transitions: bool = True, seed: int = SEED) -> dict[str, list[float]]:
    """Averaged structured perceptron. Without transitions each event is tagged by itself, for comparison."""
    counts = Counter(f for chain, _ in chains for e in chain for f in e.seen)
    keep = {f for f, n in counts.items() if n >= LEAST_SEEN}
    w: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
    total: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
    met: dict[str, set[int]] = defaultdict(set)
    for chain, gold in chains:
        for p, e, g in zip([BOUNDARY, *gold], chain, gold):
            met[f">{e.cls}|{p}"].add(g)
    classes = {f[1:].split("|")[0] for f in met}
    for cls in classes:
        for p in TAGS:
            seen = met.get(f">{cls}|{p}", set()) if transitions else {g for q in TAGS for g in met.get(f">{cls}|{q}", ())}
            w[f">{cls}|{p}"] = [0.0 if g in seen else NEVER for g in TAGS]
    pruned = {id(e): tuple(f for f in e.seen if f in keep) for chain, _ in chains for e in chain}
    order, step, draw = list(range(len(chains))), 1, random.Random(seed)
    for _ in range(rounds):
        draw.shuffle(order)
        for n in order:
            chain, gold = chains[n]
            got = viterbi(chain, w, {})
            if got != gold:
                for p, q, e, g, h in zip([BOUNDARY, *gold], [BOUNDARY, *got], chain, gold, got):
                    if g == h and p == q:
                        continue
                    for t, d in ((g, 1.0), (h, -1.0)):
                        for f in pruned[id(e)]:
                            w[f][t] += d
                            total[f][t] += d * step
                    if transitions:
                        for f, t, d in ((f">{e.cls}|{p}", g, 1.0), (f">{e.cls}|{q}", h, -1.0)):
                            w[f][t] += d
                            total[f][t] += d * step
            step += 1
    mean = {f: [round(a - b / step, 3) if a > NEVER / 2 else NEVER for a, b in zip(w[f], total[f])] for f in w}
    return {f: v for f, v in sorted(mean.items()) if any(v) or f.startswith(">")}


def fitted(sample: list[str | None], rounds: int = ROUNDS) -> dict[str, list[float]]:
    """The model of a sample of texts."""
    adverts = advert_words_of(right_texts(sample))
    texts = read(sample, adverts)
    known = Evidence(texts)
    return train(examples(texts, known), rounds) | {w: [1.0, 0.0, 0.0, 0.0] for w in sorted([f"ad={w}" for w in adverts] + [f"report={w}" for w in known.reports])}


def main(documents: str, weights: str) -> None:
    import pyarrow.parquet as pq

    rows = sorted(pq.read_table(documents, columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    model = fitted([r["text"] for r in rows if r["doc_id"] % 2 == 0][:SAMPLE])
    with open(weights, "w", encoding="utf-8") as f:
        json.dump(model, f, ensure_ascii=False, indent=0, sort_keys=True)


if __name__ == "__main__":
    main(*sys.argv[1:3])

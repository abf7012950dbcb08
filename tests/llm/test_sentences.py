import itertools
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weirstone.llm import sentence_training as T
from weirstone.llm import sentences as S
from weirstone.llm.subtitles import CUE, reread, spoken


def srt(*cues):
    return "".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},500\n{c}\n\n" for i, c in enumerate(cues, 1))


def units(text):
    """The sentences, without what isn't speech, white space folded."""
    s, _ = spoken(text, S.lexica(S.weights())[0])
    out, at = [], 0
    for e in S.sentence_ends(text):
        out.append(re.sub(r"\s+", " ", re.sub("[\x00\x1d\x1e]", " ", s[at:e])).strip())
        at = e
    return out


CASES = [
    (["We met on Jan. 9, on the", "night train. Go on… Tell us."], ["We met on Jan. 9, on the night train.", "Go on…", "Tell us."]),
    (['"Wait. Is the map empty?" Tinost\nasked. It opens at 2 a.m. on weekdays.'], ['"Wait. Is the map empty?" Tinost asked.', "It opens at 2 a.m. on weekdays."]),
    (["The boat left at 7", "[THUNDER] p.m. Nobody waved."], ["The boat left at 7 p.m.", "Nobody waved."]),
    (["“Why?” “Because the map is\nlost.” Look out!"], ["“Why?”", "“Because the map is lost.”", "Look out!"]),
    (["OSKEL: But I thought the map was—", "It was never warm!"], ["But I thought the map was—", "It was never warm!"]),
    (["- No!\n- Not the A.B.K. office.", "<i>Wait... let me count.</i>"], ["No!", "Not the A.B.K. office.", "Wait... let me count."]),
    (["Captain Quell shouted, \"Stop! The\nmap is heavy!\" What?!", "(sighs)", "See No. 10. Never."], ['Captain Quell shouted, "Stop! The map is heavy!"', "What?!", "See No. 10.", "Never."]),
    (["„Ist der Brief leer?“, fragte\nJost. Am 2. 5. war er da. Das sind ca. 4,7 km, d.", "h. weit. Am 11. März wird er da sein."], ["„Ist der Brief leer?“, fragte Jost.", "Am 2. 5. war er da.", "Das sind ca. 4,7 km, d. h. weit.", "Am 11. März wird er da sein."]),
    (["Tano gritó: «¡Alto! El baúl está\nroto». La Dra. Brisa vive en la av. Sur, 2. ¡No!"], ["Tano gritó: «¡Alto! El baúl está roto».", "La Dra. Brisa vive en la av. Sur, 2.", "¡No!"]),
    (["«Разве маяк тёплый?» — спросил он.\nВ 10 ч. утра г. Лурия ушёл.Стой!"], ["«Разве маяк тёплый?» — спросил он.", "В 10 ч. утра г. Лурия ушёл.", "Стой!"]),
    (["“箱子还热着。”船长说。老郝问：“钟楼还热着吗？”\n我只是……想看看。"], ["“箱子还热着。”船长说。", "老郝问：“钟楼还热着吗？”", "我只是……想看看。"]),
    (["叔父は「待って！鞄は重い。」と言った。ただ…鞄が見たかった。"], ["叔父は「待って！鞄は重い。」と言った。", "ただ…鞄が見たかった。"]),
    (["Ήταν βαρύς, π.χ. ο κήπος; Όχι!"], ["Ήταν βαρύς, π.χ. ο κήπος;", "Όχι!"]),
    (["دفع د. سالم 5.4 دينار. أين الجسر؟ لا!"], ["دفع د. سالم 5.4 دينار.", "أين الجسر؟", "لا!"]),
    (["डॉ. रमोला ने 6.4 लीटर माँगा। पुल कहाँ है?"], ["डॉ. रमोला ने 6.4 लीटर माँगा।", "पुल कहाँ है?"]),
    (["ตั๋วอยู่ที่ไหน  ราคา 5.5 บาท", "เรือออกตอน 9.30 น.", "ไปกันเถอะ\nดร.มานิตรอ"], ["ตั๋วอยู่ที่ไหน", "ราคา 5.5 บาท", "เรือออกตอน 9.30 น.", "ไปกันเถอะ", "ดร.มานิตรอ"]),
    (["快走", "一共5.9公里　我觉得车票是空的\n旧桥在哪里"], ["快走", "一共5.9公里", "我觉得车票是空的", "旧桥在哪里"]),
    (["they sold it approx. 4.7 km\nfrom st. marrit's chapel", "Go on", "tell us about the ledger"], ["they sold it approx. 4.7 km from st. marrit's chapel", "Go on", "tell us about the ledger"]),
]


@pytest.mark.parametrize("cues, want", CASES)
def test_conventions(cues, want):
    assert units(srt(*cues)) == want


def test_adverts_are_whole_and_interrupt_nothing():
    text = srt("The map was", "Subtitles by pen62.\nGet more at www.x.example!", "quite empty. Yes!")
    ends = S.sentence_ends(text)
    assert len(ends) == 3
    assert text[: ends[0]].endswith("www.x.example!") and text[: ends[1]].endswith("quite empty.")


@pytest.mark.parametrize("last, first", [("<i>“Is the map empty?” Jorun</i>", '<font color="#ffff00">asked.</font> It is.'), ("“Is the map empty?”", '<font color="#ffff00">Jorun asked.</font> It is.'), ("“Is the map empty?” Aldous", "[THUNDER ROLLS ABOVE THE HARBOUR GATE]\nFray shouted. It is.")])
def test_reporting_clause_split_by_a_time_line(last, first):
    got = units(srt(last, first))
    assert len(got) == 2 and got[0].endswith(("asked.", "shouted.")) and got[1] == "It is."


def test_what_follows_a_quotation_without_reporting_it():
    got = units(srt("“The map is empty.” “Never again,” said Silquo, and", '<font color="#ffff00">sold the old bridge. Yes.</font>'))
    assert got == ["“The map is empty.”", "“Never again,” said Silquo, and sold the old bridge.", "Yes."]


def test_forms():
    vtt = "WEBVTT\n\n1\n00:01.000 --> 00:02.000 position:10%\nHello there. Bye!\n"
    assert [vtt[:e][-4:] for e in S.sentence_ends(vtt)] == ["ere.", "Bye!"]
    assert S.sentence_ends("Plain text. Two of them") == [11, 23]
    crlf = srt("A map. It\nis here.").replace("\n", "\r\n")
    assert [crlf[:e][-5:] for e in S.sentence_ends(crlf)] == [" map.", "here."]
    for empty in (None, "", " \n", "WEBVTT\n\n", srt("[THUNDER]", "♪ ♪")):
        assert S.sentence_ends(empty) == []


def test_misread_text_counts_as_it_stands():
    right = srt("¡El espejo está vacío! Ñandú.", "Так. “Да”, сказал он. Нет!")
    wrong = right.encode().decode("latin-1")
    assert reread(wrong)[0] == right and reread(right) is None
    assert S.sentence_ends(wrong) == [len(right[:e].encode()) for e in S.sentence_ends(right)]


def test_other_misreadings():
    right = srt("¡El espejo está vacío! Ñandú “uno” y “dos”.", "Está aquí. ¿Dónde?")
    twice = right
    for _ in range(2):
        twice = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in twice.encode())
    assert reread(twice)[0] == right
    put_in = twice.replace("Est", "＜鐘の音＞ 👩 Est")
    assert reread(put_in)[0].endswith(right[-12:])
    for text, encoding in ((srt("Так. Ты тут? Я здесь. Чёрный чемодан."), "cp1251"), (srt("Είναι εδώ. Όχι! Ποτέ κοντά στο κανάλι."), "cp1253")):
        wrong = text.encode(encoding).decode("latin-1")
        assert reread(wrong) == (text, list(range(1, len(text) + 1)))
        assert S.sentence_ends(wrong) == S.sentence_ends(text)
    assert reread("Où est le café ? « Déjà là\xa0», répéta-t-il.") is None


def test_viterbi_is_the_best_path():
    rng = random.Random(1)
    for _ in range(30):
        chain = [S.Event(i, i, rng.choice("ab"), "", "", "", (f"f{rng.randint(0, 5)}", f"g{rng.randint(0, 3)}")) for i in range(5)]
        w = {f: [rng.uniform(-2, 2) for _ in S.TAGS] for f in [*(f"f{i}" for i in range(6)), "g1", "g2"]}
        w |= {f">{c}|{p}": [rng.uniform(-2, 2) if rng.random() < 0.8 else S.NEVER for _ in S.TAGS] for c in "ab" for p in S.TAGS}

        def score(tags, chain=chain, w=w):
            return sum(w[f">{e.cls}|{p}"][t] + sum(w[f][t] for f in e.seen if f in w) for p, t, e in zip([S.BOUNDARY, *tags], tags, chain))

        best = max(score(tags) for tags in itertools.product(S.TAGS, repeat=5))
        if best > S.NEVER / 2:
            assert abs(score(S.viterbi(chain, w)) - best) < 1e-9


def test_a_quotation_that_never_closes_holds_nothing_back():
    assert units(srt("“The map is empty. Nobody waved.", "The boat left. It is here.", "No! Never."))[-4:] == ["The boat left.", "It is here.", "No!", "Never."]


@pytest.fixture(scope="module")
def halves():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [[r["text"] for r in texts if r["doc_id"] % 2 == k] for k in (0, 1)]


def test_the_chain_matters(halves):
    """Trained on one half of the documents and held against the labels of the other; without transitions several times as many tags are wrong."""
    train, held = map(T.read, halves)
    known = T.Evidence(train)
    chains = T.examples(train, known)
    for t in held:
        t.look(known.reports)
    gold = [(t.chain, T.tagged(t, T.ends_of(t, known))) for t in held if not t.bare]
    wrong = []
    for transitions in (True, False):
        model, memo = T.train(chains, 3, transitions), {}
        wrong.append(sum((g == S.BOUNDARY) != (h == S.BOUNDARY) for chain, tags in gold for g, h in zip(tags, S.viterbi(chain, model, memo))))
        assert transitions == any(len({tuple(v) for k, v in model.items() if k.startswith(f">{c}|")}) > 1 for c in (".", "!"))
    n = sum(len(c) for c, _ in gold)
    assert wrong[0] / n < 0.004 and wrong[1] > 3 * wrong[0], (wrong, n)


def test_files_without_marks(halves):
    """Files with spaces and without end marks take no part in training; each of their cues is a sentence."""
    model = T.fitted(halves[0], 3)
    held = [t for t in T.right_texts(halves[0] + halves[1]) if S.habit(spoken(t, S.lexica(model)[0])[0]) == ("few00", False)]
    hit = found = true = 0
    for t in held:
        s, ads = spoken(t, S.lexica(model)[0])
        want, at = set(ads), 0
        for cue in s.split(CUE):
            end = at + len(cue.rstrip(S._BLANKS))
            if S._ALNUM.search(s, at, end):
                want |= {end} if "\x1d" not in cue else set()
            at += len(cue) + 1
        if "\x1d" in s:
            continue
        got = set(S.sentence_ends(t, model))
        hit, found, true = hit + len(got & want), found + len(got), true + len(want)
    assert true > 300 and hit / true > 0.99 and hit / found > 0.99, (hit, found, true)


def test_words_are_learnt_not_listed(halves):
    known = T.Evidence(T.read(halves[0] + halves[1]))
    assert known.inner("mr") and known.inner("z") and not known.inner("map") and "asked" in known.reports and "märz" in known.dates
    assert {"subtitles", "downloaded"} <= T.advert_words_of(T.right_texts(halves[0] + halves[1]))


def test_rows(spark):
    long = srt(*["It is here. "] * 3) * 3000
    rows = [(1, srt("One. Two.")), (2, None), (3, ""), (4, long), (1, srt("One. Two."))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("end_pos", F.lit(0))
    got = S.p9_found(df).collect()
    assert sum(r["doc_id"] == 1 for r in got) == 4 and sum(r["doc_id"] == 4 for r in got) == 9000
    assert not [r for r in got if r["doc_id"] in (2, 3)] and S.p9_found(df.limit(0)).count() == 0

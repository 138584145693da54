from __future__ import annotations

import random

import numpy as np
import pytest

from gridloom.llm import sentences as S


def split(text, chunk=4096):
    _, start, end = S.sentence_spans([text], chunk)
    return [text[a:b] for a, b in zip(start, end, strict=True)]


CASES = {
    "Dr. K. S. Petrov met Mrs. Hill at 7 p.m. He left.": ["Dr. K. S. Petrov met Mrs. Hill at 7 p.m.", "He left."],
    "See sec. 4.23 at http://a.b/c.php?id=7. Why?! Pay 3.50 now": ["See sec. 4.23 at http://a.b/c.php?id=7.", "Why?!", "Pay 3.50 now"],
    "“We are done!” said Ann, and left. “It rained.” Then she slept.": ["“We are done!” said Ann, and left.", "“It rained.”", "Then she slept."],
    "„Ist das fertig?“, fragte er am 8. März. Es gibt z. B. Rohre.": ["„Ist das fertig?“, fragte er am 8. März.", "Es gibt z. B. Rohre."],
    "«Стой!» — крикнул сторож. — Готово? — спросил он. Да.": ["«Стой!» — крикнул сторож.", "— Готово? — спросил он.", "Да."],
    "„Je li gotovo?“, pita on. »Stani!« viknu Ana.Čekali su... i otišli.": ["„Je li gotovo?“, pita on.", "»Stani!« viknu Ana.", "Čekali su... i otišli."],
    "他问：“谁？”然后坐下了。“走吧！”她说。“好。”来了13个人。等了很久……终于来了！": ["他问：“谁？”然后坐下了。", "“走吧！”她说。", "“好。”", "来了13个人。", "等了很久……终于来了！"],
    "彼は「はい。」と答えた．「どう？」と聞いた｡（雨。）7.7節": ["彼は「はい。」と答えた．", "「どう？」と聞いた｡", "（雨。）", "7.7節"],
    "हल हुआ। “क्या हुआ?” उसने पूछा। “हाँ।” डॉ. शर्वेन आए।": ["हल हुआ।", "“क्या हुआ?” उसने पूछा।", "“हाँ।”", "डॉ. शर्वेन आए।"],
    "قال د. سرمون ذلك! «هل انتهى؟» سأل الحارس. «نعم.» حضر": ["قال د. سرمون ذلك!", "«هل انتهى؟» سأل الحارس.", "«نعم.»", "حضر"],
    "«Είναι έτοιμο;» ρώτησε. Έγινε; Ναι· όλα.": ["«Είναι έτοιμο;» ρώτησε.", "Έγινε;", "Ναι· όλα."],
    "มีคนมา 6 คน ต่อมาฝนตก ดีมาก! จบ": ["มีคนมา 6 คน", "ต่อมาฝนตก", "ดีมาก!", "จบ"],
    "Home | Map\n\nTitle\n \nA line\nwrapped. Bye": ["Home | Map", "Title", "A line\nwrapped.", "Bye"],
    "9. Sitzung\n\nIm Jahr 2007. Dann": ["9. Sitzung", "Im Jahr 2007.", "Dann"],
    "« C'est dit. » Le Dr. A. Bo est là ? Oui.": ["« C'est dit. »", "Le Dr. A. Bo est là ?", "Oui."],
}


#: Abbreviations of several languages, and words and addresses of any length.
CASES |= {t: [t] for t in (
    "La Sra. López vino.", "Il sig. Rossi parla.", "De heer dhr. Jansen komt.", "It takes approx. Number 5.", "On 5 Jan. Smith left.",
    "See http://example.org/" + "a" * 100 + ".Xy now.", "See http://example.org/" + "a" * 5000 + ".Xy now.", "Die Fa. Holz & Co. KG zahlt.",
    "Am 8. März kam er.", "Am 8. MÃ¤rz kam er.", "Es gibt z. B. Rohre.", "x" * 300 + "’Prof. Hill came.",
)}
CASES |= {
    "Die Fa. Holz & Co. Karl zahlt.": ["Die Fa. Holz & Co.", "Karl zahlt."], "Es war der 8. Marta kam.": ["Es war der 8.", "Marta kam."],
    "Er ging z. Bald kam er.": ["Er ging z.", "Bald kam er."], "Es war 2008. Juni kam.": ["Es war 2008.", "Juni kam."],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert split(text) == CASES[text]


def sequential(text):
    signs, symbols, _ = S.classify(text)
    kinds = [*range(15), *S._words().letters]
    word, told = ("out", True, False, True), []
    for x in symbols.tolist():
        word, out = S._read(word, kinds[x])
        told.append(out)
    signs = S.with_words(signs, np.array(told, np.uint8))
    state, starts, maybe = S._START, set(), -1
    for i, sign in enumerate(signs.tolist()):
        state, out = S.transition(state, sign)
        if out == S.STARTS:
            starts.add(i)
        elif out == S.MAY_START:
            maybe = i
        elif out == S.STARTED:
            starts.add(maybe)
    return sorted(starts)


def test_parallel_scan_equals_the_sequential_machine():
    random.seed(6)
    pieces = [*CASES, "\n\n", "\n", " ", "A. ", "x! ", "— ", "“", "”", "。", "…", "12", "т. п. "]
    texts = ["", " \n ", "a"] + ["".join(random.choice(pieces) for _ in range(random.randint(1, 60))) for _ in range(60)]
    for chunk, some in ((1, texts[:5]), (3, texts[5:9]), (17, texts[:20]), (256, texts), (100_000, texts)):
        doc, start, _ = S.sentence_spans(some, chunk)
        for k, t in enumerate(some):
            assert start[doc == k].tolist() == sequential(t)


def test_cover_all_but_blanks():
    random.seed(7)
    text = "".join(random.choice(" \n.!?“”a1Aж।。«»—") for _ in range(5000))
    _, start, end = S.sentence_spans([text], 64)
    inside = "".join(text[a:b] for a, b in zip(start, end, strict=True))
    assert "".join(inside.split()) == "".join(text.split())
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in zip(start, end, strict=True))
    assert all(b <= c for b, c in zip(end, start[1:], strict=False))


def test_frame(spark):
    rows = [(1, "A b. C d."), (2, None), (3, ""), (4, " "), (1, "A b. C d."), (5, "One two. " * 30_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, start_char int")
    got = S.split_sentences(df).collect()
    assert sorted((r["start_char"], r["end_char"]) for r in got if r["doc_id"] == 1) == [(0, 4), (0, 4), (5, 9), (5, 9)]
    assert sum(r["doc_id"] == 5 for r in got) == 30_000 and {r["doc_id"] for r in got} == {1, 5}
    assert S.split_sentences(df.limit(0)).count() == 0

import random
import re

import numpy as np
import pytest

from corvane.llm import answer_defects as ad
from corvane.llm import language, personal_data
from corvane.llm.kernels import shingle_sets
from corvane.llm.personal_examples import labelled_examples
from corvane.session import table


@pytest.fixture(scope="module")
def samples(spark, sf):
    return [(r.lang, r.text) for r in table(spark, sf, "lang_samples").collect()]


def test_shingle_kernel():
    texts = ["A b c d", "a B, c; d!", "a b", "b a", "", None, "é È", "x" * 5000, "a b c a b c"]
    h, s = shingle_sets(texts, 3)
    sets = [set(h[s[i] : s[i + 1]].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and sets[2] != sets[3] and len(sets[2]) == 1
    assert not sets[4] and not sets[5] and len(sets[7]) == 1 and len(sets[8]) == 3


def test_language_held_out(samples):
    r = random.Random(0)
    rows = samples[:]
    r.shuffle(rows)
    cut = len(rows) // 2
    f = language.LanguageFilters.fit(rows[:cut])
    owner, letters, best, lead = f.sentences([t for _, t in rows[cut:]])
    good = [f.langs[b] == rows[cut:][o][0] for o, n, b, x in zip(owner, letters, best, lead, strict=True) if n > 20 and x > language.LEAD]
    assert np.mean(good) > 0.98


def test_language_cases(spark, samples):
    en = "The parcel was sent on Monday and it should arrive this week. "
    de = "Wir haben das Paket am Montag verschickt und es kommt bald an. "
    rows = [
        (1, en * 3, "English", "z"), (2, en * 3, "de", "z"), (3, en * 2 + de * 2, "en", "z"), (4, en * 3 + de, "en-US", "z"), (5, None, None, "z"), (6, "", "en", "z"), (7, "12 !", None, "z"),
        (8, en * 2, " ", "z"), (9, "```\n" + en * 3 + "\n```\n" + de * 3, "deu", "z"), (10, de * 4000, "de", "z"), (11, "see https://example.com/x", None, "z"), (12, de, "de", "z"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, given string").coalesce(1)
    got = {}
    for r in language.label_languages(d, samples).collect():
        got.setdefault(r.doc_id, []).append(r)
    lang = {k: [x.true_lang for x in v] for k, v in got.items()}
    assert lang[1] == lang[2] == lang[4] == lang[8] == ["en"] and sorted(lang[3]) == ["de", "en"] and lang[9] == lang[10] == lang[12] == ["de"]
    assert lang[5] == lang[6] == lang[7] == [None] and got[3][0].mixed and not got[4][0].mixed
    assert got[1][0].given == "en" and got[8][0].given is None and 0 < got[1][0].confidence < 1
    assert language.label_languages(d.limit(0), samples).count() == 0


def test_language_segments(spark, samples):
    en = "The parcel was sent on Monday and it should arrive this week. Please keep it at the desk."
    de = "Wir haben das Paket am Montag verschickt und es kommt bald an. Bitte heben Sie es gut auf."
    texts = [f"{en}\n```\nx = 1\n```\n{de} {en}", en, None, "", "12", f"42!\n{de}"]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, begin int").coalesce(1)
    got = {}
    for r in sorted(language.language_segments(d, samples).collect(), key=lambda r: (r.doc_id, r.segment)):
        got.setdefault(r.doc_id, []).append((r.segment, r.lang, texts[r.doc_id][r.begin : r.end]))
    assert got == {0: [(0, "en", en[:-1]), (1, "de", de[:-1]), (2, "en", en[:-1])], 1: [(0, "en", en[:-1])], 5: [(0, "de", de[:-1])]}
    assert language.language_segments(d.limit(0), samples).count() == 0


def test_text_of_nothing_but_tables_is_read(spark, samples):
    t = "| The parcel was sent on Monday and it should arrive this week. |\n| Please keep it at the desk until then. |"
    d = spark.createDataFrame([(1, t, None), (2, "|||", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.true_lang for r in language.label_languages(d, samples).collect()} == {1: "en", 2: None}


def test_decode_equals_plain_viterbi():
    m = personal_data.default_model()
    rng = np.random.default_rng(1)
    t = m.steps
    for n in (1, 2, 7, 60):
        e = rng.normal(size=(n, len(personal_data.LABELS))).astype(np.float32) * 4
        e[:, 0] += rng.random(n) * 3 * (t.max() - t.min())
        last = rng.random(n) < 0.2
        last[-1] = True
        want, s = [], 0
        for end in np.flatnonzero(last):
            score, back = e[s].astype(float), []
            for i in range(s + 1, end + 1):
                x = score[:, None] + t
                back.append(x.argmax(axis=0))
                score = x.max(axis=0) + e[i]
            y = [int(score.argmax())]
            for b in reversed(back):
                y.append(int(b[y[-1]]))
            want += y[::-1]
            s = end + 1
        assert m.decode(e, last).tolist() == want


def _recall(m, test):
    got = personal_data.find_items(m, [t for t, _ in test])
    hit = sum(len(set(s) & set(g)) for (_, s), g in zip(test, got, strict=True))
    return hit / sum(len(s) for _, s in test), hit / sum(len(g) for g in got)


def test_personal_held_out():
    m = personal_data.default_model()
    recall, precision = _recall(m, labelled_examples(600, seed=321))
    assert recall > 0.95 and precision > 0.95
    recall, precision = _recall(m, labelled_examples(800, seed=322, unseen=True))  # lines that are in no training text
    assert recall > 0.9 and precision > 0.9


def test_kept_weights_are_those_of_the_code():
    assert not hasattr(personal_data.default_model(), "digest")  # else it was fitted anew: keep its weights


def test_training_lines_are_none_of_the_tables(spark, sf):
    from pyspark.sql import functions as F

    from corvane.llm import personal_examples as pe

    held = table(spark, sf, "production_logs").select(F.explode("messages.content").alias("t")).unionByName(table(spark, sf, "chat_examples").select(F.explode(F.flatten("messages.content")).alias("p")).select(F.col("p.text").alias("t")))
    for t in ("documents", "embedding_texts", "lang_samples"):
        held = held.unionByName(table(spark, sf, t).select(F.col("text").alias("t")))
    every = "\n".join(r.t.lower() for r in held.filter("t IS NOT NULL").distinct().collect())
    for b in (*pe.HELD, pe.NONE, pe.PLAIN):
        for line in pe.lines(b):
            assert not [f for f in re.split(r"\{\w+\}|\n", line) if len(f.strip(" .,:;!?")) >= 12 and f.strip(" .,:;!?").lower() in every], line


def test_long_island_is_decoded_in_bounded_memory():
    m = personal_data.default_model()
    t = ("Anna Weber, " * 30_000) + "\n" + "Jan Koch\n" * 5000
    assert len(personal_data.find_items(m, [t])[0]) > 5000


def test_items_do_not_depend_on_the_batch():
    m = personal_data.default_model()
    r = random.Random(8)
    texts = []
    for t, _ in labelled_examples(200, seed=77):  # short texts, many cut next to an item
        w = t.split(" ")
        at = r.randrange(len(w) + 1)
        texts += [" ".join(w[:at]), " ".join(w[at:]), None]
    alone = [personal_data.find_items(m, [t])[0] for t in texts]
    assert sum(map(len, alone)) > 100
    for _ in range(3):
        order = r.sample(range(len(texts)), len(texts))
        assert personal_data.find_items(m, [texts[i] for i in order]) == [alone[i] for i in order]


def test_masking(spark):
    rows = [("a", ["Call me on (267) 555-0114. Thanks\n", None, ""], 1), ("b", None, 2), ("c", [], 3), ("d", ["word " * 20000 + "Mail: ann.lee@example.org"], 4)]
    d = spark.createDataFrame(rows, "id string, texts array<string>, n int")
    got = {r.id: r for r in personal_data.mark_items(d).collect()}
    assert got["a"].clean == ["Call me on [PHONE]. Thanks\n", None, ""] and got["b"].clean is None and got["c"].items == []
    assert [(i.kind, i.found) for i in got["d"]["items"]] == [("email", "ann.lee@example.org")]
    assert personal_data.mark_items(d.limit(0)).count() == 0


def test_suffix_automaton_brute_force():
    r = random.Random(2)
    for _ in range(60):
        a, b = ("".join(r.choices("abc", k=r.randrange(0, 25))) for _ in "xy")
        want = [any(b[s : s + 4] in a for s in range(max(0, i - 3), i + 1) if s + 4 <= len(b)) for i in range(len(b))]
        assert ad.SuffixAutomaton(a).covered(b, 4).tolist() == want


def test_defect_rules():
    q = "How can I move the appointment for order AB-12 at the Ashmont shop?"
    assert ad.is_copied(q, f'You asked: "{q.upper()}"') and not ad.is_copied(q, f"You asked: {q} Our team will check the calendar and write back by tomorrow evening.") and not ad.is_copied(q, "Next week")
    assert ad.is_refusal("I'm sorry, but I can't help with that. Please ask someone else.") and not ad.is_refusal("I'm sorry for the delay; the parcel leaves on Monday.")
    assert not ad.is_refusal("I can't help with that, but the desk at Ashmont will gladly book it for you.")
    assert ad._open_delimiters('x ```json\n{"a": 1') and ad._open_delimiters("see (the list") and not ad._open_delimiters("fine :) (2/2)\n1) one")


def test_defects(spark, samples):
    part = lambda t: [("text", t, None, None)]
    msg = lambda role, content, calls=None: (role, content, None, None, calls)
    full = "The parcel was sent on Monday and it should arrive this week."
    q = "When will the parcel that I ordered on Friday arrive at my home?"
    cases = {
        "ok": part(full), "empty": part(" — "), "none": None, "value": [("json", None, '{"n": 1}', None)], "refusal": part("Unfortunately, I am not able to answer this question."), "copied": part(q), "foreign": part("Das Paket wurde am Montag verschickt und es kommt in dieser Woche an."),
        "cut": part("The parcel was sent on Monday and it sho"), "short": part("On Monday"), "call": None,
    }
    rows = [(k, [msg("user", part(q)), msg("assistant", c, [("c", "f", "{}")] if k == "call" else None)], 1) for k, c in cases.items()]
    rows += [(f"more{i}", [msg("user", part(q)), msg("assistant", part(full))], 1) for i in range(12)] + [("ok", rows[0][1], 2), ("null", None, 1), ("first", [msg("assistant", None)], 1), ("asked", [msg("user", part(q + " Please answer in German.")), msg("assistant", cases["foreign"])], 1)]
    schema = "example_id string, messages array<struct<role:string,content array<struct<type:string,text:string,value:string,uri:string>>,name:string,toolCallId:string,toolCalls array<struct<id:string,name:string,arguments:string>>>>, defect int".replace("content array", "content:array").replace("toolCalls array", "toolCalls:array")
    d = spark.createDataFrame(rows, schema)
    got = {r.example_id: r.defect for r in ad.answer_defects(d, samples).collect()}
    assert got == {"empty": "empty", "none": "empty", "refusal": "refusal", "copied": "copied", "foreign": "other_language", "cut": "truncated"}
    assert ad.answer_defects(d.limit(0), samples).count() == 0


def test_endings_are_counted_exactly(spark, samples):
    msg = lambda role, t: (role, [("text", t, None, None)], None, None, None)
    q = "When will the parcel that I ordered on Friday arrive at my home?"
    # in a count-min sketch of 2^21 slots these words, as whole sentences, hide that the ending was never one
    texts = {"cut": "The parcel was sent on Monday and it baban"} | {f"w{i}": "Kaseta. Mipaso." for i in range(3)}
    rows = [(k, [msg("user", q), msg("assistant", t)]) for k, t in texts.items()]
    d = spark.createDataFrame(rows, "example_id string, messages array<struct<role:string,content:array<struct<type:string,text:string,value:string,uri:string>>,name:string,toolCallId:string,toolCalls:array<struct<id:string,name:string,arguments:string>>>>")
    assert [tuple(r) for r in ad.answer_defects(d, samples).collect()] == [("cut", 1, "truncated")]


def test_sentence_counts_brute_force(spark):
    texts = ["One two three four. One two", "one two three four. One two three", "One two", None, "Other words here."] * 3
    words = ("one", "one two", "one two three", "one two three four")
    hs = {w: ad.last_sentences([w])[0][0][0] for w in words} | {"never seen": 5}
    tails = {w: ad.last_sentences([f"so {w}"])[0][0][4 - n] for n, w in enumerate(("four", "three four", "two three four"))}
    asked = spark.createDataFrame([(h,) for h in (hs | tails).values()], "h long")
    got = {r.h: (r.goes_on, r.whole, r.final) for r in ad.sentence_counts(spark.createDataFrame([(t,) for t in texts], "text string"), asked, 8).collect()}
    assert {k: got.get(h, (0, 0, 0)) for k, h in hs.items()} == {"one": (15, 0, 0), "one two": (9, 0, 6), "one two three": (6, 0, 3), "one two three four": (0, 6, 0), "never seen": (0, 0, 0)}
    assert {k: got.get(h, (0, 0, 0)) for k, h in tails.items()} == {w: (0, 6, 0) for w in tails}


def test_sentences():
    texts = ["1. Update: The big Parcel is here (now).\n- And \"more\" of it", "```\nx. y\n```", None, "", "…", "It's 12 o'clock! Go", "A: b"]
    s = ad.sentences(texts)
    rows = [(int(o), bool(e), int(b - a)) for o, e, a, b in zip(s.owner, s.ended, s.first[:-1], s.first[1:], strict=True)]
    assert rows == [(0, True, 6), (0, False, 4), (5, True, 3), (5, False, 1), (6, False, 1)]
    one = ad.last_sentences(["The Ann is in Rome", "the Bob is in Oslo", "the bob is in oslo", "the Bob is in 12"])
    assert one[0] == one[1] and len({x[0][0] for x in one}) == 3 and [x[2] for x in one] == [False, False, True, False]


def test_refusals_in_other_words():
    yes = ["Sorry, I simply cannot assist you here.", "I'm not in a position to comment on that.", "Dazu kann ich Ihnen leider keinerlei Auskunft geben.", "Je ne suis malheureusement pas habilité à vous répondre.", "No estoy en condiciones de contestar a eso.", "Purtroppo non sono in grado di fornire queste informazioni.", "Não consigo responder a esse pedido.", "Ik kan u daar helaas niets over zeggen."]
    no = ["I can help you with that on Monday.", "The desk cannot answer the phone at noon.", "Die Filiale hilft Ihnen nicht am Sonntag, aber online geht es.", "Nous vous aidons dès lundi.", "El plan no incluye los envíos.", "Non serve altro, il pacco arriva lunedì.", "O plano não inclui os envios.", "De winkel is niet open op maandag."]
    assert [ad.is_refusal(t) for t in yes] == [True] * len(yes) and [ad.is_refusal(t) for t in no] == [False] * len(no)

"""Broken answers: copied words by a suffix automaton, refusal automata, delimiter stacks, sentence ends, language votes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.format_duplicates import _positions, repeat_filter
from corvane.llm.kernels import code_points, mix, powers, tables
from corvane.llm.language import LanguageFilters
from corvane.plans.cut import cut
from corvane.plans.skew import join_per_key
from corvane.session import table

#: Letters and digits that a match of answer and prompt must have to count as copied.
COPIED_RUN = 12

# What declines, what only softens or redirects, and what turns a refusal into an answer. Lower case, single spaces.
REFUSALS = """
can't help with|cannot help with|can't assist|cannot assist|won't assist|will not assist|won't help you|will not help you|unable to provide that|unable to help|unable to assist|unable to answer|unable to respond|unable to comment
not able to answer|not able to help|not able to assist|not able to provide|not able to respond|must refuse|have to refuse|refuse to answer|have to decline|must decline|decline to|decline this|rather not|no answer will be given|can't say anything|cannot say anything
can't answer|cannot answer|can't provide that|cannot provide that|not allowed to answer|not permitted to|against my guidelines|can't discuss|cannot discuss|won't answer|will not answer|can't comment|cannot comment|prefer not to
kann ich nicht helfen|kann ihnen nicht helfen|kann ihnen dabei nicht|kann nichts über|darf diese frage nicht|nicht beantworten|werde ihnen nicht helfen|möchte ich mich nicht äußern|muss ich ablehnen|gebe ich keine|widerspricht meinen|ich lehne|kann dazu nichts|darf ich nicht|nicht weiterhelfen|helfe ihnen nicht
ne peux pas vous aider|ne peux pas répondre|ne peux rien dire|impossible de répondre|dois refuser|préfère ne pas|ne dirai rien|ne vous aiderai pas|contre mes consignes|refuse de répondre|ne suis pas en mesure|pas autorisé à|aucune réponse|ne peux pas fournir|ne répondrai pas
no puedo ayudarle|no puedo ayudar|no me es posible responder|no puedo responder|no diré nada|no puedo decir nada|prefiero no|debo rechazar|tengo que rechazar|no le ayudaré|no voy a ayudar|en contra de mis normas|no estoy autorizad|no se dará|no puedo facilitar|no puedo proporcionar|no responderé
non posso aiutarla|non posso aiutar|non mi è possibile rispondere|non posso rispondere|non dirò nulla|non posso dire nulla|preferisco non|devo rifiutare|non la aiuterò|contrario alle mie regole|non sono autorizzat|nessuna risposta|non posso fornire|non risponderò
não posso ajudar|não me é possível responder|não posso responder|não direi nada|não posso dizer nada|prefiro não|tenho de recusar|devo recusar|não vou ajudar|contra as minhas regras|não estou autorizad|nenhuma resposta|não posso fornecer|não responderei|tenho que recusar
kan ik niet helpen|ik niet helpen|mag deze vraag niet|niet beantwoorden|moet ik weigeren|zeg ik niets|ik help u niet|zeg ik liever niets|wil ik liever niet|liever niet|tegen mijn regels|kan ik niets|geef ik geen|kan u niet helpen|ik weiger|kan ik geen
""".strip().replace("\n", "|").split("|")
SOFTENERS = """
is there anything different|is there anything else|ask someone else|contact someone else|i'm sorry|i am sorry|apologies|unfortunately|as an assistant|wenden sie sich|es tut mir leid|leider|fragen sie jemand|vous adresser à|demandez à quelqu'un|désolé|malheureusement|mes excuses|a otra persona|consulte a|lo siento|lamentablemente|disculpe
si rivolga|qualcun altro|mi dispiace|purtroppo|fale com|outra pessoa|peço desculpa|infelizmente|lamento|vraag het|iemand anders|het spijt me|helaas|excuses|kann ich ihnen sonst|puis-je vous aider|puedo ayudarle en otra|posso aiutarla con altro|posso ajudar com outra|kan ik u ergens anders|merci de votre compréhension|thank you for understanding|gracias por su comprensión
""".strip().replace("\n", "|").split("|")
# By language, words of a first person who is able or willing, words that deny, and what is denied: beginnings of words.
DECLINES = {
    "en": ("i i'm i'd i'll we we're we'd", "not can't cannot won't don't couldn't wouldn't mustn't unable never nothing no neither", "help assist answer respond reply comment discuss say tell share advis disclos engage fulfil compl provid suppor talk speak handl weigh"),
    "de": ("ich wir mir uns", "nicht nichts kein außerstande unmöglich nie niemals", "helfen helfe behilflich beantwort antwort unterstütz auskunft auskünfte äußer sagen sage mitteil weiterhelf beitrag angaben stellung nachkomm besprech kommentier informationen liefern erfüll assistier"),
    "fr": ("je j nous m me", "pas rien aucun aucune jamais impossible guère", "aider aide répondre réponds réponse dire dis fournir fournis donner commenter renseign assister parler discuter traiter satisfaire éclairer accéder"),
    "es": ("puedo podemos voy vamos quiero debo estoy me nos pienso deseo sé podré", "no nada ningún ninguna nunca imposible tampoco", "ayud respond respuesta contest decir diré facilit proporcion coment hablar ofrecer asist atender inform dar opinar tratar"),
    "it": ("posso possiamo sono intendo voglio devo mi ci riesco potrò desidero", "non nulla niente nessun nessuna mai impossibile", "aiut rispo dire dirò forni assist comment parlar informa dare discut esprim trattar soddisf"),
    "pt": ("posso podemos vou vamos quero devo estou consigo pretendo me nos poderei", "não nada nenhum nenhuma nunca impossível", "ajud respo dizer direi forne coment falar inform dar discut atend trat auxili esclarec"),
    "nl": ("ik wij we me mij ons", "niet geen niets nooit onmogelijk", "help beantwoord antwoord zeggen zeg verstrek uitleg geven geef bespre ondersteun informatie reageer reageren ingaan bijstaan bijsta toelicht"),
}
#: Words within which a refusal's three parts must stand.
DECLINE_SPAN = 9
TURNS = re.compile(r"\b(?:but|yet|however|instead|aber|jedoch|sondern|mais|cependant|pero|sino|però|ma|porém|mas|maar|echter)\b")
# Names of the languages in each of the languages: a prompt that names one asks for it.
ASKED = {
    "en": "english englisch anglais inglés ingles inglese inglês engels",
    "de": "german deutsch allemand alemán aleman tedesco alemão duits",
    "fr": "french französisch français francais francés frances francese francês frans",
    "es": "spanish spanisch espagnol español espanol spagnolo espanhol spaans",
    "it": "italian italienisch italien italiano italiaans",
    "pt": "portuguese portugiesisch portugais portugués portugues portoghese português portugees",
    "nl": "dutch niederländisch néerlandais neerlandés neerlandes holandés olandese neerlandês holandês nederlands",
}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LEAD = re.compile(r"^[\s\-*•>#\d.)]*(?:[^\W\d_]+(?: [^\W_]+){0,3} ?[:–] )?")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»“)\]]*\s+|\n+")


class SuffixAutomaton:
    """All substrings of a text; ``covered`` walks another text through it."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def covered(self, text: str, run: int) -> np.ndarray:
        """Which characters of ``text`` lie in a common substring of ``run`` or more."""
        mark = np.zeros(len(text) + 1, np.int64)
        state = n = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                n += 1
            if n >= run:
                mark[i + 1 - n] += 1
                mark[i + 1] -= 1
        return np.cumsum(mark)[:-1] > 0


def _squeeze(t: str) -> str:
    return "".join(c for c in t.lower() if c.isalnum())


def is_copied(prompt: str, answer: str) -> bool:
    """The answer is the prompt's words and no more than a short lead-in."""
    a, p = _squeeze(answer), _squeeze(prompt)
    if len(a) < COPIED_RUN or not p:
        return False
    words = set(_WORD.findall(prompt.lower()))
    own = _WORD.findall(answer.lower())
    if sum(w in words for w in own) < 0.3 * len(own):
        return False
    run = min(COPIED_RUN, len(p))
    starts = [i for i in range(len(a) - run + 1) if a[i : i + run] in p]
    if len(starts) * run < 0.6 * len(a):  # common runs cannot cover enough, and no automaton is needed
        return False
    hit = SuffixAutomaton(p).covered(a, run)
    rest = int((~hit).sum())
    share = SuffixAutomaton(a).covered(p, min(COPIED_RUN, len(a))).mean()
    return bool(hit.mean() >= 0.6 and rest <= 40 and (share >= 0.5 or (hit.sum() >= 40 and rest <= 12)))


@cache
def _automata() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in SOFTENERS:
        a.add_word(p, ("soft", len(p)))
    for p in REFUSALS:
        a.add_word(p, ("refusal", len(p)))
    a.make_automaton()
    return a


_ABILITY = re.compile(r"can't |cannot |won't |will not |unable |not able |not allowed |not permitted ")


@cache
def _parts(word: str) -> tuple[tuple[str, int], ...]:
    """(language, part) pairs that a word can be: 0 the first person, 1 a denial, 2 what is denied."""
    out = []
    for lang, (own, deny, acts) in DECLINES.items():
        if word in own.split():
            out.append((lang, 0))
        if word in deny.split() or lang == "de" and word.startswith("kein"):
            out.append((lang, 1))
        if any(word.startswith(x) for x in acts.split()):
            out.append((lang, 2))
    return tuple(out)


def declines_at(sentence: str) -> int:
    """Where a sentence (lower case) has denied to help or answer, as listed or by three parts near each other; -1 if nowhere."""
    hits = [(e - n + 1, e) for e, (kind, n) in _automata().iter(sentence) if kind == "refusal"]
    english = DECLINES["en"][0].split()
    for begin, end in sorted(hits, key=lambda x: x[1]):
        words = _WORD.findall(sentence)
        # "the desk cannot answer the phone" declines nothing; "sorry, cannot help with that" does
        if not _ABILITY.match(sentence[begin:]) or any(w in english for w in words) or len(_WORD.findall(sentence[:begin])) <= 1:
            return end
    last: dict[str, list[int]] = {}
    for i, m in enumerate(re.finditer(r"[^\W_]+(?:'[^\W_]+)?", sentence)):
        w = m.group()
        for lang, part in _parts(w) if len(w) < 30 else ():
            at = last.setdefault(lang, [-99, -99, -99])
            at[part] = i
            if i - min(at) < DECLINE_SPAN:
                return m.end()
        if "'" in w and w[0] in "jnm" and w[1] == "'":  # French contractions: j', n', m'
            head, tail = w.split("'", 1)
            at = last.setdefault("fr", [-99, -99, -99])
            at[0] = i if head != "n" else at[0]
            for lang, part in _parts(tail):
                if lang == "fr":
                    at[part] = i
            if i - min(at) < DECLINE_SPAN:
                return m.end()
    return -1


def is_refusal(answer: str) -> bool:
    """Every sentence declines or only softens, and one declines."""
    refused = False
    wrapped = re.sub(r"[ \t]*\n(?=[^\W\d_])", lambda m: " " if answer[m.end()].islower() else "\n", answer)
    for s in _SENTENCE.split(wrapped):
        s = re.sub(r"\s+", " ", s.lower().replace("’", "'")).strip()
        if not any(c.isalnum() for c in s):
            continue
        at = declines_at(s)
        if at >= 0:
            refused = True
            turn = TURNS.search(s, at)
            if turn and len(_WORD.findall(s[turn.end() :])) >= 4:
                return False
        elif not any(True for _ in _automata().iter(s)) or len(_WORD.findall(s)) > 12:
            return False
    return refused


def _open_delimiters(t: str) -> bool:
    """A code fence or bracket is still open at the end (a stack; faces and list numbers are no brackets)."""
    if t.count("```") % 2:
        return True
    t = re.sub(r"```.*?```", "", t, flags=re.S)
    t = re.sub(r"[:;]-?[()\[\]]|(?m:^\s*\w{1,3}\))", "", t)
    stack = []
    for c in t:
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and stack and stack[-1] == {")": "(", "]": "[", "}": "{"}[c]:
            stack.pop()
    return bool(stack) or t.count("`") % 2 == 1


_FENCE = re.compile(r"```.*?(?:```|$)", re.S)


@dataclass
class Sentences:
    """Words of texts in a form without names and numbers, sentence by sentence; arrays by word and by sentence."""

    owner: np.ndarray  # by sentence: its text
    ended: np.ndarray  # by sentence: a stop or more text follows
    first: np.ndarray  # by sentence: its first word; one more at the end
    plain: np.ndarray  # by word: in lower case, neither a name nor a number
    beginning: np.ndarray  # by word: hash of the sentence up to it
    runs: tuple[np.ndarray, np.ndarray, np.ndarray]  # by word: hash of it alone, of the two, of the three words that end with it; 0 where there are not so many


@cache
def _classes() -> dict[str, np.ndarray]:
    n = 0x110000
    mark = {}
    for name, chars in {"stop": ".!?…", "closer": "\"'”»“)]", "tail": "\"'”»“)]*", "apostrophe": "'’", "lead": ":–"}.items():
        mark[name] = np.zeros(n, bool)
        mark[name][[ord(c) for c in chars]] = True
    mark["space"] = np.fromiter((chr(i).isspace() for i in range(n)), bool, n)
    mark["digit"] = np.fromiter((chr(i).isdigit() for i in range(n)), bool, n)
    return mark


def sentences(texts: list[str | None]) -> Sentences:
    """Sentences of texts, code fences left out: they end at a stop before white space, and at line ends but before lower case.

    A sentence's list number or mark and a lead of up to four words before a colon or dash are no
    part of it. Its first word counts in lower case; later capitalised words are one form, words
    with a digit another.
    """
    is_word, low = tables()
    c = _classes()
    cp, starts = code_points([_FENCE.sub("\n", t) if t and "```" in t else t for t in texts])
    none = np.empty(0, np.int64)
    if not len(cp):
        return Sentences(none, none, np.zeros(1, np.int64), none, none, (none, none, none))
    at = np.arange(len(cp))
    word, space, stop = is_word[cp].copy(), c["space"][cp], c["stop"][cp]
    quote = np.flatnonzero(c["apostrophe"][cp])
    quote = quote[(quote > 0) & (quote < len(cp) - 1)]
    word[quote[word[quote - 1] & word[quote + 1]]] = True
    before = np.maximum.accumulate(np.where(~c["closer"][cp], at, -1))  # the last character that closes nothing
    cut = cp == 10
    cut[:-1] &= ~(is_word[cp[1:]] & (low[cp[1:]] == cp[1:]) & ~c["digit"][cp[1:]])  # a line that goes on in lower case
    cut[starts[1:] - 1] = True
    cut[1:] |= space[1:] & np.where(before[:-1] >= 0, stop[before[:-1]], False)
    sid = np.cumsum(cut)
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    w = np.flatnonzero(begin)
    if not len(w):
        return Sentences(none, none, np.zeros(1, np.int64), none, none, (none, none, none))
    chars = cp[word]
    head = np.flatnonzero(begin[word])
    size = np.diff(np.append(head, len(chars)))
    end = w + size
    digits = np.add.reduceat(c["digit"][chars].astype(np.int64), head)
    small = np.add.reduceat((low[chars] == chars) & is_word[chars] & ~c["digit"][chars], head, dtype=np.int64)
    upper = low[cp[w]] != cp[w]
    place = np.arange(len(chars)) - np.repeat(head, size)
    value = mix(np.add.reduceat((low[chars].astype(np.uint64) + np.uint64(0x51ED27)) * powers(1 << max(6, int(size.max() - 1).bit_length()))[place], head) ^ size.astype(np.uint64))
    # leads and list numbers go
    sent = sid[w]
    new = np.ones(len(w), bool)
    new[1:] = sent[1:] != sent[:-1]
    k = np.arange(len(w)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    pad = np.append(cp, [10, 10, 10])
    colon = (c["lead"][pad[end]] & (pad[end + 1] == 32)) | ((pad[end] == 32) & c["lead"][pad[end + 1]] & (pad[end + 2] == 32))
    lead = np.flatnonzero(colon & (k <= 3))
    gone = np.zeros(int(sid[-1]) + 1, np.int64)
    gone[sent[lead[::-1]]] = k[lead[::-1]] + 1
    gone[sent[new & (digits == size) & (gone[sent] == 0)]] = 1
    keep = k >= gone[sent]
    w, end, sent, digits, small, upper, value, k = (x[keep] for x in (w, end, sent, digits, small, upper, value, k))
    if not len(w):
        return Sentences(none, none, np.zeros(1, np.int64), none, none, (none, none, none))
    k = k - gone[sent]
    new = k == 0
    name, number = (k > 0) & upper & (small > 0), digits > 0
    value = np.where(number, np.uint64(0x30), np.where(name, np.uint64(0x43), value))
    first = np.flatnonzero(new)
    ids = sent[first]
    owner = np.searchsorted(starts, w[first], side="right") - 1
    stops = np.append(np.flatnonzero(cut), len(cp))  # where a sentence id ends
    close = stops[np.searchsorted(stops, end[np.append(first[1:], len(w)) - 1])]
    visible = np.maximum.accumulate(np.where(~space, at, -1))
    more = visible[starts[owner + 1] - 1] >= close
    tail = np.maximum.accumulate(np.where(~(c["tail"][cp] | space), at, -1))
    ended = more | stop[tail[close - 1]]
    total = np.cumsum(value * powers(1 << max(6, int(k.max()).bit_length()))[k], dtype=np.uint64)
    base = np.concatenate([np.zeros(1, np.uint64), total])[first]
    nth = np.cumsum(new) - 1
    runs = []
    for n in range(3):
        x = value * powers(4)[1] + np.uint64(n + 1)
        for i in range(1, n + 1):
            x[i:] += value[:-i] * powers(4)[i + 1]
        runs.append(np.where(k >= n, mix(x), np.uint64(0)).view(np.int64))
    return Sentences(owner, ended, np.append(first, len(w)), ~(name | number), mix(total - base[nth]).view(np.int64), tuple(runs))


def sentence_counts(texts: DataFrame, asked: DataFrame, n_asked: int) -> DataFrame:
    """How often hashes of ``asked(h)`` occur in all ``texts(text)``: ``(h, goes_on, whole, final)``, exactly.

    ``goes_on``: words that began a sentence which went on; ``whole``: a whole ended one; ``final``:
    they ended a text without an end. For runs of one to three words the first two: going on, and
    ending a sentence. A Bloom filter of the asked hashes keeps all others from the shuffle; what it
    lets through besides them joins nothing later.
    """
    packed, bits = repeat_filter(asked.select(F.explode(F.array("h", "h")).alias("x")), n_asked)
    wanted = texts.sparkSession.sparkContext.broadcast(packed)  # at most 8 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            s = sentences(b.column(0).to_pylist())
            last = np.zeros(len(s.beginning), bool)
            last[s.first[1:] - 1] = True
            ended = np.repeat(s.ended.astype(bool), np.diff(s.first))
            going = [s.beginning[~last], *(r[~last] for r in s.runs)]
            whole = [s.beginning[last & ended], *(r[last & ended] for r in s.runs)]
            for i, parts in enumerate((going, whole, [s.beginning[last & ~ended]])):
                x, n = np.unique(np.concatenate(parts), return_counts=True)
                if not len(x):
                    continue
                at = _positions(x, bits).reshape(-1, len(x))
                ok = (wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)
                if ok.any():
                    none = np.zeros(int(ok.sum()), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[ok]), *(pa.array(n[ok] if j == i else none) for j in range(3))], ["h", "goes_on", "whole", "final"])

    seen = texts.mapInArrow(count, "h long, goes_on long, whole long, final long")
    return seen.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("goes_on", "whole", "final")))


def breaks_open(answer: str) -> bool | None:
    """Whether a text breaks off in a bracket, code block, list item or after a joining mark; None where only counts can tell."""
    if _open_delimiters(answer):
        return True
    t = re.sub(r"[\s*_~​✓—–]+$", "", re.sub(r"\n\s*--+\s*$", "", answer))
    if not t:
        return False
    if re.search(r"(?:^|\n)\s*(?:[-*•]|\d{1,3}[.)])\s*[*_`~]*\s*$", answer):
        return True
    if re.search(r"\S+://\S+$|\S+@\S+\.\w+$", t):
        return False
    if t[-1] in ",:;/(-":
        return True
    return None if t[-1].isalnum() else False


#: What is asked of a text without a full stop, in this order: its last sentence, that without its last word, its last three, two and one words.
ASKED_OF = ("sentence", "stem", "three", "two", "one")


def last_sentences(answers: list[str]) -> list[tuple[list[int | None], int, bool] | None]:
    """For each answer the hashes named by ``ASKED_OF``, its last sentence's words and whether the last is plain; None without a word."""
    s = sentences([re.sub(r"[\s*_~​✓—–]+$", "", re.sub(r"\n\s*--+\s*$", "", a)) for a in answers])
    out: list[tuple[list[int | None], int, bool] | None] = [None] * len(answers)
    for i, o in enumerate(s.owner):  # a text's last one stays
        a, b = int(s.first[i]), int(s.first[i + 1])
        runs = [int(r[b - 1]) if b - a > n else None for n, r in enumerate(s.runs)]
        out[int(o)] = ([int(s.beginning[b - 1]), int(s.beginning[b - 2]) if b - a > 1 else None, *runs[::-1]], b - a, bool(s.plain[b - 1]))
    return out


def breaks_off() -> F.Column:
    """Whether a text without a full stop is truncated, by the counts of its last sentence and of its last words."""
    n = lambda of, what: F.coalesce(F.col(f"{of}_{what}"), F.lit(0))
    goes_on, whole, final = (n("sentence", c) for c in ("goes_on", "whole", "final"))
    rule = (
        F.when((whole >= 2) & (whole * 25 >= goes_on), False)
        .when((final >= 4) & (final * 2 >= goes_on), False)
        .when((goes_on >= 10) & (whole == 0), True)
        # a word that is nowhere else, after words that do go on: broken off inside it
        .when(F.col("plain") & (n("one", "goes_on") + n("one", "whole") == 0) & (n("stem", "goes_on") >= 1), True)
    )
    for of, least in (("three", 4), ("two", 5)):  # seldom seen from its beginning: judge by its last words, wherever sentences had them
        rule = rule.when((n(of, "whole") >= 2) & (n(of, "whole") * 20 >= n(of, "goes_on")), False)
        rule = rule.when((n(of, "goes_on") >= 3) & (n(of, "whole") * 20 < n(of, "goes_on")) & (F.col("words") >= least), True)
    return rule.otherwise((goes_on >= 1) | (F.col("words") > 5))


def stopwords(samples: list[tuple[str, str]]) -> dict[str, dict[str, float]]:
    """Word to languages, from samples: words that several of a language's texts have, weighed down when others have them."""
    seen: dict[str, dict[str, int]] = {}
    for lang, text in samples:
        for w in {w.lower() for w in _WORD.findall(text) if w.islower()}:
            seen.setdefault(w, {}).setdefault(lang, 0)
            seen[w][lang] += 1
    return {w: {k: n / sum(c.values()) for k, n in c.items()} for w, c in seen.items() if max(c.values()) >= 2}


class Judge:
    """Decides the defect of a (prompt, answer), or says that counts must decide."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.votes, self.filters = stopwords(samples), LanguageFilters.fit(samples)
        self.asked = {w: k for k, ws in ASKED.items() for w in ws.split()}

    def languages(self, texts: list[str]) -> list[dict[str, float]]:
        """Each text's share of stopword votes by language; of letters times lead by n-gram filters where too few words vote."""
        out: list[dict[str, float]] = []
        for t in texts:
            v: dict[str, float] = {}
            for w in _WORD.findall(re.sub(r"```.*?(?:```|$)", " ", t, flags=re.S).lower()):
                for k, x in self.votes.get(w, {}).items():
                    v[k] = v.get(k, 0) + x
            out.append(v)
        weak = [i for i, v in enumerate(out) if sum(v.values()) < 6 or max(v.values()) < 0.6 * sum(v.values())]
        if weak:
            owner, letters, best, lead = self.filters.sentences([texts[i] for i in weak])
            soft: dict[int, dict[str, float]] = {}
            for o, n, b, x in zip(owner, letters, best, lead, strict=True):
                if x >= (0.05 if n >= 20 else 0.25) and o < len(weak):
                    d = soft.setdefault(int(o), {})
                    d[self.filters.langs[b]] = d.get(self.filters.langs[b], 0) + float(n * x)
            for j, i in enumerate(weak):
                out[i] = soft.get(j, {})
        total = [sum(v.values()) or 1 for v in out]
        return [{k: x / n for k, x in v.items()} for v, n in zip(out, total, strict=True)]

    def __call__(self, pairs: list[tuple[str, str, bool]]) -> list[str | None]:
        """Defects of (prompt, answer's text, whether it has a value or uri); ``open`` where counts of its last words must tell."""
        langs = self.languages([x for p, a, _ in pairs for x in (p, a)])
        out: list[str | None] = []
        for i, (p, a, other) in enumerate(pairs):
            if not any(c.isalnum() for c in a):
                out.append(None if other else "empty")
                continue
            user, own = langs[2 * i], langs[2 * i + 1]
            if is_copied(p, a):
                out.append("copied")
            elif not other and is_refusal(a):
                out.append("refusal")
            elif len(_WORD.findall(a)) >= 4 and self._foreign(p, user, own):  # "Non" is right in several languages
                out.append("other_language")
            else:
                last = breaks_open(a)
                out.append("open" if last is None else "truncated" if last else None)
        return out

    def _foreign(self, prompt: str, user: dict[str, float], own: dict[str, float]) -> bool:
        if not user or not own:
            return False
        mine, theirs = max(own, key=own.get), max(user, key=user.get)
        if mine == theirs or own[mine] < 0.6 or user.get(mine, 0) > 0.35 or user[theirs] < 0.5 or own.get(theirs, 0) > 0.3:
            return False
        return mine not in {self.asked[w] for w in _WORD.findall(prompt.lower()) if w in self.asked}


OUT = "example_id string, msg_idx int, defect string, hashes array<long>, words int, plain boolean"


def _texts(content: list[dict] | None) -> tuple[str, bool]:
    parts = content or []
    return "\n".join(p["text"] for p in parts if p and p["text"]), any(p and (p["value"] or p["uri"]) for p in parts)


def answer_defects(examples: DataFrame, samples: list[tuple[str, str]]) -> DataFrame:
    """``(example_id, msg_idx, defect)`` of every assistant message in ``examples(example_id, messages)`` that is no answer.

    Judged are assistant messages without tool calls after a user message, against the nearest one
    before. Defects, the first that holds: ``empty``, ``copied``, ``refusal``, ``other_language``,
    ``truncated``. A message's texts are joined by line ends and read whole. Null messages, contents
    and texts count as nothing; an example delivered again gives the same rows, once; an empty table
    gives none; other columns are ignored. A text without a full stop is
    judged by exact counts, over all messages, of its last sentence and its last words (64-bit hashes).
    """
    spark = examples.sparkSession
    rows = examples.select("example_id", "messages").filter("example_id IS NOT NULL AND messages IS NOT NULL")
    said = rows.select(F.explode("messages").alias("m")).filter("m.role = 'assistant'").select(F.array_join(F.transform("m.content", lambda p: p["text"]), "\n").alias("text"))
    given = spark.sparkContext.broadcast(samples)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(given.value)
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            where, pairs = [], []
            for ex, messages in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prompt = None
                for i, m in enumerate(messages):
                    if not m:
                        continue
                    if m["role"] == "user":
                        prompt = _texts(m["content"])[0]
                    elif m["role"] == "assistant" and prompt is not None and not m["toolCalls"]:
                        where.append((ex, i))
                        pairs.append((prompt, *_texts(m["content"])))
            kinds = j(pairs) if pairs else []
            at = [i for i, x in enumerate(kinds) if x == "open"]
            got = [(*where[i], x, None, None, None) for i, x in enumerate(kinds) if x and x != "open"]
            got += [(*where[i], None, *x) for i, x in zip(at, last_sentences([pairs[i][1] for i in at]), strict=True) if x]
            if got:
                types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), types, strict=True)], ["example_id", "msg_idx", "defect", "hashes", "words", "plain"])

    found = cut(rows.mapInArrow(find, OUT).distinct())
    open_ = found.filter("defect IS NULL")
    each = open_.select("example_id", "msg_idx", "words", "plain", F.posexplode("hashes").alias("of", "h")).filter("h IS NOT NULL")
    asked = cut(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    counts = sentence_counts(said.filter("text IS NOT NULL"), asked, asked.count())
    counts = cut(asked.join(counts, "h", "left").na.fill(0))
    per = join_per_key(each, counts, "h", len(ASKED_OF) * open_.count(), "n").groupBy("example_id", "msg_idx", "words", "plain")
    pick = [F.max(F.when(F.col("of") == i, F.col(c))).alias(f"{name}_{c}") for i, name in enumerate(ASKED_OF) for c in ("goes_on", "whole", "final")]
    broken = per.agg(*pick).filter(breaks_off()).select("example_id", "msg_idx", F.lit("truncated").alias("defect"))
    return found.filter("defect IS NOT NULL").select("example_id", "msg_idx", "defect").unionByName(broken).distinct()


def _defects(spark: SparkSession, d: str) -> DataFrame:
    samples = [(r["lang"], r["text"]) for r in table(spark, d, "lang_samples").collect()]  # fixed size: 280 rows
    return answer_defects(table(spark, d, "chat_examples"), samples)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Assistant messages that are no proper answer, with their defect."""
    return _defects(spark, d).dropDuplicates(["example_id", "msg_idx"])


def p5_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    """Defective messages by defect and split."""
    got = p5_found(spark, d)
    split = table(spark, d, "chat_examples").groupBy("example_id").agg(F.max_by("split", "ingested_at").alias("split"))
    return got.join(split, "example_id").groupBy("split", "defect").agg(F.count(F.lit(1)).alias("messages"))

"""Problem 3: question-answer pairs whose answer is unfit for its question."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.deliveries import first_delivery
from lodestone.operators.lineage import materialise

DEFECTS = ("empty_answer", "copied_question", "refusal", "other_language", "truncated_answer")
#: Opening: the first characters of a clause, names, numbers and the question's own words masked.
OPENING_CHARS = 30
#: Openings are alike from this Jaccard similarity of their character 4-grams (they are too short for word shingles).
ALIKE = 0.6
BANDS, ROWS = 8, 2
#: A template is a refusal's if half of its answers at least offer nothing instead, and of these so large a share
#: speaks of not answering.
MIN_CUE = 0.5
#: Prompts are unlike below this Jaccard similarity of their content words.
UNLIKE = 0.5
#: A sentence of so few words, without a number, a name or a word of the question, is courtesy.
COURTESY_WORDS = 6

# --- Fixed values: word lists and marks -------------------------------------------------------------------
_PLACEHOLDERS = {"null", "nil", "nan", "n/a", "na", "empty", "no answer", "answer", "tbd", "todo", "none given", "blank", "response", "a", "answer here", "your answer here", "insert answer here"}
_FUNCTION_WORDS = {
    "en": "the of and to in is was that for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so what its than into them can only other new some could these two may then do first any my now such like our over even most after also did many before must through how why where does show describe explain give every each about",
    "fr": "le la les de des du en et un une est que qui dans pour pas sur au aux avec se ce sont par ne plus il elle ils elles mais ou où sa son ses leur leurs cette ces était fut été être comme même avant après très encore puis dont lorsque depuis pendant selon quand pourquoi comment quel quelle on c'est d'abord qu'en",
    "de": "ich eine sie diese dieser muss kann der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ohne zuerst danach obwohl während später warum wann wer was gilt",
    "es": "el la los las de del y en un una que es se no por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto antes algunos qué cuál cómo dónde fue era está según después nunca aunque",
}
_LANGUAGE_NAMES = {
    "fr": r"french|français\w*|französisch\w*|franc[eé]s",
    "de": r"german|allemand\w*|deutsch\w*|alem[aá]n",
    "es": r"spanish|espagnol\w*|spanisch\w*|español\w*|castellano",
    "en": r"english|anglais\w*|englisch\w*|ingl[eé]s",
    "cyrillic": r"russian|ukrainian|russe|russisch\w*|ruso",
    "cjk": r"japanese|chinese|korean|japonais\w*|japanisch\w*|japon[eé]s|chinois\w*|chinesisch\w*|chino",
    "greek": r"greek|grec\w*|griechisch\w*|griego",
}
#: What an answer says that declines or can't answer, in the languages of the pairs.
_CUE = re.compile(
    r"\b(?:cannot|can ?not|can'?t|could ?n'?t|unable|not able|not (?:something|possible|given|in a position|permitted|allowed?|guess|for me|my place)|(?:is|was)n't (?:possible|able|something)"
    r"|(?:do|does|did) ?(?:not|n'?t) (?:know|have|cover|provide|say|mention|contain|offer|state|specify|give|include|allow|permit)|(?:says|tells us|know) nothing|nothing (?:in|on|about) th"
    r"|no (?:comment|mention|information|way of|idea|answer|reply|opinion)|declin\w*|refus\w*|rather not|prefer not|must pass|outside what|beyond what|unanswered|i lack|sorry|guidelines|won'?t"
    r"|ne (?:peux|puis|sais|donne|contient|dit|fournit|permet|souhaite)|ne suis pas en mesure|désolée?|déclin\w*|préfère ne|aucune (?:information|réponse|idée|donnée)|refus\w*"
    r"|no (?:puedo|sé|ofrece|contiene|dispongo|tengo|menciona|proporciona|dice)|no me es posible|lo siento|rechaz\w*|prefiero no|ningun[ao]? (?:información|respuesta|dato)"
    r"|nicht (?:helfen|beantworten|sagen|äu(?:ß|ss)ern|möglich|wei(?:ß|ss))|keine? (?:angaben?|antwort|auskunft|information\w*|ahnung)|ablehn\w*|tut mir leid|kann (?:ich|dazu|dabei|darauf)? ?(?:leider )?nicht|wei(?:ß|ss) (?:ich|es) nicht)\b",
    re.I,
)
_CONTRAST = re.compile(r"(?:[,;:]\s*|\b)(?:but|however|yet|instead|mais|cependant|pero|sino|sin embargo|aber|jedoch|sondern)\b[, ]*", re.I)
#: What can't be done to a thing, which isn't an answer withheld.
_NOT_OF_ANSWERS = re.compile(
    r"(?:cannot|can ?not|can'?t|could ?n'?t) (?:be (?!(?:\w+ly )?(?:answered|addressed|given|provided|supplied|said|told|stated|discussed|determined|known|found|inferred|derived|shared|disclosed|fulfilled|completed|processed|helped|of (?:help|assistance))\b)|(?:overstate|exaggerate|overemphasi[sz]e)\b)",
    re.I,
)
#: What is said of the talk itself: thanks, excuses, policies, where else to ask.
_TALK = re.compile(
    r"\b(?:questions?|requests?|quer(?:y|ies)|asking|asked|answer(?:s|ed|ing)?|repl(?:y|ies)|respon[ds]\w*|help\w*|assist\w*|advi[cs]e\w*|polic(?:y|ies)|guidelines?|rules|permitted|allowed|disclos\w*|discuss\w*|please|thank\w*|appreciat\w*|apolog\w*|regret\w*|unfortunately|let me know|hope|topics?|language model|assistant|consult\w*|contact\w*|i (?:am|was|have|had|would|will|must|need|understand|know)|i'(?:m|ve|d|ll))\b"
    r"|\b(?:demandes?|répon\w*|aid\w*|politique|règles|directives|autoris\w*|veuillez|merci|excus\w*|regrett\w*|malheureusement|sujets?|modèle de langage|consult\w*|n'hésitez)\b"
    r"|\b(?:fragen?|anfragen?|antwort\w*|beantwort\w*|hilf\w*|helfen|richtlinien?|regeln|erlaubt|bitte|danke?|entschuldig\w*|bedauer\w*|leider|themen?|sprachmodell|wenden)\b"
    r"|\b(?:preguntas?|solicitud(?:es)?|petici(?:ón|ones)|respuestas?|respond\w*|ayud\w*|polític[ao]s?|reglas|permit\w*|por favor|gracias|disculp\w*|lament\w*|temas?|modelo de lenguaje|puede)\b",
    re.I,
)
_ADDRESSED = re.compile(r"\b(?:please|you|your|vous|votre|veuillez|bitte|sie|ihre?n?|usted|puede|por favor)\b", re.I)
#: Openings that are known for a refusal's, in the languages of the pairs: a cluster that one of them belongs to is labelled by it.
_SEEDS = (
    "i cannot answer this question", "i cant answer that", "i am unable to answer this", "i am not able to answer", "im sorry but i cannot", "sorry i cant help with that", "i cant help with that",
    "i wont be able to help", "i do not know", "i dont know the answer", "i have no information about", "i dont have enough information", "i have no way of knowing", "i was not given the information",
    "i must decline to answer", "i would rather not answer", "id prefer not to answer", "id rather not say", "it is not possible for me to", "it isnt possible for me to say", "this is not something i can",
    "that is outside what i can", "that falls outside what i can", "my guidelines do not allow me", "as a language model i cannot", "the text does not say", "the text says nothing about", "the passage does not mention",
    "the text does not provide any", "there is no mention of this", "there is no information about", "no answer can be given", "nothing in the text says", "no comment", "i am not able to fulfil this request",
    "je ne peux pas répondre", "je suis désolé mais je ne peux", "je préfère ne pas répondre", "je ne sais pas", "le texte ne contient aucune", "en tant que modèle de langue je", "malheureusement je ne peux pas", "je dois décliner cette demande",
    "lo siento pero no puedo", "no puedo responder a esa pregunta", "prefiero no responder", "no lo sé", "el texto no ofrece ninguna", "como modelo de lenguaje no", "lamentablemente no puedo", "debo rechazar esta solicitud",
    "es tut mir leid aber ich kann", "dazu kann ich nichts sagen", "dazu möchte ich mich nicht", "ich kann diese frage nicht", "das weiß ich nicht", "der text enthält dazu keine", "als sprachmodell kann ich dazu", "leider kann ich diese anfrage", "ich muss diese anfrage ablehnen",
)
# -------------------------------------------------------------------------------------------------------------

_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF])
_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S | re.I)
_TOKEN = re.compile(r"<\|[^<>|]{1,40}\|>|</?s>|\[/?INST\]|</?(?:assistant|answer)>", re.I)
_MARKUP = re.compile(r"[*_`~#>]+|</?[a-zA-Z][^<>]{0,80}>")
_ANY_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SENTENCE_END = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]*_]*\s*(?:\n|\s)\s*|(?<=[。！？])|\n+")
_FINISHED = re.compile(r"[.!?…。！？।][\"'”’»«“)\]*_`]*$")
_UNFINISHED_ABBREVIATION = re.compile(r"(?:\b(?:dr|mr|mrs|e\.g|i\.e|cf|vgl|bzw|vol|no|st)|\b[A-Z])\.$", re.I)
_LIST_ITEM = re.compile(r"(?:[-*•+]|\d+[.)])\s+(?=\S)")


def visible(answer: str) -> str:
    """The answer without a model's own marks (thought blocks, turn tokens), invisible characters and outer white space."""
    if "<" in answer or "[" in answer:
        answer = _TOKEN.sub(" ", _THINK.sub(" ", answer))
    if not answer.isascii():
        answer = unicodedata.normalize("NFC", answer.translate(_INVISIBLE))
    return answer.strip(" \t\r\n\x0b\x0c\u00a0\u3000\u2028\u2029")


def is_empty(shown: str) -> bool:
    """Nothing left but markup, punctuation or a placeholder; a number or a short word is an answer."""
    bare = _MARKUP.sub(" ", shown)
    bare = re.sub(r"\s+", " ", bare).strip(" .:;,!?…-–—()[]{}\"'“”|/\\=+").lower()
    return not bare or bare in _PLACEHOLDERS


def words(text: str) -> list[str]:
    return _ANY_WORD.findall(text.lower().replace("’", "'"))


def copies_question(question: str, shown: str) -> bool:
    return _copies(words(question), words(shown))


def _copies(q: list[str], a: list[str]) -> bool:
    """The question again, once or more, with a few words before, changed or put in. What follows a whole copy of it
    is an answer, unless that is the question once more."""
    if len(q) < 2 or not a:
        return False
    start = 0  # after the copies so far; each may have a few words before it
    while (k := next((k for k in range(start, start + 5) if a[k : k + len(q)] == q), None)) is not None:
        start = k + len(q)
        if start == len(a):
            return True
    a = a[start:]
    if len(a) > 4 * len(q) + 6:
        return False
    asked = set(q)
    if a[-1] not in asked or sum(w not in asked for w in a) > max(4, 0.25 * len(q)):
        return False
    row = [0] * (len(a) + 1)  # longest common subsequence
    for x in q:
        last = 0
        for j, y in enumerate(a, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] >= 0.7 * len(q)


_LANGUAGE_OF = {}
for _language, _list in _FUNCTION_WORDS.items():
    for _w in _list.split():
        _LANGUAGE_OF.setdefault(_w, []).append(_language)
_SCRIPTS = (("cyrillic", "Ѐ", "ԯ"), ("greek", "Ͱ", "Ͽ"), ("cjk", "぀", "ヿ"), ("cjk", "一", "鿿"), ("cjk", "가", "힯"), ("arabic", "؀", "ۿ"), ("hebrew", "֐", "׿"), ("devanagari", "ऀ", "ॿ"))

_BEYOND_LATIN = re.compile("[\u0370-\U0010ffff]")
_MARKS = {"de": re.compile("[ßäöüÄÖÜ]"), "es": re.compile("[ñ¿¡áíóúÁÍÓÚ]"), "fr": re.compile("[àèêçùâîôûœÀÈÊÇ«]")}
_DIGIT = re.compile(r"\d")


#: For each language the words that only others have: without one of them, a text can't be taken for another's.
_FOREIGN = {lang: frozenset(w for w, of in _LANGUAGE_OF.items() if lang not in of) for lang in _FUNCTION_WORDS}


def language(text: str, found: list[str] | None = None) -> str | None:
    """The language of a stretch of text, by function words, or its script where that isn't Latin; None if it can't be told.
    ``found`` are its words, where they are known already."""
    plain = text.isascii()
    if not plain and _BEYOND_LATIN.search(text):
        letters = [c for c in text if c.isalpha()]
        for name, low, high in _SCRIPTS:
            if 2 * sum(low <= c <= high for c in letters) > len(letters):
                return name
    score: dict[str, float] = {}
    for w in words(text) if found is None else found:
        for part in {w, *w.split("'")} if "'" in w else (w,):
            for lang in (langs := _LANGUAGE_OF.get(part, ())):
                score[lang] = score.get(lang, 0.0) + 1 / len(langs)
    if not plain:
        for lang, marks in _MARKS.items():
            score[lang] = score.get(lang, 0.0) + 0.5 * len(marks.findall(text))
    if not score:
        return None
    best, second = (sorted(score.values(), reverse=True) + [0.0, 0.0])[:2]
    return max(score, key=score.get) if best >= 1.5 and best >= 1.3 * second else None


def _all_own(own: str, text: str, found: Iterable[str]) -> bool:
    """No word or mark in the text that could make it another language's than ``own``."""
    foreign = _FOREIGN.get(own)
    return foreign is not None and text.isascii() and foreign.isdisjoint(found) and not any("'" in w and not foreign.isdisjoint(w.split("'")) for w in found)


def in_other_language(question: str, shown: str, own: str | None = None, found: list[str] | None = None) -> bool:
    """More than half of the answer, by characters of what can be told, in another language than the question's,
    unless the question names that language. ``own`` is the question's language, ``found`` the answer's words, where known."""
    own = own or language(question)
    if own is None or _all_own(own, shown, words(shown) if found is None else found):
        return False
    told = {}
    prose = re.sub(r"```.*?(?:```|\Z)", " ", shown, flags=re.S)
    for sentence in _SENTENCE_END.split(re.sub(r"https?://\S+", " ", _MARKUP.sub(" ", prose))):
        if sentence and (lang := language(sentence)):
            told[lang] = told.get(lang, 0) + len(sentence)
    if not told or told.get(own, 0) * 2 >= sum(told.values()):
        return False
    other = max((lang for lang in told if lang != own), key=told.get)
    return not (other in _LANGUAGE_NAMES and re.search(rf"\b(?:{_LANGUAGE_NAMES[other]})\b", question, re.I))


def breaks_off(shown: str) -> bool:
    """Does the answer end before it is finished? Short answers, lists, tables, code and addresses may do without a full stop."""
    if shown.count("```") % 2:
        return True
    if shown.endswith("```"):
        return False
    lines = [line.strip() for line in re.split(r"[\n\r\u2028\u2029\x85]+", shown) if line.strip()]
    last = lines[-1]
    if len(lines) > 1 and re.fullmatch(r"(?:[-*•+]|\d+[.)])?\s*[*_]{0,3}", last):
        return True  # a list mark without its item
    if last.startswith("|"):
        rows = [line for line in lines if line.startswith("|")]
        return not last.endswith("|") or last.count("|") < rows[0].count("|")
    bare = last.rstrip("*_` ")
    if re.search(r"[,;:(\[{–—«„-]$", bare) and bare != "-":
        return True
    if _FINISHED.search(bare):
        return bool(_UNFINISHED_ABBREVIATION.search(bare)) and len(words(bare)) > 1
    if re.search(r"https?://\S+$", bare) or " > " in bare:
        return False
    if _LIST_ITEM.match(last):
        others = [line for line in lines[:-1] if _LIST_ITEM.match(line)]
        return bool(others) and all(_FINISHED.search(line.rstrip("*_` ")) for line in others)
    if bare.endswith(("}", "]", "$", "%")):
        return False
    prose_before = len(lines) > 1 or len(re.split(r"(?<=[.!?…])[\"'”’»)]*\s+", bare)) > 1
    return prose_before or len(words(bare)) > 3


#: Four first letters of the words that _CUE and _TALK can begin to match at; a sentence without any is spared the pattern.
_CUE_STARTS = frozenset("cann can can' cant coul unab not isn' is was wasn isnt do don' dont does did didn say says tell know noth no decl refu rath pref must outs beyo unan i guid won' wont sorr ne déso décl préf aucu lo rech ning nich kein able tut kann weiß weis".split())
_TALK_STARTS = frozenset("ques requ quer aski aske answ repl resp help assi advi poli guid rule perm allo disc plea than appr apol regr unfo let hope topi lang cons cont i i'm i've i'd i'll im dema répo aid aide aidé aida règl dire auto veui merc excu malh suje modè n'hé frag anfr antw bean hilf helf rich rege erla bitt dank ents beda leid them spra wend preg soli peti ayud polí regl por grac lame tema mode pued".split())


def _starts(found: list[str]) -> set[str]:
    return {w[:4] for w in found} | {p[:4] for w in found if "'" in w for p in w.split("'")}


def _cues(text: str, starts: set[str]) -> list[re.Match]:
    if _CUE_STARTS.isdisjoint(starts):
        return []
    return [m for m in _CUE.finditer(text) if not _NOT_OF_ANSWERS.match(text, m.start())]


def _cue(text: str) -> bool:
    return any(not _NOT_OF_ANSWERS.match(text, m.start()) for m in _CUE.finditer(text))


def _specific(text: str, asked: set[str], capitals: bool) -> bool:
    """Has a number or a name the question hasn't."""
    return any((_DIGIT.search(w) or (capitals and i and w[:1].isupper() and not text.isupper() and w.split("'")[0] != "I")) and w.lower() not in asked for i, w in enumerate(_ANY_WORD.findall(text)))


def _offers(sentence: str, found: list[str], starts: set[str], cues: list[re.Match], asked: set[str], capitals: bool) -> bool:
    """Does the sentence tell something of the matter? Refusing, its reasons, courtesy and policy don't."""
    if cues:
        if contrast := _CONTRAST.search(sentence, cues[0].end()):
            tail = sentence[contrast.end() :]
            if len(words(tail)) >= 5 and not _cue(tail):
                return not _TALK.search(tail) or _specific(tail, asked, capitals)
        # a number in a clause of its own after the refusal is of the matter
        return any(_DIGIT.search(c) and _specific(c, asked, False) and not _cue(c) and not _TALK.search(c) for c in re.split(r"[,;:]\s+", sentence[cues[0].end() :])[1:])
    if sentence.rstrip("\"'”’»)*_").endswith("?"):  # asks back
        return False
    if not _TALK_STARTS.isdisjoint(starts) and _TALK.search(sentence):
        return _specific(sentence, asked, capitals) and not _ADDRESSED.search(sentence)
    return len(found) > COURTESY_WORDS or _specific(sentence, asked, capitals) or any(len(w) > 3 and w in asked for w in found)


_SENTENCES = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+")
_CLAUSES = re.compile(r"[,;:]\s+(?:(?:but|mais|pero|aber|however|that said|so)\b,?\s*)?")
_CLAUSE_ENDS = re.compile(r"[,;:]\s")
_SPACE = re.compile(r"\s+")


def _opening(sentence: str, start: int, asked: set[str], capitals: bool) -> str:
    """The first characters of a clause, its names, numbers and the question's words masked."""
    stop = start + 4 * OPENING_CHARS  # as far as most openings need; else the whole sentence
    for end in (stop, len(sentence)) if stop < len(sentence) else (len(sentence),):
        found = _ANY_WORD.findall(sentence, start, end)
        if end < len(sentence):
            found = found[:-1]  # may be cut short
        out, size = [], 0
        for i, word in enumerate(found):
            low = word.lower()
            if low in asked or (not low.isalpha() and _DIGIT.search(low)) or (capitals and i and low != word and word[0].isupper() and word.split("'")[0] != "I"):
                if out and out[-1] == "_":
                    continue
                low = "_"
            else:
                low = low.replace("'", "")
            out.append(low)
            size += len(low) + 1
            if size > OPENING_CHARS:
                break
        if size > OPENING_CHARS:
            break
    return " ".join(out)[:OPENING_CHARS].strip()


def openings(question: str, shown: str) -> tuple[list[tuple[str, bool, bool]], list[str]]:
    """The openings of the clauses of all sentences of the answer, those of an answer that offers nothing beside them first:
    ``(opening, speaks of not answering, does so before its next comma)``; then those of which something else is told."""
    every = set(words(question))
    return _openings(every, language(question), shown, words(shown))


def _openings(every: set[str], own: str | None, shown: str, said: list[str]) -> tuple[list[tuple[str, bool, bool]], list[str]]:
    plain = _SPACE.sub(" ", _MARKUP.sub(" ", shown)).strip().replace("’", "'")
    sentences = [s for s in _SENTENCES.split(plain) if s.strip()]
    asked = {w for w in every if len(w) > 3}
    # in German every noun has a capital, in the other languages names
    capitals = own != "de" and (_all_own("en", shown, said) or language(shown, said) != "de")
    known: list[tuple[list[re.Match], bool]] = []
    n_offers = 0
    for s in sentences:
        found = words(s)
        starts = _starts(found)
        cues = _cues(s, starts)
        offer = _offers(s, found, starts, cues, every, capitals)
        known.append((cues, offer))
        n_offers += offer
        if n_offers > 1:  # whatever its sentences open with, something is told beside it
            break
    bare: dict[tuple[str, bool, bool], None] = {}
    other: dict[str, None] = {}
    for sentence, (cues, offer) in zip(sentences, known + [([], False)] * (len(sentences) - len(known))):
        starts = [0, *(m.end() for m in _CLAUSES.finditer(sentence))]
        capital = capitals and not sentence.isupper()
        if n_offers > 1:
            other.update(dict.fromkeys(o for start in starts if (o := _opening(sentence, start, asked, capital))))
            continue
        breaks, at = [m.start() for m in _CLAUSE_ENDS.finditer(sentence)], [m.start() for m in cues]
        contrast = _CONTRAST.search(sentence, 1)
        turned = contrast is not None and len(words(sentence[contrast.end() :])) >= 5
        for start in starts:
            if not (opening := _opening(sentence, start, asked, capital)):
                continue
            # a sentence without a cue may be the refusal itself: then the others count, and what it turns to
            if n_offers > 0 if cues else n_offers > offer or (turned and start <= contrast.start()):
                other[opening] = None
                continue
            k, b = bisect_left(at, start), bisect_left(breaks, start)
            cue = k < len(cues)
            bare[opening, cue, cue and (b == len(breaks) or at[k] < breaks[b])] = None
    return list(bare), list(other)


def _pair_checks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each pair with its verdicts and the openings of a bare answer; and rows without a pair, ``other`` counted
    together for a batch, of the openings of answers that offer something."""
    for pdf in batches:
        rows, others = [], Counter()
        for q, a in zip(pdf.question, pdf.answer):
            q = "" if q is None else q if q.isascii() else unicodedata.normalize("NFC", q.translate(_INVISIBLE))
            shown = visible(a) if a is not None else ""
            asked, said = words(q), words(shown)
            empty = (len(said) < 5 or "<" in shown) and is_empty(shown)
            if empty or _copies(asked, said):
                rows.append((True, empty, not empty, False, False, [], [], None, 0))
                continue
            own = language(q, asked)
            bare, other = _openings(set(asked), own, shown, said)
            others.update(other)
            content = sorted({w for w in asked if len(w) > 3 and w not in _LANGUAGE_OF}) if bare else []
            rows.append((True, False, False, in_other_language(q, shown, own, said), breaks_off(shown), content, [dict(zip(_BARE, o)) for o in bare], None, 0))
        rows += [(False, False, False, False, False, [], [], o, n) for o, n in others.items()]
        ids = pd.concat([pdf["pair_id"], pdf["pair_id"].iloc[:1].repeat(len(others))], ignore_index=True)
        yield pd.concat([ids, pd.DataFrame(rows, columns=_CHECKED)], axis=1)


_BARE = ("opening", "cue", "own")
_CHECKED = ["pair", "empty", "copied", "other", "broken", "content", "bare", "opening", "n"]
_CHECKED_TYPES = "pair boolean, empty boolean, copied boolean, other boolean, broken boolean, content array<string>, bare array<struct<opening: string, cue: boolean, own: boolean>>, opening string, n long"

_RANDOM = np.random.default_rng(20_231)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_OF_PLACE = _RANDOM.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OF_BAND = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def grams(opening: str) -> set[str]:
    return {opening[i : i + 4] for i in range(max(len(opening) - 3, 1))}


def bands_of(some: list[str]) -> np.ndarray:
    """LSH bands ([n][BANDS], 64 bits each) of the MinHash signatures over the openings' character 4-grams, all at once."""
    if not some:
        return np.zeros((0, BANDS), np.int64)
    longest = max(4, max(map(len, some)))
    codes = np.frombuffer("".join(o.ljust(longest, "\0") for o in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), longest).astype(np.uint64)
    n = longest - 3
    with np.errstate(over="ignore"):
        h = sum(codes[:, i : i + n] * _OF_PLACE[i] for i in range(4))
        h ^= h >> np.uint64(29)
        none = np.arange(n)[None, :] >= np.maximum(np.fromiter(map(len, some), np.int64, len(some)) - 3, 1)[:, None]
        signature = np.empty((len(some), BANDS * ROWS), np.uint64)
        for k in range(BANDS * ROWS):
            v = (h * _A[k] + _B[k]) >> np.uint64(32)
            v[none] = np.uint64(1 << 32)
            signature[:, k] = v.min(1)
        out = np.empty((len(some), BANDS), np.uint64)
        for b in range(BANDS):
            key = _OF_BAND[b] + signature[:, b * ROWS]
            for r in range(1, ROWS):
                key = (key ^ (key >> np.uint64(31))) * _A[r] + signature[:, b * ROWS + r]
            out[:, b] = key
    return out.view(np.int64)


def _with_bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(band=list(bands_of(pdf.opening.tolist())))


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each bucket's openings, which come bucket by bucket, the heaviest first. Only the representatives of one
    bucket are held, by their grams: an opening meets those alone that it shares a gram with. A bucket whose first
    opening has no weight has no template that counts."""
    last, live = None, False
    bucket, leaders, holders = None, [], {}
    for pdf in batches:
        band, weight = pdf.band.to_numpy(), pdf.weight.to_numpy()
        if not len(band):
            continue
        starts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        sizes, lives = np.diff(np.append(starts, len(band))), weight[starts] > 0
        if band[0] == last:
            lives[0] = live
        last, live = band[-1], lives[-1]
        met = lives & (sizes > 1)
        met[0], met[-1] = lives[0], lives[-1]  # these may go on in another batch
        rows, out = np.flatnonzero(np.repeat(met, sizes)), []
        for b, opening, w in zip(band[rows].tolist(), pdf.opening.to_numpy()[rows], weight[rows].tolist()):
            if b != bucket:
                bucket, leaders, holders = b, [], {}
            own = grams(opening)
            shared = Counter(k for g in own for k in holders.get(g, ()))
            alike = [k for k, both in shared.items() if both >= ALIKE * (len(own) + leaders[k][1] - both)]
            if alike:
                out.append((opening, leaders[min(alike)][0]))
            elif w:
                for g in own:
                    holders.setdefault(g, []).append(len(leaders))
                leaders.append((opening, len(own)))
        yield pd.DataFrame(out, columns=["opening", "template"])


def templates(found: DataFrame) -> DataFrame:
    """``opening, template``: each distinct opening with the openings that stand for a cluster it belongs to.

    ``found`` has the distinct openings with their ``weight`` and their number of uses ``n``. An LSH bucket is represented
    by its heaviest opening (ties by uses, then by the text) and, of those not alike to a representative yet, by the
    next heaviest, until every opening in it is linked, a representative itself, or without weight. Alike is a Jaccard
    similarity of the 4-grams, computed exactly, of at least ALIKE; a link goes to the heaviest such
    representative. No bucket is cut short, and no Python worker holds one: it is read in order, and its representatives
    alone are kept (the count before it spills). Openings without weight link to others but stand for nothing.
    """
    banded = found.select("opening", "weight", "n").mapInPandas(_with_bands, "opening string, weight long, n long, band array<long>").select("opening", "weight", "n", F.explode("band").alias("band"))
    # most buckets have one opening, or none of weight: they stay out of Python
    bucket = Window.partitionBy("band")
    met = banded.withColumns({"_heaviest": F.max("weight").over(bucket), "_size": F.count(F.lit(1)).over(bucket)}).filter("_heaviest > 0 and _size > 1")
    ordered = met.sortWithinPartitions("band", F.desc("weight"), F.desc("n"), F.desc("opening"))
    links = ordered.select("band", "opening", "weight").mapInPandas(_linked, "opening string, template string").distinct()
    return links.unionByName(found.filter("weight > 0").select("opening", F.col("opening").alias("template")))


#: Weight of a seed in a bucket: it stands for the openings that are alike.
_SEED_WEIGHT = 1 << 40


def refusal_openings(checked: DataFrame) -> DataFrame:
    """The openings that are a refusal's: ``opening, telling``, distinct. A telling one has the refusal in its own words, so
    that an answer opening with it needs no cue; of the others ("I appreciate your interest; however, ...") it does.

    A cluster without a seed and without a bare answer that speaks of not answering can't be labelled, so clusters stand
    around openings that have one; what is alike to them joins whatever it says."""
    spark = checked.sparkSession
    uses = checked.select("content", F.explode("bare").alias("o")).select("content", "o.*")
    long = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("long")
    bare = uses.select(
        "opening", long(1).alias("n"), long(1).alias("bares"), long("cue").alias("cues"), long("own").alias("owns"), long(0).alias("seeds"),
        F.struct(F.hash("content").alias("h"), F.col("content").alias("c")).alias("first"),
    )
    no_prompt = F.lit(None).cast(bare.schema["first"].dataType).alias("first")
    rest = checked.filter(~F.col("pair")).select("opening", "n", *[long(0).alias(c) for c in ("bares", "cues", "owns", "seeds")], no_prompt)
    seeds = spark.createDataFrame([(s,) for s in dict.fromkeys(s[:OPENING_CHARS].strip() for s in _SEEDS)], "opening string")
    seeds = seeds.select("opening", *[long(0).alias(c) for c in ("n", "bares", "cues", "owns")], long(1).alias("seeds"), no_prompt)
    summed = ("n", "bares", "cues", "owns", "seeds")
    found = bare.unionByName(rest).unionByName(seeds).groupBy("opening").agg(*[F.sum(c).alias(c) for c in summed], F.min("first").alias("first"))
    found = materialise(found)
    linked = materialise(templates(found.select("opening", "n", (F.col("cues") + F.col("seeds") * _SEED_WEIGHT).alias("weight"))))
    sums = linked.join(found, "opening").groupBy("template").agg(*[F.sum(c).alias(c) for c in summed], F.min("first").alias("first"))
    sums = sums.withColumn("seeded", F.col("seeds") > 0)
    told = sums.filter((2 * F.col("bares") >= F.col("n")) & (F.col("bares") > 0) & (F.col("seeded") | (F.col("cues") >= MIN_CUE * F.col("bares"))))
    told = told.select("template", "seeded", (F.col("seeded") | (F.col("owns") >= MIN_CUE * F.col("bares"))).alias("telling"), F.col("first.c").alias("first")).join(linked, "template")
    # does the template answer unlike prompts? One prompt that is unlike its first is enough, and there is one if any two are unlike enough
    both, either = F.size(F.array_intersect("content", "first")), F.size(F.array_union("content", "first"))
    recurs = told.filter("not seeded").join(uses.select("opening", "content"), "opening").filter((F.col("content") != F.col("first")) & (both < UNLIKE * either)).select("template").distinct()
    refusing = told.join(recurs.withColumn("recurs", F.lit(True)), "template", "left").filter("seeded or recurs")
    return refusing.groupBy("opening").agg(F.max("telling").alias("telling"))


def defective_pairs(df: DataFrame) -> DataFrame:
    """``pair_id, defect`` of each distinct ``pair_id`` whose answer is unfit; the first that applies of DEFECTS.

    A null question is the empty question (its answer can be empty, refusing or broken off, nothing else). A
    repeated ``pair_id`` counts once, by its earliest delivery; rows without ``pair_id`` once for each content. An
    empty table gives no rows; other columns are ignored.

    Refusals: the openings of all answers are clustered by verified MinHash (``templates``). A cluster is a refusal's if
    half of the answers that open so offer nothing beside it and either a known refusal's opening (_SEEDS) belongs to
    it, or it recurs across unlike prompts and half of those answers speak of not answering (_CUE). An answer is a
    refusal if it offers nothing and opens a clause with an opening of such a cluster; where the cluster has the
    refusal only after its first clause, the answer must speak of it itself. The other defects follow from checks
    of the pair alone, in one Arrow pass. The join with the refusing openings is left to AQE, which broadcasts
    them only where they are small and splits a skewed opening otherwise.
    """
    once = first_delivery(df, "pair_id", "loaded_at", {"question": F.col("question"), "answer": F.col("answer")})
    kind = once.schema["pair_id"].dataType.simpleString()
    checked = materialise(once.mapInPandas(_pair_checks, f"pair_id {kind}, {_CHECKED_TYPES}"))
    may = checked.select(F.col("pair_id").alias("refused_id"), F.explode("bare").alias("o")).select("refused_id", "o.opening", "o.cue")
    refused = may.join(refusal_openings(checked), "opening").filter("cue or telling").select("refused_id", F.lit(True).alias("refused")).distinct()
    pairs = checked.filter("pair").drop("pair", "content", "bare", "opening", "n")
    joined = pairs.join(refused, F.col("pair_id").eqNullSafe(F.col("refused_id")), "left").withColumn("refused", F.coalesce("refused", F.lit(False)))
    defect = F.when(F.col("empty"), DEFECTS[0]).when(F.col("copied"), DEFECTS[1]).when(F.col("refused"), DEFECTS[2]).when(F.col("other"), DEFECTS[3]).when(F.col("broken"), DEFECTS[4])
    return joined.select("pair_id", defect.alias("defect")).filter("defect is not null")

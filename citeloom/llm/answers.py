"""Broken question and answer pairs: ordered rules, every triggered defect with its name.

Rules, in order of precedence: emptiness, refusal phrases in several languages, the question given back, unclosed
delimiters and abrupt endings, script and language mismatch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.sentences import INVISIBLE, MARKER, NEVER_FINAL, segment, units
from citeloom.plans.staging import broadcast_if_small, spread, stage

DEFECTS = ["empty", "refusal", "copied_question", "truncated", "wrong_language"]

_MARK = re.compile(rf"\s*{MARKER}")
_OTHER = re.compile(r"[\W_]+")
_QUOTED = re.compile(r"\(?[“„«「『\"][^“”„«»「」『』\"]{12,}[”“»」』\"]\)?|[(（][^()（）]{12,}[)）]")

# Texts that stand for no answer.
PLACEHOLDERS = frozenset(["", "null", "none", "nil", "na", "nan", "undefined", "noanswer", "noresponse", "empty", "tbd", "keineantwort", "sansréponse", "pasderéponse", "sinrespuesta", "無回答", "回答なし", "无回答", "没有回答", "無", "无", "なし"])
# Refusals, sentence by sentence, in lower case with straight apostrophes.
REFUSALS = [
    r"\bi (?:cannot|can't|can not|could not|couldn't|won't|will not|must decline to|would rather not|'d rather not|do not wish to|refuse to|am unable to|am not able to|am not allowed to|am not permitted to) (?:\w+ ){0,3}?(?:answer|help|assist|provide|discuss|comment|speculate|respond|share|say|disclose|talk|address|offer|give)", r"\bi'd rather not\b", r"\b(?:is|are) something i (?:won't|can't|cannot|will not)\b",
    r"\bi(?: am|'m) (?:not|un)(?: in a position| able|able| allowed| permitted)? to\b", r"\bi must decline\b", r"\bi do(?: not|n't) (?:feel|wish|want)\b", r"^no comment\b", r"\bnot (?:be )?appropriate for me\b", r"\b(?:guidelines|rules|policies|policy)\b.*\b(?:don't|do not|not|prevent|forbid|let me)\b", r"\bagainst the (?:rules|guidelines|policy)\b", r"\boutside what i\b", r"\brequest can(?:'t|not| not) be (?:completed|processed|answered)\b", r"^(?:please )?(?:try )?rephras", r"^please (?:consult|ask|contact|try)\b", r"\bno answer will be given\b", r"\bas an (?:ai|assistant)\b.*\b(?:can|must|unable|not)\b", r"^unfortunately,? i\b", r"\bunable to (?:provide|answer|help|assist)\b",
    r"\bich (?:kann|darf|möchte|werde|muss)\b.*\b(?:nicht|keine?n?|ablehnen)\b", r"\b(?:kann|darf|möchte|muss|werde) ich\b.*\b(?:nicht|keine?n?|ablehnen|äußern)\b", r"\bvon mir gibt es\b.*\bkeine\b", r"\bwas mir erlaubt ist\b", r"\bkein kommentar\b", r"\b(?:anfrage|frage|bitte)\b.*\b(?:nicht|keine)\b.*\b(?:beantwort|bearbeit|erfüll|entsprech|nachkomm)", r"\bwenden sie sich\b", r"\bmeine (?:richtlinien|regeln|vorgaben)\b", r"\bnicht (?:angemessen|in der lage|befugt|möglich)\b.*\b(?:mir|ich|antwort)", r"\bhierzu\b.*\bkeine (?:antwort|auskunft|angaben)\b",
    r"\bje (?:ne |n'|préfère|regrette|suis dans l'impossibilité|dois (?:refuser|décliner))", r"\bm'est impossible\b", r"\bme (?:prononcer|permettent pas|permet pas)\b", r"\bsans commentaire\b|\bpas de commentaire\b|\baucun commentaire\b", r"\b(?:veuillez|merci de) (?:consulter|contacter|vous adresser|reformuler)", r"\bmes (?:consignes|règles|directives)\b", r"\bne (?:peux|puis|saurais|peut|souhaite|donnerai)\b.*\b(?:pas|répondre|aucune)\b", r"\bhors de ce qui m'est permis\b|\bce qui m'est permis\b|\bce que je peux\b", r"\bcette demande ne peut\b", r"\bserait pas approprié\b|\bcontraire aux règles\b",
    r"\bno (?:puedo|podré|podemos|me es posible|estoy (?:autorizad|en condiciones|en posición)|debo|voy a|daré|quiero)", r"\bprefiero no\b", r"\bsin comentarios\b", r"\bfuera de lo que\b", r"\bconsulte (?:a|con)\b|\bpóngase en contacto\b|\breformule\b", r"\bmis (?:normas|reglas|directrices|pautas)\b", r"\bno (?:sería|es) apropiado\b|\bva en contra de\b", r"\bdebo (?:declinar|rechazar|abstenerme)\b|\btengo que (?:rechazar|declinar)\b", r"\besta solicitud no\b|\bno se puede (?:completar|atender)\b", r"\baquí no daré\b|\bninguna respuesta\b",
    r"无法(?:回答|提供|协助|讨论|评论|处理|满足|完成|透露)|不能(?:回答|提供|评论|讨论|协助|透露)|不便(?:提供|透露|回答|评论|讨论)|恕(?:我|难|不)|不作(?:回答|评论|答复)|拒绝(?:回答|讨论|提供)|不予(?:置评|回答)|无可奉告|超出(?:了)?我|请咨询|规定不允许|不允许我|不愿(?:意)?(?:评论|猜测|回答)",
    r"お答え(?:でき|し(?:かね|ません))|回答(?:でき|は?差し控え|を?控え|いたしかね)|差し控え|控えさせて|対応(?:でき|いたしかね)|お断り|ご遠慮|答えられ|お手伝いできません|お話し?(?:でき|し(?:かね|ません))|コメント(?:は|でき|を)|許(?:され|可)|専門家に(?:ご)?相談|範囲外",
]
# Apologies. Alone they neither answer nor decline; with a word that declines they do.
APOLOGIES = [
    r"(?:i(?: am|'m) |^(?:no\W+)?)(?:really |truly |so |very )?(?:sorry|afraid)(?: about that| for that)?", r"i apologi[sz]e", r"(?:es )?tut mir (?:sehr )?leid", r"(?:ich )?beda(?:ure|uere)", "entschuldigung",
    r"(?:je suis |^(?:non\W+)?)(?:désolé|navré)e?", r"je regrette", r"lo siento(?: mucho)?", r"lo lamento", "(?:我)?(?:很|非常|十分)?(?:抱歉|遗憾)", "对不起", "對不起", "(?:大変|誠に)?申し訳(?:ありません|ございません|ない)(?:が|けど)?", "すみませんが?",
]
DECLINING = [
    r"\b(?:can(?:'t|not| not)|could(?:n't| not)|unable|not able|won't|will not|not (?:allowed|permitted|something|in a position)|declin\w+|refus\w+|rather not|must not|no (?:answer|comment))\b",
    r"\b(?:nicht|keine?[nrms]?|ablehnen|verweiger\w+)\b", r"\b(?:ne|impossible|refus\w+|aucune?)\b|\bn'", r"\b(?:no|imposible|ningun[oa]?)\b", "无法|不能|不便|不可以|不允许|拒绝|不予|没办法", "でき|ませ|お断り|控え|ない",
]
# A bare "no", or what joins an apology to its sentence, beside a refusal belongs to it.
_ASIDE = re.compile(r"^(?:no|non|nein|いいえ|不|but|aber|mais|pero|但是?|が|[\s,.;:!。！，、—–-])*$")


# Function words that tell languages in Latin script apart. A word of several languages counts for each in part.
FUNCTION_WORDS = {
    "en": """the of and to in is was are were be been it its that this these those with for on at by from as an or but not no which
        who whose what when where why how than then there their they them he she his her we our you your have has had do does did
        will would can could should may might must if because while after before between during about into over under against
        through until without within also more most such only other any some all both each a every up down despite according per""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren wird werden
        wurde wurden worden sein hat haben hatte hatten mit von zu zum zur im in am an auf aus bei nach vor für durch über unter um bis
        seit während als wie dass wenn weil ob auch nur noch schon sehr mehr ich er sie es wir ihr man sich was wer wo wann warum
        welche welcher welches dieser diese dieses kann können soll muss ab laut davon dann daher neue neuer neuen erste ersten zweite zweiten""",
    "fr": """le la les un une des du de et ou mais ne pas plus que qui quoi dont où quand comment pourquoi quel quelle quels quelles
        combien est sont était étaient a ont avait été être sera ce cet cette ces il elle ils elles on nous vous je se sa son ses leur
        leurs au aux à en dans par pour sur sous avec sans entre vers chez depuis pendant avant après selon contre comme aussi très si
        lors malgré près""",
    "es": """el la los las un una unos unas de del al a y e o pero no ni que qué quien quién cuál cuáles cuándo cuánto cuántos cuánta
        dónde cómo por para con sin sobre entre desde hasta según durante tras ante bajo contra frente es son era eran fue fueron ser está
        están estaba ha han había hay se su sus lo le les esta este estos estas más muy también como cuando si ya porque antes después
        pese cerca""",
    "it": """il lo la gli le un uno una di del della dei delle dello degli da dal dalla dai in nel nella nei nelle su sul sulla con per
        tra fra e ed o ma non che chi cosa quale quali quando dove come perché quanto quanti è sono era erano fu furono stato stata
        essere ha hanno aveva si ci suo sua suoi loro questo questa questi anche più molto già se dopo prima durante secondo contro
        senza al alla ai alle""",
    "pt": """o a os as um uma de do da dos das em no na nos nas por pelo pela pelos pelas para com sem sobre entre desde até segundo
        durante após contra e ou mas não nem que quem qual quais quando quanto quantos onde como é são era eram foi foram ser está
        estão estava há tem tinha se seu sua seus suas ele ela eles isso este esta mais muito também já depois antes ao à aos às cerca""",
    "nl": """de het een en of maar niet geen van voor met op in aan uit bij naar door over onder tussen tijdens na sinds tot tegen
        zonder is zijn was waren werd werden wordt worden heeft hebben had hadden dat die dit deze wat wie waar wanneer hoe waarom
        welke er ook nog al meer zeer hij zij ze wij ik zich haar hun als dan toen om te""",
}
# Endings and letters that mark the words of a language.
MARKED = {
    "en": r"(?:ing|tion|tions|ness|ship|ed)$|^wh|th", "de": r"(?:ung|ungen|lich|liche[nrs]?|keit|heit|isch|ische[nrs]?|ete|eten)$|sch|ß|ä|ö", "fr": r"(?:ement|ements|aient|eux|euse|eau|eaux|ée|ées|és|é)$|[êèçôûœâî]",
    "es": r"(?:ción|[il]ones|idad|ó|ía|ían|aron|ieron|ado|ada|ados|adas)$|ñ", "it": r"(?:zione|zioni|ità|mente|ato|ati|ggio)$|gli", "pt": r"(?:ção|ções|ão|ões|idade|ou|aram|eram)$|ã|õ|nh|lh", "nl": r"(?:heid|ingen|elijk|elijke|tie|ties)$|ij|aa|uu",
}
_MARKED = {k: re.compile(v) for k, v in MARKED.items()}
_LANGUAGE = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANGUAGE.setdefault(_w, set()).add(_lang)
@lru_cache(maxsize=1)
def _refusing() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """(what declines by itself, apologies, what declines beside an apology)"""
    any_of = lambda parts: "|".join(f"(?:{p})" for p in parts)
    return re.compile(any_of(REFUSALS)), re.compile(rf"(?<!\w)(?:{any_of(APOLOGIES)})"), re.compile(any_of(DECLINING))


def _low(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().replace("’", "'").replace("‘", "'")


def _bare(text: str) -> str:
    """Letters and digits only."""
    return _OTHER.sub("", _low(text))


def scripts(text: str) -> dict[str, int]:
    """Letters by script, as far as it tells languages apart."""
    count: dict[str, int] = {}
    for pattern, name in (("[a-zA-ZÀ-ɏ]", "latin"), ("[ぁ-ヺ]", "kana"), ("[一-鿿]", "han"), ("[؀-ۿ]", "arabic"), ("[ऀ-ॿ]", "devanagari"), ("[ก-๛]", "thai"), ("[Ѐ-ӿ]", "cyrillic"), ("[가-힣]", "hangul")):
        if n := len(re.findall(pattern, text)):
            count[name] = n
    return count


_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@lru_cache(maxsize=1 << 16)
def _evidence(word: str, small: bool) -> tuple[tuple[str, float], ...]:
    """What a word says for each language: one for a function word, half for an ending or letter; shared by several."""
    if langs := _LANGUAGE.get(word):
        return tuple((lang, 1 / len(langs)) for lang in langs)
    if len(word) < 4 or not small and word.isascii():  # capitalised words are often names
        return ()
    marked = [lang for lang, p in _MARKED.items() if p.search(word)]
    return tuple((lang, 0.5 / len(marked)) for lang in marked)


def language(text: str) -> tuple[str, dict[str, float]]:
    """(language, evidence by language); "" where nothing tells."""
    by = scripts(text)
    if not by:
        return "", {}
    if by.get("kana", 0) >= 2:
        return "ja", {"ja": float(by["kana"])}
    latin = by.pop("latin", 0)
    if by and sum(by.values()) * 2 >= latin:
        top = max(by, key=by.get)
        lang = {"han": "zh", "kana": "ja", "arabic": "ar", "devanagari": "hi", "thai": "th", "cyrillic": "ru", "hangul": "ko"}[top]
        return lang, {lang: float(by[top])}
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    low = _low(text)
    if re.search("[¿¡]", low):
        score["es"] += 1
    for w, small in zip(re.findall(_WORD, low), re.findall(_WORD, text), strict=False):
        for lang, weight in _evidence(w, small == w):
            score[lang] += weight
    for lang, pattern in (("fr", r"\b(?:l|d|qu|n|s)'[a-zà-ÿ]"), ("it", r"\b(?:dell|nell|sull|all|dall)'[a-zà-ÿ]")):
        if re.search(pattern, low):
            score[lang] += 1
    best = max(score, key=score.get)
    return (best if score[best] >= 1 and score[best] > max(v for k, v in score.items() if k != best) else ""), score


#: A question is asked of many engines: what is known of it is kept for a while.
_asked_in = lru_cache(maxsize=4096)(language)
_bare_question = lru_cache(maxsize=4096)(_bare)


def _other_language(question: str, answer: str) -> bool:
    """Is the answer clearly in another language? In one script by function words, else by the script."""
    asked, wanted = _asked_in(question)
    told, said = language(answer)
    if not asked or not told or asked == told:
        return False
    if asked in wanted and asked not in FUNCTION_WORDS and told in FUNCTION_WORDS:
        return said[told] >= 1
    return said[told] - said.get(asked, 0.0) > 1.5 - 1e-9


def _refuses(text: str) -> bool:
    """Every sentence declines, but for an aside or an apology; the first that does neither decides. An answer of nothing
    but an apology declines too."""
    refusing, apology, declining = _refusing()
    declines = sorry = False
    for a, b in units(text):
        unit = _low(_MARK.sub("", text[a:b])).strip()
        if not any(c.isalnum() for c in unit):
            continue
        rest = apology.sub(" ", unit)
        sorry |= rest != unit
        if refusing.search(unit) or rest != unit and declining.search(rest):
            declines = True
        elif not _ASIDE.match(rest):
            return False
    return declines or sorry


def _copies(answer: str, question: str) -> bool:
    """Nothing but the question again, once or more, whatever its case, quotes and end marks."""
    a, q = _bare(_MARK.sub("", answer)), _bare_question(question)
    if not q or not a:
        return False
    left = a
    for label in ("question", "frage", "pregunta", "質問", "问题", "問題"):
        if left.startswith(label) and left[len(label) :].startswith(q):
            left = left[len(label) :]
    if left == q or len(left) % len(q) == 0 and left == q * (len(left) // len(q)):
        return True
    return len(left) >= 0.9 * len(q) and q.startswith(left)


_UNIT_ONLY = re.compile(r"^[\d.,]+(?:\s*(?!年|月|日)[^\d\s.,;:!?。，、；：]+){0,5}(?:\s*\([^()]*\))?[.。]?$")


_NAMED_VALUE = re.compile(r"^[^:：\n]{2,60}[:：]\s*" + _UNIT_ONLY.pattern[1:])


# Words that join names.
_JOINING = frozenset("and or of the de del la du des et ou und oder von der y e o da do di van het en".split())


def _names_only(text: str) -> bool:
    """Up to five words that are names or years, with what joins them: a whole answer without a final mark."""
    words = re.findall(r"[^\s,&/]+", text)
    named = [w for w in words if w.lower() not in _JOINING]
    first = words[0].lower() if words else ""
    return 0 < len(named) <= len(words) <= 5 and first not in _LANGUAGE and words[-1] in named and all(w[0].isupper() and w[1:].lower() == w[1:] and len(w) > 1 and w.strip(".").isalpha() or re.fullmatch(r"\d{1,4}", w) for w in named)


def _cut_word(text: str, question: str) -> bool:
    """Does the text end, without a mark, within a word that the question has whole?"""
    last = re.search(r"[^\W\d_]{2,}$", text.strip())
    words = set(re.findall(r"[^\W\d_]+", question)) if last else set()
    return bool(last) and last.group() not in words and any(w.startswith(last.group()) for w in words)


def _breaks_off(text: str) -> bool:
    """Does the text stop before its last sentence is finished?"""
    s = text.strip().strip(INVISIBLE).strip()
    cited = _MARK.sub("", s[-40:]) != s[-40:] and re.search(rf"{MARKER}\s*[.。!?！？]?$", s)
    core = re.sub(rf"(?:\s*{MARKER})+\s*(?=[.。!?！？]?$)", "", s).rstrip()
    if not core:
        return False
    last = core[-1]
    for a, b in ("()", "[]", "（）", "【】"):
        if core.rfind(a) > core.rfind(b) and not cited:
            return True
    if cited and re.search(r"[.。!?！？]$", s):
        return False  # the mark stands behind the citation
    if last == "." and not core.endswith(".."):
        units = segment(core)
        end = core[units[-1][0] : units[-1][1]]
        token = re.split(r"\s", end[:-1])[-1].lstrip("([\"'“„«")
        low = token.lower()
        if low in NEVER_FINAL or len(token) == 1 and token.isalpha() and len(end) > 3:
            return True
        return low == "no" and len(end) > 3 or low in ("e.g", "i.e")
    if last in "!?…。！？।؟॥.":
        return False
    if last in "\"'”’»“」』)）]】":
        body = core[:-1].rstrip()
        return not (body and (body[-1] in ".!?…。！？।؟\"'”’»“」』)）" or _UNIT_ONLY.match(core) or last in ")）]】"))
    if last in ",;:-–—/([{，、；：（「『“„«":
        return True
    if _UNIT_ONLY.match(core) or _NAMED_VALUE.match(core) or len(core.split()) <= 4 and re.search(r"\b\d{4}$", core):
        return False  # a figure, a name with a figure, or a year, and nothing more
    items = [x.strip() for x in re.split(r"[;；]", core)]
    if len(items) > 1 and all(x and len(x.split()) <= 4 and (x[0].isupper() or not x[0].isascii()) for x in items):
        return False
    if len(core.split()) <= 2 and _low(core) in ("yes", "no", "ja", "nein", "oui", "non", "sí", "si", "是", "否", "はい", "いいえ"):
        return False
    if _names_only(core):
        return False
    scripted = scripts(core)
    if scripted.get("thai") and not (set(scripted) & {"latin", "han", "kana"}):
        return False  # Thai sentences bear no final mark
    return True


def defects(answer: str | None, question: str | None, error: str | None = None) -> list[str]:
    """Every defect of an answer, in order of precedence. ``error`` alone makes none: sound answers carry errors too."""
    text = answer or ""
    bare = _bare(_MARK.sub("", text))
    empty = bare in PLACEHOLDERS
    found = ["empty"] if empty else []  # of an empty answer only the placeholder's language is left to test
    if not empty and _refuses(text):
        found.append("refusal")
    if not empty and question and _copies(text, question):
        found.append("copied_question")
    if not empty and (_breaks_off(text) or question and _names_only(text.strip()) and _cut_word(text, question)):
        found.append("truncated")
    if question and not _UNIT_ONLY.match(_MARK.sub("", text).strip()):
        if _other_language(question, _QUOTED.sub(" ", _MARK.sub("", text))):
            found.append("wrong_language")
    return found


def flag_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``(ord, question_id, defect, rank)``: one row per triggered defect; ``rank`` 0 is the decisive one.

    A question repeated under one id counts once (the least ``ord``). Answers without a question are tested for all but
    copying and language. Null texts are empty. Repeated deliveries are flagged each; other columns are ignored. Questions
    are broadcast if their measured size allows it, and answers then stay where they are; else both are shuffled.
    """
    asked = stage(questions.where("id is not null").groupBy(F.col("id").alias("question_id")).agg(F.min_by("text", "ord").alias("question")), "asked")
    small = broadcast_if_small(asked, F.length("question_id") * 4 + F.coalesce(F.length("question") * 4, F.lit(0)) + 32)
    pairs = spread(answers.select("ord", "question_id", "answer_text", "error")).join(small, "question_id", "left")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def judged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, asked_texts, errors in batches:
            yield pd.Series([defects(*x) for x in zip(texts, asked_texts, errors, strict=True)], dtype=object)

    return pairs.select("ord", "question_id", F.posexplode(judged("answer_text", "question", "error")).alias("rank", "defect")).select("ord", "question_id", "defect", "rank")

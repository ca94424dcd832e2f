"""Sentence boundaries across languages and scripts.

Spaced scripts: one scan finds candidate terminators (mark run, closers, citation markers), each classified by the token
before the gap and the word after it. Thai and Lao: the stretches on both sides of a blank are cut into words by a lattice
(cheapest path), and the blank ends a unit only on evidence: a final particle on its left or an opening word on its right.
Chinese and Japanese are cut at their marks; after a closing quotation mark a lattice over the clause that follows tells
whether the sentence around the quotation goes on. Khmer and Burmese are cut at their marks. A line break always ends a
unit. Nothing is looked for within a fixed number of characters only.

The words here are those that decide. A general word list for the lattices, so that these are not found inside longer
words, can be given (:func:`load_words`); there is none on the box, and an unknown stretch is then a path of characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.plans.staging import spread

LINE_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
INVISIBLE = "​‌‍⁠﻿­‎‏"
BLANK = f"(?:[^\\S\n\r\x0b\x0c\x85  ]|[{INVISIBLE}])"
MARKER = r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]"

#: Marks that end a sentence without a following blank (ideographic, Indic, Khmer, Burmese) and those that need one.
WIDE_MARKS = "。！？｡．।॥។៕။"
NARROW_MARKS = ".!?…؟۔‼⁇⁈⁉"
CLOSERS = "\"'”’»›)]}」』）】》〉〕］｣"
OPENERS = "\"'“‘„‚«‹([{¿¡「『（【《〈〔［｢"
CONTINUING = ",;:，；：、،؛·၊"
_QUOTE_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "‘": "’", "《": "》"}

_CANDIDATE = re.compile(
    rf"(?P<mark>[{WIDE_MARKS}{NARROW_MARKS}]+)"
    rf"(?P<close>(?:(?:{BLANK})*»|[{re.escape(CLOSERS)}“])*)"
    rf"(?P<cite>(?:(?:{BLANK})*{MARKER})*)"
)
#: Blank and invisible characters that a unit neither starts nor ends with.
_EDGE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + INVISIBLE
_SPACELESS_GAP = re.compile(f"(?<=[\u0e01-\u0e4e\u0e81-\u0ece])(?:{BLANK})+(?=[\u0e01-\u0e4e\u0e81-\u0ece])")
_SPACELESS = re.compile("[\u0e01-\u0e4e\u0e81-\u0ece]")
_SPACE = re.compile(rf"(?:{BLANK})+")
_WORD = re.compile(r"[^\W_]+(?:[.'’\-][^\W_]+)*", re.UNICODE)

# Abbreviations that never end a sentence before a word or figure that goes on.
NEVER_FINAL = frozenset(
    """mr mrs ms dr dra prof profa lt st sr sra srta mme mlle rev gen col capt sgt gov sen rep hon vs fig figs sec secs
    nos nr núm num art arts cf ca approx aprox env inkl incl excl exkl bzw ggf evtl vgl abb bd eg ie viz al pp vol vols
    eq eqs ref refs ch chap ed eds hrsg dipl ing lic vda ud uds ee tel av avda no.s z.b u.a d.h e.g i.e s.a p.ex p.ej
    डॉ श्री प्रो पं सं क्र د أ م ص""".split()
)
# Abbreviations whose point does not end a sentence only when a figure follows.
BEFORE_FIGURE = frozenset("no jan feb mar apr jun jul aug sep sept oct nov dec p s n º".split())
# Month names before which "22." is a German ordinal, and words that announce one.
MONTHS_DE = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
BEFORE_ORDINAL = frozenset("am vom zum im bis ab seit der die das dem den des".split())

# Words of the spaceless scripts' lattices, Thai and then Lao: words that open a sentence, that go on with
# one, that expect something after them, and particles that close one.
OPENING = frozenset(
    """บริษัท การ ความ ผู้ โรงงาน ระหว่าง ก่อน หลัง ตาม ใน เมื่อ แต่ อย่างไรก็ตาม นอกจาก นอกจากนี้ เนื่องจาก ดังนั้น ปัจจุบัน ต่อมา
    ทั้งนี้ สำหรับ เขา เธอ เรา ฉัน ผม พวกเขา มัน รัฐบาล นาย นาง นางสาว โดยรวม ขณะที่ จากนั้น อีกทั้ง หาก ถ้า แม้ เพราะฉะนั้น สุดท้าย
    ส่วน ทั้งหมด ทุกคน หลายคน วันนี้ เมื่อวาน ปีนี้ ปีที่แล้ว
    ແຕ່ ດັ່ງນັ້ນ ຫຼັງຈາກ ກ່ອນ ເມື່ອ ຖ້າ ນອກຈາກ ບໍລິສັດ ລັດຖະບານ ການ ຄວາມ ພວກເຮົາ ພວກເຂົາ ຂ້ອຍ ປັດຈຸບັນ ມື້ນີ້""".split()
)
GOING_ON = frozenset("และ หรือ ที่ ซึ่ง อัน ของ เพื่อ กับ ให้ ว่า ๆ ฯลฯ คือ เป็น จน ต่อ แห่ง ราว ประมาณ เปอร์เซ็นต์ ແລະ ຫຼື ທີ່ ຊຶ່ງ ຂອງ ເພື່ອ ກັບ ໃຫ້ ວ່າ ຄື ເປັນ".split())
EXPECTING = frozenset("และ หรือ ว่า คือ ได้แก่ เช่น ของ ที่ ซึ่ง ราว ประมาณ เกือบ กว่า นาย นาง นางสาว ดร เลขที่ ແລະ ຫຼື ວ່າ ຄື ໄດ້ແກ່ ເຊັ່ນ ຂອງ ທີ່ ຊຶ່ງ ປະມານ ທ້າວ ນາງ".split())
FINAL = frozenset("ครับ ค่ะ คะ นะ เลย แล้ว นั้น นี้ ก่อน ด้วย จริง ແລ້ວ ເດີ ນັ້ນ ນີ້ ດ້ວຍ".split())
JA_QUOTATIVE = frozenset("と って という といった とは との とも などと".split())
JA_GOES_ON = frozenset("が を に で は も の へ から まで や など".split())
ZH_SPEECH = frozenset("问道 说道 答道 喊道 写道 叹道 说 问 道 答 喊 表示 指出 回答 强调 补充 称 補充道 問道 說道 說 表示道 解释 解释道 补充道".split())


@lru_cache(maxsize=None)
def _lexicon(*groups: frozenset) -> tuple[frozenset, int]:
    words = frozenset().union(*groups)
    return words, max(map(len, words))


def lattice(text: str, lexicon: tuple[frozenset, int]) -> list[str]:
    """The cheapest path through the word lattice of ``text``: a dictionary word costs 1, an unknown character 1.2."""
    words, longest = lexicon
    cost, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        best, start = cost[end - 1] + 1.2, end - 1
        for n in range(1, min(longest, end) + 1):
            if text[end - n : end] in words and cost[end - n] + 1 <= best:
                best, start = cost[end - n] + 1, end - n
        cost.append(best)
        back.append(start)
    path, end = [], len(text)
    while end:
        path.append(text[back[end] : end])
        end = back[end]
    return path[::-1]


def _ideographic(ch: str) -> bool:
    return "々" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "ｦ" <= ch <= "ﾟ" or ch >= "\U00020000"


_EXTRA: list[frozenset] = []
_STRETCH_END = re.compile(BLANK)
_CLAUSE_END = re.compile(r"[。！？，；：、,;:!?「」『』“”]")


def load_words(path: str | None) -> None:
    """Take the words of a file, one a line, into the lattices of this process; None takes them out again."""
    _EXTRA.clear()
    if path:
        with open(path, encoding="utf-8") as f:
            _EXTRA.append(frozenset(w for line in f if (w := line.strip())))


def _stretch_before(line: str, start: int, at: int) -> str:
    """What stands between the last blank in ``line[start:at]`` and ``at``."""
    i = at
    while i > start and not _STRETCH_END.match(line[i - 1]):
        i -= 1
    return line[i:at]


def _spaceless_gap(line: str, start: int, at: int, end: int) -> bool:
    """Does the blank at ``line[at:end]`` between Thai or Lao letters end a sentence? Only on evidence."""
    following = _STRETCH_END.search(line, end)
    left = lattice(_stretch_before(line, start, at), _lexicon(EXPECTING, FINAL, OPENING, GOING_ON, *_EXTRA))
    right = lattice(line[end : following.start() if following else len(line)], _lexicon(OPENING, GOING_ON, *_EXTRA))
    if left and left[-1] in EXPECTING or right and right[0] in GOING_ON:
        return False
    return bool(left and left[-1] in FINAL or right and right[0] in OPENING)


def _quoted_goes_on(line: str, start: int, end: int, closer: str) -> bool:
    """After a closing quote in a spaceless script: does the sentence around the quotation go on?"""
    stop = _CLAUSE_END.search(line, end)
    clause = line[end : stop.start() if stop else len(line)]
    if not clause:
        return False
    words = lattice(clause, _lexicon(JA_QUOTATIVE, JA_GOES_ON, *_EXTRA))
    if closer in "」』" and (words[0] in JA_QUOTATIVE or words[0] in JA_GOES_ON):
        return True
    if line[start : start + 1] in "“‘「『\"":  # the quotation opened the sentence: a reporting clause may follow
        return lattice(clause, _lexicon(ZH_SPEECH, *_EXTRA))[-1] in ZH_SPEECH
    return False


def _inside_quotation(line: str, start: int, at: int) -> bool:
    """Is ``line[at]`` within a bracket or quotation that began inside the current sentence and is closed later?"""
    stack: list[tuple[str, int]] = []
    for i in range(start, at):
        ch = line[i]
        if stack and ch == stack[-1][0]:
            stack.pop()
        elif ch in _QUOTE_PAIRS and not (ch == "‘" and i and line[i - 1].isalnum()):
            stack.append((_QUOTE_PAIRS[ch], i))
        elif ch == '"':
            stack.append(('"', i))
    return any(opened > start and line.find(close, at) >= 0 for close, opened in stack)


def _before(line: str, start: int, at: int) -> str:
    """The token that ends at ``at``, without opening marks."""
    return _stretch_before(line, start, at).lstrip(OPENERS)


def _point_ends(line: str, start: int, at: int, word: str, figure: bool) -> bool:
    """Does a single point after ``line[:at]`` end the sentence, given the word or figure that follows?"""
    token = _before(line, start, at)
    low = token.lower()
    if low in NEVER_FINAL:
        return False
    if len(token) == 1 and token.isalpha():  # initials, d., z. B., U. S.
        return False
    if token.isdigit():
        if not line[start:at].strip()[: -len(token)].strip():  # a list number opens the unit
            return False
        if len(token) <= 2 and not figure:
            last = re.split(BLANK, line[start : at - len(token)].rstrip())[-1].lower()
            if word.lower() in MONTHS_DE or last in BEFORE_ORDINAL:
                return False
    if low in BEFORE_FIGURE:
        return not figure
    return True


def _ends(line: str, start: int, m: re.Match, closed: str, end: int) -> bool:
    """Classify the gap after a candidate of the terminator lattice. ``end``: where its closers and markers end."""
    mark, rest = m.group("mark"), line[end:]
    gap = _SPACE.match(rest)
    after = rest[gap.end() :] if gap else rest
    if not after:
        return True
    wide = any(ch in WIDE_MARKS for ch in mark)
    nxt = after[0]
    if nxt in CONTINUING or nxt in WIDE_MARKS + NARROW_MARKS:
        return False
    if not closed.strip() and _inside_quotation(line, start, m.start()):
        return False
    if wide or _ideographic(nxt) and mark[-1] in "!?…":
        quote = closed.strip()[-1:]
        return not (quote and quote in "”’」』\"»" and not gap and not m.group("cite") and _quoted_goes_on(line, start, end, quote))
    if not gap and not m.group("cite"):
        return False
    bare = after.lstrip(OPENERS + "\u00a0\u202f ")
    found = _WORD.match(bare)
    word = found.group() if found else ""
    figure = word[:1].isdigit()
    if word[:1].islower():
        camel = word[1:2].isupper()  # "eVarn" opens a sentence though its first letter is small
        if not (camel and (mark != "." or _point_ends(line, start, m.start(), word, False))):
            return False
    if not gap and not (word[:1].isupper() or _ideographic(nxt)):
        return False
    if mark == "." and not closed.strip() and not m.group("cite"):
        return _point_ends(line, start, m.start(), word, figure)
    return True


def _closers(line: str, m: re.Match) -> tuple[str, int]:
    """The closers that belong to the candidate, and where it ends; “ after a wide mark opens the next quotation."""
    closed, end = m.group("close"), m.end()
    if closed.endswith("“") and m.group("mark")[-1] in WIDE_MARKS or closed.endswith(('"', "'")) and line[: m.end("close")].count(closed[-1]) % 2:
        closed = closed[:-1]
        end = m.start("close") + len(closed)
    return closed, end


def _cuts(line: str) -> Iterator[tuple[int, int]]:
    """Places in a line where a unit ends and the next may begin."""
    start = pos = 0
    marks: Iterator[re.Match] = _CANDIDATE.finditer(line)
    if _SPACELESS.search(line):
        marks = iter(sorted([*marks, *_SPACELESS_GAP.finditer(line)], key=lambda x: x.start()))
    for m in marks:
        if m.start() < pos:
            continue
        if m.re is _SPACELESS_GAP:
            if _spaceless_gap(line, start, m.start(), m.end()):
                start = pos = m.end()
                yield m.start(), start
            continue
        closed, end = _closers(line, m)
        if _ends(line, start, m, closed, end):
            gap = _SPACE.match(line, end)
            start = pos = gap.end() if gap else end
            yield end, start


def units(text: str) -> Iterator[tuple[int, int]]:
    """Sentence units of ``text`` as (start, end) code-point offsets, from first to last visible character, one by one."""
    at = 0
    for br in [*LINE_BREAK.finditer(text), None]:
        stop = br.start() if br else len(text)
        line, base = text[at:stop], at
        at = br.end() if br else stop
        if not line.strip(_EDGE):
            continue
        start = 0
        for end, following in _with_end(line):
            core = line[start:end].strip(_EDGE)
            if core:
                first = line.index(core, start)
                yield base + first, base + first + len(core)
            start = following


def _with_end(line: str) -> Iterator[tuple[int, int]]:
    yield from _cuts(line)
    yield len(line), len(line)


def segment(text: str) -> list[tuple[int, int]]:
    """All units of :func:`units`."""
    return list(units(text))


UNITS = T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))


def sentence_units(text: Column | str, words: str | None = None) -> Column:
    """``array<struct<start_char,end_char>>`` of the units of a text column.

    Offsets are code points of the stored text, outer blanks included; ``end_char`` is the end of the unit's last
    visible character. Null and blank texts give an empty array. Pure function of the text: no state, no order. ``words``
    names a file of words for the lattices, one a line, that every executor can read.
    """

    @F.pandas_udf(UNITS)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        load_words(words)
        for texts in batches:
            yield texts.map(lambda t: [{"start_char": a, "end_char": b} for a, b in segment(t)] if t else [])

    return cut(F.col(text) if isinstance(text, str) else text)


def explode_units(df: DataFrame, text: str, keys: list[str], words: str | None = None) -> DataFrame:
    """One row per unit: ``keys``, ``unit`` (0-based), ``start_char``, ``end_char``, ``sentence``.

    Rows whose text is null or blank give no row; repeated rows give repeated units; other columns are dropped, so
    their names cannot clash. Narrow: no shuffle.
    """
    t = F.col(f"`{text}`")
    cut = df.select(*[F.col(f"`{k}`") for k in keys], t.alias("__text"), sentence_units(t, words).alias("__units"))
    return cut.select(*[F.col(f"`{k}`") for k in keys], "__text", F.posexplode("__units").alias("unit", "__u")).select(
        *[F.col(f"`{k}`") for k in keys], "unit", "__u.start_char", "__u.end_char",
        F.substring(F.col("__text"), F.col("__u.start_char") + 1, F.col("__u.end_char") - F.col("__u.start_char")).alias("sentence"),
    )


def units_of_tables(corpus: DataFrame, samples: DataFrame, words: str | None = None) -> DataFrame:
    """Units of ``corpus.text`` and of every entry of ``sample_batch1.cited_snippets``.

    Columns: src_table, rec_key, piece, unit, start_char, end_char, sentence. Identical rows exported twice are
    reduced to one before segmenting.
    """
    pages = corpus.select(F.lit("corpus").alias("src_table"), F.col("doc_index").cast("string").alias("rec_key"), F.lit(0).alias("piece"), F.col("text").alias("body"))
    snippets = samples.select("claim_id", "cited_snippets").distinct().select(F.lit("sample_batch1").alias("src_table"), F.col("claim_id").alias("rec_key"), F.posexplode("cited_snippets").alias("piece", "body"))
    return explode_units(spread(pages.unionByName(snippets)), "body", ["src_table", "rec_key", "piece"], words)

"""One consistent form for text that looks the same but is stored with different characters.

Text is cut into clusters (a base with the characters that may change around it). Only distinct clusters are exploded to
positioned code points, broadcast-joined with the decomposition and look-alike tables (both derived from the Unicode
database of the Python in use, hence of fixed size), their combining marks ordered by class, recomposed, and put back.
Texts without such clusters pass untouched, without a shuffle.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.plans.staging import broadcast_if_small, stage

# Letters of other alphabets drawn like Latin ones, in pairs (look-alike, plain).
LOOK_ALIKES = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅԌԚԜаеорсухіјѕһԁԛԝӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿονϲϳ" + "ՕՍօսո" + "ıɑɡ",
        "ABEKMHOPCTYXIJSGQWaeopcyxijshdqwl" + "ABEZHIKMNOPTYXCCovcj" + "OUoun" + "iag",
        strict=False,
    )
)
LOOK_ALIKES = {k: v for k, v in LOOK_ALIKES.items() if k not in "ıϿո"}  # a missing dot or a mirrored letter is visible
#: Compatibility forms that show the same letter; superscripts, fractions, circled and squared forms look different.
SAME_LETTER = {"<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, 0xFEFF, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
BLANKS = [0x09, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
LINE_BREAKS = [0x85, 0x2028, 0x2029]


def _plain(ch: str, depth: int = 0) -> str:
    """Full decomposition of one character under the rules above, look-alikes replaced."""
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0][0] == "<":
        seq = "".join(chr(int(x, 16)) for x in parts[1:])
        if parts[0] not in SAME_LETTER or not all(unicodedata.category(c)[0] in "LNM" for c in seq):
            return ch
    elif parts:
        seq = "".join(chr(int(x, 16)) for x in parts)
    else:
        return LOOK_ALIKES.get(ch, ch)
    return "".join(_plain(c, depth + 1) for c in seq)


@lru_cache(maxsize=1)
def tables() -> dict:
    """Decompositions (``{char: sequence}``), classes (``{char: class}``) and compositions (``{pair: char}``)."""
    blank, gone, breaks = set(BLANKS), set(INVISIBLE), set(LINE_BREAKS)
    decomposed, classes, composed, seconds = {}, {}, {}, set()
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x20000 <= cp < 0x2F800:
            continue  # surrogates, and ideographs and Hangul syllables that stay as they are
        ch = chr(cp)
        if c := unicodedata.combining(ch):
            classes[ch] = c
        seq = _plain(ch)
        if seq != ch:
            decomposed[ch] = seq
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            a, b = (chr(int(x, 16)) for x in parts)
            composed[LOOK_ALIKES.get(a, a) + b] = ch if LOOK_ALIKES.get(a, a) == a else composed.get(LOOK_ALIKES[a] + b) or unicodedata.normalize("NFC", LOOK_ALIKES[a] + b)
            seconds.add(b)
    composed = {k: v for k, v in composed.items() if len(v) == 1}
    seconds |= {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}  # Hangul vowels and finals
    decomposed |= {chr(c): "" for c in gone} | {chr(c): " " for c in blank} | {chr(c): "\n" for c in breaks} | {k: v for k, v in LOOK_ALIKES.items()}
    decomposed["\r"] = "\n"
    #: A precomposed letter that recomposes to itself needs no work unless a mark follows it.
    stable = {ch for ch, seq in decomposed.items() if unicodedata.normalize("NFC", seq) == ch and all(c not in LOOK_ALIKES for c in unicodedata.normalize("NFD", ch))}
    return {"decomposed": decomposed, "classes": classes, "composed": composed, "moving": (set(decomposed) - stable) | seconds, "marks": set(classes)}


#: Code points that are frequent in ordinary text. Ranges to search for are joined over gaps that hold none of them: a
#: short Java character class is many times faster, and a cluster found in excess keeps its form.
FREQUENT = [(0x09, 0x17F), (0x384, 0x45F), (0x620, 0x64A), (0x660, 0x66F), (0x671, 0x6D5), (0x904, 0x939), (0x93D, 0x94C), (0x964, 0x96F), (0xE01, 0xE37), (0xE3F, 0xE47), (0xE4C, 0xE5B), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3001, 0x3098), (0x309D, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20)]


def _ranges(chars: set[str]) -> list[list[int]]:
    """Ranges that hold these code points, and no frequent one besides."""
    frequent = lambda a, b: any(lo <= b and a <= hi for lo, hi in FREQUENT)
    ranges: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if ranges and (cp == ranges[-1][1] + 1 or not frequent(ranges[-1][1] + 1, cp - 1)):
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return ranges


def _spell(ranges: list[list[int]]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if b > a else f"\\x{{{a:x}}}" for a, b in ranges)


@lru_cache(maxsize=1)
def patterns() -> tuple[str, str]:
    """(does a text hold anything that may change, one cluster of it) as Java patterns.

    Java tests the ranges of a class one after the other, so the long gaps between them are tested first.
    """
    t = tables()
    moving, marks, both = _ranges(t["moving"]), _ranges(t["marks"]), _ranges(t["moving"] | t["marks"])
    safe = _spell([[a + 1, b - 1] for (_, a), (b, _) in zip(both, both[1:]) if b - a > 20])
    one = lambda ranges: f"[[^{safe}]&&[{_spell(ranges)}]]"
    return f"{one(moving)}|{one(marks)}{{2}}", f"(?s).?(?:{one(both)}{{2,}}|{one(moving)})"


def _char(code: Column) -> Column:
    """The character of a code point below 0x10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _hangul(starter: Column, point: Column) -> Column:
    """A leading consonant with a vowel, or a syllable without a final with one, as one syllable; else null."""
    a, b = F.ascii(starter), F.ascii(point)
    lead = a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175)
    final = a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(0x11A8, 0x11C2)
    return F.when(lead, _char(0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28)).when(final, _char(a + b - 0x11A7))


def _cluster_forms(clusters: DataFrame) -> DataFrame:
    """``(cluster, form)`` of distinct clusters: explode to code points, map, order by class, recompose.

    Every point brings what it composes with, a few dozen starters at most, so a step of the recomposition looks into a
    short list and not into the whole table.
    """
    spark, t = clusters.sparkSession, tables()
    by_second: dict[str, str] = {}  # a blank, the starter and the whole, for each
    for pair, whole in sorted(t["composed"].items()):
        by_second[pair[-1]] = by_second.get(pair[-1], "") + f" {pair[:-1]}{whole}"
    mapping = spark.createDataFrame(sorted(t["decomposed"].items()), "ch string, seq string")
    known = sorted((ch, t["classes"].get(ch, 0), by_second.get(ch, "")) for ch in t["classes"].keys() | by_second.keys())
    facts = spark.createDataFrame(known, "point string, class int, wholes string")
    points = clusters.select("cluster", F.posexplode(F.regexp_extract_all("cluster", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    mapped = points.join(F.broadcast(mapping), "ch", "left").select("cluster", "pos", F.posexplode(F.regexp_extract_all(F.coalesce("seq", "ch"), F.lit("(?s)."), F.lit(0))).alias("sub", "point"))
    # the tables have a fixed size: broadcast
    placed = mapped.join(F.broadcast(facts), "point", "left").select("cluster", "pos", "sub", "point", F.coalesce("class", F.lit(0)).alias("class"), F.coalesce("wholes", F.lit("")).alias("wholes"))
    # starters are numbered in order of place; each starter's marks then stand in order of class, stably
    so_far = Window.partitionBy("cluster").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("n", F.count_if(F.col("class") == 0).over(so_far))
    ordered = numbered.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("n", "class", "pos", "sub", "point", "wholes"))).alias("p"))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("rest"), F.lit(-1).alias("last"))

    def step(acc, x):  # canonical composition
        # a mark combines unless one of its own or a higher class stands between; a starter only if nothing does
        free = (acc.starter != "") & (acc["last"] < x["class"]) & ((x["class"] > 0) | (acc.rest == ""))
        at = F.instr(x.wholes, F.concat(F.lit(" "), acc.starter))
        joined = F.when(free, F.when(at > 0, F.substring(x.wholes, at + 2, F.lit(1))).otherwise(_hangul(acc.starter, x.point)))
        return F.element_at(F.transform(F.array(joined), lambda whole: (
            F.when(whole.isNotNull(), F.struct(acc.done.alias("done"), whole.alias("starter"), acc.rest.alias("rest"), acc["last"].alias("last")))
            .when(x["class"] == 0, F.struct(F.concat(acc.done, acc.starter, acc.rest).alias("done"), x.point.alias("starter"), F.lit("").alias("rest"), F.lit(-1).alias("last")))
            .otherwise(F.struct(acc.done.alias("done"), acc.starter.alias("starter"), F.concat(acc.rest, x.point).alias("rest"), x["class"].alias("last")))
        )), 1)

    forms = ordered.select("cluster", F.aggregate("p", start, step, lambda acc: F.concat(acc.done, acc.starter, acc.rest)).alias("form"))
    # clusters of nothing but invisible characters lose all their points
    return clusters.join(forms, "cluster", "left").select("cluster", F.coalesce("form", F.lit("")).alias("form"))


def consistent_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``df`` with column ``out``: ``text`` in its one consistent form.

    Invisible characters vanish, every kind of blank becomes a space, look-alike letters, full-width and ligature forms
    become plain letters, marks are ordered and composed. Case, accents, digits, words and line breaks stay as they are.
    Null gives null, an empty text an empty one; repeated texts are worked on once; ``out`` replaces a column of that name.
    The distinct clusters that change are broadcast only if their measured size allows it.
    """
    need, cluster = patterns()
    if out == text:
        raise ValueError("out must differ from the text column")
    df = df.drop(out)
    t = F.col(f"`{text}`")
    dirty = t.rlike(need) | t.contains("\r")
    clean = df.where(t.isNull() | ~dirty).withColumn(out, t)
    texts = df.where(dirty).select(F.sha2(t, 256).alias("__h"), F.replace(t, F.lit("\r\n"), F.lit("\n")).alias("__t"))
    texts = texts.groupBy("__h").agg(F.first("__t").alias("__t"))  # one of each text
    parts = stage(texts.select("__h", F.split("__t", cluster, -1).alias("rest"), F.regexp_extract_all("__t", F.lit(cluster), F.lit(0)).alias("act")), "parts")
    distinct = parts.select(F.explode(F.array_distinct("act")).alias("cluster")).groupBy("cluster").count().select("cluster")
    forms = stage(_cluster_forms(distinct).where("form != cluster"), "forms")
    rows = parts.select("__h", F.posexplode(F.transform("act", lambda a, i: F.struct(F.col("rest")[i].alias("pre"), a.alias("cluster")))).alias("pos", "x")).select("__h", "pos", "x.pre", "x.cluster")
    tails = parts.select("__h", F.size("act").alias("pos"), F.element_at("rest", -1).alias("pre"), F.lit("").alias("cluster"))
    put = rows.join(broadcast_if_small(forms, 200), "cluster", "left").select("__h", "pos", F.concat("pre", F.coalesce("form", "cluster")).alias("s"))
    put = put.unionByName(tails.select("__h", "pos", F.col("pre").alias("s")))
    rebuilt = put.groupBy("__h").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("p")).select("__h", F.array_join(F.col("p.s"), "").alias(out))
    changed = df.where(dirty).withColumn("__h", F.sha2(t, 256)).join(rebuilt, "__h", "left").drop("__h")
    return clean.unionByName(changed)


def same_looking(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of rows whose stored texts differ but share one consistent form.

    Null and blank texts are in no pair. A form with a third of all rows is split by salts in proportion to its rows.
    """
    from citeloom.llm.pairs import pairs_within

    forms = consistent_form(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), "text")
    keyed = forms.where(F.trim("form") != "").where(~F.col("form").rlike("^\\s*$")).select("id", F.sha2("form", 256).alias("grp"), F.sha2("text", 256).alias("variant"))
    return pairs_within(stage(keyed.where("id is not null").distinct(), "looks"), differing=True)

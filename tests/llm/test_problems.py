"""The nine problems against brute force, exact round trips and stated cases."""

import collections
import functools
import hashlib
import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import answers, consensus, leaks, lookalike, mixing, neardups, sampling, sentences, splitting

SF = "/root/testdata/sf0.001"


def cut(text):
    return [text[a:b] for a, b in sentences.segment(text)]


# -- 3 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("It resumed at 6 a.m. Within 8 weeks it fell. The yard is leased to J. R. Vor until 2010.", 3),
        ("The U.S. filing lists 284 litres, i.e. 2 percent. Seals, etc. The site. A vs. B was settled at 4 p.m. local time. eVarn cells lost 3.4 percent.", 5),
        ("“Nobody asked us,” said U, “and nobody will.” \"Did it trip?\" the inspector asked. It read: \"Do not exceed 8 beds!\" Since then.", 4),
        ("Done. [8] When it [6]. [20] (The figure excludes F.) Other.", 4),
        ("Dr. M prüfte z. B. den Umbau. Am 22. Januar 1996 fielen ca. 557 aus. „Wurde sie getrennt?“, fragte der Prüfer. Kosten (inkl. MwSt.) trug F.", 4),
        ("Quel gâchis ! On vend. « Aucun incident. » D’après lui. « Ne dépassez pas 245 MW ! » disait l’affiche.", 5),
        ("El informe de EE. UU. menciona 690 litros. ¡No se superó! Decía: «¡No exceda 1,1!» Fin", 4),
        ("真的没有！“线路是否跳闸？”检查员问道。技术员说：“没有停机。”损耗为3.7%，见图5。[3]在第二季度，运营。", 5),
        ("止まらなかった！「点検は終わった。」と担当者は述べた。掲示には「839枚を超えるな！」とあった。[21]損失は3.8％だった（図9参照）。", 4),
        ("การสูญเสียอยู่ที่ 3.6 เปอร์เซ็นต์ในปีนั้น ระหว่างภัยแล้งบริษัทเปิดอาคารใหม่ 7 หลังที่เมืองทินวิท", 2),
        ("डॉ. नेवतान ने दौरा किया। हानि 3.4 प्रतिशत रही। क्या थी?", 3),
        ("زار د. كورمك موقع زهد. هل بلغت قدرة؟ نعم", 3),
        ("Heading\n1. Close the valve and wait 9 min. before restart.\n\n2. Stop", 3),
        ("", 0),
        (" \n ​ ", 0),
    ],
)
def test_units(text, want):
    assert len(cut(text)) == want, cut(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("เขาชอบกินผลไม้ เช่น มะม่วง กล้วย ส้ม และ องุ่น", 1), ("เขาชอบกินผลไม้ มะม่วง กล้วย", 1), ("ฝนตกหนักมาก ดังนั้นเขาไม่มา", 2), ("က၊ ခ၊ ဂ။", 1), ("ຝົນຕົກໜັກ ດັ່ງນັ້ນພວກເຮົາບໍ່ໄດ້ໄປ", 2), ("ខ្ញុំទៅ។ គាត់មក។", 2),
        ("He wrote: “" + "It was good. " * 80 + "It was.” Then he left.", 2), ("他说：“" + "很好。" * 300 + "”完了。", 2),
    ],
)
def test_units_on_evidence(text, want):
    """Lists and clauses within a sentence go on; quotations of any length hold together."""
    assert len(cut(text)) == want, cut(text)


def test_words_for_the_lattice(spark, tmp_path):
    text = "ฝนตกหนักมาก ในที่สุดเขาก็มา"  # the opening word stands at the start of a longer one
    assert len(cut(text)) == 2
    (tmp_path / "words").write_text("ในที่สุด\n", encoding="utf-8")
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(sentences.sentence_units("t", str(tmp_path / "words")))).first()[0] == 1
    assert df.select(F.size(sentences.sentence_units("t"))).first()[0] == 2


def test_units_cover_what_is_visible():
    for text in ["A b. C d!\n[1] E", "真的。[3]在，“好？”他说。", "x" * 50_000 + ". Y" * 2000]:
        units = sentences.segment(text)
        assert "".join(text[a:b] for a, b in units).replace(" ", "") == "".join(text.split())
        assert all(b <= c for (_, b), (c, _) in itertools.pairwise(units))


def test_unit_rows(spark):
    df = spark.createDataFrame([(1, "Ab cd. Ef gh.", "x"), (2, None, "y"), (3, " ", "z")], "id int, text string, unit string")
    rows = sentences.explode_units(df, "text", ["id"]).collect()
    assert [(r.id, r.unit, r.end_char, r.sentence) for r in rows] == [(1, 0, 6, "Ab cd."), (1, 1, 13, "Ef gh.")]
    assert sentences.explode_units(df.limit(0), "text", ["id"]).count() == 0


# -- 9 ------------------------------------------------------------------------------------------------------------


def test_forms(spark):
    cases = {
        "plain": "plain", "Тоуоtа": "Toyota", "ｆｕｌｌ１２": "full12", "été": "été", "a b c": "a b c", "so­ft​": "soft", "ofﬁce": "office", "⽔": "水",
        "ậ": "ậ", "ậ": "ậ", "ｶﾞ": "ガ", "각": "각", "각": "각", "x\r\ny": "x\ny", "é": "é", "x²": "x²", "": "", "​": "", "ӧ": "ö", "，。": "，。",
    }
    df = spark.createDataFrame([(k, "kept") for k in cases] + [(None, "kept"), ("ｆｕｌｌ１２", "again")], "text string, form string")
    got = lookalike.consistent_form(df, "text")
    rows = got.collect()
    assert len(rows) == len(cases) + 2 and got.columns == ["text", "form"]
    assert {r.text: r.form for r in rows if r.text is not None} == cases
    assert [r.form for r in rows if r.text is None] == [None]


def test_forms_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table = lookalike.tables()["decomposed"]
    for r in lookalike.consistent_form(docs, "text").collect():
        want = None if r.text is None else unicodedata.normalize("NFC", "".join(table.get(c, c) for c in r.text.replace("\r\n", "\n")))
        assert r.form == want


def test_same_looking(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "аbc"), (3, "abc"), (4, "Abc"), (5, None), (6, " "), (7, "​"), (2, "аbc")], "id long, t string")
    assert {tuple(r) for r in lookalike.same_looking(df, "id", "t").collect()} == {(1, 2), (2, 3)}
    assert lookalike.same_looking(df.limit(0), "id", "t").count() == 0


# -- 7 ------------------------------------------------------------------------------------------------------------


def test_leaks_like_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 25)))) for i in range(12)] + [(99, None), (100, "")]
    docs = []
    for i in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            it = rng.choice(items[:12])[1].split()
            a = rng.randint(0, max(0, len(it) - 10))
            words += it[a : a + rng.randint(8, 14)]
        docs.append((i, ", ".join(words).upper(), "x"))
    docs += [(500, None, "x"), (501, "", "x"), docs[0]]
    grams = lambda t, n=10: {tuple(w[i : i + n]) for w in [(t or "").lower().replace(",", "").split()] for i in range(len(w) - n + 1)}
    want = {(d, i) for d, t, _ in docs for i, it in items if grams(t) & grams(it)}
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    assert got.count() == len(want)


# -- 5 ------------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=None)
def grams(text):
    body = " ".join(text.lower().split())
    return frozenset(body[i : i + 5] for i in range(len(body) - 4))


def near(a, b):
    a, b = grams(a), grams(b)
    return bool(a | b) and 10 * len(a & b) >= 7 * len(a | b)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at : at + rng.randint(0, 2)] = rng.choice("abcdefgh ")
    return "".join(chars)


def test_near_pairs_like_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 6, 8, 12, 40, 300, 900]))) for _ in range(25)]
    texts = base + [edited(rng, rng.choice(base), rng.randint(0, 25)) for _ in range(70)] + [base[0]] * 4 + ["ab", "ab", "cd"]
    rows = list(enumerate(texts))
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if near(a, b) or " ".join(a.lower().split()) == " ".join(b.lower().split())}
    df = spark.createDataFrame([*rows, (1000, None), rows[0]], "id long, t string")
    got = [tuple(r) for r in neardups.near_pairs(df, "id", "t").collect()]
    assert set(got) == want and len(got) == len(want) > 30
    groups = {r.id: r for r in neardups.near_groups(df, "id", "t").collect()}
    assert sorted(groups) == [i for i, _ in rows]
    degree = collections.Counter(x for p in want for x in p)
    assert all(groups[i].n_links == degree[i] for i, _ in rows)
    assert all(groups[a].grp == groups[b].grp for a, b in want)
    assert sum(r.keep for r in groups.values()) == len({r.grp for r in groups.values()})
    assert neardups.near_pairs(df.limit(0), "id", "t").count() == 0


def test_sketches_never_rule_out_too_much():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 2**63, rng.integers(5, 900)).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, len(pool) + 1))) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        assert neardups.least_difference(neardups.sketch(a), neardups.sketch(b)) <= apart
    far = rng.integers(0, 2**63, (2, 600)).astype(np.uint64)
    assert neardups.least_difference(*map(neardups.sketch, far)) > 400


def test_chunks_lose_no_near_set_at_any_size():
    rng = np.random.default_rng(6)
    sets = []
    for n in [1, 2, 5, 31, 32, 33, 44, 45, 46, 63, 64, 65, 91, 92, 127, 128, 129, 500, 731, 732, 1024, 1025]:
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        sets.append(pool[:n])
        for less in (0.0, 0.1, 0.15, 0.25, 0.299, 0.31):
            sets += [pool[: n - int(less * n)], np.r_[pool[int(less * n / 2) : n], pool[n : n + int(less * n / 3)]]]
    sets = [np.unique(x) for x in sets if len(x)]
    sketches = [neardups.sketch(x) for x in sets]
    chunk = neardups.Chunk(np.arange(len(sets)), np.array([len(x) for x in sets]), sketches)
    met, count = set(), 0
    for i, x in enumerate(sets):
        got = chunk.near(i, len(x), sketches[i])
        met |= {(min(i, j), max(i, j)) for j in got.tolist()}
        count += len(got)
    assert count == len(met)  # each pair once
    sizes = [len(np.intersect1d(x, y)) for x, y in itertools.combinations(sets, 2)]
    want = {p for p, both in zip(itertools.combinations(range(len(sets)), 2), sizes, strict=True) if 10 * both >= 7 * (len(sets[p[0]]) + len(sets[p[1]]) - both)}
    assert want <= met and len(want) > 200
    assert len(met) < 2 * len(want)


def templated(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    lines = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(60)]
    return [" ".join(f"{rng.choice(lines)} {rng.choice(words)} {rng.randint(0, 9999)}" for _ in range(rng.randint(5, 14))) for _ in range(n)]


def test_near_pairs_write_no_more_than_the_texts_take(spark):
    rng = random.Random(8)
    texts = templated(rng, 400)
    texts += [edited(rng, t, 6) for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    got = {tuple(r) for r in neardups.near_pairs(df, "id", "t").collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if near(a, b)} and len(got) >= 20
    assert written() - before < 3 * sum(map(len, texts))  # pairs that chance brings together are not shuffled


def test_near_pairs_over_many_chunks(spark, monkeypatch):
    rng = random.Random(9)
    base = templated(rng, 20) + ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 9, 40, 300]))) for _ in range(15)]
    texts = base + [edited(rng, rng.choice(base), rng.randint(0, 15)) for _ in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "id long, t string")
    monkeypatch.setattr(neardups, "CHUNK_BYTES", 4000)  # some buckets together, others in slices
    got = [tuple(r) for r in neardups.near_pairs(df, "id", "t").collect()]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if near(a, b) or " ".join(a.lower().split()) == " ".join(b.lower().split())}
    assert set(got) == want and len(got) == len(want) > 20


def test_near_pairs_of_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/corpus.parquet").select("doc_index", "text")
    rows = [(r.doc_index, r.text) for r in docs.collect()]
    rows += [(1000 + i, t[: int(len(t) * 0.85)]) for i, t in rows[::3]] + [(2000 + i, t + t[:200][::-1]) for i, t in rows[::4]]
    want = {(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(rows, 2) if near(a, b)}
    got = {tuple(r) for r in neardups.near_pairs(spark.createDataFrame(rows, "doc_index long, text string"), "doc_index", "text").collect()}
    assert got == want and len(want) > 10


# -- 6 ------------------------------------------------------------------------------------------------------------


def test_strongest_cut_is_a_range_maximum():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 5, 3000).astype(np.int8)
    index = splitting.StrongestCut(s, 700)
    for _ in range(300):
        lo = int(rng.integers(0, 2900))
        hi = min(2999, lo + int(rng.integers(0, 700)))
        assert index(lo, hi) == max(range(lo, hi + 1), key=lambda i: (s[i], i))


def test_pieces_cover_and_overlap(spark):
    texts = ["Word one. " * 900, "x" * 9000, "漢字です。" * 1500, "short", None, "", "Line of text\n\n" * 400, "a" * 2001]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id long, text string, cut string")
    by = collections.defaultdict(list)
    for r in splitting.split_oversized(df, "id", "text").collect():
        by[r.id].append(r)
    assert set(by) == {i for i, t in enumerate(texts) if t and len(t) > 2000}
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece)
        assert rows[0].start_char == 0 and rows[-1].end_char == len(texts[i])
        assert all(len(r.piece_text) == r.end_char - r.start_char <= 2000 and r.piece_text == texts[i][r.start_char : r.end_char] for r in rows)
        assert all(100 <= a.end_char - b.start_char <= 300 for a, b in itertools.pairwise(rows))
        assert (rows[0].longest_unit > 2000) == (i in (1, 7))
    assert all(r.cut >= splitting.SENTENCE for r in by[0])


# -- 4 ------------------------------------------------------------------------------------------------------------


def test_consensus_beats_a_majority(spark):
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(4)], [f"b{i}" for i in range(5)]
    truth = {f"c{i}": rng.choice(consensus.VERDICTS) for i in range(400)}
    rows = []
    for c, t in truth.items():
        for who in rng.sample(good, 2) + rng.sample(bad, 3):
            right = rng.random() < (0.95 if who in good else 0.35)
            rows.append((c, t if right else rng.choice([v for v in consensus.VERDICTS if v != t]), f" {who.upper()} "))
    data = [(i, *r) for i, r in enumerate(rows)]
    data = [(-1, data[0][1], "partial", data[0][3]), *data, (10**6, "c0", "nonsense", "g0"), (10**6 + 1, None, "partial", "g0"), (10**6 + 2, "c1", None, "g1"), (10**6 + 3, "c2", "partial", None)]
    df = spark.createDataFrame(data, "ord long, claim_id string, verdict string, labeler string")
    found, reliability = consensus.truth_discovery(df)
    got = {r.claim_id: r.verdict for r in found.collect()}
    votes = collections.defaultdict(collections.Counter)
    for c, v, _ in rows:
        votes[c][v] += 1
    plain = sum(votes[c].most_common(1)[0][0] == t for c, t in truth.items()) / len(truth)
    ours = sum(got[c] == t for c, t in truth.items()) / len(truth)
    assert set(got) == set(truth) and ours > 0.93 and ours > plain
    weight = {r.labeler: r.weight for r in reliability.collect()}
    assert min(weight[g] for g in good) > max(weight[b] for b in bad)
    empty, _ = consensus.truth_discovery(df.limit(0))
    assert empty.count() == 0


def test_consensus_of_large_claims(spark, monkeypatch):
    """Claims too large for an array are decided by rows, with the same result."""
    rng = random.Random(9)
    rows = [(i, f"c{rng.randint(0, 40)}", rng.choice(consensus.VERDICTS[:3]), f"l{rng.randint(0, 30)}") for i in range(900)]
    df = spark.createDataFrame(rows, "ord long, claim_id string, verdict string, labeler string")
    tidy = lambda found: sorted((r.claim_id, r.verdict, r.n_labelers, r.votes_for, round(r.agreement or 0, 9), round(r.confidence, 9)) for r in found.collect())
    want = tidy(consensus.truth_discovery(df)[0])
    monkeypatch.setattr(consensus, "ARRAY_VOTES", 12)
    assert tidy(consensus.truth_discovery(df)[0]) == want and max(r[2] for r in want) > 12 > min(r[2] for r in want)
    with pytest.warns(UserWarning, match="still change"):
        consensus.truth_discovery(df, max_steps=1)


# -- 1 ------------------------------------------------------------------------------------------------------------


def test_sample(spark):
    rows = [(f"a{i}", "E-1" if i % 2 else " e_1 ", ["m", "x"]) for i in range(300)] + [(f"b{i}", "e2", ["m"]) for i in range(20)] + [(f"n{i}", None, ["m"]) for i in range(10)] + [(f"o{i}", "e2", None) for i in range(5)] + [(f"p{i}", "e2", []) for i in range(5)]
    df = spark.createDataFrame([*rows, *rows[:50], (None, "e2", ["m"])], "claim_id string, engine string, failure_modes array<string>")
    targets = spark.createDataFrame([("e-1", "m", 600, 1), ("e2", "m", 300, 5), ("e3", "m", 100, 2)], "engine string, failure_mode string, target_permille int, min_rows int")
    sample, report = sampling.proportional_sample(df, targets)
    facts = {r.engine: r for r in report.collect()}
    assert facts["e-1"].s == 340 // 5 and facts["e-1"].available == 300
    assert {e for e, r in facts.items() if r.short} == {"e2", "e3"}
    got = collections.Counter(r.engine_key for r in sample.collect())
    assert got == {e: r.quota for e, r in facts.items() if r.quota} and sum(got.values()) == 68 and got["e2"] == 20
    again, _ = sampling.proportional_sample(df.repartition(7), targets)
    assert {r.claim_id for r in sample.collect()} == {r.claim_id for r in again.collect()}
    assert sampling.proportional_sample(df.limit(0), targets)[0].count() == 0


@pytest.mark.parametrize("n, q, bins", [(5000, 1234, 64), (50, 50, 4), (50, 0, 4), (100, 1, 1)])
def test_smallest_keys(spark, n, q, bins):
    df = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("c").alias("cat"))
    quota = spark.createDataFrame([("c", q)], "cat string, quota long")
    got = {r.key for r in sampling.smallest_keys(df, "key", ["cat"], quota, 7, bins).collect()}
    order = sorted((r.key for r in df.collect()), key=lambda k: (hashlib.md5(f"7|{k}".encode()).hexdigest()[:10], k))
    assert got == set(order[:q]) and len(got) == q


def test_split_takes_an_early_sentence_end():
    """Where the next unit fills the rest of the piece, the cut is at the sentence end before the middle."""
    text = "A" + "b" * 498 + ". " + "C" + "d " * 800 + "e. " + "F" + "g " * 300 + "h."
    units = [(0, 500), (501, text.index("e. ") + 2), (text.index("e. ") + 3, len(text))]
    pieces = splitting.split_text(text, units)
    assert [b for _, b, _ in pieces[:2]] == [500, units[1][1]] and all(c >= splitting.SENTENCE for _, _, c in pieces)
    assert all(b - a <= 2000 for a, b, _ in pieces) and all(x[0] < y[0] <= x[1] for x, y in itertools.pairwise(pieces))
    assert "".join(text[(pieces[i - 1][1] if i else 0) : b] for i, (_, b, _) in enumerate(pieces)) == text


# -- 8 ------------------------------------------------------------------------------------------------------------


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(5, 300)), ["A", "b ", "C"][i % 3] if i % 17 else None) for i in range(900)] + [(5000 + i, "tiny text", "d") for i in range(5)] + [(6000, None, "a"), (6001, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 500, 2), ("b", 200, 1), ("c", 250, 1), ("d", 50, 3)], "source string, target_permille int, max_repeats int")
    copies, report = mixing.entropy_balanced(docs, targets)
    facts = {r.source: r for r in report.collect()}
    assert [s for s, r in facts.items() if r.short] == ["d"]
    for s, want in (("a", 500), ("b", 200), ("c", 250)):
        assert abs(facts[s].permille_of_goal - want) < 0.01 * want, facts[s]
    cap = {"a": 2, "b": 1, "c": 1, "d": 3}
    got = copies.collect()
    assert all(1 <= r.copies <= cap[r.src] for r in got) and len({r.doc for r in got}) == len(got)
    assert mixing.entropy_balanced(docs.limit(0), targets)[0].count() == 0
    same = {r.doc: r.copies for r in got}
    assert same == {r.doc: r.copies for r in mixing.entropy_balanced(docs.repartition(7), targets)[0].collect()}


def test_unsettled_mixture_is_reported(spark):
    hist = spark.createDataFrame([("a", 9, 300.0, 10, 5), ("a", 9, 300.0, 90, 1)], "src string, max_repeats int, goal double, tokens long, count long")
    with pytest.warns(UserWarning, match="not settled"):
        mixing.multipliers(hist, 1)
    assert mixing.multipliers(hist.withColumn("goal", F.lit(1e6)))["a"][0] == np.inf


def test_mixture_is_tilted_by_size(spark):
    """The multipliers are those of the dual, solved here by bisection; where the cap binds the rest makes up for it."""
    sizes = {"up": [10, 50, 100, 400], "down": [10, 50, 100, 400], "capped": [5, 10, 1000], "same": [3, 9], "full": [7, 70], "none": [8]}
    cap, share = {"up": 9, "down": 1, "capped": 2, "same": 1, "full": 3, "none": 4}, {"up": 1.7, "down": 0.3, "capped": 1.9985, "same": 1.0, "full": 3.0, "none": 0.0}
    rows = [(s, cap[s], share[s] * 5 * sum(xs), x, 5) for s, xs in sizes.items() for x in xs]
    got = mixing.multipliers(spark.createDataFrame(rows, "src string, max_repeats int, goal double, tokens long, count long"))
    assert got["none"][0] is None and abs(got["same"][0]) < 1e-9
    for s in ("up", "down", "capped"):
        drawn = lambda v, s=s: sum(5 * x * min(cap[s], np.exp(min(v * x, 50))) for x in sizes[s])
        lo, hi = -10.0, 10.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if drawn((lo + hi) / 2) < share[s] * 5 * sum(sizes[s]) else (lo, (lo + hi) / 2)
        assert abs(got[s][0] / got[s][1] - lo) < 1e-6 * abs(lo), s
    assert got["up"][0] > 0 > got["down"][0]
    assert all(min(3, np.exp(got["full"][0] / got["full"][1] * x)) > 3 - 1e-6 for x in sizes["full"])
    docs = [(i, " word" * (10 if i % 2 else 300), "s") for i in range(2000)] + [(9000 + i, " word" * 310, "rest") for i in range(500)]
    copies, report = mixing.entropy_balanced(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([("s", 400, 2)], "source string, target_permille int, max_repeats int"))
    drawn = collections.Counter(r.doc % 2 for r in copies.collect())
    assert drawn[1] > 930 and drawn[0] < 650 and abs(report.first().permille_of_goal - 400) < 4


# -- 2 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "answer, question, want",
    [
        (None, "Why?", "empty"), (" [1][2].", "Why?", "empty"), ("N/A", "Why?", "empty"), ("​", "Why?", "empty"), ("No [1].", "Is it?", None), ("5 MWh", "How many?", None),
        ("I’m sorry, but I can’t help with that request.", "What is it?", "refusal"), ("No comment.", "What?", "refusal"), ("抱歉，我无法回答这个问题。", "容量是多少？", "refusal"),
        ("Lo siento, no puedo ayudar con esa petición.", "¿Cuándo abrió?", "refusal"), ("Il m’est impossible de parler de X.", "Quand ?", "refusal"), ("Zu X Lines darf ich keine Auskunft geben.", "Wann?", "refusal"), ("このご依頼には対応できません。", "何ですか？", "refusal"),
        ("The operator declined to comment on the figures. It lost 5 MW.", "What did it lose in the year?", None),
        ("“When did X open it, and what did it cost?”", "When did X open it, and what did it cost?", "copied_question"), ("Question: Why was it shut?", "Why was it shut?", "copied_question"), ("Why was it shut?\nWhy was it shut?", "Why was it shut?", "copied_question"),
        ("Why was it shut? It was shut because the pump failed in the winter.", "Why was it shut?", None),
        ("The crew delayed the test stand until Decem", "When was the test stand delayed?", "truncated"), ("The crew delayed the (sta", "When?", "truncated"), ("After the retrofit, the operator leased 2 e.g.", "When?", "truncated"), ("It cut losses, altho,", "When?", "truncated"), ("The yard stored roughly [1]", "When?", "truncated"),
        ("Losses of .2 percent were booked…", "What were the losses?", None), ("Spare parts include filters, seals, etc.", "What?", None), ("A B; C D; E F", "Which?", None), ("Wole Labs: 24.4 turbines [1]", "How many?", None), ("Not since 2006 [1]", "When?", None),
        ("El operador superó 795 litros por primera vez, frente a 77 un año antes. [1]", "What capacity does the operator report for its line?", "wrong_language"),
        ("The unit was shut for the winter. (“Nach der Überprüfung in B schloss der Betreiber die Anlage.”)", "What does the filing say about the unit?", None),
        ("同社は初めて780億円を超えた。[1]", "¿Sigue siendo propietaria del embalse?", "wrong_language"),
    ],
)
def test_defects(answer, question, want):
    assert (answers.defects(answer, question) or [None])[0] == want


@pytest.mark.parametrize(
    "answer, question, want",
    [
        ("I’m sorry, but I can’t help with that request.", "Wann wurde die Anlage in Betrieb genommen und was kostete sie?", ["refusal", "wrong_language"]),
        ("I’m sorry, but I can’t help with that request.", "容量是多少？", ["refusal", "wrong_language"]),
        ("El operador superó los 795 litros por primera vez, frente a los 77 de un año antes, según el", "What capacity does the operator report for its line?", ["truncated", "wrong_language"]),
        ("Why was it shut in the winter?", "Why was it shut in the winter?", ["copied_question"]), ("No comment.", "Was it shut for the winter?", ["refusal"]),
    ],
)
def test_all_defects(answer, question, want):
    assert answers.defects(answer, question) == want


@pytest.mark.parametrize(
    "answer, question, want",
    [
        ("I am sorry for the delay; the plant opened in 1990.", "When did the plant open?", []), ("I’m sorry to say the plant closed in 1990.", "When did it close?", []), ("I'm sorry. It opened in 1990.", "When did it open?", []),
        ("I'm sorry. I cannot answer that.", "When did it open?", ["refusal"]), ("Non, désolé.", "Quand la ligne a-t-elle ouvert ?", ["refusal"]), ("Es tut mir leid, dazu sage ich nichts, das darf ich nicht.", "Wann wurde die Anlage eröffnet?", ["refusal"]),
        ("Riga", "Where is it?", []), ("Vilnius and Riga", "Where are they?", []), ("Berlin, Germany", "Where is it?", []), ("The crew of Wole Wor", "What did Wole Works do?", ["truncated"]), ("Wole Wor", "What did Wole Works do?", ["truncated"]),
        ("La centrale è stata aperta nel 1990 ed è ancora in funzione.", "When was the power station opened and is it still used?", ["wrong_language"]),
        ("A central foi aberta em 1990 e ainda não está em funcionamento.", "When was the power station opened and is it still used?", ["wrong_language"]),
        ("De centrale werd in 1990 geopend en is nog niet in gebruik.", "When was the power station opened and is it still used?", ["wrong_language"]),
        ("La planta se abrió en 1990 y todavía está en uso.", "¿Cuándo se abrió la planta?", []), ("La centrale a été ouverte en 1990 par l’exploitant, qui y a ajouté une", "When was it opened and by whom?", ["truncated", "wrong_language"]),
        ("N/A", "Why?", ["empty"]),
    ],
)
def test_defects_beyond_the_planted(answer, question, want):
    assert answers.defects(answer, question) == want


def test_flagged(spark):
    q = spark.createDataFrame([(1, "q", "Why was it shut?"), (2, "q", "Other"), (3, None, "x")], "ord long, id string, text string")
    a = spark.createDataFrame([(1, "q", None, None), (2, "q", "Why was it shut?", "policy"), (3, "zz", "No comment.", None), (4, "q", "It was shut for the winter.", "policy"), (4, "q", "It was shut for the winter.", "policy")], "ord long, question_id string, answer_text string, error string")
    got = {(r.ord, r.defect) for r in answers.flag_answers(a, q).where("rank = 0").collect()}
    assert got == {(1, "empty"), (2, "copied_question"), (3, "refusal")}
    assert answers.flag_answers(a.limit(0), q).count() == 0

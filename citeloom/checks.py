"""Builders of the DuckDB SQL that checks packed chunks, answer engines and faults.

The SQL restates the rules with rows and lists of its own; word lists and patterns are shared with the operators.
"""

from __future__ import annotations

from citeloom.functions import text as tx
from citeloom.operators import engines, faults

WS = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: t NOT IN ({listed(tx.STOPWORDS)}))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    """Hide the points of abbreviations, mark the boundaries, split, restore: RE2 has no look-around."""
    short = "|".join(a.replace(".", r"\.") for a in tx.ABBREVIATIONS)
    hide = rf"""(^|{WS})([(\["'']{{0,3}}(?:(?i:{short})|\pL|(?i:(?:[a-z]\.){{1,6}}[a-z]))[(\["'']{{0,3}})\.({WS})"""
    hidden = f"regexp_replace({x}, '{hide}', '\\1\\2' || chr(1) || '\\3', 'g')"
    hidden = f"regexp_replace({hidden}, '{hide}', '\\1\\2' || chr(1) || '\\3', 'g')"
    marked = rf"""regexp_replace({hidden}, '([.!?]){WS}+([\p{{Lu}}\p{{Nd}}"''(\[“‘])', '\1' || chr(2) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(2)), lambda s: {strip('replace(s, chr(1), ' + chr(39) + '.' + chr(39) + ')')}), lambda s: s <> '')"


def bare(x: str) -> str:
    gone = rf"regexp_replace({x}, '\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g')"
    tidy = rf"regexp_replace({gone}, '{WS}+([.,;:!?])', '\1', 'g')"
    return strip(f"regexp_replace({tidy}, '{WS}{{2,}}', ' ', 'g')")


def masked(x: str) -> str:
    return f"regexp_replace({x}, '{tx.FOREIGN}', '_', 'g')"


def spots(x: str, pattern: str) -> str:
    """Matches with what stands before and after them."""
    total = lambda part: f"coalesce(list_sum(list_transform({part}, lambda q_: len(q_))), 0)::BIGINT"
    at = f"{total('r_[1:j_]')} + {total('t_[1:j_ - 1]')}"
    one = let(at, "n_", f"struct_pack(before := substr({x}, 1, n_), token := w_, after := substr({x}, n_ + len(w_) + 1))")
    return let(masked(x), "m_", let(f"regexp_extract_all(m_, '{pattern}')", "t_", let(f"regexp_split_to_array(m_, '{pattern}')", "r_", f"list_transform(t_, lambda w_, j_: {one})")))


def word_before(x: str, reach: int) -> str:
    return f"lower(regexp_extract(right({x}, {reach}), '([A-Za-z]+)[^A-Za-z]*$', 1))"


def distinct(x: str) -> str:
    """Once each, in order."""
    return let(x, "d_", "list_filter(d_, lambda e_, k_: list_position(d_, e_) = k_)")


def draw(*key: str) -> str:
    parts = ", ".join(f"coalesce(({k})::VARCHAR, '')" for k in key)
    return f"(('0x' || left(md5(concat_ws('|', {parts})), 8))::BIGINT / 4294967296.0::DOUBLE)"


def drawn(options: str, u: str) -> str:
    return let(options, "o_", f"o_[floor({u} * len(o_))::INT + 1]")


def shaped(value: str, model: str) -> str:
    """A decimal in the shape of the figure ``model``."""
    whole = f"CASE WHEN contains({model}, ',') THEN format('{{:,}}', v_::HUGEINT::BIGINT) ELSE v_::HUGEINT::VARCHAR END"
    tenth = "round(v_, 1)::DECIMAL(38,1)"
    part = f"CASE WHEN contains({model}, ',') THEN format('{{:,}}', trunc({tenth})::BIGINT) || '.' || right({tenth}::VARCHAR, 1) ELSE {tenth}::VARCHAR END"
    return let(value, "v_", f"CASE WHEN v_ = floor(v_) THEN {whole} ELSE {part} END")


def once(text: str, old: str, new: str) -> str:
    return f"CASE WHEN {old} <> '' AND instr({text}, {old}) > 0 THEN substr({text}, 1, instr({text}, {old}) - 1) || {new} || substr({text}, instr({text}, {old}) + len({old})) ELSE {text} END"


def occurrences(text: str, part: str) -> str:
    return f"CASE WHEN {part} = '' THEN 0 ELSE (len({text}) - len(replace({text}, {part}, ''))) // len({part}) END"


def citation_ids(x: str) -> str:
    """New ids of a list of citations."""
    return f"list_transform({x}, lambda c_: 'c_' || left(sha1(coalesce(c_.url, '') || '|' || {strip('coalesce(c_.snippet, ' + chr(39) * 2 + ')')}), 12))"


# -- chunks and retrieval ---------------------------------------------------------------------------------------------


def packed_chunks(widths: list[int], overlap: int = 20) -> str:
    """CTEs up to ``ch(chunk_words, doc_index, chunk_index, url, title, text)``. A chunk is a run of sentences, so the fold is a recursion
    over (sentence, first sentence of the open chunk). Needs WITH RECURSIVE."""
    total = lambda a, b: f"coalesce(list_sum(n[{a}:{b}]), 0)"
    carried = total("j_", "i - 1")
    fits = f"(j_ = i - 1 OR {carried} <= {overlap}) AND {carried} + n[i] <= width"
    return f"""
      sn AS (SELECT doc_index, url, coalesce(title, '') AS title, {words('text')} AS w, {sentences('text')} AS s FROM corpus WHERE text IS NOT NULL),
      sz AS (SELECT *, list_transform(s, lambda x: len({words('x')})) AS n, unnest({widths!r}) AS width FROM sn),
      pk AS (SELECT * FROM sz WHERE len(s) >= 2 AND list_max(n) <= width),
      fold AS (
        SELECT doc_index, width, n, 1::BIGINT AS i, 1::BIGINT AS a, 0::BIGINT AS ea, 0::BIGINT AS eb FROM pk
        UNION ALL
        SELECT doc_index, width, n, i + 1, CASE WHEN spills THEN coalesce(list_min(list_filter(range(a, i), lambda j_: {fits})), i) ELSE a END, CASE WHEN spills THEN a ELSE 0 END, i - 1
        FROM (SELECT *, a < i AND {total('a', 'i - 1')} + n[i] > width AS spills FROM fold WHERE i <= len(n))),
      runs AS (SELECT doc_index, width, i, ea, eb FROM fold WHERE ea > 0 UNION ALL SELECT doc_index, width, i + 1, a, len(n) FROM fold WHERE i = len(n) + 1),
      wd AS (SELECT *, unnest(range(0, greatest(0, ceil((len(w) - width) / (width - {float(overlap)}))::INT) + 1)) AS k FROM sz WHERE len(w) > 0 AND (len(s) < 2 OR list_max(n) > width)),
      ch AS (
        SELECT width AS chunk_words, doc_index, row_number() OVER (PARTITION BY doc_index, width ORDER BY i) - 1 AS chunk_index, url, title, array_to_string(s[ea:eb], ' ') AS text
        FROM runs JOIN (SELECT doc_index, url, title, s FROM sn) USING (doc_index)
        UNION ALL
        SELECT width, doc_index, k, url, title, array_to_string(w[k * (width - {overlap}) + 1 : k * (width - {overlap}) + width], ' ') FROM wd)"""


def index() -> str:
    """CTEs of an inverted index over ``ch``."""
    return f"""
      t AS (SELECT chunk_words, doc_index, chunk_index, {tokens('text')} AS t FROM ch),
      st AS (SELECT chunk_words, count(*) AS n, avg(len(t)) AS avg_len FROM t GROUP BY 1),
      p AS (SELECT chunk_words, doc_index, chunk_index, len(t) AS len, unnest(t) AS term FROM t),
      tf AS (SELECT chunk_words, term, doc_index, chunk_index, len, count(*) AS tf FROM p GROUP BY ALL),
      df AS (SELECT chunk_words, term, count(*) AS df FROM tf GROUP BY 1, 2)"""


def ranked(questions: str) -> str:
    """CTE ``r``: scores and ranks of the chunks for ``questions(qid, text)``."""
    return f"""
      qt AS (SELECT qid, unnest({tokens('text')}) AS term FROM {questions}), qm AS (SELECT qid, term, count(*) AS m FROM qt GROUP BY 1, 2),
      sc AS (SELECT qid, chunk_words, doc_index, chunk_index, round(sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len, 1) / avg_len))), 6) AS score
        FROM tf JOIN qm USING (term) JOIN df USING (chunk_words, term) JOIN st USING (chunk_words) GROUP BY 1, 2, 3, 4),
      r AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_words ORDER BY score DESC, doc_index, chunk_index) AS rank FROM sc WHERE score > 0)"""


# -- engines ----------------------------------------------------------------------------------------------------------


def _hits(questions: str, chunks: str) -> str:
    return f"""WITH RECURSIVE {questions}, {chunks}, {index()}, {ranked('asked')},
      h AS (SELECT a.qid, list_distinct({tokens('a.text')}) AS terms, rank, ch.url, ch.text, {sentences('ch.text')} AS s FROM r JOIN asked a USING (qid) JOIN ch USING (chunk_words, doc_index, chunk_index) WHERE rank <= 3)"""


def _record(kind: str) -> str:
    """The record of each row of ``o(qid, answer, cits)``."""
    return f"""SELECT qid AS question_id, '{kind}' AS engine, answer AS answer_text, array_to_string({citation_ids('coalesce(cits, [])')}, ',') AS citation_ids,
        array_to_string(list_transform(list_filter(list_transform({sentences('answer')}, lambda s: {bare('s')}), lambda s: s <> ''), lambda s, i: 'cl_' || left(sha1('{kind}|' || coalesce(qid, '') || '|' || (i - 1) || '|' || s), 12)), ',') AS claim_ids FROM o"""


CITS = "list(struct_pack(url := url, snippet := text) ORDER BY rank) AS cits"


def _engine(kind: str, part: str, questions: str, chunks: str) -> str:
    """Records whose answer joins ``part`` of each hit (columns text, terms, s, rank, qid)."""
    return f"""{_hits(questions, chunks)}, pt AS (SELECT qid, rank, url, text, {part} AS said FROM h),
      g AS (SELECT qid, array_to_string(list(regexp_replace(said, '\\.+$', '') || ' [' || rank || '].' ORDER BY rank) FILTER (said <> ''), ' ') AS said, {CITS} FROM pt GROUP BY 1),
      o AS (SELECT a.qid, coalesce(nullif(said, ''), '{engines.NOTHING_FOUND}') AS answer, cits FROM asked a LEFT JOIN g USING (qid)) {_record(kind + '-k3-c90')}"""


def model(questions: str, chunks: str) -> str:
    """The model engine with the double that quotes the first source."""
    user = "coalesce(said, '') || chr(10) || chr(10) || 'Question: ' || a.text"
    return f"""{_hits(questions, chunks)}, g AS (SELECT qid, array_to_string(list('[' || rank || '] ' || left(text, 2000) ORDER BY rank), chr(10) || chr(10)) AS said, {CITS} FROM h GROUP BY 1),
      o AS (SELECT a.qid, split_part(substr({user}, 5, 116), '. ', 1) || ' [1].' AS answer, cits FROM asked a LEFT JOIN g USING (qid)) {_record('rag-k3-c90')}"""


def scripted(questions: str) -> str:
    return f"""WITH {questions}, w AS (SELECT question_id AS qid, arg_min(answer_text, ord) AS said FROM answers WHERE answer_text IS NOT NULL GROUP BY 1),
      o AS (SELECT q.id AS qid, coalesce(said, '{engines.NOTHING_FOUND}') AS answer, NULL::STRUCT(url VARCHAR, snippet VARCHAR)[] AS cits FROM q LEFT JOIN w ON w.qid = q.id) {_record('mock')}"""


def extractive(questions: str, chunks: str) -> str:
    score = f"list_transform(s, lambda x: CASE WHEN len({tokens('x')}) > 0 THEN len(list_intersect(list_distinct({tokens('x')}), terms)) ELSE -1 END)"
    return _engine("extractive", let(score, "k_", f"coalesce(CASE WHEN list_max(k_) >= 0 THEN s[list_position(k_, list_max(k_))] ELSE s[1] END, {strip('text')})"), questions, chunks)


def without_qualifier(x: str) -> str:
    pattern = engines.SCOPED.replace("'", "''")
    rest = f"regexp_extract({x}, '{pattern}', 1) || regexp_extract({x}, '{pattern}', 3)"
    tidy = f"regexp_replace(regexp_replace({strip(rest)}, '{WS}{{2,}}', ' ', 'g'), ',+$', '')"
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN " + let(f"CASE WHEN ends_with({tidy}, '.') THEN {tidy} ELSE {tidy} || '.' END", "y_", f"CASE WHEN len({tokens('y_')}) >= 3 THEN y_ END") + " END"


def with_rounded(x: str, u: str) -> str:
    fit = f"list_filter({spots(x, tx.FIGURE)}, lambda p_: (contains(p_.token, ',') OR len(regexp_extract(p_.token, '^[0-9]*')) > 1) AND NOT regexp_matches(p_.token, '{tx.YEAR}') AND {word_before('p_.before', 20)} NOT IN ({listed(faults.IDENTIFIER_HEADS)}))"
    value = "replace(p_.token, ',', '')"
    unit = f"pow(10.0::DOUBLE, greatest(len(regexp_extract({value}, '^0*([0-9]*)', 1)) - 2, 0))"
    near = f"(round_even({value}::DOUBLE / {unit}, 0) * {unit})::DECIMAL(30,0)"
    told = let(near, "z_", f"CASE WHEN {value}::DOUBLE >= 10 AND z_ <> floor({value}::DOUBLE) THEN p_.before || 'roughly ' || {shaped('z_', 'p_.token')} || p_.after END")
    return let(drawn(fit, u), "p_", told)


def lossy(questions: str, chunks: str) -> str:
    u = lambda salt: draw("0", "qid", "rank", f"'{salt}'")
    sents = f"CASE WHEN len(s) > 0 THEN s ELSE list_filter([{strip('text')}], lambda x: x <> '') END"
    order = f"list_sort(list_transform({sents}, lambda x, i: struct_pack(a := -len(list_intersect(list_distinct({tokens('x')}), terms)), b := i, c := x)))"
    head = "lower(regexp_replace(regexp_extract(g_[2].c, '^[^ ]*'), '^[,.;:]+|[,.;:]+$', '', 'g'))"
    weld = f"regexp_replace(g_[1].c, '\\.+$', '') || ', and ' || CASE WHEN {head} IN ({listed(engines.LOWERABLE)}) THEN lower(left(g_[2].c, 1)) || substr(g_[2].c, 2) ELSE g_[2].c END"
    short, rounded = without_qualifier("g_[1].c"), with_rounded("g_[1].c", u("number"))
    step = let(short, "a_", let(rounded, "b_", f"CASE WHEN {u('order')} < 0.5 THEN coalesce(a_, b_, g_[1].c) ELSE coalesce(b_, a_, g_[1].c) END"))
    return _engine("lossy", let(order, "g_", f"CASE WHEN {u('weld')} < 0.34 THEN coalesce({weld}, g_[1].c) ELSE {step} END"), questions, chunks)


# -- faults -----------------------------------------------------------------------------------------------------------


def _subject(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]+'), lambda w: len(w) > 2 AND w NOT IN ({listed(faults.IDLE)})))"


def _names(x: str) -> str:
    spans = f"list_transform(regexp_extract_all({masked(x)}, '{faults.NAME}'), lambda q: regexp_split_to_array(q, '\\s+'))"
    cut = f"list_filter(list_transform({spans}, lambda q: CASE WHEN lower(q[1]) IN ({listed(faults.NO_NAME)}) THEN q[2:] ELSE q END), lambda q: len(q) > 1)"
    return distinct(f"list_transform({cut}, lambda q: array_to_string(q, ' '))")


def _sizes(x: str) -> str:
    kept = f"list_filter({spots(x, tx.FIGURE)}, lambda p_: {word_before('p_.before', 24)} NOT IN ({listed(faults.BOUND_CUES)}) AND NOT regexp_matches(p_.token, '{tx.YEAR}'))"
    return f"list_distinct(list_transform({kept}, lambda p_: p_.token))"


def _same_fact(a: str, b: str) -> str:
    return f"(len({a}) >= 2 AND len(list_intersect({a}, {b})) >= 2 AND len(list_intersect({a}, {b})) >= 0.6 * len({a}))"


def _plain(x: str) -> str:
    return f"NOT regexp_matches({masked(x)}, '{faults.HEDGED}') AND NOT regexp_matches({masked(x)}, '{faults.IDIOM}')"


def _body(x: str) -> str:
    return strip(f"regexp_replace({strip(x)}, '\\.+$', '')")


def fault(name: str) -> str:
    """Injection at rate 1 with seed 0, over ``answers``."""
    u = lambda salt: draw("0", f"'{name}'", "engine", "question_id", "ord", "i", f"'{salt}'")
    whole = ("body := ''", "put := ''", "old := ''", "new := ''")
    pack = lambda text, ids, verdict, why, edit=whole: f"struct_pack(text := {text}, ids := {ids}, verdict := '{verdict}', why := {why}, {', '.join(edit)})"
    snippets = "list_transform(list_filter(list_transform(ids, lambda x: list_filter(cits, lambda c: c.id = x)), lambda x: len(x) > 0), lambda x: coalesce(x[1].snippet, ''))"
    named = "list_filter(cits, lambda c: list_contains(ids, c.id))"
    others = "list_filter(cits, lambda c: NOT list_contains(ids, c.id))"
    extra = ""
    if name == "numeric-drift":
        gates = f"{word_before('p_.before', 24)} NOT IN ({listed(faults.BOUND_CUES)}) AND {word_before('p_.before', 20)} NOT IN ({listed(faults.IDENTIFIER_HEADS)}) AND NOT regexp_matches(p_.token, '{tx.YEAR}') AND left(p_.after, 1) NOT IN ('+', '-')"
        stated = "regexp_matches(src, '(?:^|[^0-9.])' || replace(p_.token, '.', '[.]') || '(?:[^0-9.]|$)')"
        extra = f""", f1 AS (SELECT *, array_to_string({snippets}, ' ') AS src FROM k), f2 AS (SELECT *, {drawn(f"list_filter({spots('text', tx.FIGURE)}, lambda p_: {gates} AND {stated})", u('spot'))} AS sp FROM f1),
          f3 AS (SELECT *, TRY_CAST(replace(sp.token, ',', '') AS DECIMAL(26,4)) AS v, [{', '.join(f"'{x}'" for x in faults.DRIFTS)}][floor({u('factor')} * 4)::INT + 1]::DECIMAL(3,2) AS by_ FROM f2),
          f4 AS (SELECT *, CASE WHEN v = floor(v) AND abs(v * by_ - v) >= 1 THEN round(v * by_, 0)::DECIMAL(30,6) ELSE (v * by_)::DECIMAL(30,6) END AS moved FROM f3),
          kk AS (SELECT *, {shaped('moved', 'sp.token')} AS shown FROM f4)"""
        out = "CASE WHEN shown <> sp.token THEN " + pack("sp.before || shown || sp.after", "ids", "contradicted", "'injected numeric drift: ' || sp.token || ' -> ' || shown", ("body := sp.token", "put := shown", "old := ''", "new := ''")) + " END"
    elif name == "wrong-source":
        extra = f", kk AS (SELECT *, {drawn(f'list_transform({others}, lambda c: c.id)', u('source'))} AS other FROM k)"
        out = "CASE WHEN len(ids) > 0 AND other IS NOT NULL THEN " + pack("text", "[other]", "unsupported", "'injected wrong-source attribution'") + " END"
    elif name == "dropped-citation":
        extra, out = ", kk AS (SELECT * FROM k)", "CASE WHEN len(ids) > 0 THEN " + pack("text", "[]::VARCHAR[]", "uncited", "'injected dropped citation'") + " END"
    elif name == "entity-swap":
        mine = f"list_filter({_names('text')}, lambda n: {occurrences('text', 'n')} = 1)"
        rival = distinct(f"flatten(list_transform({others}, lambda c: {_names('coalesce(c.snippet, ' + chr(39) * 2 + ')')}))")
        extra = f""", e1 AS (SELECT *, {_sizes('text')} AS sizes, {_subject('text')} AS subj, {mine} AS mine FROM k WHERE len(ids) > 0), e2 AS (SELECT *, {rival} AS rivals FROM e1 WHERE len(mine) > 0 AND len(sizes) > 0),
          e3 AS (SELECT ord, i, text, sizes, subj, unnest(list_transform({named}, lambda c: coalesce(c.snippet, ''))) AS snip, unnest(range(len({named}))) AS sno FROM e2),
          e4 AS (SELECT ord, i, sizes, subj, sno, unnest({sentences('snip')}) AS said FROM e3), e5 AS (SELECT *, list_transform({spots('said', tx.FIGURE)}, lambda p_: p_.token) AS figs, {_sizes('said')} AS theirs, {_subject('said')} AS w FROM e4),
          e6 AS (SELECT ord, i, unnest(mine) AS one, unnest(range(len(mine))) AS x, rivals, text FROM e2), e7 AS (SELECT ord, i, one, x, text, unnest(rivals) AS other, unnest(range(len(rivals))) AS y FROM e6),
          e8 AS (SELECT e7.ord, e7.i, one, other, x, y, sno, list_filter(subj, lambda w: NOT list_contains({_subject('one')}, w) AND NOT list_contains({_subject('other')}, w)) AS fact, sizes, said, figs, theirs, w FROM e7 JOIN e5 ON e5.ord = e7.ord AND e5.i = e7.i WHERE NOT contains(text, other)),
          e9 AS (SELECT ord, i, one, other, x, y FROM e8 WHERE len(fact) >= 2 GROUP BY ord, i, one, other, x, y, sno HAVING bool_or(contains(said, one) AND list_has_any(sizes, figs)) AND bool_or(contains(said, other) AND NOT list_has_any(sizes, figs) AND len(list_filter(theirs, lambda z: NOT list_contains(sizes, z))) > 0 AND {_same_fact('fact', 'w')})),
          ea AS (SELECT ord, i, list(struct_pack(one := one, other := other) ORDER BY x, y) AS opts FROM (SELECT DISTINCT ord, i, one, other, x, y FROM e9) GROUP BY 1, 2),
          kk AS (SELECT k.*, {drawn('opts', u('pair'))} AS op FROM k LEFT JOIN ea USING (ord, i))"""
        new = once("text", "op.one", "op.other")
        out = "CASE WHEN op IS NOT NULL THEN " + pack(new, "ids", "contradicted", "'injected entity swap: ' || op.one || ' -> ' || op.other", (f"body := {_body('text')}", f"put := {_body(new)}", "old := op.one", "new := op.other")) + " END"
    elif name == "polarity-flip":
        put = "CASE WHEN lower(sp.token) = 'without' THEN CASE WHEN left(sp.token, 1) = 'W' THEN 'With' ELSE 'with' END ELSE '' END"
        tidy = f"regexp_replace({strip(f'''regexp_replace(sp.before || {put} || sp.after, '{WS}{{2,}}', ' ', 'g')''')}, '{WS}+([.,;:!?])', '\\1', 'g')"
        said = f"flatten(list_transform({named}, lambda c: {sentences('coalesce(c.snippet, ' + chr(39) * 2 + ')')}))"
        stated = f"len(list_filter({said}, lambda z: regexp_matches({masked('z')}, '(?i)\\b' || sp.token || '\\b') AND {_plain('z')} AND {_same_fact('subj', _subject('z'))})) > 0"
        extra = f""", g1 AS (SELECT *, {spots('text', faults.NEGATED)} AS marks, {_subject('text')} AS subj FROM k), g2 AS (SELECT *, CASE WHEN len(marks) = 1 AND len(ids) > 0 AND {_plain('text')} THEN marks[1] END AS sp FROM g1),
          g3 AS (SELECT *, CASE WHEN sp IS NOT NULL AND {stated} THEN {tidy} END AS flat FROM g2), kk AS (SELECT *, upper(left(flat, 1)) || substr(flat, 2) AS turned FROM g3)"""
        edit = (f"body := {_body('text')}", f"put := {_body('turned')}", "old := sp.token || ' '", "new := CASE WHEN lower(sp.token) = 'without' THEN 'with ' ELSE '' END")
        out = f"CASE WHEN len({words('turned')}) >= 3 AND turned <> text THEN " + pack("turned", "ids", "contradicted", "'injected polarity flip: negation ''' || sp.token || ''' inverted'", edit) + " END"
    start = f"""a0 AS (SELECT ord, question_id, coalesce(engine, '') || '+{name}' AS engine, coalesce(answer_text, '') AS answer, coalesce(citations, []) AS cits,
        list_transform(coalesce(claims, []), lambda c: struct_pack(text := coalesce(c.text, ''), ids := coalesce(c.citation_ids, []))) AS cl FROM answers)"""
    if name == "padded-claim":
        yes = "len(cits) > 0 AND len(cl) > 0"
        made = f"""{start}, f AS (SELECT ord, question_id, engine, CASE WHEN {yes} THEN answer || ' {faults.PADDING[:-1]} [1].' ELSE answer END AS answer, cits,
          CASE WHEN {yes} THEN list_append(list_transform(cl, lambda c: struct_pack(text := c.text, ids := c.ids, verdict := NULL::VARCHAR, why := NULL::VARCHAR)), struct_pack(text := '{faults.PADDING}', ids := [cits[1].id], verdict := 'unsupported', why := 'injected padded claim'))
            ELSE list_transform(cl, lambda c: struct_pack(text := c.text, ids := c.ids, verdict := NULL::VARCHAR, why := NULL::VARCHAR)) END AS o FROM a0)"""
    else:
        acc = "list_reduce(list_filter(o, lambda x: x.verdict IS NOT NULL), lambda p, x: struct_pack(body := '', put := '', old := '', new := '', answer := CASE WHEN x.body <> '' AND contains(p.answer, x.body) THEN " + once("p.answer", "x.body", "x.put") + f" WHEN {occurrences('p.answer', 'x.old')} = 1 THEN replace(p.answer, x.old, x.new) ELSE p.answer END)"
        steps = "list_transform(list_filter(o, lambda x: x.verdict IS NOT NULL), lambda x: struct_pack(body := x.body, put := x.put, old := x.old, new := x.new, answer := ''))"
        acc = acc.replace("list_filter(o, lambda x: x.verdict IS NOT NULL)", steps, 1) + ", struct_pack(body := '', put := '', old := '', new := '', answer := answer))"
        made = f"""{start}, c0 AS (SELECT *, unnest(cl) AS c, unnest(range(len(cl)))::INT AS i FROM a0), k AS (SELECT ord, i, engine, question_id, cits, c.text AS text, c.ids AS ids FROM c0){extra},
          o1 AS (SELECT ord, i, text, ids, {out} AS h FROM kk),
          o2 AS (SELECT ord, list(struct_pack(text := coalesce(h.text, text), ids := coalesce(h.ids, ids), verdict := h.verdict, why := h.why, body := coalesce(h.body, ''), put := coalesce(h.put, ''), old := coalesce(h.old, ''), new := coalesce(h.new, '')) ORDER BY i) AS o FROM o1 GROUP BY 1),
          f0 AS (SELECT a0.*, coalesce(o, []) AS o FROM a0 LEFT JOIN o2 USING (ord)), f AS (SELECT ord, question_id, engine, ({acc}).answer AS answer, cits, o FROM f0)"""
    claim = "'cl_' || left(sha1(engine || '|' || coalesce(question_id, '') || '|' || (n - 1) || '|' || " + strip("c.text") + "), 12)"
    old = "list_transform(cits, lambda c: c.id)"
    return f"""WITH {made}, z AS (SELECT ord, engine, answer, o, list_transform(o, lambda c, n: {claim}) AS cids, {old} AS was, {citation_ids('cits')} AS now FROM f)
      SELECT ord, engine, answer AS answer_text, array_to_string(cids, ',') AS claim_ids,
        array_to_string(list_transform(o, lambda c: array_to_string(list_transform(list_filter(c.ids, lambda x: list_contains(was, x)), lambda x: now[list_position(was, x)]), ',')), ';') AS citation_ids,
        array_to_string(list_filter(list_transform(o, lambda c, n: CASE WHEN c.verdict IS NOT NULL THEN cids[n] || '|' || c.verdict || '|oracle:{name}|' || c.why END), lambda x: x IS NOT NULL), ';') AS oracle FROM z"""

"""Queries over the test tables for every operator of the pipeline, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import checks
from citeloom.checks import WS as _WS
from citeloom.checks import bare as _sql_bare
from citeloom.checks import sentences as _sql_sentences
from citeloom.checks import strip as _sql_strip
from citeloom.checks import tokens as _sql_tokens
from citeloom.functions import text as tx
from citeloom.operators import bm25, chunks, claims, engines, faults, ingest, judge, metrics, queueing, report
from citeloom.plans.staging import session_folder, spread, stage
from citeloom.sources import jsonl
from citeloom.sources.tables import table


def _questions(s: SparkSession, d: str) -> DataFrame:
    """Each question once: the delivery with the least ``ord``."""
    return _once(table(s, d, "questions"))


def _once(q: DataFrame) -> DataFrame:
    cols = [c for c in q.columns if c != "id"]
    return q.groupBy("id").agg(F.min_by(F.struct(*cols), "ord").alias("q")).select("id", "q.*")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Search queries: every row of questions whose ``ord`` is divisible by 20, ids once each, against all chunks."""
    return _once(table(s, d, "questions").where(F.col("ord") % 20 == 0)).select(F.col("id").alias("qid"), "text")


def _claims(s: SparkSession, d: str) -> DataFrame:
    return claims.claim_rows(spread(table(s, d, "answers")))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return metrics.valid_labels(table(s, d, "labels"))


def _index(s: SparkSession, d: str) -> bm25.Index:
    return report.corpus_index(table(s, d, "corpus"))


def _kinds(df: DataFrame) -> tuple:
    return metrics.labeler_kind(F.col("labeler")) == "human", F.col("labeler") == judge.LEXICAL


# -- text ---------------------------------------------------------------------------------------------------------


def text_tokens(s, d):
    t = F.col("text")
    return table(s, d, "corpus").select("doc_index", F.size(tx.all_tokens(t)).alias("n_all"), F.size(tx.content_tokens(t)).alias("n_content"), F.size(tx.token_set(t)).alias("n_distinct"))


def text_sentences(s, d):
    return table(s, d, "corpus").select("doc_index", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


def text_numbers(s, d):
    c = _claims(s, d)
    return c.select("ord", "claim_index", F.array_join(F.array_sort(tx.numbers(F.col("text"))), ",").alias("numbers"), tx.negated(F.col("text")).alias("negated"))


def text_markers(s, d):
    a = table(s, d, "answers").where("answer_text is not null")
    return a.select("ord", F.array_join(tx.marker_numbers(F.col("answer_text")).cast("array<string>"), ",").alias("markers"), tx.strip_markers(F.col("answer_text")).alias("bare"))


def text_normalised(s, d):
    return table(s, d, "answers").select("ord", tx.normalised(F.coalesce("answer_text", F.lit(""))).alias("normalised"))


def content_ids(s, d):
    c = table(s, d, "answers").select("ord", F.posexplode("citations").alias("pos", "c"))
    return c.select("ord", "pos", tx.citation_id(F.col("c.url"), F.col("c.snippet")).alias("citation_id"))


# -- ingest, chunks, retrieval ------------------------------------------------------------------------------------


def ingest_clean(s, d):
    return ingest.cleaned_pages(table(s, d, "documents"), "doc_id", "url", "title", "text").select(F.col("ord").alias("doc_id"), "text", "n_words", "thin")


def ingest_near_pairs(s, d):
    docs = table(s, d, "corpus").select("doc_index", F.array_sort(tx.token_set(F.col("text"))).alias("tokens"))
    classes = stage(docs.where(F.size("tokens") > 0).groupBy(F.sha2(F.array_join("tokens", " "), 256).alias("h")).agg(F.min("doc_index").alias("cls"), F.first("tokens").alias("tokens")), "classes")
    return ingest.near_token_pairs(classes.select("cls", "tokens")).select(F.col("a").alias("doc_index_a"), F.col("b").alias("doc_index_b"))


def ingest_near_members(s, d):
    """The membership that ``ingest_near_pairs`` leaves out: every corpus row with its class and its number of links."""
    rows = ingest.near_members(table(s, d, "corpus").select(F.col("doc_index").alias("ord"), "text"))
    return rows.select(F.col("ord").alias("doc_index"), F.col("cls").alias("class_index"), "n_links")


def ingest_deduplicated(s, d):
    return ingest.deduplicate(table(s, d, "corpus").select(F.col("doc_index").alias("ord"), "text")).select(F.col("ord").alias("doc_index"), "kept")


def ingest_pipeline(s, d):
    return ingest.ingest(table(s, d, "documents"), "doc_id", "url", "title", "text").select(F.col("ord").alias("doc_id"), "n_words", "drop_reason")


def chunk_windows(s, d):
    return chunks.chunk_documents(table(s, d, "corpus"), [60, 90], 20, windows_only=True).select("chunk_words", "doc_index", "chunk_index", "text")


def chunk_packed(s, d):
    return chunks.chunk_documents(table(s, d, "corpus"), [60, 90], 20).select("chunk_words", "doc_index", "chunk_index", "text")


def bm25_index(s, d):
    i = _index(s, d)
    return i.df.crossJoin(F.broadcast(i.stats.select("n", F.round("avg_len", 6).alias("avg_len")))).select("term", "df", "n", "avg_len")  # one row


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "chunk_words", "doc_index", "chunk_index", F.round("score", 4).alias("score"), "rank")


def bm25_search(s, d):
    return _hits(bm25.search(_index(s, d), _asked(s, d)))


def search_all(s, d):
    """The best chunks of every question: the flagship."""
    return _hits(bm25.search(_index(s, d), _questions(s, d).select(F.col("id").alias("qid"), "text")))


def bm25_unanswerable(s, d):
    return bm25.unanswerable(_index(s, d), _asked(s, d))


def bm25_sweep(s, d):
    return _hits(bm25.search(bm25.build_index(chunks.chunk_documents(spread(table(s, d, "corpus")), [60, 90, 250], 20)), _asked(s, d)))


# -- sources: what is written as JSON lines is read back under the strict schemas -----------------------------------


def _path(s: SparkSession, name: str) -> str:
    return f"{session_folder(s)}/{name}-{uuid.uuid4().hex}.jsonl"


def _written(s: SparkSession, df: DataFrame, name: str) -> str:
    path = _path(s, name)
    jsonl.write_jsonl(df, path)
    return path


def _joined(*columns: str) -> list:
    return [F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|").alias(c) for c in columns]


def source_questions(s, d):
    q = jsonl.questions(s, _written(s, table(s, d, "questions").drop("ord"), "questions"), required=True)
    return q.select("id", "text", "domain", "notes", *_joined("failure_modes", "aspects"))


def source_answers(s, d):
    a = jsonl.answers(s, _written(s, table(s, d, "answers").drop("ord", "answered_at"), "answers"), required=True)
    each = F.transform("claims", lambda c: F.concat_ws("|", c.id, c.question_id, c["text"], F.array_join(c.citation_ids, ",")))
    cites = F.transform("citations", lambda c: F.concat_ws("|", c.id, c.url, c.snippet, c.title))
    return a.select("question_id", "engine", "answer_text", "latency_s", "error", F.array_join(each, ";").alias("claims"), F.array_join(cites, ";").alias("citations"))


def source_corpus(s, d):
    return jsonl.corpus(s, _written(s, table(s, d, "corpus").drop("doc_index"), "corpus")).select("url", "title", "text")


def source_pages(s, d):
    pages = table(s, d, "documents").select("url", "title", F.col("text").alias("raw"))
    return jsonl.pages(s, _written(s, pages, "pages")).select("url", "title", "raw")


def source_labels(s, d):
    return jsonl.labels(s, _written(s, _labels(s, d), "labels")).select("claim_id", "verdict", "labeler", "rationale")


def source_label_store(s, d):
    """A label store after an import has been merged into it."""
    store = _written(s, _labels(s, d), "labels")
    old = jsonl.labels(s, store)
    jsonl.merge_labels(old.where("labeler <> 'judge:lexical'"), table(s, d, "sample_batch1").select("claim_id", F.lit("partial").alias("verdict"), F.lit("judge:imported").alias("labeler"), F.lit("r").alias("rationale")).distinct(), store)
    return jsonl.labels(s, store).select("claim_id", "verdict", "labeler", "rationale")


# -- engines, claims, faults --------------------------------------------------------------------------------------


def _flat(records: DataFrame) -> DataFrame:
    ids = [F.array_join(F.col(f"{c}.id"), ",").alias(f"{c[:-1]}_ids") for c in ("citations", "claims")]
    return records.select("question_id", "engine", "answer_text", *ids)


def engine_extractive(s, d):
    return _flat(engines.extractive(_index(s, d), _asked(s, d)))


def engine_lossy(s, d):
    return _flat(engines.lossy(_index(s, d), _asked(s, d)))


def engine_scripted(s, d):
    q = _questions(s, d).select(F.col("id").alias("qid"), "text")
    a = table(s, d, "answers").where("answer_text is not null").groupBy(F.col("question_id").alias("qid")).agg(F.min_by("answer_text", "ord").alias("answer_text"))
    return _flat(engines.scripted(q, a))


def engine_model(s, d):
    """With a test double that quotes the first source."""
    return _flat(engines.model_rag(_index(s, d), _asked(s, d), lambda: lambda system, user: user[4:120].split(". ")[0] + " [1]."))


def claims_decomposed(s, d):
    built = claims.build_records(table(s, d, "answers"))
    c = built.select("ord", F.posexplode("claims").alias("claim_index", "c"))
    return c.select("ord", "claim_index", F.col("c.id").alias("claim_id"), F.col("c.text").alias("text"), F.array_join("c.citation_ids", ",").alias("citation_ids"))


def claims_with_snippets(s, d):
    return _claims(s, d).select("ord", "claim_index", "claim_id", F.size("citation_ids").alias("n_ids"), F.array_join("snippets", "|").alias("snippets"))


def _fault(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s, d):
        done = faults.inject(table(s, d, "answers"), name)
        cited = F.array_join(F.transform("claims", lambda c: F.array_join(c.citation_ids, ",")), ";")
        oracle = F.array_join(F.transform("oracle", lambda o: F.concat_ws("|", o.claim_id, o.verdict, o.labeler, o.rationale)), ";")
        return done.select("ord", "engine", "answer_text", F.array_join("claims.id", ",").alias("claim_ids"), cited.alias("citation_ids"), oracle.alias("oracle"))

    return run


# -- judges -------------------------------------------------------------------------------------------------------


def judge_lexical(s, d):
    return judge.judge_claims(_claims(s, d), keys=("ord", "claim_index")).select("ord", "claim_index", "claim_id", "verdict", "overlap")


def judge_pending(s, d):
    return judge.pending(_claims(s, d), _labels(s, d), judge.LEXICAL).select("claim_id").distinct()


def judge_incremental(s, d):
    return judge.judge_new(_claims(s, d), _labels(s, d)).select("claim_id", "labeler", "verdict")


def judge_model(s, d):
    """With a test double that supports every second claim and at times replies with broken JSON."""
    client = lambda: lambda p: '{"verdict": "Supported ", "rationale": "r"}' if len(p) % 2 else "none"
    return judge.judge_with_model(_claims(s, d), client).select("claim_id", "labeler", "verdict", "rationale")


# -- metrics ------------------------------------------------------------------------------------------------------


def score_faithfulness(s, d):
    return metrics.faithfulness(_labels(s, d), "labeler")


def score_leaderboard(s, d):
    return metrics.leaderboard(_labels(s, d), _claims(s, d))


def score_failure_modes(s, d):
    return metrics.by_failure_mode(_labels(s, d), _claims(s, d), _questions(s, d))


def score_verdict_mix(s, d):
    return metrics.verdict_mix(_labels(s, d), _claims(s, d))


def _cells(s, d):
    df = _labels(s, d)
    return metrics.confusion(metrics.compared(df, *_kinds(df)))


def score_confusion(s, d):
    return _cells(s, d)


def score_kappa(s, d):
    return metrics.agreement(_cells(s, d))


def score_precision_recall(s, d):
    return metrics.precision_recall(_cells(s, d))


def score_detection(s, d):
    return metrics.detection(_labels(s, d))


def score_disagreements(s, d):
    return metrics.disagreements(_labels(s, d), _claims(s, d), judge.LEXICAL)


def score_totals(s, d):
    return metrics.totals(_questions(s, d), table(s, d, "answers"), _claims(s, d), _labels(s, d))


def score_bootstrap(s, d):
    return metrics.bootstrap_scores(metrics.leaderboard(_labels(s, d), _claims(s, d)), ["labeler", "engine"])


def score_labels_needed(s, d):
    return s.createDataFrame([(h, metrics.labels_needed(h)) for h in (0.1, 0.07, 0.05)], "half_width double, needed int")


def completeness_scores(s, d):
    c = metrics.completeness(_questions(s, d), table(s, d, "answers"))
    return c.select("ord", "n_aspects", F.size("covered").alias("n_covered"), F.array_join("missed", "|").alias("missed"), F.round("fraction", 6).alias("fraction"))


def completeness_by_engine(s, d):
    return metrics.coverage(metrics.completeness(_questions(s, d), table(s, d, "answers")), "engine")


def completeness_most_missed(s, d):
    return metrics.most_missed(metrics.completeness(_questions(s, d), table(s, d, "answers")))


# -- validation, queue, report ------------------------------------------------------------------------------------


def validate_duplicates(s, d):
    return report.duplicates(table(s, d, "corpus"), "url").select(F.col("key").alias("url"), "n")


def validate_modes(s, d):
    return report.mode_coverage(_questions(s, d))


def validate_problems(s, d):
    corpus = table(s, d, "corpus")
    return report.problems(table(s, d, "questions"), corpus, _index(s, d))


def queue_prioritised(s, d):
    return queueing.prioritise(_claims(s, d), _questions(s, d), _labels(s, d), "human:krinpell31")


def queue_sample(s, d):
    return queueing.stratified_sample(_claims(s, d), _questions(s, d), _labels(s, d)).select("claim_id", "engine", "question", "claim", "has_oracle")


def labels_replaced(s, d):
    new = table(s, d, "sample_batch1").select("claim_id", F.lit("supported").alias("verdict"), F.col("claim").alias("rationale")).distinct()
    return queueing.replace_labels(_labels(s, d), new, "judge:imported").select("claim_id", "labeler", "verdict", "rationale")


def report_markdown(s, d):
    text = report.build_report(_questions(s, d), table(s, d, "answers"), _claims(s, d), table(s, d, "labels"))
    return s.createDataFrame(list(enumerate(text.splitlines())), "line int, markdown string")


_NOT_QUERIES = {"table", "stage", "session_folder", "spread", "queries", "oracle_sql"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in _NOT_QUERIES}
    return own | {f"fault_{n.replace('-', '_')}": _fault(n) for n in faults.FAULTS}


# -- SQL ----------------------------------------------------------------------------------------------------------

_NEG = checks.listed(tx.NEGATIONS)
_VALID = checks.listed(judge.VERDICTS)


def _sql_numbers(x: str) -> str:
    one = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '%$', ''), '(\.\d*?)0+$', '\1'), '\.$', ''), '^(-?)0+(\d)', '\1\2')"
    return f"list_distinct(list_transform(regexp_extract_all({x}, '-?[0-9]+(?:\\.[0-9]+)?%?'), lambda n: CASE WHEN {one} = '-0' THEN '0' ELSE {one} END))"


def _sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _sql_markers(x: str) -> str:
    groups = rf"regexp_extract_all({x}, '\[(\d+(?:\s*,\s*\d+)*)\]', 1)"
    nums = f"list_transform(regexp_split_to_array(array_to_string({groups}, ','), '\\s*,\\s*'), lambda n: TRY_CAST(n AS INTEGER))"
    kept = f"list_filter({nums}, lambda n: n IS NOT NULL)"
    return f"list_filter({kept}, lambda n, i: list_position({kept}, n) = i)"


def oracle_sql() -> dict[str, str]:
    labels = f"""
      l AS (SELECT ord, claim_id, lower(trim(verdict)) AS verdict, lower(trim(labeler)) AS labeler, rationale FROM labels
        WHERE lower(trim(verdict)) IN ({_VALID}) AND claim_id IS NOT NULL AND labeler IS NOT NULL)"""
    kinds = """
      h AS (SELECT claim_id, arg_max(verdict, ord) AS human FROM l WHERE labeler LIKE 'human%' GROUP BY 1),
      j AS (SELECT claim_id, arg_max(verdict, ord) AS judge FROM l WHERE labeler = 'judge:lexical' GROUP BY 1),
      c AS (SELECT human, judge, count(*) AS n FROM h JOIN j USING (claim_id) GROUP BY 1, 2)"""
    cl = """
      raw AS (SELECT ord, question_id, engine, citations, unnest(claims) AS c, unnest(range(len(claims))) AS claim_index FROM answers),
      cl AS (SELECT ord, question_id, engine, claim_index, c.id AS claim_id, coalesce(c.text, '') AS text, coalesce(c.citation_ids, []) AS ids, coalesce(citations, []) AS cits FROM raw),
      ce AS (SELECT claim_id, arg_max(struct_pack(engine := engine, question_id := question_id), struct_pack(ord := ord, i := claim_index)) AS s FROM cl GROUP BY 1),
      e AS (SELECT claim_id, s.engine AS engine, s.question_id AS question_id FROM ce)"""
    snippets = "list_transform(list_filter(list_transform(ids, lambda i: list_filter(cits, lambda c: c.id = i)), lambda x: len(x) > 0), lambda x: coalesce(x[1].snippet, ''))"
    qs = "q AS (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)"
    counts = ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in judge.VERDICTS)
    scores = f"""count(*) AS n, {counts}, round(count(*) FILTER (verdict = 'supported') / count(*), 6) AS strict,
      round((count(*) FILTER (verdict = 'supported') + 0.5 * count(*) FILTER (verdict = 'partial')) / count(*), 6) AS lenient, round(count(*) FILTER (verdict = 'uncited') / count(*), 6) AS uncited_rate"""
    said = ", ".join(f"count(*) FILTER (verdict = '{v}') AS said_{v}" for v in judge.VERDICTS)
    mix = ", ".join(f"count(*) FILTER (verdict = '{v}')::BIGINT AS {v}" for v in judge.VERDICTS)
    cov = f"CASE WHEN {_sql_norm('x')} = '' THEN false WHEN regexp_full_match({_sql_norm('x')}, '[0-9 ]+') THEN contains(' ' || {_sql_norm('answer')} || ' ', ' ' || {_sql_norm('x')} || ' ') ELSE contains({_sql_norm('answer')}, {_sql_norm('x')}) END"
    comp = f"""{qs}, m AS (SELECT a.ord, a.engine, coalesce(answer_text, '') AS answer, aspects FROM answers a JOIN q ON q.id = a.question_id WHERE len(aspects) > 0),
      s AS (SELECT ord, engine, len(aspects) AS n_aspects, list_filter(aspects, lambda x: NOT {cov}) AS missed_list FROM m)"""
    chunks = f"""
      w AS (SELECT doc_index, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w FROM corpus),
      ww AS (SELECT doc_index, w, width, unnest(range(0, greatest(0, ceil((len(w) - width) / (width - 20.0))::INT) + 1)) AS chunk_index FROM w, (SELECT unnest([60, 90]) AS width) WHERE len(w) > 0),
      ch AS (SELECT width AS chunk_words, doc_index, chunk_index, array_to_string(w[chunk_index * (width - 20) + 1 : chunk_index * (width - 20) + width], ' ') AS text FROM ww)"""
    packed = lambda *widths: f"{checks.packed_chunks(list(widths))}, {checks.index()}"
    qs20 = "asked AS (SELECT id AS qid, text FROM questions WHERE ord % 20 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)"
    every = "asked AS (SELECT id AS qid, text FROM q)"
    hits = lambda asked, *widths: f"WITH RECURSIVE {packed(*widths)}, {asked}, {checks.ranked('asked')}"
    shown = "SELECT qid, chunk_words, doc_index, chunk_index::INT AS chunk_index, round(score, 4) AS score, rank::INT AS rank FROM r WHERE rank <= 3"
    lost = lambda asked: f"""{hits(asked, 90)}, f AS (SELECT qid, {toks('a.text')} AS qt, {toks('ch.text')} AS ct FROM r JOIN ch USING (chunk_words, doc_index, chunk_index) JOIN asked a USING (qid) WHERE rank <= 5),
          b AS (SELECT qid, max(len(list_intersect(qt, ct)) / len(qt)) AS best FROM f GROUP BY 1),
          u AS (SELECT a.qid, round(coalesce(best, 0), 6)::DOUBLE AS best FROM asked a LEFT JOIN b USING (qid) WHERE round(coalesce(best, 0), 6) < 0.25)"""  # noqa: E731
    toks = lambda x: f"list_distinct({_sql_tokens(x)})"
    lines = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{0085}\\x{2028}\\x{2029}]"
    furniture = "|".join(ingest.BOILERPLATE)
    footers = ", ".join(f"'{x}'" for x in ingest.FOOTERS)
    out = {
        "text_tokens": f"SELECT doc_index, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS n_all, len({_sql_tokens('text')})::INT AS n_content, len({toks('text')})::INT AS n_distinct FROM corpus",
        "text_sentences": f"WITH s AS (SELECT doc_index, {_sql_sentences('text')} AS s FROM corpus) SELECT doc_index, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM s",
        "text_numbers": f"WITH {cl} SELECT ord, claim_index::INT AS claim_index, array_to_string(list_sort({_sql_numbers('text')}), ',') AS numbers, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t IN ({_NEG}))) > 0 AS negated FROM cl",
        "text_markers": f"SELECT ord, array_to_string({_sql_markers('answer_text')}, ',') AS markers, {_sql_bare('answer_text')} AS bare FROM answers WHERE answer_text IS NOT NULL",
        "text_normalised": f"SELECT ord, {_sql_norm('coalesce(answer_text, ' + chr(39) * 2 + ')')} AS normalised FROM answers",
        "content_ids": f"WITH c AS (SELECT ord, unnest(citations) AS c, unnest(range(len(citations)))::INT AS pos FROM answers) SELECT ord, pos, 'c_' || left(sha1(coalesce(c.url, '') || '|' || {_sql_strip('coalesce(c.snippet, ' + chr(39) * 2 + ')')}), 12) AS citation_id FROM c",
        "ingest_clean": f"""
          WITH a AS (SELECT doc_id, regexp_split_to_array(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '{lines}') AS l FROM documents),
          b AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: lower(regexp_replace({_sql_strip('x')}, ':+$', '')) IN ({footers})), true) AS f FROM a),
          c AS (SELECT doc_id, list_filter(list_transform(CASE WHEN f > 0 THEN l[1 : f - 1] ELSE l END, lambda x: {_sql_strip("regexp_replace(x, '(?i)[[]\\s*(?:[0-9]+|citation needed|clarification needed|sic)\\s*[]]', '', 'g')")}), lambda x: len(x) >= 25 AND NOT regexp_matches(lower(x), '^(?:{furniture})')) AS k FROM b),
          d AS (SELECT doc_id, {_sql_strip(f"regexp_replace(array_to_string(k, ' '), '{_WS}+', ' ', 'g')")} AS text FROM c)
          SELECT doc_id, text, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::INT AS n_words, len(list_filter(string_split(text, ' '), lambda x: x <> '')) < 60 AS thin FROM d""",
        "ingest_near_pairs": f"""
          WITH s AS (SELECT min(doc_index) AS d, t FROM (SELECT doc_index, list_sort({toks('text')}) AS t FROM corpus) WHERE len(t) > 0 GROUP BY t),
          x AS (SELECT d, len(t) AS n, unnest(t) AS k FROM s),
          p AS (SELECT a.d AS a, b.d AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM x a JOIN x b USING (k) WHERE a.d < b.d GROUP BY 1, 2)
          SELECT a AS doc_index_a, b AS doc_index_b FROM p WHERE common >= 0.8 * (na + nb - common) - 1e-9""",
        "ingest_near_members": f"""
          WITH s AS (SELECT doc_index, list_distinct({_sql_tokens('text')}) AS t FROM corpus), x AS (SELECT doc_index AS d, len(t) AS n, unnest(t) AS k FROM s),
          p AS (SELECT a.d AS a, b.d AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM x a JOIN x b USING (k) WHERE a.d <> b.d GROUP BY 1, 2),
          l AS (SELECT a, count(*) AS n_links, min(b) FILTER (common = na AND common = nb) AS same FROM p WHERE common >= 0.8 * (na + nb - common) - 1e-9 GROUP BY 1)
          SELECT doc_index, least(doc_index, coalesce(same, doc_index)) AS class_index, coalesce(n_links, 0) AS n_links FROM s LEFT JOIN l ON a = doc_index""",
        "chunk_windows": f"WITH {chunks} SELECT chunk_words, doc_index, chunk_index::INT AS chunk_index, text FROM ch",
        "bm25_index": f"WITH RECURSIVE {packed(90)} SELECT term, df, n, round(avg_len, 6) AS avg_len FROM df CROSS JOIN st",
        "bm25_search": f"{hits(qs20, 90)} {shown}",
        "search_all": f"{hits(qs + ', ' + every, 90)} {shown}",
        "bm25_sweep": f"{hits(qs20, 60, 90, 250)} {shown}",
        "bm25_unanswerable": f"{lost(qs20)} SELECT * FROM u",
        "chunk_packed": f"WITH RECURSIVE {checks.packed_chunks([60, 90])} SELECT chunk_words, doc_index, chunk_index::INT AS chunk_index, text FROM ch",
        "engine_extractive": checks.extractive(qs20, checks.packed_chunks([90])),
        "engine_lossy": checks.lossy(qs20, checks.packed_chunks([90])),
        "engine_model": checks.model(qs20, checks.packed_chunks([90])),
        "engine_scripted": checks.scripted(qs),
        "source_questions": "SELECT id, text, coalesce(domain, 'general') AS domain, coalesce(notes, '') AS notes, array_to_string(coalesce(failure_modes, []), '|') AS failure_modes, array_to_string(coalesce(aspects, []), '|') AS aspects FROM questions",
        "source_answers": """SELECT question_id, engine, answer_text, latency_s, error, array_to_string(list_transform(claims, lambda c: concat_ws('|', c.id, c.question_id, c.text, array_to_string(c.citation_ids, ','))), ';') AS claims,
          array_to_string(list_transform(citations, lambda c: concat_ws('|', c.id, c.url, c.snippet, c.title)), ';') AS citations FROM answers""",
        "source_corpus": "SELECT url, coalesce(title, '') AS title, text FROM corpus",
        "source_pages": "SELECT url, title, text AS raw FROM documents",
        "source_labels": f"WITH {labels} SELECT claim_id, verdict, labeler, coalesce(rationale, '') AS rationale FROM l",
        "source_label_store": f"WITH {labels} SELECT claim_id, verdict, labeler, coalesce(rationale, '') AS rationale FROM l WHERE labeler <> 'judge:lexical' UNION ALL SELECT DISTINCT claim_id, 'partial', 'judge:imported', 'r' FROM sample_batch1",
        "claims_decomposed": f"""
          WITH a AS (SELECT ord, engine, question_id, coalesce(answer_text, '') AS t, list_transform(coalesce(citations, []), lambda c: 'c_' || left(sha1(coalesce(c.url, '') || '|' || {_sql_strip('coalesce(c.snippet, ' + chr(39) * 2 + ')')}), 12)) AS ids FROM answers),
          s AS (SELECT ord, engine, question_id, ids, unnest(list_filter(list_transform({_sql_sentences('t')}, lambda s: struct_pack(s := s, b := {_sql_bare('s')})), lambda x: x.b <> '')) AS x, generate_subscripts(list_filter({_sql_sentences('t')}, lambda s: {_sql_bare('s')} <> ''), 1) - 1 AS i FROM a),
          k AS (SELECT ord, engine, question_id, x.b AS text, i, list_transform(list_filter({_sql_markers('x.s')}, lambda n: n BETWEEN 1 AND len(ids)), lambda n: ids[n]) AS c FROM s)
          SELECT ord, i::INT AS claim_index, 'cl_' || left(sha1(coalesce(engine, '') || '|' || coalesce(question_id, '') || '|' || i || '|' || text), 12) AS claim_id, text, array_to_string(list_filter(c, lambda v, n: list_position(c, v) = n), ',') AS citation_ids FROM k""",
        "claims_with_snippets": f"WITH {cl} SELECT ord, claim_index::INT AS claim_index, claim_id, len(ids)::INT AS n_ids, array_to_string({snippets}, '|') AS snippets FROM cl",
        "judge_lexical": f"""
          WITH {cl}, f AS (SELECT ord, claim_index, claim_id, text, ids, {snippets} AS sn, {toks('text')} AS tk FROM cl),
          o AS (SELECT *, list_transform(sn, lambda s: coalesce(len(list_intersect(tk, {toks('s')})) / nullif(len(tk), 0), 0)) AS ov FROM f),
          b AS (SELECT *, coalesce(list_max(ov), 0) AS best, CASE WHEN coalesce(list_max(ov), 0) > 0 THEN sn[list_position(ov, list_max(ov))] ELSE '' END AS bs, {_sql_numbers('text')} AS cn, {_sql_numbers("array_to_string(sn, ' ')")} AS nn FROM o),
          g AS (SELECT *, len(list_filter(cn, lambda n: NOT list_contains(nn, n))) > 0 AS lost, (len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t IN ({_NEG}))) > 0) <> (len(list_filter(regexp_extract_all(lower(bs), '[a-z0-9]+'), lambda t: t IN ({_NEG}))) > 0) AS flip FROM b)
          SELECT ord, claim_index::INT AS claim_index, claim_id, CASE WHEN len(ids) = 0 OR len(sn) = 0 THEN 'uncited' WHEN len(tk) = 0 THEN 'partial'
            WHEN lost THEN CASE WHEN best >= 0.4 AND len(nn) > 0 THEN 'contradicted' ELSE 'unsupported' END WHEN flip THEN 'partial' WHEN best >= 0.75 THEN 'supported' WHEN best >= 0.4 THEN 'partial' ELSE 'unsupported' END AS verdict,
            CASE WHEN len(ids) > 0 AND len(sn) > 0 AND len(tk) > 0 THEN round(best, 6) END AS overlap FROM g""",
        "judge_pending": f"WITH {cl}, {labels} SELECT DISTINCT claim_id FROM cl WHERE claim_id NOT IN (SELECT claim_id FROM l WHERE labeler = 'judge:lexical')",
        "score_faithfulness": f"WITH {labels} SELECT labeler, {scores} FROM l GROUP BY 1",
        "score_leaderboard": f"WITH {cl}, {labels}, s AS (SELECT labeler, engine, {scores} FROM l JOIN e USING (claim_id) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY labeler ORDER BY strict DESC, engine)::INT AS place FROM s",
        "score_failure_modes": f"WITH {cl}, {labels}, {qs}, f AS (SELECT engine, verdict, unnest(failure_modes) AS mode FROM l JOIN e USING (claim_id) JOIN q ON q.id = question_id) SELECT engine, mode, {scores} FROM f GROUP BY 1, 2",
        "score_verdict_mix": f"WITH {cl}, {labels} SELECT engine, {mix} FROM l JOIN e USING (claim_id) GROUP BY 1",
        "score_confusion": f"WITH {labels}, {kinds} SELECT * FROM c",
        "score_kappa": f"""WITH {labels}, {kinds}, t AS (SELECT sum(n) AS n, sum(n) FILTER (human = judge) AS same FROM c),
          x AS (SELECT sum(h * j) AS hj FROM (SELECT human AS v, sum(n) AS h FROM c GROUP BY 1) JOIN (SELECT judge AS v, sum(n) AS j FROM c GROUP BY 1) USING (v))
          SELECT n::BIGINT AS n, round(same / n, 6)::DOUBLE AS accuracy, round((same / n - hj / (n * n)) / (1 - hj / (n * n)), 6)::DOUBLE AS kappa FROM t, x""",
        "score_precision_recall": f"""WITH {labels}, {kinds}, v AS (SELECT unnest([{_VALID}]) AS verdict)
          SELECT verdict, round(coalesce(sum(n) FILTER (human = verdict AND judge = verdict) / nullif(sum(n) FILTER (judge = verdict), 0), 0), 6)::DOUBLE AS precision,
            round(coalesce(sum(n) FILTER (human = verdict AND judge = verdict) / nullif(sum(n) FILTER (human = verdict), 0), 0), 6)::DOUBLE AS recall,
            coalesce(sum(n) FILTER (human = verdict), 0)::BIGINT AS n_human, coalesce(sum(n) FILTER (judge = verdict), 0)::BIGINT AS n_judge FROM v, c GROUP BY 1""",
        "score_detection": f"""WITH {labels}, o AS (SELECT claim_id, substr(labeler, 8) AS fault, verdict AS truth FROM l WHERE labeler LIKE 'oracle:%'),
          j AS (SELECT claim_id, labeler, arg_max(verdict, ord) AS verdict FROM l WHERE labeler NOT LIKE 'human%' AND labeler NOT LIKE 'oracle:%' GROUP BY 1, 2)
          SELECT labeler, fault, count(*) AS n, count(*) FILTER (truth = verdict) AS n_detected, round(count(*) FILTER (truth = verdict) / count(*), 6) AS rate, {said} FROM o JOIN j USING (claim_id) GROUP BY 1, 2""",
        "score_disagreements": f"WITH {cl}, {labels}, {kinds}, tx AS (SELECT claim_id, arg_max(text, struct_pack(ord := ord, i := claim_index)) AS text FROM cl GROUP BY 1) SELECT claim_id, human, judge, coalesce(text, '') AS text FROM h JOIN j USING (claim_id) LEFT JOIN tx USING (claim_id) WHERE human <> judge ORDER BY claim_id LIMIT 20",
        "score_totals": f"""WITH {cl}, {labels}, {qs} SELECT (SELECT count(*) FROM q) AS questions, (SELECT count(*) FROM answers) AS runs, (SELECT count(DISTINCT claim_id) FROM cl) AS claims,
          count(*) AS labels, count(*) FILTER (labeler LIKE 'human%') AS human_labels, count(DISTINCT labeler) FILTER (labeler NOT LIKE 'human%' AND labeler NOT LIKE 'oracle:%') AS judges FROM l""",
        "score_labels_needed": "SELECT h::DOUBLE AS half_width, (floor(1.96::DOUBLE * 1.96::DOUBLE * 0.5::DOUBLE * 0.5::DOUBLE / (h::DOUBLE * h::DOUBLE)) + 1)::INT AS needed FROM (SELECT unnest([0.1, 0.07, 0.05]) AS h)",
        "completeness_scores": f"WITH {comp} SELECT ord, n_aspects::INT AS n_aspects, (n_aspects - len(missed_list))::INT AS n_covered, array_to_string(missed_list, '|') AS missed, round((n_aspects - len(missed_list)) / n_aspects, 6) AS fraction FROM s",
        "completeness_by_engine": f"WITH {comp} SELECT engine, count(*) AS n, round(avg((n_aspects - len(missed_list)) / n_aspects), 6) AS macro, round(sum(n_aspects - len(missed_list)) / sum(n_aspects), 6)::DOUBLE AS micro FROM s GROUP BY 1",
        "completeness_most_missed": f"WITH {comp}, x AS (SELECT unnest(missed_list) AS aspect FROM s) SELECT aspect, count(*) AS n FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "validate_duplicates": "SELECT url, count(*) AS n FROM corpus GROUP BY 1 HAVING count(*) > 1 AND url IS NOT NULL",
        "validate_modes": f"WITH {qs} SELECT mode, count(*) AS n, count(*) < 3 AS thin FROM (SELECT unnest(failure_modes) AS mode FROM q) GROUP BY 1",
        "labels_replaced": f"""WITH {labels} SELECT claim_id, labeler, verdict, coalesce(rationale, '') AS rationale FROM l WHERE labeler <> 'judge:imported' UNION ALL SELECT DISTINCT claim_id, 'judge:imported', 'supported', left(coalesce(claim, ''), 400) FROM sample_batch1""",
    }
    judged = out["judge_lexical"].replace("SELECT ord, claim_index::INT AS claim_index, claim_id,", "SELECT ord, claim_index, claim_id, text, ids, sn, tk,")
    anyone = f"WITH jl AS ({judged}), {labels}"
    out["judge_incremental"] = f"{anyone} SELECT claim_id, labeler, verdict FROM l UNION ALL SELECT claim_id, 'judge:lexical', verdict FROM jl WHERE claim_id NOT IN (SELECT claim_id FROM l WHERE labeler = 'judge:lexical')"
    prompt = "'Claim: ' || text || chr(10) || chr(10) || 'Sources:' || chr(10) || array_to_string(list_transform(sn, lambda x, i: '[' || i || '] ' || left(x, 4000)), chr(10))"
    out["judge_model"] = f"""{anyone}, p AS (SELECT claim_id, len(ids) = 0 OR len(sn) = 0 AS none, len({prompt}) % 2 = 1 AS odd FROM jl)
      SELECT claim_id, 'judge:llm' AS labeler, CASE WHEN none THEN 'uncited' WHEN odd THEN 'supported' ELSE 'partial' END AS verdict,
        CASE WHEN none THEN 'claim carried no resolvable citation' WHEN odd THEN 'r' ELSE 'unparseable judge response: none' END AS rationale FROM p"""
    amb = "CASE WHEN overlap IS NULL THEN 0.0 ELSE round(greatest(0.0, 1 - least(abs(overlap_ - 0.40), abs(overlap_ - 0.75)) / 0.5), 6) END::DOUBLE"
    exact = judged.replace("THEN round(best, 6) END AS overlap", "THEN round(best, 6) END AS overlap, best AS overlap_")
    out["queue_prioritised"] = f"""WITH jl AS ({exact}), {labels}, {qs},
      k AS (SELECT claim_id, ord, claim_index, {amb} AS ambiguity, claim_id IN (SELECT claim_id FROM l WHERE labeler LIKE 'oracle:%') AS known FROM jl WHERE claim_id NOT IN (SELECT claim_id FROM l WHERE labeler = 'human:krinpell31')),
      x AS (SELECT k.*, coalesce(list_min(failure_modes), 'unknown') AS mode FROM k JOIN (SELECT ord, any_value(question_id) AS question_id FROM answers GROUP BY 1) a USING (ord) LEFT JOIN q ON q.id = question_id),
      c AS (SELECT floor(count(*) FILTER (NOT known) * 0.35::DOUBLE / (1 - 0.35::DOUBLE)) AS cap, count(*) FILTER (NOT known) AS unknown FROM x),
      y AS (SELECT x.*, row_number() OVER (PARTITION BY known ORDER BY x.ord, claim_index, claim_id) AS place FROM x), z AS (SELECT * FROM y, c WHERE NOT known OR unknown = 0 OR place <= cap),
      b AS (SELECT mode, row_number() OVER (ORDER BY count(*) DESC, mode) AS bucket FROM z GROUP BY 1)
      SELECT claim_id, z.mode, ambiguity, known, row_number() OVER (PARTITION BY z.mode ORDER BY ambiguity DESC, known, z.ord, claim_index, claim_id) AS turn, bucket::INT AS bucket FROM z JOIN b USING (mode)"""
    out["queue_sample"] = f"""WITH {cl}, {labels}, {qs},
      x AS (SELECT claim_id, cl.ord, claim_index, engine, q.text AS question, cl.text AS claim, CASE WHEN contains(engine, '+') THEN 'faulty' ELSE 'clean' END AS family, failure_modes[1] AS mode FROM cl JOIN q ON q.id = question_id),
      y AS (SELECT *, row_number() OVER (PARTITION BY family, mode ORDER BY md5('0|' || claim_id || '|' || ord), claim_index) AS r, (SELECT count(*) FROM (SELECT DISTINCT family, mode FROM x)) AS strata FROM x)
      SELECT claim_id, engine, question, claim, claim_id IN (SELECT claim_id FROM l WHERE labeler LIKE 'oracle:%') AS has_oracle FROM y WHERE r <= greatest(1, 60 // strata) ORDER BY md5('1|' || claim_id || '|' || ord), claim_index LIMIT 60"""
    # greedy choice in order: a set is dropped if an earlier kept one is near
    greedy = lambda rows: f"""{rows}, xs AS (SELECT o AS d, len(t) AS n, unnest(t) AS k FROM sets),
      pr AS (SELECT a.d AS a, b.d AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM xs a JOIN xs b USING (k) WHERE a.d < b.d GROUP BY 1, 2),
      nb AS MATERIALIZED (SELECT b AS o, list(a) AS early FROM pr WHERE common >= 0.8 * (na + nb - common) - 1e-9 GROUP BY 1),
      steps AS MATERIALIZED (SELECT sets.o, row_number() OVER (ORDER BY sets.o) AS i, coalesce(early, []) AS early FROM sets LEFT JOIN nb USING (o)),
      gr AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS dropped UNION ALL SELECT s.i, CASE WHEN len(list_filter(early, lambda e: NOT list_contains(dropped, e))) > 0 THEN list_append(dropped, s.o) ELSE dropped END FROM gr JOIN steps s ON s.i = gr.i + 1),
      dr AS (SELECT unnest(dropped) AS o FROM (SELECT dropped FROM gr ORDER BY i DESC LIMIT 1))"""  # noqa: E731
    out["ingest_deduplicated"] = f"WITH RECURSIVE {greedy(f'sets AS (SELECT doc_index AS o, {toks(chr(116) + chr(101) + chr(120) + chr(116))} AS t FROM corpus)')} SELECT doc_index, doc_index NOT IN (SELECT o FROM dr) AS kept FROM corpus"
    clean = f"cleaned AS ({out['ingest_clean']})"
    rich = f"{clean}, sets AS (SELECT doc_id AS o, {toks('text')} AS t FROM cleaned WHERE NOT thin)"
    out["ingest_pipeline"] = f"WITH RECURSIVE {greedy(rich)} SELECT doc_id, n_words, CASE WHEN thin THEN 'thin' WHEN doc_id IN (SELECT o FROM dr) THEN 'duplicate' END AS drop_reason FROM cleaned"
    doc_words = f"len({checks.words('text')})"
    out["validate_problems"] = f"""{lost(qs + ', ' + every)},
      m AS (SELECT mode, count(*) AS n FROM (SELECT unnest(failure_modes) AS mode FROM questions) GROUP BY 1), na AS (SELECT count(*) FILTER (coalesce(len(aspects), 0) = 0) AS none, count(*) AS n FROM q)
      SELECT 'duplicate question id' AS kind, id AS key, count(*)::VARCHAR AS detail FROM questions GROUP BY id HAVING count(*) > 1 AND id IS NOT NULL
      UNION ALL SELECT 'duplicate corpus url', url, count(*)::VARCHAR FROM corpus GROUP BY url HAVING count(*) > 1 AND url IS NOT NULL
      UNION ALL SELECT 'short document', doc_index::VARCHAR, {doc_words}::VARCHAR FROM corpus WHERE {doc_words} < 20
      UNION ALL SELECT 'thin failure mode', mode, n::VARCHAR FROM m WHERE n < 3 UNION ALL SELECT 'questions without aspects', 'aspects', none::VARCHAR FROM na WHERE none > 0 AND none < n
      UNION ALL SELECT 'unanswerable question', qid, best::VARCHAR FROM u"""
    return out | {f"fault_{n.replace('-', '_')}": checks.fault(n) for n in faults.FAULTS}

"""The catalog's results as SQL for an independent engine (DuckDB dialect)."""

from __future__ import annotations

from assay.functions.text import TERM
from assay.lexicons import HEDGE_WORDS, KEPT_WORDS, LABEL_CLASS, VAGUE_WORDS
from assay.plans import views as v
from assay.plans.catalog import LABEL_NAMES, LETTERS
from assay.sources.claims import RAW_COUNTS

ORACLE: dict[str, str] = {}

# White space spelled out for an engine whose classes know ASCII only.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# --- Building blocks ---------------------------------------------------------------------------


def lit(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return "[" + ", ".join(lit(x) for x in values) + "]"


def rows(values) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in values) + ")"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TERM}')"


def uniform(*key) -> str:
    parts = ", ".join(f"({k})::VARCHAR" for k in key)
    return f"((('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::UBIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def draw(pos: str, *key) -> str:
    """The draw at position ``pos``: four 32-bit numbers per digest."""
    parts = ", ".join(f"({k})::VARCHAR" for k in (*key, f"({pos}) // 4"))
    return f"((('0x' || substr(md5(concat_ws('|', {parts})), (1 + 8 * (({pos}) % 4))::INTEGER, 8))::UBIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def digest(*key) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"({k})::VARCHAR" for k in key) + "))"


def chunks(x: str) -> str:
    """List of 100-word passages; an empty list for blank text."""
    return (
        f"CASE WHEN len({words(x)}) = 0 THEN [] ELSE list_transform(range(0, len({words(x)}), 100), "
        f"lambda o: array_to_string(list_slice({words(x)}, o + 1, o + 100), ' ')) END"
    )


_u_split = uniform("'fixture_split'", "claim_id")
CLAIMS = f"""
claims AS (
  SELECT *, CASE WHEN {_u_split} < 0.8::DOUBLE THEN 'train' WHEN {_u_split} < 0.9::DOUBLE THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT d.doc_id AS claim_id, d.text AS claim, d.source AS speaker, d.lang AS subject, l.quality AS label
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
),
labelled AS (SELECT * FROM claims WHERE label IS NOT NULL)"""
SHORT = """
short_claims AS (
  SELECT conv_id * 1000 + turn AS claim_id, text AS claim, role AS speaker, NULL::VARCHAR AS subject FROM conversations
)"""
OWN_EVIDENCE = f"own_kept AS (SELECT claim_id, {chunks('claim')} AS passages FROM claims)"


# --- Uncertainty -------------------------------------------------------------------------------


def scored(source: str, hedge, vague, k_min=1, k_max=5, name="scored") -> str:
    def lexicon(words_listed):
        return f"least(len(list_intersect(list_distinct({words('lower(claim)')}), {names(words_listed)})) / 2.0::DOUBLE, 1.0::DOUBLE)"

    word = r"[^\p{L}\p{N}_]"
    return f"""
features AS (
  SELECT *,
    len({words('claim')})::INTEGER AS n_words,
    least(len({words('claim')}) / 25.0::DOUBLE, 1.0::DOUBLE) AS length_score,
    ((regexp_matches(claim, '(^|{word})\\p{{Nd}}+($|{word})'))::INTEGER::DOUBLE
      + (regexp_matches(claim, '\\p{{Nd}}+{SPACE}*%'))::INTEGER::DOUBLE
      + (regexp_matches(claim, '\\${SPACE}*\\p{{Nd}}'))::INTEGER::DOUBLE) / 3.0::DOUBLE AS specificity,
    {lexicon(hedge)} AS hedge_score,
    least(len(list_filter({words('claim')}, lambda w, i: i > 1 AND regexp_matches(w, '^\\p{{Lu}}\\p{{L}}*$'))) / 4.0::DOUBLE, 1.0::DOUBLE) AS entity_score,
    {lexicon(vague)} AS vague_score,
    CASE WHEN len({words('claim')}) < 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS short_penalty
  FROM {source}
),
weighted AS (
  SELECT *, least(greatest(
    0.2::DOUBLE * length_score + 0.25::DOUBLE * (1.0::DOUBLE - specificity) + 0.15::DOUBLE * hedge_score
    + 0.15::DOUBLE * (1.0::DOUBLE - entity_score) + 0.15::DOUBLE * vague_score + 0.1::DOUBLE * short_penalty,
    0.0::DOUBLE), 1.0::DOUBLE) AS uncertainty FROM features
),
{name} AS (
  SELECT *, least(greatest(CASE WHEN uncertainty < 0.2::DOUBLE THEN 1 WHEN uncertainty < 0.35::DOUBLE THEN 2
    WHEN uncertainty < 0.5::DOUBLE THEN 3 WHEN uncertainty < 0.65::DOUBLE THEN 4 ELSE 5 END, {k_min}), {k_max})::INTEGER AS k
  FROM weighted
)"""


_FEATURE_LIST = "claim_id, n_words, length_score, specificity, hedge_score, entity_score, vague_score, short_penalty, uncertainty, k"
ORACLE["uncertainty_features"] = f"WITH {CLAIMS}, {scored('claims', v.HEDGE, v.VAGUE)} SELECT {_FEATURE_LIST} FROM scored"
ORACLE["uncertainty_builtin_words"] = (
    f"WITH {SHORT}, {scored('short_claims', HEDGE_WORDS, VAGUE_WORDS)} SELECT {_FEATURE_LIST} FROM scored"
)
ORACLE["adaptive_k"] = (
    f"WITH {SHORT}, {scored('short_claims', v.HEDGE, v.VAGUE, 2, 4)} SELECT claim_id, uncertainty, k FROM scored"
)
ORACLE["k_distribution"] = f"""WITH {CLAIMS}, {scored('claims', v.HEDGE, v.VAGUE)}
SELECT k, count(*) AS n_claims, round(count(*) / (SELECT count(*) FROM scored)::DOUBLE, 6) AS share,
  (SELECT count(DISTINCT k) FROM scored)::INTEGER AS distinct_k FROM scored GROUP BY k"""
ORACLE["stream_scores"] = (
    f"WITH {SHORT}, {scored('short_claims', v.HEDGE, v.VAGUE)} SELECT claim_id, uncertainty, k FROM scored"
)


# --- Retrieval ---------------------------------------------------------------------------------


def queries_of(source: str, name: str = "queries") -> str:
    content = f"list_filter({terms('claim')}, lambda t: NOT list_contains({names(v.STOPWORDS)}, t))"
    return f"""
{name}_tokens AS (SELECT claim_id, unnest({content}) AS term, generate_subscripts({content}, 1) AS pos FROM {source}),
{name}_counts AS (SELECT claim_id, term, count(*) AS n, min(pos) AS first_pos FROM {name}_tokens GROUP BY ALL),
{name}_top AS (
  SELECT claim_id, string_agg(term, ' ' ORDER BY first_pos) AS picked FROM (
    SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, term) AS r FROM {name}_counts) WHERE r <= 5 GROUP BY claim_id
),
{name} AS (
  SELECT c.claim_id, c.claim, CASE WHEN len({words('c.claim')}) <= 5 THEN c.claim
    ELSE coalesce(t.picked, array_to_string(list_slice({words('c.claim')}, 1, 5), ' ')) END AS query
  FROM {source} c LEFT JOIN {name}_top t ON c.claim_id = t.claim_id
)"""


def index_of(source: str) -> str:
    return f"""
index AS (
  SELECT term, page_id, count(*) AS tf FROM (SELECT page_id, unnest({terms('extract')}) AS term FROM {source}) GROUP BY ALL
)"""


def search(queries: str, name: str) -> str:
    return f"""
{name}_hits AS (
  SELECT q.claim_id, i.page_id, count(*) AS matched, sum(i.tf)::BIGINT AS tf_sum
  FROM (SELECT claim_id, unnest(list_distinct({terms('query')})) AS term FROM {queries}) q JOIN index i ON q.term = i.term
  GROUP BY ALL
),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY matched DESC, tf_sum DESC, page_id)::INTEGER AS page_rank
    FROM {name}_hits) WHERE page_rank <= 10
)"""


def similar(claims: str, candidates: str, pages: str) -> str:
    """All passages of candidate pages with their similarity."""
    return f"""
page_passages AS (
  SELECT page_id, unnest(list) AS text, (generate_subscripts(list, 1) - 1)::INTEGER AS chunk_no
  FROM (SELECT page_id, {chunks('extract')} AS list FROM {pages} WHERE page_id IN (SELECT page_id FROM {candidates}))
),
passage_terms AS (
  SELECT page_id, chunk_no, term, count(*) AS n FROM (SELECT page_id, chunk_no, unnest({terms('text')}) AS term FROM page_passages) GROUP BY ALL
),
passage_norms AS (SELECT page_id, chunk_no, sum(n * n)::BIGINT AS norm2 FROM passage_terms GROUP BY ALL),
claim_terms AS (
  SELECT claim_id, term, count(*) AS n FROM (SELECT claim_id, unnest({terms('claim')}) AS term FROM {claims}) GROUP BY ALL
),
claim_norms AS (SELECT claim_id, sum(n * n)::BIGINT AS norm2 FROM claim_terms GROUP BY ALL),
dots AS (
  SELECT c.claim_id, c.page_id, p.chunk_no, sum(t.n * p.n)::BIGINT AS dot
  FROM {candidates} c JOIN passage_terms p ON c.page_id = p.page_id JOIN claim_terms t ON t.claim_id = c.claim_id AND t.term = p.term
  GROUP BY ALL
),
compared AS (
  SELECT c.claim_id, c.page_id, c.page_rank, g.chunk_no, g.text,
    CASE WHEN a.norm2 * b.norm2 > 0 AND d.dot IS NOT NULL THEN d.dot / sqrt((a.norm2 * b.norm2)::DOUBLE) ELSE 0.0::DOUBLE END AS similarity
  FROM {candidates} c JOIN page_passages g ON c.page_id = g.page_id
  LEFT JOIN claim_norms a ON a.claim_id = c.claim_id
  LEFT JOIN passage_norms b ON b.page_id = g.page_id AND b.chunk_no = g.chunk_no
  LEFT JOIN dots d ON d.claim_id = c.claim_id AND d.page_id = c.page_id AND d.chunk_no = g.chunk_no
)"""


PROBES = "probes AS (SELECT item_id AS claim_id, text AS claim FROM benchmark)"
CORPUS = "corpus AS (SELECT doc_id AS page_id, text AS extract FROM documents)"
_PROBE_SEARCH = f"{PROBES}, {CORPUS}, {queries_of('probes')}, {index_of('corpus')}, {search('queries', 'candidates')}"

ORACLE["keyword_query"] = f"WITH {CLAIMS}, {queries_of('claims')} SELECT claim_id, query FROM queries"
ORACLE["corpus_index"] = f"WITH {CORPUS}, {index_of('corpus')} SELECT term, page_id, tf FROM index"
for _name in ("candidate_pages", "candidate_pages_hot_terms", "candidate_pages_stored_index", "candidate_pages_blocks"):
    ORACLE[_name] = f"WITH {_PROBE_SEARCH} SELECT claim_id, page_id, matched, tf_sum, page_rank FROM candidates"
ORACLE["chunk_passages"] = f"""WITH {CORPUS}
SELECT page_id, (generate_subscripts(list, 1) - 1)::INTEGER AS chunk_no, unnest(list) AS text
FROM (SELECT page_id, {chunks('extract')} AS list FROM corpus)"""
ORACLE["similarity_filter"] = f"""WITH {_PROBE_SEARCH}, {similar('probes', 'candidates', 'corpus')}
SELECT claim_id, page_id, page_rank, chunk_no, round(similarity, 6) AS similarity FROM compared WHERE similarity >= 0.25::DOUBLE"""
ORACLE["adaptive_topk_evidence"] = f"""WITH {_PROBE_SEARCH}, {similar('probes', 'candidates', 'corpus')}, {scored('probes', v.HEDGE, v.VAGUE)},
ranked AS (SELECT c.*, s.k, row_number() OVER (PARTITION BY c.claim_id ORDER BY page_rank, chunk_no)::INTEGER AS rank
  FROM compared c JOIN scored s ON c.claim_id = s.claim_id WHERE similarity >= 0.25::DOUBLE)
SELECT claim_id, rank, page_id, chunk_no, text FROM ranked WHERE rank <= k"""


def evidence_rows(source: str, pages: str, compared=similar, threshold: str = "0.25") -> str:
    """The whole evidence build, with the second search for claims without a hit."""
    return f"""
{queries_of(source)}, {index_of(pages)}, {search('queries', 'first_found')},
again AS (SELECT claim_id, substr(claim, 1, 100) AS query FROM {source} WHERE claim_id NOT IN (SELECT claim_id FROM first_found)),
{search('again', 'second_found')},
found AS (SELECT * FROM first_found UNION ALL SELECT * FROM second_found),
{compared(source, 'found', pages)}, {scored(source, v.HEDGE, v.VAGUE)},
kept AS (
  SELECT c.claim_id, text, row_number() OVER (PARTITION BY c.claim_id ORDER BY page_rank, chunk_no) AS r
  FROM compared c WHERE similarity >= {threshold}::DOUBLE
),
counts AS (
  SELECT claim_id, count(DISTINCT page_id) AS n_candidates, count(*) AS n_passages FROM compared GROUP BY claim_id
),
texts AS (
  SELECT s.claim_id, list(t.text ORDER BY t.r) AS passages FROM scored s JOIN kept t ON s.claim_id = t.claim_id AND t.r <= s.k GROUP BY s.claim_id
),
evidence AS (
  SELECT s.claim_id, s.k AS k_used, coalesce(n.n_candidates, 0) AS n_candidates, coalesce(n.n_passages, 0) AS n_passages,
    coalesce(len(t.passages), 0)::INTEGER AS n_kept, s.claim_id IN (SELECT claim_id FROM again) AS used_fallback,
    coalesce(t.passages, []) AS passages
  FROM scored s LEFT JOIN counts n ON s.claim_id = n.claim_id LEFT JOIN texts t ON s.claim_id = t.claim_id
)"""


_FLAT = """SELECT claim_id, k_used, n_candidates, n_passages, n_kept, used_fallback,
  md5(coalesce(array_to_string(passages, ' [SEP] '), '')) AS evidence_md5 FROM evidence"""
ORACLE["evidence_build"] = f"WITH {SHORT}, {CORPUS}, {evidence_rows('short_claims', 'corpus')} {_FLAT}"


def letter_counts(x: str) -> str:
    return "[" + ", ".join(f"(length({x}) - length(translate({x}, '{c}{c.upper()}', '')))::DOUBLE" for c in LETTERS) + "]"


def dense_similar(claims: str, candidates: str, pages: str) -> str:
    """All passages of candidate pages with the cosine of their letter counts to the claim's."""
    return f"""
page_passages AS (
  SELECT *, {letter_counts('text')} AS vec FROM (
    SELECT page_id, unnest(list) AS text, (generate_subscripts(list, 1) - 1)::INTEGER AS chunk_no
    FROM (SELECT page_id, {chunks('extract')} AS list FROM {pages} WHERE page_id IN (SELECT page_id FROM {candidates})))
),
claim_vectors AS (SELECT claim_id, {letter_counts('claim')} AS vec FROM {claims}),
scales AS (
  SELECT c.claim_id, c.page_id, c.page_rank, g.chunk_no, g.text, list_inner_product(a.vec, g.vec) AS dot,
    sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(g.vec, g.vec)) AS scale
  FROM {candidates} c JOIN page_passages g ON c.page_id = g.page_id JOIN claim_vectors a ON a.claim_id = c.claim_id
),
compared AS (SELECT *, CASE WHEN scale > 0 THEN dot / scale ELSE 0.0::DOUBLE END AS similarity FROM scales)"""


ORACLE["dense_evidence"] = f"WITH {PROBES}, {CORPUS}, {evidence_rows('probes', 'corpus', dense_similar, '0.97')} {_FLAT}"
ORACLE["evidence_build_resumed"] = ORACLE["evidence_build"]
ORACLE["fallback_retrieval"] = f"""WITH {CLAIMS}, small AS (SELECT item_id AS page_id, text AS extract FROM benchmark),
{evidence_rows('claims', 'small')} {_FLAT}"""
ORACLE["retrieval_fill_rate"] = f"""WITH {PROBES}, {CORPUS}, {evidence_rows('probes', 'corpus')}
SELECT k_used, count(*) AS n_claims, count(*) FILTER (n_kept > 0) AS n_filled,
  round(avg((n_kept > 0)::INTEGER::DOUBLE), 6) AS fill_rate FROM evidence GROUP BY k_used"""
ORACLE["stream_evidence"] = f"WITH {PROBES}, {CORPUS}, {evidence_rows('probes', 'corpus')} {_FLAT}"


# --- Evidence tables ---------------------------------------------------------------------------

ORACLE["evidence_resume"] = """SELECT d.doc_id AS claim_id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'reused' END AS state,
  length(d.text)::INTEGER AS n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
ORACLE["evidence_lookup_last_wins"] = """WITH last AS (
  SELECT text, arg_max(source || ' [SEP] ' || doc_id, doc_id) AS evidence FROM documents GROUP BY text)
SELECT d.doc_id AS claim_id, l.evidence FROM documents d JOIN last l ON d.text = l.text"""
ORACLE["evidence_alignment"] = f"""WITH {CLAIMS}, {OWN_EVIDENCE}
SELECT c.claim_id, 'table' AS evidence_mode, coalesce(len(e.passages), 0)::INTEGER AS n_passages
FROM claims c LEFT JOIN own_kept e ON c.claim_id = e.claim_id
UNION ALL SELECT claim_id, 'none', 0 FROM claims"""
_FILLED = f"coalesce(len(list_filter(e.passages, lambda p: {strip('p')} <> '')), 0) > 0"
ORACLE["fill_rate"] = f"""WITH {CLAIMS}, {OWN_EVIDENCE}
SELECT split, count(*) AS n_claims, count(*) FILTER ({_FILLED}) AS n_filled, round(avg(({_FILLED})::INTEGER::DOUBLE), 6) AS fill_rate
FROM claims c LEFT JOIN own_kept e ON c.claim_id = e.claim_id GROUP BY split"""
ORACLE["evidence_parse"] = f"""WITH parsed AS (
  SELECT doc_id AS claim_id, list_filter(string_split(replace(text, chr(10), ' [SEP] '), ' [SEP] '), lambda p: {strip('p')} <> '') AS passages FROM documents)
SELECT claim_id, len(passages)::INTEGER AS n_passages, md5(coalesce(array_to_string(passages, ' [SEP] '), '')) AS evidence_md5 FROM parsed"""
ORACLE["evidence_csv_roundtrip"] = f"""WITH {CLAIMS}, {OWN_EVIDENCE}
SELECT claim_id, len(passages)::INTEGER AS k_used, len(passages)::INTEGER AS n_passages,
  md5(coalesce(array_to_string(passages, ' [SEP] '), '')) AS evidence_md5 FROM own_kept"""


# --- Claims ------------------------------------------------------------------------------------

_NAME = f"list_extract({names(LABEL_NAMES)}, (floor({uniform(lit('label'), 'claim_id')} * {len(LABEL_NAMES)}))::INTEGER + 1)"
_COUNTS = ", ".join(
    f"CASE WHEN subject = 'es' THEN NULL ELSE floor({uniform(lit(c), 'claim_id')} * 9)::INTEGER END AS {c}" for c in RAW_COUNTS
)
RAW = f"""
raw AS (
  SELECT split, 'c' || claim_id AS id, {_NAME} AS label_str, regexp_replace(claim, '{SPACE}+', ' ', 'g') AS claim, subject,
    CASE WHEN subject = 'fr' THEN NULL ELSE ' ' || speaker || ' ' END AS speaker, 'party' AS party, {_COUNTS},
    CASE WHEN subject = 'es' THEN NULL ELSE 'context' END AS context
  FROM claims WHERE subject <> 'de'
),
cleaned AS (
  SELECT split, id, label_str, {strip('claim')} AS claim, coalesce({strip('speaker')}, '') AS speaker, subject,
    CASE WHEN label_str IN ({", ".join(lit(n) for n, c in LABEL_CLASS.items() if c)}) THEN 1 ELSE 0 END AS label
  FROM raw WHERE label_str <> 'not-rated'
)"""
ORACLE["raw_claims_scan"] = f"""WITH {CLAIMS}, {RAW}
SELECT id, label_str, subject, speaker, party, {", ".join(RAW_COUNTS)}, context, md5(claim) AS claim_md5 FROM raw"""
ORACLE["load_splits"] = f"""WITH {CLAIMS}, {RAW}
SELECT split, speaker, subject, label, label_str, md5(claim) AS claim_md5 FROM cleaned"""
ORACLE["processed_roundtrip"] = f"""WITH {CLAIMS}, {RAW}
SELECT split, label_str, label, count(*) AS n_rows, sum(length(claim))::BIGINT AS n_chars, count(*) FILTER (speaker = '') AS no_speaker
FROM cleaned GROUP BY ALL"""
_TOTAL = "(" + " + ".join(f"coalesce({c}, 0)" for c in RAW_COUNTS) + ")"
_SHARES = ", ".join(
    f"round(CASE WHEN {_TOTAL} > 0 THEN coalesce({c}, 0) / {_TOTAL}::DOUBLE ELSE 0.0::DOUBLE END, 6) AS {c.replace('_counts', '_share')}"
    for c in RAW_COUNTS
)
ORACLE["speaker_history"] = f"""WITH {CLAIMS}, {RAW}
SELECT id, {_TOTAL}::BIGINT AS history_total, {_SHARES} FROM raw"""
ORACLE["split_stats"] = f"""WITH {CLAIMS}
SELECT split, count(*) AS n_rows, count(*) FILTER (label = 1) AS n_real, count(*) FILTER (label = 0) AS n_fake,
  round(avg((label = 1)::INTEGER::DOUBLE), 6) AS real_share FROM labelled GROUP BY split"""
ORACLE["label_histogram"] = f"""WITH {CLAIMS}
SELECT split, CASE WHEN label = 1 THEN 'true' ELSE 'false' END AS label_str, count(*) AS n_rows FROM labelled GROUP BY ALL"""
ORACLE["clean_text"] = f"""WITH {SHORT}
SELECT claim_id, {strip('speaker')} AS speaker, '' AS subject, CASE WHEN speaker = 'user' THEN 1 ELSE 0 END AS label,
  md5({strip('claim')}) AS claim_md5 FROM short_claims WHERE speaker IN ('user', 'assistant') AND claim IS NOT NULL"""
ORACLE["head_sample"] = f"WITH {CLAIMS} SELECT claim_id, label FROM labelled ORDER BY claim_id LIMIT 50"


# --- Text for models ---------------------------------------------------------------------------


def context(speaker: str, subject: str, claim: str = "claim") -> str:
    def shown(x):
        return f"coalesce(nullif({strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, ''), 'unknown')"

    return f"'[' || {shown(speaker)} || '] [' || {shown(subject)} || '] ' || {claim}"


_CONTEXT = context("speaker", "subject")
ORACLE["context_text"] = f"""WITH {SHORT}
SELECT claim_id, {_CONTEXT} AS context, md5('[' || coalesce(speaker, '') || '] [' || coalesce(subject, '') || '] ' || claim) AS raw_md5,
  md5(claim) AS bare_md5 FROM short_claims"""
ORACLE["model_text"] = f"""WITH {CLAIMS}, {OWN_EVIDENCE},
parts AS (SELECT c.claim_id, {_CONTEXT} AS context, {strip("coalesce(array_to_string(list_slice(e.passages, 1, 3), ' '), '')")} AS three,
  coalesce(e.passages[1], '') AS one FROM claims c LEFT JOIN own_kept e ON c.claim_id = e.claim_id),
texts AS (SELECT claim_id, CASE WHEN three = '' THEN context ELSE context || ' [SEP] ' || three END AS whole,
  CASE WHEN one = '' THEN context ELSE context || ' [SEP] ' || one END AS joined FROM parts)
SELECT claim_id, length(whole)::INTEGER AS n_chars, md5(whole) AS text_md5, md5(joined) AS joined_md5 FROM texts"""


def grams(source: str, high: int, name: str = "grams") -> str:
    """(claim_id, term, tf) of all n-grams up to ``high``."""
    parts = ["SELECT claim_id, unnest(toks) AS term FROM toks_" + name]
    for n in range(2, high + 1):
        joined = " || ' ' || ".join(f"toks[i + {j}]" if j else "toks[i]" for j in range(n))
        parts.append(
            f"SELECT claim_id, unnest(list_transform(range(1, len(toks) - {n} + 2), lambda i: {joined})) AS term FROM toks_{name}"
        )
    return f"""
toks_{name} AS (SELECT claim_id, {terms('text')} AS toks FROM {source}),
{name} AS (SELECT claim_id, term, count(*) AS tf FROM ({" UNION ALL ".join(parts)}) GROUP BY ALL)"""


def tfidf(fit: str, counts: str, n_docs: str, max_terms: int, tf: str) -> str:
    return f"""
vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM {fit} GROUP BY term ORDER BY total DESC, term LIMIT {max_terms}),
raw AS (SELECT g.claim_id, g.term, {tf} * (ln(({n_docs} + 1) / (w.df + 1)::DOUBLE) + 1.0::DOUBLE) AS raw FROM {counts} g JOIN vocab w ON g.term = w.term),
norms AS (SELECT claim_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY claim_id),
weights AS (SELECT r.claim_id, r.term, r.raw / n.norm AS weight FROM raw r JOIN norms n ON r.claim_id = n.claim_id)"""


_SHORT_TEXT = f"{SHORT}, texts AS (SELECT claim_id, {_CONTEXT} AS text FROM short_claims)"
_SHORT_TFIDF = f"{_SHORT_TEXT}, {grams('texts', 3)}, {tfidf('grams', 'grams', '(SELECT count(*) FROM texts)', 15000, 'g.tf')}"
ORACLE["tfidf_terms"] = f"WITH {_SHORT_TFIDF} SELECT claim_id, term, round(weight, 6) AS weight FROM weights"
ORACLE["tfidf_train_only"] = f"""WITH {CLAIMS},
train_texts AS (SELECT claim_id, claim AS text FROM claims WHERE split = 'train'),
test_texts AS (SELECT claim_id, claim AS text FROM claims WHERE split = 'test'),
{grams('train_texts', 2, 'train_grams')}, {grams('test_texts', 2, 'test_grams')},
{tfidf('train_grams', 'test_grams', '(SELECT count(*) FROM train_texts)', 50000, '(1.0::DOUBLE + ln(g.tf::DOUBLE))')}
SELECT claim_id, term, round(weight, 6) AS weight FROM weights"""
ORACLE["tfidf_vectors"] = f"""WITH {_SHORT_TFIDF}
SELECT t.claim_id, count(w.term)::INTEGER AS n_terms, round(coalesce(sum(w.weight), 0.0::DOUBLE), 5) AS total, round(max(w.weight), 5) AS largest
FROM texts t LEFT JOIN weights w ON t.claim_id = w.claim_id GROUP BY t.claim_id"""


# --- Augmentation ------------------------------------------------------------------------------


def deletion(ws: str, text: str, claim_id: str, p: float, seed) -> str:
    keep = f"list_filter({ws}, lambda w, i: list_contains({names(KEPT_WORDS)}, lower(w)) OR {draw('i - 1', claim_id, seed, lit('delete'))} > {p}::DOUBLE)"
    return f"CASE WHEN len({ws}) <= 3 OR len({keep}) = 0 THEN {text} ELSE array_to_string({keep}, ' ') END"


def swap_at(ws: str, claim_id: str, seed, turn: int) -> str:
    return f"(floor({uniform(claim_id, seed, lit('swap'), turn)} * (len({ws}) - 1)))::INTEGER"


def swapped(source: str, seed, name: str, ws: str = "ws") -> str:
    """Two swaps of neighbouring words in ``source(claim_id, text, ws)``."""

    def turn(at: str) -> str:
        return (
            f"list_transform({ws}, lambda w, i: CASE WHEN i - 1 = {at} THEN {ws}[{at} + 2] "
            f"WHEN i - 1 = {at} + 1 THEN {ws}[{at} + 1] ELSE w END)"
        )

    return f"""
{name}_1 AS (SELECT *, {swap_at(ws, 'claim_id', seed, 1)} AS a1, {swap_at(ws, 'claim_id', seed, 2)} AS a2 FROM {source}),
{name}_2 AS (SELECT * REPLACE ({turn('a1')} AS ws) FROM {name}_1),
{name}_3 AS (SELECT * REPLACE ({turn('a2')} AS ws) FROM {name}_2),
{name} AS (SELECT claim_id, CASE WHEN len(ws) < 2 THEN text ELSE array_to_string(ws, ' ') END AS claim FROM {name}_3)"""


def _lexicon() -> str:
    from assay.lexicons import BLOCKED_SYNONYMS, POS_OF_TAG

    return f"""
lexicon AS (
  SELECT s.word, list(DISTINCT s.synonym ORDER BY s.synonym) AS candidates
  FROM {rows(v.SYNONYMS)} s(word, pos, synonym)
  JOIN {rows(v.TAGGED)} t(word, tag) ON s.word = t.word
  JOIN {rows(POS_OF_TAG.items())} m(tag, pos) ON t.tag = m.tag AND m.pos = s.pos
  WHERE s.synonym <> s.word AND NOT contains(s.synonym, '_') AND s.synonym NOT IN ({", ".join(lit(b) for b in BLOCKED_SYNONYMS)})
  GROUP BY s.word
)"""


def substituted(source: str, p: str, seed: str, name: str, key: str = "claim_id") -> str:
    """Word substitution in ``source(<key>, claim)``, row by row over single words."""
    u1 = draw("t.pos", "t.claim_id", seed, lit("synonym"))
    u2 = uniform("t.claim_id", seed, lit("choose"), "t.pos")
    extra = ", ".join(f"t.{k.strip()}" for k in key.split(","))
    return f"""
{name}_words AS (SELECT *, unnest({words('claim')}) AS w, generate_subscripts({words('claim')}, 1) - 1 AS pos FROM {source}),
{name}_new AS (
  SELECT {extra}, t.pos, CASE WHEN {u1} < {p} AND x.word IS NOT NULL
    THEN x.candidates[(floor({u2} * len(x.candidates)))::INTEGER + 1] ELSE t.w END AS w
  FROM {name}_words t LEFT JOIN lexicon x ON lower(t.w) = x.word
),
{name}_text AS (SELECT {key}, string_agg(w, ' ' ORDER BY pos) AS claim FROM {name}_new GROUP BY {key}),
{name} AS (SELECT s.* REPLACE (coalesce(t.claim, '') AS claim) FROM {source} s LEFT JOIN {name}_text t USING ({key}))"""


_DIGEST = "md5(claim) AS text_md5, length(claim)::INTEGER AS n_chars"
ORACLE["random_deletion"] = f"""WITH {CLAIMS}, split_words AS (SELECT claim_id, claim AS text, {words('claim')} AS ws FROM claims),
done AS (SELECT claim_id, {deletion('ws', 'text', 'claim_id', 0.1, 7)} AS claim FROM split_words) SELECT claim_id, {_DIGEST} FROM done"""
ORACLE["random_swap"] = f"""WITH {CLAIMS}, split_words AS (SELECT claim_id, claim AS text, {words('claim')} AS ws FROM claims),
{swapped('split_words', 7, 'done')} SELECT claim_id, {_DIGEST} FROM done"""
ORACLE["synonym_substitute"] = f"""WITH {CLAIMS}, {_lexicon()}, {substituted('claims', '0.15::DOUBLE', '7', 'done')}
SELECT claim_id, {_DIGEST} FROM done"""
ORACLE["combined_augment"] = f"""WITH {SHORT}, {_lexicon()}, {substituted('short_claims', '0.15::DOUBLE', '7', 'first')},
substituted_words AS (SELECT claim_id, claim AS text, {words('claim')} AS ws FROM first),
second AS (SELECT claim_id, {deletion('ws', 'text', 'claim_id', 0.1, 8)} AS text FROM substituted_words),
second_words AS (SELECT claim_id, text, {words('text')} AS ws FROM second),
{swapped('second_words', 9, 'done')} SELECT claim_id, {_DIGEST} FROM done"""
ORACLE["augment_union"] = f"""WITH {CLAIMS}, {OWN_EVIDENCE}, {_lexicon()}, {substituted('labelled', '0.15::DOUBLE', 't.claim_id', 'done')},
both_sets AS (SELECT *, false AS is_augmented FROM labelled UNION ALL SELECT *, true FROM done)
SELECT b.claim_id, is_augmented, label, speaker, subject, coalesce(len(e.passages), 0)::INTEGER AS n_passages, {_DIGEST}
FROM both_sets b LEFT JOIN own_kept e ON b.claim_id = e.claim_id"""
ORACLE["paraphrase_table"] = f"""WITH {CLAIMS}, {_lexicon()},
changed AS (SELECT * REPLACE (CASE WHEN label IS NOT NULL THEN array_to_string(list_reverse({words('claim')}), ' ') ELSE claim END AS claim) FROM claims),
{substituted('changed', '0.3::DOUBLE', '11', 'done')} SELECT claim_id, {_DIGEST} FROM done"""
ORACLE["attack_sets"] = f"""WITH {SHORT}, {_lexicon()},
spread AS (SELECT s.*, a.attack, a.p FROM short_claims s,
  (VALUES ('synonym_p15', 0.15::DOUBLE), ('synonym_p30', 0.3::DOUBLE), ('synonym_p50', 0.5::DOUBLE)) a(attack, p)),
{substituted('spread', 't.p', 't.claim_id', 'done', 'claim_id, attack')}
SELECT claim_id, attack, speaker, {_DIGEST} FROM done"""


# --- Vectors -----------------------------------------------------------------------------------

_DIMS = "dims AS (SELECT vec_id AS claim_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
ORACLE["mean_pool"] = f"WITH {_DIMS} SELECT label, dim::INTEGER AS dim, round(avg(x), 6) AS x FROM dims GROUP BY label, dim"
ORACLE["claim_evidence_blend"] = f"""WITH {_DIMS}, means AS (SELECT label, dim, avg(x) AS m FROM dims WHERE label <> 0 GROUP BY label, dim)
SELECT d.claim_id, d.dim::INTEGER AS dim, round(CASE WHEN m.m IS NULL THEN d.x ELSE 0.7::DOUBLE * d.x + 0.3::DOUBLE * m.m END, 6) AS x
FROM dims d LEFT JOIN means m ON d.label = m.label AND d.dim = m.dim"""
ORACLE["fusion_vectors"] = f"""WITH {CLAIMS}, {OWN_EVIDENCE},
own AS (SELECT claim_id, unnest({letter_counts('text')}) AS x, generate_subscripts({letter_counts('text')}, 1) - 1 AS dim
  FROM (SELECT claim_id, {_CONTEXT} AS text FROM claims)),
pieces AS (SELECT claim_id, unnest(passages) AS text FROM own_kept),
counted AS (SELECT claim_id, {letter_counts('text')} AS vec FROM pieces),
means AS (SELECT claim_id, dim, avg(x) AS m FROM (SELECT claim_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM counted) GROUP BY ALL)
SELECT o.claim_id, o.dim::INTEGER AS dim, round(CASE WHEN m.m IS NULL THEN o.x ELSE 0.7::DOUBLE * o.x + 0.3::DOUBLE * m.m END, 6) AS x
FROM own o LEFT JOIN means m ON o.claim_id = m.claim_id AND o.dim = m.dim"""
ORACLE["dense_cosine_filter"] = f"""WITH {_DIMS}, means AS (SELECT label, dim, avg(x) AS m FROM dims GROUP BY label, dim),
cos AS (SELECT d.claim_id, d.label, sum(d.x * m.m) / sqrt(sum(d.x * d.x) * sum(m.m * m.m)) AS similarity
  FROM dims d JOIN means m ON d.label = m.label AND d.dim = m.dim GROUP BY ALL)
SELECT claim_id, label, round(similarity, 6) AS similarity FROM cos WHERE similarity >= 0.25::DOUBLE"""
ORACLE["hashed_text_vectors"] = f"""WITH {_SHORT_TEXT}
SELECT claim_id, 384 AS width, CASE WHEN len({terms('text')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM texts"""


# --- Splits, weights, metrics ------------------------------------------------------------------

ORACLE["hash_split"] = f"""WITH {CLAIMS}
SELECT claim_id, label, CASE WHEN {uniform("'split'", '42', 'claim_id')} < 0.1::DOUBLE THEN 'val' ELSE 'train' END AS fold FROM labelled"""
_ORDER = digest("'number'", "42", "claim_id")
ORACLE["balanced_resample"] = f"""WITH {CLAIMS},
real_rows AS (SELECT claim_id, row_number() OVER (ORDER BY {_ORDER}, claim_id) - 1 AS pos FROM labelled WHERE label = 1),
fake_rows AS (SELECT claim_id, row_number() OVER (ORDER BY {_ORDER}, claim_id) - 1 AS pos FROM labelled WHERE label = 0),
picks AS (SELECT pos AS draw, floor({uniform("'draw'", '42', 'pos')} * (SELECT count(*) FROM real_rows))::BIGINT AS pos FROM fake_rows),
both_sets AS (SELECT r.claim_id, 1 AS label, p.draw FROM picks p JOIN real_rows r ON p.pos = r.pos
  UNION ALL SELECT claim_id, 0, pos FROM fake_rows)
SELECT claim_id, label, draw, {digest("'shuffle'", '42', 'label', 'draw')} AS shuffle_key FROM both_sets"""
ORACLE["class_weights"] = f"""WITH {CLAIMS}
SELECT label, count(*) AS n_rows, round((SELECT count(*) FROM labelled) / (2.0::DOUBLE * count(*)), 6) AS weight FROM labelled GROUP BY label"""

_VARIANTS = rows(v.VARIANTS) + " m(model, augmentation, retrieve, use_speaker, use_ensemble, base, gain, noise)"
_SEEDS = rows([(s,) for s in v.SEEDS]) + " s(seed)"
PREDICTIONS = f"""{CLAIMS},
drawn AS (
  SELECT c.claim_id, c.label, s.seed, m.model, m.augmentation, m.retrieve, m.use_speaker, m.use_ensemble,
    m.base + m.gain * c.label + m.noise * ({uniform('m.model', 's.seed', 'c.claim_id')} - 0.5::DOUBLE) AS p_real
  FROM labelled c, {_VARIANTS}, {_SEEDS}
),
predictions AS (SELECT *, 1.0::DOUBLE - p_real AS p_fake, CASE WHEN p_real > 1.0::DOUBLE - p_real THEN 1 ELSE 0 END AS pred FROM drawn)"""
ATTACKED = f"""{CLAIMS},
attacked AS (
  SELECT c.claim_id, c.label, s.seed, a.attack, CASE WHEN 0.25::DOUBLE + (0.3::DOUBLE - a.loss) * c.label
    + 0.5::DOUBLE * ({uniform('a.attack', 's.seed', 'c.claim_id')} - 0.5::DOUBLE) > 0.5::DOUBLE THEN 1 ELSE 0 END AS pred
  FROM labelled c, {rows(v.ATTACK_LOSS)} a(attack, loss), {_SEEDS}
)"""


def graded(source: str, by: str, name: str = "graded") -> str:
    return f"""
{name}_counts AS (
  SELECT {by}, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
    count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM {source} GROUP BY {by}
),
{name}_f AS (
  SELECT *, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy,
    CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0::DOUBLE ELSE 2 * tn / (2 * tn + fn + fp)::DOUBLE END AS f1_fake,
    CASE WHEN 2 * tp + fn + fp = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + fn + fp)::DOUBLE END AS f1_real FROM {name}_counts
),
{name} AS (SELECT *, (f1_fake + f1_real) / 2.0::DOUBLE AS f1_macro FROM {name}_f)"""


_BLEND = """
blended AS (
  SELECT a.claim_id, a.seed, a.label, w.weight, (1.0::DOUBLE - w.weight) * a.p_fake + w.weight * b.p_fake AS p_fake,
    (1.0::DOUBLE - w.weight) * a.p_real + w.weight * b.p_real AS p_real
  FROM predictions a JOIN predictions b ON a.claim_id = b.claim_id AND a.seed = b.seed,
    {weights} w(weight) WHERE a.model = 'tfidf_lr' AND b.model = 'vectors_mlp'
),
chosen AS (SELECT *, CASE WHEN p_real > p_fake THEN 1 ELSE 0 END AS pred FROM blended)"""
_GRID = _BLEND.format(weights=rows([(w,) for w in (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35)]))
ORACLE["ensemble_blend"] = f"""WITH {PREDICTIONS}, {_BLEND.format(weights=rows([(0.3,)]))}
SELECT claim_id, seed, label, round(p_fake, 6) AS p_fake, round(p_real, 6) AS p_real, pred FROM chosen"""
_SCORES = "round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(f1_fake, 6) AS f1_fake, round(f1_real, 6) AS f1_real"
ORACLE["weight_grid"] = f"WITH {PREDICTIONS}, {_GRID}, {graded('chosen', 'weight')} SELECT weight, tp, fp, fn, tn, {_SCORES} FROM graded"
ORACLE["best_weight"] = f"""WITH {PREDICTIONS}, {_GRID}, {graded('chosen', 'weight')}
SELECT weight, round(f1_macro, 6) AS f1_macro FROM (SELECT * FROM graded ORDER BY graded.f1_macro DESC, weight LIMIT 1)"""
ORACLE["confusion_metrics"] = f"WITH {PREDICTIONS}, {graded('predictions', 'model, seed')} SELECT model, seed, tp, fp, fn, tn, {_SCORES} FROM graded"


def _ratio(above: str, below: str) -> str:
    return f"CASE WHEN {below} = 0 THEN 0.0::DOUBLE ELSE {above} / ({below})::DOUBLE END"


ORACLE["classification_report"] = f"""WITH {PREDICTIONS}, {graded('predictions', 'model')},
classes AS (
  SELECT model, 'FAKE' AS class, {_ratio('tn', 'tn + fn')} AS precision, {_ratio('tn', 'tn + fp')} AS recall, f1_fake AS f1, tn + fp AS support FROM graded
  UNION ALL
  SELECT model, 'REAL', {_ratio('tp', 'tp + fp')}, {_ratio('tp', 'tp + fn')}, f1_real, tp + fn FROM graded
),
report AS (
  SELECT * FROM classes
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM classes GROUP BY model
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support)::BIGINT FROM classes GROUP BY model
)
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report"""
_DROPS = f"""{ATTACKED}, {graded('attacked', 'attack, seed')},
drops AS (SELECT g.*, c.accuracy - g.accuracy AS robustness_drop FROM graded g JOIN graded c ON g.seed = c.seed AND c.attack = 'clean')"""
ORACLE["robustness_drop"] = f"""WITH {_DROPS}
SELECT attack, seed, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(robustness_drop, 6) AS robustness_drop FROM drops"""
ORACLE["drop_over_seeds"] = f"""WITH {_DROPS}
SELECT attack, count(*) AS n_seeds, round(avg(robustness_drop), 6) AS drop_mean, round(stddev_pop(robustness_drop), 6) AS drop_std_pop,
  round(stddev_samp(robustness_drop), 6) AS drop_std_samp FROM drops GROUP BY attack"""

RESULTS = f"{PREDICTIONS}, {graded('predictions', 'model, augmentation, retrieve, use_speaker, use_ensemble, seed', 'results')}"
ORACLE["variant_drop"] = f"""WITH {RESULTS}, means AS (SELECT model, avg(f1_macro) AS f1_macro FROM results GROUP BY model)
SELECT model, round(f1_macro, 6) AS f1_macro, round((SELECT f1_macro FROM means WHERE model = 'full') - f1_macro, 6) AS drop FROM means"""
ORACLE["variant_summary"] = f"""WITH {RESULTS}
SELECT augmentation, retrieve, use_speaker, use_ensemble, count(*) AS n_seeds, round(avg(f1_macro), 6) AS f1_macro_mean,
  round(stddev_pop(f1_macro), 6) AS f1_macro_std_pop, round(stddev_samp(f1_macro), 6) AS f1_macro_std_samp,
  round(avg(accuracy), 6) AS acc_mean, round(avg(f1_fake), 6) AS f1_fake_mean
FROM results GROUP BY augmentation, retrieve, use_speaker, use_ensemble"""
ORACLE["scores_per_model"] = f"""WITH {RESULTS}
SELECT model, (row_number() OVER (PARTITION BY model ORDER BY seed) - 1)::INTEGER AS pos, round(f1_macro, 6) AS score FROM results"""
# Student's t with 4 degrees of freedom (5 seeds) in closed form.
_T4 = "1.0::DOUBLE - sin(atan(abs(t) / 2.0::DOUBLE)) * (1.0::DOUBLE + 0.5::DOUBLE * cos(atan(abs(t) / 2.0::DOUBLE)) * cos(atan(abs(t) / 2.0::DOUBLE)))"


def tested(pairs: str) -> str:
    return f"""
moments AS (SELECT model, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS mean_d, stddev_samp(a - b) AS sd_d FROM {pairs} GROUP BY model),
with_t AS (SELECT *, mean_d / (sd_d / sqrt(n::DOUBLE)) AS t FROM moments),
with_p AS (SELECT *, {_T4} AS p_two_sided FROM with_t),
tested AS (SELECT *, CASE WHEN t > 0 THEN p_two_sided / 2.0::DOUBLE ELSE 1.0::DOUBLE END AS p_one_sided FROM with_p)"""


_PAIRS = f"""{RESULTS},
pairs AS (SELECT r.model, r.seed, f.f1_macro AS a, r.f1_macro AS b FROM results r JOIN results f ON r.seed = f.seed AND f.model = 'full' WHERE r.model <> 'full')"""
_TEST_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_a", "mean_b", "mean_d", "sd_d", "t", "p_two_sided", "p_one_sided"))
ORACLE["paired_ttest"] = f"WITH {_PAIRS}, {tested('pairs')} SELECT model, n, {_TEST_COLUMNS} FROM tested"
_HALF = "2.7764451051977987::DOUBLE * sd_d / sqrt(n::DOUBLE)"
ORACLE["effect_size"] = f"""WITH {_PAIRS}, {tested('pairs')}
SELECT model, round(mean_d / sd_d, 6) AS cohens_d, round(0.05::DOUBLE / 6, 6) AS alpha_corrected, round(mean_d - {_HALF}, 6) AS ci_low,
  round(mean_d + {_HALF}, 6) AS ci_high, p_two_sided < 0.05::DOUBLE / 6 AS significant_corrected FROM tested"""
# Every sign pattern of the ranks at hand is listed: a bit of ``p`` is the sign of one rank.
_PATTERN_SUM = "list_sum(list_transform(range(0, len(rs)), lambda i: CASE WHEN (p >> i) & 1 = 1 THEN rs[i + 1] ELSE 0.0::DOUBLE END))"
ORACLE["wilcoxon"] = f"""WITH {_PAIRS},
diffs AS (SELECT model, a - b AS d FROM pairs),
ranked AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0::DOUBLE AS r FROM diffs WHERE d <> 0),
sums AS (SELECT model, count(*) AS n_ranked, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus,
  list(r::DOUBLE) AS rs FROM ranked GROUP BY model),
whole AS (SELECT model, count(*) AS n, count(DISTINCT d) AS distinct_d, sum(d) AS sum_d FROM diffs GROUP BY model),
patterns AS (SELECT model, rs, w_plus, w_minus, unnest(range(0, (1 << n_ranked)::BIGINT)) AS p FROM sums),
two_sided AS (SELECT model, least(2.0::DOUBLE * count(*) FILTER ({_PATTERN_SUM} <= least(w_plus, w_minus)) / count(*), 1.0::DOUBLE) AS p FROM patterns GROUP BY model)
SELECT model, n, n_ranked, w_plus, w_minus, round(CASE WHEN distinct_d < 2 THEN NULL WHEN sum_d > 0 THEN p / 2.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS p_one_sided
FROM two_sided JOIN sums USING (model) JOIN whole USING (model)"""
_ATTACK_LEVELS = "(VALUES ('synonym_p15', 0.15::DOUBLE), ('synonym_p30', 0.3::DOUBLE), ('synonym_p50', 0.5::DOUBLE)) a(attack, p)"
_ATTACKED_SEEDS = f"""{CLAIMS}, {_lexicon()},
spread AS (SELECT c.*, s.seed, a.attack, a.p FROM labelled c, {_SEEDS}, {_ATTACK_LEVELS}),
{substituted('spread', 't.p', "concat_ws(':', t.claim_id, t.seed)", 'done', 'claim_id, attack, seed')}"""
ORACLE["attack_sets_over_seeds"] = f"WITH {_ATTACKED_SEEDS} SELECT claim_id, attack, seed, {_DIGEST} FROM done"
ORACLE["robustness_over_seeds"] = f"""WITH {_ATTACKED_SEEDS},
texts AS (SELECT attack, seed, label, claim FROM done UNION ALL SELECT 'clean', s.seed, c.label, c.claim FROM labelled c, {_SEEDS}),
ruled AS (SELECT 'hedged' AS model, attack, seed, label, len(list_intersect({words('lower(claim)')}, {names(v.HEDGE)})) > 0 AS yes FROM texts
  UNION ALL SELECT 'long_words', attack, seed, label, length(claim) >= 6 * len({words('claim')}) FROM texts),
accuracies AS (SELECT model, attack, seed, avg((yes::INTEGER = label)::INTEGER)::DOUBLE AS accuracy FROM ruled GROUP BY model, attack, seed),
drops AS (SELECT g.model, g.attack, g.seed, c.accuracy - g.accuracy AS d FROM accuracies g JOIN accuracies c
  ON g.model = c.model AND g.seed = c.seed AND c.attack = 'clean' WHERE g.attack <> 'clean'),
seed_pairs AS (SELECT x.attack AS model, x.seed, x.d AS a, y.d AS b FROM drops x JOIN drops y
  ON x.attack = y.attack AND x.seed = y.seed AND x.model = 'long_words' AND y.model = 'hedged'), {tested('seed_pairs')}
SELECT model AS attack, n, {_TEST_COLUMNS} FROM tested"""
ORACLE["significance_report"] = f"""WITH {RESULTS},
pairs AS (SELECT r.model, r.seed, f.f1_macro AS a, r.f1_macro AS b FROM results r JOIN results f ON r.seed = f.seed AND f.model = 'full' WHERE r.augmentation = 'baseline'),
{tested('pairs')}
SELECT model, n AS n_base, n AS n_full, {_TEST_COLUMNS}, CASE WHEN p_one_sided < 0.05::DOUBLE THEN 'SIGNIFICANT' ELSE 'NOT significant' END AS verdict FROM tested"""
ORACLE["accuracy_margin"] = f"""WITH {PREDICTIONS}, {graded('predictions', 'model, seed')}
SELECT model, seed, round(accuracy, 6) AS accuracy,
  round(1.96::DOUBLE * sqrt(accuracy * (1.0::DOUBLE - accuracy) / (tp + fp + fn + tn)::DOUBLE), 6) AS margin FROM graded"""
ORACLE["mcnemar"] = f"""WITH {ATTACKED},
pairs AS (SELECT a.attack, a.pred = a.label AS now, c.pred = c.label AS was FROM attacked a JOIN attacked c
  ON a.claim_id = c.claim_id AND a.seed = c.seed AND c.attack = 'clean' WHERE a.attack <> 'clean'),
counted AS (SELECT attack, count(*) FILTER (was AND now) AS both_right, count(*) FILTER (was AND NOT now) AS only_base,
  count(*) FILTER (NOT was AND now) AS only_variant, count(*) FILTER (NOT was AND NOT now) AS both_wrong FROM pairs GROUP BY attack)
SELECT *, round(CASE WHEN only_base + only_variant = 0 THEN 0.0::DOUBLE
  ELSE pow(greatest(abs(only_base - only_variant) - 1, 0), 2) / (only_base + only_variant)::DOUBLE END, 6) AS statistic FROM counted"""
ORACLE["stratified_accuracy"] = f"""WITH {ATTACKED}, {OWN_EVIDENCE}, {scored('labelled', v.HEDGE, v.VAGUE)},
joined AS (SELECT a.pred = a.label AS ok, coalesce(len(e.passages), 0) AS n_ev, s.specificity, s.n_words FROM attacked a
  JOIN scored s ON a.claim_id = s.claim_id LEFT JOIN own_kept e ON a.claim_id = e.claim_id),
tagged AS (
  SELECT 'evidence' AS stratum, CASE WHEN n_ev > 3 THEN 'many' WHEN n_ev > 0 THEN 'some' ELSE 'none' END AS value, ok FROM joined
  UNION ALL SELECT 'specific', CASE WHEN specificity > 0 THEN 'yes' ELSE 'no' END, ok FROM joined
  UNION ALL SELECT 'length', CASE WHEN n_words < 100 THEN 'short' WHEN n_words < 400 THEN 'medium' ELSE 'long' END, ok FROM joined)
SELECT stratum, value, count(*) AS n_claims, round(avg(ok::INTEGER::DOUBLE), 6) AS accuracy FROM tagged GROUP BY stratum, value"""
ORACLE["results_append"] = f"WITH {RESULTS} SELECT model, count(*) AS n_rows, round(sum(accuracy), 6) AS acc_sum FROM results GROUP BY model"
ORACLE["final_summary"] = f"""WITH {RESULTS}
SELECT model, CASE WHEN augmentation = 'baseline' THEN 'baseline' ELSE 'main' END AS category,
  format('{{:.4f}}', accuracy) AS test_acc, format('{{:.4f}}', f1_macro) AS test_f1_macro FROM results"""


ORACLE["report_files"] = f"""SELECT fmt, s.* FROM ({ORACLE["scores_per_model"]}) s, (VALUES ('csv'), ('json')) f(fmt)"""
ORACLE["final_nested"] = f"""WITH {RESULTS}
SELECT CASE WHEN model = 'full' THEN 'full' ELSE 'others' END AS section, model, seed, round(f1_macro, 6) AS score FROM results"""
ORACLE["dense_search"] = """
WITH given AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
units AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM given WHERE list_inner_product(v, v) > 0),
pairs AS (SELECT q.vec_id AS query_id, o.vec_id AS id, round(list_inner_product(q.u, o.u), 9) AS cosine
  FROM units q JOIN units o ON q.vec_id <> o.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, id, round(cosine, 6) AS cosine FROM ranked WHERE rank <= 10"""


# --- Key-based evidence ------------------------------------------------------------------------

SENTENCES = f"""
last_pages AS (SELECT lang || '-' || n_chars AS title, arg_max(text, doc_id) AS text FROM documents GROUP BY title),
numbered AS (SELECT title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM last_pages),
parsed AS (SELECT title, i, CASE WHEN i % 7 = 6 THEN i - 1 ELSE i END::INTEGER AS sent_id, {strip("string_split(line, chr(9))[1]")} AS text
  FROM numbered WHERE i % 5 <> 4),
sentences AS (SELECT title, sent_id, arg_max(text, i) AS text FROM parsed WHERE text <> '' GROUP BY title, sent_id)"""
ORACLE["page_sentences"] = f"WITH {SENTENCES} SELECT title, sent_id, md5(text) AS text_md5 FROM sentences"
ORACLE["keyed_claims"] = f"""WITH {SHORT}
SELECT claim_id, CASE WHEN speaker = 'user' THEN 1 ELSE 0 END AS label, CASE WHEN speaker = 'user' THEN 'SUPPORTS' ELSE 'REFUTES' END AS label_str,
  6 AS n_tuples FROM short_claims WHERE speaker IN ('user', 'assistant')"""
ORACLE["evidence_resolve"] = f"""WITH {SHORT}, {SENTENCES},
draws AS (SELECT claim_id, speaker, j, floor({uniform("'cite'", 'claim_id', 'j')} * (SELECT count(*) FROM documents))::BIGINT AS doc_id,
  {uniform("'sent'", 'claim_id', 'j')} AS u FROM short_claims, (VALUES (0), (1), (2), (3)) t(j)),
placed AS (SELECT w.claim_id, w.j, floor(w.u * len(string_split(d.text, chr(10))))::INTEGER AS sent_id, d.lang || '-' || d.n_chars AS title
  FROM draws w JOIN documents d ON w.doc_id = d.doc_id),
titled AS (SELECT * FROM placed WHERE NOT (j = 3 AND sent_id = 0)),
firsts AS (SELECT claim_id, title, sent_id, min(j) AS j FROM titled GROUP BY ALL),
hits AS (SELECT f.claim_id, s.text, row_number() OVER (PARTITION BY f.claim_id ORDER BY f.j) AS r FROM firsts f JOIN sentences s ON f.title = s.title AND f.sent_id = s.sent_id),
joined AS (SELECT claim_id, string_agg(text, ' ' ORDER BY r) AS text FROM hits WHERE r <= 3 GROUP BY claim_id)
SELECT c.claim_id, CASE WHEN c.speaker = 'user' THEN 1 ELSE 0 END AS label, length(coalesce(j.text, ''))::INTEGER AS n_chars,
  md5(coalesce(j.text, '')) AS text_md5 FROM short_claims c LEFT JOIN joined j ON c.claim_id = j.claim_id WHERE c.speaker IN ('user', 'assistant')"""

# --- Streaming ---------------------------------------------------------------------------------

ORACLE["stream_fill_rate"] = """SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_claims, count(*) FILTER (value >= 10) AS n_filled,
  round(avg((value >= 10)::INTEGER::DOUBLE), 6) AS fill_rate FROM events GROUP BY 1"""

"""The same queries as SQL for a second engine, written independently of the Spark plans."""

from __future__ import annotations

from lexicarta.sources.readers import default_stop_words

DIGITS = 6
TOTAL_DIGITS = 3  # of sums of weights
TOP = 101
CHUNK_CHARS = 50_000  # small, so that the test tables have categories of several chunks

DOCS = r"""docs AS (
  SELECT doc_id, source AS category,
         trim(regexp_replace(text, '[\r\n\t]+', ' ', 'g')) AS text
  FROM documents)"""


def _stops() -> str:
    rows = ", ".join("('" + w.replace("'", "''") + "')" for w in default_stop_words())
    return f"stops(term) AS (VALUES {rows})"


def _split(text: str) -> str:
    return (
        f"CASE WHEN rtrim({text}, ' ') = '' AND {text} <> '' THEN []::VARCHAR[] "
        f"ELSE string_split(rtrim({text}, ' '), ' ') END"
    )


def _units(text: str) -> str:
    beyond = r"[^\x{10000}-\x{10FFFF}]"
    return f"(length({text}) + length(regexp_replace({text}, '{beyond}', '', 'g')))"


def _clean(text: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({text}), '\d+', '', 'g'), '\p{{P}}', '', 'g')"


def _blank_stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


# --- record files -----------------------------------------------------------


def _lines(tag: str) -> str:
    return rf"""lines AS (
  SELECT source, doc_id, unnest(line) AS line, unnest(range(len(line))) AS line_no
  FROM (SELECT source, doc_id,
               ['{tag}' || t[1]] || list_transform(t[2:], lambda x: '   ' || x)
               || ['TI x y zzz', '   cont zzzz', ''] AS line
        FROM (SELECT source, doc_id, string_split_regex(text, '\r\n|\r|\n') AS t FROM documents)))"""


def _records(tag: str, width: int, close: int, joiner: str) -> str:
    return rf"""{_lines(tag.ljust(width))},
  worded AS (SELECT *, {_split('line')} AS w, {_blank_stripped('lower(line)')} AS body FROM lines),
  marked AS (
    SELECT source, doc_id, line_no,
           CASE WHEN {_units('line')} <= {close} THEN 'T' WHEN len(w) < 2 THEN NULL
                WHEN w[1] = '{tag}' THEN 'S' WHEN w[1] = '' THEN 'C' ELSE 'O' END AS kind, body
    FROM worded),
  numbered AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS pos,
           coalesce(sum(CASE WHEN kind = 'T' THEN 1 ELSE 0 END) OVER (
             PARTITION BY source ORDER BY doc_id, line_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rec
    FROM marked WHERE kind IS NOT NULL),
  started AS (
    SELECT *, max(CASE WHEN kind = 'S' THEN pos END) OVER (PARTITION BY source, rec) AS s
    FROM numbered WHERE kind <> 'T'),
  stopped AS (
    SELECT *, min(CASE WHEN kind = 'O' AND pos > s THEN pos END) OVER (PARTITION BY source, rec) AS o
    FROM started),
  records AS (
    SELECT source, rec,
           string_agg(nullif(CASE WHEN kind = 'S' THEN substr(body, {width + 1}) ELSE body END, ''),
                      '{joiner}' ORDER BY pos) AS text
    FROM stopped WHERE pos >= s AND (o IS NULL OR pos < o) GROUP BY source, rec)"""


def _record_query(tag: str, width: int, close: int, joiner: str) -> str:
    return f"""WITH {_records(tag, width, close, joiner)}
SELECT source, text FROM records WHERE text <> ''"""


def _strip_query(joiner: str) -> str:
    kept = f"""list_filter({_split('text')},
      lambda w: {_units('w')} >= 2 AND NOT list_contains(stop_list, w))"""
    return f"""WITH {_records('AB', 3, 2, joiner)}, {_stops()}
SELECT source, coalesce(array_to_string({kept}, '{joiner}'), '') AS text
FROM records, (SELECT list(term) AS stop_list FROM stops) WHERE text <> ''"""


# --- documents, ids, categories ---------------------------------------------

NUMBERED = f"""{DOCS},
  flagged AS (
    SELECT *, doc_id IN (SELECT doc_id FROM labels) AS is_train FROM docs),
  numbered AS (
    SELECT doc_id AS old_id, is_train, category, text,
           row_number() OVER (ORDER BY is_train, category, doc_id) - 1 AS doc_id
    FROM flagged),
  ranges AS (
    SELECT category, CAST(row_number() OVER (ORDER BY min(doc_id)) AS INTEGER) AS label_id,
           min(doc_id) AS start_id, max(doc_id) AS stop_id
    FROM numbered WHERE is_train GROUP BY category),
  labelled AS (
    SELECT n.doc_id, n.old_id, n.text,
           CASE WHEN n.doc_id < (SELECT min(start_id) FROM ranges) THEN 'test'
                WHEN r.label_id IS NOT NULL THEN 'train' END AS split,
           CAST(r.label_id - 1 AS INTEGER) AS label, r.category
    FROM numbered n LEFT JOIN ranges r ON n.doc_id BETWEEN r.start_id AND r.stop_id)"""



def _chunks(docs: str, chars: int) -> str:
    return f"""sized AS (
    SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY category ORDER BY doc_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM {docs}),
  chunks AS (
    SELECT category, CAST(before // {chars} AS BIGINT) AS chunk, min(doc_id) AS first_id, count(*) AS n_docs,
           string_agg(text, '' ORDER BY doc_id) AS text
    FROM sized GROUP BY category, before // {chars})"""


# --- tokens and vocabulary --------------------------------------------------


def _tokens(docs: str = "docs") -> str:
    return f"""tokens AS (
  SELECT doc_id, unnest(w) AS term, CAST(unnest(range(len(w))) AS INTEGER) AS word_no
  FROM (SELECT doc_id, {_split('c')} AS w FROM (SELECT doc_id, {_clean('text')} AS c FROM {docs})))"""


def _vocabulary(docs: str = "docs", by: str = "count(*)") -> str:
    return f"""{_tokens(docs)}, {_stops()},
  chosen AS (
    SELECT term FROM tokens
    WHERE {_units('term')} > 2 AND term NOT IN (SELECT term FROM stops)
    GROUP BY term
    HAVING {by} >= CAST(0.005 AS DOUBLE) * (SELECT count(*) FROM {docs}))"""


def _weights(docs: str = "docs", cleaned: bool = False) -> str:
    text = _clean("text") if cleaned else "text"
    return f"""{_vocabulary(docs)},
  words AS (
    SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS word_no
    FROM (SELECT doc_id, {_split('c')} AS w FROM (SELECT doc_id, {text} AS c FROM {docs}))),
  counts AS (
    SELECT doc_id, term, count(*) AS cnt FROM words
    WHERE term IN (SELECT term FROM chosen) GROUP BY doc_id, term),
  used AS (
    SELECT term, count(*) AS doc_frequency, CAST(sum(cnt) AS BIGINT) AS doc_occurrences,
           CASE WHEN count(*) >= 2
                THEN ln(((SELECT count(*) FROM {docs}) + 1) / (count(*) + 1)) ELSE 0.0 END AS idf
    FROM counts GROUP BY term),
  dictionary AS (
    SELECT *, CAST(row_number() OVER (ORDER BY doc_occurrences DESC, term) - 1 AS INTEGER) AS term_id
    FROM used),
  tfidf AS (
    SELECT c.doc_id, c.term, c.cnt, d.term_id, round(c.cnt * d.idf, {DIGITS}) AS weight
    FROM counts c JOIN dictionary d USING (term))"""


def _ranked(ties: str) -> str:
    return f"""{_weights()},
  ranked AS (
    SELECT doc_id, term, term_id, weight, CAST(row_number() OVER (
             PARTITION BY doc_id ORDER BY weight DESC, {ties}) AS INTEGER) AS rank
    FROM tfidf WHERE weight > 0)"""


def _vector_lines(docs: str, drop_last: int = 0) -> str:
    kept = "" if not drop_last else "WHERE back > 1"
    return f"""lines AS (
    SELECT d.doc_id, coalesce(v.body, '') AS body
    FROM {docs} d LEFT JOIN (
      SELECT doc_id, string_agg(term_id || ':' || printf('%.{DIGITS}f', weight) || ' ', ''
                                ORDER BY term_id) AS body
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY term_id DESC) AS back FROM tfidf)
      {kept} GROUP BY doc_id) v ON d.doc_id = v.doc_id)"""


# --- topics on given mixtures -----------------------------------------------

MIXTURES = """weights AS (
    SELECT vec_id AS doc_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS topic,
           CAST(unnest(embedding) AS DOUBLE) AS weight FROM embeddings),
  assigned AS (
    SELECT doc_id, CAST(CASE WHEN max(weight) <= 0 THEN 0
                             ELSE arg_min(topic, (-weight, topic)) END AS INTEGER) AS topic
    FROM weights GROUP BY doc_id)"""
TOP_DOCS = f"""{MIXTURES},
  top AS (
    SELECT topic, CAST(row_number() OVER (
             PARTITION BY topic ORDER BY round(weight, {DIGITS}) DESC, doc_id) AS INTEGER) AS rank,
           doc_id, round(weight, {DIGITS}) AS weight
    FROM weights QUALIFY rank <= 20)"""
GIVEN_TERMS = f"""{MIXTURES},
  terms AS (
    SELECT w.topic, d.term_id, d.term, round(w.weight, {DIGITS}) AS weight,
           CAST(row_number() OVER (
             PARTITION BY w.topic ORDER BY round(w.weight, {DIGITS}) DESC, d.term_id) AS INTEGER) AS rank
    FROM weights w JOIN dictionary d ON d.term_id = w.doc_id),
  top AS (
    SELECT topic, term_id, term, weight, CAST(row_number() OVER (
             PARTITION BY topic ORDER BY weight DESC, term) AS INTEGER) AS rank
    FROM terms QUALIFY rank <= {TOP}),
  filled AS (
    SELECT t.topic, d.term_id, d.term, coalesce(g.weight, 0.0) AS weight,
           CAST(row_number() OVER (
             PARTITION BY t.topic ORDER BY coalesce(g.weight, 0.0) DESC, d.term) AS INTEGER) AS rank
    FROM (SELECT DISTINCT topic FROM weights) t CROSS JOIN dictionary d
    LEFT JOIN terms g ON g.topic = t.topic AND g.term_id = d.term_id
    QUALIFY rank <= {TOP})"""


def oracle_sql() -> dict[str, str]:
    with_docs = f"WITH {DOCS}"
    weights = f"{with_docs}, {_weights()}"
    numbered = f"WITH {NUMBERED}"
    return {
        "raw_lines": f"WITH {_lines('AB ')} SELECT source, line FROM lines",
        "article_records": _record_query("AB", 3, 2, " "),
        "article_records_compat": _record_query("AB", 3, 2, ""),
        "patent_records": _record_query("abd", 7, 8, " "),
        "patent_records_compat": _record_query("abd", 7, 8, ""),
        "article_stopword_strip": _strip_query(" "),
        "article_stopword_strip_compat": _strip_query(""),
        "doc_lines": f"{with_docs} SELECT doc_id, text FROM docs",
        "doc_ids": """SELECT source, doc_id,
  row_number() OVER (ORDER BY source, doc_id) - 1 AS new_id FROM documents""",
        "label_ranges": f"{numbered} SELECT * FROM ranges",
        "label_by_range": f"{numbered} SELECT doc_id, old_id, label, category FROM labelled",
        "train_test_split": f"""{numbered} SELECT split, label, count(*) AS n_docs,
  min(doc_id) AS first_id, max(doc_id) AS last_id FROM labelled GROUP BY split, label""",
        "category_docs": f"""{with_docs}, {_chunks('docs', CHUNK_CHARS)}
SELECT category, chunk, first_id, n_docs, text FROM chunks""",
        "stopwords": f"""{with_docs}, {_tokens()}, {_stops()}
SELECT term, count(DISTINCT doc_id) AS n_docs FROM tokens
WHERE term IN (SELECT term FROM stops) GROUP BY term""",
        "clean_text": f"{with_docs} SELECT doc_id, {_clean('text')} AS text FROM docs",
        "tokens": f"{with_docs}, {_tokens()} SELECT doc_id, word_no, term FROM tokens",
        "tokens_no_stop": f"""{with_docs}, {_tokens()}, {_stops()}
SELECT doc_id, word_no, term FROM tokens WHERE term NOT IN (SELECT term FROM stops)""",
        "tokens_min_len": f"""{with_docs}, {_tokens()}, {_stops()}
SELECT doc_id, word_no, term FROM tokens
WHERE term NOT IN (SELECT term FROM stops) AND {_units('term')} > 2""",
        "term_counts": f"""{with_docs}, {_tokens()}, {_stops()}
SELECT term, count(*) AS cnt FROM tokens
WHERE term NOT IN (SELECT term FROM stops) AND {_units('term')} > 2 GROUP BY term""",
        "vocabulary": f"""{with_docs}, {_vocabulary()}
SELECT term, count(*) AS cnt FROM tokens WHERE term IN (SELECT term FROM chosen) GROUP BY term""",
        "vocabulary_by_documents": f"""{with_docs}, {_vocabulary(by='count(DISTINCT doc_id)')}
SELECT term, count(DISTINCT doc_id) AS n_docs FROM tokens
WHERE term IN (SELECT term FROM chosen) GROUP BY term""",
        "corpus_stats": f"""{with_docs}, {_vocabulary()}
SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(*) FROM chosen) AS n_terms""",
        "batched_ids": f"{numbered} SELECT doc_id, old_id, category FROM numbered",
        "batched_vocabulary": f"""{with_docs}, {_vocabulary()}
SELECT term, count(*) AS cnt FROM tokens WHERE term IN (SELECT term FROM chosen) GROUP BY term""",
        "batched_dictionary": f"{weights} SELECT term, term_id FROM dictionary",
        "batched_tfidf": f"{weights} SELECT doc_id, term, cnt, weight FROM tfidf",
        "dictionary": f"{weights} SELECT term, term_id FROM dictionary",
        "doc_words": f"""{weights}
SELECT d.doc_id, coalesce(w.words, '') AS words FROM docs d LEFT JOIN (
  SELECT doc_id, string_agg(term, ' ' ORDER BY word_no) AS words FROM words
  WHERE term IN (SELECT term FROM chosen) GROUP BY doc_id) w ON d.doc_id = w.doc_id""",
        "doc_term_counts": f"{weights} SELECT doc_id, term, cnt FROM counts",
        "document_frequency": f"{weights} SELECT term, doc_frequency FROM used",
        "idf": f"{weights} SELECT term, round(idf, {DIGITS}) AS idf FROM used",
        "tfidf": f"{weights} SELECT doc_id, term, cnt, weight FROM tfidf",
        "tfidf_clean_docs": f"""{with_docs}, {_weights(cleaned=True)}
SELECT doc_id, term, cnt, weight FROM tfidf""",
        "tfidf_ml": f"{weights} SELECT doc_id, term, weight FROM tfidf",
        "doc_top_terms": f"""{with_docs}, {_ranked('term')}
SELECT doc_id, rank, term, weight FROM ranked WHERE rank <= {TOP}""",
        "doc_top_terms_filled": f"""{with_docs}, {_weights()},
  every AS (
    SELECT d.doc_id, t.term, t.term_id, coalesce(f.weight, 0.0) AS weight
    FROM docs d CROSS JOIN dictionary t
    LEFT JOIN tfidf f ON f.doc_id = d.doc_id AND f.term_id = t.term_id)
SELECT doc_id, term, weight, CAST(row_number() OVER (
         PARTITION BY doc_id ORDER BY weight DESC, term_id) AS INTEGER) AS rank
FROM every QUALIFY rank <= {TOP}""",
        "vector_lines_parse": f"{weights} SELECT doc_id, term_id, weight FROM tfidf",
        "export_documents": f"{numbered} SELECT doc_id || chr(9) || text AS value FROM numbered",
        "export_train_documents": f"""{numbered}
SELECT doc_id || chr(9) || text AS value FROM numbered WHERE is_train""",
        "export_category_docs": f"""{numbered}, {_chunks('(FROM numbered WHERE is_train)', CHUNK_CHARS)}
SELECT category || chr(9) || chunk || chr(9) || first_id || chr(9) || text AS value FROM chunks""",
        "export_label_ranges": f"""{numbered}
SELECT category || chr(9) || label_id || chr(9) || start_id || chr(9) || stop_id AS value FROM ranges""",
        "export_dictionary": f"{weights} SELECT term || chr(9) || term_id AS value FROM dictionary",
        "export_vector_lines": f"""{weights}, {_vector_lines('docs')}
SELECT doc_id || ' ' || body AS value FROM lines""",
        "export_vector_lines_compat": f"""{weights}, {_vector_lines('docs', drop_last=1)}
SELECT doc_id || ' ' || body AS value FROM lines""",
        "export_train_vectors": f"""{numbered}, {_weights('numbered')}, {_vector_lines('numbered')}
SELECT l.label || ' ' || v.body AS value FROM lines v JOIN labelled l ON v.doc_id = l.doc_id
WHERE l.split = 'train'""",
        "export_document_terms": f"""{with_docs}, {_ranked('term')}
SELECT d.doc_id || chr(9) || coalesce(r.words, '') AS value FROM docs d LEFT JOIN (
  SELECT doc_id, string_agg(term || ' ', '' ORDER BY rank) AS words FROM ranked
  WHERE rank <= {TOP} GROUP BY doc_id) r ON d.doc_id = r.doc_id""",
        "dominant_topic": f"WITH {MIXTURES} SELECT doc_id, topic FROM assigned",
        "docs_by_topic": f"""WITH {MIXTURES}
SELECT topic, doc_id // 100000 AS part, count(*) AS n_docs,
       string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids
FROM assigned GROUP BY topic, part""",
        "topic_top_docs": f"WITH {TOP_DOCS} SELECT topic, rank, doc_id, weight FROM top",
        "export_topic_documents": f"""WITH {MIXTURES}
SELECT 'Topic' || t.topic || ':' || chr(9) || '['
       || coalesce(string_agg(CAST(a.doc_id AS VARCHAR), ', ' ORDER BY a.doc_id), '') || ']' || chr(10)
       AS value
FROM (SELECT unnest(range(64)) AS topic) t LEFT JOIN assigned a ON a.topic = t.topic
GROUP BY t.topic, a.doc_id // 100000""",
        "topic_terms": f"""{weights}, {GIVEN_TERMS}
SELECT topic, rank, term_id, term, weight FROM terms""",
        "topic_top_terms": f"""{weights}, {GIVEN_TERMS}
SELECT topic, rank, term_id, term, weight FROM top""",
        "topic_top_terms_filled": f"""{weights}, {GIVEN_TERMS}
SELECT topic, rank, term_id, term, weight FROM filled""",
        "export_topic_words": f"""{weights}, {GIVEN_TERMS}
SELECT 'Topic' || topic || ':' || chr(9) || string_agg(term || chr(9), '' ORDER BY rank) || chr(10) AS value
FROM top GROUP BY topic""",
        "export_topic_descriptions": f"""{weights}, {GIVEN_TERMS}
SELECT 'Topic' || topic || ':' || chr(10) || string_agg(term || ' ', '' ORDER BY rank) || chr(10) AS value
FROM terms GROUP BY topic""",
        "lda_fit": f"""{weights}
SELECT CAST(t AS INTEGER) AS topic, n AS n_terms, 1.0::DOUBLE AS weight, n AS last_rank
FROM unnest(range(7)) AS topics(t), (SELECT count(*) AS n FROM used WHERE idf > 0)""",
        "doc_topics": f"""{weights}
SELECT doc_id, 7::INTEGER AS n_topics,
       CASE WHEN doc_id IN (SELECT doc_id FROM tfidf WHERE weight > 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS weight
FROM docs""",
        "lda_top_docs": f"""{with_docs}
SELECT CAST(t AS INTEGER) AS topic, CAST(r AS INTEGER) AS rank, true AS falls
FROM unnest(range(7)) AS topics(t), unnest(range(1, 21)) AS ranks(r) WHERE r <= (SELECT count(*) FROM docs)""",
        "lda_docs_by_topic": f"""{weights}
SELECT DISTINCT doc_id FROM tfidf WHERE weight > 0""",
        "training_mixtures": f"""{weights}
SELECT c.doc_id, 7::INTEGER AS n_topics, 1.0::DOUBLE AS weight, round(sum(c.cnt * u.idf), {TOTAL_DIGITS}) AS total
FROM counts c JOIN used u USING (term) WHERE u.idf > 0 GROUP BY c.doc_id""",
        "training_terms": f"""{weights}
SELECT c.term, 7::INTEGER AS n_topics, round(sum(c.cnt * u.idf), {TOTAL_DIGITS}) AS total
FROM counts c JOIN used u USING (term) WHERE u.idf > 0 GROUP BY c.term""",
        "training_topic_terms": f"""{weights}
SELECT CAST(t AS INTEGER) AS topic, n AS n_terms, 1.0::DOUBLE AS weight, n AS last_rank
FROM unnest(range(7)) AS topics(t), (SELECT count(*) AS n FROM used WHERE idf > 0)""",
        "training_top_docs": f"""{weights}
SELECT CAST(t AS INTEGER) AS topic, CAST(r AS INTEGER) AS rank, true AS falls
FROM unnest(range(7)) AS topics(t), unnest(range(1, 21)) AS ranks(r)
WHERE r <= (SELECT count(DISTINCT doc_id) FROM tfidf WHERE weight > 0)""",
        "training_docs_by_topic": f"""{weights}
SELECT DISTINCT doc_id FROM tfidf WHERE weight > 0""",
        "export_topic_top_documents": f"""WITH {TOP_DOCS}
SELECT 'Topic' || topic || ':' || chr(9)
       || string_agg(doc_id || ':' || printf('%.{DIGITS}f', weight) || ',' || chr(10), ''
                     ORDER BY rank) || chr(10) AS value
FROM top GROUP BY topic""",
    }

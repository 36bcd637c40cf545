"""Text, retrieval, chat log and paged listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from balancier.functions import text as T
from balancier.operators import chatlog as G
from balancier.operators import corpus as C
from balancier.operators import indexes as I
from balancier.operators import listing as P
from balancier.operators import retrieval as V
from balancier.session import work_folder
from checks.registry import check
from checks.tables import DATAMART_VIEWS, datamart, duck, table, view, with_views


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


STOPS = ", ".join(_quote(w) for w in T.STOP_WORDS)


def words_sql(c: str) -> str:
    return rf"string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{Nd}}\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"


def tokens_sql(c: str) -> str:
    """Words that count, repeats kept."""
    return f"list_filter({words_sql(c)}, lambda w: length(w) > 1 AND w NOT IN ({STOPS}))"


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@check(
    "tokens_top",
    f"""SELECT token, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest({words_sql('text')}) AS token FROM documents)
    WHERE length(token) > 1 AND token NOT IN ({STOPS}) GROUP BY token""",
)
def tokens_top(spark, sf_dir):
    return C.token_counts(table(spark, sf_dir, "documents"), "text")


QUESTIONS = """SELECT event_id, user_id, concat(CASE event_id % 9 WHEN 0 THEN 'Pourquoi ' WHEN 1 THEN 'Trend of ' WHEN 2 THEN 'Seuil: '
    WHEN 3 THEN 'What is ' WHEN 4 THEN 'Simuler ' WHEN 5 THEN 'Vue d''ensemble ' WHEN 6 THEN 'Évolution, ' ELSE '' END,
    CASE event_type WHEN 'view' THEN 'la solvabilité RS et RCET1' WHEN 'signup' THEN 'LIQUIDITY de FPE, rcr' WHEN 'click' THEN 'FPE/ROE/ROA analysis'
    WHEN 'error' THEN 'rien RSX xRS' ELSE 'risque crédit et levier TECH-9' END, ' on ', CAST(CAST(ts AS DATE) AS STRING),
    CASE WHEN event_id % 4 = 0 THEN ' and 1999-01-31, 1999-01-31 x2000-02-028' ELSE '.' END) AS text FROM {events}"""


def spotted_sql(codes, c: str = "text") -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS code, {i} AS pos" for i, code in enumerate(codes))


def has_code(code: str, c: str) -> str:
    return rf"regexp_matches(upper({c}), '(^|[^\p{{L}}\p{{Nd}}]){code}($|[^\p{{L}}\p{{Nd}}])')"


def domain_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({c}), {_quote(p)}) THEN '{d}'" for p, d in T.DOMAIN_PHRASES.items()) + " END"


_ENTITIES = " UNION ALL ".join(
    [f"SELECT event_id, user_id, 'RATIO_CODE' AS entity_type, '{k}' AS entity_value FROM q WHERE {has_code(k, 'text')}" for k in T.RATIO_CODES]
    + [f"SELECT event_id, user_id, 'PARAMETER_CODE', '{k}' FROM q WHERE {has_code(k, 'text')}" for k in T.PARAMETER_CODES]
    + [r"SELECT DISTINCT event_id, user_id, 'DATE', unnest(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b')) FROM q"]
    + [f"SELECT event_id, user_id, 'DOMAIN', {domain_sql('text')} FROM q WHERE {domain_sql('text')} IS NOT NULL"]
)


@check("entities_long", f"WITH q AS ({duck(QUESTIONS)}) {_ENTITIES}")
def entities_long(spark, sf_dir):
    return C.entities(view(spark, sf_dir, QUESTIONS), "text", ["event_id", "user_id"])


def intent_sql(c: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({c}), {_quote(p)})' for p in phrases)} THEN '{name}'" for name, phrases in T.INTENT_PHRASES.items()
    )
    codes = "|".join([*T.RATIO_CODES, *T.PARAMETER_CODES])
    return f"CASE {whens} WHEN {has_code('(' + codes + ')', c)} THEN 'RATIO_VALUE' ELSE 'GENERAL' END"


_ASKED = QUESTIONS + " UNION ALL SELECT conv_id * 1000 + turn + 1000000000000, conv_id, text FROM {conversations}"


@check("intent_class", f"WITH q AS ({duck(_ASKED)}) SELECT event_id, {intent_sql('text')} AS intent FROM q")
def intent_class(spark, sf_dir):
    return view(spark, sf_dir, _ASKED).select("event_id", T.intent("text").alias("intent"))


@check("domain_tag", f"WITH q AS ({duck(_ASKED)}) SELECT event_id, {domain_sql('text')} AS domain FROM q")
def domain_tag(spark, sf_dir):
    return view(spark, sf_dir, _ASKED).select("event_id", T.domain("text").alias("domain"))


# A knowledge sheet: the documents, with codes, keywords and gaps by document number.
SHEET = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN concat(' ', source, ' ') ELSE ' ' END AS titre,
    CASE WHEN doc_id % 17 = 5 THEN '  ' ELSE text END AS content, concat('body ', lang) AS body, lang AS language, source,
    CASE doc_id % 5 WHEN 0 THEN ' rs' WHEN 1 THEN '' ELSE NULL END AS ratio_code,
    CASE doc_id % 4 WHEN 0 THEN 'fpe ' ELSE NULL END AS parameter,
    CASE WHEN doc_id % 6 = 0 THEN 'Solvency ' END AS domain,
    CASE doc_id % 3 WHEN 0 THEN 'alpha, beta;gamma|' WHEN 1 THEN ' ' ELSE 'alpha' END AS keywords FROM {documents}"""

_FILLED = f"""sheet AS ({duck(SHEET)}),
    coded AS (SELECT *, CASE WHEN {strip_sql('titre')} <> '' THEN {strip_sql('titre')} END AS t,
        CASE WHEN {strip_sql('content')} <> '' THEN content ELSE body END AS c,
        upper(nullif({strip_sql('ratio_code')}, '')) AS rc, upper(nullif({strip_sql('parameter')}, '')) AS pc FROM sheet),
    bodies AS (SELECT *, coalesce('[' || coalesce(rc, pc) || ']', '') AS prefix,
        CASE WHEN coalesce(rc, pc) IS NULL THEN {strip_sql('c')} ELSE '[' || coalesce(rc, pc) || '] — ' || {strip_sql('c')} END AS whole FROM coded),
    cuts(doc_id, chunk_no, start, stop) AS (
        SELECT doc_id, -1, 0, 0 FROM bodies
        UNION ALL SELECT doc_id, chunk_no + 1, stop, CASE WHEN stop + 1800 >= n THEN n
            WHEN bound > 900 THEN stop + bound ELSE stop + 1800 END
        FROM (SELECT k.doc_id, k.chunk_no, k.stop, length(b.whole) AS n,
            length(regexp_replace(substr(b.whole, k.stop + 1, 1801), '[^.?!]*$', '')) AS bound
            FROM cuts k JOIN bodies b USING (doc_id) WHERE k.stop < length(b.whole))),
    pieces AS (SELECT b.*, k.chunk_no, CASE WHEN length(b.whole) <= 1800 THEN b.whole
        ELSE {strip_sql('substr(b.whole, k.start + 1, k.stop - k.start)')} END AS piece FROM cuts k JOIN bodies b USING (doc_id) WHERE k.chunk_no >= 0)"""


@check(
    "chunks",
    f"""WITH RECURSIVE {_FILLED.replace('bound > 900', 'bound - 1 > 900')} SELECT doc_id, chunk_no, piece AS text, {strip_sql("coalesce(t, prefix || ' — knowledge chunk')")} AS title, rc AS ratio_code,
    pc AS parameter_code, source, language FROM pieces""",
)
def chunks(spark, sf_dir):
    out = C.chunk_documents(view(spark, sf_dir, SHEET), ["doc_id"])
    return out.select("doc_id", "chunk_no", "text", "title", "ratio_code", "parameter_code", "source", "language")


_FIRST_RATIO = "CASE " + " ".join(f"WHEN {has_code(k, 'w')} THEN '{k}'" for k in T.RATIO_CODES) + " END"
_FIRST_PARAM = "CASE " + " ".join(f"WHEN {has_code(k, 'w')} THEN '{k}'" for k in T.PARAMETER_CODES) + " END"


@check(
    "chunks_enriched",
    f"""WITH RECURSIVE {_FILLED.replace('bound > 900', 'bound - 1 > 900')}, base AS (SELECT doc_id, chunk_no, rc, pc, lower(nullif({strip_sql('domain')}, '')) AS d,
        list_filter(list_transform(string_split_regex(coalesce(keywords, ''), '[,;|]\\s*'), lambda k: {strip_sql('k')}), lambda k: k <> '') AS kw,
        {strip_sql("coalesce(t, prefix || ' — knowledge chunk')")} || '. ' || piece AS w FROM pieces),
    found AS (SELECT *, coalesce(rc, {_FIRST_RATIO}) AS r, coalesce(pc, {_FIRST_PARAM}) AS p, coalesce(d, {domain_sql('w')}) AS dom, {tokens_sql('w')} AS tk0 FROM base),
    once AS (SELECT *, list_filter(tk0, lambda x, i: list_position(tk0, x) = i) AS tk FROM found),
    merged AS (SELECT *, list_concat(kw, tk, list_filter([r, p], lambda x: x IS NOT NULL)) AS m FROM once)
    SELECT doc_id, chunk_no, r AS ratio_code, p AS parameter_code, dom AS domain, array_to_string(CASE
        WHEN len(kw) = 0 THEN list_filter(m, lambda x, i: list_position(m, x) = i)[1:20]
        WHEN rc IS NULL OR pc IS NULL OR d IS NULL THEN list_filter(m, lambda x, i: list_position(m, x) = i)[1:30] ELSE kw END, ' ') AS keywords FROM merged""",
)
def chunks_enriched(spark, sf_dir):
    out = C.enrich(C.chunk_documents(view(spark, sf_dir, SHEET), ["doc_id"]))
    return out.select("doc_id", "chunk_no", "ratio_code", "parameter_code", "domain", F.array_join("keywords", " ").alias("keywords"))


@check("corpus_counts", "SELECT lang AS document_type, count(*) AS total, count(CASE WHEN source = 'src7' THEN 1 END) AS seeded FROM documents GROUP BY lang")
def corpus_counts(spark, sf_dir):
    return C.counts(table(spark, sf_dir, "documents").withColumnRenamed("lang", "document_type"), "src7")


@check("corpus_delete_source", "SELECT doc_id, source FROM documents WHERE source <> 'src7' OR source IS NULL")
def corpus_delete_source(spark, sf_dir):
    return C.without_source(table(spark, sf_dir, "documents"), "src7").select("doc_id", "source")


@check("corpus_seed", "SELECT item_id, text, 'benchmark' AS source FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM documents WHERE source = 'benchmark')")
def corpus_seed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    have = C.seed(docs, table(spark, sf_dir, "benchmark"), "src7")  # present already: adds nothing
    return C.seed(docs, table(spark, sf_dir, "benchmark"), "benchmark").unionByName(have)


# Corpus rows: documents beside the vector of the same number, coded by source and language.
CORPUS = """SELECT doc_id AS id, text AS content, source AS title, upper(source) AS ratio_code, upper(lang) AS parameter_code,
    CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'solvency' ELSE 'liquidity' END AS domain, embedding
    FROM {documents} LEFT JOIN {embeddings} ON doc_id = vec_id"""
TERMS = {0: ["the", "thre"], 1: ["mente", "que", "ción"], 2: ["éreau", "les"], 3: ["onen", "erhe", "src7"], 4: ["src12"]}
CODES = {0: (["SRC7", "SRC1"], []), 1: ([], ["FR"]), 2: (["SRC3"], ["EN"]), 5: (["NONE"], [])}


def _queries(spark, sf_dir):
    """One query per label of the vectors: its last vector, with fixed words, codes and domains."""
    last = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max_by("embedding", "vec_id").alias("v"))
    return [
        V.Query(f"q{r['label']}", r["v"], TERMS.get(r["label"], []), *CODES.get(r["label"], ([], [])),
                "solvency" if r["label"] % 3 == 1 else None)
        for r in sorted(last.collect(), key=lambda r: r["label"])
    ]


_CORPUS = f"""corpus AS ({duck(CORPUS)}),
    asked AS (SELECT 'q' || label AS query, arg_max(embedding, vec_id)::DOUBLE[] AS v, CASE WHEN label % 3 = 1 THEN 'solvency' END AS dom FROM embeddings GROUP BY label),
    dense_all AS (SELECT query, id, round(list_cosine_similarity(embedding::DOUBLE[], v), 12) AS score FROM corpus, asked
        WHERE embedding IS NOT NULL AND (dom IS NULL OR domain = dom OR domain IS NULL)),
    dense_hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM dense_all QUALIFY rank <= 16),
    terms AS (SELECT * FROM (VALUES {', '.join(f"('q{q}', '{t}')" for q, ts in TERMS.items() for t in ts)}) t(query, term)),
    bag AS (SELECT id, unnest({words_sql("concat(content, ' ', title)")}) AS term FROM corpus),
    tf AS (SELECT id, term, count(*) AS tf FROM bag WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
    w AS (SELECT term, ln(1 + (SELECT count(*) FROM corpus) / count(*)) AS weight FROM tf GROUP BY term),
    term_all AS (SELECT query, id, round(sum(tf * weight), 9) AS score FROM tf JOIN w USING (term) JOIN terms USING (term) GROUP BY query, id),
    term_hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM term_all QUALIFY rank <= 16),
    codes AS (SELECT * FROM (VALUES {', '.join(f"('q{q}', 'r', '{c}')" for q, (r, _) in CODES.items() for c in r)}, {', '.join(f"('q{q}', 'p', '{c}')" for q, (_, p) in CODES.items() for c in p)}) t(query, kind, code)),
    code_all AS (SELECT DISTINCT query, id, 1.0::DOUBLE AS score FROM corpus JOIN codes ON (kind = 'r' AND code = ratio_code) OR (kind = 'p' AND code = parameter_code)),
    code_hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM code_all QUALIFY rank <= 8),
    fused AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM
        (SELECT query, id, rank FROM dense_hits UNION ALL SELECT query, id, rank FROM term_hits UNION ALL SELECT query, id, rank FROM code_hits) GROUP BY ALL)"""


def _six(df):
    return df.select("query", "id", "rank", F.round("score", 6).alias("score"))


@check("retrieve_dense", f"WITH {_CORPUS} SELECT query, id, rank, round(score, 6) AS score FROM dense_hits")
def retrieve_dense(spark, sf_dir):
    return _six(V.dense(view(spark, sf_dir, CORPUS), _queries(spark, sf_dir), domain="domain"))


@check("retrieve_terms", f"WITH {_CORPUS} SELECT query, id, rank, round(score, 6) AS score FROM term_hits")
def retrieve_terms(spark, sf_dir):
    return _six(V.by_terms(view(spark, sf_dir, CORPUS), _queries(spark, sf_dir)))


@check("retrieve_dense_indexed", f"WITH {_CORPUS} SELECT query, id, rank, round(score, 6) AS score FROM dense_hits")
def retrieve_dense_indexed(spark, sf_dir):
    path = work_folder(spark)
    I.write_vectors(view(spark, sf_dir, CORPUS), path, domain="domain")
    return _six(I.dense(spark, path, _queries(spark, sf_dir)).hits)


@check("retrieve_terms_indexed", f"WITH {_CORPUS} SELECT query, id, rank, round(score, 6) AS score FROM term_hits")
def retrieve_terms_indexed(spark, sf_dir):
    path = work_folder(spark)
    I.write_terms(view(spark, sf_dir, CORPUS), path)
    return _six(I.by_terms(spark, path, _queries(spark, sf_dir)).hits)


@check("retrieve_exact", f"WITH {_CORPUS} SELECT query, id, rank, score FROM code_hits")
def retrieve_exact(spark, sf_dir):
    return _six(V.by_code(view(spark, sf_dir, CORPUS), _queries(spark, sf_dir)))


@check(
    "retrieve_fused",
    f"""WITH {_CORPUS} SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, round(score, 6) AS score
    FROM fused QUALIFY rank <= 8""",
)
def retrieve_fused(spark, sf_dir):
    return _six(V.retrieve(view(spark, sf_dir, CORPUS), _queries(spark, sf_dir)))


MESSAGES = "SELECT conv_id AS session_id, turn AS sequence_no, turn AS created_at, role, text AS content FROM {conversations}"
SUMMARIES = "SELECT session_id, created_at FROM ({messages}) AS m WHERE session_id % 2 = 0 AND sequence_no IN (1, 3)"


def _summaries():
    return SUMMARIES.replace("{messages}", MESSAGES)


@check(
    "sessions_to_summarise",
    f"""WITH m AS ({duck(MESSAGES)}), s AS (SELECT session_id, max(created_at) AS last FROM ({duck(_summaries())}) GROUP BY 1)
    SELECT m.session_id, count(*) AS messages FROM m LEFT JOIN s USING (session_id) WHERE m.created_at > coalesce(s.last, -1) GROUP BY 1 HAVING count(*) >= 4""",
)
def sessions_to_summarise(spark, sf_dir):
    return G.sessions_to_summarise(view(spark, sf_dir, MESSAGES), view(spark, sf_dir, _summaries()), at_least=4)


@check("last_n_messages", f"WITH m AS ({duck(MESSAGES)}) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence_no DESC) <= 3")
def last_n_messages(spark, sf_dir):
    return G.last_messages(view(spark, sf_dir, MESSAGES), keep=3)


@check("trimmed_counts", f"WITH m AS ({duck(MESSAGES)}) SELECT session_id, greatest(count(*) - 3, 0) AS deleted FROM m GROUP BY 1")
def trimmed_counts(spark, sf_dir):
    return G.trimmed_counts(view(spark, sf_dir, MESSAGES), keep=3)


_LINES = "string_agg(role || ': ' || content, chr(10) ORDER BY sequence_no) AS text"


@check("conversation_text", f"WITH m AS ({duck(MESSAGES)}) SELECT session_id, CAST(0 AS BIGINT) AS part_no, count(*) AS messages, {_LINES} FROM m GROUP BY session_id")
def conversation_text(spark, sf_dir):
    return G.conversation_text(view(spark, sf_dir, MESSAGES), part=1000)


@check("conversation_parts", f"WITH m AS ({duck(MESSAGES)}) SELECT session_id, sequence_no // 3 AS part_no, count(*) AS messages, {_LINES} FROM m GROUP BY ALL")
def conversation_parts(spark, sf_dir):
    return G.conversation_text(view(spark, sf_dir, MESSAGES), part=3)


@check("session_sequence", f"WITH m AS ({duck(MESSAGES)}) SELECT session_id, count(*) AS messages, coalesce(max(sequence_no), 0) AS max_sequence_no FROM m GROUP BY 1")
def session_sequence(spark, sf_dir):
    return G.last_sequence(view(spark, sf_dir, MESSAGES))


SESSIONS = """SELECT min(event_id) AS id, concat('user-', CAST(user_id % 20 AS STRING)) AS user_id,
    CASE WHEN min(event_id) % 4 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, max(ts) AS last_message_at FROM {events} GROUP BY user_id, event_type"""


@check("session_list", f"SELECT * FROM ({duck(SESSIONS)}) WHERE user_id = 'user-7' AND status = 'ACTIVE' ORDER BY last_message_at DESC NULLS LAST, id LIMIT 20")
def session_list(spark, sf_dir):
    return G.session_page(view(spark, sf_dir, SESSIONS), "user-7").items


@check("token_budget", "SELECT doc_id, CAST(ceil(length(text) / 3.7::DOUBLE) AS INT) AS tokens, ceil(length(text) / 3.7::DOUBLE) <= 500 AS fits FROM documents")
def token_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("tokens"), T.fits("text", 500).alias("fits"))


RAW = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat(event_type, ' said "x"') WHEN 2 THEN concat(' [1,  ', CAST(user_id AS STRING), ' ] ')
    WHEN 3 THEN '{bad' ELSE NULL END AS raw FROM {events}"""


@check(
    "json_normalised",
    f"""SELECT event_id, CASE WHEN raw IS NULL THEN NULL WHEN regexp_matches(trim(raw), '^[{{\\[]') AND json_valid(trim(raw))
    THEN CAST(json(trim(raw)) AS VARCHAR) ELSE CAST(to_json(raw) AS VARCHAR) END AS json FROM ({duck(RAW)})""",
)
def json_normalised(spark, sf_dir):
    text = RAW.replace("'{bad'", "concat(chr(123), 'bad')")
    return view(spark, sf_dir, text).select("event_id", T.normalise_json("raw").alias("json"))


PROMPTS = f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('  ', event_type, chr(10), '{T.CONTEXT_MARKER}', ' ctx') WHEN 1 THEN '{T.CONTEXT_MARKER} ctx'
    ELSE event_type END AS content FROM {{events}}"""


@check(
    "prompt_text",
    f"""SELECT event_id, CASE WHEN instr(content, '{T.CONTEXT_MARKER}') > 1 THEN {strip_sql(f"split_part(content, '{T.CONTEXT_MARKER}', 1)")} ELSE content END AS prompt
    FROM ({duck(PROMPTS)})""",
)
def prompt_text(spark, sf_dir):
    return view(spark, sf_dir, PROMPTS).select("event_id", T.prompt_text("content").alias("prompt"))


@check(
    "page_listing",
    with_views(DATAMART_VIEWS, """SELECT c.idtiers, c.nomprenom, c.raisonsoc, c.chiffreaffaires, r.pays, r.geo, a.libelle, d.douteux, g.nomgrpaffaires AS nomgroupaffaire,
    s.libelle AS sectionactivite FROM (SELECT * FROM dim_client ORDER BY idtiers LIMIT 20 OFFSET 60) c LEFT JOIN sub_dim_residence r ON r.id = c.id_residence
    LEFT JOIN sub_dim_agenteco a ON a.id = c.id_agenteco LEFT JOIN sub_dim_douteux d ON d.id = c.id_douteux
    LEFT JOIN sub_dim_grpaffaire g ON g.id = c.id_grpaffaire LEFT JOIN sub_dim_sectionactivite s ON s.id = c.id_sectionactivite"""),
)
def page_listing(spark, sf_dir):
    return P.client_page(datamart(spark, sf_dir), page=3, size=20).items


@check(
    "page_contracts",
    with_views(DATAMART_VIEWS, """SELECT c.id, c.id_client, c.ancienneteimpaye, c.tauxcontrat, c.actif, a.numagence, d.devise, o.libelle AS objetfinance, t.typcontrat,
    x.date_value AS dateouverture, y.date_value AS dateecheance, k.nomprenom FROM (SELECT * FROM dim_contrat ORDER BY id LIMIT 50 OFFSET 0) c
    LEFT JOIN sub_dim_agence a ON a.id = c.id_agence LEFT JOIN sub_dim_devise d ON d.id = c.id_devise LEFT JOIN sub_dim_objetfinance o ON o.id = c.id_objetfinance
    LEFT JOIN sub_dim_typcontrat t ON t.id = c.id_typcontrat LEFT JOIN sub_dim_date x ON x.id = c.id_dateouverture LEFT JOIN sub_dim_date y ON y.id = c.id_dateecheance
    LEFT JOIN dim_client k ON k.idtiers = c.id_client"""),
)
def page_contracts(spark, sf_dir):
    return P.contract_page(datamart(spark, sf_dir), page=-1, size=50).items


@check(
    "page_balances",
    with_views(DATAMART_VIEWS, """SELECT b.id, b.id_client, b.id_contrat, b.soldeorigine, CAST(b.soldeconvertie AS DOUBLE) AS soldeconvertie, b.cumulmvtdb, b.cumulmvtcr,
    b.soldeinitdebmois, b.amount, b.actif, a.numagence, d.devise, k.devise AS devisebanque, c.libellecompte, h.chapitre, t.date_value AS datevalue
    FROM (SELECT * FROM fact_balance ORDER BY id, soldeorigine, id_compte, soldeconvertie LIMIT 30 OFFSET 30) b LEFT JOIN sub_dim_agence a ON a.id = b.id_agence
    LEFT JOIN sub_dim_devise d ON d.id = b.id_devise LEFT JOIN sub_dim_devise k ON k.id = b.id_devisebnq LEFT JOIN sub_dim_compte c ON c.id = b.id_compte
    LEFT JOIN sub_dim_chapitre h ON h.id = b.id_chapitre LEFT JOIN sub_dim_date t ON t.id = b.id_date"""),
)
def page_balances(spark, sf_dir):
    """Test facts share ids, so amounts break the ties."""
    tables = datamart(spark, sf_dir)
    rows = P.page_of(tables["fact_balance"], ["id", "soldeorigine", "id_compte", "soldeconvertie"], 1, 30).items
    return P.labelled(rows, tables, P.BALANCE_LABELS).withColumn("soldeconvertie", F.col("soldeconvertie").cast("double"))

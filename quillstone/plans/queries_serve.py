"""Registered queries on articles, links, search, requests, runs and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import articles as A
from quillstone.operators import links as K
from quillstone.operators import manifest as MF
from quillstone.operators import mentions as M
from quillstone.operators import requests as R
from quillstone.operators import runs as O
from quillstone.operators import search as L
from quillstone.operators.cleaning import clean_documents
from quillstone.plans import queries_text as QT
from quillstone.plans import views as V
from quillstone.plans.queries_notes import key_sql, slug_sql
from quillstone.plans.queries_text import title_sql
from quillstone.plans.views import table, with_views
from quillstone.sources import scans as S
from quillstone.sources.storage import fresh_dir, pinned
from quillstone.functions import text as X
from quillstone.streaming import logs

QUERIES = {}
ORACLES = {}
NL = V.NL


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- articles --------------------------------------------------------------------------------------


def heading_sql(body: str, fallback: str) -> str:
    first = f"list_filter(list_transform(string_split({body}, {NL}), lambda x: trim(x)), lambda x: starts_with(x, '#'))[1]"
    return f"coalesce(nullif(trim(ltrim({first}, '#')), ''), {fallback})"


query(
    "heading_title",
    with_views("article_files", f"SELECT rel_path, root, {heading_sql('body', chr(39) + 'none' + chr(39))} AS title FROM article_files"),
)(
    lambda spark, sf: V.article_files(spark, sf).select(
        "rel_path", "root", X.heading_title(F.col("body"), F.lit("none")).alias("title")
    )
)

BODIES = """SELECT scope, entity, CAST(0 AS BIGINT) AS part, min_by(path, {'a': lower(name), 'b': name, 'c': path}) FILTER (WHERE kind = 'md') AS path,
    coalesce(string_agg(trim(body), chr(10) || chr(10) ORDER BY lower(name), name, path) FILTER (WHERE kind = 'md' AND trim(body) <> ''), '')
    || CASE WHEN count(*) FILTER (WHERE kind = 'jsonl') = 0 THEN '' ELSE chr(10) || chr(10) || '## Data files (JSONL)' || chr(10)
      || string_agg(chr(10) || '- `' || name || '`', '' ORDER BY lower(name), name, path) FILTER (WHERE kind = 'jsonl') END AS body
    FROM entity_files GROUP BY scope, entity HAVING count(*) FILTER (WHERE kind = 'md') > 0"""


def bodies(spark, sf):
    files = V.entity_file_list(spark, sf)
    listed = MF.entity_files(files).join(files.select("path", "body"), "path")
    return A.aggregate_entity_body(listed)


query("aggregate_entity_body", with_views("entity_files", BODIES))(bodies)

PREFIX = """CASE root WHEN 'lore' THEN 'lore' WHEN 'campaign_entities' THEN 'campaign-entities' WHEN 'campaign' THEN 'campaign'
    WHEN 'topics' THEN 'topics' WHEN 'sessions' THEN 'sessions' ELSE 'campaign-requests' END"""
RANK = """CASE root WHEN 'lore' THEN 1 WHEN 'campaign_entities' THEN 2 WHEN 'campaign' THEN 3 WHEN 'topics' THEN 4 WHEN 'sessions' THEN 5 ELSE 6 END"""
STEM = "regexp_replace(regexp_replace(rel_path, '[.]md$', ''), '^.*/', '')"
CATEGORY = "CASE root WHEN 'lore' THEN 'general' WHEN 'topics' THEN 'general' WHEN 'requests' THEN 'campaign-queue' ELSE 'campaign' END"
ARTICLE_CTES = dict(
    bodies=BODIES,
    general_keys=f"SELECT DISTINCT {key_sql('entity')} AS k FROM bodies WHERE scope = 'general'",
    entity_rows=f"""SELECT CASE WHEN scope = 'campaign' THEN 'campaign-entities-' ELSE 'lore-entities-' END || lower(replace(entity, '_', '-')) AS slug,
      {heading_sql('body', title_sql("replace(entity, '-', ' ')"))} AS title, path, body, CASE WHEN scope = 'campaign' THEN 'campaign' ELSE 'general' END AS category
      FROM bodies WHERE scope <> 'campaign' OR {key_sql('entity')} NOT IN (SELECT k FROM general_keys)""",
    legacy=f"""SELECT *, CASE WHEN root = 'campaign_entities' AND contains(stem, '.') THEN 'campaign-entities-' || replace(lower(split_part(stem, '.', 1)), '_', '-') END AS base
      FROM (SELECT {PREFIX} || '-' || replace(lower(replace(regexp_replace(rel_path, '[.]md$', ''), '/', '-')), '_', '-') AS slug, root, rel_path,
        root || '/' || rel_path AS path, body, {CATEGORY} AS category, {RANK} AS rnk, {STEM} AS stem FROM article_files
        WHERE NOT (root IN ('lore', 'campaign_entities', 'campaign') AND starts_with(rel_path, 'requests/')) AND NOT (root = 'campaign' AND starts_with(rel_path, 'entities/')) AND NOT (root = 'requests' AND contains(rel_path, '/')))""",
    usable=f"""SELECT * FROM legacy l WHERE NOT (rnk IN (2, 3) AND {key_sql('stem')} IN (SELECT k FROM general_keys))
      AND NOT (base IS NOT NULL AND (base IN (SELECT slug FROM entity_rows)
        OR EXISTS (SELECT 1 FROM legacy b WHERE b.rnk = 2 AND b.base IS NULL AND b.slug = l.base AND b.path < l.path)))""",
    candidates=f"""SELECT slug, title, path, body, category, 1 AS prec, 0 AS rnk FROM entity_rows
      UNION ALL SELECT slug, {heading_sql('body', title_sql("replace(stem, '_', ' ')"))}, path, body, category, CASE WHEN rnk >= 4 THEN 2 ELSE 0 END, rnk FROM usable""",
    ranked="""SELECT *, row_number() OVER (PARTITION BY slug ORDER BY prec DESC, CASE WHEN prec = 0 THEN rnk ELSE -rnk END,
      CASE WHEN prec = 0 THEN path END, CASE WHEN prec > 0 THEN path END DESC) AS rn FROM candidates""",
    articles="""SELECT slug, title, path, body, category FROM ranked WHERE rn = 1 UNION ALL
      SELECT 'index', 'Index', NULL, '# Index' || chr(10) || chr(10) || 'Browse every knowledge article.', 'core'
      UNION ALL SELECT 'entity-queue', 'Entity Request Queue', NULL, '# Entity Request Queue', 'core'""",
)


def articles_sql(body: str) -> str:
    return with_views("entity_files article_files", body, **ARTICLE_CTES)


def articles(spark, sf):
    return A.build_articles(pinned(bodies(spark, sf)), V.article_files(spark, sf))


SHOWN = ("slug", "title", "path", "body", "category")
query("build_articles", articles_sql("SELECT * FROM articles"))(lambda spark, sf: articles(spark, sf).select(*SHOWN))
UNLISTED = ARTICLE_CTES | dict(
    bodies=f"""SELECT scope, split_part(name, '.', 1) AS entity, CAST(0 AS BIGINT) AS part, min_by(path, {{'a': lower(name), 'b': name, 'c': path}}) AS path,
      coalesce(string_agg(trim(body), {NL} || {NL} ORDER BY lower(name), name, path) FILTER (WHERE trim(body) <> ''), '') AS body
      FROM entity_file_list WHERE name LIKE '%.md' GROUP BY ALL""",
    general_keys="SELECT '' AS k WHERE false",
)
query("build_unlisted_articles", with_views("entity_file_list article_files", "SELECT * FROM articles", **UNLISTED))(
    lambda spark, sf: A.build_articles(
        pinned(A.unlisted_bodies(V.entity_file_list(spark, sf))), V.article_files(spark, sf), listed=False
    ).select(*SHOWN)
)
query(
    "article_category",
    with_views("article_files", f"SELECT root, rel_path, {CATEGORY} AS category FROM article_files"),
)(
    lambda spark, sf: V.article_files(spark, sf).select("root", "rel_path", A.article_category(F.col("root")).alias("category"))
)
PIN = ("no-such-article", "topics-3", "topics-5")


@query(
    "merge_pinned_article",
    with_views(
        "link_articles",
        f"""SELECT slug, CASE WHEN slug = 'topics-3' THEN 'Pinned' ELSE title END AS title,
        CASE WHEN slug = 'topics-3' THEN rtrim(body, ' ' || {NL}) || {NL} || {NL} || '---' || {NL} || {NL} || '# Context' || {NL} || {NL} || more ELSE body END AS body FROM link_articles, extra
        UNION ALL SELECT 'home', 'Pinned', rtrim(body, ' ' || {NL}) || {NL} || {NL} || '---' || {NL} || {NL} || '# Context' || {NL} || {NL} || more FROM link_articles, extra WHERE slug = 'topics-3'""",
        extra=f"SELECT string_agg(r_name, {NL} || {NL} ORDER BY r_regionkey) AS more FROM region",
    ),
)
def merge_pinned_article(spark, sf):
    extra = table(spark, sf, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("body"))
    out = A.merge_pinned_article(V.link_articles(spark, sf), PIN, extra, "home", "Pinned", "Context")
    return out.select("slug", "title", "body")


query(
    "entity_choices",
    articles_sql(
        """SELECT DISTINCT trim(replace(replace(replace(title, 'Campaign NPC: ', ''), 'Campaign PC: ', ''), 'Campaign Entity: ', '')) AS name
        FROM articles WHERE starts_with(slug, 'campaign-entities-') AND trim(title) <> ''"""
    ),
)(lambda spark, sf: A.entity_choices(articles(spark, sf)))

# --- links -----------------------------------------------------------------------------------------

LINKS = dict(
    dictionary="""SELECT title AS name, max_by(slug, {'r': src_rank, 'p': path}) AS slug FROM link_articles GROUP BY title""",
    tokens=r"""SELECT DISTINCT slug AS src, unnest(regexp_extract_all(regexp_replace(body, '<[^>]+>', '|', 'g'), '[\p{L}\p{N}_/]+')) AS name FROM link_articles""",
    edges="SELECT DISTINCT src, slug AS dst FROM tokens JOIN dictionary USING (name) WHERE src <> slug",
)


def links_sql(body: str) -> str:
    return with_views("link_articles", body, **LINKS)


query("link_dictionary", links_sql("SELECT * FROM dictionary"))(
    lambda spark, sf: K.link_dictionary(V.link_articles(spark, sf))
)
query("extract_links", links_sql("SELECT * FROM edges"))(
    lambda spark, sf: K.extract_links(V.link_articles(spark, sf), K.link_dictionary(V.link_articles(spark, sf)))
)
NAMED = r"""SELECT src, slug AS dst, count(*) AS n FROM (SELECT slug AS src,
    unnest(regexp_extract_all(regexp_replace(body, '<[^>]+>', '|', 'g'), '[\p{L}\p{N}_/]+')) AS name FROM link_articles)
    JOIN dictionary USING (name) WHERE src <> slug GROUP BY ALL"""
query("outgoing_edges", links_sql(NAMED))(
    lambda spark, sf: K.outgoing_edges(V.link_articles(spark, sf))
)
EDGES = "page_edges edge_articles"
query(
    "inbound_counts",
    with_views(EDGES, "SELECT slug, count(src) AS inbound FROM edge_articles LEFT JOIN page_edges ON dst = slug GROUP BY slug"),
)(lambda spark, sf: K.inbound_counts(V.edge_articles(spark, sf), V.page_edges(spark, sf)))
query(
    "backlinks",
    with_views(EDGES, "SELECT DISTINCT e.dst AS slug, src, coalesce(upper(a.slug), src) AS title FROM page_edges e LEFT JOIN edge_articles a ON a.slug = e.src"),
)(lambda spark, sf: K.backlinks(V.edge_articles(spark, sf), V.page_edges(spark, sf)))
query("outbound_count", with_views("page_edges", "SELECT src AS slug, count(DISTINCT dst) AS outbound FROM page_edges GROUP BY src"))(
    lambda spark, sf: K.outbound_count(V.page_edges(spark, sf))
)
CITE = "concat(' /', {m}, '/f%20', doc_id, if(doc_id % 4 = 0, '', if(doc_id % 4 = 1, concat('#L', n_chars), concat('#PAGE-', doc_id))))"


@query(
    "parse_citation",
    """SELECT citation, path, line, section FROM (SELECT ' /' || d || '/f%20' || doc_id || mark AS citation, '/' || d || '/f ' || doc_id AS path,
      CASE WHEN doc_id % 4 = 1 THEN n_chars END AS line, CASE WHEN doc_id % 4 > 1 THEN 'PAGE-' || doc_id END AS section, d
      FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'mem' WHEN 1 THEN 'memory' ELSE 'raw/x' END AS d,
        CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '#L' || n_chars ELSE '#PAGE-' || doc_id END AS mark FROM documents)) WHERE d <> 'memory'""",
)
def parse_citation(spark, sf):
    folder = "if(doc_id % 3 = 0, 'mem', if(doc_id % 3 = 1, 'memory', 'raw/x'))"
    rows = V.documents(spark, sf).select(F.expr(CITE.format(m=folder)).alias("citation"))
    return K.parse_citation(rows, ["/mem", "/raw/"])


INDEX = """SELECT CAST(CASE category WHEN 'core' THEN 0 WHEN 'general' THEN 1 WHEN 'campaign' THEN 2 ELSE 3 END AS INTEGER) AS category_rank,
    category, title, slug, (SELECT count(*) FROM edges WHERE dst = slug) AS inbound FROM link_articles WHERE slug <> 'topics-1'
    ORDER BY category_rank, lower(title), slug"""


@query("article_index", links_sql(INDEX))
def article_index(spark, sf):
    items = V.link_articles(spark, sf)
    return K.article_index(items, K.inbound_counts(items, K.outgoing_edges(items)), hidden="topics-1", pinned="topics-2")


query(
    "source_window",
    with_views("doc_lines", "SELECT doc_id, line_no, line_no = 45 AS marked, text FROM doc_lines WHERE line_no > 5 AND line_no <= 1405"),
)(lambda spark, sf: K.source_window(S.doc_lines(V.documents(spark, sf)), F.lit(45)))

DIAG = """SELECT 'articles_' || category AS metric, count(*) AS value FROM link_articles GROUP BY category
    UNION ALL SELECT 'articles_total', count(*) FROM link_articles UNION ALL SELECT 'manifest_rows', count(*) FROM entity_file_list
    UNION ALL SELECT 'manifest_campaign', count(*) FROM entity_file_list WHERE scope = 'campaign'
    UNION ALL SELECT 'manifest_general', count(*) FROM entity_file_list WHERE scope = 'general'
    UNION ALL SELECT 'queue_rows', count(*) FROM events UNION ALL SELECT 'submissions', count(*) FROM conversations"""
query("diagnostics", with_views("link_articles entity_file_list", DIAG))(
    lambda spark, sf: K.diagnostics(
        V.link_articles(spark, sf), V.entity_file_list(spark, sf), table(spark, sf, "events"), table(spark, sf, "conversations")
    )
)
query(
    "latest_requests",
    with_views("requests", "SELECT request_id, entity, ts FROM requests ORDER BY ts DESC, request_id LIMIT 5"),
)(lambda spark, sf: K.latest_requests(V.requests(spark, sf)).select("request_id", "entity", "ts"))
query(
    "data_source_counts",
    with_views(
        "",
        """SELECT group_name, subgroup, count(*) AS n FROM inv GROUP BY group_name, subgroup
        UNION ALL SELECT group_name, '', count(*) FROM inv GROUP BY group_name""",
        inv=QT.INVENTORY_SQL,
    ),
)(lambda spark, sf: K.data_source_counts(QT.inventory(spark, sf)))

# --- search ----------------------------------------------------------------------------------------

ASKED = "The tion the  zzyzx Que"


def count_sql(text: str, term: str) -> str:
    return f"(length({text}) - length(replace({text}, {term}, ''))) // length({term})"


SCORE = " + ".join(count_sql("lower(text)", f"'{t}'") for t in L.query_terms(ASKED))


def snippet_sql(query_text: str) -> str:
    at = "coalesce(" + ", ".join(f"nullif(instr(lower(text), '{t}'), 0)" for t in L.query_terms(query_text)) + ")"
    return f"""trim(replace(CASE WHEN {at} IS NULL THEN substr(text, 1, 220)
        ELSE substr(text, greatest({at} - 1 - 73, 0) + 1, {at} - 1 + 220 - greatest({at} - 1 - 73, 0)) END, {NL}, ' '))"""


def search_ctes(limit: int) -> str:
    return f"""SELECT doc_id, CAST({SCORE} AS DOUBLE) AS score, {snippet_sql(ASKED)} AS snippet FROM documents WHERE {SCORE} > 0
        ORDER BY score DESC, doc_id LIMIT {limit}"""


query("keyword_search", search_ctes(8))(lambda spark, sf: L.keyword_search(V.documents(spark, sf), ASKED, L.DEFAULT_LIMIT))
query("search_snippet", f"SELECT doc_id, {snippet_sql('que tion the')} AS snippet FROM documents")(
    lambda spark, sf: L.search_snippet(V.documents(spark, sf), "que tion the")
)


@query(
    "semantic_search",
    """SELECT vec_id, round(score, 5) AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]),
      (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) AS score FROM embeddings) ORDER BY round(score, 5) DESC, vec_id LIMIT 8""",
)
def semantic_search(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where(F.col("vec_id") == 7).agg(F.first("embedding").alias("e")).scalar()
    return L.semantic_search(vectors, asked, L.DEFAULT_LIMIT).withColumn("score", F.round("score", 5))


BATCH = """WITH q AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS term FROM benchmark),
    t AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL), u AS (SELECT DISTINCT term FROM t),
    d AS (SELECT doc_id, lower(text) AS low FROM documents),
    h AS (SELECT doc_id, term, (length(low) - length(replace(low, term, ''))) // length(term) AS n FROM d JOIN u ON contains(low, term)),
    s AS (SELECT query_id, doc_id, CAST(sum(n * times) AS DOUBLE) AS score FROM h JOIN t USING (term) GROUP BY query_id, doc_id)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 8"""


@query("batch_search", BATCH)
def batch_search(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return L.batch_search(V.documents(spark, sf), asked, L.DEFAULT_LIMIT)


@query(
    "get_doc",
    "SELECT doc_id, substr(text, 1, 500) AS content, length(text) > 500 AS truncated FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)",
)
def get_doc(spark, sf):
    docs = V.documents(spark, sf)
    return L.get_doc(docs, docs.agg(F.max("doc_id").alias("m")).scalar(), 500)


# --- facts, submissions, requests ------------------------------------------------------------------

FACTS = """SELECT now AS ts, trim(fact) AS fact, trim(coalesce(entity, '')) AS entity, coalesce(source, 'discord') AS source,
    coalesce(channel, '') AS channel, coalesce(confidence, 'medium') AS confidence, coalesce(array_to_string(tags, '|'), '') AS tags FROM payloads"""


@query("append_facts", with_views("payloads", FACTS))
def append_facts(spark, sf):
    facts = R.fact_rows(V.payloads(spark, sf), F.col("now"))
    return facts.withColumn("tags", F.array_join("tags", "|"))


@query(
    "fact_audit",
    with_views(
        "payloads",
        """SELECT now AS ts, 'upsert_fact' AS action, 'chat_facts.jsonl' AS filename, trim(coalesce(entity, '')) AS entity,
        coalesce(source, 'discord') AS source FROM payloads""",
    ),
)
def fact_audit(spark, sf):
    return R.fact_audit(R.fact_rows(V.payloads(spark, sf), F.col("now")))


@query(
    "append_requests",
    with_views(
        "payloads",
        """SELECT now AS ts, now AS created_at, now AS updated_at, trim(coalesce(entity, '')) AS entity, trim(note) AS note, 'incoming' AS status,
          source_submission_id, submitter, '[{"ts":' || now || ',"event":"incoming","detail":"added via web queue"}]' AS history, NULL AS source FROM payloads
        UNION ALL SELECT now, NULL, NULL, trim(coalesce(entity, '')), trim(note), 'incoming', NULL, NULL, NULL, coalesce(source, 'api') FROM payloads""",
    ),
)
def append_requests(spark, sf):
    rows = V.payloads(spark, sf)
    return R.append_requests(rows, rows, F.col("now")).withColumn("history", F.to_json("history"))


SUBMITTED = """SELECT 'sub-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 10) AS submission_id, now AS ts,
    strftime(make_timestamp(now * 1000000), '%Y-%m-%d %H:%M:%S') AS date, trim(coalesce(entity, '')) AS entity,
    coalesce(nullif(trim(player), ''), 'Unknown Player') AS player, coalesce(nullif(trim(request_type), ''), 'fact') AS request_type,
    trim(note) AS note, 'new' AS status FROM payloads"""


def submitted(spark, sf):
    return R.submission_rows(V.payloads(spark, sf), F.col("now"), F.col("event_id"))


query("append_submissions", with_views("payloads", SUBMITTED))(submitted)
ROUTED = """SELECT ts, ts AS created_at, ts AS updated_at, entity, '[' || player || '] ' || note AS note, 'incoming' AS status,
    submission_id AS source_submission_id, player AS submitter, '[{"ts":' || ts || ',"event":"incoming","detail":"added via web queue"}]' AS history
    FROM submissions WHERE entity <> '' AND note <> '' AND request_type IN ('research', 'update', 'question')"""
query("route_submissions", with_views("submissions", ROUTED))(
    lambda spark, sf: R.route_submissions(V.submissions(spark, sf)).withColumn("history", F.to_json("history"))
)
NOW = 1_700_000_000
LEGACY = "lower(trim(status)) IN ('researched', 'integrated')"
DONE_AT = "coalesce(completed_at, researched_at, ts)"
REQUEST_CTES = dict(
    queue="""SELECT *, CASE WHEN event_id % 5 = 0 THEN ts - 10 END AS created_at, CASE WHEN event_id % 5 = 1 THEN ts + 5 END AS updated_at,
      CASE WHEN event_id % 5 = 2 THEN ts + 9 END AS completed_at, CASE WHEN event_id % 5 = 3 THEN ts + 7 END AS researched_at, CASE WHEN event_id % 7 = 1 THEN ts + 3 END AS started_at,
      CASE WHEN event_id % 6 = 0 THEN '[{"ts":' || ts || ',"event":"incoming","detail":""}]' END AS history FROM requests""",
    opened="SELECT * FROM queue WHERE lower(trim(status)) IN ('incoming', 'pending') AND trim(entity) <> ''",
    names=r"""SELECT pos, canonical, unnest([canonical] || synonyms) AS n FROM catalog""",
    keyed="SELECT lower(n) AS k, min_by(canonical, pos) AS canonical FROM names GROUP BY lower(n)",
    resolved="SELECT o.*, k.canonical FROM opened o LEFT JOIN keyed k ON k = lower(trim(entity))",
    fresh="""SELECT (SELECT max(pos) FROM catalog) + 1 + min(request_id) AS pos, trim(min_by(entity, request_id)) AS canonical, min(request_id) AS first_id FROM resolved
      WHERE canonical IS NULL GROUP BY lower(trim(entity))""",
    all_names="SELECT pos, canonical, n FROM names UNION ALL SELECT pos, canonical, canonical FROM fresh",
    all_keyed="SELECT lower(n) AS k, min_by(canonical, pos) AS canonical FROM all_names GROUP BY lower(n)",
    settled="""SELECT r.* EXCLUDE (canonical), k.canonical, r.request_id IN (SELECT first_id FROM fresh) AS is_new
      FROM resolved r JOIN all_keyed k ON k = lower(trim(entity))""",
    extended="""SELECT pos, canonical, type, array_to_string(synonyms, '|') AS synonyms FROM catalog
      UNION ALL SELECT pos, canonical, 'Unknown', '' FROM fresh""",
)


def requests_sql(body: str, extra: str = "", **more: str) -> str:
    return with_views("requests catalog " + extra, body, **REQUEST_CTES, **more)


@query(
    "migrate_legacy_status",
    requests_sql(
        f"""SELECT request_id, CASE WHEN {LEGACY} THEN lower(trim(status)) END AS result, CASE WHEN {LEGACY} THEN 'completed' ELSE status END AS status,
        CASE WHEN {LEGACY} THEN {DONE_AT} ELSE completed_at END AS completed_at, CASE WHEN {LEGACY} THEN coalesce(created_at, ts) ELSE created_at END AS created_at,
        CASE WHEN {LEGACY} THEN coalesce(updated_at, {DONE_AT}) ELSE updated_at END AS updated_at,
        CASE WHEN {LEGACY} AND history IS NULL THEN '[{{"ts":' || {DONE_AT} || ',"event":"completed","detail":"migrated legacy status=' || lower(trim(status)) || '"}}]' ELSE history END AS history FROM queue"""
    ),
)
def migrate_legacy_status(spark, sf):
    out = R.migrate_legacy_status(V.requests(spark, sf), F.lit(NOW))
    return out.select(
        "request_id", "result", "status", "completed_at", "created_at", "updated_at", F.to_json("history").alias("history")
    )


def opened(spark, sf):
    return R.select_open_requests(V.requests(spark, sf))


def resolved(spark, sf):
    return M.resolve_canonical(opened(spark, sf), V.catalog(spark, sf))


query("select_open_requests", requests_sql("SELECT request_id, entity, status FROM opened"))(
    lambda spark, sf: opened(spark, sf).select("request_id", "entity", "status")
)
query("resolve_canonical", requests_sql("SELECT request_id, entity, canonical FROM resolved"))(
    lambda spark, sf: resolved(spark, sf).select("request_id", "entity", "canonical")
)
query("extend_catalog", requests_sql("SELECT * FROM extended"))(
    lambda spark, sf: M.extend_catalog(opened(spark, sf), V.catalog(spark, sf)).withColumn("synonyms", F.array_join("synonyms", "|"))
)

FOUND = dict(
    all_terms=f"SELECT DISTINCT canonical, {V.UNITS.format(x='lower(n)')} AS term, {V.WORDS.format(x='lower(n)')}[1] AS head FROM all_names WHERE n <> ''",
    logs=f"""SELECT 'doc' || doc_id AS source, line_no, text, {V.UNITS.format(x='lower(text)')} AS norm,
      unnest(list_distinct({V.WORDS.format(x='lower(text)')})) AS head FROM doc_lines""",
    page_lines=f"""SELECT *, {V.UNITS.format(x='lower(text)')} AS norm, unnest(list_distinct({V.WORDS.format(x='lower(text)')})) AS head
      FROM (SELECT 'conv' || conv_id AS source, turn AS page, unnest(string_split(text, {NL})) AS text,
        generate_subscripts(string_split(text, {NL}), 1) AS i FROM conversations)""",
    hits="""SELECT DISTINCT canonical, 0 AS dr, 'campaign' AS domain, source AS file, line_no AS place, source || '#L' || line_no AS source, substr(trim(text), 1, 280) AS excerpt
      FROM logs JOIN all_terms USING (head) WHERE contains(norm, term) UNION ALL
      SELECT canonical, 1, 'general', source, page, source || '#PAGE-' || page, min_by(substr(trim(text), 1, 280), i) FROM page_lines JOIN all_terms USING (head)
      WHERE contains(norm, term) GROUP BY canonical, source, page""",
    every_hit="SELECT canonical, row_number() OVER (PARTITION BY canonical ORDER BY dr, file, place) AS rank, domain, source, excerpt FROM hits",
    found=f"SELECT * FROM every_hit WHERE rank <= {R.MENTION_CAP}",
)


def searched(spark, sf):
    """The texts that a queue run searches: whole documents and conversations."""
    logs = V.documents(spark, sf).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), "text")
    pages = table(spark, sf, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("source"), F.col("turn").alias("page"), "text"
    )
    return logs, pages


def queue_run(spark, sf):
    """The tables that the steps of a queue run share."""
    return R.queue_run(V.requests(spark, sf), V.catalog(spark, sf), *searched(spark, sf))


def mentioned(spark, sf, cap=None):
    """Mentions of all names of the extended catalog, asked for or not."""
    _, extended = R.settle_queue(V.requests(spark, sf), V.catalog(spark, sf))
    return R.find_mentions(R.terms_of(extended), *searched(spark, sf), cap)


query("find_mentions", requests_sql("SELECT * FROM found", "doc_lines", **FOUND))(
    lambda spark, sf: mentioned(spark, sf, R.MENTION_CAP)
)
query("find_every_mention", requests_sql("SELECT * FROM every_hit", "doc_lines", **FOUND))(mentioned)


def slugs(spark, sf):
    """Slugs of existing entity articles: every third catalog name has one."""
    return V.catalog(spark, sf).where(F.col("pos") % 3 == 0).select(X.slug(F.col("canonical")).alias("slug"))


def completed(spark, sf, run=None):
    """Names count all their mentions; ``MENTION_CAP`` cuts the lists of dossiers only."""
    run = run or queue_run(spark, sf)
    return R.complete_requests(run.settled, run.counts, slugs(spark, sf), F.lit(NOW))


COMPLETED = dict(
    **FOUND,
    have=f"SELECT DISTINCT {slug_sql('canonical')} AS slug FROM catalog WHERE pos % 3 = 0",
    counts="SELECT canonical AS c, count(*) AS n FROM every_hit GROUP BY canonical",
    named="SELECT *, canonical AS resolved_entity FROM settled",
    completed=f"""SELECT *, {slug_sql('resolved_entity')} AS slug, coalesce(n, 0) AS n_mentions,
      CASE WHEN {slug_sql('resolved_entity')} IN (SELECT slug FROM have) THEN 'integrated' ELSE 'researched' END AS result FROM named LEFT JOIN counts ON c = resolved_entity""",
)
DETAIL = """CASE WHEN result = 'integrated' THEN 'already present in canonical campaign entities (integrated)'
    ELSE 'research dossier written (' || n_mentions || ' mentions)' END"""


@query(
    "complete_requests",
    requests_sql(
        f"""SELECT request_id, result, resolved_entity, n_mentions, CASE WHEN result = 'integrated' THEN 'entities/' ELSE 'requests/' END || slug || '.md' AS output,
        coalesce(created_at, ts) AS created_at, coalesce(started_at, CAST({NOW} AS BIGINT)) AS started_at, is_new, submitter FROM completed""",
        "doc_lines",
        **COMPLETED,
    ),
)
def complete_requests(spark, sf):
    return completed(spark, sf).select(
        "request_id", "result", "resolved_entity", "n_mentions", "output", "created_at", "started_at", "is_new", "submitter"
    )


@query(
    "append_history",
    requests_sql(
        f"""SELECT request_id, coalesce(substr(history, 1, length(history) - 1) || ',', '[') || '{{"ts":{NOW},"event":"in_progress","detail":"queue processor started work"}},'
        || '{{"ts":{NOW},"event":"completed","detail":"' || {DETAIL} || '"}}]' AS history FROM completed""",
        "doc_lines",
        **COMPLETED,
    ),
)
def append_history(spark, sf):
    return completed(spark, sf).select("request_id", F.to_json("history").alias("history"))


DOSSIERS = dict(
    **COMPLETED,
    last="SELECT * FROM completed WHERE result = 'researched' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY request_id DESC) = 1",
    every="""SELECT canonical AS resolved_entity, min_by(type, pos) AS type, min_by(syn, pos) AS syn FROM (
      SELECT pos, canonical, type, array_to_string(synonyms, ', ') AS syn FROM catalog UNION ALL SELECT pos, canonical, 'Unknown', '' FROM fresh) GROUP BY canonical""",
    lists="""SELECT canonical AS resolved_entity, string_agg('- **' || domain || '** - ' || excerpt || chr(10) || '  - Source: `' || source || '`', chr(10) ORDER BY rank) AS cited
      FROM found GROUP BY canonical""",
    dossiers="""SELECT slug, '# Campaign Entity Dossier: ' || resolved_entity || chr(10) || chr(10) || '- Pipeline status: **researched_from_queue**' || chr(10)
    || '- Queue status at processing: **' || lower(trim(status)) || '**' || chr(10) || '- Entity type: **' || type || '**' || chr(10)
    || '- Synonyms: ' || CASE WHEN syn = '' THEN '_None_' ELSE syn END || chr(10) || '- Requested as: **' || trim(entity) || '**' || chr(10)
    || '- Mentions found: **' || n_mentions || '**' || chr(10) || chr(10)
    || CASE WHEN note = '' THEN '' ELSE '- Request note: ' || note || chr(10) || chr(10) END
    || '## Cited Mentions' || chr(10) || chr(10) || coalesce(cited, '_No mentions found yet._') || chr(10) AS body
    FROM last JOIN every USING (resolved_entity) LEFT JOIN lists USING (resolved_entity)""",
)
# dossiers that stand before a run: one for each name of the passages
OLD = f"""SELECT DISTINCT {slug_sql('canonical')} AS slug, '# Campaign Entity Dossier: ' || min(canonical) || chr(10) || chr(10) || '- an old line' || chr(10) || '- an old line' || chr(10) AS body
    FROM catalog WHERE pos < 1000 GROUP BY slug"""
DIFFS = dict(
    **DOSSIERS,
    old=OLD,
    moved=f"""SELECT slug, line, sum(d) AS n FROM (SELECT slug, unnest(string_split(rtrim(body, {NL}), {NL})) AS line, 1 AS d FROM dossiers
      UNION ALL SELECT slug, unnest(string_split(rtrim(body, {NL}), {NL})), -1 FROM old WHERE slug IN (SELECT slug FROM dossiers)) GROUP BY slug, line HAVING sum(d) <> 0""",
    diffs=f"""SELECT slug, string_agg((CASE WHEN n > 0 THEN '+ ' ELSE '- ' END) || line || (CASE WHEN abs(n) > 1 THEN ' (' || abs(n) || ' times)' ELSE '' END), {NL} ORDER BY n > 0, line) AS diff
      FROM moved GROUP BY slug""",
)


def old_dossiers(spark, sf):
    name = F.col("canonical")
    body = F.concat(F.lit("# Campaign Entity Dossier: "), F.min(name), F.lit("\n\n- an old line\n- an old line\n"))
    return V.passage_names(spark, sf).groupBy(X.slug(name).alias("slug")).agg(body.alias("body"))


def dossiers(spark, sf):
    """(completed requests, their dossiers) of a run."""
    run = queue_run(spark, sf)
    done = completed(spark, sf, run)
    return done, R.dossier_rows(done, run.catalog, run.cited(R.MENTION_CAP))


@query(
    "request_audit",
    requests_sql(
        f"""SELECT source_submission_id AS submission_id, CAST({NOW} AS BIGINT) AS ts, 'completed' AS status, result, resolved_entity AS entity,
        concat_ws('|', {", ".join(chr(39) + w + chr(39) for w in R.WORK_LOG)}, CASE WHEN is_new THEN 'catalog entry created' END,
          CASE WHEN result = 'integrated' THEN 'existing entity dossier detected; no write needed' ELSE 'request dossier generated (' || n_mentions || ' mentions)' END) AS actions,
        CASE WHEN result = 'integrated' THEN '' ELSE 'requests/' || slug || '.md' END AS edited,
        CASE WHEN result = 'integrated' THEN '' ELSE substr(coalesce(diff, ''), 1, {R.DIFF_CAP}) END AS diff
        FROM completed LEFT JOIN diffs USING (slug) WHERE source_submission_id <> ''""",
        "doc_lines",
        **DIFFS,
    ),
)
def request_audit(spark, sf):
    done, new = dossiers(spark, sf)
    rows = R.request_audit(done, R.dossier_diffs(old_dossiers(spark, sf), new))
    return rows.select(
        "submission_id", "ts", "status", "result", "entity", F.array_join("actions", "|").alias("actions"),
        F.array_join("edited_docs.path", "|").alias("edited"), F.array_join("edited_docs.diff", "|").alias("diff"),
    )


query("dossier_rows", requests_sql("SELECT slug, body FROM dossiers", "doc_lines", **DOSSIERS))(lambda spark, sf: dossiers(spark, sf)[1])
query(
    "dossier_documents",
    requests_sql(
        "SELECT slug, body FROM dossiers UNION ALL SELECT slug, body FROM old WHERE slug NOT IN (SELECT slug FROM completed)", "doc_lines", **DIFFS
    ),
)(lambda spark, sf: R.dossier_documents(old_dossiers(spark, sf), *reversed(dossiers(spark, sf))))


@query(
    "document_changes",
    with_views(
        "dirty_docs",
        """SELECT key, line, CASE WHEN sum(d) > 0 THEN 'added' ELSE 'removed' END AS change, CAST(abs(sum(d)) AS BIGINT) AS n FROM (
          SELECT doc_id AS key, line, 1 AS d FROM after_lines UNION ALL SELECT doc_id, line, -1 FROM before_lines) GROUP BY key, line HAVING sum(d) <> 0""",
        **QT.CLEAN_CTES,
        before_lines=QT.dirty_lines("dirty_docs"),
        after_lines=QT.dirty_lines("cleaned"),
    ),
)
def document_changes(spark, sf):
    before = V.dirty_docs(spark, sf)
    after = clean_documents(before, V.FIXES)

    def split(docs):
        return S.doc_lines(docs).select(F.col("doc_id").alias("key"), F.col("text").alias("line"))

    return R.document_changes(split(before), split(after))


query(
    "queue_listing",
    requests_sql("SELECT request_id, entity, note, status, ts FROM queue ORDER BY ts DESC, request_id"),
)(lambda spark, sf: R.queue_listing(V.requests(spark, sf)))
query(
    "submissions_with_audit",
    with_views(
        "submissions audits",
        """SELECT s.submission_id, s.ts, entity, player, note, a.ts AS audit_ts, CASE WHEN a.submission_id IS NOT NULL THEN 'completed' END AS audit_status, work_log
        FROM submissions s LEFT JOIN audits a USING (submission_id) ORDER BY s.ts DESC, s.submission_id, a.ts""",
    ),
)(lambda spark, sf: R.submissions_with_audit(V.submissions(spark, sf), V.audits(spark, sf)))

# --- runs ------------------------------------------------------------------------------------------

ITEM = "concat('lib/', lang, '/b', doc_id, '.pdf')"


@query(
    "pending_documents",
    """SELECT 'lib/' || lang || '/b' || doc_id || '.pdf' AS path, 'lib__' || lang || '__b' || doc_id AS document FROM documents
    WHERE doc_id NOT IN (SELECT page_id FROM pages WHERE length(html) > 1200)""",
)
def pending_documents(spark, sf):
    docs = V.documents(spark, sf)
    sizes = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.length("html").alias("length"))
    outputs = docs.select("doc_id", O.document_key(F.expr(ITEM)).alias("document")).join(sizes, "doc_id")
    return O.pending_documents(docs.select(F.expr(ITEM).alias("path")), outputs, 1200)


STATUS = """SELECT document, CASE WHEN failed = 0 THEN 'ok' WHEN failed = pages THEN 'error' ELSE 'partial' END AS status, pages, failed AS failed_pages, chars, errors
    FROM (SELECT document, count(*) AS pages, count(*) FILTER (WHERE NOT ok) AS failed, CAST(coalesce(sum(chars) FILTER (WHERE ok), 0) AS BIGINT) AS chars,
      coalesce(array_to_string(list(error ORDER BY page) FILTER (WHERE NOT ok)[1:5], '|'), '') AS errors FROM run_pages GROUP BY document)"""


def statuses(spark, sf):
    return O.document_status(V.run_pages(spark, sf), sample=5)


query("document_status", with_views("run_pages", STATUS))(
    lambda spark, sf: statuses(spark, sf).withColumn(
        "errors", F.coalesce(F.array_join(F.col("errors.error"), "|"), F.lit(""))
    )
)
query("run_summary", with_views("run_pages", f"SELECT status, count(*) AS n FROM ({STATUS}) GROUP BY status"))(
    lambda spark, sf: O.run_summary(statuses(spark, sf))
)
query("document_key", "SELECT page_id, replace(replace(url, '/', '__'), '.pdf', '') AS document FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", O.document_key(F.col("url")).alias("document"))
)
query(
    "log_alerts",
    """SELECT source AS run, bool_or(hit) AS alert, count(*) FILTER (WHERE hit) AS n FROM (SELECT source,
      regexp_matches(unnest(string_split(text, chr(10))), '(?i)tion the|and und|que les') AS hit FROM documents) GROUP BY source""",
)(
    lambda spark, sf: O.log_alerts(
        S.doc_lines(V.documents(spark, sf), keep=["source"]).withColumnRenamed("source", "run"), "(?i)tion the|and und|que les"
    )
)


@query(
    "chars_delta",
    with_views(
        "dirty_docs",
        "SELECT doc_id AS document, length(d.text) AS chars, length(c.text) AS cleaned_chars FROM dirty_docs d JOIN cleaned c USING (doc_id)",
        **QT.CLEAN_CTES,
    ),
)
def chars_delta(spark, sf):
    raw = V.dirty_docs(spark, sf).withColumnRenamed("doc_id", "document")
    return O.chars_delta(raw, clean_documents(raw, V.FIXES))


# --- streams ---------------------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = logs.read_log(spark, sf, schema, "parquet", "events.parquet")
    return stream.withColumn("event_time", F.col("ts").cast("timestamp"))


def submission_stream(spark, sf):
    return event_stream(spark, sf).select(
        F.concat(F.lit("sub-"), F.col("event_id").cast("string")).alias("submission_id"),
        F.unix_seconds("event_time").alias("ts"),
        F.expr("if(user_id % 9 = 0, '', concat('user', user_id))").alias("entity"),
        F.expr("concat('p', user_id % 20)").alias("player"),
        F.expr(
            "CASE event_type WHEN 'click' THEN 'research' WHEN 'view' THEN 'question' WHEN 'error' THEN 'update' ELSE 'fact' END"
        ).alias("request_type"),
        F.expr("if(event_id % 10 = 0, '', props)").alias("note"),
        F.lit("new").alias("status"),
    )


@query("stream_ingest", "SELECT event_id, user_id, event_type FROM events")
def stream_ingest(spark, sf):
    root = fresh_dir(spark, "ingest")
    rows = event_stream(spark, sf).select("event_id", "user_id", "event_type")
    logs.drain(logs.stream_ingest(rows, f"{root}/table", f"{root}/progress"))
    return spark.read.parquet(f"{root}/table")


# Events come in four files of eight days; some pairs of events come one file late, some two.
DELIVERED = "least((extract(day from ts) - 1) {div} 8 + CASE (event_id {div} 2) % 97 WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 0 END, 3)"


def delivered(spark, sf, folder, files):
    """Write some of the files to the log that streams read."""
    events = table(spark, sf, "events").withColumn("file", F.expr(DELIVERED.format(div="div")))
    for i in files:
        events.where(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(folder)


def over_files(spark, sf, label, start):
    """Run a stream one file at a time, stop after two files, and go on from its progress; gives its folder."""
    root = fresh_dir(spark, label)
    for files in ((0, 1), (2, 3)):
        delivered(spark, sf, f"{root}/log", files)
        stream = logs.read_log(spark, f"{root}/log", table(spark, sf, "events").schema, "parquet", files=1)
        logs.drain(start(stream.withColumn("event_time", F.col("ts").cast("timestamp")), root))
    return root


# rows of the second run are late by the watermark that the first run has left; within a run it acts two files later
LATE = """WITH e AS (SELECT *, {file} AS file FROM events),
    w AS (SELECT file, CASE WHEN file >= 2 THEN (SELECT max(ts) FROM e WHERE file < 2) END AS seen FROM (SELECT DISTINCT file FROM e))"""
LATE = LATE.format(file=DELIVERED.format(div="//"))


@query(
    "stream_dedupe",
    LATE + " SELECT DISTINCT event_id // 2 AS submission_id FROM e JOIN w USING (file) WHERE seen IS NULL OR ts > seen - INTERVAL 2 DAY",
)
def stream_dedupe(spark, sf):
    def start(stream, root):
        rows = stream.select(F.expr("event_id div 2").alias("submission_id"), "event_time")
        return logs.stream_dedupe(rows, f"{root}/table", f"{root}/progress", delay="2 days")

    root = over_files(spark, sf, "dedupe", start)
    return spark.read.parquet(f"{root}/table").select("submission_id")


@query(
    "stream_latest_status",
    "SELECT user_id AS request_id, max_by(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id",
)
def stream_latest_status(spark, sf):
    root = fresh_dir(spark, "latest")
    rows = event_stream(spark, sf).select(
        F.col("user_id").alias("request_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")
    )
    logs.drain(logs.stream_latest_status(rows, f"{root}/table", f"{root}/progress", order=("seq",)))
    logs.compact(spark, f"{root}/table", f"{root}/state", order=("seq",))
    return logs.latest_table(spark, f"{root}/table", order=("seq",), state=f"{root}/state")


@query("stream_route", with_views("submissions", f"SELECT entity, note, source_submission_id FROM ({ROUTED})"))
def stream_route(spark, sf):
    root = fresh_dir(spark, "route")
    logs.drain(
        logs.stream_route(submission_stream(spark, sf), f"{root}/submissions", f"{root}/queue", f"{root}/progress")
    )
    return spark.read.parquet(f"{root}/queue").select("entity", "note", "source_submission_id")


@query(
    "stream_daily_sessions",
    LATE + """ SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM e JOIN w USING (file)
      WHERE seen IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > seen - INTERVAL 2 DAY GROUP BY day""",
)
def stream_daily_sessions(spark, sf):
    def start(stream, root):
        return logs.stream_daily_sessions(stream, f"{root}/table", f"{root}/progress", delay="2 days")

    root = over_files(spark, sf, "daily", start)
    return logs.day_table(spark, f"{root}/table", f"{root}/days")


@query(
    "stream_incremental_pages",
    with_views(
        "",
        """SELECT q.doc_id, q.text, label, word_count, quality_score, low_quality FROM cq_quality q
        LEFT JOIN (SELECT doc_id, quality AS label FROM labels) USING (doc_id)""",
        **{**QT.CLEAN_CTES, "flat": QT.CLEAN_CTES["flat"].replace("FROM dirty_docs", "FROM documents")},
        **QT.quality_ctes("cleaned", "doc_id", "cq_"),
    ),
)
def stream_incremental_pages(spark, sf):
    """Documents come in six parts; a first run takes three, two at a time, a second run only the other three.

    Each part is written by as many tasks as the documents have, one file each.
    """
    root = fresh_dir(spark, "pages")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    files = docs.withColumn("file", F.pmod(F.xxhash64("doc_id"), F.lit(6)))
    tasks = max(1, files.rdd.getNumPartitions())
    for half in ((0, 1, 2), (3, 4, 5)):
        for i in half:
            files.where(F.col("file") == i).drop("file").write.mode("append").parquet(f"{root}/log")
        stream = logs.read_log(spark, f"{root}/log", docs.schema, "parquet", files=2 * tasks)
        work = lambda df: logs.quality_pages(df, V.FIXES, labels)
        logs.drain(logs.stream_incremental_pages(stream, work, f"{root}/table", f"{root}/progress"))
    return spark.read.parquet(f"{root}/table")

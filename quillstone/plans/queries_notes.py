"""Registered queries on mentions, profiles, sessions and the manifest, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import manifest as MF
from quillstone.operators import mentions as M
from quillstone.operators import profiles as P
from quillstone.operators import sessions as S
from quillstone.plans import views as V
from quillstone.plans.queries_text import title_sql
from quillstone.plans.views import table, with_views
from quillstone.sources.storage import stored

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


def slug_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower({x}), '/', '-'), ' ', '-'), '[^a-z0-9-]+', '-', 'g'), '-')"


def key_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(trim({x})), '^entity\s*:\s*', ''), '[^a-z0-9]+', '-', 'g'), '-')"


# --- aliases and mentions --------------------------------------------------------------------------

NAME_SQL = "p_name || (CASE WHEN p_partkey % 3 = 0 THEN ' / ' || p_brand ELSE '' END)"
NAME = "concat(p_name, if(p_partkey % 3 = 0, concat(' / ', p_brand), ''))"


@query(
    "slugify",
    f"""SELECT p_partkey, {slug_sql(NAME_SQL)} AS slug,
    trim(regexp_replace(lower({NAME_SQL}), '[^a-z0-9-]+', '-', 'g'), '-') AS import_slug FROM part""",
)
def slugify(spark, sf):
    name = F.expr(NAME)
    return table(spark, sf, "part").select(
        "p_partkey", X.slug(name).alias("slug"), X.slug(name, split_separators=False).alias("import_slug")
    )


def aliases(spark, sf):
    return M.expand_aliases(V.catalog(spark, sf))


def alias_keys(spark, sf):
    return M.dedupe_aliases(aliases(spark, sf))


query("expand_aliases", with_views("aliases", "SELECT pos, canonical, alias, idx FROM aliases"))(aliases)
query("dedupe_aliases", with_views("alias_keys", "SELECT alias_key, pos, canonical, alias FROM alias_keys"))(alias_keys)


def known(spark, sf):
    """The catalog, which several steps read, written once."""
    return stored(V.catalog(spark, sf), "catalog")


def log_lines(spark, sf, keys=None):
    return M.mention_lines(V.notes(spark, sf), alias_keys(spark, sf) if keys is None else keys)


def input_lines(spark, sf, catalog=None, keys=None):
    catalog = known(spark, sf) if catalog is None else catalog
    keys = M.dedupe_aliases(M.expand_aliases(catalog)) if keys is None else keys
    return M.input_lines(V.player_inputs(spark, sf), keys, catalog, "inputs")


def log_mentions(spark, sf):
    return M.match_mentions(V.notes(spark, sf), alias_keys(spark, sf))


def input_mentions(spark, sf):
    return M.match_player_inputs(V.player_inputs(spark, sf), alias_keys(spark, sf), V.catalog(spark, sf), "inputs")


def mentions(spark, sf, catalog=None):
    """Lines of notes and inputs with the entities they mention."""
    catalog = known(spark, sf) if catalog is None else catalog
    keys = stored(M.dedupe_aliases(M.expand_aliases(catalog)), "aliases")
    return M.all_mentions(log_lines(spark, sf, keys), input_lines(spark, sf, catalog, keys))


query("match_mentions", with_views("log_mentions", "SELECT * FROM log_mentions"))(log_mentions)
query(
    "line_with_context",
    with_views("context_lines", "SELECT source, line_no, context FROM context_lines"),
)(
    lambda spark, sf: M.lines_with_context(V.notes(spark, sf), ["source"]).select("source", "line_no", "context")
)
query("session_title", with_views("notes", "SELECT source, session FROM notes"))(
    lambda spark, sf: V.notes(spark, sf).select("source", "session")
)
query("match_player_inputs", with_views("input_mentions", "SELECT * FROM input_mentions"))(input_mentions)
EVERY = "SELECT * FROM mentions UNION ALL SELECT * FROM import_mentions ORDER BY src_rank, source, line_no"


@query("all_mentions", with_views("mentions import_mentions", EVERY))
def all_mentions(spark, sf):
    """Mentions in notes, imports and inputs, in reading order."""
    catalog = known(spark, sf)
    keys = stored(M.dedupe_aliases(M.expand_aliases(catalog)), "aliases")
    imported = M.mention_lines(V.imports(spark, sf), keys, src_rank=1)
    every = M.all_mentions(log_lines(spark, sf, keys), imported, input_lines(spark, sf, catalog, keys))
    return M.by_name(every.orderBy("src_rank", "source", "line_no"))



# --- profiles --------------------------------------------------------------------------------------

GROUP = "CASE upper(trim(type)) WHEN 'PC' THEN 'PCs' WHEN 'NPC' THEN 'NPCs' ELSE 'Unclassified' END"
COUNTS = "SELECT c.*, (SELECT count(*) FROM mentions m WHERE m.canonical = c.canonical) AS citations FROM catalog c"


def any_of(words, text="lower(text)"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


ORDERED = "SELECT *, source || '#L' || line_no AS cite FROM mentions"


def first_distinct(keys: str, source: str, n: int) -> str:
    """First n distinct texts per key in reading order."""
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY src_rank, source, line_no) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys}, text ORDER BY src_rank, source, line_no) AS dup FROM {source})
        WHERE dup = 1 QUALIFY rank <= {n}"""


FACET_ROWS = " UNION ALL ".join(
    f"SELECT *, '{name}' AS facet, {i} AS facet_rank FROM ordered WHERE {any_of(words)}" for i, (name, words) in enumerate(V.FACETS)
)
DEATH = "regexp_matches(text, '" + V.DEATH + "')"
ALIVE = "regexp_matches(text, '" + V.ALIVE + "')"
PLACE = "{'r': src_rank, 's': source, 'l': line_no}"
TAG_SQL = "concat_ws('|', " + ", ".join(
    f"CASE WHEN bool_or({any_of(words)}) THEN '{name}' END" for name, words in V.TAG_RULES
) + ")"
PROFILE = dict(
    ordered=ORDERED,
    counts=COUNTS,
    facet_rows=FACET_ROWS,
    facets=f"SELECT canonical, facet, facet_rank, rank, text, cite AS source FROM ({first_distinct('canonical, facet', 'facet_rows', 3)})",
    timeline="""SELECT canonical, row_number() OVER (PARTITION BY canonical ORDER BY src_rank, source, line_no) AS rank, session, text,
      cite AS source FROM ordered QUALIFY rank <= 6""",
    notable_rows=f"SELECT * FROM ordered WHERE {any_of(V.NOTABLE)}",
    notable=f"SELECT canonical, rank, session, text, cite AS source FROM ({first_distinct('canonical', 'notable_rows', 5)})",
    passing=f"""SELECT canonical, min_by(session, {PLACE}) AS session, min_by(text, {PLACE}) AS text, min_by(cite, {PLACE}) AS source
      FROM ordered WHERE {DEATH} GROUP BY canonical""",
    conflicts=f"""SELECT canonical, min_by(cite, {PLACE}) FILTER (WHERE {DEATH}) AS death_source, min_by(cite, {PLACE}) FILTER (WHERE {ALIVE}) AS alive_source
      FROM ordered GROUP BY canonical HAVING bool_or({DEATH}) AND bool_or({ALIVE})""",
    tags=f"SELECT canonical, {TAG_SQL} AS tags FROM ordered GROUP BY canonical",
    sections="""SELECT canonical, facet_rank AS section_rank, rank AS item_rank, source FROM facets
      UNION ALL SELECT canonical, 4, rank, source FROM timeline UNION ALL SELECT canonical, 5, rank, source FROM notable
      UNION ALL SELECT canonical, 6, 1, source FROM passing UNION ALL SELECT canonical, 7, 1, death_source FROM conflicts
      UNION ALL SELECT canonical, 7, 2, alive_source FROM conflicts""",
    refs="""SELECT canonical, source, row_number() OVER (PARTITION BY canonical ORDER BY o) AS ref_no
      FROM (SELECT canonical, source, min({'s': section_rank, 'i': item_rank}) AS o FROM sections GROUP BY canonical, source)""",
)


def profile(body: str) -> str:
    return with_views("mentions catalog", body, **PROFILE)


def sections(spark, sf):
    return P.section_rows(mentions(spark, sf), V.FACETS, V.NOTABLE, V.DEATH, V.ALIVE)


query(
    "coverage_index",
    profile(f"SELECT {GROUP} AS group_name, canonical, citations, {slug_sql('canonical')} AS slug, pos FROM counts"),
)(lambda spark, sf: P.coverage_index(c := known(spark, sf), mentions(spark, sf, c)))
query("entity_facets", profile("SELECT canonical, facet, rank, text, source FROM facets"))(
    lambda spark, sf: P.entity_facets(mentions(spark, sf), V.FACETS)
)
query("continuity_conflicts", profile("SELECT * FROM conflicts"))(
    lambda spark, sf: P.continuity_conflicts(mentions(spark, sf), V.DEATH, V.ALIVE)
)
query("entity_tags", profile("SELECT * FROM tags"))(
    lambda spark, sf: P.entity_tags(mentions(spark, sf), V.TAG_RULES).withColumn("tags", F.array_join("tags", "|"))
)


def opinion_sql() -> str:
    def chain(choices):
        whens, last = [], "''"
        for tag, text in choices:
            said = "replace('" + text.replace("'", "''") + "', '{name}', canonical)"
            if tag is None:
                last = said
            else:
                whens.append(f"WHEN contains(tags, '{tag}') THEN {said}")
        return f"(CASE {' '.join(whens)} ELSE {last} END)" if whens else last

    kinds = [f"WHEN '{k}' THEN {chain(c)}" for k, c in P.OPINIONS.items() if k]
    return f"CASE upper(type) {' '.join(kinds)} ELSE {chain(P.OPINIONS[''])} END"


def said(key: str, **fields: str) -> str:
    """A sentence of the profile as SQL."""
    out = "'" + P.SENTENCES[key].replace("'", "''") + "'"
    for field, value in (*fields.items(), ("name", "canonical")):
        out = f"replace({out}, '{{{field}}}', {value})"
    return out


PROFILE["summaries"] = f"""SELECT canonical, CASE WHEN n IS NULL THEN {said('unknown')}
      ELSE {said('described', label="coalesce(nullif(replace(tags, '|', ' and '), ''), 'recurring')", session='first_session')} END AS description,
    CASE WHEN n IS NULL THEN {said('no_summary')} ELSE {said('summary', n='CAST(n AS VARCHAR)')} END AS summary,
    CASE WHEN n IS NULL THEN '{P.NO_OPINION}' WHEN n < 2 THEN '{P.FEW_DATA}' ELSE {opinion_sql()} END AS opinion
    FROM catalog LEFT JOIN tags USING (canonical) LEFT JOIN (SELECT canonical, count(*) AS n, min_by(session, {PLACE}) AS first_session FROM ordered GROUP BY canonical) USING (canonical)"""
query("entity_summary_text", profile("SELECT * FROM summaries"))(
    lambda spark, sf: P.entity_summary(c := known(spark, sf), mentions(spark, sf, c), V.TAG_RULES)
)
query("entity_timeline", profile("SELECT * FROM timeline"))(lambda spark, sf: P.entity_timeline(mentions(spark, sf)))
query("notable_events", profile("SELECT * FROM notable"))(
    lambda spark, sf: P.notable_events(mentions(spark, sf), V.NOTABLE)
)
query("passing_record", profile("SELECT * FROM passing"))(
    lambda spark, sf: P.passing_record(mentions(spark, sf), V.DEATH)
)
query("reference_numbers", profile("SELECT * FROM refs"))(
    lambda spark, sf: P.reference_numbers(sections(spark, sf))
)
query(
    "target_filter",
    with_views(
        "catalog",
        f"""SELECT pos, canonical FROM catalog WHERE contains(lower(canonical), 'th') OR {slug_sql('canonical')} = 'th'""",
    ),
)(lambda spark, sf: M.target_filter(V.catalog(spark, sf), " Th ").select("pos", "canonical"))
query(
    "entity_index",
    profile("SELECT canonical, type, array_to_string(synonyms, '|') AS synonyms, citations AS citation_count FROM counts"),
)(
    lambda spark, sf: P.entity_index(c := known(spark, sf), mentions(spark, sf, c)).withColumn(
        "synonyms", F.array_join("synonyms", "|")
    )
)
BASE = len(V.FACETS)
GAP = "chr(10) || chr(10)"
PROFILE["items"] = f"""SELECT canonical, facet_rank AS section, rank AS item, source, '- ' || text || ' ' AS said FROM facets
    UNION ALL SELECT canonical, {BASE}, rank, source, '- **' || session || '** — ' || text || ' ' FROM timeline
    UNION ALL SELECT canonical, {BASE + 1}, rank, source, '- ' || text || ' ' FROM notable
    UNION ALL SELECT canonical, {BASE + 2}, 1, source, '- ' || text || ' ' FROM passing
    UNION ALL SELECT canonical, {BASE + 3}, 1, death_source, '- conflicting survival language ' FROM conflicts
    UNION ALL SELECT canonical, {BASE + 3}, 2, alive_source, '- conflicting survival language ' FROM conflicts"""
PROFILE["blocks"] = f"""SELECT canonical, section, string_agg(said || '[[' || ref_no || ']]', {NL} ORDER BY item) AS block
    FROM items JOIN refs USING (canonical, source) GROUP BY canonical, section"""
PROFILE["listed"] = f"SELECT canonical, string_agg('- [' || ref_no || '] `' || source || '`', {NL} ORDER BY ref_no) AS reference_list FROM refs GROUP BY canonical"
TITLES = [f"### {P.FACET_LABELS.get(name, name)}" for name, _ in V.FACETS] + [title for title, _ in P.SECTIONS]
NOTHING = [P.NO_FACET] * BASE + [nothing for _, nothing in P.SECTIONS]
PARTS = f" || {GAP} || ".join(
    f"'{title}' || {GAP} || coalesce((SELECT block FROM blocks b WHERE b.canonical = c.canonical AND section = {i}), '{nothing}')"
    for i, (title, nothing) in enumerate(zip(TITLES, NOTHING, strict=True))
)
DOCUMENT = f"""SELECT c.canonical, {slug_sql('c.canonical')} AS slug, '# Campaign ' || CASE upper(trim(type)) WHEN 'PC' THEN 'PC' WHEN 'NPC' THEN 'NPC' ELSE 'Entity' END || ': ' || c.canonical
    || {GAP} || '- Entity type: **' || type || '**' || {NL} || '- Synonyms: ' || CASE WHEN len(synonyms) > 0 THEN array_to_string(synonyms, ', ') ELSE '_None_' END
    || {NL} || '- Citation count: **' || citations || '**' || {GAP} || '## Description' || {GAP} || description || {GAP} || '## Summary' || {GAP} || summary
    || {GAP} || '## Opinion' || {GAP} || opinion || {GAP} || '## Profile facets' || {GAP} || {PARTS}
    || {GAP} || '## References' || {GAP} || coalesce(reference_list, '{P.NO_REFERENCES}') AS body
    FROM counts c JOIN summaries s ON s.canonical = c.canonical LEFT JOIN listed l ON l.canonical = c.canonical"""
query("entity_document", profile(DOCUMENT))(
    lambda spark, sf: P.entity_document(
        c := known(spark, sf), mentions(spark, sf, c), V.FACETS, V.NOTABLE, V.DEATH, V.ALIVE, V.TAG_RULES
    )
)

# --- sessions --------------------------------------------------------------------------------------

DATE = "replace(replace(regexp_extract({t}, '20[0-9]{{2}}[-_/][0-9]{{2}}[-_/][0-9]{{2}}'), '_', '-'), '/', '-')"
CHUNKS = dict(
    rows=f"""SELECT source, name, line, n, nullif({DATE.format(t='line')}, '') AS d FROM (SELECT source, name,
      unnest(string_split(text, {NL})) AS line, CAST(generate_subscripts(string_split(text, {NL}), 1) AS BIGINT) AS n FROM note_docs)""",
    marked="""SELECT *, sum(CASE WHEN trim(line) LIKE '#%' AND d IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) AS seg,
      trim(line) LIKE '#%' AND d IS NOT NULL AS head FROM rows""",
    segs=f"""SELECT source, seg, CASE WHEN seg = 0 THEN min_by(d, n) FILTER (WHERE d IS NOT NULL) ELSE max(d) FILTER (WHERE head) END AS date,
      CASE WHEN seg = 0 THEN min(n) FILTER (WHERE d IS NOT NULL) ELSE min(n) + 1 END AS start_line, max(n) AS end_line,
      trim(coalesce(string_agg(line, {NL} ORDER BY n) FILTER (WHERE NOT head), ''), ' ' || {NL}) AS content FROM marked GROUP BY source, seg""",
    dated="SELECT date, source, start_line, end_line, content FROM segs WHERE date IS NOT NULL AND content <> ''",
    fallback=f"""SELECT nullif({DATE.format(t='name')}, '') AS date, source, CAST(1 AS BIGINT) AS start_line,
      CAST(len(string_split(text, {NL})) AS BIGINT) AS end_line, trim(text, ' ' || {NL}) AS content FROM note_docs
      WHERE source NOT IN (SELECT source FROM dated) AND nullif({DATE.format(t='name')}, '') IS NOT NULL AND trim(text, ' ' || {NL}) <> ''""",
    chunks="SELECT * FROM dated UNION ALL SELECT * FROM fallback",
)


def sessions_sql(body: str) -> str:
    return with_views("note_docs", body, **CHUNKS)


def chunks(spark, sf):
    return S.session_chunks(V.note_docs(spark, sf))


query("norm_date", with_views("note_docs", f"SELECT source, nullif({DATE.format(t='text')}, '') AS date FROM note_docs"))(
    lambda spark, sf: V.note_docs(spark, sf).select("source", X.norm_date(F.col("text")).alias("date"))
)
query("session_chunks", sessions_sql("SELECT * FROM chunks"))(chunks)
query("filename_date_fallback", sessions_sql("SELECT * FROM fallback"))(
    lambda spark, sf: S.filename_date_fallback(V.note_docs(spark, sf))
)
query(
    "session_group",
    sessions_sql("SELECT *, row_number() OVER (PARTITION BY date ORDER BY source, start_line) AS chunk_no FROM chunks"),
)(lambda spark, sf: S.session_group(chunks(spark, sf)))
query(
    "session_index",
    sessions_sql(
        """SELECT date, count(*) AS chunks, (SELECT count(DISTINCT date) FROM chunks) AS sessions,
        (SELECT count(*) FROM note_docs) AS input_files FROM chunks GROUP BY date ORDER BY date"""
    ),
)(lambda spark, sf: S.session_index(chunks(spark, sf), V.note_docs(spark, sf)))


def intro(spark, sf):
    manifest = table(spark, sf, "customer").select(
        F.expr("concat(' customer_', c_custkey)").alias("entity"),
        F.expr("if(c_custkey % 5 = 0, 'general', ' Campaign')").alias("scope"),
        F.expr("array('facts.jsonl', concat('t/', c_custkey, '.timeline.jsonl'), 'x.timeline.jsonl')").alias("jsonl_files"),
    )
    events = table(spark, sf, "events").select(
        F.expr("concat('t/', user_id, '.timeline.jsonl')").alias("file"),
        F.col("event_id").alias("seq"),
        F.expr("if(user_id % 7 = 0, concat('Session ', user_id), date_format(ts, 'yyyy-MM-dd'))").alias("date_or_session"),
        F.expr("repeat(concat('**', event_type, '** #', user_id, ', '), cast(user_id % 9 AS int))").alias("text"),
    )
    return S.first_event_per_entity(manifest, events)


CLIP = """CASE WHEN {c} = '' THEN 'first campaign mention' WHEN length({c}) <= {n} THEN {c}
    ELSE rtrim(CASE WHEN contains(substr({c}, 1, {n} - 1), ' ') THEN rtrim(regexp_replace(substr({c}, 1, {n} - 1), '(?s) [^ ]*$', '')) ELSE substr({c}, 1, {n} - 1) END, ' ,;:.') || '…' END"""


def clip_sql(t: str, n: int = 80) -> str:
    c = rf"trim(regexp_replace(regexp_replace({t}, '[*_`#>\-\x{{2022}}]+', ' ', 'g'), '\s+', ' ', 'g'))"
    return CLIP.format(c=c, n=n)


INTRO = dict(
    firsts="""SELECT user_id, min_by(ts, event_id) AS ts, min_by(event_type, event_id) AS event_type FROM events GROUP BY user_id""",
    intro=f"""SELECT 'customer_' || c_custkey AS entity, 'Customer ' || c_custkey AS display_name,
      CASE WHEN user_id % 7 = 0 THEN 'Session ' || user_id ELSE strftime(ts, '%Y-%m-%d') END AS date_or_session,
      {clip_sql("repeat('**' || event_type || '** #' || user_id || ', ', user_id % 9)")} AS text, 't/' || user_id || '.timeline.jsonl' AS source
      FROM customer JOIN firsts ON c_custkey = user_id WHERE c_custkey % 5 <> 0""",
)
query("first_event_per_entity", with_views("", "SELECT * FROM intro", **INTRO))(intro)
query(
    "intro_order",
    with_views(
        "",
        """SELECT * FROM intro ORDER BY date_or_session LIKE 'Session%', CASE WHEN date_or_session NOT LIKE 'Session%' THEN date_or_session END,
        lower(date_or_session), lower(display_name)""",
        **INTRO,
    ),
)(lambda spark, sf: S.intro_order(intro(spark, sf)))
query("clip_text", f"SELECT doc_id, {clip_sql('text')} AS text FROM documents")(
    lambda spark, sf: V.documents(spark, sf).select("doc_id", X.clip(F.col("text")).alias("text"))
)
DISPLAY = "trim(regexp_replace(regexp_replace(p_name || '_' || p_brand || '-3d', '[-_]+', ' ', 'g'), ' +', ' ', 'g'))"
query("display_name", f"SELECT p_partkey, {title_sql(DISPLAY)} AS display_name FROM part")(
    lambda spark, sf: table(spark, sf, "part").select(
        "p_partkey", X.display_name(F.concat("p_name", F.lit("_"), "p_brand", F.lit("-3d"))).alias("display_name")
    )
)


def plain_sql(t: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace({t}, '[:;]', ' -', 'g'), '["`{{}}\[\]()<>]', '', 'g'), '\s+', ' ', 'g'))"""


SKIP = " OR ".join(f"starts_with(lower(x), '{w}')" for w in S.NOT_CONTENT)
SUMMARY = dict(
    two=f"""SELECT doc_id, list_filter(list_transform(string_split(text, {NL}), lambda x: trim(x)), lambda x: length(x) >= 20 AND NOT ({SKIP}))[1:2] AS c FROM documents""",
    parts=f"SELECT doc_id, len(c) AS n, {plain_sql(clip_sql('c[1]', 90))} AS a, {plain_sql(clip_sql('c[2]', 70))} AS b FROM two",
    summaries=f"""SELECT doc_id, CASE WHEN n = 0 THEN '{S.NO_SUMMARY}' WHEN n = 1 OR contains(lower(a), lower(b)) THEN a
      ELSE {plain_sql(clip_sql("(a || ' - ' || b)", 120))} END AS summary FROM parts""",
)
query("session_summary", with_views("", "SELECT doc_id, summary FROM summaries", **SUMMARY))(
    lambda spark, sf: S.session_summary(V.documents(spark, sf))
)
query("plain_text", f"SELECT page_id, {plain_sql('html')} AS text FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", X.plain_text(F.col("html")).alias("text"))
)


def session_docs(spark, sf):
    """Session documents with source lines: the links of a page name its sources."""
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.concat(F.lit("s/"), F.col("page_id").cast("string")).alias("path"),
        F.expr(
            "if(page_id % 4 = 0, concat('note', page_id, '.md'), date_format(date_add(DATE'2020-01-01', cast(page_id AS int)), 'yyyy-MM-dd.\\'md\\''))"
        ).alias("name"),
        F.expr(
            r"""concat_ws('\n', '# head', 'Session text of page with links', array_join(transform(
            regexp_extract_all(html, 'href="/([^"]*)"', 1), x -> concat('Source: `dir/', x, '`')), '\n'))"""
        ).alias("text"),
    )


def source_table(spark, sf):
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)))
    return table(spark, sf, "benchmark").select(words.alias("name"), (F.col("item_id") % 2).alias("root_rank")).distinct().select(
        "name", "root_rank", F.concat(F.lit("root"), F.col("root_rank").cast("string"), F.lit("/"), "name").alias("path")
    )


REFS = dict(
    src=r"SELECT DISTINCT unnest(list_distinct(regexp_extract_all(text, '\p{L}+'))) AS name, item_id % 2 AS root_rank FROM benchmark",
    best="SELECT name, 'root' || max(root_rank) || '/' || name AS path FROM src GROUP BY name",
    uses="""SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name,
      generate_subscripts(regexp_extract_all(html, 'href="/([^"]*)"', 1), 1) + 1 AS pos FROM pages""",
    refs="""SELECT page_id AS doc_id, min(CAST(pos AS BIGINT)) AS pos, coalesce(path, name) AS ref FROM uses LEFT JOIN best USING (name)
      GROUP BY page_id, coalesce(path, name)""",
)
query("session_source_refs", with_views("", "SELECT * FROM refs", **REFS))(
    lambda spark, sf: S.session_source_refs(session_docs(spark, sf), source_table(spark, sf))
)
query(
    "session_events",
    with_views(
        "",
        f"""SELECT strftime(DATE '2020-01-01' + CAST(page_id AS INTEGER), '%Y-%m-%d') AS date,
        'Session text of page with links' AS summary, 's/' || page_id AS source,
        coalesce((SELECT string_agg(ref, {NL} ORDER BY pos) FROM refs WHERE doc_id = page_id), '') AS refs FROM pages WHERE page_id % 4 <> 0
        ORDER BY date""",
        **REFS,
    ),
)(lambda spark, sf: S.session_events(session_docs(spark, sf), source_table(spark, sf)))

# --- manifest --------------------------------------------------------------------------------------


def campaign(spark, sf):
    return table(spark, sf, "part").select(F.expr("concat('Entity: ', p_name, '_', p_partkey % 400)").alias("entity"), "p_partkey")


def general(spark, sf):
    return table(spark, sf, "part").select(F.expr("concat(p_name, ' ', p_partkey % 90)").alias("entity"), "p_partkey")


PARTS = dict(
    campaign="SELECT 'Entity: ' || p_name || '_' || (p_partkey % 400) AS entity, p_partkey FROM part",
    general="SELECT p_name || ' ' || (p_partkey % 90) AS entity, p_partkey FROM part",
    kept=f"SELECT * FROM campaign WHERE {key_sql('entity')} NOT IN (SELECT {key_sql('entity')} FROM general)",
)
query(
    "entity_files",
    with_views(
        "entity_files",
        """SELECT scope, entity, coalesce(string_agg(path, '|' ORDER BY lower(name), name, path) FILTER (WHERE kind = 'md'), '') AS md_files,
        coalesce(string_agg(path, '|' ORDER BY lower(name), name, path) FILTER (WHERE kind = 'jsonl'), '') AS jsonl_files FROM entity_files GROUP BY scope, entity""",
    ),
)(
    lambda spark, sf: MF.manifest_rows(V.entity_file_list(spark, sf))
    .withColumn("md_files", F.array_join("md_files", "|"))
    .withColumn("jsonl_files", F.array_join("jsonl_files", "|"))
)
query("prefer_subsections", with_views("entity_files", "SELECT scope, entity, kind, name, path FROM entity_files"))(
    lambda spark, sf: MF.entity_files(V.entity_file_list(spark, sf))
)
query("norm_entity_key", f"SELECT p_partkey, {key_sql(chr(39) + ' Entity :  ' + chr(39) + ' || p_name || p_brand')} AS key FROM part")(
    lambda spark, sf: table(spark, sf, "part").select(
        "p_partkey", X.entity_key(F.concat(F.lit(" Entity :  "), "p_name", "p_brand")).alias("key")
    )
)
query(
    "suppress_duplicates",
    with_views("", "SELECT entity, p_partkey, (SELECT count(*) FROM campaign) - (SELECT count(*) FROM kept) AS skipped FROM kept", **PARTS),
)(
    lambda spark, sf: MF.suppress_duplicates(campaign(spark, sf), general(spark, sf)).withColumn(
        "skipped", MF.skipped_count(campaign(spark, sf), general(spark, sf)).scalar()
    )
)
query("manifest_union", with_views("", "SELECT * FROM kept UNION ALL SELECT * FROM general", **PARTS))(
    lambda spark, sf: MF.manifest_union(campaign(spark, sf), general(spark, sf))
)

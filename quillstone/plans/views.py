"""Input tables of the registered queries, derived row by row from the given tables.

Each view exists twice, as DataFrame and as SQL text for the comparison engine, by the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lexicons on words that occur in the test documents.
# no word boundaries, because their meaning differs between regular-expression engines
PLAIN_TOPICS = (
    ("articles", ("the", "th[a-z]*")),
    ("joining", ("and", "with")),
    ("places", ("ther", "inst")),
    ("endings", ("tion", "ing")),
    ("absent", ("zzyzx",)),
)
PLAIN_ENTITIES = (
    ("Ther", "ther[a-z]"),
    ("Nation", "tion|ation"),
    ("French", "aux|que"),
    ("German", "schaft|ung"),
    ("Absent", "zzyzx"),
)
FACETS = (
    ("first", ("the ", "and ")),
    ("second", ("tion", "ment")),
    ("third", ("que", "sch")),
    ("fourth", ("zzyzx",)),
)
TAG_RULES = (
    ("matrix-active", ("ther", "eau")),
    ("field-tech", ("zzyzx",)),
    ("social-connector", ("ing", "que")),
    ("combat-capable", ("tion",)),
)
NOTABLE = ("that", "dans", "und")
DEATH = r"(?i)(the|que|und)"
ALIVE = r"(?i)(was|les|der)"
FIXES = (("tion", "tlon"), ("tlon.", "tion!"), ("eau", "eo"))
PLAN = ((1, 2, "opening"), (3, 5, "middle"), (4, 9, "overlap"), (10, 40, "rest"), (900, 999, "none"))


LONG_NAME = r"(\p{L}+,? ){19}\p{L}+"

# tables with much work per row, and the columns that tell their rows apart
TEXT_TABLES = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; a small text table is dealt out over all cores, in more tasks the more splits it has.

    A text needs far more work than reading it, and a small file is one row group, thus one task. When
    the scan has few splits for the cores there are, the rows are spread by their key; a large table has
    many splits and is left as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and (splits := df.rdd.getNumPartitions()) < 4 * cores:
        return df.repartition(max(cores, 4 * splits), *TEXT_TABLES[name])
    return df


def documents(spark, sf):
    return table(spark, sf, "documents")


def book_pages(spark, sf):
    return documents(spark, sf).select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")


def marked_docs(spark, sf):
    return documents(spark, sf).select(
        F.col("doc_id").alias("book"),
        F.expr(
            r"""concat('front matter\n', array_join(transform(split(text, '\n'), (x, i) ->
            if(i % 3 = 0, concat('===== PAGE ', if(doc_id % 5 = 0 AND i = 6, 1, i div 3 + 1), ' =====\n', x), x)), '\n'))"""
        ).alias("text"),
    )


def para_pages(spark, sf):
    """Pages of three lines each: book = doc_id; some pages are missing, some failed."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("i", "text")
    ).select("book", (F.col("i") + 1).cast("long").alias("page"), "text")


def page_plan(spark, sf):
    """Ranges of pages to cut out, a few of each book."""
    from quillstone.operators.pages import plan_table

    books = table(spark, sf, "documents").select(F.col("doc_id").alias("book"))
    own = books.select(
        "book", (F.col("book") % 7 + 1).alias("a"), (F.col("book") % 7 + 3 + F.col("book") % 3 * 40).alias("b"), F.lit("own").alias("hint")
    )
    return plan_table(books, PLAN).unionByName(own)


def engine_a(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where(F.col("role") == "user").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")


def engine_b(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("book"), (F.col("turn") - 1).alias("page"), "text"
    )


def dirty_docs(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        F.expr(
            r"""replace(array_join(transform(split(text, '\n'), (x, i) -> concat(
            if((doc_id + i) % 7 = 0, '<|ref|>junk<|/ref|>', ''), x,
            if((doc_id + i) % 5 = 0, concat('\n', x), ''),
            if((doc_id + i) % 6 = 0, concat('\n', i + 1), ''),
            if((doc_id + i) % 9 = 0, concat('\nPage  ', i), ''),
            if((doc_id + i) % 4 = 0, '\n\n\n', ''),
            if((doc_id + i) % 3 = 0, concat('\n', lower(x)), ''))), '\n'), 'ing ', 'i-\nng ')"""
        ).alias("text"),
    )


def kind_of(key):
    return F.when(F.col(key) % 3 == 0, "PC").when(F.col(key) % 3 == 1, "npc").otherwise("Thing").alias("type")


def passage_names(spark, sf):
    """Entities of the benchmark passages; one of their names is 20 words long where it can be."""
    words = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)
    return table(spark, sf, "benchmark").select("item_id", words.alias("w"), F.regexp_extract("text", LONG_NAME, 0).alias("long")).select(
        F.col("item_id").alias("pos"),
        F.concat(F.get("w", F.lit(0)), F.lit(" "), F.get("w", F.lit(1))).alias("canonical"),
        kind_of("item_id"),
        F.array(F.get("w", F.lit(3)), F.get("w", F.lit(5)), "long").alias("synonyms"),
    )


def catalog(spark, sf):
    """Entities of the benchmark passages, and one for each part.

    A part's other names are the longest word and the longest pair of words in the whole document of its number.
    """

    def longest(pattern):
        found = F.regexp_extract_all("text", F.lit(pattern), 1)
        return F.array_max(F.transform(found, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]

    named = documents(spark, sf).select(
        F.col("doc_id").alias("p_partkey"), longest(r"(\p{L}+)").alias("word"), longest(r"(\p{L}+ \p{L}+)").alias("pair")
    )
    parts = table(spark, sf, "part").join(named, "p_partkey").select(
        (F.col("p_partkey") + 1_000_000).alias("pos"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("canonical"),
        kind_of("p_partkey"),
        F.array(F.coalesce("word", F.lit("")), F.coalesce("pair", F.lit(""))).alias("synonyms"),
    )
    return passage_names(spark, sf).unionByName(parts)


def note_docs(spark, sf):
    return documents(spark, sf).select(
        F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"),
        F.expr(
            """if(doc_id % 4 = 0, concat('2024_', lpad(cast(doc_id % 12 + 1 AS string), 2, '0'), '_',
            lpad(cast(doc_id % 28 + 1 AS string), 2, '0'), '_notes.md'), concat('note_', doc_id, '.md'))"""
        ).alias("name"),
        F.expr(
            r"""array_join(transform(split(text, '\n'), (x, i) -> concat(
            if(doc_id % 3 <> 0 AND (doc_id + i) % 5 = 3,
               concat('# Session 2024/', lpad(cast((doc_id + i) % 12 + 1 AS string), 2, '0'), '/', lpad(cast(i % 28 + 1 AS string), 2, '0'), '\n'), ''),
            x,
            if(doc_id % 3 <> 0 AND (doc_id + i) % 7 = 2, concat(' on 2023-05-0', i % 9 + 1), ''))), '\n')"""
        ).alias("text"),
    )


def notes(spark, sf):
    """Notes for the mention scan: session, source, text."""
    from quillstone.functions.text import session_title

    return note_docs(spark, sf).select(session_title(F.col("name")).alias("session"), "source", "text")


def imports(spark, sf):
    """Imported pages as notes: session, source, text."""
    return table(spark, sf, "pages").select(
        F.concat(F.lit("Imported "), F.col("page_id").cast("string")).alias("session"),
        F.concat(F.lit("imports/"), F.col("page_id").cast("string"), F.lit(".html")).alias("source"),
        F.col("html").alias("text"),
    )


def player_inputs(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"),
        F.expr("if(turn % 3 = 0, '  That And ', '')").alias("entity"),
        F.expr("if(role = 'user', concat('user', conv_id), cast(null AS string))").alias("player"),
        F.expr("if(turn % 2 = 0, '2024-02-03', '')").alias("date"),
        F.col("text").alias("note"),
    )


def entity_file_list(spark, sf):
    return table(spark, sf, "pages").select(
        F.expr("if(page_id % 2 = 0, 'campaign', 'general')").alias("scope"),
        F.expr(
            """concat(regexp_extract(url, '://([a-z.-]+)[.]example', 1), if(page_id % 3 = 0, '.bio', ''), '.',
            page_id, if(page_id % 5 = 0, '.timeline.jsonl', if(page_id % 5 = 1, '.txt', '.md')))"""
        ).alias("raw"),
        "page_id",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
    ).select(
        "scope",
        F.expr(
            """concat(replace(regexp_extract(raw, '^([a-z.-]+?)[.](bio|[0-9])', 1), '.', '_'),
            if(page_id % 7 = 0, '', concat('.', page_id)), regexp_extract(raw, '([.](timeline[.]jsonl|txt|md))$', 1))"""
        ).alias("name"),
        "page_id",
        "title",
    ).select(
        "scope", "name", F.concat("scope", F.lit("/"), "page_id", F.lit("/"), "name").alias("path"),
        F.col("title").alias("body"),
    )


def article_files(spark, sf):
    return documents(spark, sf).select(
        F.expr(
            """element_at(array('lore', 'campaign_entities', 'campaign', 'topics', 'sessions', 'requests', 'campaign'),
            cast(doc_id % 7 + 1 AS int))"""
        ).alias("root"),
        F.expr(
            """concat(if(doc_id % 11 = 0, 'requests/', if(doc_id % 13 = 0, 'entities/', '')),
            if(doc_id % 2 = 0, concat('Doc_', doc_id), concat('doc-', greatest(doc_id - 7, 0))),
            if(doc_id % 5 = 0, '.bio', ''), '.md')"""
        ).alias("rel_path"),
        F.expr("if(doc_id % 3 = 0, concat('## Title ', doc_id % 50, '\n', text), text)").alias("body"),
    )


def link_articles(spark, sf):
    """Articles with one-word titles from the benchmark and articles from the documents."""
    word = F.get(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1), F.lit(3))
    bench = table(spark, sf, "benchmark").select(
        F.concat(F.lit("topics-"), F.col("item_id").cast("string")).alias("slug"),
        word.alias("title"),
        F.concat(F.lit("b/"), F.col("item_id").cast("string")).alias("path"),
        F.col("text").alias("body"),
        F.lit("general").alias("category"),
        F.lit(0).cast("long").alias("part"),
        F.lit(1).alias("src_rank"),
    )
    docs = documents(spark, sf).select(
        F.concat(F.lit("campaign-"), F.col("doc_id").cast("string")).alias("slug"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"),
        F.expr("if(doc_id % 4 = 0, concat('<b class=\"That\">', text, '</b>'), text)").alias("body"),
        F.expr("if(doc_id % 5 = 0, 'campaign-queue', 'campaign')").alias("category"),
        F.lit(0).cast("long").alias("part"),
        F.lit(2).alias("src_rank"),
    )
    return bench.unionByName(docs)


def page_edges(spark, sf):
    pages = table(spark, sf, "pages")
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1))
    return pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.explode(hrefs).alias("dst"))


def edge_articles(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1))).alias("slug")
    ).distinct().select("slug", F.upper("slug").alias("title"), F.lit("general").alias("category"), F.lit(0).cast("long").alias("part"))


def requests(spark, sf):
    events = table(spark, sf, "events")
    names = passage_names(spark, sf).select("pos", "canonical")
    rows = events.select(
        F.col("event_id").alias("request_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        "event_id", "user_id", "event_type", "props", (F.col("user_id") % 40).alias("pos"),
    ).join(names, "pos", "left")
    return rows.select(
        "request_id",
        "ts",
        F.expr(
            """if(event_id % 3 = 0, if(user_id % 50 < 10, if(event_id % 2 = 0, upper(element_at(array('that', 'with', 'dans', 'nicht', 'para'), cast(user_id % 5 + 1 AS int))),
            element_at(array('that', 'with', 'dans', 'nicht', 'para'), cast(user_id % 5 + 1 AS int))), concat('Unknown ', user_id % 50)), if(event_id % 3 = 1, lower(canonical),
            if(event_id % 31 = 2, ' ', concat(' ', canonical, ' '))))"""
        ).alias("entity"),
        F.expr("if(event_id % 4 = 0, '', concat('note ', props))").alias("note"),
        F.expr(
            """CASE event_type WHEN 'click' THEN 'incoming' WHEN 'view' THEN ' Pending' WHEN 'purchase' THEN 'Researched'
            WHEN 'signup' THEN 'integrated' ELSE 'in_progress' END"""
        ).alias("status"),
        F.expr("if(event_id % 2 = 1, concat('sub-', event_id), '')").alias("source_submission_id"),
        F.expr("cast(null AS string)").alias("result"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("submitter"),
        F.expr("if(event_id % 7 = 1, ts + 3, cast(null AS bigint))").alias("started_at"),
        F.expr("if(event_id % 5 = 0, ts - 10, cast(null AS bigint))").alias("created_at"),
        F.expr("if(event_id % 5 = 1, ts + 5, cast(null AS bigint))").alias("updated_at"),
        F.expr("if(event_id % 5 = 2, ts + 9, cast(null AS bigint))").alias("completed_at"),
        F.expr("if(event_id % 5 = 3, ts + 7, cast(null AS bigint))").alias("researched_at"),
        F.expr(
            "if(event_id % 6 = 0, array(named_struct('ts', ts, 'event', 'incoming', 'detail', '')), null)"
        ).cast("array<struct<ts: bigint, event: string, detail: string>>").alias("history"),
    )


def payloads(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("now"),
        F.expr("concat('  ', event_type, ' ', props, ' ')").alias("fact"),
        F.expr("if(user_id % 9 = 0, cast(null AS string), concat(' user', user_id, ' '))").alias("entity"),
        F.expr("if(event_id % 3 = 0, cast(null AS string), 'web')").alias("source"),
        F.expr("if(event_id % 4 = 0, cast(null AS string), 'main')").alias("channel"),
        F.expr("if(event_id % 5 = 0, 'high', cast(null AS string))").alias("confidence"),
        F.expr("if(event_id % 2 = 0, array('t', event_type), cast(null AS array<string>))").alias("tags"),
        F.expr("if(user_id % 7 = 0, ' ', concat('p', user_id))").alias("player"),
        F.expr(
            "CASE event_type WHEN 'click' THEN 'research' WHEN 'view' THEN 'question' WHEN 'error' THEN ' ' ELSE 'fact' END"
        ).alias("request_type"),
        F.expr("if(event_id % 10 = 0, '', props)").alias("note"),
        F.expr("if(event_id % 2 = 1, concat('sub-', event_id), '')").alias("source_submission_id"),
        F.expr("concat('p', user_id)").alias("submitter"),
    )


def submissions(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("sub-"), F.col("event_id").cast("string")).alias("submission_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.expr("if(user_id % 9 = 0, '', concat('user', user_id))").alias("entity"),
        F.expr("concat('p', user_id % 20)").alias("player"),
        F.expr(
            "CASE event_type WHEN 'click' THEN 'research' WHEN 'view' THEN 'question' WHEN 'error' THEN 'update' ELSE 'fact' END"
        ).alias("request_type"),
        F.expr("if(event_id % 10 = 0, '', props)").alias("note"),
        F.lit("new").alias("status"),
    )


def audits(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("sub-"), (F.floor(F.col("event_id") / 3) * 2).cast("string")).alias("submission_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.lit("completed").alias("status"),
        F.array(F.col("event_type"), F.lit("done")).alias("actions"),
    )


def run_pages(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("document"),
        F.col("event_id").alias("page"),
        (F.col("event_type") != "error").alias("ok"),
        F.length("props").cast("long").alias("chars"),
        F.expr("if(event_type = 'error', concat('failed ', props), cast(null AS string))").alias("error"),
    )


# --- the same views as SQL -------------------------------------------------------------------------

NL = "chr(10)"
LINES = f"string_split(text, {NL})"
WORDCH = r"[\p{L}\p{N}_]"
LINES_OF = "string_split({x}, chr(10))"
# words and single other characters between bars: a term stands whole where its units do
UNITS = r"'|' || array_to_string(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]'), '|') || '|'"
WORDS = r"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+')"

SQL = {
    "book_pages": "SELECT source AS book, doc_id AS page, text FROM documents",
    "doc_lines": f"""SELECT doc_id, unnest({LINES}) AS text,
        CAST(generate_subscripts({LINES}, 1) AS BIGINT) AS line_no FROM documents""",
    "marked_docs": f"""SELECT doc_id AS book, 'front matter' || {NL} || array_to_string(list_transform({LINES}, lambda x, i:
        CASE WHEN (i - 1) % 3 = 0 THEN '===== PAGE ' || (CASE WHEN doc_id % 5 = 0 AND i = 7 THEN 1 ELSE (i - 1) // 3 + 1 END)
        || ' =====' || {NL} || x ELSE x END), {NL}) AS text FROM documents""",
    "para_pages": f"""SELECT doc_id AS book, CAST(generate_subscripts({LINES}, 1) AS BIGINT) AS page,
        unnest({LINES}) AS text FROM documents""",
    "engine_a": "SELECT conv_id AS book, turn AS page, text FROM conversations WHERE role = 'user'",
    "engine_b": "SELECT conv_id AS book, turn - 1 AS page, text FROM conversations WHERE role = 'assistant'",
    "dirty_docs": f"""SELECT doc_id, replace(array_to_string(list_transform({LINES}, lambda x, j:
        (CASE WHEN (doc_id + j - 1) % 7 = 0 THEN '<|ref|>junk<|/ref|>' ELSE '' END) || x
        || (CASE WHEN (doc_id + j - 1) % 5 = 0 THEN {NL} || x ELSE '' END)
        || (CASE WHEN (doc_id + j - 1) % 6 = 0 THEN {NL} || j ELSE '' END)
        || (CASE WHEN (doc_id + j - 1) % 9 = 0 THEN {NL} || 'Page  ' || (j - 1) ELSE '' END)
        || (CASE WHEN (doc_id + j - 1) % 4 = 0 THEN {NL} || {NL} || {NL} ELSE '' END)
        || (CASE WHEN (doc_id + j - 1) % 3 = 0 THEN {NL} || lower(x) ELSE '' END)), {NL}), 'ing ', 'i-' || {NL} || 'ng ') AS text
        FROM documents""",
    "catalog": rf"""SELECT item_id AS pos, w[1] || ' ' || w[2] AS canonical,
        CASE item_id % 3 WHEN 0 THEN 'PC' WHEN 1 THEN 'npc' ELSE 'Thing' END AS type, [w[4], w[6], long] AS synonyms
        FROM (SELECT item_id, regexp_extract_all(text, '\p{{L}}+') AS w, regexp_extract(text, '{LONG_NAME}') AS long FROM benchmark)
        UNION ALL SELECT 1000000 + p_partkey, p_name || ' ' || p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'PC' WHEN 1 THEN 'npc' ELSE 'Thing' END,
          [coalesce(list_reverse_sort(list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda x: {{'l': length(x), 'w': x}}))[1].w, ''),
           coalesce(list_reverse_sort(list_transform(regexp_extract_all(text, '\p{{L}}+ \p{{L}}+'), lambda x: {{'l': length(x), 'w': x}}))[1].w, '')]
        FROM part JOIN documents ON doc_id = p_partkey""",
    "note_docs": f"""SELECT 'notes/' || doc_id || '.md' AS source,
        CASE WHEN doc_id % 4 = 0 THEN '2024_' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '_'
        || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '_notes.md' ELSE 'note_' || doc_id || '.md' END AS name,
        array_to_string(list_transform({LINES}, lambda x, j:
        (CASE WHEN doc_id % 3 <> 0 AND (doc_id + j - 1) % 5 = 3 THEN '# Session 2024/'
          || lpad(CAST((doc_id + j - 1) % 12 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST((j - 1) % 28 + 1 AS VARCHAR), 2, '0') || {NL} ELSE '' END)
        || x || (CASE WHEN doc_id % 3 <> 0 AND (doc_id + j - 1) % 7 = 2 THEN ' on 2023-05-0' || ((j - 1) % 9 + 1) ELSE '' END)), {NL}) AS text
        FROM documents""",
    "notes": r"""SELECT CASE WHEN regexp_matches(name, '[0-9]{4}[-_][0-9]{2}[-_][0-9]{2}')
        THEN replace(regexp_extract(name, '[0-9]{4}[-_][0-9]{2}[-_][0-9]{2}'), '_', '-')
        ELSE regexp_replace(name, '[.][^.]+$', '') END AS session, source, text FROM note_docs""",
    "note_lines": f"""SELECT session, source, unnest({LINES}) AS line,
        CAST(generate_subscripts({LINES}, 1) AS BIGINT) AS line_no FROM notes""",
    "player_inputs": """SELECT conv_id * 1000 + turn AS line_no, CASE WHEN turn % 3 = 0 THEN '  That And ' ELSE '' END AS entity,
        CASE WHEN role = 'user' THEN 'user' || conv_id END AS player,
        CASE WHEN turn % 2 = 0 THEN '2024-02-03' ELSE '' END AS date, text AS note FROM conversations""",
    "aliases": """SELECT pos, canonical, trim(u.alias) AS alias, u.idx FROM (SELECT pos, canonical,
          unnest(list_transform([canonical] || synonyms || [array_to_string(string_split(canonical, ' ')[1:2], ' ')], lambda x, i: {'alias': x, 'idx': CAST(i - 1 AS BIGINT)})) AS u
          FROM catalog) WHERE trim(u.alias) <> ''""",
    "alias_keys": """SELECT alias_key, pos, canonical, alias FROM (SELECT lower(alias) AS alias_key, pos, canonical, alias,
          row_number() OVER (PARTITION BY lower(alias) ORDER BY length(alias) DESC, pos, idx) AS rn FROM aliases) WHERE rn = 1""",
    "context_lines": r"""SELECT session, source, line_no, trim(line) AS line,
        substr(trim(regexp_replace(concat_ws(' ',
          CASE WHEN length(lag(trim(line)) OVER w) >= 15 THEN lag(trim(line)) OVER w END,
          nullif(trim(line), ''),
          CASE WHEN length(lead(trim(line)) OVER w) >= 15 THEN lead(trim(line)) OVER w END), '\s+', ' ', 'g')), 1, 420) AS context
        FROM note_lines WINDOW w AS (PARTITION BY source ORDER BY line_no)""",
    "alias_terms": f"SELECT *, {UNITS.format(x='alias_key')} AS term, {WORDS.format(x='alias_key')}[1] AS head FROM alias_keys",
    "log_mentions": f"""SELECT DISTINCT 0 AS src_rank, session, source, line_no, context AS text, canonical
        FROM (SELECT *, {UNITS.format(x='lower(line)')} AS norm, unnest(list_distinct({WORDS.format(x='lower(line)')})) AS head
              FROM context_lines WHERE length(line) >= 12) l
        JOIN alias_terms a USING (head) WHERE contains(norm, term)""",
    "import_lines": f"""SELECT page_id, unnest({LINES_OF.format(x='html')}) AS line,
        CAST(generate_subscripts({LINES_OF.format(x='html')}, 1) AS BIGINT) AS line_no FROM pages""",
    "import_mentions": rf"""SELECT DISTINCT 1 AS src_rank, 'Imported ' || page_id AS session, 'imports/' || page_id || '.html' AS source, line_no,
        substr(trim(regexp_replace(concat_ws(' ', CASE WHEN length(prior) >= 15 THEN prior END, nullif(trim(line), ''), CASE WHEN length(next) >= 15 THEN next END),
          '\s+', ' ', 'g')), 1, 420) AS text, canonical
        FROM (SELECT *, {UNITS.format(x='lower(trim(line))')} AS norm, unnest(list_distinct({WORDS.format(x='lower(line)')})) AS head FROM (
          SELECT *, lag(trim(line)) OVER w AS prior, lead(trim(line)) OVER w AS next FROM import_lines WINDOW w AS (PARTITION BY page_id ORDER BY line_no))
          WHERE length(trim(line)) >= 12) l
        JOIN alias_terms a USING (head) WHERE contains(norm, term)""",
    "input_rows": """SELECT line_no, trim(note, ' ' || chr(10)) AS note, lower(trim(entity)) AS hint,
        'Player Input (' || coalesce(nullif(date, ''), 'undated') || ')' AS session,
        substr('[' || coalesce(player, 'Unknown Player') || '] ' || trim(note, ' ' || chr(10)), 1, 320) AS text
        FROM player_inputs WHERE length(trim(note, ' ' || chr(10))) >= 8""",
    "input_mentions": f"""SELECT DISTINCT 2 AS src_rank, session, 'inputs' AS source, line_no, text, canonical FROM (
        SELECT session, line_no, text, canonical FROM (SELECT *, {UNITS.format(x='lower(note)')} AS norm,
          unnest(list_distinct({WORDS.format(x='lower(note)')})) AS head FROM input_rows) l
        JOIN alias_terms a USING (head) WHERE contains(norm, term)
        UNION ALL SELECT session, line_no, text, canonical FROM input_rows JOIN catalog ON lower(canonical) = hint)""",
    "mentions": "SELECT * FROM log_mentions UNION ALL SELECT * FROM input_mentions",
    "entity_file_list": r"""SELECT scope, name, scope || '/' || page_id || '/' || name AS path, title AS body FROM (
        SELECT page_id, scope, title, replace(regexp_extract(raw, '^([a-z.-]+?)[.](bio|[0-9])', 1), '.', '_')
          || (CASE WHEN page_id % 7 = 0 THEN '' ELSE '.' || page_id END) || regexp_extract(raw, '([.](timeline[.]jsonl|txt|md))$', 1) AS name
        FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'campaign' ELSE 'general' END AS scope,
          regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
          regexp_extract(url, '://([a-z.-]+)[.]example', 1) || (CASE WHEN page_id % 3 = 0 THEN '.bio' ELSE '' END) || '.' || page_id
          || (CASE page_id % 5 WHEN 0 THEN '.timeline.jsonl' WHEN 1 THEN '.txt' ELSE '.md' END) AS raw FROM pages))""",
    "entity_files": """SELECT scope, entity, kind, name, path, body FROM (SELECT *, max(CASE WHEN kind = 'md'
          AND length(name) - length(replace(name, '.', '')) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY scope, entity) AS sectioned
        FROM (SELECT scope, split_part(name, '.', 1) AS entity, CASE WHEN name LIKE '%.md' THEN 'md' WHEN name LIKE '%.jsonl' THEN 'jsonl' END AS kind,
          name, path, body FROM entity_file_list) WHERE kind IS NOT NULL)
        WHERE NOT (kind = 'md' AND sectioned = 1 AND name = entity || '.md')""",
    "article_files": f"""SELECT ['lore', 'campaign_entities', 'campaign', 'topics', 'sessions', 'requests', 'campaign'][doc_id % 7 + 1] AS root,
        (CASE WHEN doc_id % 11 = 0 THEN 'requests/' WHEN doc_id % 13 = 0 THEN 'entities/' ELSE '' END)
        || (CASE WHEN doc_id % 2 = 0 THEN 'Doc_' || doc_id ELSE 'doc-' || greatest(doc_id - 7, 0) END)
        || (CASE WHEN doc_id % 5 = 0 THEN '.bio' ELSE '' END) || '.md' AS rel_path,
        CASE WHEN doc_id % 3 = 0 THEN '## Title ' || (doc_id % 50) || {NL} || text ELSE text END AS body FROM documents""",
    "link_articles": r"""SELECT 'topics-' || item_id AS slug, regexp_extract_all(text, '\p{L}+')[4] AS title, 'b/' || item_id AS path,
          text AS body, 'general' AS category, 1 AS src_rank FROM benchmark
        UNION ALL SELECT 'campaign-' || doc_id, 'Document ' || doc_id, 'd/' || doc_id,
          CASE WHEN doc_id % 4 = 0 THEN '<b class="That">' || text || '</b>' ELSE text END,
          CASE WHEN doc_id % 5 = 0 THEN 'campaign-queue' ELSE 'campaign' END, 2 FROM documents""",
    "page_edges": """SELECT DISTINCT 'p' || page_id AS src, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS dst FROM pages""",
    "edge_articles": r"""SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS slug FROM benchmark""",
    "requests": """SELECT event_id AS request_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
        CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 50 >= 10 THEN 'Unknown ' || (user_id % 50)
            WHEN event_id % 2 = 0 THEN upper(['that', 'with', 'dans', 'nicht', 'para'][user_id % 5 + 1]) ELSE ['that', 'with', 'dans', 'nicht', 'para'][user_id % 5 + 1] END WHEN 1 THEN lower(canonical)
          ELSE CASE WHEN event_id % 31 = 2 THEN ' ' ELSE ' ' || canonical || ' ' END END AS entity,
        CASE WHEN event_id % 4 = 0 THEN '' ELSE 'note ' || props END AS note,
        CASE event_type WHEN 'click' THEN 'incoming' WHEN 'view' THEN ' Pending' WHEN 'purchase' THEN 'Researched'
          WHEN 'signup' THEN 'integrated' ELSE 'in_progress' END AS status,
        CASE WHEN event_id % 2 = 1 THEN 'sub-' || event_id ELSE '' END AS source_submission_id, 'p' || user_id AS submitter,
        CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id
        FROM events LEFT JOIN catalog ON pos = user_id % 40""",
    "payloads": """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS now, '  ' || event_type || ' ' || props || ' ' AS fact,
        CASE WHEN user_id % 9 = 0 THEN NULL ELSE ' user' || user_id || ' ' END AS entity,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'web' END AS source, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'main' END AS channel,
        CASE WHEN event_id % 5 = 0 THEN 'high' END AS confidence, CASE WHEN event_id % 2 = 0 THEN ['t', event_type] END AS tags,
        CASE WHEN user_id % 7 = 0 THEN ' ' ELSE 'p' || user_id END AS player,
        CASE event_type WHEN 'click' THEN 'research' WHEN 'view' THEN 'question' WHEN 'error' THEN ' ' ELSE 'fact' END AS request_type,
        CASE WHEN event_id % 10 = 0 THEN '' ELSE props END AS note,
        CASE WHEN event_id % 2 = 1 THEN 'sub-' || event_id ELSE '' END AS source_submission_id, 'p' || user_id AS submitter FROM events""",
    "submissions": """SELECT 'sub-' || event_id AS submission_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
        CASE WHEN user_id % 9 = 0 THEN '' ELSE 'user' || user_id END AS entity, 'p' || (user_id % 20) AS player,
        CASE event_type WHEN 'click' THEN 'research' WHEN 'view' THEN 'question' WHEN 'error' THEN 'update' ELSE 'fact' END AS request_type,
        CASE WHEN event_id % 10 = 0 THEN '' ELSE props END AS note FROM events""",
    "audits": """SELECT 'sub-' || (event_id // 3 * 2) AS submission_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
        event_type || ', done' AS work_log FROM events""",
    "run_pages": """SELECT user_id AS document, event_id AS page, event_type <> 'error' AS ok, length(props) AS chars,
        CASE WHEN event_type = 'error' THEN 'failed ' || props END AS error FROM events""",
}

NEEDS = {
    "notes": ["note_docs"],
    "note_lines": ["notes"],
    "aliases": ["catalog"],
    "alias_keys": ["aliases"],
    "context_lines": ["note_lines"],
    "alias_terms": ["alias_keys"],
    "log_mentions": ["context_lines", "alias_terms"],
    "import_mentions": ["import_lines", "alias_terms"],
    "input_rows": ["player_inputs"],
    "input_mentions": ["input_rows", "alias_terms", "catalog"],
    "mentions": ["log_mentions", "input_mentions"],
    "entity_files": ["entity_file_list"],
    "requests": ["catalog"],
}


def with_views(names: str, query: str, /, **more: str) -> str:
    """``query`` behind the definitions of the named views and of those they need, then of ``more``."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query

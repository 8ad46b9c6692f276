"""Facts, submissions and the request queue."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.text import left, lines, not_blank, or_blank, slug, strip
from quillstone.operators.mentions import held_once, name_blocks, new_names, settle_names, show_lines, term_lines, with_names, with_names_of
from quillstone.operators.ranking import first_per_group, joined_in_order, rank_in_group
from quillstone.operators.spans import Bits
from quillstone.sources.storage import discard, stored

# States, request types, work-log texts and limits of the queue.
OPEN_STATES = ("incoming", "pending")
LEGACY_RESULTS = ("researched", "integrated")
RESEARCH_TYPES = ("research", "update", "question")
NO_PLAYER = "Unknown Player"
WORK_LOG = (
    "queue lookup",
    "entity canonicalization",
    "memory corpus mention scan (campaign logs + harmonized rules corpus)",
)
MENTION_CAP = 120
DIFF_CAP = 12000
HISTORY = "array<struct<ts: bigint, event: string, detail: string>>"


def happening(ts: Column, event: str | Column, detail: str | Column = "") -> Column:
    def col(v):
        return F.lit(v) if isinstance(v, str) else v

    return F.struct(ts.cast("long").alias("ts"), col(event).alias("event"), col(detail).alias("detail"))


def append_history(history: Column, ts: Column, event: str | Column, detail: str | Column = "") -> Column:
    """History with one more event; a missing history starts new."""
    return F.concat(F.coalesce(history, F.array().cast(HISTORY)), F.array(happening(ts, event, detail)))


def fact_rows(payloads: DataFrame, now: Column, default_source: str = "discord") -> DataFrame:
    return payloads.select(
        now.cast("long").alias("ts"),
        strip(or_blank(F.col("fact"))).alias("fact"),
        strip(or_blank(F.col("entity"))).alias("entity"),
        F.coalesce("source", F.lit(default_source)).alias("source"),
        F.coalesce("channel", F.lit("")).alias("channel"),
        F.coalesce("confidence", F.lit("medium")).alias("confidence"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def fact_audit(facts: DataFrame, filename: str = "chat_facts.jsonl") -> DataFrame:
    return facts.select(
        "ts", F.lit("upsert_fact").alias("action"), F.lit(filename).alias("filename"), "entity", "source"
    )


def short_requests(payloads: DataFrame, now: Column, default_source: str = "api") -> DataFrame:
    return payloads.select(
        now.cast("long").alias("ts"),
        strip(or_blank(F.col("entity"))).alias("entity"),
        strip(or_blank(F.col("note"))).alias("note"),
        F.lit("incoming").alias("status"),
        F.coalesce("source", F.lit(default_source)).alias("source"),
    )


def long_requests(payloads: DataFrame, now: Column) -> DataFrame:
    ts = now.cast("long")
    return payloads.select(
        ts.alias("ts"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
        strip(or_blank(F.col("entity"))).alias("entity"),
        strip(or_blank(F.col("note"))).alias("note"),
        F.lit("incoming").alias("status"),
        strip(or_blank(F.col("source_submission_id"))).alias("source_submission_id"),
        strip(or_blank(F.col("submitter"))).alias("submitter"),
        F.array(happening(ts, "incoming", "added via web queue")).alias("history"),
    )


def append_requests(short: DataFrame, long: DataFrame, now: Column) -> DataFrame:
    """Queue rows of both writers in one nullable schema."""
    return long_requests(long, now).unionByName(short_requests(short, now), allowMissingColumns=True)


def submission_rows(payloads: DataFrame, now: Column, seed: Column) -> DataFrame:
    """Submissions with an id from ``seed``: the same input gives the same id after a retry."""
    return payloads.select(
        F.concat(F.lit("sub-"), left(F.sha2(seed.cast("string"), 256), 10)).alias("submission_id"),
        now.cast("long").alias("ts"),
        F.date_format(F.timestamp_seconds(now.cast("long")), "yyyy-MM-dd HH:mm:ss").alias("date"),
        strip(or_blank(F.col("entity"))).alias("entity"),
        not_blank(strip(or_blank(F.col("player"))), NO_PLAYER).alias("player"),
        not_blank(strip(or_blank(F.col("request_type"))), "fact").alias("request_type"),
        strip(or_blank(F.col("note"))).alias("note"),
        F.lit("new").alias("status"),
    )


def valid_submissions(submissions: DataFrame) -> DataFrame:
    return submissions.where((F.col("entity") != "") & (F.col("note") != ""))


def route_submissions(submissions: DataFrame) -> DataFrame:
    """Queue rows of the submissions that ask for work."""
    asked = valid_submissions(submissions).where(F.col("request_type").isin(list(RESEARCH_TYPES)))
    payload = asked.select(
        "ts",
        "entity",
        F.concat(F.lit("["), "player", F.lit("] "), "note").alias("note"),
        F.col("submission_id").alias("source_submission_id"),
        F.col("player").alias("submitter"),
    )
    return long_requests(payload, F.col("ts"))


def migrate_legacy_status(queue: DataFrame, now: Column) -> DataFrame:
    """Old final states become ``completed`` with a result; missing times come from what is there."""
    old = F.lower(strip(or_blank(F.col("status"))))
    legacy = old.isin(list(LEGACY_RESULTS))

    def known(*cols: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols], now.cast("long"))

    done = F.coalesce("completed_at", known(F.col("researched_at"), F.col("ts")))
    changed = {
        "result": F.when(legacy, old).otherwise(F.col("result")),
        "status": F.when(legacy, "completed").otherwise(F.col("status")),
        "completed_at": F.when(legacy, done).otherwise(F.col("completed_at")),
        "created_at": F.when(legacy, F.coalesce("created_at", known(F.col("ts")))).otherwise(F.col("created_at")),
        "updated_at": F.when(legacy, F.coalesce("updated_at", done)).otherwise(F.col("updated_at")),
        "history": F.when(
            legacy & F.col("history").isNull(),
            F.array(happening(done, "completed", F.concat(F.lit("migrated legacy status="), old))),
        ).otherwise(F.col("history")),
    }
    return queue.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def select_open_requests(queue: DataFrame) -> DataFrame:
    state = F.lower(strip(or_blank(F.col("status"))))
    return queue.where(state.isin(list(OPEN_STATES)) & (strip(or_blank(F.col("entity"))) != ""))


# The two kinds of texts that are searched, in order.
DOMAINS = ("campaign", "general")


def log_keys(logs: DataFrame) -> list[str]:
    """Logs are whole texts (source, text) or single lines (source, line_no, text)."""
    return ["source", "line_no"] if "line_no" in logs.columns else ["source"]


def names_of(terms: DataFrame) -> DataFrame:
    """Distinct (canonical, term) with lower-cased terms."""
    return terms.select("canonical", F.lower("term").alias("term")).where(F.col("term") != "").distinct()


PLACE = ("domain_rank", "file", "place", "_doc", "_i")


def hit_lines(names: DataFrame, logs: DataFrame, pages: DataFrame) -> DataFrame:
    """(domain_rank, file, place, _doc, _i, shown, terms, _row): each line where likely terms stand, made in the row of its text.

    ``_doc`` and ``_i`` are the text's row hash and the line in it, ``_row`` the hash of both, ``shown`` is the excerpt.
    """

    def found(domain: int, texts: DataFrame, keys: list[str], place: Column) -> DataFrame:
        held = term_lines(texts, keys, "text", names, lambda ls, i: left(ls[i], 280), "edge")
        columns = [F.lit(domain).alias("domain_rank"), F.col("source").alias("file"), place.alias("place"), "_doc", F.col("_i").cast("int").alias("_i")]
        return held.select(*columns, "shown", "terms", F.xxhash64("_doc", "_i").alias("_row"))

    in_logs = F.col("line_no") if "line_no" in logs.columns else (F.col("_i") + 1).cast("long")
    return found(0, logs, log_keys(logs), in_logs).unionByName(found(1, pages, ["source", "page"], F.col("page")))


def term_places(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(term, domain_rank, file, place, _doc, _i): where terms stand in ``hit_lines``, in pages only the first line of each."""
    keys = names.select("term", F.col("term").alias("canonical")).distinct()
    met = with_names_of(lines, keys, PLACE).select(F.explode_outer("names").alias("term"), *PLACE)
    first = met.where("domain_rank = 1").groupBy("term", "domain_rank", "file", "place").agg(F.min(F.struct("_i", "_doc")).alias("at"))
    return met.where("domain_rank = 0").unionByName(first.select("term", "domain_rank", "file", "place", "at._doc", "at._i"))


def term_hits(names: DataFrame, logs: DataFrame, pages: DataFrame) -> DataFrame:
    """Where terms stand: (term, domain_rank, file, place, _doc, _i), texts left behind.

    Many names may share a term, so its places are found and kept once, a line with its terms as one row. Each line of a
    log counts, of a page (source, page, text) the first line with a term does.
    """
    return term_places(held_once(hit_lines(names, logs, pages).drop("shown"), "_row", "mention-places"), names)


def name_hits(hits: DataFrame, names: DataFrame) -> DataFrame:
    """(canonical, domain_rank, file, place, _doc, _i): the places of all terms of each name, each place once."""
    met = hits.join(names, "term")
    in_logs = met.where("domain_rank = 0").select("canonical", "domain_rank", "file", "place", "_doc", "_i").distinct()
    in_pages = met.where("domain_rank = 1").groupBy("canonical", "domain_rank", "file", "place").agg(F.min(F.struct("_i", "_doc")).alias("at"))
    return in_logs.unionByName(in_pages.select("canonical", "domain_rank", "file", "place", "at._doc", "at._i"))


def mention_counts(hits: DataFrame, names: DataFrame) -> DataFrame:
    """(canonical, n_mentions): how many places name each name, as many as ``name_hits`` has, which are not made.

    A place counts for a name at the first of the name's terms that stands there. So a place is one row with its terms,
    and names that share terms multiply nothing but counts.
    """
    log = F.col("domain_rank") == 0
    place = [F.col(c) for c in ("domain_rank", "file", "place")] + [F.when(log, F.col(c)).alias(c) for c in ("_doc", "_i")]
    held = hits.groupBy(*place).agg(F.collect_set("term").alias("held")).select("held", F.explode("held").alias("term"))
    own = names.groupBy("canonical").agg(F.array_sort(F.collect_set("term")).alias("own"))
    firsts = own.select("canonical", F.posexplode("own").alias("i", "term"), "own").select("canonical", "term", F.slice("own", 1, F.col("i")).alias("sooner"))
    met = held.join(firsts, "term").where(~F.arrays_overlap("held", "sooner"))
    return met.groupBy("canonical").agg(F.count("*").alias("n_mentions"))


def cite_mentions(hits: DataFrame, names: DataFrame, logs: DataFrame, pages: DataFrame, cap: int | None = None) -> DataFrame:
    """(canonical, rank, domain, source, excerpt) of the hits, logs first. With a ``cap`` each name keeps that many.

    The first places of a name are among the first of its terms, so with a cap the terms' places are cut before they
    are repeated for the names. Places are ranked and cut before any text is joined.
    """
    order = ["domain_rank", "file", "place", "_doc", "_i"]
    if cap is None:
        ranked = rank_in_group(name_hits(hits, names), ["canonical"], order, "rank")
    else:
        cut = first_per_group(hits, ["term"], [F.col(c) for c in order], cap).drop("rank")
        ranked = first_per_group(name_hits(cut, names), ["canonical"], [F.col(c) for c in order], cap)

    def cited(rank: int, texts: DataFrame, keys: list[str], mark: str, place: Column) -> DataFrame:
        name = F.struct("canonical", F.col("rank").cast("long").alias("rank")).alias("name")
        own = ranked.where(F.col("domain_rank") == rank).select("_doc", "_i", name)
        shown = show_lines(texts, keys, "text", own, lambda ls, i: left(ls[i], 280), keys)
        return shown.withColumn("_name", F.explode("names")).select(
            "_name.canonical",
            "_name.rank",
            F.lit(DOMAINS[rank]).alias("domain"),
            F.concat("source", F.lit(mark), place.cast("string")).alias("source"),
            F.col("shown").alias("excerpt"),
        )

    line = F.col("line_no") if "line_no" in logs.columns else F.col("_i") + 1
    return cited(0, logs, log_keys(logs), "#L", line).unionByName(cited(1, pages, ["source", "page"], "#PAGE-", F.col("page")))


def find_mentions(terms: DataFrame, logs: DataFrame, pages: DataFrame, cap: int | None = None) -> DataFrame:
    """(canonical, rank, domain, source, excerpt): cited mentions of names (canonical, term), logs first.

    With a ``cap`` each name keeps that many, and only lines that may be cited are shuffled; see ``cite_mentions``.
    """
    names = stored(names_of(terms), "mention-names")
    if cap is None:
        return every_mention(names, logs, pages)
    order = [F.col(c) for c in PLACE]
    lines = held_once(hit_lines(names, logs, pages), "_row", "mention-places")
    cut = first_per_group(term_places(lines, names), ["term"], order, cap).drop("rank")
    near = stored(name_hits(cut, names).withColumn("_row", F.xxhash64("_doc", "_i")), "mention-cut")
    ranked = first_per_group(near, ["canonical"], order, cap)
    wanted = near.select(F.col("_row").alias("h")).distinct()
    texts = lines.where(Bits(wanted, wanted.count()).holds(F.col("_row"))).select("_row", "shown")
    return ranked.join(texts, "_row").select("canonical", F.col("rank").cast("long").alias("rank"), *cited(), F.col("shown").alias("excerpt"))


def cited() -> list[Column]:
    """Domain and source of a place."""
    log = F.col("domain_rank") == 0
    mark = F.when(log, F.lit("#L")).otherwise(F.lit("#PAGE-"))
    return [
        F.when(log, F.lit(DOMAINS[0])).otherwise(F.lit(DOMAINS[1])).alias("domain"),
        F.concat("file", mark, F.col("place").cast("string")).alias("source"),
    ]


def every_mention(names: DataFrame, logs: DataFrame, pages: DataFrame) -> DataFrame:
    """(canonical, rank, domain, source, excerpt) of all mentions, logs first.

    The result grows as places times names, so what is shuffled are places with their terms, never mentions: places are
    dealt out by ranges of their order, the mentions of each name in each range are counted, and a second reading
    numbers them from the sum of the ranges before.
    """
    found = held_once(hit_lines(names, logs, pages), "_row", "mention-places")
    logged = found.where("domain_rank = 0").select(*PLACE, F.array("shown").alias("shown"), F.array("terms").alias("terms"))
    line = F.sort_array(F.collect_list(F.struct("_i", "_doc", "shown", "terms")))
    paged = found.where("domain_rank = 1").groupBy("domain_rank", "file", "place").agg(line.alias("l"))
    paged = paged.select("domain_rank", "file", "place", F.lit(0).cast("long").alias("_doc"), F.lit(0).alias("_i"), "l.shown", "l.terms")
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = logged.unionByName(paged).repartitionByRange(parts, "domain_rank", "file", "place", "_doc", "_i")
    places = stored(ranged.withColumn("_piece", F.spark_partition_id()), "mention-ranges")
    discard(found)
    out = []
    for block in name_blocks(places.select(F.flatten("terms").alias("terms")), names):
        counted = block.counts(places).groupBy("_piece", "code").agg(F.sum("n").alias("n"))
        before = W.partitionBy("code").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
        starts = counted.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        packed = stored(starts.groupBy("_piece").agg(F.collect_list(F.struct("code", "start")).alias("s")).select("_piece", "s.code", "s.start"), "mention-starts")
        none = [F.lit(None).cast(t).alias(c) for c, t in places.dtypes if c != "_piece"]
        dealt = places.select("*", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("array<long>").alias("start")).unionByName(
            packed.select("_piece", *none, "code", "start")
        )
        ordered = dealt.repartition(parts, "_piece").sortWithinPartitions("_piece", F.col("code").isNull(), *PLACE)
        ranked = block.ranked(ordered).withColumn("_m", F.explode_outer(F.arrays_zip("names", "ranks", "lines")))
        names_of_line = [F.col("_m.names").alias("canonical"), F.col("_m.ranks").alias("rank")]
        out.append(ranked.select(*names_of_line, *cited(), F.get("shown", F.col("_m.lines")).alias("excerpt")))
    return functools.reduce(DataFrame.unionByName, out)


@dataclass(frozen=True)
class QueueRun:
    """What the steps of a queue run share: each table is made once and read by all of them."""

    settled: DataFrame  # open requests with their canonical name
    catalog: DataFrame  # extended by the new names
    names: DataFrame  # terms of the names that are asked for
    terms: DataFrame  # places where the terms stand, none cut off
    logs: DataFrame
    pages: DataFrame

    @property
    def counts(self) -> DataFrame:
        """How many places mention each asked name."""
        return mention_counts(self.terms, self.names)

    @property
    def hits(self) -> DataFrame:
        """Places where the asked names are mentioned."""
        return name_hits(self.terms, self.names)

    def cited(self, cap: int | None = None) -> DataFrame:
        return cite_mentions(self.terms, self.names, self.logs, self.pages, cap)


def terms_of(catalog: DataFrame) -> DataFrame:
    return catalog.select("canonical", F.explode(F.concat(F.array("canonical"), "synonyms")).alias("term"))


def settle_queue(queue: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open requests with their names, and the catalog extended by the new ones.

    Both are written in the shared folder, so a step that is repeated reads what the others have read.
    """
    asked = stored(select_open_requests(queue), "queue-requests")
    known = stored(catalog.select("pos", "canonical", "type", "synonyms"), "queue-known")
    new = stored(new_names(asked, known), "queue-new")
    extended = stored(with_names(known, new), "queue-catalog")
    return stored(settle_names(asked, known, new), "queue-settled"), extended


def queue_run(queue: DataFrame, catalog: DataFrame, logs: DataFrame, pages: DataFrame) -> QueueRun:
    """Settle the names of the open requests, extend the catalog, and find all mentions of the names that are asked for."""
    settled, extended = settle_queue(queue, catalog)
    asked = settled.select("canonical").distinct()
    names = stored(names_of(terms_of(extended).join(asked, "canonical", "left_semi")), "queue-names")
    return QueueRun(settled, extended, names, stored(term_hits(names, logs, pages), "queue-hits"), logs, pages)


def complete_requests(
    requests: DataFrame,
    mentions: DataFrame,
    articles: DataFrame,
    now: Column,
    article_root: str = "entities",
    dossier_root: str = "requests",
) -> DataFrame:
    """Resolved open requests in their final state.

    ``requests`` carry ``canonical`` and ``is_new`` (``mentions.settle_names``). With an article of that slug the
    request is integrated and points to it, else it is researched and points to its dossier. A time at which work
    started stays, and so do all other columns of the queue. ``mentions`` are places of names or, with the column
    ``n_mentions``, their counts.
    """
    counted = "n_mentions" in mentions.columns
    counts = mentions.select("canonical", "n_mentions") if counted else mentions.groupBy("canonical").agg(F.count("*").alias("n_mentions"))
    present = articles.select("slug").distinct().withColumn("_there", F.lit(True))
    named = requests.withColumn("resolved_entity", F.coalesce("canonical", strip(F.col("entity"))))
    rows = (
        named.withColumn("slug", slug(F.col("resolved_entity")))
        .join(present, "slug", "left")
        .join(counts.withColumnRenamed("canonical", "resolved_entity"), "resolved_entity", "left")
    )
    there = F.col("_there").isNotNull()
    n = F.coalesce("n_mentions", F.lit(0)).cast("long")
    ts = now.cast("long")
    detail = F.when(there, "already present in canonical campaign entities (integrated)").otherwise(
        F.concat(F.lit("research dossier written ("), n.cast("string"), F.lit(" mentions)"))
    )
    started = append_history(F.col("history"), ts, "in_progress", "queue processor started work")
    before = F.col("started_at") if "started_at" in requests.columns else F.lit(None).cast("long")
    done = [
        F.col("request_id"),
        F.col("ts"),
        F.col("entity"),
        F.col("note"),
        F.lower(strip(or_blank(F.col("status")))).alias("asked_status"),
        F.lit("completed").alias("status"),
        F.when(there, "integrated").otherwise("researched").alias("result"),
        F.col("resolved_entity"),
        F.col("slug"),
        F.col("is_new"),
        n.alias("n_mentions"),
        F.concat(F.when(there, F.lit(article_root)).otherwise(F.lit(dossier_root)), F.lit("/"), "slug", F.lit(".md")).alias("output"),
        F.coalesce("created_at", F.nullif(F.col("ts"), F.lit(0)), ts).alias("created_at"),
        ts.alias("updated_at"),
        F.coalesce(before, ts).alias("started_at"),
        ts.alias("completed_at"),
        F.when(~there, ts).alias("researched_at"),
        F.col("source_submission_id"),
        append_history(started, ts, "completed", detail).alias("history"),
    ]
    fixed = rows.select(*done).columns
    return rows.select(*done, *[c for c in requests.columns if c not in fixed and c != "canonical"])


def write_back(queue: DataFrame, completed: DataFrame) -> DataFrame:
    """The whole queue after a run: completed requests in their new state, all other rows as they were."""
    rest = queue.join(completed.select("request_id"), "request_id", "left_anti")
    return rest.unionByName(completed, allowMissingColumns=True)


def request_audit(completed: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """Audit row of every completed request that came from a submission.

    ``diffs`` (slug, diff) carries the changes of the dossiers.
    """
    rows = completed.where(strip(or_blank(F.col("source_submission_id"))) != "")
    diff = F.lit("")
    if diffs is not None:
        rows = rows.join(diffs.select("slug", "diff"), "slug", "left")
        diff = left(or_blank(F.col("diff")), DIFF_CAP)
    integrated = F.col("result") == "integrated"
    last = F.when(integrated, "existing entity dossier detected; no write needed").otherwise(
        F.concat(F.lit("request dossier generated ("), F.col("n_mentions").cast("string"), F.lit(" mentions)"))
    )
    actions = F.array_compact(
        F.array(*[F.lit(a) for a in WORK_LOG], F.when(F.col("is_new"), "catalog entry created"), last)
    )
    edited = F.when(
        ~integrated,
        F.array(F.struct(F.col("output").alias("path"), F.lit("create_or_update").alias("change_type"), diff.alias("diff"))),
    ).otherwise(F.array().cast("array<struct<path: string, change_type: string, diff: string>>"))
    return rows.select(
        strip(F.col("source_submission_id")).alias("submission_id"),
        F.col("completed_at").alias("ts"),
        "status",
        "result",
        F.col("resolved_entity").alias("entity"),
        actions.alias("actions"),
        edited.alias("edited_docs"),
    )


def dossier_rows(completed: DataFrame, catalog: DataFrame, mentions: DataFrame) -> DataFrame:
    """Markdown dossier (slug, body) of each researched name, from its latest request.

    A name has at most the capped number of mentions, so its list is bounded.
    """
    researched = completed.where(F.col("result") == "researched")
    last = researched.groupBy("slug").agg(
        F.max_by(F.struct("resolved_entity", "entity", "note", "n_mentions", "asked_status"), "request_id").alias("r")
    ).select("slug", "r.*")
    cited = F.concat(
        F.lit("- **"), "domain", F.lit("** - "), "excerpt", F.lit("\n  - Source: `"), "source", F.lit("`")
    )
    lists = mentions.groupBy(F.col("canonical").alias("resolved_entity")).agg(
        joined_in_order("rank", cited, "\n").alias("cited")
    )
    known = catalog.groupBy(F.col("canonical").alias("resolved_entity")).agg(
        F.min_by(F.struct("type", "synonyms"), "pos").alias("c")
    )
    rows = last.join(known, "resolved_entity", "left").join(lists, "resolved_entity", "left")
    synonyms = F.when(F.size("c.synonyms") > 0, F.array_join("c.synonyms", ", ")).otherwise("_None_")
    note = F.when(
        or_blank(F.col("note")) != "", F.concat(F.lit("- Request note: "), "note", F.lit("\n\n"))
    ).otherwise("")
    body = F.concat(
        F.lit("# Campaign Entity Dossier: "), "resolved_entity",
        F.lit("\n\n- Pipeline status: **researched_from_queue**\n- Queue status at processing: **"), "asked_status",
        F.lit("**\n- Entity type: **"),
        F.coalesce("c.type", F.lit("Unknown")),
        F.lit("**\n- Synonyms: "), synonyms,
        F.lit("\n- Requested as: **"), strip(F.col("entity")),
        F.lit("**\n- Mentions found: **"), F.col("n_mentions").cast("string"), F.lit("**\n\n"),
        note,
        F.lit("## Cited Mentions\n\n"),
        F.coalesce("cited", F.lit("_No mentions found yet._")),
        F.lit("\n"),
    )
    return rows.select("slug", body.alias("body"))


def dossier_documents(before: DataFrame, dossiers: DataFrame, completed: DataFrame) -> DataFrame:
    """Dossiers (slug, body) after a run: new ones replace old ones, and an entity with an article of its own has none."""
    gone = completed.select("slug").distinct()
    return before.join(gone, "slug", "left_anti").select("slug", "body").unionByName(dossiers.select("slug", "body"))


def dossier_diffs(before: DataFrame, dossiers: DataFrame) -> DataFrame:
    """(slug, diff): removed and added lines of each rewritten dossier, as ``- line`` and ``+ line`` with their number."""
    def split(docs: DataFrame) -> DataFrame:
        return docs.select(F.col("slug").alias("key"), F.explode(lines(F.col("body"))).alias("line"))

    old = before.join(dossiers.select("slug"), "slug", "left_semi")
    changes = document_changes(split(old), split(dossiers))
    times = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" times)"))).otherwise("")
    added = F.col("change") == "added"
    shown = F.concat(F.when(added, "+ ").otherwise("- "), "line", times)
    return changes.groupBy(F.col("key").alias("slug")).agg(joined_in_order(F.struct(added.alias("a"), "line"), shown, "\n").alias("diff"))


def document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines (key, line) added or removed between two versions, with multiplicity."""
    signed = after.select("key", "line", F.lit(1).alias("d")).unionByName(before.select("key", "line", F.lit(-1).alias("d")))
    return (
        signed.groupBy("key", "line")
        .agg(F.sum("d").alias("n"))
        .where(F.col("n") != 0)
        .select("key", "line", F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), F.abs("n").alias("n"))
    )


def queue_listing(queue: DataFrame) -> DataFrame:
    return queue.select(
        "request_id", "entity", "note", F.coalesce("status", F.lit("pending")).alias("status"),
        F.coalesce("ts", F.lit(0)).cast("long").alias("ts"),
    ).orderBy(F.desc("ts"), "request_id")


def submissions_with_audit(submissions: DataFrame, audits: DataFrame) -> DataFrame:
    """Submissions newest first with their audits by time, one row each; without audit the fields are null.

    Rows instead of an array, because one submission may have any number of audits. The inner join lets
    Spark split the audits of such a submission, which it cannot do on that side of an outer join.
    """
    work = audits.where(or_blank(F.col("submission_id")) != "").select(
        "submission_id",
        F.col("ts").alias("audit_ts"),
        F.col("status").alias("audit_status"),
        F.array_join("actions", ", ").alias("work_log"),
    )
    shown = submissions.select("submission_id", "ts", "entity", "player", "note")
    without = shown.join(work.select("submission_id").distinct(), "submission_id", "left_anti")
    return (
        shown.join(work, "submission_id")
        .unionByName(without, allowMissingColumns=True)
        .orderBy(F.desc("ts"), "submission_id", "audit_ts")
    )

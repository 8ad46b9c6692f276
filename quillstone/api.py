"""The calls a user makes: search, read a document, append facts and requests, rebuild the knowledge base."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import manifest, mentions, profiles, requests, search as searching, sessions
from quillstone.sources import sinks
from quillstone.sources.scans import scan_scope
from quillstone.sources.storage import pinned
from quillstone.sources.versions import write_tables

REBUILD_SCOPES = ("all", "campaign", "entity")


def search(docs: DataFrame, q: str, scope: str = "all", limit: int = searching.DEFAULT_LIMIT) -> DataFrame:
    """Ranked keyword search in documents (doc_id, scope, text); at most 30 rows."""
    return searching.keyword_search(scan_scope(docs, scope, key=None), q, searching.clamp(limit))


def semantic_search(vectors: DataFrame, query: Column, limit: int = searching.DEFAULT_LIMIT) -> DataFrame:
    return searching.semantic_search(vectors, query, searching.clamp(limit))


def get_doc(docs: DataFrame, doc_id, max_chars: int = 8000) -> DataFrame:
    return searching.get_doc(docs, doc_id, max_chars)


def append_facts(payloads: DataFrame, now: Column, facts_path: str, audit_path: str) -> None:
    """Append facts and their audit rows; ``now`` is a fixed time, so a retry writes the same rows."""
    facts = requests.fact_rows(payloads, now)
    sinks.append_jsonl(facts, facts_path)
    sinks.append_jsonl(requests.fact_audit(facts), audit_path)


def append_requests(payloads: DataFrame, now: Column, queue_path: str) -> None:
    sinks.append_jsonl(requests.short_requests(payloads, now), queue_path)


@dataclass(frozen=True)
class Sources:
    """Input tables of a rebuild."""

    catalog: DataFrame  # pos, canonical, type, synonyms
    notes: DataFrame  # session, source, text
    inputs: DataFrame  # line_no, entity, player, date, note
    entity_files: DataFrame  # scope, path, name
    timeline_events: DataFrame  # file, seq, date_or_session, text
    imports: DataFrame | None = None  # session, source, text; read after the notes and before the inputs


def rebuild(sources: Sources, target: str = "", scope: str = "all", inputs_name: str = "submissions") -> dict[str, DataFrame]:
    """Tables of the knowledge base.

    Every scope gives profiles and indexes; ``all`` and ``campaign`` also the manifest and the first
    introductions. ``target`` limits the profiles, never the indexes.
    """
    scope = (scope or "all").lower()
    out: dict[str, DataFrame] = {}
    if scope not in REBUILD_SCOPES:
        return out
    aliases = mentions.dedupe_aliases(mentions.expand_aliases(sources.catalog))
    found = pinned(
        mentions.all_mentions(
            mentions.match_mentions(sources.notes, aliases),
            *([] if sources.imports is None else [mentions.match_mentions(sources.imports, aliases, src_rank=1)]),
            mentions.match_player_inputs(sources.inputs, aliases, sources.catalog, inputs_name),
        )
    )
    out["mentions"] = found
    out["coverage_index"] = profiles.coverage_index(sources.catalog, found)
    out["entity_index"] = profiles.entity_index(sources.catalog, found)
    out["entity_documents"] = profiles.entity_document(mentions.target_filter(sources.catalog, target), found)
    if scope in ("all", "campaign"):
        files = manifest.manifest_rows(sources.entity_files)
        campaign = files.where(F.col("scope") == "campaign")
        general = files.where(F.col("scope") == "general")
        out["manifest"] = pinned(manifest.manifest_union(campaign, general))
        first = sessions.first_event_per_entity(out["manifest"], sources.timeline_events)
        out["intro_timeline"] = sessions.intro_order(first)
    return out


def publish_rebuild(sources: Sources, root: str, target: str = "", scope: str = "all", inputs_name: str = "submissions") -> str:
    """Write the tables of a ``rebuild`` below ``root`` and make them current together; gives the new version's folder.

    A table that cannot be made ends the run and leaves the version before it in place. ``versions.read_table`` reads
    what is current.
    """
    tables = rebuild(sources, target, scope, inputs_name)
    if not tables:
        raise ValueError(f"unknown scope {scope!r}")
    spark = sources.catalog.sparkSession
    return write_tables(spark, root, [(name, lambda t=t: t) for name, t in tables.items()])

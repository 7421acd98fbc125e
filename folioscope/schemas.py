"""Schemas of the knowledge base's relations, as DDL."""

OCCURRENCE = "struct<doc_id: bigint, page: int, chunk_index: bigint>"
COOCCURRENCE = "struct<term: string, frequency: bigint, confidence: double>"
TABLE = "struct<page: int, data: array<array<string>>, rows: int, columns: int>"

RELATIONS = {
    "documents": "doc_id bigint, filename string, source_type string, total_pages bigint",
    "pages": f"doc_id bigint, page int, text string, lines int, tables array<{TABLE}>, images array<string>",
    "chunks": "doc_id bigint, chunk_id string, chunk_index bigint, page int, text string",
    "candidates": "kind string, term string, doc_id bigint, page int, chunk_index bigint, score double",
    "terms": "term_key string, term string, term_type string, full_form string, meaning string, total_count bigint, mean_score double",
    "cooccurrences": "kind string, term string, other string, frequency bigint, confidence double, rank int",
    "links": "acronym string, keyword string, match_score double",
    "votes": "item string, round int, model_id string, seq int, key string",
}

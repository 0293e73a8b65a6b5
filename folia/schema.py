"""The five relations and their fixed value sets."""

from __future__ import annotations

DOCUMENTS = "doc_id string, doc_type string, source string, content_hash string, metadata string, created_at double, updated_at double"
ELEMENTS = "element_pk bigint, element_id string, doc_id string, element_type string, parent_id string, ord int, content_preview string, content_location string, content_hash string, metadata string"
RELATIONSHIPS = "relationship_id string, doc_id string, source_id string, relationship_type string, target_reference string, metadata string"
EMBEDDINGS = "element_pk bigint, embedding array<float>, dimensions int, created_at double"
HISTORY = "source_id string, content_hash string, last_modified double, processing_count int"

# Element types that hold other elements.
CONTAINERS = [
    "root", "div", "article", "section", "list", "table", "page", "xml_list", "xml_object", "table_header", "table_header_row", "presentation_body",
    "slide", "comments_container", "comments", "json_array", "json_object", "slide_masters", "slide_templates", "headers", "footers", "page_header", "page_footer", "body",
]

# Element types whose likeness across documents makes an edge.
SECTION_TYPES = ["body", "div", "list", "header", "section", "title", "h1", "h2", "h3", "h4", "h5", "h6"]

# Categories of relationship types; all others are unknown.
STRUCTURAL = ["next_sibling", "previous_sibling", "contains", "contained_by", "contains_row", "contains_cell", "contains_item"]
EXPLICIT = ["link", "referenced_by"]
SEMANTIC = ["semantic_similarity"]

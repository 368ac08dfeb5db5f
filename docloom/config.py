"""Constants and rule tables.  Names of people, projects and mailboxes are configuration and empty or generic here."""

from __future__ import annotations

# They must equal those that existing stores were chunked and enriched with.
MAX_SECTION = 1500
RECURSIVE_CHUNK = 1000
RECURSIVE_OVERLAP = 200
EMAIL_SINGLE = 500
EMAIL_CHUNK = 800
BOLD_TITLE_MAX = 80
BLANK_RATIO = 0.15
MIN_BLANKS = 3
MIN_HEADINGS = 2
SHEET_SINGLE_ROWS = 5
GROUP_LEAST, GROUP_MOST, GROUP_REPEAT, GROUP_PRESENCE = 2, 8, 1.5, 0.5
LONG_HEADER = 100
METADATA_MIN_WORDS = 20
OCR_PAGE_CHARS = 50
HEADING_SIZE, TOP_HEADING_SIZE, NEAR_BODY, BOLD_HEADING_CHARS = 1.3, 1.5, 0.1, 100
PDF_SAMPLE_PAGES, PDF_DEFAULT_SIZE, PDF_MIN_CHARS, PDF_MIN_SIZES = 5, 11.0, 100, 3
EMBED_BATCH, EMBED_TRIES, EMBED_WAIT = 100, 3, 2.0

# The quarter of each sprint, and the calendar of sprints.
SPRINT_QUARTERS = {1: "Q1", 2: "Q1", 3: "Q1", 4: "Q2", 5: "Q2", 6: "Q2", 7: "Q3", 8: "Q3", 9: "Q3", 10: "Q4", 11: "Q4", 12: "Q4", 13: "Q4"}
SPRINT_FIRST_DAY, SPRINT_DAYS, SPRINTS = "2025-01-01", 14, 13

# Kinds of documents, and those that must, must not or may lack a sprint or quarter.
DOC_TYPES = ("jira", "retro", "okr", "roadmap", "planning", "meeting_notes", "technical_spec", "email")
SPRINT_REQUIRED = ("jira", "retro", "meeting_notes", "planning")
SPRINT_FORBIDDEN = ("okr", "roadmap", "technical_spec")
QUARTER_FREE = ("okr", "roadmap")
# The categories of the verifier's summary.
ISSUE_CATEGORIES = (
    "sprint", "quarter", "doc_type", "folder", "source_type", "sheet_name", "section_heading", "sender", "subject", "chunk_index",
    "document_title", "author", "file_created_at", "file_updated_at", "people", "features", "ticket_ids", "metrics", "chunk_type",
)

TICKET = r"\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-\d+\b"

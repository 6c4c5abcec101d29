"""Values that are part of the query semantics."""

# Chunking, in words.
CHUNK_SIZE = 250
CHUNK_OVERLAP = 50

# Request limits.
DEFAULT_LIMIT = 5
MAX_LIMIT = 20
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_MESSAGE_CHARS = 8000

# Prompt budget.
CONTEXT_CHUNKS = 5
HISTORY_MESSAGES = 8
CONTEXT_CHARS = 12000
HISTORY_CHARS = 4000
SOURCE_CHARS = 1800
FALLBACK_SOURCES = 3
EXCERPT_CHARS = 700

# Stored lengths.
CONVERSATION_TITLE_CHARS = 80
MESSAGE_LABEL_CHARS = 80
PREVIEW_CHARS = 500
ERROR_CHARS = 2000
NODE_TITLE_CHARS = 255
MEMORY_TITLE_CHARS = 180
TAG_CHARS = 40
MAX_TAGS = 12

# Digest.
DIGEST_ITEMS = 5

EMBEDDING_DIMENSIONS = 384

# The characters Python's str.strip and str.split treat as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The characters that end a line.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Enumerations and their labels.
FILE_TYPES = {"pdf": "PDF", "txt": "Text", "docx": "DOCX", "link": "Link", "note": "Note"}
PROCESSING_STATUSES = {
    "pending": "Pending", "processing": "Processing", "completed": "Completed", "failed": "Failed",
}
MEMORY_CATEGORIES = {
    "fact": "Fact", "preference": "Preference", "summary": "Summary", "note": "Note", "pinned": "Pinned",
}
NODE_TYPES = {
    "person": "Person", "project": "Project", "company": "Company", "technology": "Technology",
    "topic": "Topic", "concept": "Concept", "other": "Other",
}
RELATIONSHIP_TYPES = {
    "works_on": "Works On", "uses": "Uses", "belongs_to": "Belongs To",
    "references": "References", "related_to": "Related To",
}
MESSAGE_ROLES = {"user": "User", "assistant": "Assistant"}
TASK_STATUSES = {"pending": "Pending", "in_progress": "In Progress", "completed": "Completed"}
TASK_PRIORITIES = {"low": "Low", "medium": "Medium", "high": "High"}

# Types accepted on upload, and the suffixes file-backed types need.
UPLOAD_TYPES = ("note", "pdf", "txt", "link")
UPLOAD_SUFFIXES = {"pdf": ".pdf", "txt": ".txt"}

# Messages of refused uploads. {TYPE} is the upper-case file type.
BAD_TYPE = "Supported MVP types are note, pdf, txt, and link."
TOO_LARGE = "File is too large for MVP ingestion."
NOTE_WITHOUT_TEXT = "Notes require text content."
FILE_MISSING = " documents require a file."
WRONG_SUFFIX_START = "Expected a "
WRONG_SUFFIX_END = " file."
LINK_WITHOUT_URL = "Links require a source URL."

# Messages of failed extraction and processing.
EMPTY_NOTE = "Note is empty."
EMPTY_TXT = "Text file is empty."
EMPTY_PDF = "No selectable text found in this PDF."
EMPTY_DOCX = "DOCX file contains no selectable text."
LINK_UNSUPPORTED = "Link extraction is not implemented in this MVP yet."
UNSUPPORTED_TYPE = "Unsupported document type: "
NO_CHUNKS = "Document text did not produce any chunks."

# Messages of other refused requests.
TITLE_REQUIRED = "Title is required."
CONTENT_REQUIRED = "Content is required."
FIELD_REQUIRED = "This field is required."
FIELD_BLANK = "This field may not be blank."
INTEGER_REQUIRED = "A valid integer is required."
LIMIT_NOT_INTEGER = "limit must be an integer."

# Placeholders and answer text of a chat exchange.
NO_HISTORY = "No previous messages."
NO_CONTEXT = "No relevant context retrieved."
NO_SOURCES_ANSWER = (
    "I could not find relevant processed document chunks for this question. "
    "Upload or reprocess documents, then try again."
)
ANSWER_START = 'Based on the retrieved document context for "'
ANSWER_MIDDLE = '", the most relevant evidence is in '
HISTORY_HEADING = "Conversation history:\n"
CONTEXT_HEADING = "Retrieved context:\n"
QUESTION_HEADING = "User question:\n"

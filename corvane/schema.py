"""Schemas of the entry store. Entries are facts; the other tables hang off them."""

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType())}


def names(ddl: str) -> list[str]:
    """Column names of a flat schema text."""
    return [x.split()[0] for x in ddl.split(", ")]


def _schema(ddl: str) -> T.StructType:
    """A flat schema text as a StructType; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


ENTRIES = _schema(
    "id string, thread_id string, source string, content_type string, text_content string, metadata string, summary string, "
    "content_hash string, version bigint, created_at timestamp, updated_at timestamp"
)
TAGS = _schema("context_entry_id string, tag string")
IMAGES = _schema("context_entry_id string, image_data binary, mime_type string, image_metadata string, position int")
EMBEDDING_METADATA = _schema("context_id string, model_name string, dimensions int, chunk_count int, created_at timestamp, updated_at timestamp")
CHUNKS = _schema("context_id string, chunk_index int, start_index int, end_index int, embedding array<float>")
CHUNKS_COMPRESSED = _schema("context_id string, chunk_index int, start_index int, end_index int, payload binary")
COMPRESSION = _schema("provider string, bits int, variant string, seed bigint, dim int, codebook_fingerprint string")
INDEX_NODES = _schema("context_id string, node_id string, level int, ordinal int, title string, node_summary string, char_start int, char_end int")
#: Which text, by its hash, something that hangs off an entry was made from.
DERIVATIONS = _schema("context_id string, kind string, content_hash string")

TABLES = {
    "entries": ENTRIES, "tags": TAGS, "images": IMAGES, "embedding_metadata": EMBEDDING_METADATA, "chunks": CHUNKS,
    "chunks_compressed": CHUNKS_COMPRESSED, "compression": COMPRESSION, "index_nodes": INDEX_NODES, "derivations": DERIVATIONS,
}
#: Column of each table that refers to an entry.
ENTRY_KEY = {"entries": "id", "tags": "context_entry_id", "images": "context_entry_id", "embedding_metadata": "context_id", "chunks": "context_id", "chunks_compressed": "context_id", "index_nodes": "context_id", "derivations": "context_id"}

#: Limits that are part of the semantics.
MAX_PAGE, RANK_DEPTH, MAX_OFFSET = 100, 100, 1_000_000
MAX_IN_LIST, MAX_FILTERS, MAX_TAGS, MAX_TAG_CHARS, MAX_IMAGES, MAX_THREAD_CHARS, MAX_QUERY_CHARS = 100, 100, 100, 128, 10, 256, 10_000
#: Sections of an entry that get a summary.
MAX_SUMMARIES = 200
#: Decoded size of one image.
MAX_IMAGE_BYTES = 10 << 20

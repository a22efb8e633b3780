"""Schemas of the stored tables."""

CHUNK_FIELDS = (
    "repository string, file string, language string, code string, start_line int, end_line int, commit string, version string, "
    "timestamp double, class_name string, function string, kind string, parent string, part int, signature string, doc string, "
    "imports array<string>, calls array<string>"
)
CHUNKS = CHUNK_FIELDS + ", chash string, doc_id string"
FILES = "path string, blob string, size long"
VERSIONS = "repository string, label string, commit string, timestamp double, n_chunks long, embedder string, representation string, base string, seq long, avgdl double, buckets int"
CACHE = "repository string, model_version string, representation string, cache_key string, vector array<float>"

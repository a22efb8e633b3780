"""DuckDB SQL for the queries of the catalogue, written independently of Spark's plans."""

from __future__ import annotations

from lodeseek.functions import query as Q
from lodeseek.functions import text as T
from lodeseek.plans.catalog import EXAMPLES


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_lit, values)) + "]"


WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z_][a-z0-9_]*')"
HASH = r"substr(sha1(trim(regexp_replace({0}, '\s+', ' ', 'g'))), 1, 16)"
SPLIT = r"list_filter(string_split_regex(lower(translate(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '_', ' ')), ' +'), lambda z: z <> '')"
STEM = r"regexp_replace({0}, '^(.{{3,}}?)(?:izations?|iz(?:e[sdr]?|ing)|is(?:e[sdr]?|ing)|ations?|ings?|ed|es|s|e)$', '\1')"
NAMES = "regexp_extract_all(coalesce({0}, ''), '[A-Za-z_][A-Za-z0-9_]*')"


def _name_words(text: str) -> str:
    return f"array_to_string(flatten(list_transform({NAMES.format(text)}, lambda x: {SPLIT.format('x')})), ' ')"


def _tokens(text: str) -> str:
    parts = f"list_transform(list_filter({SPLIT.format('x')}, lambda y: NOT list_contains({_list(T.STOPWORDS)}, y)), lambda y: {STEM.format('y')})"
    return f"flatten(list_transform({NAMES.format(text)}, lambda x: CASE WHEN len({SPLIT.format('x')}) > 1 THEN list_concat([lower(x)], {parts}) ELSE {parts} END))"


CORPUS = f"corpus AS (SELECT doc_id AS chunk_id, {WORDS.format('text')} AS tokens FROM documents)"
ASKED = f"asked AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL)"
POSTINGS = f"""{CORPUS}, tf AS (
  SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM corpus) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), whole AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM corpus
), postings AS (
  SELECT tf.chunk_id, tf.term, tf, len(tokens) AS dl, df,
    ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / avgdl)) AS impact
  FROM tf JOIN df USING (term) JOIN corpus USING (chunk_id) CROSS JOIN whole
)"""
SCORED = f"""{POSTINGS}, {ASKED}, scored AS (
  SELECT query_id, chunk_id, round(sum(weight * impact), 9) AS score FROM postings JOIN asked USING (term) GROUP BY ALL
)"""


def _best(source: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k})"


CHUNKS = f"""chunks AS (
  SELECT doc_id AS chunk_id, source AS repository, concat_ws('/', 'src', source, lang, 'FileNo' || doc_id || '.py') AS file, lang AS language, coalesce(text, '') AS code,
    'HTTPServer' || upper(lang) AS class_name, 'read_doc' || (doc_id % 50) AS function, (doc_id % 3)::INTEGER AS part, ['os.path', lang] AS imports,
    list_slice(calls_, 1, 3) AS calls
  FROM (SELECT *, list_transform(list_filter(list_zip(w, range(len(w))), lambda z: list_position(w, z[1]) = z[2] + 1), lambda z: z[1]) AS calls_ FROM (SELECT *, {WORDS.format('text')} AS w FROM documents))
)"""
QUALNAME = "class_name || '.' || function || CASE WHEN part > 0 THEN '#' || part ELSE '' END"
TEXTS = "texts AS (SELECT item_id AS query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark UNION ALL SELECT 10000000 + i, trim(regexp_replace(t, '\\s+', ' ', 'g')) FROM (VALUES " + ", ".join(f"({i}, {_lit(t)})" for i, t in enumerate(EXAMPLES)) + ") v(i, t))"


def _ordered_unique(column: str) -> str:
    return f"list_transform(list_filter(list_zip({column}, range(len({column}))), lambda z: list_position({column}, z[1]) = z[2] + 1), lambda z: z[1])"


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(bare, {_lit(pattern)}, {group})"


def _not_names(patterns: list[str]) -> str:
    found = "list_concat(" + ", ".join(_all(p, 1) for p in patterns) + ")"
    return f"list_filter(list_transform({found}, lambda x: lower(x)), lambda x: NOT list_contains({_list([*Q.NOT_NAMES, *T.STOPWORDS])}, x))"


_names = [_all(Q.CALL_PATTERN, 1), _all(Q.BACKTICK_PATTERN, 1), *(_all(p) for p in Q.NAME_PATTERNS.values())]
_raw_names = "[]::VARCHAR[]"
for _part in _names:
    _raw_names = f"list_concat({_raw_names}, {_part})"
_stems: dict[str, str] = {}
UNDERSTOOD = f"""{TEXTS}, bared AS (
  SELECT *, list_transform(regexp_extract_all(text, {_lit(Q.FILE_PATTERN)}), lambda x: lower(x)) AS file_names, regexp_replace(text, {_lit(Q.FILE_PATTERN)}, ' ', 'g') AS bare FROM texts
), named AS (
  SELECT *, list_transform(list_filter({_raw_names}, lambda x: length(x) > 2), lambda x: lower(regexp_replace(x, '[()]+$', ''))) AS names,
    list_concat({_not_names(Q.FUNCTION_PATTERNS)}, list_transform({_all(Q.CALL_PATTERN, 1)}, lambda x: lower(x))) AS fn,
    list_concat({_not_names(Q.CLASS_PATTERNS)}, list_transform({_all(Q.NAME_PATTERNS['pascal'])}, lambda x: lower(x))) AS cn,
    list_transform({_all('[A-Za-z_]' + chr(92) + 'w*')}, lambda x: lower(x)) AS words,
    regexp_matches(text, {_lit(Q.ERROR_PATTERN)}) AS has_error_text,
    lower(regexp_extract(text, {_lit(Q.LANGUAGE_PATTERN)}, 1)) AS lang_
  FROM bared
), split AS (
  SELECT *, list_concat(names, flatten(list_transform(list_filter(names, lambda x: contains(x, '.')), lambda x: string_split(x, '.')))) AS ids,
    list_concat({_tokens('bare')}, {_tokens("array_to_string(file_names, ' ')")}) AS tokens,
    list_filter(words, lambda x: list_contains({_list(Q.LIBRARIES)}, x)) AS libraries
  FROM named
), understood AS (
  SELECT *, {_ordered_unique('ids')} AS identifiers, {_ordered_unique('fn')} AS function_names, {_ordered_unique('cn')} AS class_names,
    CASE lang_ WHEN 'golang' THEN 'go' WHEN 'c++' THEN 'cpp' WHEN 'c#' THEN 'csharp' ELSE lang_ END AS language, lower(text) AS low
  FROM split
)"""
_rules = "".join(
    f" WHEN regexp_matches(low, {_lit(p)})" + (" AND (len(libraries) > 0 OR contains(low, 'api') OR contains(low, 'how'))" if n == "API_USAGE" else "") + f" THEN {_lit(n)}" for n, p in Q.CATEGORY_PATTERNS.items()
)
CATEGORY = f"""CASE WHEN has_error_text AND regexp_matches(low, {_lit(Q.ERROR_WORDS)}) THEN 'ERROR_MESSAGE' WHEN len(file_names) > 0 THEN 'FILE_LOOKUP'
  WHEN len(class_names) > 0 AND regexp_matches(low, {_lit(Q.CLASS_WORDS)}) THEN 'CLASS_LOOKUP'
  WHEN (len(identifiers) > 0 AND (len(string_split(text, ' ')) <= 6 OR regexp_matches(low, {_lit(Q.PLACE_WORDS)}))) OR (len(function_names) > 0 AND len(string_split(text, ' ')) <= 6) THEN 'FUNCTION_LOOKUP'
  {_rules} WHEN len(libraries) > 0 THEN 'API_USAGE' ELSE 'GENERAL_SEMANTIC_SEARCH' END"""
_concepts = ", ".join(f"({i}, {_lit(k)}, {_lit(' '.join(v))})" for i, (k, v) in enumerate(Q.CONCEPTS.items()))
EXPANDED = f"""{UNDERSTOOD}, concepts AS (
  SELECT stem, arg_max(related, i) AS related FROM (SELECT i, {STEM.format('k')} AS stem, string_split(v, ' ') AS related FROM (VALUES {_concepts}) c(i, k, v)) GROUP BY stem
), acts AS (
  SELECT query_id, pos, w FROM (SELECT query_id, unnest(words) AS w, unnest(range(len(words))) AS pos FROM understood)
), related AS (
  SELECT query_id, pos, nth, {STEM.format('r')} AS t FROM (SELECT a.query_id, a.pos, unnest(c.related) AS r, unnest(range(len(c.related))) AS nth FROM acts a JOIN concepts c ON c.stem = {STEM.format('a.w')})
), firsts AS (
  SELECT query_id, t, min(pos * 1000 + nth) AS place FROM related r WHERE NOT EXISTS (SELECT 1 FROM understood u WHERE u.query_id = r.query_id AND list_contains(u.tokens, r.t)) GROUP BY ALL
), expanded AS (
  SELECT query_id, list(t ORDER BY place) AS expansion FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM firsts) WHERE n <= 16 GROUP BY query_id
)"""


def _files(version: int) -> str:
    if version == 1:
        return "SELECT 'd/' || doc_id || '.py' AS path, sha1(coalesce(text, '')) AS blob FROM documents WHERE doc_id % 17 <> 0"
    return "SELECT 'd/' || doc_id || '.py' AS path, sha1(coalesce(text, '') || CASE WHEN doc_id % 10 < 3 THEN ' edited' ELSE '' END) AS blob FROM documents WHERE doc_id % 19 <> 0"


FILES = f"v1 AS ({_files(1)}), v2 AS ({_files(2)})"
CHANNELS = f"""{SCORED}, {CHUNKS}, sizes AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id
), overlap AS (SELECT query_id, chunk_id, round(count(*) / any_value(n)::DOUBLE, 9) AS score FROM postings JOIN asked USING (term) JOIN sizes USING (query_id) GROUP BY ALL
), own AS (
  SELECT chunk_id, unnest(calls) AS name, 0.5 AS score FROM chunks UNION ALL SELECT chunk_id, function, 1.0 FROM chunks UNION ALL SELECT chunk_id, lower(class_name), 1.0 FROM chunks
), exact AS (SELECT query_id, chunk_id, max(score) AS score FROM own JOIN asked ON name = term GROUP BY ALL
), {_best('overlap', 30, 'c1')}, {_best('scored', 30, 'c2')}, {_best('exact', 30, 'c3')}, channels AS (
  SELECT 'dense' AS channel, * FROM c1 UNION ALL SELECT 'bm25', * FROM c2 UNION ALL SELECT 'identifier', * FROM c3
), scaled AS (
  SELECT *, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN hi > 0 THEN 1.0 ELSE 0.0 END, 9) AS normal
  FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM channels WINDOW w AS (PARTITION BY channel, query_id))
), gathered AS (
  SELECT query_id, chunk_id,
    coalesce(max(normal) FILTER (channel = 'dense'), 0.0) AS dense_n, coalesce(max(normal) FILTER (channel = 'bm25'), 0.0) AS bm25_n, coalesce(max(normal) FILTER (channel = 'identifier'), 0.0) AS identifier_n,
    max(rank) FILTER (channel = 'dense') AS dense_rank, max(rank) FILTER (channel = 'bm25') AS bm25_rank, max(rank) FILTER (channel = 'identifier') AS identifier_rank,
    string_agg(channel, '+' ORDER BY channel) AS method
  FROM scaled GROUP BY ALL
)"""
CONTAINED = "contained AS (SELECT item_id AS query_id, doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)"
_fused = "(SELECT query_id, chunk_id, {score} AS score FROM gathered)"
JUDGED = f"""{SCORED}, {_best('scored', 100, 'run')}, {CONTAINED}, qrels AS (
  SELECT * FROM contained UNION ALL SELECT item_id, -1, 0 FROM benchmark
), judged AS (
  SELECT q.query_id, q.rel, r.rank, row_number() OVER (PARTITION BY q.query_id ORDER BY rel DESC, doc_id) AS ideal FROM qrels q LEFT JOIN run r ON r.query_id = q.query_id AND r.chunk_id = q.doc_id
)"""


def _measures(k: int) -> str:
    return f"""SELECT query_id,
  coalesce(sum(rel / log2(rank + 1)) FILTER (rank <= {k}), 0.0) / nullif(sum(rel / log2(ideal + 1)) FILTER (ideal <= {k}), 0) AS ndcg,
  1.0 / min(rank) FILTER (rel > 0 AND rank <= {k}) AS mrr,
  count(*) FILTER (rel > 0 AND rank <= {k}) / nullif(count(*) FILTER (rel > 0), 0)::DOUBLE AS recall
FROM judged GROUP BY query_id"""


VERSIONED = f"""{SCORED}, {_best('scored', 10, 'top')}, versioned AS (
  SELECT t.query_id, t.chunk_id * 2 + n AS chunk_id, CASE n WHEN 0 THEN t.score ELSE t.score / 2 END AS score, t.rank, 'v' || (n + 1) AS version,
    'read_doc' || (t.chunk_id % 50) AS function, d.source || '::read_doc' || (t.chunk_id % 50) AS identity
  FROM top t CROSS JOIN (VALUES (0), (1)) v(n) JOIN documents d ON d.doc_id = t.chunk_id
), merged AS (
  SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version, rank, chunk_id) AS place FROM versioned
)"""
RENAMED = f"""WITH RECURSIVE {VERSIONED}, units AS (
  SELECT v.query_id, v.chunk_id, v.score, v.version, v.chunk_id // 2 AS unit, v.version = 'v2' AND (v.chunk_id // 2) % 10 < 3 AS edited, v.function, v.identity FROM versioned v
), named AS (
  SELECT u.query_id, u.chunk_id, u.version, CASE WHEN edited THEN 'new_' ELSE '' END || u.function AS function, CASE WHEN edited THEN 'new_' ELSE '' END || u.identity AS identity,
    concat_ws('/', 'src', d.source, d.lang, 'FileNo' || d.doc_id || '.py') AS file,
    CASE WHEN edited AND unit % 10 = 2 THEN 'nothing of it is left' ELSE coalesce(d.text, '') END AS code,
    (unit + CASE WHEN edited AND unit % 10 = 1 THEN 1 ELSE 0 END) % 500 AS vec_id, row_number() OVER (PARTITION BY u.query_id ORDER BY u.score DESC, u.chunk_id) AS place
  FROM units u JOIN documents d ON d.doc_id = unit
), bodied AS (
  SELECT n.*, e.embedding::DOUBLE[] AS vector, list_distinct(list_filter({WORDS.format('n.code')}, lambda w: w <> lower(n.function))) AS body FROM named n JOIN embeddings e USING (vec_id)
), matches AS (
  SELECT b.query_id, b.place, list(a.place ORDER BY a.place) AS earlier FROM bodied a JOIN bodied b ON a.query_id = b.query_id AND a.place < b.place
    AND (a.identity = b.identity OR a.file = b.file AND a.version <> b.version AND list_inner_product(a.vector, b.vector) >= 0.9
      AND (len(a.body) + len(b.body) = 0 OR len(list_intersect(a.body, b.body)) / (len(a.body) + len(b.body) - len(list_intersect(a.body, b.body)))::DOUBLE >= 0.6)) GROUP BY ALL
), listed AS (
  SELECT n.query_id, n.place, coalesce(m.earlier, []) AS earlier FROM named n LEFT JOIN matches m USING (query_id, place)
), walk AS (
  SELECT query_id, 1::BIGINT AS place, [1::BIGINT] AS kept, NULL::BIGINT AS home FROM listed WHERE place = 1
  UNION ALL
  SELECT w.query_id, l.place, CASE WHEN list_has_any(l.earlier, w.kept) THEN w.kept ELSE list_append(w.kept, l.place) END,
    CASE WHEN list_has_any(l.earlier, w.kept) THEN list_min(list_intersect(l.earlier, w.kept)) END
  FROM walk w JOIN listed l ON l.query_id = w.query_id AND l.place = w.place + 1
), absorbed AS (
  SELECT w.query_id, w.home, string_agg(n.version || ':' || n.function, ',' ORDER BY n.place) AS also_in FROM walk w JOIN named n USING (query_id, place) WHERE home IS NOT NULL GROUP BY ALL
)
SELECT n.query_id, n.chunk_id, coalesce(a.also_in, '') AS also_in FROM walk w JOIN named n USING (query_id, place) LEFT JOIN absorbed a ON a.query_id = w.query_id AND a.home = w.place WHERE w.home IS NULL"""
LAMBDAS = f"""WITH {SCORED}, {_best('scored', 30, 'run')}, {CONTAINED}, graded AS (
  SELECT r.query_id, r.chunk_id, round(r.score, 6) AS score, CASE WHEN c.doc_id IS NULL THEN 0.0 ELSE 1.0 END AS label FROM run r LEFT JOIN contained c ON c.query_id = r.query_id AND c.doc_id = r.chunk_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, chunk_id) AS best FROM graded
), discounted AS (
  SELECT *, CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END AS discount, sum(CASE WHEN best <= 10 THEN label / log2(best + 1) ELSE 0 END) OVER (PARTITION BY query_id) AS ideal FROM placed
), pairs AS (
  SELECT h.query_id, h.chunk_id AS high, l.chunk_id AS low, 1 / (1 + exp(h.score - l.score)) AS rho, abs(h.discount - l.discount) / h.ideal AS change
  FROM discounted h JOIN discounted l ON h.query_id = l.query_id AND h.label > l.label
), moved AS (
  SELECT query_id, high AS chunk_id, rho * change AS g, rho * (1 - rho) * change AS h FROM pairs UNION ALL SELECT query_id, low, -rho * change, rho * (1 - rho) * change FROM pairs
)
SELECT d.query_id, d.chunk_id, round(coalesce(sum(m.g), 0.0), 5) + 0.0::DOUBLE AS gradient, round(coalesce(sum(m.h), 0.0), 5) + 0.0::DOUBLE AS curvature FROM discounted d LEFT JOIN moved m USING (query_id, chunk_id) GROUP BY d.query_id, d.chunk_id"""
_weights = "CASE category " + " ".join(f"WHEN '{n}' THEN [{', '.join(str(a * b) for a, b in zip(f, (0.55, 0.30, 0.15), strict=True))}]" for n, f in Q.CATEGORY_FACTORS.items()) + " END"
COSINE = "SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"

def _share(of: str, among: str) -> str:
    return f"CASE WHEN len({of}) > 0 THEN len(list_intersect({of}, {among})) / len(list_distinct({of}))::DOUBLE ELSE 0.0 END"


FEATURED = rf"""WITH {CHANNELS}, {EXPANDED}, fused AS (
  SELECT query_id, chunk_id, dense_n, bm25_n, identifier_n, 0.55 * dense_n + 0.30 * bm25_n + 0.15 * identifier_n AS score FROM gathered
), {_best('fused', 10, 'head')}, asking AS (
  SELECT u.query_id, list_concat(u.tokens, coalesce(e.expansion, [])) AS words, u.tokens AS own_words, list_concat(list_concat(u.function_names, u.class_names), u.identifiers) AS entities FROM understood u LEFT JOIN expanded e USING (query_id)
), described AS (
  SELECT chunk_id, lower(function) AS function, list_transform(calls, lambda x: lower(x)) AS calls, {_tokens('function')} AS fn, {_tokens('class_name')} AS cls, {_tokens("regexp_replace(file, '[.][A-Za-z0-9]*$', '')")} AS path, {_tokens("'Reads a document.'")} AS doc FROM chunks
), met AS (
  SELECT h.*, d.* EXCLUDE (chunk_id), a.* EXCLUDE (query_id), list(d.function) FILTER (d.function <> '') OVER q AS functions, flatten(list(d.calls) OVER q) AS called
  FROM head h JOIN described d USING (chunk_id) JOIN asking a USING (query_id) WHERE h.score > 0 WINDOW q AS (PARTITION BY h.query_id)
), matched AS (
  SELECT query_id, chunk_id, rank, dense_n AS semantic, bm25_n AS bm25, identifier_n AS identifier, {_share('fn', 'words')} AS function_match, {_share('cls', 'words')} AS class_match, {_share('path', 'words')} AS path_match, {_share('own_words', 'doc')} AS doc_overlap,
    CASE WHEN list_has_any(calls, entities) THEN 1.0 WHEN list_has_any(calls, list_filter(functions, lambda x: x <> function)) OR list_contains(called, function) THEN 0.5 ELSE 0.0 END AS structural
  FROM met
), summed AS (
  SELECT *, (function_match + class_match + path_match + doc_overlap) / 4 AS metadata FROM matched
), weighed AS (
  SELECT *, 0.5 * semantic + 0.2 * bm25 + 0.1 * identifier + 0.1 * metadata + 0.1 * structural AS linear FROM summed
)
SELECT query_id, chunk_id, CASE WHEN rank > 5 THEN rank ELSE row_number() OVER (PARTITION BY query_id, rank <= 5 ORDER BY linear DESC, rank) END AS rank,
  round(semantic, 6) AS semantic, round(bm25, 6) AS bm25, round(identifier, 6) AS identifier, round(function_match, 6) AS function_match, round(class_match, 6) AS class_match, round(path_match, 6) AS path_match,
  round(doc_overlap, 6) AS doc_overlap, round(metadata, 6) AS metadata, round(structural, 6)::DOUBLE AS structural,
  coalesce(nullif(concat_ws('; ', CASE WHEN identifier >= 1 THEN 'defines a queried identifier' END, CASE WHEN structural >= 1 THEN 'calls a queried name' END, CASE WHEN function_match > 0 THEN 'function name matches query terms' END,
    CASE WHEN semantic >= 0.6 THEN 'high semantic similarity' END, CASE WHEN bm25 >= 0.6 THEN 'strong lexical match' END, CASE WHEN path_match > 0 THEN 'file path matches' END), ''), 'weaker partial match') AS why
FROM weighed"""


def _made_files(suffix: str, numbered: str, before: list[str], after: list[str], broken: str) -> str:
    """The made source files: id, url, number of numbered lines, and the lines of those with a long function or without units."""
    line = f"list_transform(range(m), lambda i: {numbered})"
    return f"""files AS (
  SELECT page_id AS id, page_id || '{suffix}' AS file, page_id % 4 AS shape, page_id % 97 + 40 AS m, regexp_replace(coalesce(url, ''), '[^a-z0-9:/.]', '', 'g') AS u FROM pages
), lined AS (
  SELECT *, list_concat(list_concat([{', '.join(before)}], {line}), [{', '.join(after)}]) AS long, list_concat([{broken}], {line}) AS bad FROM files
)"""


def _cut(columns: dict[str, str], lines: str, start: str, stop: str) -> str:
    code = f"array_to_string(list_slice({lines}, {start}, {stop}), chr(10))"
    return ", ".join(f"{v} AS {k}" for k, v in (columns | {"start_line": f"({start})::INTEGER", "end_line": f"({stop})::INTEGER", "chash": HASH.format(code)}).items())


def _unit(kind: str, **given: str) -> dict[str, str]:
    return {"file": "file", "kind": f"'{kind}'"} | {c: given.get(c, "''") for c in ("class_name", "function", "parent", "signature", "doc", "calls")} | {"part": given.get("part", "0") + "::INTEGER"}


def _whole(start: int, stop: int, code: str) -> str:
    return f"{start}::INTEGER AS start_line, {stop}::INTEGER AS end_line, {HASH.format(code)} AS chash"


def _fields(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def _python_chunks() -> str:
    imports = lambda text: {"imports": f"'{text}'"}
    name, long = "'page_' || id", _unit("function", function="'page_' || id", signature="'def page_' || id || '(x):'", calls="'step'") | imports("")
    block = _unit("block", function=name, parent=name, signature="'def page_' || id || '(x):'", calls="CASE WHEN m = 60 * p THEN '' ELSE 'step' END", part="p") | imports("")
    text = "'@cached def page_' || id || '(x): ''''''Doc.'''''' def inner(y): return strip(y) return inner(fetch(x))'"
    own = _unit("function", function=name, signature="'def page_' || id || '(x):'", doc="'Doc.'", calls="'inner,strip,fetch'") | imports("os,net.fetch")
    page = _unit("class", class_name="'Page'", signature="'class Page(Base):'", doc="'A page.'") | imports("os,net.fetch")
    url = _unit("method", class_name="'Page'", function="'url'", signature="'def url(self):'", calls="'join'") | imports("os,net.fetch")
    module = _unit("module", calls="'compute,print'") | imports("os")
    return f"""WITH {_made_files(".py", "'    x = step(x, ' || i || ')'", ["'def page_' || id || '(x):'"], ["'    return x'"], "'def broken_' || id || '(:'")}
SELECT {_fields(own)}, {_whole(4, 9, text)} FROM files WHERE shape = 0
UNION ALL SELECT {_fields(page)}, {_whole(11, 16, "'class Page(Base): def url(self):'")} FROM files WHERE shape = 0
UNION ALL SELECT {_fields(url)}, {_whole(15, 16, "'def url(self): return join(''' || u || ''')'")} FROM files WHERE shape = 0
UNION ALL SELECT {_cut(long, 'long', '1', 'm + 2')} FROM lined WHERE shape = 1 AND m + 2 <= 60
UNION ALL SELECT {_cut(block, 'long', 'CASE WHEN p = 0 THEN 1 ELSE 60 * p + 2 END', 'least(60 * p + 60, m + 1) + 1')} FROM (SELECT *, unnest(range(m // 60 + 1)) AS p FROM lined WHERE shape = 1 AND m + 2 > 60)
UNION ALL SELECT {_cut(_unit("file", part="p") | imports(""), 'bad', '60 * p + 1', 'least(60 * p + 60, m + 1)')} FROM (SELECT *, unnest(range(m // 60 + 1)) AS p FROM lined WHERE shape = 2)
UNION ALL SELECT {_fields(module)}, {_whole(3, 4, "'TOTAL = compute(' || id || ') print(TOTAL)'")} FROM files WHERE shape = 3"""


def _brace_chunks() -> str:
    name = "'long' || id"
    long = _unit("function", function=name, signature="'function long' || id || '(a)'", calls="'step'")
    block = _unit("block", function=name, parent=name, signature="'function long' || id || '(a)'", calls="'step'", part="p")
    load = _unit("function", function="'load' || id", signature="'function load' || id || '(a, b)'", doc="'Loads.'", calls="'go,run'")
    stop = _unit("method", class_name="'K'", function="'stop'", signature="'stop(x)'", calls="'halt'")
    pick = _unit("function", function="'pick' || id", signature="'const pick' || id || ' = (a) =>'", calls="'find'")
    return f"""WITH {_made_files(".js", "'  a = step(a, ' || i || ');'", ["'function long' || id || '(a)'", "'{'"], ["'  return a;'", "'}'"], "'start(' || id || ');'")}
SELECT {_fields(load)}, {_whole(2, 5, "'function load' || id || '(a, b) { if (a) { go(b); } return run(a); }'")} FROM files WHERE shape = 0
UNION ALL SELECT {_fields(_unit("class", class_name="'K'", signature="'class K {'"))}, {_whole(6, 11, "'class K {'")} FROM files WHERE shape = 0
UNION ALL SELECT {_fields(stop)}, {_whole(7, 10, "'stop(x) { const text = \"not a { brace\"; // nor { this return halt(x); }'")} FROM files WHERE shape = 0
UNION ALL SELECT {_fields(pick)}, {_whole(12, 14, "'const pick' || id || ' = (a) => { return find(\"' || u || '\"); };'")} FROM files WHERE shape = 0
UNION ALL SELECT {_cut(long, 'long', '1', 'm + 4')} FROM lined WHERE shape = 1 AND m + 4 <= 60
UNION ALL SELECT {_cut(block, 'long', '60 * p + 1', 'least(60 * p + 60, m + 4)')} FROM (SELECT *, unnest(range((m + 3) // 60 + 1)) AS p FROM lined WHERE shape = 1 AND m + 4 > 60)
UNION ALL SELECT {_cut(_unit("file", part="p"), 'bad', '60 * p + 1', 'least(60 * p + 60, m + 1)')} FROM (SELECT *, unnest(range(m // 60 + 1)) AS p FROM lined WHERE shape = 2)
UNION ALL SELECT {_fields(_unit("file"))}, {_whole(1, 2, "'let total = ' || id || '; show(total);'")} FROM files WHERE shape = 3"""


ORACLE: dict[str, str] = {
    "python_chunks": _python_chunks(),
    "brace_chunks": _brace_chunks(),
    "content_hash": f"SELECT doc_id, {HASH.format('text')} AS content_hash FROM documents",
    "exact_duplicates": f"SELECT content_hash, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, {HASH.format('text')} AS content_hash FROM documents) GROUP BY content_hash HAVING count(*) > 1",
    "unit_keys": f"WITH {CHUNKS} SELECT chunk_id, {QUALNAME} AS qualname, concat_ws('::', repository, file, 'fn', {QUALNAME}) AS identity, sha1(concat_ws('|', repository, file, {QUALNAME}, {HASH.format('code')})) AS cache_key FROM chunks",
    "tokenize_ascii": f"WITH {CORPUS} SELECT chunk_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM corpus",
    "tokenize_stems": f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "whitespace_collapse": r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents",
    "line_windows": "SELECT doc_id, part::INTEGER AS part, (part * 5 + 1)::INTEGER AS start_line, least(part * 5 + 5, len(l))::INTEGER AS end_line, md5(array_to_string(list_slice(l, part * 5 + 1, part * 5 + 5), chr(10))) AS digest FROM (SELECT doc_id, l, unnest(range((len(l) - 1) // 5 + 1)) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))",
    "file_stem": r"SELECT page_id, lower(regexp_replace(list_last(string_split(url, '/')), '\.[^.]*$', '')) AS stem, array_to_string((string_split(url, '/'))[-3:], '/') AS short FROM pages",
    "raw_text": "SELECT doc_id AS chunk_id, md5(substr(coalesce(text, ''), 1, 2000)) AS digest FROM documents",
    "metadata_text": f"WITH {CHUNKS} SELECT chunk_id, concat_ws(chr(10), 'function ' || {_name_words('function')}, 'class ' || {_name_words('class_name')}, 'file ' || {_name_words('file')}, 'Reads a document.', 'calls ' || {_name_words(chr(39) + chr(39) + ' || array_to_string(calls, chr(32))')}, 'imports ' || {_name_words('array_to_string(imports, chr(32))')}) AS text FROM chunks",
    "contextual_text": f"WITH {CHUNKS} SELECT chunk_id, concat_ws(chr(10), 'File: ' || file, 'Class: ' || class_name, 'Function: ' || function, 'Purpose: ' || {_name_words('function')}, 'Signature: def read_doc(self)', 'Doc: Reads a document.', 'Imports: ' || array_to_string(imports, ', '), CASE WHEN len(calls) > 0 THEN 'Calls: ' || array_to_string(calls, ', ') END) || chr(10) || 'Code:' || chr(10) || substr(code, 1, 2000) AS text FROM chunks",
    "lexical_text": f"WITH {CHUNKS}, n AS (SELECT *, function || ' ' || class_name || ' ' AS names FROM chunks) SELECT chunk_id, md5(concat_ws(' ', names, names, names, file, file, 'Reads a document.', 'def read_doc(self)', substr(code, 1, 2000))) AS digest FROM n",
    "first_sentence": r"SELECT conv_id, turn, CASE WHEN cut <> '' THEN cut ELSE p END AS sentence FROM (SELECT *, regexp_extract(p, '^(.*?[a-z0-9)]\.)(?:\s|$)', 1) AS cut FROM (SELECT conv_id, turn, trim(regexp_replace(string_split(regexp_replace(text, '^\s+', ''), chr(10) || chr(10))[1], '\s+', ' ', 'g')) AS p FROM conversations))",
    "highlighted": r"SELECT conv_id, turn, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(that|tion)', '<mark>\1</mark>', 'g')) AS digest FROM conversations WHERE text IS NOT NULL",
    "refactored_units": f"WITH {CHUNKS}, made AS (SELECT chunk_id, CASE WHEN chunk_id % 10 < 3 THEN 'refactored_' ELSE '' END || function AS function, language, chunk_id % 10 < 3 AS done FROM chunks), coded AS (SELECT chunk_id, function, 'def ' || function || '(x):' || chr(10) || '  ' || language || chr(10) || 'def read_doc' || (chunk_id % 50) || '(y): pass' || CASE WHEN done THEN chr(10) || '# refactored' ELSE '' END AS code, 'def ' || function || '(read_doc' || (chunk_id % 50) || ')' AS signature FROM made) SELECT *, {HASH.format('code')} AS chash FROM coded",
    "term_freq": f"WITH {POSTINGS} SELECT chunk_id, term, tf FROM tf",
    "doc_freq": f"WITH {POSTINGS} SELECT term, df FROM df",
    "doc_stats": f"WITH {POSTINGS} SELECT n, round(avgdl, 6) AS avgdl FROM whole",
    "bm25_postings": f"WITH {POSTINGS} SELECT chunk_id, term, tf, dl, df, round(impact, 6) AS impact FROM postings",
    "bm25_topk": f"WITH {SCORED}, {_best('scored', 10, 'best')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM best",
    "query_term_weights": f"WITH {EXPANDED}, own AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest(list_concat(tokens, identifiers)) AS term FROM understood) GROUP BY ALL) SELECT * FROM own UNION ALL SELECT query_id, term, 0.35 FROM (SELECT query_id, unnest(expansion) AS term FROM expanded) e WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = e.query_id AND o.term = e.term)",
    "identifier_index": f"WITH {CHUNKS} SELECT chunk_id, function AS name, 'defined' AS role FROM chunks UNION ALL SELECT chunk_id, lower(class_name), 'defined' FROM chunks UNION ALL SELECT chunk_id, unnest(calls), 'called' FROM chunks UNION ALL SELECT chunk_id, 'fileno' || chunk_id, 'stem' FROM chunks",
    "identifier_lookup": f"WITH {CHUNKS}, found AS (SELECT 1 AS query_id, chunk_id, 1.0 AS score FROM chunks WHERE function = 'read_doc7' UNION ALL SELECT 1, chunk_id, 0.5 FROM chunks WHERE list_contains(calls, 'the') OR list_contains(calls, 'read_doc7') UNION ALL SELECT 1, chunk_id, 0.8 FROM chunks WHERE chunk_id = 3 UNION ALL SELECT 2, chunk_id, 1.0 FROM chunks WHERE language = 'en' UNION ALL SELECT 2, chunk_id, 0.5 FROM chunks WHERE list_contains(calls, 'httpserveren') UNION ALL SELECT 3, chunk_id, 0.8 FROM chunks WHERE chunk_id = 5 UNION ALL SELECT 3, chunk_id, 0.5 FROM chunks WHERE list_contains(calls, 'nothing')) SELECT query_id::BIGINT AS query_id, chunk_id, max(score)::DOUBLE AS score FROM found GROUP BY ALL",
    "query_identifiers": f"WITH {UNDERSTOOD} SELECT query_id, array_to_string(identifiers, ',') AS identifiers, array_to_string(function_names, ',') AS function_names, array_to_string(class_names, ',') AS class_names FROM understood",
    "query_files": f"WITH {UNDERSTOOD} SELECT query_id, text, array_to_string(file_names, ',') AS file_names FROM understood",
    "query_tokens": f"WITH {UNDERSTOOD} SELECT query_id, array_to_string(tokens, ',') AS tokens FROM understood",
    "query_categories": f"WITH {UNDERSTOOD} SELECT query_id, {CATEGORY} AS category FROM understood",
    "category_weights": f"WITH {UNDERSTOOD}, w AS (SELECT query_id, {_weights} AS w FROM (SELECT query_id, {CATEGORY} AS category FROM understood)) SELECT query_id, round(w[1] / list_sum(w), 6) AS dense_weight, round(w[2] / list_sum(w), 6) AS bm25_weight, round(w[3] / list_sum(w), 6) AS identifier_weight FROM w",
    "query_libraries": f"WITH {UNDERSTOOD} SELECT query_id, array_to_string(libraries, ',') AS libraries, array_to_string(list_filter({_ordered_unique('words')}, lambda x: length(x) > 2 AND NOT list_contains({_list(T.STOPWORDS)}, x)), ',') AS keywords, language FROM understood",
    "concept_expansion": f"WITH {EXPANDED} SELECT u.query_id, coalesce(array_to_string(expansion, ','), '') AS expansion, u.text || CASE WHEN expansion IS NULL THEN '' ELSE '  related: ' || array_to_string(expansion, ' ') END AS dense_text FROM understood u LEFT JOIN expanded USING (query_id)",
    "last_turn_query": "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id",
    "error_text_flag": f"WITH {UNDERSTOOD} SELECT query_id, has_error_text FROM understood",
    "cosine_topk": f"WITH s AS ({COSINE}), {_best('s', 10, 'best')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM best",
    "cosine_topk_sql": f"WITH s AS ({COSINE}), {_best('s', 5, 'best')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM best",
    "cosine_threshold_search": "SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) >= 0.4",
    "minmax_scores": f"WITH {SCORED}, {_best('scored', 10, 'best')} SELECT query_id, chunk_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 6) AS normal FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM best WINDOW w AS (PARTITION BY query_id))",
    "candidates_full": f"WITH {CHANNELS} SELECT query_id, chunk_id, round(dense_n, 6) AS dense_n, round(bm25_n, 6) AS bm25_n, round(identifier_n, 6) AS identifier_n, method FROM gathered",
    "weighted_fusion": f"WITH {CHANNELS}, s AS {_fused.format(score='0.55 * dense_n + 0.30 * bm25_n + 0.15 * identifier_n')}, {_best('s', 10, 'best')} SELECT query_id, chunk_id, round(score, 5) AS score FROM best WHERE score > 0",
    "rrf_fusion": f"WITH {CHANNELS}, s AS {_fused.format(score='coalesce(0.55 / (60 + dense_rank), 0) + coalesce(0.30 / (60 + bm25_rank), 0) + coalesce(0.15 / (60 + identifier_rank), 0)')}, {_best('s', 10, 'best')} SELECT query_id, chunk_id, round(score, 6) AS score FROM best",
    "rerank_features": FEATURED,
    "structural_neighbours": f"WITH {CHUNKS} SELECT c.chunk_id, c.name, count(*) AS targets FROM (SELECT chunk_id, repository, unnest(calls) AS name FROM chunks) c JOIN chunks d ON d.repository = c.repository AND d.language = c.name GROUP BY ALL",
    "version_diff": f"WITH {FILES} SELECT coalesce(v1.path, v2.path) AS path, CASE WHEN v1.path IS NULL THEN 'added' WHEN v2.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM v1 FULL JOIN v2 ON v1.path = v2.path WHERE v1.blob IS DISTINCT FROM v2.blob",
    "reused_chunks": f"WITH {FILES} SELECT v1.path AS file, 'c2' AS commit, 'v2' AS version, 2.0::DOUBLE AS timestamp FROM v1 JOIN v2 ON v1.path = v2.path AND v1.blob = v2.blob",
    "cache_misses": f"WITH {FILES} SELECT path, blob FROM v2 WHERE blob NOT IN (SELECT blob FROM v1)",
    "incremental_union": f"WITH {FILES} SELECT path AS file, blob FROM v2",
    "latest_version": "SELECT repository, label, commit, timestamp FROM (SELECT o_custkey::VARCHAR AS repository, o_orderkey::VARCHAR AS label, o_orderstatus AS commit, round(o_totalprice, -4) AS timestamp, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -4) DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "cross_version_merge": f"WITH {VERSIONED} SELECT query_id, chunk_id, version, place AS rank FROM merged WHERE place <= 12",
    "dedup_identity": f"WITH {VERSIONED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, identity ORDER BY score DESC, chunk_id) AS n FROM versioned) SELECT query_id, identity, min(chunk_id) FILTER (n = 1) AS chunk_id, coalesce(string_agg(version || ':' || function, ',' ORDER BY n) FILTER (n > 1), '') AS also_in FROM o GROUP BY query_id, identity",
    "dedup_rename": RENAMED,
    "bm25_stored_topk": f"WITH {SCORED}, {_best('scored', 10, 'best')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM best",
    "listwise_lambdas": LAMBDAS,
    "duplicate_rate": f"WITH {VERSIONED} SELECT query_id, round((count(*) - count(DISTINCT identity)) / 10.0::DOUBLE, 6) AS duplicate_rate FROM merged WHERE place <= 10 GROUP BY query_id",
    "evaluation_per_query": f"WITH {JUDGED} SELECT query_id, round(coalesce(ndcg, 0.0), 6) AS ndcg, round(coalesce(mrr, 0.0), 6)::DOUBLE AS mrr, round(coalesce(recall, 0.0), 6) AS recall FROM ({_measures(10)})",
    "evaluation_means": f"WITH {JUDGED}, ten AS ({_measures(10)}), hundred AS ({_measures(100)}) SELECT count(*) AS n_queries, round(avg(coalesce(ten.ndcg, 0)), 6) AS ndcg_at_10, round(avg(coalesce(ten.mrr, 0)), 6) AS mrr_at_10, round(avg(coalesce(ten.recall, 0)), 6) AS recall_at_10, round(avg(coalesce(hundred.recall, 0)), 6) AS recall_at_100 FROM ten JOIN hundred USING (query_id)",
    "contained_benchmark": f"WITH {CONTAINED} SELECT * FROM contained",
    "latency_percentiles": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "val_test_split": "SELECT item_id, ntile(2) OVER (ORDER BY ('0x' || substr(md5(item_id::VARCHAR), 1, 8))::BIGINT, item_id) AS half FROM benchmark",
    "weight_trials": f"WITH {CHANNELS}, {CONTAINED}, trials AS (SELECT i::INTEGER AS trial, i / 10.0::DOUBLE AS d, 1 - i / 10.0::DOUBLE AS b, 0.05 * i AS n FROM range(11) t(i)), s AS (SELECT trial, query_id, chunk_id, round(d * dense_n + b * bm25_n + n * identifier_n, 9) AS score FROM gathered CROSS JOIN trials), placed AS (SELECT *, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, chunk_id) AS place FROM s), firsts AS (SELECT trial, p.query_id, min(place) AS place FROM placed p JOIN contained c ON c.query_id = p.query_id AND c.doc_id = p.chunk_id GROUP BY ALL) SELECT trial, round(sum(1.0::DOUBLE / place), 6) AS reciprocal_ranks FROM firsts GROUP BY trial",
}

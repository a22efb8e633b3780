"""Text functions as Column expressions: tokens, hashes, names of code units and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of code that take part in retrieval texts.
CODE_CHARS = 2000
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"

# Prose words that say nothing about code.
STOPWORDS = [
    "a", "about", "an", "and", "any", "are", "as", "at", "be", "been", "being", "but", "by", "can", "code", "did", "do", "does", "each", "from",
    "had", "has", "have", "how", "i", "in", "into", "is", "it", "its", "me", "my", "of", "on", "or", "our", "please", "show", "so", "that", "the",
    "their", "them", "there", "these", "they", "this", "those", "to", "us", "was", "we", "were", "what", "where", "which", "who", "why", "will",
    "with", "would", "you", "your",
]


def string_array(values: list[str]) -> Column:
    """A literal of words without quotes or backslashes, as one expression."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")").cast("array<string>")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(code: Column) -> Column:
    """16 hex digits that don't depend on how much white space there is."""
    return F.substring(F.sha1(collapse_whitespace(code).cast("binary")), 1, 16)


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores that don't start with a digit."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))


def split_identifier(name: Column) -> Column:
    """The lower-cased words of a snake or camel case name."""
    humps = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.translate(humps, "_", " ")), " +"), lambda w: w != "")


def stem(word: Column) -> Column:
    """Cuts a verb or plural ending off, if three letters or more stay."""
    return F.regexp_replace(word, "^(.{3,}?)(?:izations?|iz(?:e[sdr]?|ing)|is(?:e[sdr]?|ing)|ations?|ings?|ed|es|s|e)$", "$1")


def tokens(text: Column) -> Column:
    """Stems of words; names of several words also whole.  Stop-words go."""
    stop = string_array(STOPWORDS)

    def of_name(name: Column) -> Column:
        parts = F.filter(split_identifier(name), lambda w: ~F.array_contains(stop, w))
        return F.when(F.size(split_identifier(name)) > 1, F.concat(F.array(F.lower(name)), F.transform(parts, stem))).otherwise(F.transform(parts, stem))

    return F.flatten(F.transform(identifiers(text), of_name))


def words_of_names(text: Column) -> Column:
    """The words of all identifiers, space-joined."""
    return F.array_join(F.flatten(F.transform(identifiers(text), split_identifier)), " ")


def file_stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))


def short_path(path: Column) -> Column:
    """The last three parts."""
    return F.substring_index(path, "/", -3)


def first_sentence(doc: Column) -> Column:
    """Of the first paragraph; a full stop, which it keeps, ends it after a lower-case letter, digit or bracket."""
    paragraph = collapse_whitespace(F.element_at(F.split(F.regexp_replace(doc, r"^\s+", ""), r"\n\n"), 1))
    cut = F.regexp_extract(paragraph, r"^(.*?[a-z0-9)]\.)(?:\s|$)", 1)
    return F.when(cut != "", cut).otherwise(paragraph)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _if(test: Column, value: Column) -> Column:
    """value, or null, which concat_ws leaves out."""
    return F.when(test, value)


def qualname() -> Column:
    """Class.function, either alone, or <module>; #part from the second part on."""
    function, class_name = _text("function"), _text("class_name")
    name = F.when((function != "") & (class_name != ""), F.concat_ws(".", class_name, function)).when(function != "", function).when(class_name != "", class_name).otherwise("<module>")
    return F.when(F.col("part") > 0, F.concat(name, F.lit("#"), F.col("part").cast("string"))).otherwise(name)


def identity() -> Column:
    """The same for the same unit in all versions."""
    sort = F.when(F.col("kind").isin("class", "module"), F.col("kind")).otherwise("fn")
    return F.concat_ws("::", "repository", "file", sort, qualname())


def cache_key() -> Column:
    """The same for a unit as long as its code is."""
    return F.sha1(F.concat_ws("|", "repository", "file", qualname(), "chash").cast("binary"))


def raw_text() -> Column:
    return F.substring(_text("code"), 1, CODE_CHARS)


def metadata_text() -> Column:
    """Words of names, calls and imports, and the documentation, a line each."""
    part = lambda label, value, test=None: _if((_text(value) if test is None else test) != "", F.concat(F.lit(label + " "), words_of_names(_text(value))))
    few = lambda column, n: words_of_names(F.array_join(F.slice(F.coalesce(column, F.array().cast("array<string>")), 1, n), " "))
    doc = F.substring(_text("doc"), 1, 300)
    return F.concat_ws(
        "\n",
        part("function", "function"),
        part("class", "class_name"),
        F.concat(F.lit("file "), words_of_names(_text("file"))),
        _if(F.trim(doc) != "", doc),
        F.concat(F.lit("calls "), few(F.col("calls"), 15)),
        F.concat(F.lit("imports "), few(F.col("imports"), 10)),
    )


def contextual_text() -> Column:
    """Labelled lines about a unit, then its code."""
    line = lambda label, value, test: _if(test, F.concat(F.lit(f"{label}: "), value))
    function, class_name, signature, doc = (_text(c) for c in ("function", "class_name", "signature", "doc"))
    listed = lambda column, n: F.array_join(F.slice(F.col(column), 1, n), ", ")
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), _text("file")),
        line("Class", class_name, class_name != ""),
        line("Function", function, function != ""),
        line("Purpose", words_of_names(function), function != ""),
        line("Signature", signature, signature != ""),
        line("Doc", F.substring(doc, 1, 300), doc != ""),
        line("Imports", listed("imports", 10), F.size("imports") > 0),
        line("Calls", listed("calls", 15), F.size("calls") > 0),
    )
    return F.concat(head, F.lit("\nCode:\n"), raw_text())


REPRESENTATIONS = {"raw": raw_text, "metadata": metadata_text, "contextual": contextual_text}


def representation(mode: str) -> Column:
    if mode not in REPRESENTATIONS:
        raise ValueError(f"no representation {mode!r}; there are {', '.join(REPRESENTATIONS)}")
    return REPRESENTATIONS[mode]()


def lexical_text(mode: str = "contextual") -> Column:
    """What is matched by words: names thrice and the file twice, for their weight."""
    if mode == "raw":
        return raw_text()
    names = F.concat_ws(" ", _text("function"), _text("class_name"), _text("parent"))
    return F.concat_ws(" ", names, names, names, _text("file"), _text("file"), _text("doc"), _text("signature"), raw_text())


def highlighted(code: Column, terms: Column) -> Column:
    """HTML with marks around terms of over three characters, whatever their case."""
    safe = F.replace(F.replace(F.replace(code, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    long = F.filter(F.array_distinct(terms), lambda t: (F.length(t) > 3) & t.rlike("^[A-Za-z0-9_]+$"))
    pattern = F.concat(F.lit("(?i)("), F.array_join(long, "|"), F.lit(")"))
    return F.when(F.size(long) > 0, F.regexp_replace(safe, pattern, F.lit("<mark>$1</mark>"))).otherwise(safe)

"""Scalar text functions as Spark columns: tokenizers, normalisers, identifiers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bm25_tokens(text: Column) -> Column:
    """Lower-case tokens between runs of underscores, dots and white space; punctuation stays, camel case is not split."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[_.\s]+"), lambda t: t != "")


def code_tokens(text: Column) -> Column:
    """Distinct tokens of a code query: whole words, path parts, snake and camel parts; longer than one character.

    Unicode classes, as words may hold letters beyond ASCII.
    """
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s./\-]", " ")
    words = F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")
    parts = F.transform(words, lambda w: F.concat(
        F.array(F.lower(w)),
        F.when(w.rlike(r"[/\\.]"), F.transform(F.split(w, r"[/.\\\-_]+"), F.lower)).otherwise(F.array().cast("array<string>")),
        F.when(w.contains("_"), F.transform(F.split(w, "_"), F.lower)).otherwise(F.array().cast("array<string>")),
        F.transform(F.regexp_extract_all(w, F.lit(r"(?U)([A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b))"), 1), F.lower),
    ))
    return F.array_distinct(F.filter(F.flatten(parts), lambda t: F.length(t) > 1))


def plain_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits longer than one character (no camel split)."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9äöüßéèêçñáíóúà]+"), lambda t: F.length(t) > 1))


def token_overlap(query: Column, doc: Column) -> Column:
    """Share of the query tokens that the document has; 0 if either is empty."""
    return F.coalesce(F.size(F.array_intersect(query, doc)) / F.nullif(F.size(query), F.lit(0)), F.lit(0.0))  # each side is named once in what is computed for every row


def normalize_path(path: Column) -> Column:
    """Forward slashes, lower case, no leading ./ ."""
    return F.regexp_replace(F.lower(F.translate(path, "\\", "/")), r"^(\./)+", "")


def normalize_symbol(name: Column) -> Column:
    """Lower case, last dotted part."""
    return F.substring_index(F.lower(name), ".", -1)


def path_to_module(path: Column, root: Column | None = None) -> Column:
    """Dotted module name of a path: relative to root, every '.py' removed, a trailing '.__init__' stripped."""
    p = F.translate(path, "\\", "/")
    if root is not None:
        r = F.concat(F.regexp_replace(F.translate(root, "\\", "/"), r"/+$", ""), F.lit("/"))
        p = F.when(p.startswith(r), F.substr(p, F.length(r) + 1)).otherwise(p)
    dotted = F.replace(F.translate(p, "/", "."), F.lit(".py"), F.lit(""))
    return F.regexp_replace(dotted, r"\.__init__$", "")


def basename(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def content_hash(content: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def evidence_id(source: Column, *parts: Column) -> Column:
    return F.concat(source, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 16))


def safe_id(name: Column) -> Column:
    """Identifier for diagrams: everything outside [a-zA-Z0-9_] becomes an underscore."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_")


def safe_int(text: Column, default: int) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def safe_symbol_type(kind: Column) -> Column:
    from loreline.schemas import SYMBOL_TYPES

    return F.when(F.lower(kind).isin(*SYMBOL_TYPES), F.lower(kind)).otherwise(F.lit("function"))


def symbol_text(name: Column, qualified_name: Column, docstring: Column, signature: Column) -> Column:
    """The text a symbol is searched by."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws(" ", blank(name), blank(qualified_name), blank(docstring), blank(signature))


def embedding_text(name: Column, qualified_name: Column, docstring: Column) -> Column:
    return F.trim(F.concat_ws(" ", name, qualified_name, F.coalesce(docstring, F.lit(""))))


def symbol_chunk(kind: Column, qualified_name: Column, path: Column, start: Column, end: Column, signature: Column, docstring: Column) -> Column:
    """Readable block of text for one symbol."""
    return F.concat_ws("\n", F.format_string("%s %s", kind, qualified_name), F.format_string("%s:%d-%d", path, start, end), signature, docstring)


def short_docstring(docstring: Column, width: int = 80) -> Column:
    return F.substring(F.split(docstring, "\n")[0], 1, width)


def same_top_package(a: Column, b: Column) -> Column:
    return F.substring_index(a, ".", 1) == F.substring_index(b, ".", 1)


def suggestions(words, command: Column, candidates: list[str]):
    """The nearest command to each mistyped one (rows of ``words``): needs a leading slash, distance 2 at most up to 6 characters, else 3.

    The first of the nearest candidates wins. Returns words with ``suggestion`` (null if none is near enough).
    """
    near = [F.struct(F.levenshtein(command, F.lit(c)).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(candidates)]
    best = F.array_min(F.array(*near))
    limit = F.when(F.length(command) <= 6, 2).otherwise(3)
    return words.withColumn("suggestion", F.when(command.startswith("/") & (best["d"] <= limit), best["c"]))

"""Text columns: names, evidence, terms, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no index terms.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with")
#: Weights of title and body terms.
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4


def doc_id(source_system: Column, external_id: Column) -> Column:
    return F.concat_ws(":", source_system, external_id)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalize_name(text: Column) -> Column:
    """Lower case, outer blanks off, inner blanks single."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quote_supported(quote: Column, source: Column) -> Column:
    """At least eight characters that the source contains, both normalised."""
    q = normalize_name(quote)
    return (F.length(q) >= 8) & F.contains(normalize_name(source), q)


def tokens(text: Column) -> Column:
    """Maximal runs of letters or digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def terms(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def paragraphs(text: Column) -> Column:
    """Parts between two line feeds in a row, trimmed, empty ones left out; a line of blanks is no break."""
    parts = F.transform(F.split(text, r"\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def escape_like(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def claim_text(predicate: Column, object_text: Column) -> Column:
    return F.concat_ws(": ", predicate, object_text)


def relationship_text(from_type: Column, from_id: Column, kind: Column, to_type: Column, to_id: Column) -> Column:
    return F.concat(from_type, F.lit(":"), from_id, F.lit(" "), kind, F.lit(" "), to_type, F.lit(":"), to_id)

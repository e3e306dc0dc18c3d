"""Exact token search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import Cursors, read_page
from tidemark.plans.context import QueryError

#: White space between tokens: tab, line feed, form feed, carriage return, space; a vertical tab is part of a token.
SPACE = r"[\t\n\f\r ]+"


def token(term: str) -> str:
    if not term or re.search(SPACE, term):
        raise QueryError("a term is not empty and has no white space")
    return term


def tokens(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SPACE)


def search(docs: DataFrame, terms: list[str], fields: tuple[str, ...] = ("text",), every: bool = True) -> DataFrame:
    """(result_key, matched_fields) of documents with all terms, or any, over the chosen fields together.  Case counts."""
    wanted = sorted({token(t) for t in terms})
    if not wanted or not fields:
        raise QueryError("a search has terms and fields")
    need = F.array(*map(F.lit, wanted))
    own = {f: F.array_intersect(tokens(F.col(f)), need) for f in fields}
    together = F.array_distinct(F.concat(*own.values()))
    matched = F.array_compact(F.array(*(F.when(F.size(x) > 0, F.lit(f)) for f, x in own.items())))
    hit = F.size(together) == len(wanted) if every else F.size(together) > 0
    return docs.filter(hit).select("result_key", F.array_join(matched, ",").alias("matched_fields"))


#: Fields that a family of records can be searched by.
FIELDS = {
    "assertion": ("text", "subject", "predicate", "value", "polarity", "validity", "perspective", "epistemic_mode"),
    "event": ("text", "kind", "participant", "attribute", "time"),
    "source": ("text", "kind", "locator", "content_digest", "metadata"),
}


def applicable(family: str, fields: tuple[str, ...]) -> bool:
    """Whether all fields are fields of the family; other documents are no candidates."""
    return all(f in FIELDS.get(family, ()) for f in fields)


def search_records(docs: DataFrame, terms: list[str], rights, family: str = "assertion", fields: tuple[str, ...] = ("text",), every: bool = True) -> DataFrame:
    """``search`` over the documents that a caller may read, in the searched fields; the right to search is demanded."""
    rights.demand("query_search")
    if not applicable(family, fields):
        return docs.filter(F.lit(False)).select("result_key", F.lit("").alias("matched_fields"))
    return search(docs.filter(rights.documents(family, "result_key", fields)), terms, fields, every)


class SearchSession:
    """A search read page by page, each with the rights that the caller has then."""

    def __init__(self, docs: DataFrame, terms: list[str], rights_now, cursors: Cursors, size: int = 100, **options):
        if not 1 <= size <= 500:
            raise QueryError("a page of a search has 1 to 500 rows")
        self.docs, self.terms, self.rights_now, self.cursors, self.size, self.options = docs, terms, rights_now, cursors, size, options

    def page(self, cursor: str | None = None) -> tuple[list, str | None]:
        """Hits of the next page, and the cursor of the one after it."""
        rights = self.rights_now()
        binding = {"principal": rights.principal, "terms": sorted(set(self.terms)), "size": self.size}
        return read_page(search_records(self.docs, self.terms, rights, **self.options), "result_key", self.size, self.cursors, binding, cursor)


def full_text(docs: DataFrame, expression) -> DataFrame:
    """Documents for which a nested ("all" | "any", ...), ("not", x) or term holds."""
    return docs.filter(_matches(expression, tokens(F.col("text")))).select("result_key")


def _matches(expression, own: Column) -> Column:
    if isinstance(expression, str):
        return F.array_contains(own, token(expression))
    kind, *parts = expression
    columns = [_matches(p, own) for p in parts]
    if kind == "not" and len(columns) == 1:
        return ~columns[0]
    if kind not in ("all", "any") or not columns:
        raise QueryError("a search expression is a term, all, any, or not of one")
    out = columns[0]
    for c in columns[1:]:
        out = out & c if kind == "all" else out | c
    return out

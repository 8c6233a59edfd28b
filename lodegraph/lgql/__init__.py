"""The path-pattern language: parser, predicates, chains as joins, standing queries."""

from lodegraph.lgql.compiler import match, query
from lodegraph.lgql.parser import ParseError, Pattern, parse
from lodegraph.lgql.standing import standing

__all__ = ["ParseError", "Pattern", "match", "parse", "query", "standing"]

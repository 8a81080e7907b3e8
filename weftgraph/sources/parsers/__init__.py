"""Parsers: the text of a source file to rows of nodes and edges, by the file's extension."""

from .base import OUT_SCHEMA, Rows, parse_source, parser_for, register, supported_extensions, supported_languages

__all__ = ["OUT_SCHEMA", "Rows", "parse_source", "parser_for", "register", "supported_extensions", "supported_languages"]

"""Scalar expressions over chunk columns; all of them stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Id prefixes and language families
ID_PREFIX = {"python": "py", "cpp": "cpp", "verilog": "verilog", "systemverilog": "verilog", "markdown": "doc", "docx": "doc"}
FAMILY = {"c": "c_family", "cpp": "c_family", "systemc": "systemc_tlm", "python": "python", "verilog": "hdl", "systemverilog": "hdl"}
TYPE_BASE = {"class_template": "class", "function_template": "function", "struct_template": "struct"}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(x: Column | str) -> Column:
    """Without white space at both ends (trim() alone takes spaces only)."""
    return F.regexp_replace(_col(x), r"^\s+|\s+$", "")


def lookup(x: Column | str, table: dict[str, str], default: Column) -> Column:
    """A constant table as a CASE expression."""
    out = None
    for k, v in table.items():
        out = (F if out is None else out).when(_col(x) == k, F.lit(v))
    return out.otherwise(default)


def language_family(language: Column | str) -> Column:
    return lookup(language, FAMILY, _col(language))


def base_type(kind: Column | str) -> Column:
    """``*_template`` types without the suffix."""
    return lookup(kind, TYPE_BASE, _col(kind))


def project_id(path: Column | str) -> Column:
    return F.substring(F.sha2(_col(path).cast("binary"), 256), 1, 12)


def chunk_id(path: Column | str, language: Column | str, kind: Column | str, name: Column | str, index: Column | str | None = None) -> Column:
    """prefix:hash8(path):type:name:index; colons and slashes of the name become underscores."""
    number = F.lit("0") if index is None else _col(index).cast("string")
    return F.concat_ws(":", lookup(language, ID_PREFIX, F.substring(_col(language), 1, 3)), F.substring(F.sha2(_col(path).cast("binary"), 256), 1, 8), _col(kind), F.translate(_col(name), ":/", "__"), number)


def declaration(text: Column | str, language: Column | str, kind: Column | str, name: Column | str) -> Column:
    """For C and C++ the text before the first brace on one line, closed by a semicolon; ``type name`` otherwise."""
    plain = F.concat_ws(" ", _col(kind), _col(name))
    lines = F.transform(F.split(F.substring_index(trim_space(text), "{", 1), r"\r\n|[\n\r]"), trim_space)
    head = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    closed = F.when(head == "", F.concat(plain, F.lit(";"))).when(head.endswith(";"), head).otherwise(F.concat(head, F.lit(";")))
    return F.when(_col(language).isin("c", "cpp"), closed).otherwise(plain)


#: The sentences of the next three functions
def behavior_summary(name: Column | str, kind: Column | str, language: Column | str, start: Column | str, end: Column | str) -> Column:
    """The sentence used without a language model."""
    return F.format_string("%s is a %s in %s defined at lines %d-%d.", _col(name), _col(kind), _col(language), _col(start), _col(end))


def behavior_fallback(name: Column | str, kind: Column | str, language: Column | str, start: Column | str, end: Column | str) -> Column:
    """The sentence used when a language model fails."""
    return F.format_string("%s performs %s logic in %s and is defined at lines %d-%d.", _col(name), _col(kind), _col(language), _col(start), _col(end))


def privacy_summary(path: Column | str) -> Column:
    return F.format_string("[PRIVACY-SAFE SUMMARY] This is a high-confidential component in %s. The raw implementation is withheld per privacy policy.", _col(path))


def sanitized_document(project: Column | str, root: Column | str, path: Column | str, language: Column | str, kind: Column | str, name: Column | str, start: Column | str, end: Column | str, decl: Column | str, summary: Column | str) -> Column:
    """The nine-line text that stands for a chunk's code."""
    s = lambda label, x: F.concat(F.lit(f"{label}: "), _col(x).cast("string"))
    lines = F.concat(F.lit("line_range: "), _col(start).cast("string"), F.lit("-"), _col(end).cast("string"))
    return F.concat_ws("\n", s("project", project), s("project_root", root), s("file", path), s("language", language), s("symbol_type", kind), s("symbol_name", name), lines, s("declaration", decl), s("summary", summary))


def token_estimate(text: Column | str) -> Column:
    """Characters divided by four, rounded down."""
    return F.floor(F.length(_col(text)) / 4).cast("long")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """Lower-cased last suffix with its dot, empty for names without one or that only start with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))

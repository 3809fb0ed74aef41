"""Message normalisation and finding signatures as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Line ends as str.splitlines sees them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; a column that stands in several places of an expression may be computed at each."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def normalize_message(message: Column) -> Column:
    """Lower case, digits and punctuation gone, white space single, a leading "syntaxerror " dropped.

    Digits become a mark that is punctuation itself, so they just vanish.
    """
    m = F.regexp_replace(F.lower(F.coalesce(message, F.lit(""))), r"(?U)\d+", "")
    m = F.trim(F.regexp_replace(F.regexp_replace(m, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))
    return F.when(m.startswith("syntaxerror "), F.substr(m, F.lit(len("syntaxerror ") + 1))).otherwise(m)


def signature(file: Column, code: Column, message: Column) -> Column:
    file, code, m = F.coalesce(file, F.lit("")), F.coalesce(code, F.lit("")), normalize_message(message)
    return F.when(code != "", F.concat_ws("::", file, code, F.substring(m, 1, 80))).otherwise(F.concat_ws("::", file, F.substring(m, 1, 100)))


def process_key(file: Column, code: Column, message: Column, line: Column) -> Column:
    return F.concat(signature(file, code, message), F.lit("::L"), F.coalesce(line, F.lit(0)).cast("string"))


def whole_numbers_hidden(message: Column) -> Column:
    """The other normalisation: whole-word numbers become #, white space single, case and punctuation stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(message, F.lit("")), r"(?U)\b\d+\b", "#"), r"(?U)\s+", " "))


def identity(file: Column, code: Column, message: Column, error_type: Column | None = None, line: Column | None = None, version: str = "1", profile: str = "default") -> Column:
    """SHA-256 of a finding's stable parts; with line, of the instance.  The type is part of it if there is one."""
    parts = [F.lit(version), F.lit(profile), F.lit("logical" if line is None else "instance"), F.element_at(F.split(F.translate(file, "\\", "/"), "/"), -1)]
    parts.append(F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit("PRIMARY:"), code)))
    parts.append(F.concat(F.lit("SECONDARY:"), whole_numbers_hidden(message)))
    if error_type is not None:
        parts.append(F.when(F.coalesce(error_type, F.lit("")) != "", F.concat(F.lit("type="), error_type)))
    if line is not None:
        parts.append(F.concat(F.lit("line="), F.coalesce(line.cast("string"), F.lit("none"))))
    return F.sha2(F.concat_ws("::", *parts), 256)


def cascade_signature(file: Column, line: Column, code: Column, message: Column) -> Column:
    return F.concat_ws("::", F.coalesce(file, F.lit("")), F.coalesce(line, F.lit(0)).cast("string"), F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(F.substring(F.coalesce(message, F.lit("")), 1, 60)))


def symbols(message: Column, most: int = 5) -> Column:
    """Distinct names in a message, back-ticked ones first, then quoted ones."""
    name = "[A-Za-z_][A-Za-z0-9_:.<>-]*"
    m = F.coalesce(message, F.lit(""))
    return F.slice(F.array_distinct(F.concat(F.regexp_extract_all(m, F.lit(f"`({name})`"), 1), F.regexp_extract_all(m, F.lit(f"'({name})'"), 1))), 1, most)


def slashes(path: Column) -> Column:
    """Forward slashes, none at the front."""
    return F.ltrim(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), F.lit("/"))

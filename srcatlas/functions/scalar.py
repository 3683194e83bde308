"""Column functions: fingerprints, references, containment and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a strip removes (ASCII and the Unicode blanks).
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 with replacement and line ends made \\n."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def fingerprint(value: Column) -> Column:
    """First 12 hex digits of SHA-256 of a string's UTF-8 or of bytes."""
    return F.substring(F.sha2(value, 256), 1, 12)


def finding_id(file: Column, section: Column, finding: Column) -> Column:
    joined = F.concat_ws("::", file, F.coalesce(section, F.lit("")), finding)
    blank = F.coalesce(file, F.lit("")).eqNullSafe("") | F.coalesce(finding, F.lit("")).eqNullSafe("")
    return F.when(blank, F.lit("")).otherwise(fingerprint(joined))


def render_ref(file: Column, start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull(), file)
        .when(end.isNull() | (start == end), F.concat(file, F.lit(":"), start.cast("string")))
        .otherwise(F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
    )


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" "))


def claim_in_body(claim: Column, body: Column) -> Column:
    return (collapse(claim) != "") & F.contains(collapse(body), collapse(claim))


def absolute_line(line: Column, offset: Column) -> Column:
    return line + offset


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last .x of the name, lower-cased; a leading dot is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


#: Fixed markers of bodies that stand for a section without content: by use, those that count as
#: written and those that count in any case.
PLACEHOLDERS = {
    "derive": ((), ("not yet populated", "no findings were extracted", "upstream sections required to derive")),
    "report": (("Not yet populated", "No findings were extracted"), ("upstream sections required to derive",)),
    "upstream": (("Not yet populated", "No findings were extracted"), ()),
    "chat": (("_Not yet populated. Run `",), ()),
}


def is_placeholder(body: Column, mode: str = "derive") -> Column:
    """Whether a body has a marker of the given use; a null body has none."""
    written, any_case = PLACEHOLDERS[mode]
    text = F.coalesce(body, F.lit(""))
    found = F.lit(False)
    for m in written:
        found = found | text.contains(m)
    for m in any_case:
        found = found | F.lower(text).contains(m)
    return found

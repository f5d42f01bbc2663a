"""String functions of the text layer, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a paragraph: NUL, vertical tab, group and unit separators.
BREAKS = "[\\x00\\x0b\\x1d\\x1f]"
BLANK = "(?U)^\\s+|\\s+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blank(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(c), BLANK, "")


def paragraph_lines(text: Column | str) -> Column:
    """array<array<string>>: trimmed non-empty lines of each paragraph that has any."""
    lines = F.transform(F.split(_col(text), BREAKS, -1), lambda p: F.filter(F.transform(F.split(p, "\n", -1), trim_blank), lambda x: x != ""))
    return F.filter(lines, lambda p: F.size(p) > 0)


def join_lines(lines: Column) -> Column:
    """One string of a paragraph's lines: a hyphen before a lower-case letter goes, other breaks are spaces."""
    return F.replace(F.regexp_replace(F.array_join(lines, "\n"), "-\n([a-z])", "$1"), F.lit("\n"), F.lit(" "))


def reflow(text: Column | str) -> Column:
    """array<struct<lines, text>> of the paragraphs of a page's text."""
    return F.transform(paragraph_lines(text), lambda p: F.struct(p.alias("lines"), join_lines(p).alias("text")))


def _replace_all(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    c = _col(c)
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_html(c: Column | str) -> Column:
    return _replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def escape_xml(c: Column | str) -> Column:
    return _replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def escape_pdf(c: Column | str) -> Column:
    """For a literal string: brackets and backslashes escaped, characters beyond ASCII as ``?``."""
    return F.regexp_replace(_replace_all(c, [("\\", "\\\\"), ("(", "\\("), (")", "\\)")]), "[^\\x00-\\x7F]", "?")


def inner_text(c: Column | str) -> Column:
    """Text of a piece of markup: tags removed, entities of the escapers undone, ends trimmed."""
    plain = F.regexp_replace(_col(c), "<[^>]*>", "")
    return trim_blank(_replace_all(plain, [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]))


def blank_to(c: Column | str, instead: str) -> Column:
    """The untrimmed text, or ``instead`` if there is none but white space."""
    c = _col(c)
    return F.when(c.isNull() | (trim_blank(c) == ""), F.lit(instead)).otherwise(c)


def byte_slice(c: Column | str, start: Column, length: Column) -> Column:
    """Characters that lie in ``length`` bytes of the UTF-8 form from ``start``; cut characters at the ends count as whole.

    A byte of the form 10xxxxxx continues a character: the start moves back and the end forward past these."""
    body = F.encode(_col(c), "UTF-8")
    size = F.octet_length(body)
    first, last = F.least(start, size), F.least(start + length, size)

    def cont(at: Column) -> Column:
        return (F.conv(F.hex(F.substring(body, at + 1, 1)), 16, 10).cast("int").bitwiseAND(192) == 128) & (at < size)

    back = F.when(cont(first), F.when(cont(first - 1), F.when(cont(first - 2), first - 3).otherwise(first - 2)).otherwise(first - 1)).otherwise(first)
    ahead = F.when(cont(last), F.when(cont(last + 1), F.when(cont(last + 2), last + 3).otherwise(last + 2)).otherwise(last + 1)).otherwise(last)
    return F.decode(F.substring(body, back + 1, ahead - back), "UTF-8")


#: Widths of characters in thousandths of an em, by class; the first class that holds a character counts.
#: A class is given as ranges of code points.
WIDTHS = [
    ([(0x00, 0x1F), (0x7F, 0x7F)], 0),
    ([(ord(c), ord(c)) for c in " ,.:;!?"], 278),
    ([(ord(c), ord(c)) for c in "'\""], 222),
    ([(ord(c), ord(c)) for c in "()[]{}-–—"], 333),
    ([(0x41, 0x5A)], 667),
    (
        [
            (0x1100, 0x11FF), (0x2E80, 0x2FDF), (0x3000, 0x4DBF), (0x4E00, 0xA4CF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF),
            (0xFE10, 0xFE1F), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x1B000, 0x1B0FF), (0x20000, 0x2A6DF),
            (0x2A700, 0x2EBEF), (0x30000, 0x3134F),
        ],
        1000,
    ),
]
OTHER_WIDTH = 556


def char_width(c: str) -> int:
    """Width of one character in thousandths of an em (for kernels outside the JVM)."""
    o = ord(c)
    return next((w for ranges, w in WIDTHS if any(a <= o <= b for a, b in ranges)), OTHER_WIDTH)


def text_width(c: Column | str) -> Column:
    """Sum of the widths of a text's characters: one count a class, no work a character."""
    total = F.length(_col(c)) * OTHER_WIDTH
    for ranges, w in WIDTHS:
        inside = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
        total = total + F.regexp_count(_col(c), F.lit(f"[{inside}]")) * (w - OTHER_WIDTH)
    return total

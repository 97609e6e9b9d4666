"""Text clean-up and tokenising as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as Python's str methods see it: Unicode spaces and the four
# ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`, usable inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def words(text: Column) -> Column:
    """Whitespace-separated words, no empty strings."""
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return words(F.lower(text))


def clean_cell(text: Column) -> Column:
    """Collapse whitespace, trim, drop zero-width spaces."""
    flat = F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))
    return F.replace(flat, F.lit("\u200b"), F.lit(""))


def fix_table_line(line: Column) -> Column:
    padded = F.regexp_replace(line, rf"(?U){SPACE}*\|{SPACE}*", " | ")
    return F.when(strip(line).startswith("|"), strip(padded)).otherwise(line)


def clean_markdown(markdown: Column) -> Column:
    """Tidy converted Markdown. Blank lines are collapsed before line ends are
    trimmed, so lines holding only spaces may leave longer gaps."""
    collapsed = F.regexp_replace(markdown, r"\n{3,}", "\n\n")
    lines = F.transform(
        F.split(collapsed, "\n"),
        lambda s: fix_table_line(F.rtrim(s, F.lit(_SPACES))),
    )
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"(?s)<!--.*?-->", "")
    spaced = F.translate(joined, "\u00a0\u200b", " ")
    return strip(spaced)


def decode_bytes(content: Column) -> Column:
    """UTF-8 text from raw bytes; undecodable bytes are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))

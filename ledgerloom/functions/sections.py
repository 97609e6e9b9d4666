"""Item sections of annual and quarterly filings, found inside one row.

Headings are marked in one regex pass, so the text is scanned once, not once
per pattern. Positions come from the lengths of the marked pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import let, strip

# Heading patterns with section names, in matching order.
ANNUAL_ITEMS = [
    (r"ITEM\s+1[^A0-9]", "Item 1 - Business"),
    (r"ITEM\s+1A", "Item 1A - Risk Factors"),
    (r"ITEM\s+1B", "Item 1B - Unresolved Staff Comments"),
    (r"ITEM\s+2[^.]", "Item 2 - Properties"),
    (r"ITEM\s+3[^.]", "Item 3 - Legal Proceedings"),
    (r"ITEM\s+4[^.]", "Item 4 - Mine Safety Disclosures"),
    (r"ITEM\s+5[^.]", "Item 5 - Market for Registrant's Common Equity"),
    (r"ITEM\s+6[^.]", "Item 6 - Selected Financial Data"),
    (r"ITEM\s+7A", "Item 7A - Quantitative and Qualitative Disclosures"),
    (r"ITEM\s+7[^A]", "Item 7 - Management's Discussion and Analysis"),
    (r"ITEM\s+8[^.]", "Item 8 - Financial Statements"),
    (r"ITEM\s+9A", "Item 9A - Controls and Procedures"),
    (r"ITEM\s+9B", "Item 9B - Other Information"),
    (r"ITEM\s+9[^AB]", "Item 9 - Changes in and Disagreements"),
    (r"ITEM\s+10[^.]", "Item 10 - Directors and Executive Officers"),
    (r"ITEM\s+11[^.]", "Item 11 - Executive Compensation"),
    (r"ITEM\s+12[^.]", "Item 12 - Security Ownership"),
    (r"ITEM\s+13[^.]", "Item 13 - Certain Relationships"),
    (r"ITEM\s+14[^.]", "Item 14 - Principal Accountant Fees"),
    (r"ITEM\s+15[^.]", "Item 15 - Exhibits and Financial Statement Schedules"),
]
QUARTERLY_ITEMS = [
    (r"ITEM\s+1[^A]", "Item 1 - Financial Statements"),
    (r"ITEM\s+2[^.]", "Item 2 - Management's Discussion and Analysis"),
    (r"ITEM\s+3[^.]", "Item 3 - Quantitative and Qualitative Disclosures"),
    (r"ITEM\s+4[^.]", "Item 4 - Controls and Procedures"),
    (r"ITEM\s+1A", "Item 1A - Risk Factors"),
    (r"ITEM\s+5[^.]", "Item 5 - Other Information"),
    (r"ITEM\s+6[^.]", "Item 6 - Exhibits"),
]
IMPORTANT_ITEMS = [
    "Item 1 - Business",
    "Item 1A - Risk Factors",
    "Item 7 - Management's Discussion and Analysis",
    "Item 8 - Financial Statements",
    "Item 2 - Management's Discussion and Analysis",
    "Item 1 - Financial Statements",
]
MIN_SECTION_CHARS = 100
WHOLE_DOCUMENT = "full_document"

_MARK, _MARK_STAND_IN = "\x01", "\x02"
_HEADING = r"(?i)(ITEM\s+\d)"
# the widest pattern looks at three characters after the blank
_LOOKAHEAD = 3
_SECTIONS = "array<struct<section:string,content:string>>"


def widened(items: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The same items, also matching headings whose number is followed by a full stop."""
    closed = []
    for pattern, name in items:
        number = pattern.split(r"\s+")[1].split("[")[0]
        letters = {"1": "AB0-9", "7": "A0-9", "9": "AB0-9"}.get(number, "0-9")
        closed.append((pattern if number[-1].isalpha() else rf"ITEM\s+{number}[^{letters}]", name))
    return closed


def _item_name(start: Column, items: list[tuple[str, str]]) -> Column:
    """Name for a heading. If several patterns match at one place the last listed
    one owns the text: the others would end where they begin."""
    name = F.lit(None).cast("string")
    for pattern, label in items:
        name = F.when(start.rlike(f"^(?i){pattern}"), F.lit(label)).otherwise(name)
    return name


def _by_items(content: Column, items: list[tuple[str, str]], keep_all: bool) -> Column:
    marked = F.regexp_replace(
        F.replace(content, F.lit(_MARK), F.lit(_MARK_STAND_IN)), _HEADING, f"{_MARK}$1"
    )

    def named(pieces: Column) -> Column:
        """struct<name, length> per piece; name NULL where no pattern matches."""
        return F.transform(
            pieces,
            lambda piece, i: F.struct(
                F.when(
                    i > 0,
                    _item_name(
                        F.concat(
                            F.lit("ITEM "),
                            F.regexp_extract(piece, r"(?is)^ITEM\s+(.{1,3})", 1),
                            F.substr(
                                F.coalesce(F.get(pieces, i + 1), F.lit("")),
                                F.lit(1),
                                F.lit(_LOOKAHEAD),
                            ),
                        ),
                        items,
                    ),
                ).alias("name"),
                F.length(piece).alias("length"),
            ),
        )

    def with_starts(heads: Column) -> Column:
        seed = F.struct(
            F.lit(1).alias("at"),
            F.array().cast("array<struct<name:string,at:int>>").alias("found"),
        )
        return F.aggregate(
            heads,
            seed,
            lambda acc, h: F.struct(
                (acc["at"] + h["length"]).alias("at"),
                F.when(
                    h["name"].isNotNull(),
                    F.concat(
                        acc["found"],
                        F.array(F.struct(h["name"].alias("name"), acc["at"].alias("at"))),
                    ),
                )
                .otherwise(acc["found"])
                .alias("found"),
            ),
            lambda acc: acc["found"],
        )

    def cut(found: Column) -> Column:
        return F.filter(
            F.transform(
                found,
                lambda h, i: F.struct(
                    h["name"].alias("section"),
                    strip(
                        F.substr(
                            content,
                            h["at"],
                            F.coalesce(F.get(found, i + 1)["at"], F.length(content) + 1) - h["at"],
                        )
                    ).alias("content"),
                ),
            ),
            lambda s: F.length(s["content"]) > MIN_SECTION_CHARS,
        )

    texts = let(let(let(F.split(marked, _MARK), named), with_starts), cut)
    return texts if keep_all else let(texts, _last_of_each)


def _last_of_each(sections: Column) -> Column:
    """Of sections with the same name the last text counts, at the first one's place."""
    names = F.array_distinct(F.transform(sections, lambda s: s["section"]))
    return F.transform(
        names,
        lambda n: F.element_at(F.filter(sections, lambda s: s["section"] == n), -1),
    )


def longest_of_each(sections: Column) -> Column:
    """For sections split with keep_all: of those with the same name the longest text,
    which ignores short in-text references to an item."""

    def choose(all_sections: Column) -> Column:
        names = F.array_distinct(F.transform(all_sections, lambda s: s["section"]))
        return F.transform(
            names,
            lambda n: F.array_max(
                F.transform(
                    F.filter(all_sections, lambda s: s["section"] == n),
                    lambda s: F.struct(F.length(s["content"]).alias("size"), s.alias("s")),
                )
            )["s"],
        )

    return let(sections, choose)


def filing_sections(
    content: Column, filing_type: Column, widen: bool = False, keep_all: bool = False
) -> Column:
    """array<struct<section, content>> of a filing text. `widen` also accepts numbers
    followed by a full stop; `keep_all` keeps every section of the same name."""
    fix = widened if widen else (lambda items: items)
    kind = F.upper(filing_type)
    found = F.when(kind.contains("10-K"), _by_items(content, fix(ANNUAL_ITEMS), keep_all)).when(
        kind.contains("10-Q"), _by_items(content, fix(QUARTERLY_ITEMS), keep_all)
    )
    whole = F.array(F.struct(F.lit(WHOLE_DOCUMENT).alias("section"), content.alias("content")))
    return let(
        found.cast(_SECTIONS), lambda f: F.when(F.size(f) > 0, f).otherwise(whole.cast(_SECTIONS))
    )


def important_sections(sections: Column) -> Column:
    """The sections that matter most for financial analysis; all if none does."""
    wanted = F.array(*[F.lit(n) for n in IMPORTANT_ITEMS])

    def choose(all_sections: Column) -> Column:
        kept = F.filter(
            all_sections, lambda s: F.exists(wanted, lambda w: F.contains(s["section"], w))
        )
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(all_sections))

    return let(sections, choose)


def chunk_bounds(paragraph_words: Column, size: int, overlap: int) -> Column:
    """array<struct<first, past>>: word ranges of the chunks of one section.

    Paragraphs are packed whole until the next one would exceed `size`; the next
    chunk repeats the last `overlap` words. Every chunk is one range of the
    section's words, so only paragraph lengths go through the fold.
    """
    ranges = "array<struct<first:int,past:int>>"
    seed = F.struct(
        F.lit(0).alias("first"), F.lit(0).alias("past"), F.array().cast(ranges).alias("done")
    )

    def add(acc: Column, length: Column) -> Column:
        held = acc["past"] - acc["first"]
        full = (held + length > size) & (held > 0)
        return F.struct(
            F.when(full, acc["past"] - F.least(F.lit(overlap), held))
            .otherwise(acc["first"])
            .alias("first"),
            (acc["past"] + length).alias("past"),
            F.when(
                full,
                F.concat(
                    acc["done"],
                    F.array(F.struct(acc["first"].alias("first"), acc["past"].alias("past"))),
                ),
            )
            .otherwise(acc["done"])
            .alias("done"),
        )

    def finish(acc: Column) -> Column:
        rest = F.array(F.struct(acc["first"].alias("first"), acc["past"].alias("past")))
        return F.when(acc["past"] > acc["first"], F.concat(acc["done"], rest)).otherwise(
            acc["done"]
        )

    return F.aggregate(paragraph_words, seed, add, finish)

"""Model responses to values: lists, tagged sections, judge scores.

Regular responses are read by JVM expressions. Only the text of irregular
ones reaches the Python helpers (regular rows pass null).
"""

from __future__ import annotations

import ast
import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIST = T.StructType().add("items", T.ArrayType(T.StringType())).add("error", T.StringType())
_SECTIONS = T.StructType().add("cot", T.StringType()).add("dialogue", T.StringType())

# A list of plain double-quoted items: JSON and Python read it alike.
_PLAIN_LIST = r'^\[\s*+(?:"[^"\\\p{Cntrl}]*+"\s*+(?:,\s*+"[^"\\\p{Cntrl}]*+"\s*+)*+)?\]$'


def bracket_slice(text: Column) -> Column:
    """Text from the first '[' to the first ']'; empty when there is none."""
    start, end = F.locate("[", text), F.locate("]", text)
    return F.when(
        (start > 0) & (end > start), F.substring(text, start, end - start + 1)
    ).otherwise("")


@F.pandas_udf(_LIST)
def _literal_list(text: pd.Series) -> pd.DataFrame:
    rows = []
    for value in text:
        if value is None:
            rows.append((None, None))
            continue
        try:
            items = ast.literal_eval(value)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            rows.append((None, "not a list"))
            continue
        if all(isinstance(item, str) for item in items):
            rows.append((list(items), None))
        else:
            rows.append((None, "item is not text"))
    return pd.DataFrame(rows, columns=["items", "error"])


def parse_list(text: Column) -> Column:
    """struct(items, error) of the Python list inside a response."""
    body = bracket_slice(F.coalesce(text, F.lit("")))
    plain = body.rlike(_PLAIN_LIST)
    other = _literal_list(F.when(plain, F.lit(None).cast("string")).otherwise(body))
    return F.struct(
        F.when(plain, F.from_json(body, "array<string>")).otherwise(other["items"]).alias("items"),
        F.when(~plain, other["error"]).alias("error"),
    )


class _SectionReader(HTMLParser):
    """Text of the first element of each wanted name, markup removed.

    Elements nest: an end tag closes everything opened since its start tag,
    and one without a start tag is ignored.
    """

    VOID = frozenset(
        "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
        "link menuitem meta nextid param source spacer track wbr".split()
    )
    UNREAD = frozenset(["script", "style", "template"])

    def __init__(self, names: tuple[str, ...]):
        super().__init__(convert_charrefs=False)
        self.names = names
        self.stack: list[str] = []
        self.open_at: dict[str, int] = {}
        self.text: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        if tag in self.names and tag not in self.text:
            self.text[tag] = []
            self.open_at[tag] = len(self.stack)
        self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            for name, depth in list(self.open_at.items()):
                if depth == len(self.stack):
                    del self.open_at[name]
            if top == tag:
                break

    def handle_data(self, data):
        if self.stack and self.stack[-1] in self.UNREAD:
            return
        for name in self.open_at:
            self.text[name].append(data)

    def handle_entityref(self, name):
        self.handle_data(html.entities.html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name):
        self.handle_data(html.unescape(f"&#{name};"))


def read_sections(text: str, names: tuple[str, ...]) -> list[str]:
    reader = _SectionReader(names)
    reader.feed(text)
    reader.close()
    return ["".join(reader.text.get(name, [])) for name in names]


@F.pandas_udf(_SECTIONS)
def _markup_sections(text: pd.Series) -> pd.DataFrame:
    rows = []
    for value in text:
        try:
            rows.append((None, None) if value is None else read_sections(value, ("cot", "dialogue")))
        except (AssertionError, ValueError):
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["cot", "dialogue"], dtype="object")


def _between(text: Column, tag: str) -> Column:
    """Plain search for a section; the whole text when a tag is missing."""
    opening, closing = f"<{tag}>", f"</{tag}>"
    start, end = F.locate(opening, text), F.locate(closing, text)
    begin = start + len(opening)
    found = F.when(end > begin, F.substring(text, begin, end - begin)).otherwise("")
    return F.when((start > 0) & (end > 0), found).otherwise(text)


def extract_sections(text: Column) -> Column:
    """struct(cot, dialogue, extraction_path) of a tagged response.

    ``markup``: both sections were found as elements and are not empty.
    ``search``: at least one was not, and both come from the plain search.
    """
    clean = "[^<&]*+"
    cot = rf"<cot>({clean})</cot>"
    dialogue = rf"<dialogue>({clean})</dialogue>"
    forward = rf"(?s)^{clean}{cot}{clean}{dialogue}{clean}$"
    backward = rf"(?s)^{clean}{dialogue}{clean}{cot}{clean}$"
    regular = (
        F.when(text.rlike(forward), F.struct(
            F.regexp_extract(text, forward, 1).alias("cot"),
            F.regexp_extract(text, forward, 2).alias("dialogue"),
        )).when(text.rlike(backward), F.struct(
            F.regexp_extract(text, backward, 2).alias("cot"),
            F.regexp_extract(text, backward, 1).alias("dialogue"),
        ))
    )
    # Without '<' there is no element to find, so the parser can be skipped.
    irregular = F.when(regular.isNull() & text.contains("<"), text)
    parsed = F.coalesce(regular, _markup_sections(irregular))
    usable = F.coalesce((F.length(parsed["cot"]) > 0) & (F.length(parsed["dialogue"]) > 0), F.lit(False))
    return F.when(text.isNotNull(), F.struct(
        F.when(usable, parsed["cot"]).otherwise(_between(text, "cot")).alias("cot"),
        F.when(usable, parsed["dialogue"]).otherwise(_between(text, "dialogue")).alias("dialogue"),
        F.when(usable, "markup").otherwise("search").alias("extraction_path"),
    ))


def judge_score(text: Column) -> Column:
    """First 'Score: n' as an integer of 1 to 10; null otherwise."""
    digits = F.regexp_extract(text, r"Score:\s*(\d+)", 1)
    value = F.when(digits != "", digits.try_cast("int"))
    return F.when(value.between(1, 10), value)

"""Text of HTML pages, by one linear pass of a regular expression over the markup. JVM expressions only."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.arrays import bound
from ledgerline.functions.text import stripped

#: Elements without text of their own, with all they hold (fixed values).
SILENT = ("script", "style")
#: Names of character references and what they stand for; those known longest come first.
NAMED = {n: chr(c) for n, c in html.entities.name2codepoint.items()} | {n.rstrip(";"): c for n, c in html.entities.html5.items()}
#: What numbers from 128 to 159 mean on pages: characters of the code page, where it has one.
OLD = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]
UNKNOWN = "\ufffd"

# A tag's attributes: a quote counts only behind an equals sign and if it is closed, and hides what is in it.
_ATTRIBUTES = r"""[^>=]*+(?:=[\s=]*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
_RAW = "|".join(rf"<{name}(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</{name}(?=[\s/>])[^>]*+>|\z)" for name in SILENT)
#: A piece of markup. Group 1 is text that it shows: what a CDATA section holds, and a last tag that never ends.
MARKUP = (
    r"(?si)<!--(?:-?>|.*?(?:--!?>|\z))"  # a comment; one that isn't closed goes to the end
    r"|<!\[CDATA\[(.*?)\]\]>"
    r"|(<(?=[a-z/!?][^>]*+\z).*+)"
    rf"|{_RAW}"
    r"|<[!?/][^>]*+>"  # a declaration, an instruction, an end tag
    rf"|<[a-z]{_ATTRIBUTES}>"
)
REFERENCE = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*);?"


def character(name: Column) -> Column:
    """What a character reference (without & and ;) stands for; an unknown name stays, without its semicolon."""
    sixteen, ten = F.regexp_extract(name, r"^#[xX]0*([0-9a-fA-F]{1,6})$", 1), F.regexp_extract(name, r"^#0*([0-9]{1,7})$", 1)
    number = F.when(sixteen != "", F.conv(sixteen, 16, 10)).when(ten != "", ten).cast("int")
    plain = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")

    def told(n: Column) -> Column:
        old = F.element_at(F.array(*map(F.lit, OLD)), n - 127)
        none = n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return F.when(none, UNKNOWN).when(n.between(128, 159), old).otherwise(plain)

    known = F.try_element_at(F.from_json(F.lit(json.dumps(NAMED)), "map<string, string>"), name)
    return F.when(name.startswith("#"), told(number)).otherwise(F.coalesce(known, F.concat(F.lit("&"), name)))


def decoded(text: Column) -> Column:
    """The text with its character references replaced, each once."""
    between = F.split(text, REFERENCE, -1)
    names = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    whole = bound(between, lambda b: F.concat(F.element_at(b, 1), F.array_join(F.zip_with(names, F.slice(b, F.lit(2), F.size(b)), lambda n, t: F.concat(character(n), t)), "")))
    return F.when(text.contains("&"), whole).otherwise(text)


def html_to_text(page: Column) -> Column:
    """Text of a page: each stretch between markup is a line or more; lines stripped, empty ones dropped.

    Scripts and styles are silent, with all they hold. Comments, declarations and tags part texts;
    what stands in quotes or comments is no markup. Character references are decoded in the text that is
    left, never as markup. An angle bracket that begins nothing is text. So is a last tag that never ends,
    as a line of its own, and what a CDATA section holds.
    """
    return clean_lines(decoded(F.regexp_replace(page, MARKUP, "\n$1$2\n")))


def clean_lines(text: Column) -> Column:
    """Lines stripped of all blanks; empty ones are dropped."""
    lines = F.transform(F.split(text, "\n"), stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")

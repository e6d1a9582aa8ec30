"""Text functions: HTML to text, sections, fences, templates, normalization. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.arrays import bound, running_sums

TRUNCATED = "\n...[truncated]"
SECTION_CHARS = 5000
CONTEXT_CHARS = 3000
#: Blanks around a text (fixed values).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BETWEEN = _SPACE.replace("[", r"[.\-\u2014")


def _any_case(words: str) -> str:
    """Pattern of words in either case, blanks between them; letters as classes, which are tried faster than a flag."""
    other = {"i": "iI\u0130\u0131", "s": "sS\u017f", "k": "kK\u212a"}
    return "".join(f"{_SPACE}+" if c == " " else f"[{other.get(c, c + c.upper())}]" if c.isalpha() else c for c in words)


#: Phrases that begin or end a section, by name (fixed values). "business" counts where a line begins.
MARKS = {
    "item 1a": "item 1a", "item 1b": "item 1b", "item 1": "item 1", "item 2": "item 2", "item 7a": "item 7a", "item 7": "item 7", "item 8": "item 8", "risk factors": "risk factors",
    "management": "management.?s? discussion and analysis", "quantitative": "quantitative and qualitative", "financial": "financial statements", "business": "business",
}
_ITEMS = "|".join(words.removeprefix("item ") for words in MARKS.values() if words.startswith("item "))
_PHRASES = [_any_case(words).replace(".[sS\u017f]?", ".?[sS\u017f]?") for words in MARKS.values() if not words.startswith(("item ", "business"))]
# The first letter is looked at before the phrases are tried one by one.
_MARK = "(?s)(?=[iI\u0130\u0131rRmMqQfFbB])(?:" + "|".join([_any_case("item ") + f"(?:{_any_case(_ITEMS)})", *_PHRASES, rf"(?:(?<=\n)|\A){_any_case('business')}"]) + ")"
_SIGN, _ROOM = "\x01", "\x02"
#: How a section's heading reads, in the order in which headings are tried, and the marks that end it (fixed
#: values): a mark with another one behind points and dashes, or a mark that ends its line.
SECTIONS = {
    "risk_factors": ((("item 1a", "risk factors"), ("item 1b", "item 2")), (("risk factors", "\n"), ("item 1b", "item 2", "quantitative"))),
    "mda": ((("item 7", "management"), ("item 7a", "item 8")), (("management", ""), ("item 7a", "item 8", "financial"))),
    "business": ((("item 1", "business"), ("item 1a", "item 2")), (("business", "\n"), ("item 1a", "risk factors"))),
}


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _named(mark: Column) -> Column:
    """Name of a mark's text."""
    plain = F.regexp_replace(F.lower(F.translate(mark, "\u0130\u0131\u017f\u212a", "iisk")), f"{_SPACE}+", " ")
    return bound(plain, lambda x: F.when(x.startswith("management"), "management").when(x.startswith("quantitative"), "quantitative").when(x.startswith("financial"), "financial").otherwise(x))


def _marks(text: Column) -> Column:
    """All marks of a text in order, from one pass over it: (name, at, and where a section behind it as a heading begins).

    after, joined and line are places: behind the mark, behind the mark that follows it after points and
    dashes alone (or the word business there), and behind the line that it ends; null where there is none.
    """
    # The pattern runs once: it sets marks off by a sign, which other signs make room for, and the text is cut there.
    cut = F.split(F.regexp_replace(F.translate(text, _SIGN, _ROOM), _MARK, f"{_SIGN}$0{_SIGN}"), _SIGN, -1)
    every_other = lambda x, first: F.filter(x, lambda _, i: i % 2 == first)

    def placed(x: Column) -> Column:
        m, p, ends = x["m"], x["p"], x["ends"]

        def one(mark: Column, i: Column) -> Column:
            after = F.get(ends, i) + F.length(F.get(p, i))  # where the piece behind mark i - 1 ends, mark i begins
            behind, following = F.get(p, i + 1), F.get(m, i + 1)
            end = after + F.length(mark)
            parted = behind.rlike(rf"\A{_BETWEEN}+\z")
            inside = F.length(F.regexp_extract(behind, rf"\A{_BETWEEN}+{_any_case('business')}", 0))
            line = F.length(F.regexp_extract(behind, rf"\A{_SPACE}*\n", 0))
            return F.struct(
                _named(mark).alias("name"), after.alias("at"), end.alias("after"), F.when(parted, _named(following)).when(inside > 0, "business").alias("next"),
                F.when(parted, end + F.length(behind) + F.length(following)).when(inside > 0, end + inside).alias("joined"), F.when(line > 0, end + line).alias("line"),
            )

        return F.transform(m, one)

    def summed(x: Column) -> Column:
        """With ends: where the marks before end, 0 first; running sums of pieces and marks."""
        sizes = F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["m"])), x["m"], lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        return F.struct(x["m"].alias("m"), x["p"].alias("p"), F.concat(F.array(F.lit(0).cast("long")), running_sums(sizes)).alias("ends"))

    pieces = bound(cut, lambda c: F.struct(every_other(c, 1).alias("m"), every_other(c, 0).alias("p")))
    return bound(pieces, lambda x: bound(summed(x), placed))


def sections(text: Column) -> Column:
    """Array of (section, section_text): the body of each filing section that a text has, cut with a marker.

    A section goes from its heading, the first one of a kind, to the nearest mark that ends it; the
    first kind of heading with both counts. Marks are listed by one pass over the text.
    """

    def tried(marks: Column, mark: str, behind: str, ends: tuple[str, ...]) -> Column:
        start = {"": lambda x: x["after"], "\n": lambda x: x["line"]}.get(behind, lambda x: F.when(x["next"] == behind, x["joined"]))
        first = F.get(F.filter(F.transform(F.filter(marks, lambda x: x["name"] == mark), start), lambda at: at.isNotNull()), F.lit(0))

        def to_end(at: Column) -> Column:
            later = F.get(F.filter(marks, lambda x: x["name"].isin(*ends) & (x["at"] >= at)), F.lit(0))["at"]
            return F.substring(text, (at + 1).cast("int"), (later - at).cast("int"))

        return bound(first, to_end)

    def body(marks: Column, name: str) -> Column:
        found = F.coalesce(*(tried(marks, mark, behind, ends) for (mark, behind), ends in SECTIONS[name]))
        return bound(stripped(found), lambda x: truncated(x, SECTION_CHARS))

    return bound(_marks(text), lambda marks: F.array(*(F.struct(F.lit(name).alias("section"), body(marks, name).alias("section_text")) for name in SECTIONS)))


def truncated(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit(TRUNCATED))).otherwise(text)


def unfenced(text: Column) -> Column:
    """What stands in the first code fence, json or plain; the text itself without one."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return F.regexp_replace(F.when(text.contains("```"), inside).otherwise(text), r"^\s+|\s+$", "")


def sentiment(text: Column) -> Column:
    """Label of a model's answer: its JSON value, or keywords where that isn't JSON."""
    value = F.try_variant_get(F.try_parse_json(unfenced(text)), "$.sentiment", "string")
    lower = F.lower(text)
    by_word = F.when(lower.contains("positive") | lower.contains("bullish"), "Neutral-positive").when(lower.contains("negative") | lower.contains("bearish"), "Neutral-negative").otherwise("Neutral")
    by_value = F.when(value == "positive", "Neutral-positive").when(value == "negative", "Neutral-negative").otherwise("Neutral")
    is_object = F.try_parse_json(unfenced(text)).isNotNull() & unfenced(text).startswith("{")
    return F.when(text.isNull(), "Neutral").when(is_object, by_value).otherwise(by_word)


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """The template with {name} replaced; unknown and null names stay as they are, {{ and }} become braces.

    The template is cut into pieces once and each piece replaced by itself, so braces inside values
    are left alone.
    """
    pieces = F.regexp_extract_all(template, F.lit(r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"), F.lit(0))

    def filled(piece: Column) -> Column:
        out = F.when(piece == "{{", "{").when(piece == "}}", "}")
        for name, value in values.items():
            out = out.when((piece == "{" + name + "}") & value.isNotNull(), value.cast("string"))
        return out.otherwise(piece)

    return F.array_join(F.transform(pieces, filled), "")


def key_list(items: Column) -> Column:
    """The items as one line, comma and blank between; null items are left out, no list is an empty line."""
    return F.coalesce(F.array_join(items, ", "), F.lit(""))


def first_given(*columns: Column, default: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(default))


def absolute_url(url: Column, base: str) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit(base), url))


def step_tag(line: Column) -> Column:
    """Text in the first brackets of a progress line, else system."""
    return F.coalesce(F.nullif(F.regexp_extract(line, r"\[([^\]]+)\]", 1), F.lit("")), F.lit("system"))


def last_json_line(output: Column) -> Column:
    lines = F.filter(F.split(output, "\n"), lambda x: F.trim(x).startswith("{"))
    return F.try_element_at(lines, F.lit(-1))


def marked_json(output: Column, start: str, end: str) -> Column:
    """JSON between two markers, else from the first brace to the last."""
    marked = F.regexp_extract(output, rf"(?s)\Q{start}\E(.*?)\Q{end}\E", 1)
    return F.coalesce(F.nullif(F.trim(marked), F.lit("")), F.nullif(F.regexp_extract(output, r"(?s)(\{.*\})", 1), F.lit("")))


def report_fields(output: Column) -> Column:
    """struct of recommendation, confidence and the three scenarios read from a text report."""
    number = lambda pattern: F.expr("null").cast("double") if pattern is None else F.try_to_number(F.nullif(F.regexp_extract(output, pattern, 1), F.lit("")), F.lit("S999999.99")).cast("double")
    fields = [F.nullif(F.regexp_extract(output, r"(?i)recommendation:\s*(\w+)", 1), F.lit("")).alias("recommendation"), (number(r"(?i)confidence[^:]*:\s*([\d.]+)") / 100).alias("confidence")]
    for name in ("bull", "base", "bear"):
        fields += [(number(rf"(?i){name}[^:]*:\s*([+-]?[\d.]+)%") / 100).alias(f"{name}_return"), (number(rf"(?i){name}[^(]*\([^\d]*([\d.]+)%") / 100).alias(f"{name}_prob")]
    return F.struct(*fields)


def sse_kind(line: Column) -> Column:
    """Kind of a line of an event stream."""
    return F.when(line.startswith("event:"), "event").when(line.startswith("data:"), "data").when(line.startswith(":"), "comment").when(F.trim(line) == "", "dispatch").otherwise("other")


def sse_event(event: Column, data: Column) -> Column:
    """An event as text of an event stream: its name unless null, its data, an empty line. Line ends in the data start lines of their own."""
    named = F.coalesce(F.concat(F.lit("event: "), event, F.lit("\n")), F.lit(""))
    return F.concat(named, F.lit("data: "), F.regexp_replace(F.coalesce(data, F.lit("")), r"\r\n|\r|\n", "\ndata: "), F.lit("\n\n"))


def sse_dispatch_kind(event: Column, data: Column) -> Column:
    """Kind of a data line: error, complete, progress or unknown, by its event and then by its JSON; null if it is nothing.

    Text that is no JSON is an error if it speaks of one. Empty texts, zero, false and null don't count
    as a step, a message or data.
    """
    parsed = F.try_parse_json(data)
    field = lambda name: F.try_variant_get(parsed, f"$.{name}", "string")
    given = lambda name: ~F.coalesce(field(name), F.lit("")).isin("", "0", "false")
    status, event = F.coalesce(field("status"), F.lit("")), F.coalesce(event, F.lit(""))
    known = (
        F.when((event == "error") | (status == "error"), "error")
        .when((event == "complete") | (status == "success") & given("data"), "complete")
        .when((event == "progress") | given("step") | given("message"), "progress")
        .otherwise("unknown")
    )
    return F.when(F.trim(data) == "", F.lit(None)).when(parsed.isNull(), F.when(data.rlike("[eE]rror"), "error")).otherwise(known)

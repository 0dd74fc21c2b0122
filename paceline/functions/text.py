"""Prompt rendering, code extraction and response parsing as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers that generated responses carry.
FENCE = "```"
BULLET_START = "- **["
TITLE_END = "]**: "
SECTION_ENDS = ("\n\nBy following these suggestions,", "Here is how the student")
SUGGESTIONS_END = "\n\n[End of Optimization Suggestions]"
SUGGESTION_TAG = "SUGG"

# The sixteen optimization categories of the extraction prompt.
CATEGORY_NAMES = (
    "Algorithm Design Optimization",
    "Data Structure Selection",
    "Memory Usage and Allocation",
    "Loop Efficiency Techniques",
    "Compiler Configuration and Tuning",
    "Multithreading and Concurrency",
    "Data Locality and Cache Awareness",
    "Input/Output Throughput Optimization",
    "Instruction-Level Execution Optimization",
    "Function Call Overhead Reduction",
    "Branching Efficiency",
    "Numerical Computation Optimization",
    "Hardware-Aware System Optimization",
    "Resource Lifetime and Scope Management",
    "Efficient Library and API Utilization",
    "Code Cleaning and Readability Improvements",
)
UNSCORED_CATEGORY = "Code Cleaning and Readability Improvements"
SCORED_CATEGORIES = tuple(name for name in CATEGORY_NAMES if name != UNSCORED_CATEGORY)
UNRECOGNIZED = "N/A"

# Every character that counts as white space, and as a line break.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = f"[{WHITE_SPACE}]"
LINE_BREAKS = ("\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
_FINITE_NUMBER = r"\A\s*[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?\s*\z"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often (or inside whatever lambda) it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column | str) -> Column:
    """Remove white space at both ends, by the Unicode definition (a plain `trim` knows only the blank)."""
    return F.btrim(as_column(text), F.lit(WHITE_SPACE))


def words(text: Column | str) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.array_remove(F.split(strip(text), f"{_SPACE}+"), "")


def lines(text: Column | str) -> Column:
    """Lines of the stripped text; an empty array for blank text.

    Breaks are replaced one by one and split at a single character: both are plain byte
    searches, where a pattern would be compiled for each row.
    """
    stripped = strip(text)
    unified = stripped
    for line_break in LINE_BREAKS:
        unified = F.replace(unified, F.lit(line_break), F.lit("\n"))
    return F.when(stripped != "", F.split(unified, "\n")).otherwise(F.array().cast("array<string>"))


def finite_number(text: Column | str) -> Column:
    """The text as a finite double, or null; stricter than a cast, which also takes `1d` and `NaN`."""
    text = as_column(text)
    return F.when(
        text.rlike(_FINITE_NUMBER),
        F.regexp_replace(text, r"[_\s]", "").try_cast("double"),
    )


def strip_cpp_comments(code: Column | str) -> Column:
    """Drop block comments, then line comments, then outer white space."""
    code = F.regexp_replace(as_column(code), r"(?s)/\*.*?\*/", "")
    return strip(F.regexp_replace(code, r"(?d)//.*", ""))


def render_template(template: Column | str, holes: Mapping[str, Column | str]) -> Column:
    """Fill `{{  name  }}` holes one after the other, in mapping order.

    `template` is a literal when it is a string. Text put in early is seen by later holes.
    """
    filled = F.lit(template) if isinstance(template, str) else template
    for name, value in holes.items():
        filled = F.replace(filled, F.lit("{{  " + name + "  }}"), as_column(value))
    return filled


def before_marker(text: Column | str, marker: str) -> Column:
    """X2, first half: text before the first marker; the whole text without one."""
    return F.substring_index(as_column(text), marker, 1)


def from_marker(text: Column | str, marker: str) -> Column:
    """X2, second half: text from the first marker on; null without one."""
    text = as_column(text)
    position = F.locate(marker, text)
    return F.when(position > 0, F.substr(text, position))


def _first_group(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def extract_first_code_chunk(text: Column | str) -> Column:
    """Body of the first fence that is bare or marked cpp, null without one."""
    return _first_group(as_column(text), rf"(?s){FENCE}(?:cpp)?\n(.*?)\n{FENCE}")


def extract_last_code(text: Column | str, language: str = "cpp", default: str = "No Code") -> Column:
    """Body of the last fence in a language, or the default."""
    bodies = F.regexp_extract_all(as_column(text), F.lit(rf"(?s){FENCE}{language}\n(.*?){FENCE}"), 1)
    return F.coalesce(F.try_element_at(bodies, F.lit(-1)), F.lit(default))


def extract_fenced_trimmed(text: Column | str, default: str = "") -> Column:
    """Body of the first cpp fence, leading white space dropped, or the default."""
    body = _first_group(as_column(text), rf"(?s){FENCE}cpp{_SPACE}*(.*?){FENCE}")
    return F.coalesce(body, F.lit(default))


def extract_tag_block(text: Column | str, tag: str = SUGGESTION_TAG) -> Column:
    """Stripped text of the first `[TAG/]…[/TAG]`, null without one."""
    return strip(_first_group(as_column(text), rf"(?s)\[{tag}/\](.*?)\[/{tag}\]"))


def truncate_at_stop(text: Column | str, stop: str = f"[/{SUGGESTION_TAG}]") -> Column:
    """Text before the stop string."""
    return F.substring_index(as_column(text), stop, 1)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(
    prompt: Column | str,
    row_system: Column | str | None = None,
    global_system: str | None = None,
) -> Column:
    """`array<struct<role, content>>` of the system prompts that exist and the user prompt."""
    messages = []
    if global_system is not None:
        messages.append(_message("system", F.lit(global_system)))
    if row_system is not None:
        row_system = as_column(row_system)
        messages.append(F.when(row_system.isNotNull(), _message("system", row_system)))
    messages.append(_message("user", as_column(prompt)))
    return F.array_compact(F.array(*messages))


def _cut_at_last(text: Column, marker: str) -> Column:
    """Text before the last marker; the whole text without one."""
    def cut(whole: Column) -> Column:
        tail = F.substring_index(whole, marker, -1)
        return F.when(
            F.contains(whole, F.lit(marker)),
            F.substr(whole, F.lit(1), F.length(whole) - F.length(tail) - F.lit(len(marker))),
        ).otherwise(whole)

    return bind(text, cut)


def relevant_section(response: Column | str) -> Column:
    """From the first bracketed bullet to the last closing phrase; empty without a bullet."""
    response = as_column(response)
    start = F.locate(BULLET_START, response)
    section = F.substr(response, start)
    for marker in SECTION_ENDS:
        section = _cut_at_last(section, marker)
    return F.when(start > 0, section).otherwise(F.lit(""))


def strategy_entries(suggestion: Column | str) -> Column:
    """`array<struct<title, content>>`, one entry per title, at its first place with its last text."""
    items = F.transform(F.split(strip(suggestion), r"\n(?=- \*\*\[)"), strip)
    titled = F.filter(
        items, lambda item: F.startswith(item, F.lit(BULLET_START)) & F.contains(item, F.lit(TITLE_END))
    )
    parsed = F.transform(
        titled,
        lambda item: F.struct(
            strip(F.substr(F.substring_index(item, TITLE_END, 1), F.lit(len(BULLET_START) + 1))).alias("title"),
            strip(F.substr(item, F.locate(TITLE_END, item) + len(TITLE_END))).alias("content"),
        ),
    )

    # Sorted by title and place, the entries of a title stand side by side: its first gives the place, its last the text.
    placed = F.transform(parsed, lambda entry, i: F.struct(entry["title"].alias("title"), i.alias("place"), entry["content"].alias("content")))

    def last_per_title(rows: Column) -> Column:
        def ends(step: int) -> Column:
            return F.filter(rows, lambda row, i: ~row["title"].eqNullSafe(F.get(rows, i + step)["title"]))

        folded = F.zip_with(
            ends(-1), ends(1), lambda first, last: F.struct(first["place"].alias("place"), first["title"].alias("title"), last["content"].alias("content"))
        )
        return F.transform(F.array_sort(folded), lambda row: F.struct(row["title"].alias("title"), row["content"].alias("content")))

    return bind(F.array_sort(placed), last_per_title)


def title_content_map(suggestion: Column | str) -> Column:
    """T2 as an ordered map, for sinks."""
    return F.map_from_entries(strategy_entries(suggestion))


def category_names(response: Column | str, allowed: Sequence[str] = SCORED_CATEGORIES) -> Column:
    """Known category names of the plain bullets before the end marker, in order, repeats kept."""
    found = F.regexp_extract_all(before_marker(response, SUGGESTIONS_END), F.lit(r"(?d)- \*\*(.+?)\*\*:"), 1)
    return F.filter(found, lambda name: name.isin(list(allowed)))


def resolve_category(answer: Column | str, categories: Sequence[str] = CATEGORY_NAMES) -> Column:
    """The answer's first line as a category: equal to one, else the first one inside it, else N/A."""

    def match(line: Column) -> Column:
        contained = [F.when(F.contains(line, F.lit(name)), F.lit(name)) for name in categories]
        return F.when(line.isin(list(categories)), line).otherwise(F.coalesce(*contained, F.lit(UNRECOGNIZED)))

    return bind(strip(F.substring_index(as_column(answer), "\n", 1)), match)


def listed(text: Column) -> Column:
    """A JSON list as an array of strings; any other text, in brackets or not, is its only entry."""
    bracketed = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))
    # Strict parsing tells a list from text that only starts like one; the object around it makes the parser read to the end.
    whole = F.try_parse_json(F.when(bracketed, F.concat(F.lit('{"list":'), text, F.lit("}")))).isNotNull()
    return F.when(whole, F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))

"""Column expressions that several jobs share. Missing values: ``filled`` skips null and '', coalesce only null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as white space (tab to carriage return, space, and Unicode's spaces with the BOM).
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The same characters one by one. A pattern would try every character of a text for white space up to its end.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trimmed(c: Column | str) -> Column:
    """Without white space at both ends (Unicode's too, which ``trim`` leaves)."""
    return F.btrim(col(c), F.lit(SPACES))


def collapsed(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(col(c), f"{SPACE}+", " "))


def blank(c: Column | str) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


def filled(*columns: Column | str) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns])


def first_text(*columns: Column | str) -> Column:
    """The first that isn't blank, trimmed; else ''."""
    return F.coalesce(*[F.nullif(trimmed(c), F.lit("")) for c in columns], F.lit(""))


def rate(part: Column, whole: Column) -> Column:
    """part / whole to 4 decimals; 0 where whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(F.coalesce(part, F.lit(0)) / whole, 4))


def percent(c: Column | str) -> Column:
    return F.concat(F.round(col(c) * 100).cast("long").cast("string"), F.lit("%"))


def clipped(c: Column | str, n: int, tail: str = "...") -> Column:
    """The first n characters and ``tail``, where it is longer."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit(tail))).otherwise(col(c))


def file_name(c: Column | str, most: int = 120) -> Column:
    """A title as a file name: no reserved characters, single spaces, no dots at the end, at most so long."""
    clean = collapsed(F.regexp_replace(F.coalesce(col(c), F.lit("")), r'[<>:"/\\|?*#^\[\]]', ""))
    clean = filled(F.regexp_replace(clean, r"\.+$", ""), F.lit("Untitled"))
    return F.when(F.length(clean) > most, trimmed(F.substring(clean, 1, most))).otherwise(clean)


def title_case(c: Column | str) -> Column:
    """Each word's first letter in upper case (``ß`` as ``SS``), the others in lower case; single spaces."""
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(F.split(collapsed(c), " "), word), " ")


def page_link(path: Column, label: Column | None = None) -> Column:
    """A link to a page by its path without ``.md``, with a label if one is given."""
    target = F.regexp_replace(path, r"(?i)\.md$", "")
    tail = F.lit("]]") if label is None else F.when(F.coalesce(label, F.lit("")) == "", F.lit("]]")).otherwise(F.concat(F.lit("|"), label, F.lit("]]")))
    return F.concat(F.lit("[["), target, tail)


def escape_links(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\[\[([^\]]+)\]\]", "`[[$1]]`")


def link_markdown(c: Column | str) -> Column:
    """``[[target|label]]`` as an ordinary link with the scheme ``wiki:``."""
    labelled = F.regexp_replace(col(c), r"\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2](wiki:$1)")
    return F.regexp_replace(labelled, r"\[\[([^\]|]+)\]\]", "[$1](wiki:$1)")


def plain(c: Column | str) -> Column:
    """Without Markdown's bold, links and code marks; trimmed."""
    text = F.regexp_replace(col(c), r"\*\*(.*?)\*\*", "$1")
    text = F.regexp_replace(text, r"\[(.*?)\]\((.*?)\)", "$1")
    return trimmed(F.regexp_replace(text, r"`([^`]+)`", "$1"))


def yaml_scalar(c: Column | str) -> Column:
    """Quoted where it holds one of YAML's marks or a new line."""
    value = F.coalesce(col(c), F.lit(""))
    odd = value.rlike(r"""[:#\[\]{}&*!|>'"%@`\n]""")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(odd, quoted).otherwise(value)


def positive(c: Column | str, default: int) -> Column:
    """A whole number of 1 or more; else the default."""
    return F.when(col(c).cast("double") >= 1, F.floor(col(c).cast("double"))).otherwise(default).cast("int")


def block_of(c: Column | str, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket; null without."""
    return F.nullif(F.regexp_extract(col(c), rf"(?s)\{opening}.*\{closing}", 0), F.lit(""))


def evidence(summary: Column | str = "summary", content: Column | str = "content", snippet: Column | str = "snippet") -> Column:
    """The first of summary, content and snippet that isn't empty, trimmed; one of spaces alone masks the rest."""
    return F.coalesce(trimmed(filled(summary, content, snippet)), F.lit(""))


def ordered(column: Column, *order: str) -> Column:
    """Inside an aggregate: the group's values of ``column`` in the order of the others."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, column.alias("_v")))), lambda x: x["_v"])


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name

"""Commands in plain words: which tool a text asks for, and with what, as expressions over a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tools in the order they are tried, and the words that ask for each.
TOOLS = (
    ("store", ("store", "save", "write", "encode", "upload")),
    ("retrieve", ("retrieve", "read", "get", "load", "decode", "download")),
    ("search", ("search", "find", "query", "look")),
    ("delete", ("delete", "remove", "rm", "erase")),
    ("migrate", ("migrate",)),
    ("status", ("status", "info", "stats", "stat", "pool", "health")),
    ("list", ("list", "ls", "dir", "files")),
    ("help", ("help", "tools", "commands")),
)
#: Endings that make a word a file name.
ENDINGS = ("txt", "bin", "dat", "csv", "json", "xml", "md", "jpg", "png", "gif", "pdf", "doc", "zip", "tar", "log", "html", "rs", "py", "js", "toml", "yaml")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def tool(text: Column) -> Column:
    """The first tool of which a whole word asks; null if none."""
    out = F.lit(None).cast("string")
    for name, asked in reversed(TOOLS):
        out = F.when(F.arrays_overlap(words(text), F.array(*map(F.lit, asked))), name).otherwise(out)
    return out


def filename(text: Column) -> Column:
    """A quoted text, else the dotted word after ``as``, else the first word with a known ending; null if none."""
    some = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    ending = "|".join(ENDINGS)
    return F.coalesce(some('"([^"]*)"', 1), some("'([^']*)'", 1), some(r"(?i) as\s+([^\s]*\.[^\s]*)", 1), some(rf"(?i)(?:^|\s)[^\w.\-\s]*([^\s]*\.(?:{ending}))[^\w.\-\s]*(?=\s|$)", 1))


def redundancy(text: Column) -> Column:
    """``4x``, or the number after ``redundancy`` or ``parity``; null if none is given."""
    low = F.lower(text)
    some = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).cast("int")
    return F.coalesce(some(r"(?:^|\s)([0-9]{1,4})[x×](?=\s|$)"), some(r"(?:^|\s)(?:redundancy|parity)\s+([0-9]{1,4})(?=\s|$)"))


def codec(text: Column) -> Column:
    """The codec named after the word ``codec``, by its full name; null if none."""
    named = F.nullif(F.regexp_extract(F.lower(text), r"(?:^|\s)codec\s+(\S+)", 1), F.lit(""))
    return F.when(named.isin("ternary", "ternary-rotating-cipher"), "ternary-rotating-cipher").when(named.isin("yin-yang", "yinyang", "yin_yang"), "yin-yang").otherwise(named)


#: The words that data and a query follow, in the order they are looked for.
DATA_WORDS, QUERY_WORDS = ("data", "content", "text", "message"), ("search", "find", "query", "look for")


def behind(text: Column, word: str, low: Column) -> Column:
    """What follows the first place of a word, trimmed; null if there is none or nothing."""
    at = F.instr(low, word)
    return F.when(at > 0, F.nullif(F.trim(F.substring(text, at + len(word), F.length(text))), F.lit("")))


def data(text: Column) -> Column:
    """What follows ``data``, ``content``, ``text`` or ``message`` and colons, equal signs or spaces: what is quoted there, or all of it; empty if none."""
    rest = lambda w: F.nullif(F.regexp_replace(behind(text, w, F.lower(text)), "^[:= ]+", ""), F.lit(""))
    given = F.coalesce(*map(rest, DATA_WORDS), F.lit(""))
    return F.when(given.rlike('^"[^"]*"'), F.regexp_extract(given, '^"([^"]*)"', 1)).otherwise(given)


def query(text: Column) -> Column:
    """The lower-cased text behind ``search``, ``find``, ``query`` or ``look for``; null if none."""
    return F.coalesce(*(behind(F.lower(text), w, F.lower(text)) for w in QUERY_WORDS))


def plans(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with tool, filename, redundancy (2 for a store that names none) and codec."""
    text = F.col(text_col)
    asked = tool(text)
    given = redundancy(text)
    return texts.withColumns({"tool": asked, "filename": filename(text), "redundancy": F.when(asked == "store", F.coalesce(given, F.lit(2))).otherwise(given), "codec": codec(text)})

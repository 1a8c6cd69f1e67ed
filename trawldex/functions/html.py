"""HTML expressions: title, text, links, inline tags. All are regular expressions that run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markup patterns, and entities with what they stand for (`&amp;` last).
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LINK = r"(?i)<a\s(?:[^>]*[\s\"'])?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
INLINE = r"</?(?:b|i|t|em|strong|font|a|br)(?:>| [^>]+>)"
ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")]


#: Names of entities and their characters, from Python's table of the HTML standard.
_NAMED = {f"&{name};": " " if name == "nbsp" else chr(point) for name, point in sorted(name2codepoint.items())} | dict(ENTITIES)


#: Stands for a decoded ampersand until all else is decoded. A text that holds this character itself, or the one that escapes it, is escaped first.
_AND, _ESCAPE = "\uffff", "\ufffe"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that it uses more than once, which is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def decode(text: Column) -> Column:
    """Entities as characters: named and numeric ones, each once (`&amp;lt;` is `&lt;`). Others stay as they are."""
    return once(text, lambda t: F.when(F.contains(t, F.lit("&")), _decoded(t)).otherwise(t))


def _decoded(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}0")), F.lit(_AND), F.lit(f"{_ESCAPE}1"))
    out = F.replace(out, F.lit("&amp;"), F.lit(_AND))
    for name, value in ENTITIES[:-1]:  # what nearly all entities are, in compiled code
        out = F.replace(out, F.lit(name), F.lit(value))
    out = once(out, lambda t: F.when(t.rlike(ENTITY), _decode_others(t)).otherwise(t))
    for mark, value in ((_AND, "&"), (f"{_ESCAPE}1", _AND), (f"{_ESCAPE}0", _ESCAPE)):
        out = F.replace(out, F.lit(mark), F.lit(value))
    return out


def _decode_others(text: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])
    digits = lambda e: F.regexp_extract(e, "([0-9A-Fa-f]+);$", 1)
    point = lambda e: F.when(e.rlike("^&#[xX]"), F.conv(digits(e), 16, 10)).otherwise(digits(e)).cast("long")
    letter = lambda p: F.when(p == 38, _AND).otherwise(F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"))
    usable = lambda p: p.between(1, 0xD7FF) | p.between(0xE000, 0xFFFD) | p.between(0x10000, 0x10FFFF)
    value = lambda e: F.when(F.startswith(e, F.lit("&#")), F.when(usable(point(e)), letter(point(e)))).otherwise(F.element_at(named, e))
    found = F.filter(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), 0)), lambda e: F.struct(e.alias("e"), value(e).alias("v"))), lambda x: x["v"].isNotNull())
    return F.aggregate(found, text, lambda t, x: F.replace(t, x["e"], x["v"]))


def title(html: Column) -> Column:
    return decode(F.regexp_extract(html, TITLE, 1))


def text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go first, tags become spaces, white space is collapsed."""
    bare = decode(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), TAG, " "))
    return F.ltrim(F.regexp_replace(F.translate(bare, "\n\t", "  "), " {2,}", " "))


def links(html: Column) -> Column:
    """Targets of all anchors: attributes and names of any case, values in double quotes, single quotes or none."""
    whole = F.regexp_extract_all(html, F.lit(LINK), 0)
    return F.transform(whole, lambda x: F.concat(*[F.regexp_extract(x, LINK, i) for i in (1, 2, 3)]))


def strip_inline_tags(html: Column) -> Column:
    return F.replace(F.regexp_replace(html, INLINE, ""), F.lit("\n"), F.lit(" "))

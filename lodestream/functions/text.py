"""Text of HTML pages, tokens and snippets, as Column expressions.

Tokens are runs of ASCII letters and digits, joined inside by single apostrophes or hyphens,
in lower case. A hyphenated token is followed by its parts at the same position.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: what a token is.
TOKEN_PATTERN = "[a-z0-9]+(?:['-][a-z0-9]+)*"
SNIPPET_WINDOW = 16

_BREAK = "\u0001"
#: Character references by name, from the standard library's table: those that end in a
#: semicolon, and the few that need none, which other letters may follow.
_NAMED = {k: v for k, v in html5.items() if k.endswith(";")}
_BARE = {k: v for k, v in html5.items() if not k.endswith(";")}
#: Numbers that HTML reads as Windows-1252.
_WESTERN = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
_REFERENCE = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"


def _constant(table: dict[str, str]) -> Column:
    """A map as one constant of the plan."""
    return F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in table.items())), F.lit("\u0001"), F.lit("\u0002"))


def _decoded(reference: Column) -> Column:
    """The text of one reference of _REFERENCE; an unknown name stays as it is."""
    digits = F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+)", 1)
    number = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("decimal(38,0)")
    odd = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number.cast("bigint")), 8, "0")), "UTF-32")
    numeric = F.when(odd, "\ufffd").when(number.between(128, 159), F.try_element_at(_constant(_WESTERN), number.cast("string"))).otherwise(char)
    name = F.substr(reference, F.lit(2))
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.length(name) - 1), lambda i: F.left(name, F.length(name) - i)),
                      lambda x: F.try_element_at(_constant(_BARE), x).isNotNull())
    own = F.get(starts, F.lit(0))
    named = F.coalesce(
        F.try_element_at(_constant(_NAMED), name),
        F.concat(F.try_element_at(_constant(_BARE), own), F.substr(name, F.length(own) + 1)), reference)
    return F.when(F.startswith(reference, F.lit("&#")), numeric).when(reference == "&amp;", "&").otherwise(named)


def unescaped(text: Column) -> Column:
    """Character references decoded, once."""
    found = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    rest = F.split(text, _REFERENCE, -1)
    joined = F.array_join(F.zip_with(rest, found, lambda t, r: F.concat(t, F.coalesce(_decoded(r), F.lit("")))), "")
    return F.when(text.rlike(_REFERENCE), joined).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text nodes outside script, style and noscript, trimmed, joined by single spaces."""
    x = F.regexp_replace(html, r"(?is)<!--.*?-->", _BREAK)
    x = F.regexp_replace(x, r"(?is)<(script|style|noscript)\b[^>]*>.*?(</\1\s*>|\z)", _BREAK)
    x = F.regexp_replace(x, r"(?s)<[/!?a-zA-Z][^>]*>", _BREAK)
    nodes = F.transform(F.split(unescaped(x), _BREAK), lambda t: F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.array_join(F.filter(nodes, lambda t: t != ""), " ")


def base_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def expanded(token: Column) -> Column:
    """The token, then its parts if it is hyphenated."""
    return F.when(F.contains(token, F.lit("-")), F.concat(F.array(token), F.split(token, "-"))).otherwise(F.array(token))


def tokens(text: Column, expand_hyphenated: bool = True) -> Column:
    base = base_tokens(text)
    return F.flatten(F.transform(base, expanded)) if expand_hyphenated else base


def token_positions(text: Column, expand_hyphenated: bool = True) -> Column:
    """array of (term, pos); the parts of a token share its position."""
    return F.flatten(F.transform(base_tokens(text), lambda t, i: F.transform(
        expanded(t) if expand_hyphenated else F.array(t), lambda p: F.struct(p.alias("term"), i.alias("pos")))))


def token_rows(docs: DataFrame, keys: Sequence[str], text: str = "text", only: Sequence[str] | None = None) -> DataFrame:
    """One row (keys, term, pos) for each token. With only, rows of other terms are dropped
    before anything is shuffled."""
    rows = docs.select(*keys, F.posexplode(base_tokens(F.col(text))).alias("pos", "base"))
    if only is not None:
        rows = rows.filter(F.col("base").isin(list(only)) | F.contains(F.col("base"), F.lit("-")))
    rows = rows.select(*keys, "pos", F.explode(expanded(F.col("base"))).alias("term"))
    return rows.filter(F.col("term").isin(list(only))) if only is not None else rows


def parse_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text, tokens and token_positions."""
    df = pages.withColumn("text", html_to_text(F.col(html)))
    return df.withColumns({"tokens": tokens(F.col("text")), "token_positions": token_positions(F.col("text"))})


def content_hash(html: Column) -> Column:
    return F.sha1(F.encode(html, "utf-8"))


def _marked(token: Column, terms: Column) -> Column:
    return F.array_contains(terms, token) | (
        F.contains(token, F.lit("-")) & F.exists(F.split(token, "-"), lambda p: F.array_contains(terms, p)))


def with_snippet(df: DataFrame, terms: Sequence[str], text: str = "text", window: int = SNIPPET_WINDOW, name: str = "snippet") -> DataFrame:
    """A window of tokens around the first highlighted one, highlighted ones in brackets."""
    wanted = F.array(*[F.lit(t.lower()) for t in terms if t]) if any(terms) else F.expr("cast(array() as array<string>)")
    width = max(1, window)
    df = df.withColumn("__toks", base_tokens(F.col(text)))
    toks, n = F.col("__toks"), F.size("__toks")
    places = F.filter(F.transform(toks, lambda t, i: F.when(_marked(t, wanted), i)), lambda i: i.isNotNull())
    df = df.withColumn("__focus", F.coalesce(F.get(places, F.lit(0)), F.lit(0)))
    lead = F.greatest(F.lit(0), F.col("__focus") - width // 3)
    df = df.withColumn("__end", F.least(n, lead + width))
    df = df.withColumn("__start", F.when(F.col("__end") - lead < width, F.greatest(F.lit(0), F.col("__end") - width)).otherwise(lead))
    part = F.slice(toks, F.col("__start") + 1, F.col("__end") - F.col("__start"))
    body = F.array_join(F.transform(part, lambda t: F.when(_marked(t, wanted), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)), " ")
    out = F.when(n == 0, "").otherwise(F.concat(
        F.when(F.col("__start") > 0, "... ").otherwise(""), body, F.when(F.col("__end") < n, " ...").otherwise("")))
    return df.withColumn(name, out).drop("__toks", "__focus", "__start", "__end")

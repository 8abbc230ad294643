"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_id(name: Column) -> Column:
    """Names that differ only in letter case or slash direction share a portable id."""
    return F.lower(F.translate(name, "\\", "/"))


def escape_markdown(text: Column) -> Column:
    """Text for the inside of a Markdown line."""
    for plain, safe in (("\\", "\\\\"), ("[", "\\["), ("]", "\\]"), ("<", "&lt;"), (">", "&gt;"), ("`", "\\`"), ("|", "\\|")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def url_path(url: Column) -> Column:
    """Path of a URL without scheme, host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def reference_key(url: Column) -> Column:
    """How a path is referred to: no trailing slash, no ``.html``."""
    return F.regexp_replace(F.regexp_replace(url_path(url), "/+$", ""), "\\.html$", "")


def fold_dots(path: Column) -> Column:
    """Parts of a relative path with ``.`` dropped and ``..`` undone; null if it escapes the root."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("p"), F.lit(False).alias("bad"))
    done = F.aggregate(
        parts,
        start,
        lambda a, x: F.when(x == "..", F.struct(F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["bad"] | (F.size(a["p"]) == 0)).alias("bad"))).otherwise(
            F.struct(F.concat(a["p"], F.array(x)).alias("p"), a["bad"].alias("bad"))
        ),
    )
    return F.when(~done["bad"], F.array_join(done["p"], "/"))


def extension(path: Column) -> Column:
    """Lower-cased extension of the last component; names that begin with a dot have none by it."""
    return F.lower(F.regexp_extract(path, "[^/.][^/]*\\.([^./]+)$", 1))


def line_count(text: Column) -> Column:
    """Lines as a reader counts them: a final newline begins none; at least 1."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.greatest(F.lit(1), newlines + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def percent_encoded(text: Column) -> Column:
    """Percent encoding of all bytes but unreserved characters and slashes, in capital hex."""
    quoted = F.url_encode(text)
    for form, own in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(form), F.lit(own))
    return quoted

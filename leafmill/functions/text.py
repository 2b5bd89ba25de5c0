"""Scalar text functions: URL parts, redaction, presence, names."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from leafmill import fixed_values as fv

# The characters Unicode counts as white space, and the four ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only the ASCII blank."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def fold_case(c: Column) -> Column:
    """Text for comparison without case: texts fold to the same exactly when Unicode
    case folding makes them equal.

    Upper case first, so that sharp s and its like meet their pairs. The capital sharp
    s has no other upper case, and the dotless i must not become a plain one.
    """
    kept = F.translate(c, "\u0131", "\ue131")
    return F.lower(F.replace(F.upper(kept), F.lit("\u1e9e"), F.lit("SS")))


def url_domain(url: Column) -> Column:
    """Network location of a URL: user info, port and case are kept."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def redact_url(url: Column) -> Column:
    """Scheme, lower-cased host, port and path; everything else goes."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    has_host = rest.startswith("//")
    netloc = F.when(has_host, F.regexp_extract(rest, r"^//([^/?#]*)", 1)).otherwise("")
    path = F.regexp_extract(
        F.when(has_host, F.regexp_replace(rest, r"^//[^/?#]*", "")).otherwise(rest),
        r"^([^?#]*)",
        1,
    )
    server = F.regexp_extract(netloc, r"([^@]*)$", 1)
    bracketed = server.startswith("[")
    host = F.lower(
        F.when(bracketed, F.regexp_extract(server, r"^\[([^\]]*)\]", 1)).otherwise(
            F.regexp_extract(server, r"^([^:]*)", 1)
        )
    )
    port_text = F.when(
        bracketed, F.regexp_extract(server, r"^\[[^\]]*\]:(.*)$", 1)
    ).otherwise(F.regexp_extract(server, r"^[^:]*:(.*)$", 1))
    digits = F.regexp_replace(port_text, r"^0+(?=[0-9])", "")
    port = F.when(digits.rlike(r"^[0-9]{1,9}$"), digits.cast("int"))
    broken = (
        (netloc.contains("[") != netloc.contains("]"))
        | ((port_text != "") & (port.isNull() | (port > 65535)))
    )
    place = F.concat(host, F.when(port > 0, F.concat(F.lit(":"), port)).otherwise(""))
    rooted = F.when(
        (place != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)
    ).otherwise(path)
    web = scheme.isin("http", "https", "ftp", "file") & (
        (path == "") | path.startswith("/")
    )
    return F.when(broken, "<invalid-url>").otherwise(
        F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when((place != "") | web, "//").otherwise(""),
            place,
            rooted,
        )
    )


# A look at one character first: most positions of a text fail there, long before the
# word boundary and the alternatives are tried. (?U) gives boundaries,
# blanks and digits their Unicode meaning.
_BEARER = "(?iU)(?=[b])" + fv.BEARER
_ASSIGNMENT = "(?iU)(?=[atpc])" + fv.SECRET_ASSIGNMENT
_PREFIX = "(?U)(?=[sgx])" + fv.SECRET_PREFIX


def _masked(value: Column, step: int) -> Column:
    if step == 0:
        return F.regexp_replace(value, _BEARER, "Bearer <redacted>")
    if step == 1:
        return F.regexp_replace(value, _ASSIGNMENT, "$1=<redacted>")
    return F.regexp_replace(value, _PREFIX, "<redacted>")


def redact_text(value: Column) -> Column:
    """Mask bearer tokens, key assignments and known key prefixes, in this order."""
    for step in range(3):
        value = _masked(value, step)
    return value


def redact_column(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the column masked and the hits of each kind counted.

    Each kind is counted on the text that the kinds before it left. The texts in
    between are columns of their own, so every pattern runs once per use.
    """
    for step, (name, pattern) in enumerate(
        (("bearer_hits", _BEARER), ("assignment_hits", _ASSIGNMENT), ("prefix_hits", _PREFIX))
    ):
        df = df.withColumns(
            {name: F.regexp_count(F.col(column), F.lit(pattern)).cast("long")}
        )
        df = df.withColumn(
            column, F.when(F.col(name) > 0, _masked(F.col(column), step)).otherwise(F.col(column))
        )
    return df


def is_present(value: Column, *, stripped: bool = False) -> Column:
    """Neither null nor one of the texts that stand for nothing."""
    text = value if stripped else strip(value)
    return F.coalesce(~text.isin(fv.ABSENT_TEXTS), F.lit(False))


def schema_name(fields: Column) -> Column:
    """First four field names in sorted order; different schemas may share a name."""
    return F.array_join(F.slice(F.array_sort(fields), 1, 4), "_")


def schema_name_of(fields: Iterable[str]) -> str:
    return "_".join(sorted(fields)[:4])


def _join_urls_batch(base: pa.Array, links: pa.Array) -> pa.Array:
    def join(b, u):
        try:
            return urljoin(b, u)
        except ValueError:
            return u

    return pa.array(
        [
            None if us is None else [None if u is None else join(b or "", u) for u in us]
            for b, us in zip(base.to_pylist(), links.to_pylist())
        ],
        pa.list_(pa.string()),
    )


# Non-deterministic in name only: a filter on the result must not copy the call.
_join_urls = F.arrow_udf(_join_urls_batch, ArrayType(StringType())).asNondeterministic()


def resolve_links(
    records: DataFrame, *, rec: str = "rec", base: str = "url", compat: bool = False
) -> DataFrame:
    """Make the link fields of the record maps absolute; other entries stay untouched.

    Only relative values travel to Python, in one call per record; a record without
    any sends null.
    """
    fields = fv.LINK_FIELDS_COMPAT if compat else fv.LINK_FIELDS
    absolute = r"^http" if compat else r"^https?://"

    def relative(name: str) -> Column:
        value = F.col(rec)[name]
        return F.when((value != "") & ~value.rlike(absolute), value)

    links = F.array(*[relative(n) for n in fields])
    sent = F.when(F.exists(links, lambda u: u.isNotNull()), links)
    out = records.withColumn("_joined", _join_urls(F.col(base), sent))
    names = F.array(*[F.lit(n) for n in fields])
    fixed = lambda k: F.get("_joined", (F.array_position(names, k) - 1).cast("int"))
    return out.withColumn(
        rec, F.transform_values(rec, lambda k, v: F.coalesce(fixed(k), v))
    ).drop("_joined")

"""Path and name expressions. All are JVM expressions but for NFC, which runs only on non-ASCII text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from echofold.errors import InvalidInput

QUARANTINE = ".echofold-quarantine"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column, ascii_only: bool = False) -> Column:
    """Canonical composition. Promise ascii_only and no Python runs at all."""
    return text if ascii_only else F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfc(text))


def leaf(path: Column) -> Column:
    """The part after the last slash; a trailing slash is not part of a name."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def normalized_name(path: Column, ascii_only: bool = False) -> Column:
    return F.lower(nfc(leaf(path), ascii_only))


def extension(path: Column) -> Column:
    """Lower-case text after the leaf's last dot; null without one, and for names that only begin with a dot."""
    found = F.regexp_extract(leaf(path), r"^.+\.([^.]*)$", 1)
    return F.when(leaf(path).rlike(r"^.+\.[^.]*$"), F.lower(found))


def lexical_path(path: Column) -> Column:
    """Absolute path without empty, '.' and '..' components; null if '..' climbs over the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))
    step = lambda a, p: F.when(p != "..", F.struct(F.concat(a["kept"], F.array(p)).alias("kept"), a["ok"].alias("ok"))).otherwise(
        F.struct(F.slice(a["kept"], F.lit(1), F.greatest(F.size(a["kept"]) - 1, F.lit(0))).alias("kept"), (a["ok"] & (F.size(a["kept"]) > 0)).alias("ok"))
    )
    return F.aggregate(parts, start, step, lambda a: F.when(a["ok"], F.concat(F.lit("/"), F.array_join(a["kept"], "/"))))


def normalized_path(path: Column, ascii_only: bool = False) -> Column:
    """lexical_path() in NFC and lower case: how paths are compared."""
    return F.lower(nfc(lexical_path(path), ascii_only))


def path_key(path: Column, ascii_only: bool = False) -> Column:
    return F.sha2(normalized_path(path, ascii_only), 256)


def path_identity_key(path: Column) -> Column:
    """Tells spellings apart that path_key() holds equal."""
    return F.sha2(F.concat(F.lit("spelling-v1\0"), lexical_path(path)), 256)


def snapshot_token(volume: Column, file: Column, size: Column, modified_ns: Column) -> Column:
    """Digest of what identifies a version of a file; a null identity leaves both of its parts out."""
    identity = F.when(volume.isNotNull() & file.isNotNull(), F.concat(volume, F.lit("\0"), file, F.lit("\0"))).otherwise(F.lit(""))
    return F.sha2(F.concat(identity, size.cast("string"), F.lit("\0"), modified_ns.cast("string")), 256)


def contains(root: Column | str, path: Column | str) -> Column:
    """Whether path is root or below it, by whole components."""
    root, path = (F.lit(x) if isinstance(x, str) else x for x in (root, path))
    bare = F.regexp_replace(root, "/+$", "")
    return (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def in_quarantine(path: Column, marker: str = QUARANTINE) -> Column:
    return F.exists(F.split(path, "/"), lambda p: F.lower(p) == marker.lower())


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob over whole paths: *, ?, **, [classes] and {alternates}; * crosses slashes."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if pattern[i : i + 1] == "*":
                i += 1
                if pattern[i : i + 1] == "/" and (i == 2 or pattern[i - 3] == "/"):
                    i += 1
                    out.append("(?:.*/)?")
                    continue
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] in ("!", "^")))
            if end < 0:
                raise InvalidInput(f"unclosed class in glob {pattern!r}")
            inside = pattern[i:end]
            no = "^" if inside[:1] in ("!", "^") else ""
            inside = inside[1:] if no else inside
            ranges = inside.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&").replace("^", "\\^")
            out.append(f"[{no}{ranges}]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        else:
            out.append(re.escape(c))
    if depth:
        raise InvalidInput(f"unclosed alternates in glob {pattern!r}")
    return "(?s)^" + "".join(out) + "$"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rfc3339(at_ns: Column) -> Column:
    """UTC time of nanoseconds since 1970 (also before it), to the microsecond; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_micros(F.floor(at_ns / F.lit(1000)).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_rfc3339(text: Column) -> Column:
    """Nanoseconds of such a time; null for what is none."""
    return F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"))) * 1000

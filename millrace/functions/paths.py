"""Path, pattern and route expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip

#: fixed values: MIME types by suffix
MIME = {
    ".csv": "text/csv", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".gif": "image/gif",
    ".htm": "text/html", ".html": "text/html", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".json": "application/json", ".md": "text/markdown", ".pdf": "application/pdf",
    ".png": "image/png", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".rtf": "application/rtf", ".tif": "image/tiff", ".tiff": "image/tiff",
    ".txt": "text/plain", ".webp": "image/webp", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xml": "text/xml",
}


def normalize(path: Column) -> Column:
    return F.regexp_replace(F.replace(strip(path), F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """The last .ext of the name in lower case; none for names that only start with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]+)$", 1))


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))).cast("bigint")


def ancestors(path: Column) -> Column:
    """All prefixes of a folder path, from '' to the path itself."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.startswith(".") & ~x.isin(".", ".."))


def inside(path: Column, folder: Column) -> Column:
    """In a folder or below it; '' holds everything; 'ab' doesn't hold 'abc/x'."""
    return (folder == "") | (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def mime(path: Column) -> Column:
    pairs = [x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[suffix(path)], F.lit("application/octet-stream"))


def human_size(n: Column) -> Column:
    """One decimal and B, KB, MB, GB or TB."""
    out, size = None, n.cast("double")
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        # half to even, which format_string doesn't do
        text = F.format_string(f"%.1f {unit}", F.bround(size / float(1024**i), 1))
        last = i == 4
        out = F.when(size < float(1024 ** (i + 1)), text) if out is None else out.otherwise(text) if last else out.when(size < float(1024 ** (i + 1)), text)
    return out


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), "^[.-]+|[.-]+$", "")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for lower-cased whole paths; * and ? also match /."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2)
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and close > 0:
            own = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + own[1:] if own[0] == "!" else own) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out.lower()})$"


def matches_any(path: Column, patterns: list[str], empty: bool) -> Column:
    """Whether a path matches one of the patterns, whatever the case; `empty` where there are none."""
    out = F.lit(empty) if not patterns else F.lit(False)
    for p in patterns:
        out = out | F.lower(path).rlike(glob_regex(p))
    return out


def first_route(key: Column, routes: list[tuple[list[str], str]], default: str) -> Column:
    """The name of the first route that lists the key (or *)."""
    out = None
    for keys, name in routes:
        hit = F.lit(True) if "*" in keys else key.isin([k.lower() for k in keys])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def first_glob_route(path: Column, routes: list[tuple[list[str], str]], default: str) -> Column:
    out = None
    for patterns, name in routes:
        hit = F.lit(True) if "*" in patterns else matches_any(path, [p.strip("/") for p in patterns], False)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def clean_user_path(path: Column) -> Column:
    """A path as a user typed it, without white space, then quotes, around it; null where nothing is left."""
    return F.nullif(F.btrim(F.btrim(strip(path), F.lit('"')), F.lit("'")), F.lit(""))


def under_root(root: str, path: Column) -> Column:
    """The path below a root; '' for the root itself, the name alone for a path elsewhere."""
    return F.when(path == root, "").when(path.startswith(root.rstrip("/") + "/"), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(basename(path))


def display_path(path: Column, shared: str, upload: str) -> Column:
    """my_data/... or uploaded_data/... for paths below the two roots, else the name."""
    out = basename(path)
    for root, shown in ((upload, "uploaded_data"), (shared, "my_data")):
        below = path.startswith(root.rstrip("/") + "/")
        out = F.when(path == root, shown).when(below, F.concat(F.lit(f"{shown}/"), under_root(root, path))).otherwise(out)
    return out


def artifact_path(relpath: Column, ending: str) -> Column:
    """Where an artifact of a file lies: the file's folder and name, with another ending for its last two."""
    stem = F.regexp_replace(F.regexp_replace(basename(relpath), r"(?<=.)\.[^.]*$", ""), r"(?<=.)\.[^.]+$", "")
    return F.concat(F.when(parent(relpath) == "", "").otherwise(F.concat(parent(relpath), F.lit("/"))), stem, F.lit(ending))


#: fixed values: a text reader's names of languages
LANGUAGES = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa", "ja": "jpn", "ko": "kor", "zh": "chi_sim", "ar": "ara"}


def reader_language(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[F.lower(code)], F.lit("eng"))


def variant_name(kind: Column, method: Column) -> Column:
    """kind--method with _ for blanks; null where either is missing."""
    part = lambda c: F.replace(F.nullif(strip(c), F.lit("")), F.lit(" "), F.lit("_"))
    return F.concat(part(kind), F.lit("--"), part(method))

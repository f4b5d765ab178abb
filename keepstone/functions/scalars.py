"""Scalar functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepstone import config as C

# --- files ---------------------------------------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty without one; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)$", 1))


def normal_extension(path: Column) -> Column:
    ext = extension(path)
    pairs = [F.lit(x) for kv in C.EXTENSION_ALIASES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[ext], ext)


def file_kind(path: Column) -> Column:
    """junk, image, video, rich, sidecar or other; names go before extensions."""
    ext = extension(path)
    return (
        F.when(F.lower(file_name(path)).isin(*C.JUNK_NAMES), "junk")
        .when(ext.isin(*C.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*C.VIDEO_EXTENSIONS), "video")
        .when(ext.isin(*C.PACKAGE_EXTENSIONS), "rich")
        .when(ext.isin(*C.SIDECAR_EXTENSIONS), "sidecar")
        .otherwise("other")
    )


def root_key(root: Column, path: Column, prefix: str) -> Column:
    """Key of a file over several roots: bare for root 0, unless its first folder looks like a root's prefix."""
    bare = (root == 0) & ~path.startswith(prefix)
    return F.when(bare, path).otherwise(F.concat(F.lit(prefix), root.cast("string"), F.lit("/"), path))


def root_of_key(key: Column, prefix: str) -> Column:
    """(root, path) of a key."""
    found = F.regexp_extract(key, f"^{prefix}([0-9]+)/(.+)$", 1)
    return F.struct(
        F.when(found != "", found.cast("int")).otherwise(F.lit(0)).alias("root"),
        F.when(found != "", F.regexp_extract(key, f"^{prefix}([0-9]+)/(.+)$", 2)).otherwise(key).alias("path"),
    )


def batch_name(path: Column) -> Column:
    """First folder of a path."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("(inbox root)")


def is_screenshot(path: Column, camera: Column) -> Column:
    return F.lower(file_name(path)).contains("screenshot") | ((normal_extension(path) == ".png") & camera.isNull())


# --- dates ---------------------------------------------------------------------------------------------------------


def _plausible(ts: Column, now_year: int) -> Column:
    return F.when(F.year(ts).between(1990, now_year + 1), ts)


def header_time(value: Column, now_year: int) -> Column:
    """A camera's date text, ``Y:m:d H:M:S``; null if it can't be read or isn't plausible."""
    text = F.substring(F.trim(value), 1, 19)
    return _plausible(F.try_to_timestamp(text, F.lit("yyyy:M:d H:m:s")).cast("timestamp_ntz"), now_year)


# The patterns of dates in file and folder names.
NAME_PATTERNS = (
    r"(?<![0-9])[0-9]{4}[0-9]{2}[0-9]{2}[_-][0-9]{2}[0-9]{2}[0-9]{2}",
    r"(?<![0-9])[0-9]{4}[0-9]{2}[0-9]{2}_[0-9]{2}_[0-9]{2}_[0-9]{2}(?![0-9])",
    r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}[-_ ][0-9]{2}[-.][0-9]{2}[-.][0-9]{2}",
)
FOLDER_DAY = r"(?<![0-9])[0-9]{4}[-_.][0-9]{2}[-_.][0-9]{2}(?![0-9])"
FOLDER_MONTH = r"(?<![0-9])[0-9]{4}[-_.][0-9]{2}(?![-_.]?[0-9])"


def name_time(name: Column, now_year: int) -> Column:
    """The first pattern, in order, with a match that is a plausible time."""
    return F.coalesce(*[_first_time(name, p, 6, now_year) for p in NAME_PATTERNS])


def _first_time(text: Column, pattern: str, groups: int, now_year: int) -> Column:
    """First match of a pattern with so many numbers that makes a plausible time."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    digits = F.transform(whole, lambda m: F.regexp_replace(m, "[^0-9]", ""))
    sizes = [(1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2)][:groups]

    def made(d: Column) -> Column:
        parts = [F.substring(d, a, n).cast("int") for a, n in sizes]
        parts += [F.lit(x) for x in {6: [], 3: [12, 0, 0], 2: [1, 12, 0, 0]}[groups]]
        return _plausible(F.try_make_timestamp_ntz(*parts[:5], parts[5].cast("double")), now_year)

    return F.try_element_at(F.filter(F.transform(digits, made), lambda x: x.isNotNull()), F.lit(1))


def folder_time(path: Column, now_year: int) -> Column:
    """(taken_at, source) from the nearest folder that names a day, or else a month; noon, as the time is unknown."""
    parts = F.split(path, "/")
    folders = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))

    def read(folder: Column) -> Column:
        day, month = _first_time(folder, FOLDER_DAY, 3, now_year), _first_time(folder, FOLDER_MONTH, 2, now_year)
        source = F.when(day.isNotNull(), "folder").when(month.isNotNull(), "folder-month")
        return F.struct(F.coalesce(day, month).alias("taken_at"), source.alias("source"))

    return F.try_element_at(F.filter(F.transform(folders, read), lambda x: x["taken_at"].isNotNull()), F.lit(1))


def capture_time(header: Column, path: Column, mtime: Column, now_year: int) -> Column:
    """(taken_at, source): header, then file name, then folders, then the file's own time to the second."""
    head, name, folder = header_time(header, now_year), name_time(file_name(path), now_year), folder_time(path, now_year)
    own = F.date_trunc("second", F.timestamp_seconds(mtime)).cast("timestamp_ntz")
    return F.struct(
        F.coalesce(head, name, folder["taken_at"], own).alias("taken_at"),
        F.when(head.isNotNull(), "exif")
        .when(name.isNotNull(), "filename")
        .when(folder.isNotNull(), folder["source"])
        .otherwise("mtime")
        .alias("source"),
    )


# --- text ----------------------------------------------------------------------------------------------------------


def slugify(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits become one dash; null if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug != "", slug)


def top_slug(slug: Column) -> Column:
    return F.substring_index(slug, "/", 1)


def pretty_slug(slug: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(slug, "-", " "), "/", " › ")


def camera_name(make: Column, model: Column) -> Column:
    """The model if it begins with the make, else both; null if nothing is there."""
    make, model = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    both = F.when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.trim(F.concat(make, F.lit(" "), model)))
    return F.when(both != "", both)


def without_spaces(part: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.trim(part), r"\s*-\s*|\s+", "-"), "-{2,}", "-")
    return F.when(made != "", made).otherwise("_")


def day_of(path: Column) -> Column:
    """Day of a library path, or null for undated paths and those of which only the month is known."""
    parts = F.split(path, "/")
    second = F.try_element_at(parts, F.lit(2))
    known = (parts[0] != C.UNDATED) & second.isNotNull() & ~second.endswith("_" + C.UNKNOWN_DAY)
    return F.when(known, F.substring(second, 1, 10))


def folder_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(parts[0] == C.UNDATED, C.UNDATED).otherwise(F.substring_index(path, "/", 2))


def pretty_day(day: Column) -> Column:
    return F.date_format(day.cast("date"), "EEE d MMM yyyy")


def month_label(month: Column) -> Column:
    return F.date_format(F.concat(month, F.lit("-01")).cast("date"), "MMMM yyyy")


def highlight_path(path: Column, name: Column) -> Column:
    """Folder of a library path above the first level for alternates or duplicates, and a name."""
    folders = F.regexp_replace(path, "/[^/]*$", "")
    top = F.regexp_replace(folders, f"(^|/)({C.ALTERNATES}|{C.DUPLICATES})(/.*)?$", "")
    return F.when(top == "", F.concat(name, F.lit(".jpg"))).otherwise(F.concat(top, F.lit("/"), name, F.lit(".jpg")))


def stamp(path: Column, keywords: Column) -> Column:
    return F.sha1(F.concat(path, F.lit("|"), F.array_join(keywords, ";")))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def clean_tag(tag: Column) -> Column:
    """Trimmed, lower case, blanks collapsed, without commas, at most 40 characters; null if nothing is left."""
    made = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(tag), ",", " "), r"\s+", " ")), 1, 40)
    return F.when(made != "", F.trim(made))


# --- hashes and vectors ----------------------------------------------------------------------------------------------


def hash_halves(hex16: Column) -> Column:
    """A 64-bit hash in hex as two non-negative longs; one signed long would overflow on reading."""
    return F.struct(
        F.conv(F.substring(hex16, 1, 8), 16, 10).cast("long").alias("hi"), F.conv(F.substring(hex16, 9, 8), 16, 10).cast("long").alias("lo")
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes in hex."""
    x, y = hash_halves(a), hash_halves(b)
    return F.bit_count(x["hi"].bitwiseXOR(y["hi"])) + F.bit_count(x["lo"].bitwiseXOR(y["lo"]))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length one; an all-zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def unordered_digest(value: Column) -> Column:
    """Aggregate: a digest of a set of SHA-256 texts that doesn't depend on their order and is added up in parts: their
    number, the exclusive or of their first 60 bits and the sum of the 32 bits behind. Nulls don't count."""
    bits = lambda at, n: F.conv(F.substring(value, at, n), 16, 10).cast("long")
    parts = F.count(value), F.coalesce(F.bit_xor(bits(1, 15)), F.lit(0)), F.coalesce(F.sum(bits(16, 8)), F.lit(0))
    return F.concat_ws("-", *[p.cast("string") for p in parts])

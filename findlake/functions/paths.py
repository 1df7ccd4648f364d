"""Repository-relative paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findlake.functions import fixed
from findlake.functions.text import bound


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Empty for a path without a directory."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the base name, lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def normalize(path: Column) -> Column:
    """``.`` dropped and ``..`` folded; a climb past the root stays visible and matches no file."""

    def fold(done: Column, segment: Column) -> Column:
        climb = F.when(
            (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1)) == ".."), F.concat(done, F.array(F.lit("..")))
        ).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        return (
            F.when(segment.isin("", "."), done).when(segment == "..", climb).otherwise(F.concat(done, F.array(segment)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold), "/")


def join(directory: Column, relative: Column) -> Column:
    return normalize(F.concat_ws("/", directory, relative))


def ancestors(path: Column) -> Column:
    """Every directory prefix of the path and the path itself, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def suffixes(path: Column) -> Column:
    """The path and what is left of it after dropping leading directories, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def to_repository_path(raw: Column, root: Column) -> Column:
    """A path or ``file:`` URI a tool printed, made repository-relative; null when it is outside
    the root or climbs with ``..``. ``+`` is not a space in these URIs, so it is protected."""
    base = F.regexp_replace(root, r"/+\z", "")
    after = F.regexp_replace(raw, r"^file:(?://(?:localhost)?)?", "")
    decoded = F.try_url_decode(F.replace(after, F.lit("+"), F.lit("%2B")))

    def inside(path: Column) -> Column:
        return F.when(~path.startswith("/"), path).when(
            path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))
        )

    def clean(parts: Column) -> Column:
        return F.when(~F.array_contains(parts, "..") & (F.size(parts) > 0), F.array_join(parts, "/"))

    relative = bound(F.when(raw.startswith("file:"), decoded).otherwise(raw), inside)
    return bound(F.filter(F.split(relative, "/"), lambda s: ~s.isin("", ".")), clean)


def is_test_path(path: Column) -> Column:
    return path.rlike(fixed.TEST_PATH_PATTERN) | path.rlike(fixed.TEST_CLASS_PATTERN)


def is_ignored_path(path: Column) -> Column:
    """Dependency, build-output or hidden directory, or a generated file name. ``bin`` and ``obj``
    beside a build tool need the file listing: see ``operators.scan.drop_ignored``."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(directories, lambda s: s.startswith(".") & ~s.isin(".", ".."))
    owned = F.arrays_overlap(directories, F.array(*[F.lit(d) for d in fixed.IGNORED_DIRS]))
    return hidden | owned | basename(path).rlike(fixed.GENERATED_NAME_PATTERN)


def is_secret_file(path: Column) -> Column:
    """Files that hold credentials by their name."""
    name = F.lower(basename(path))
    return name.rlike(r"^\.env[\p{L}\p{N}_.]*\z|^.+\.(pem|key|p12|pfx|jks|keystore)\z|^config\.env\z|^id_rsa")
